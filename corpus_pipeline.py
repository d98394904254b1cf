"""The corpus pipeline; its stages are in primeweave.llm.pipeline."""

from primeweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
