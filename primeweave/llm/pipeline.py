"""The corpus pipeline: five stages from `documents` to packed sequences.

Each stage reads what the one before it kept, as Parquet, and takes (spark, docs, sf_dir). All but the last return the columns
of documents. Null and empty texts pass the filters (they are neither toxic, near copies nor contaminated) and pack as one end
token; rows may repeat: equal rows are near duplicates of each other, and one stays. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from primeweave.llm.shared import Stages, numbered, small

SEQUENCE = 4096


def _texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): rows by their place in the scan of the stage's Parquet input, so that repeated ids don't meet."""
    return numbered(docs).select("row", "doc.doc_id", "doc.text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents but those of rejected(row)."""
    stages = Stages(docs.sparkSession)
    left = numbered(docs).join(small(rejected, stages, "rejected"), "row", "left_anti")
    return left.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the labels of the documents at hand."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxicity.score(_texts(docs), model, id_col="row").where("predicted = 1").select("row"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents of which no word is left."""
    out = line_dedup.deduplicated(docs)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    rows = _texts(docs).select(F.struct("doc_id", "row").alias("at"), "text")
    found = ngram_join.near_duplicates(rows, id_col="at")
    return _without(docs, found.where("component_id <> at").select("at.row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more lie in benchmark windows."""
    found = decontamination.contamination(_texts(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return _without(docs, found.where(decontamination.contaminated()).select("row"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=SEQUENCE, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: SQL can't say compression distances or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stages.put(stage(spark, docs, sf_dir), name)
    return docs
