"""Tables staged in the shared folder."""

from __future__ import annotations

import atexit
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from primeweave import importable, shared_folder

#: Rows of an Arrow batch: texts are long, and a batch is held a few times over.
ARROW_ROWS = "2000"


def batch_rows(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, unless the session has a size of its own; the workers find the package."""
    importable(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Stages:
    """Tables written in the shared folder, so that later jobs survive lost executors; dropped on request or at exit."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, shared_folder(spark), []
        batch_rows(spark)
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        self.paths.append(f"{self.folder}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def put(self, df: DataFrame, name: str = "stage", options: dict[str, str] | None = None) -> DataFrame:
        path, began = self.path(name), time.monotonic()
        df.write.options(**(options or {})).parquet(path)
        if time.monotonic() - began > 2:
            self.spark._jvm.System.gc()  # what nothing refers to any more, shuffle files of finished jobs among it, is cleaned now
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the given staged tables, or all."""
        self._delete([f._stage_path for f in frames] or list(self.paths))

    def only(self, *frames: DataFrame) -> None:
        """Delete all staged tables but the given ones."""
        kept = {f._stage_path for f in frames}
        self._delete([p for p in self.paths if p not in kept])

    def _delete(self, gone: list[str]) -> None:
        for p in gone:
            self.paths.remove(p)
            try:
                delete(self.spark, p)
            except Exception:  # noqa: BLE001  the session may have ended: the folder goes with it
                return
