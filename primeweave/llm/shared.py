"""What several operators need: staged tables in the shared folder, connected components, crc32 folds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave.stages import Stages, batch_rows, delete  # noqa: F401  as the operators know them

#: What operators remember in a worker, by operator.
_REMEMBERED: dict[str, dict] = {}


def remembers(name: str) -> dict:
    """A worker's memory for an operator."""
    return _REMEMBERED.setdefault(name, {})


def at_work(name: str) -> None:
    """Called as an operator's task begins: a reused worker forgets what others remembered."""
    for other, what in _REMEMBERED.items():
        if other != name:
            what.clear()
    give_back()


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can give freed memory back
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_SCANS = re.compile(r"[\s:+|-]*(Project|Filter|Relation|LocalRelation)\b")


def replayable(stages: Stages, df: DataFrame) -> DataFrame:
    """The rows themselves where they are a plain scan, whose places are the same whenever a task is run again; else staged."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    return df if all(_SCANS.match(x) for x in plan) else stages.put(df, "input")


def numbered(df: DataFrame) -> DataFrame:
    """(row, doc): rows of a replayable table by their place in its scan, so that repeated ids don't meet; doc has all their columns."""
    return df.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"))


#: Rows and bytes on disk of a table that is broadcast at most; beyond, it is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20


def fits(staged: DataFrame) -> bool:
    """Whether a staged table may be broadcast."""
    spark = staged.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(staged._stage_path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return size <= BROADCAST_BYTES and staged.count() <= BROADCAST_ROWS


def small(df: DataFrame, stages: Stages, name: str) -> DataFrame:
    """Staged; marked for broadcast where it is small enough."""
    df = stages.put(df, name)
    return F.broadcast(df) if fits(df) else df


def fold(id_col: str, mod: int):
    """crc32 of the id as text, mod the number of folds."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(mod)


def _priority(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))


def components(stages: Stages, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in edges(a, b). Links stay distributed.

    Each round every node points to the neighbour of least random priority (itself included), the pointers are jumped
    until they rest, and links between the roots that remain go to the next round. Nodes without a link inside the rest
    leave, so the links shrink by a constant factor a round.
    """
    spark = stages.spark
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stages.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        parent = both(links).groupBy("a").agg(F.min(_priority("b")).alias("m"))
        parent = parent.select(F.col("a").alias("id"), F.least(F.col("m"), _priority("a")).getField("v").alias("root"))
        parent = stages.put(parent, "parents")
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = parent.join(up, "root").select("id", "root", "next")
            jumped = stages.put(jumped, "parents")
            moved = not jumped.where("root <> next").isEmpty()
            stages.drop(parent)
            parent = jumped.select("id", F.col("next").alias("root"))
            parent._stage_path = jumped._stage_path
            if not moved:
                break
        maps.append(parent)
        a = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rest = links.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rest = stages.put(rest, "links")
        stages.drop(links)
        links = rest
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return spark.createDataFrame([], f"id {dict(edges.dtypes)['a']}, component {dict(edges.dtypes)['a']}")
    # every node's chain of roots through the rounds
    def onto(below: DataFrame, above: DataFrame) -> DataFrame:
        up = above.select(F.col("id").alias("root"), F.col("root").alias("top"))
        return below.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root"))

    final = reduce(onto, maps)
    least = final.groupBy("root").agg(F.min("id").alias("component"))
    return final.join(least, "root").select("id", "component")
