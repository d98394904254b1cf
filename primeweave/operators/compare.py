"""Comparing relations: sets, positions, duplicates, totals; the verdicts of a certification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeweave.operators.lists import ranked

SAME, DIFFERENT = "SAME SET", "DIFFERENT"
VERIFIED, DECODED, CERTIFIED, FAILED = "VERIFIED", "DECODED", "CERTIFIED", "FAILED"


def full_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: common, only_a, only_b of two sets of keys."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1))
    y = b.select(key).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, key, "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    return both.agg(n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), n(F.col("_b").isNull()).alias("only_a"), n(F.col("_a").isNull()).alias("only_b"))


def set_verdict(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return full_compare(a, b, key).select(F.when((F.col("only_a") == 0) & (F.col("only_b") == 0), SAME).otherwise(DIFFERENT).alias("verdict"))


def multiset_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys, counted as often as they repeat, are common, only in a or only in b, and whether all agree."""
    x, y = a.groupBy(key).agg(F.count("*").alias("_p")), b.groupBy(key).agg(F.count("*").alias("_q"))
    p, q = F.coalesce("_p", F.lit(0)), F.coalesce("_q", F.lit(0))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return x.join(y, key, "full_outer").agg(none(F.least(p, q)).alias("common"), none(F.greatest(p - q, F.lit(0))).alias("only_a"), none(F.greatest(q - p, F.lit(0))).alias("only_b"), (none(F.abs(p - q)) == 0).alias("same"))


def positional_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(rank, left_value, right_value) where two sorted lists differ at a position."""
    x = ranked(a.select(F.col(key).alias("left_value")), "left_value")
    y = ranked(b.select(F.col(key).alias("right_value")), "right_value")
    return x.join(y, "rank", "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value"))).select("rank", "left_value", "right_value")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def totals(values: DataFrame, key: str) -> DataFrame:
    """(record_count, total_check): the sum is exact in decimals, far below 2**128."""
    return values.agg(F.count("*").alias("record_count"), F.sum(F.col(key).cast("decimal(25,0)")).cast("string").alias("total_check"))


def certify(decoded: DataFrame, reference: DataFrame, key: str) -> str:
    """CERTIFIED if both lists agree in count, total and every position; else FAILED."""
    if totals(decoded, key).first() != totals(reference, key).first():
        return FAILED
    return CERTIFIED if positional_compare(decoded, reference, key).isEmpty() else FAILED
