"""Sorted value lists: distributed rank and predecessor, gaps, block index, lookups, lengths and entropies.

A global order without a single task: values are cut into ranges at approximate quantiles (plain numbers, so a recomputed
task sees the same cuts), windows run within a range, and the few figures of each range (its size, its last value) are
carried over from one range to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from primeweave.functions import arith

#: Ranges a list is cut into at most, and rows of one at least.
RANGES, ROWS_A_RANGE = 2000, 50_000


def ranges(df: DataFrame, key: str) -> Column:
    """The number of the range that the key, a number, falls in."""
    n = df.count()
    parts = min(RANGES, max(1, n // ROWS_A_RANGE))
    if parts == 1:
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
    cuts = sorted(set(cuts))
    kind = df.schema[key].dataType
    return F.size(F.filter(F.array(*(F.lit(c).cast(kind) for c in cuts)), lambda c: c <= F.col(key)))


def ranked(df: DataFrame, key: str, *ties: Column, name: str = "rank", descending: bool = False) -> DataFrame:
    """Adds the row's position from 0 by key (a number), then ties."""
    rows = df.withColumn("_range", ranges(df, key))
    order = [F.col(key).desc() if descending else F.col(key).asc(), *ties]
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # RANGES rows at most
    way = F.col("_range").desc() if descending else F.col("_range").asc()
    sizes = sizes.select("_range", (F.sum("_n").over(Window.orderBy(way)) - F.col("_n")).alias("_from"))
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return rows.join(F.broadcast(sizes), "_range").withColumn(name, (F.col(name) + F.col("_from")).cast("long")).drop("_range", "_from")


def with_previous(df: DataFrame, key: str, name: str = "previous") -> DataFrame:
    """Adds the next smaller row's key (null for the first); keys are numbers."""
    rows = df.withColumn("_range", ranges(df, key))
    last = rows.groupBy("_range").agg(F.max(key).alias("_last"))  # RANGES rows at most
    last = last.select("_range", F.max("_last").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rows = rows.withColumn(name, F.lag(key).over(Window.partitionBy("_range").orderBy(key)))
    return rows.join(F.broadcast(last), "_range").withColumn(name, F.coalesce(name, "_before")).drop("_range", "_before")


def gaps(values: DataFrame, key: str) -> DataFrame:
    """(key, gap): distance to the value before; the first is absolute."""
    return with_previous(values.select(key), key).select(key, (F.col(key) - F.coalesce("previous", F.lit(0))).alias("gap"), F.col("previous").isNull().alias("first"))


def rebuilt(gap_rows: DataFrame, rank: str, gap: str) -> DataFrame:
    """(rank, value): running sums of gaps in rank order."""
    rows = gap_rows.withColumn("_range", ranges(gap_rows, rank))
    sums = rows.groupBy("_range").agg(F.sum(gap).alias("_s"))
    sums = sums.select("_range", (F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).alias("_from"))
    running = F.sum(gap).over(Window.partitionBy("_range").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("value", running).join(F.broadcast(sums), "_range").select(rank, (F.col("value") + F.col("_from")).cast("long").alias("value"))


def block_index(values: DataFrame, key: str, block: int) -> DataFrame:
    """(block_id, first_value, rank_base, n_rows): one row a block of a sorted list."""
    rows = ranked(values.select(key), key)
    return rows.groupBy((F.floor(F.col("rank") / block)).cast("long").alias("block_id")).agg(F.min(key).alias("first_value"), F.min("rank").alias("rank_base"), F.count("*").alias("n_rows"))


def lookup(values: DataFrame, key: str, asked: DataFrame, query: str) -> DataFrame:
    """For each asked value: is_member, predecessor (greatest not above), successor (least not below) and rank (how many not above).

    Both sides are merged in one order; no row is compared with all others.
    """
    own = values.select(F.col(key).alias("v")).distinct().withColumn("asked", F.lit(0))
    q = asked.select(F.col(query).alias("v")).distinct().withColumn("asked", F.lit(1))
    rows = own.union(q)
    part = rows.withColumn("_range", ranges(rows, "v"))
    up = Window.partitionBy("_range").orderBy("v", "asked").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_range").orderBy(F.desc("v"), F.desc("asked")).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.when(F.col("asked") == 0, F.col("v"))
    marks = part.groupBy("_range").agg(F.max(mine).alias("hi"), F.min(mine).alias("lo"), F.count(mine).alias("n"))
    before, after = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    marks = marks.select("_range", F.max("hi").over(before).alias("hi"), F.min("lo").over(after).alias("lo"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    part = part.withColumns({"p": F.max(mine).over(up), "s": F.min(mine).over(down), "r": F.count(mine).over(up)}).join(F.broadcast(marks), "_range")
    out = part.where("asked = 1").select(F.col("v").alias(query), F.coalesce("p", "hi").alias("predecessor"), F.coalesce("s", "lo").alias("s"), (F.col("r") + F.col("n")).alias("rank"))
    member = F.coalesce(F.col("predecessor") == F.col(query), F.lit(False))
    return out.select(query, member.alias("is_member"), "predecessor", F.when(member, F.col(query)).otherwise(F.col("s")).alias("successor"), "rank")


def code_lengths(gap_rows: DataFrame, key: str) -> DataFrame:
    """One row of the list's code lengths in bits: gap(S), delta overhead, trie edges, VByte with and without differencing."""
    bits, gap = arith.bits, F.col("gap")
    prev = F.col(key) - gap
    vbyte = lambda v: 8 * arith.vbyte_length(v)
    return gap_rows.agg(
        F.count("*").alias("n"),
        F.sum(F.log2(gap + 1)).alias("gap_bits"),
        F.sum(F.when(~F.col("first"), 2 * bits(bits(gap)))).alias("delta_overhead_bits"),
        F.sum(F.when(~F.col("first"), bits(F.col(key).bitwiseXOR(prev)))).alias("trie_edges"),
        F.sum(vbyte(gap)).alias("vbyte_gap_bits"),
        F.sum(vbyte(F.col(key))).alias("vbyte_absolute_bits"),
    )


def entropy(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., n, distinct_symbols, entropy_bits) of a column `sym` with counts `cnt`."""
    sums = rows.groupBy(*by).agg(F.sum("cnt").alias("n"), F.count("*").alias("symbols"), F.sum(F.col("cnt") * F.log2("cnt")).alias("s"))
    return sums.select(*by, "n", "symbols", (F.col("n") * F.log2("n") - F.col("s")).alias("entropy_bits"))


def residue_classes(values: DataFrame, key: str, modulus: int) -> DataFrame:
    """(r, n_values, k_first, k_last): classes of a sorted set modulo M and the quotients at their ends."""
    k = ((F.col(key) - F.col(key) % modulus) / modulus).cast("long")
    return values.select((F.col(key) % modulus).alias("r"), k.alias("k")).groupBy("r").agg(F.count("*").alias("n_values"), F.min("k").alias("k_first"), F.max("k").alias("k_last"))
