"""Queries over sorted value lists; the list is the events' timestamps in microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave.functions import arith
from primeweave.operators import lists
from primeweave.plans.registry import query, table

V_SQL = "with v as (select distinct epoch_us(ts) as v from events)"
#: Lookups ask for every value, moved by a remainder.
ASKED_SQL = ", q as (select v + (v % 5) - 2 as q from v)"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("v")).distinct()


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select((F.col("v") + F.col("v") % 5 - 2).alias("q")).distinct()


@query("block_index", V_SQL + " select (r // 4096)::bigint as block_id, min(v) as first_value, min(r)::bigint as rank_base, count(*) as n_rows from (select v, row_number() over (order by v) - 1 as r from v) group by 1")
def _(spark, d):
    return lists.block_index(values(spark, d), "v", 4096)


LOOKUP_SQL = V_SQL + ASKED_SQL + ", a as (select distinct q from q), o as (select v, row_number() over (order by v) as i from v), l as (select q, x.v as predecessor, y.v as successor, coalesce(x.i, 0) as rank from a asof left join o x on q >= x.v asof left join o y on q <= y.v)"


@query("point_lookup", LOOKUP_SQL + " select q, coalesce(predecessor = q, false) as is_member from l")
def _(spark, d):
    return lists.lookup(values(spark, d), "v", asked(spark, d), "q").select("q", "is_member")


@query("predecessor_successor", LOOKUP_SQL + " select q, predecessor, successor from l")
def _(spark, d):
    return lists.lookup(values(spark, d), "v", asked(spark, d), "q").select("q", "predecessor", "successor")


@query("rank_of_value", LOOKUP_SQL + " select q, rank from l")
def _(spark, d):
    return lists.lookup(values(spark, d), "v", asked(spark, d), "q").select("q", "rank")


@query("rank_select", V_SQL + " select r::bigint as rank, v from (select v, row_number() over (order by v) - 1 as r from v)")
def _(spark, d):
    return lists.ranked(values(spark, d), "v").select("rank", "v")


@query("range_enumerate", V_SQL + ", b as (select min(v) as lo, max(v) as hi from v) select v from v, b where v >= lo + (hi - lo) // 4 and v < lo + (hi - lo) // 2")
def _(spark, d):
    v = values(spark, d)
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    return v.where(F.col("v").between(lo + (hi - lo) // 4, lo + (hi - lo) // 2 - 1)) if lo is not None else v


@query("find_block", LOOKUP_SQL + " select q, case when rank = 0 then null else ((rank - 1) // 4096)::bigint end as block_id from l")
def _(spark, d):
    found = lists.lookup(values(spark, d), "v", asked(spark, d), "q")
    return found.select("q", F.when(F.col("rank") > 0, arith.quotient(F.col("rank") - 1, F.lit(4096))).alias("block_id"))


@query("block_stride_sample", V_SQL + " select v, r::bigint as rank from (select v, row_number() over (order by v) - 1 as r from v) where (r // 64) % 10 = 0")
def _(spark, d):
    return lists.ranked(values(spark, d), "v").where("floor(rank / 64) % 10 = 0").select("v", "rank")


@query("stride_sample", V_SQL + " select v, r::bigint as rank from (select v, row_number() over (order by v) - 1 as r from v) where r % 17 = 0")
def _(spark, d):
    return lists.ranked(values(spark, d), "v").where("rank % 17 = 0").select("v", "rank")


@query("max_bits_cut", V_SQL + ", m as (select avg(v)::bigint as c from v) select count(*) as n, max(v) as greatest from v where v < (1::bigint << (length(bin((select c from m))) - 1)) + 400000000000000")
def _(spark, d):
    v = values(spark, d)
    c = int(v.agg(F.avg(F.col("v").cast("decimal(20,0)"))).first()[0] or 0)
    return v.where(F.col("v") < (1 << max(c.bit_length() - 1, 0)) + 400000000000000).agg(F.count("*").alias("n"), F.max("v").alias("greatest"))


GAPS_SQL = V_SQL + ", g as (select v, v - coalesce(lag(v) over (order by v), 0) as gap, lag(v) over (order by v) is null as f from v)"


@query("value_gaps", GAPS_SQL + " select v, gap from g")
def _(spark, d):
    return lists.gaps(values(spark, d), "v").select("v", "gap")


@query("gap_rebuild", V_SQL + " select row_number() over (order by v) - 1 as rank, v as value from v")
def _(spark, d):
    return lists.rebuilt(lists.ranked(lists.gaps(values(spark, d), "v"), "v"), "rank", "gap")


@query("gap_stats", GAPS_SQL + " select count(*) as n, round(sum(log2(gap + 1)), 3) as gap_bits, sum(gap)::bigint as total_gap, max(gap) filter (not f) as widest, min(gap) filter (not f) as narrowest from g")
def _(spark, d):
    g = lists.gaps(values(spark, d), "v")
    inner = F.when(~F.col("first"), F.col("gap"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum(F.log2(F.col("gap") + 1)), 3).alias("gap_bits"), F.sum("gap").alias("total_gap"), F.max(inner).alias("widest"), F.min(inner).alias("narrowest"))


@query("delta_overhead", GAPS_SQL + " select sum(2 * length(bin(length(bin(gap)))))::bigint as delta_overhead_bits from g where not f")
def _(spark, d):
    return lists.code_lengths(lists.gaps(values(spark, d), "v"), "v").select(F.col("delta_overhead_bits").cast("long").alias("delta_overhead_bits"))


@query("trie_edges", GAPS_SQL + " select sum(length(bin(xor(v, v - gap))))::bigint as trie_edges from g where not f")
def _(spark, d):
    return lists.code_lengths(lists.gaps(values(spark, d), "v"), "v").select(F.col("trie_edges").cast("long").alias("trie_edges"))


@query("vbyte_lengths", GAPS_SQL + " select sum(8 * greatest(1, ceil(length(bin(gap)) / 7.0)))::bigint as vbyte_gap_bits, sum(8 * greatest(1, ceil(length(bin(v)) / 7.0)))::bigint as vbyte_absolute_bits from g")
def _(spark, d):
    return lists.code_lengths(lists.gaps(values(spark, d), "v"), "v").select(F.col("vbyte_gap_bits").cast("long").alias("vbyte_gap_bits"), F.col("vbyte_absolute_bits").cast("long").alias("vbyte_absolute_bits"))


@query("bits_per_value", GAPS_SQL + " select count(*) as n, round(sum(8 * ceil(length(bin(gap)) / 7.0)) / count(*), 6) as vbyte_bits_each, round(128.0 * count(*) / sum(8 * ceil(length(bin(gap)) / 7.0)), 6) as against_raw16 from g")
def _(spark, d):
    c = lists.code_lengths(lists.gaps(values(spark, d), "v"), "v")
    return c.select("n", F.round(F.col("vbyte_gap_bits") / F.col("n"), 6).alias("vbyte_bits_each"), F.round(128.0 * F.col("n") / F.col("vbyte_gap_bits"), 6).alias("against_raw16"))


@query("length_histogram", GAPS_SQL + " select length(bin(gap))::int as bits, count(*) as cnt from g where not f group by 1")
def _(spark, d):
    return lists.gaps(values(spark, d), "v").where("not first").groupBy(arith.bits(F.col("gap")).alias("bits")).agg(F.count("*").alias("cnt"))


@query("length_entropy", GAPS_SQL + ", h as (select length(bin(gap)) as b, count(*) as c from g where not f group by 1), t as (select sum(c) as n from h) select n::bigint as n, count(*) as symbols, round(sum(-c * log2(c / n)), 3) as entropy_bits, sum(c * (b - 1))::bigint as raw_bits from h, t group by n")
def _(spark, d):
    h = lists.gaps(values(spark, d), "v").where("not first").groupBy(arith.bits(F.col("gap")).alias("sym")).agg(F.count("*").alias("cnt"))
    raw = h.agg(F.sum(F.col("cnt") * (F.col("sym") - 1)).alias("raw_bits"))
    return lists.entropy(h).select("n", "symbols", F.round("entropy_bits", 3).alias("entropy_bits")).join(F.broadcast(raw))  # two one-row tables


@query("odd_length_entropy", "with v as (select distinct 2 * epoch_us(ts) + 1 as v from events), g as (select (v - lag(v) over (order by v)) // 2 as gap from v), h as (select length(bin(gap)) as b, count(*) as c from g where gap is not null group by 1), t as (select sum(c) as n from h) select n::bigint as n, count(*) as symbols, round(sum(-c * log2(c / n)), 3) as entropy_bits from h, t group by n")
def _(spark, d):
    odd = values(spark, d).select((2 * F.col("v") + 1).alias("v"))
    h = lists.gaps(odd, "v").where("not first").groupBy(arith.bits(F.floor(F.col("gap") / 2).cast("long")).alias("sym")).agg(F.count("*").alias("cnt"))
    return lists.entropy(h).select("n", "symbols", F.round("entropy_bits", 3).alias("entropy_bits"))


@query("residue_classes", V_SQL + " select v % 2310 as r, count(*) as n_values, min(v // 2310) as k_first, max(v // 2310) as k_last from v group by 1")
def _(spark, d):
    return lists.residue_classes(values(spark, d), "v", 2310)


@query("class_widths", V_SQL + ", c as (select v % 2310 as r, count(*) as n, max(v // 2310) as k from v group by 1) select count(*) as nonempty, max(n) as largest, max(length(bin(k)))::int as end_width from c")
def _(spark, d):
    c = lists.residue_classes(values(spark, d), "v", 2310)
    return c.agg(F.count("*").alias("nonempty"), F.max("n_values").alias("largest"), F.max(arith.bits(F.col("k_last"))).alias("end_width"))


@query("total_check", V_SQL + " select count(*) as record_count, sum(v)::hugeint::varchar as total_check from v")
def _(spark, d):
    from primeweave.operators import compare

    return compare.totals(values(spark, d), "v")


@query("residue_permutation", V_SQL + " select v, row_number() over (order by v % 30, v) - 1 as place from v")
def _(spark, d):
    rows = values(spark, d).withColumn("r", F.col("v") % 30)
    return lists.ranked(rows, "r", F.col("v").asc(), name="place").select("v", "place")


@query("histogram_fingerprint", V_SQL + " select length(bin(v))::int as bits, count(*) as cnt, sum(v % 1000003)::bigint as mixed from v group by 1")
def _(spark, d):
    return values(spark, d).groupBy(arith.bits(F.col("v")).alias("bits")).agg(F.count("*").alias("cnt"), F.sum(F.col("v") % 1000003).alias("mixed"))


__all__ = ["asked", "values"]
