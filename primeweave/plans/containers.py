"""Round trips through the containers: written by the sinks, read by the sources, compared with what went in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave import shared_folder
from primeweave.functions import arith, primes
from primeweave.operators import divisors
from primeweave.plans import lists, numbers
from primeweave.plans.registry import query
from primeweave.sources import files
from primeweave.stages import Stages


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def odd(spark: SparkSession, d: str) -> DataFrame:
    return lists.values(spark, d).select((2 * F.col("v") + 1).cast(arith.WIDE).alias("v"))


def carmichael(spark: SparkSession, d: str) -> DataFrame:
    """(n, factors) of the Carmichael numbers among the keys."""
    rows = divisors.korselt(numbers.factored(spark, d), "n", "factors")
    return rows.select(F.col("n").cast(arith.WIDE).alias("n"), F.transform("factors", lambda x: x.p).alias("factors"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """(n, factors) of the squarefree odd keys of three primes or more."""
    keys = numbers.keys(spark, d)
    return primes.squarefree_primes(keys.where("n % 2 = 1"), "n", numbers.most(keys)).where(F.size("ps") >= 3).select(F.col("n").cast(arith.WIDE).alias("n"), F.col("ps").alias("factors"))


ODD_SQL = "select distinct 2 * epoch_us(ts) + 1 as v from events"


@query("raw16_roundtrip", ODD_SQL)
def _(spark, d):
    files.register(spark)
    path = _path(spark, "raw16")
    files.write_raw16(odd(spark, d), path)
    return spark.read.format("raw16").load(path).select(F.col("v").cast("long").alias("v"))


@query("vbg_roundtrip", ODD_SQL)
def _(spark, d):
    files.register(spark)
    path = _path(spark, "vbg1")
    files.write_vbg1(odd(spark, d), path)
    return spark.read.format("vbg1").load(path).select(F.col("v").cast("long").alias("v"))


@query("cnd_roundtrip", ODD_SQL)
def _(spark, d):
    files.register(spark)
    path, v = _path(spark, "cnd"), odd(spark, d)
    files.write_cnd(v, path, 2310, files.n_targets(v, "v"))
    return spark.read.format("cnd").load(path).select(F.col("v").cast("long").alias("v"))


RECORDS_SQL = numbers.SIEVE_SQL + ", rec as (select n, ps from kf where top = 1 and n % 2 = 1 and k >= 3)"


@query("orc1_roundtrip", RECORDS_SQL + " select n, array_to_string(ps, ' ') as factors, row_number() over (order by n) - 1 as rank from rec")
def _(spark, d):
    files.register(spark)
    path = _path(spark, "orc1")
    files.write_orc1(records(spark, d), path)
    out = spark.read.format("orc1").load(path)
    return out.select(F.col("n").cast("long").alias("n"), F.array_join(F.transform("factors", lambda x: x.cast("string")), " ").alias("factors"), "rank")


@query("text_roundtrip", RECORDS_SQL + " select n, array_to_string(ps, ' ') as factors from rec")
def _(spark, d):
    path = _path(spark, "text")
    files.write_text(records(spark, d), path)
    out = files.read_text(spark, path).where("problem is null")
    return out.select(F.col("n").cast("long").alias("n"), F.array_join(F.transform("factors", lambda x: x.cast("string")), " ").alias("factors"))


@query("paths_roundtrip", RECORDS_SQL + " select array_to_string(ps, ' ') as path, row_number() over (order by n) - 1 as rank from rec")
def _(spark, d):
    files.register(spark)
    path = _path(spark, "paths")
    files.write_paths(records(spark, d), path, 14, column="factors")
    return spark.read.format("paths").option("fields", 14).load(path).select(F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"), "rank")


@query("masks_roundtrip", numbers.SUBSET_SQL + " select mask, row_number() over (order by n) - 1 as rank from dm")
def _(spark, d):
    files.register(spark)
    rows = numbers.smallest(spark, d).where("d is not null").withColumn("mask", divisors.mask_of(F.col("ps"), F.col("d")))
    path = _path(spark, "masks")
    files.write_masks(rows, path)
    return spark.read.format("masks").load(path).select("mask", "rank")


def _tree(spark, d, kind):
    files.register(spark)
    stages, path = Stages(spark), _path(spark, "pwt2")
    rows = stages.put(records(spark, d), "records")
    files.write_pwt2(rows, path, files.n_targets(rows), full=True, kind=kind, column="factors")
    stages.drop()
    return spark.read.format("pwt2").load(path).select(F.col("n").cast("long").alias("n"), F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


TREE_SQL = RECORDS_SQL + " select n, array_to_string(ps, ' ') as path from rec"


@query("pwt2_roundtrip", TREE_SQL)
def _(spark, d):
    return _tree(spark, d, 3)


@query("pwt2_set1_roundtrip", TREE_SQL)
def _(spark, d):
    return _tree(spark, d, 1)


@query("pwt2_set2_roundtrip", TREE_SQL)
def _(spark, d):
    return _tree(spark, d, 2)


@query("pwt2_naive_roundtrip", TREE_SQL)
def _(spark, d):
    return _tree(spark, d, None)


@query("pwt2_divisor_roundtrip", numbers.KORSELT_SQL + " select n from cn")
def _(spark, d):
    """Least valid divisors of the Carmichael keys, stored as a tree; n comes back through the inverse."""
    files.register(spark)
    rows = carmichael(spark, d)
    chosen = rows.withColumn("c", divisors.choose_dmin(F.col("n").cast("long"), F.col("factors")))
    chosen = chosen.select("n", divisors.divisor_path(F.col("factors"), F.col("c.d")).alias("path"))
    path = _path(spark, "pwt2")
    files.write_pwt2(chosen, path, files.n_targets(rows))
    return spark.read.format("pwt2").load(path).select(F.col("n").cast("long").alias("n"))


def sha_sql(relation: str) -> str:
    """SHA-256 of a relation's values v, in order, as 16 bytes each, least first."""
    return f"(select sha256(unhex(string_agg(array_to_string(list_transform(range(15, -1, -1), lambda i: substr(lpad(to_hex(v::hugeint), 32, '0'), 2 * i + 1, 2)), ''), '' order by v))) from {relation})"


@query("sha_stream", f"with o as ({ODD_SQL}) select {sha_sql('o')} as sha_nset, (select sum(v)::varchar from o) as total_check, (select count(*) from o) as record_count")
def _(spark, d):
    """Ordered hash, total and count of the odd list, as hex."""
    t = files.n_targets(odd(spark, d), "v")
    return spark.createDataFrame([(t[:32].hex(), str(int.from_bytes(t[32:48], "little")), int.from_bytes(t[48:], "little"))], "sha_nset string, total_check string, record_count long")
