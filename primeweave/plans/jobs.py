"""The file jobs, run end to end over the wide records, with what SQL says their reports must be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave.operators import divisors
from primeweave.plans import containers, wide
from primeweave.plans.registry import query
from primeweave.sources import files, tools

#: Records that break no rule of the format.
FINE_SQL = wide.SUBSET_SQL + ", ok as (select * from rec where n < 1000000000000000000000000::hugeint and p < 100000000), od as (select dm.* from dm join ok using (n))"


def records(spark: SparkSession, d: str) -> DataFrame:
    rows = wide.records(spark, d)
    return rows.where(F.size(divisors.record_faults(F.col("n"), F.col("factors"))) == 0)


def _text(spark: SparkSession, d: str) -> str:
    files.register(spark)
    path = containers._path(spark, "records")
    files.write_text(records(spark, d), path)
    return path


def _orc1(spark: SparkSession, d: str) -> str:
    files.register(spark)
    path = containers._path(spark, "orc1")
    files.write_orc1(records(spark, d), path)
    return path


@query("job_encode_records", FINE_SQL + " select count(*) as record_count, sum(n)::varchar as total_check from ok")
def _(spark, d):
    """Text to ORC1, every factor proven prime."""
    return tools.encode_records(spark, _text(spark, d), containers._path(spark, "orc1"), prove_primes=True)


@query("job_decode_records", FINE_SQL + " select count(*) as record_count, sum(n)::varchar as total_check, 'CERTIFIED' as verdict from ok")
def _(spark, d):
    return tools.decode_records(spark, _orc1(spark, d), containers._path(spark, "text"))


STAT_SQL = containers.RECORDS_SQL + """, g as (select n as v, n - coalesce(lag(n) over (order by n), 0) as gap, lag(n) over (order by n) is null as first, coalesce(lag(n) over (order by n), 0) as prev from rec)
 select count(*) as n, round(sum(log2(gap + 1)), 6) as gap_bits, sum(case when not first then 2 * length(bin(length(bin(gap)))) end)::bigint as delta_overhead_bits, sum(case when not first then length(bin(xor(v, prev))) end)::bigint as trie_edges,
 sum(8 * greatest(1, ceil(length(bin(gap)) / 7.0)))::bigint as vbyte_gap_bits, sum(8 * greatest(1, ceil(length(bin(v)) / 7.0)))::bigint as vbyte_absolute_bits from g"""


@query("job_list_statistics", STAT_SQL)
def _(spark, d):
    files.register(spark)
    path = containers._path(spark, "orc1")
    files.write_orc1(containers.records(spark, d), path)
    out = tools.list_statistics(spark, path, containers._path(spark, "raw16"))
    return out.withColumn("gap_bits", F.round("gap_bits", 6))


@query("job_export_paths", FINE_SQL + " select count(*) as paths, round(avg(len(s)), 6) as mean_length, max(len(s))::int as longest from od")
def _(spark, d):
    return tools.export_paths(spark, _orc1(spark, d), containers._path(spark, "paths")).withColumn("mean_length", F.round("mean_length", 6))


@query("job_divisor_list", FINE_SQL + " select route, count(*) as record_count, sum(d)::varchar as total_check from od, (values ('paths'), ('records')) r(route) group by 1")
def _(spark, d):
    """The sorted divisors by either route."""
    orc1, paths = _orc1(spark, d), containers._path(spark, "paths")
    tools.export_paths(spark, orc1, paths)
    by_path = tools.divisor_list(spark, containers._path(spark, "raw16"), paths=paths).withColumn("route", F.lit("paths"))
    return by_path.unionByName(tools.divisor_list(spark, containers._path(spark, "raw16"), orc1=orc1).withColumn("route", F.lit("records")))


def _lists(spark, d, orc1: str) -> list[tuple[str, str]]:
    """The divisors of the records as a list of each format."""
    paths = {k: containers._path(spark, k) for k in ("raw16", "vbg1", "cnd")}
    tools.divisor_list(spark, paths["raw16"], orc1=orc1)
    v = spark.read.format("raw16").load(paths["raw16"]).select("v")
    files.write_vbg1(v, paths["vbg1"])
    files.write_cnd(v, paths["cnd"], 2310, files.n_targets(spark.read.format("orc1").load(orc1)))
    return list(paths.items())


@query("job_certify_divisors", FINE_SQL + " select format, count(*) as record_count, sum(n)::varchar as total_check, 'CERTIFIED' as verdict from ok, (values ('raw16'), ('vbg1'), ('cnd')) f(format) group by 1")
def _(spark, d):
    """Divisors read from each list format, factored, turned to values and held against the records, one by one."""
    orc1, out = _orc1(spark, d), None
    for name, path in _lists(spark, d, orc1):
        one = tools.decode_list(spark, path, "d", orc1)[1].withColumn("format", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("job_certify_tree", FINE_SQL + f", v as (select n as v from ok) select count(*) as record_count, sum(v)::varchar as total_check, {containers.sha_sql('v')} as sha_nset, 'CERTIFIED' as verdict from v")
def _(spark, d):
    """A tree of the divisors' paths, whose values agree with its footer and with the records."""
    orc1, tree = _orc1(spark, d), containers._path(spark, "pwt2")
    rows = spark.read.format("orc1").load(orc1)
    files.write_pwt2(tools.divisor_paths(spark, orc1), tree, files.n_targets(rows))
    return tools.decode_tree(spark, tree, orc1)


@query("job_reencode_identity", "select unnest(['raw16', 'vbg1', 'cnd']) as format, true as identical")
def _(spark, d):
    """Each list, read and written again, has the same bytes."""
    orc1, out = _orc1(spark, d), None
    targets = files.n_targets(spark.read.format("orc1").load(orc1))
    for _, path in _lists(spark, d, orc1):
        one = tools.reencoded(spark, path, containers._path(spark, "again"), modulus=2310, targets=targets)
        out = one if out is None else out.unionByName(one)
    return out


@query("job_cofactor_bench", FINE_SQL + " select count(*) as records, count(*) filter (d < n) as proper, 0::bigint as wrong, 0::bigint as fallbacks from od")
def _(spark, d):
    orc1, paths = _orc1(spark, d), containers._path(spark, "paths")
    tools.export_paths(spark, orc1, paths)
    return tools.cofactor_bench(spark, orc1, paths, 14).drop("ladders")


@query("job_paths_beside_records", FINE_SQL + " select n::varchar as n, row_number() over (order by n) - 1 as rank, array_to_string(s, ' ') as path, (n // d)::varchar as cofactor from od")
def _(spark, d):
    orc1, paths = _orc1(spark, d), containers._path(spark, "paths")
    tools.export_paths(spark, orc1, paths)
    rows = tools.with_records(spark.read.format("paths").option("fields", 14).load(paths), spark.read.format("orc1").load(orc1))
    rest = F.aggregate(F.array_except("factors", "path"), F.lit(1).cast("decimal(38,0)"), lambda a, p: (a * p).cast("decimal(38,0)"))
    return rows.select(F.col("n").cast("string").alias("n"), "rank", wide._path("path").alias("path"), rest.cast("string").alias("cofactor"))


@query("job_flat_bench", "select unnest(['vbyte', 'classes_210', 'classes_2310']) as codec, 'CERTIFIED' as verdict")
def _(spark, d):
    raw, folder = containers._path(spark, "raw16"), containers._path(spark, "flat")
    tools.divisor_list(spark, raw, orc1=_orc1(spark, d))
    return tools.flat_bench(spark, raw, folder, [210, 2310]).select("codec", "verdict")


@query("job_check_files", "select * from (values ('raw16', 'VERIFIED'), ('vbg1', 'VERIFIED'), ('cnd', 'FAILED')) t(name, verdict)")
def _(spark, d):
    """Sizes and hashes of a manifest; one line of it is wrong."""
    orc1, manifest = _orc1(spark, d), containers._path(spark, "manifest")
    found = tools.digests(spark, [p for _, p in _lists(spark, d, orc1)])
    wrong = F.when(F.col("path").contains("/cnd-"), F.reverse("sha256")).otherwise(F.col("sha256"))
    tools.write_manifest(found.withColumn("sha256", wrong), manifest)
    return tools.check_files(spark, manifest).select(F.regexp_extract("path", r"/([a-z0-9]+)-[0-9a-f]+$", 1).alias("name"), "verdict")


@query("orc1_range_scan", containers.RECORDS_SQL + " select n, rank from (select n, row_number() over (order by n) - 1 as rank from rec) where rank >= 20 and rank < 90")
def _(spark, d):
    """Blocks are chosen by the index: filters reach the reader."""
    files.register(spark)
    path = containers._path(spark, "orc1")
    files.write_orc1(containers.records(spark, d), path)
    return spark.read.format("orc1").load(path).where("rank >= 20 and rank < 90").select(F.col("n").cast("long").alias("n"), "rank")
