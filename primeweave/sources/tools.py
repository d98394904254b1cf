"""The jobs over files: ingest, export, build, decode, certify, compare; each reads and writes containers and gives its report
as a DataFrame of one row, with a verdict where it checks something.

VERIFIED: agrees with the totals and the hash that the file itself carries. CERTIFIED: agrees with a reference table in count,
total and every position. DECODED: read whole, with nothing to hold it against. FAILED: anything else.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from primeweave.functions import arith, primes
from primeweave.operators import compare, divisors, lists
from primeweave.sources import files

MANIFEST = "path string, bytes long, sha256 string"


def _verdict(passed) -> F.Column:
    return F.when(passed, compare.CERTIFIED).otherwise(compare.FAILED).alias("verdict")


# ingest and export of records


def encode_records(spark: SparkSession, text: str, out: str, prove_primes: bool = False) -> DataFrame:
    """Records of a text table into an ORC1 file; any record that breaks a rule stops the job. One row: records, total."""
    rows = files.read_text(spark, text)
    faults = F.when(F.col("problem").isNotNull(), F.array(F.lit("line"))).otherwise(divisors.record_faults(F.col("n"), F.col("factors")))
    rows = rows.withColumn("faults", faults)
    if prove_primes:
        unproven = rows.select(F.explode("factors").alias("p")).distinct().where(~F.coalesce(primes.proven_prime("p"), F.lit(False))).select("p")
        bad = rows.select("n", F.explode("factors").alias("p")).join(unproven, "p", "left_semi").select("n").distinct().withColumn("unproven", F.lit(True))
        rows = rows.join(bad, "n", "left").withColumn("faults", F.when(F.col("unproven"), F.concat("faults", F.array(F.lit("prime")))).otherwise(F.col("faults")))
    broken = rows.where(F.size("faults") > 0).limit(1).collect()  # the first one met is told
    if broken:
        raise ValueError(f"record {broken[0]['n'] or broken[0]['problem']}: {', '.join(broken[0]['faults'])}")
    rows = rows.select("n", "factors")
    if not compare.duplicates(rows, "n").isEmpty():
        raise ValueError("a value repeats")
    files.write_orc1(rows, out)
    return compare.totals(rows, "n")


def decode_records(spark: SparkSession, orc1: str, out: str) -> DataFrame:
    """An ORC1 file as text; the text is read again and held against the file. One row: records, total, verdict."""
    rows = spark.read.format("orc1").load(orc1)
    files.write_text(rows, out)
    again = files.read_text(spark, out).where("problem is null")
    join = lambda f: F.array_join(F.transform(f, lambda x: x.cast("string")), " ")
    keyed = lambda df: df.select(F.concat_ws(" ", F.col("n").cast("string"), join("factors")).alias("line"))
    same = compare.multiset_compare(keyed(rows), keyed(again), "line").select("same")
    return compare.totals(rows, "n").crossJoin(F.broadcast(same)).select("record_count", "total_check", _verdict(F.col("same")))  # one row each


def list_statistics(spark: SparkSession, orc1: str, raw16: str | None = None) -> DataFrame:
    """Code lengths of the values of an ORC1 file (below 2**63), and the values themselves as raw16 if asked."""
    rows = spark.read.format("orc1").load(orc1)
    if raw16:
        files.write_raw16(rows, raw16, column="n")
    return lists.code_lengths(lists.gaps(rows.select(F.col("n").cast("long").alias("v")), "v"), "v")


def divisor_paths(spark: SparkSession, orc1: str, full: bool = False) -> DataFrame:
    """(n, rank, path): the primes of each value's least valid divisor, or all of them."""
    rows = spark.read.format("orc1").load(orc1)
    if full:
        return rows.select("n", "rank", F.col("factors").alias("path"))
    rows = rows.withColumn("c", divisors.choose_dmin_wide("n", "factors"))
    return rows.select("n", "rank", F.filter("factors", lambda p: F.col("c.d") % p == 0).alias("path"))


def export_paths(spark: SparkSession, orc1: str, out: str, fields: int = 14, full: bool = False) -> DataFrame:
    """A path file in order of n; one row: paths, mean and greatest length, share at all primes."""
    rows = divisor_paths(spark, orc1, full)
    files.write_paths(rows, out, fields)
    return rows.agg(F.count("*").alias("paths"), F.avg(F.size("path")).alias("mean_length"), F.max(F.size("path")).alias("longest"))


# lists of divisors


def path_products(spark: SparkSession, paths: str, fields: int) -> DataFrame:
    """(rank, d): products of a path file's rows; rows that aren't ascending odd primes-to-be stop the job."""
    rows = spark.read.format("paths").option("fields", fields).load(paths)
    fine = arith.strictly_ascending(F.col("path")) & F.forall("path", lambda p: (p >= 3) & (p % 2 == 1)) & (F.size("path") > 0)
    return rows.where(F.assert_true(fine, "a path is out of order").isNull()).select("rank", arith.product(F.col("path")).alias("d"))


def divisor_list(spark: SparkSession, out: str, paths: str | None = None, fields: int = 14, orc1: str | None = None) -> DataFrame:
    """The sorted divisors as raw16, from a path file or from the records; a repeated one stops the job. One row: count, total."""
    if paths:
        values = path_products(spark, paths, fields).select(F.col("d").alias("v"))
    else:
        values = spark.read.format("orc1").load(orc1).select(divisors.choose_dmin_wide("n", "factors").alias("c")).select(F.col("c.d").alias("v"))
    if not compare.duplicates(values, "v").isEmpty():
        raise ValueError("a divisor repeats")
    files.write_raw16(values, out)
    return compare.totals(values, "v")


def value_of_divisor(d: int) -> int | None:
    """n = d (1/d mod lam(d)) of an odd squarefree d whose primes are all proven; None for others."""
    found = primes.split(d)
    own = found.primes
    if d < 3 or d % 2 == 0 or d >= 1 << 95 or found.uncertified or len(set(own)) < len(own):
        return None
    return arith.path_value(own)


@F.pandas_udf(T.DecimalType(38, 0))
def values_of_divisors(d: pd.Series) -> pd.Series:
    return arith.decimals(value_of_divisor(int(x)) for x in d)


def decode_list(spark: SparkSession, path: str, kind: str = "n", reference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(values of n, report) of a VBG1, CND or raw16 list of values (kind n) or divisors (kind d), certified against an ORC1 file."""
    form = files.sniff(spark, path) or "raw16"
    v = spark.read.format(form).load(path).select("v")
    if kind == "d":
        v = v.select(values_of_divisors("v").alias("v"))
        v = v.where(F.assert_true(F.col("v").isNotNull(), "a divisor stands for no value").isNull())
    report = compare.totals(v, "v")
    if not reference:
        return v, report.withColumn("verdict", F.lit(compare.DECODED))
    return v, report.withColumn("verdict", F.lit(compare.certify(v, spark.read.format("orc1").load(reference).select(F.col("n").alias("v")), "v")))


def decode_tree(spark: SparkSession, path: str, reference: str | None = None) -> DataFrame:
    """One row: values of a tree file, their total, the ordered hash, whether the footer agrees (VERIFIED) and the reference too."""
    n = spark.read.format("pwt2").load(path).select("n")
    target = files.n_targets(n)
    told = files.footer_targets(path)
    verdict = compare.FAILED
    if target == told:
        verdict = compare.VERIFIED
        if reference:
            verdict = compare.certify(n, spark.read.format("orc1").load(reference).select("n"), "n")
    return compare.totals(n, "n").withColumn("sha_nset", F.lit(target[:32].hex())).withColumn("verdict", F.lit(verdict))


def reencoded(spark: SparkSession, path: str, again: str, **options) -> DataFrame:
    """One row: format and whether a list file, read and written again, has the same bytes."""
    form = files.sniff(spark, path) or "raw16"
    rows = spark.read.format(form).load(path).select("v")
    if form == "cnd":
        files.write_cnd(rows, again, options["modulus"], options["targets"])
    else:
        {"vbg1": files.write_vbg1, "raw16": files.write_raw16}[form](rows, again)
    return digests(spark, [path, again]).agg(F.lit(form).alias("format"), (F.countDistinct("bytes", "sha256") == 1).alias("identical"))


# files


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of files, streamed in tasks."""

    def run(frames):
        for frame in frames:
            rows = []
            for p in frame["path"]:
                digest, n = hashlib.sha256(), 0
                for chunk in files.stream(p):
                    digest.update(chunk)
                    n += len(chunk)
                rows.append((p, n, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, MANIFEST)


def write_manifest(listed: DataFrame, out: str) -> None:
    """Tab-separated: path, bytes, sha256."""
    listed.select("path", "bytes", "sha256").coalesce(1).write.option("sep", "\t").csv(out)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines that begin with # are remarks."""
    return spark.read.option("sep", "\t").option("comment", "#").schema(MANIFEST).csv(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of `KEY = value` lines; others are skipped."""
    parts = F.split("value", "=", 2)
    return spark.read.text(path).where(r"value rlike '^\\s*[A-Za-z_][A-Za-z0-9_]*\\s*='").select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def check_files(spark: SparkSession, manifest: str) -> DataFrame:
    """(path, verdict): VERIFIED where size and hash are as listed."""
    told = read_manifest(spark, manifest)
    found = digests(spark, [r.path for r in told.select("path").toLocalIterator()])  # a row a file
    both = told.alias("t").join(found.alias("f"), "path", "left")
    return both.select("path", F.when((F.col("t.bytes") == F.col("f.bytes")) & (F.col("t.sha256") == F.col("f.sha256")), compare.VERIFIED).otherwise(compare.FAILED).alias("verdict"))


# benches


def with_records(paths: DataFrame, records: DataFrame, stride: int = 1) -> DataFrame:
    """(rank, n, factors, path): rows of a path file beside the records of the same position; every stride-th one where asked."""
    rows = paths.where(F.col("rank") % stride == 0).select("rank", "path").join(records.select("rank", "n", "factors"), "rank")
    return rows.select("rank", "n", "factors", "path")


def cofactor_bench(spark: SparkSession, orc1: str, paths: str, fields: int, stride: int = 1) -> DataFrame:
    """Cofactors n / d of path and record, factored by powers with exponent n - 1. One row: records, proper ones, wrong ones, fallbacks, ladders."""
    rows = with_records(spark.read.format("paths").option("fields", fields).load(paths), spark.read.format("orc1").load(orc1), stride)
    rest = F.array_except("factors", "path")
    rows = rows.select("n", rest.alias("rest"), arith.product(rest).alias("x")).withColumn("r", primes.algorithm1("x", "n"))
    wrong = F.array_join("r.primes", " ") != F.array_join(F.transform("rest", lambda p: p.cast("string")), " ")
    return rows.agg(F.count("*").alias("records"), F.count(F.when(F.size("rest") > 0, 1)).alias("proper"), F.count(F.when(wrong, 1)).alias("wrong"), F.count(F.when(F.col("r.fallback"), 1)).alias("fallbacks"), F.coalesce(F.sum("r.ladders"), F.lit(0)).alias("ladders"))


def flat_bench(spark: SparkSession, raw16: str, folder: str, moduli: list[int]) -> DataFrame:
    """(codec, bytes, bits_per_value, verdict) of a list under either list codec, each read back and held against the input."""
    v = spark.read.format("raw16").load(raw16).select("v")
    n, out = v.count(), []
    targets = files.n_targets(v, "v")
    for name, write in [("vbyte", files.write_vbg1), *((f"classes_{m}", lambda x, p, m=m: files.write_cnd(x, p, m, targets)) for m in moduli)]:
        path = f"{folder}/{name}"
        write(v, path)
        back = spark.read.format("vbg1" if name == "vbyte" else "cnd").load(path).select("v")
        size = digests(spark, [path]).first()["bytes"]
        out.append((name, size, round(8 * size / max(n, 1), 4), compare.certify(back, v, "v")))
    return spark.createDataFrame(out, "codec string, bytes long, bits_per_value double, verdict string")
