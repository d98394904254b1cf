"""WARC archives: written by Spark's own writer, read back by boundary-chain verification.

Writing: one record a page; of equal payloads of at least `least` bytes the one of the smallest id is the response, the others
are revisit records that refer to it. Records are UTF-8 text, so Spark's text writer lays down the archive with the record end
as line separator, through any file system and its commit protocol. Archive files are gzip members of a bounded number of records; plain ones are read
too, and offsets are those of the plain bytes.

Reading: each task takes whole archives and lists every place where a record could begin (the version line, wherever it stands,
payloads included) with the offset of the record after it by its Content-Length. Pointer jumping from offset 0 keeps what is
reachable; a version line inside a payload is not. A chain that doesn't end at the file's end is an error.

Null html: an empty payload. Rows of null id are refused by the writer. Equal rows (id and payload) are records of their own;
of the smallest id's equal rows each is a response. An empty table writes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave.llm.shared import Stages, small

VERSION = "WARC/1.1"
END = "\r\n\r\n"
RECORDS_A_FILE = 1000
#: Copies of a payload beyond which its pages learn of it by a broadcast.
HOT = 10_000
#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HEAD = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$", re.M)


def base32(sha1_hex: Column) -> Column:
    """Base32 of 40 hex digits, five digits to four letters."""
    out = []
    for k in range(8):
        v = F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(value): a record's text for each page, without its end."""
    page = pages.select(F.col(id_col).alias("id"), F.coalesce(payload_col, F.lit("")).alias("payload"), (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"))
    page = page.withColumn("sha", F.sha1(F.encode("payload", "utf-8"))).withColumn("bytes", F.octet_length("payload"))
    first = page.where(F.col("bytes") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("copies")).where("first <> last")
    stages = Stages(pages.sparkSession)
    first = stages.put(first, "payloads")
    hot = small(first.where(F.col("copies") > HOT).select("sha", F.col("first").alias("hot")), stages, "hot")
    rare = first.where(F.col("copies") <= HOT).select("sha", F.col("first").alias("rare"))
    # pages of a hot payload learn its first page without meeting in a task: only others are dealt by their payload
    page = page.join(hot, "sha", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("hot "), F.col("id").cast("string"))))
    page = page.join(rare.withColumnRenamed("sha", "key"), "key", "left").withColumn("first", F.coalesce("hot", "rare"))
    page = page.withColumn("revisit", F.coalesce((F.col("first") < F.col("id")) & (F.col("bytes") >= least), F.lit(False)))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    plain = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.length(plain) > 0, line("WARC-Target-URI", plain)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", uri(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))),
        F.lit("\r\n"),
    )
    return page.where(F.assert_true(F.col("id").isNotNull()).isNull()).select(F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("payload"))).alias("value"))


def write(pages: DataFrame, path: str, **columns) -> None:
    """Compressed archives under path, RECORDS_A_FILE records at most in each."""
    records(pages, **columns).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", "gzip").text(path)


def candidates(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict[bytes, bytes]]]:
    """Of every possible record: where it begins, where its block begins, where the next record would begin, its fields."""
    start, block, after, fields = [], [], [], []
    for m in _HEAD.finditer(content):
        stop = content.find(b"\r\n\r\n", m.end() - 2)
        if stop < 0:
            continue
        own = {k.lower(): v for k, v in _FIELD.findall(content[m.end() : stop].replace(b"\r\n", b"\n"))}
        length = own.get(b"content-length", b"")
        if not length.isdigit():
            continue
        begin = stop + 4
        end = begin + int(length)
        if content[end : end + 4] != END.encode():
            continue
        start.append(m.start())
        block.append(begin)
        after.append(end + 4)
        fields.append(own)
    return *(np.array(x, np.int64) for x in (start, block, after)), fields


def reachable(start: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain from offset 0 meets, by pointer jumping; raises if it doesn't end at the size."""
    n = len(start)
    at = np.searchsorted(start, after)
    hit = (at < n) & (start[np.minimum(at, n - 1)] == after) if n else np.zeros(0, bool)
    jump = np.append(np.where(hit, at, n), n)  # n: no candidate there
    met = np.zeros(n + 1, bool)
    if n and start[0] == 0:
        met[0] = True
    reach = 1
    while reach < n + 1:
        met[jump[np.flatnonzero(met)]] = True
        jump = jump[jump]
        reach *= 2
    met = met[:n]
    end = int(after[met].max()) if met.any() else 0
    if end != size:
        raise ValueError(f"the chain of records ends at {end} of {size}")
    return met


def _parsed(batches):
    names = ["id", "type", "digest", "told", "refers_to", "bytes"]
    for batch in batches:
        for content in batch.column("content"):
            content = content.as_py()
            content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            start, block, after, fields = candidates(content)
            rows = []
            for k in np.flatnonzero(reachable(start, after, len(content))):
                f, payload = fields[k], content[block[k] : after[k] - 4]
                told = f[b"warc-payload-digest"].decode().removeprefix("sha1:")
                revisit = f[b"warc-type"] == b"revisit"
                own = told if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                refers = f.get(b"warc-refers-to")
                rows.append((int(f[b"warc-record-id"][10:-1]), f[b"warc-type"].decode(), own, told, int(refers[10:-1]) if refers else None, None if revisit else len(payload)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to): revisits take the size of the record they refer to."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    stages = Stages(spark)
    found = stages.put(files.mapInArrow(_parsed, "id long, type string, digest string, told string, refers_to long, bytes long"), "records")
    found = found.where(F.assert_true(F.col("digest") == F.col("told"), "a payload differs from its digest").isNull())
    targets = found.where("type = 'response'").select(F.col("id").alias("refers_to"), F.col("bytes").alias("full"), F.col("digest").alias("full_digest")).distinct()
    out = found.join(targets, "refers_to", "left")
    out = out.where(F.assert_true((F.col("type") == "response") | (F.col("digest") == F.col("full_digest")), "a revisit refers to another payload").isNull())
    return out.select("id", F.coalesce("bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
