"""Spark readers (`spark.read.format(...)`) and sinks for the containers, through any file system that pyarrow or Spark knows.

Readers split what a format lets be read apart: ORC1 by blocks, CND by classes, raw16, path and mask files by fixed widths;
VBG1 and PWT2 are chains and are read by one task. Values reach Spark as DECIMAL(38,0), paths as arrays of BIGINT.
"""

from __future__ import annotations

import bisect
import contextlib
import hashlib
import itertools
import math
import uuid
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from primeweave.functions import arith
from primeweave.operators.lists import ranked
from primeweave.sources import formats, pwt2

#: Rows of a task in fixed-width files, blocks of a task in ORC1 files, classes of a task in CND files.
ROWS, BLOCKS, CLASSES = 1_000_000, 64, 256


def _open(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))
    return where.open_input_file(inner)


def _bytes(path: str, begin: int = 0, end: int | None = None) -> bytes:
    with _open(path) as f:
        f.seek(begin)
        return f.read() if end is None else f.read(end - begin)


def _size(path: str) -> int:
    with _open(path) as f:
        return f.size()


class Ranged:
    """A file that gives slices of its bytes, without being read whole."""

    def __init__(self, path: str):
        self.path, self.size = path, _size(path)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, piece: slice) -> bytes:
        begin, end, _ = piece.indices(self.size)
        return _bytes(self.path, begin, max(begin, end))


def stream(path: str, chunk: int = 8 << 20) -> Iterator[bytes]:
    with _open(path) as f:
        while data := f.read(chunk):
            yield data


def footer_targets(path: str) -> bytes:
    """What a class list or a tree file certifies to by its own footer: ordered hash, total, count."""
    return Ranged(path)[-56:]


class Part(InputPartition):
    def __init__(self, *what):
        self.what = what


def _values(numbers) -> pa.Array:
    return pa.array([Decimal(v) for v in numbers], pa.decimal128(38, 0))


class _Reader(DataSourceReader):
    def __init__(self, source):
        self.source, self.path = source, source.options["path"]


class _Source(DataSource):
    reads = _Reader
    columns = "v decimal(38,0)"

    @classmethod
    def name(cls) -> str:
        return cls.__name__.lower()

    def schema(self) -> str:
        return self.columns

    def reader(self, schema):
        return self.reads(self)


class _Orc1Reader(_Reader):
    """Filters on block_id, rank and n choose blocks by the index; Spark applies them to the rows again."""

    def __init__(self, source):
        super().__init__(source)
        self.bounds: list[tuple[str, float, float]] = []

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            column, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if column in ("block_id", "rank", "n") and value is not None:
                low, high = {"EqualTo": (value, value), "GreaterThan": (value, math.inf), "GreaterThanOrEqual": (value, math.inf), "LessThan": (-math.inf, value), "LessThanOrEqual": (-math.inf, value)}.get(type(f).__name__, (-math.inf, math.inf))
                if isinstance(value, (int, Decimal)):
                    self.bounds.append((column, low, high))
            yield f

    def _chosen(self, index: list[tuple[int, int, int]]) -> list[int]:
        firsts, out = [first for first, _, _ in index], set(range(len(index)))
        for column, low, high in self.bounds:
            if column == "n":  # the last block that begins at or below the value holds it
                a, b = bisect.bisect_right(firsts, low) - 1, bisect.bisect_right(firsts, high) - 1
            else:
                a, b = (x if math.isinf(x) else int(x) // (formats.BLOCK if column == "rank" else 1) for x in (low, high))
            out &= {k for k in out if a <= k <= b}
        return sorted(out)

    def partitions(self):
        n, index, index_off, _ = formats.orc1_open(Ranged(self.path))
        ends = [off for _, off, _ in index[1:]] + [index_off - 64]
        blocks = [(k, 64 + index[k][1], 64 + ends[k], index[k][2], min(formats.BLOCK, n - index[k][2])) for k in self._chosen(index)]
        return [Part(blocks[g : g + BLOCKS]) for g in range(0, len(blocks), BLOCKS)] or [Part([])]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        for k, a, b, base, count in part.what[0]:
            rows = formats.orc1_decode_block(_bytes(self.path, a, b), count)
            yield pa.RecordBatch.from_arrays([pa.array(range(base, base + count), pa.int64()), pa.array([k] * count, pa.int64()), _values(n for n, _ in rows), pa.array([f for _, f in rows], pa.list_(pa.int64()))], ["rank", "block_id", "n", "factors"])


class Orc1(_Source):
    columns, reads = "rank long, block_id long, n decimal(38,0), factors array<long>", _Orc1Reader


class _FixedReader(_Reader):
    """Rows of a fixed width, after a header."""

    def partitions(self):
        width, head = self.source.width(), self.source.head
        size = _size(self.path) - head
        formats.need(size >= 0 and size % width == 0, "the size isn't a multiple of a row's")
        return [Part(k, min(k + ROWS, size // width)) for k in range(0, max(size // width, 1), ROWS)]

    def read(self, part):
        a, b = part.what
        width, head = self.source.width(), self.source.head
        rows = self.source.rows(_bytes(self.path, head + a * width, head + b * width))
        yield pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), rows], self.source.columns.split()[0:1] + [self.source.columns.split(", ")[1].split()[0]])


class Raw16(_Source):
    columns, reads, head = "rank long, v decimal(38,0)", _FixedReader, 0

    def width(self) -> int:
        return 16

    def rows(self, data: bytes) -> pa.Array:
        return _values(formats.read_raw16(data))


class Paths(_Source):
    """Option fields: 12 or 14."""

    columns, reads, head = "rank long, path array<long>", _FixedReader, 0

    def width(self) -> int:
        return formats.FIELD * int(self.options.get("fields", 14))

    def rows(self, data: bytes) -> pa.Array:
        return pa.array(formats.read_paths(data, int(self.options.get("fields", 14))), pa.list_(pa.int64()))


class Masks(_Source):
    columns, reads, head = "rank long, mask int", _FixedReader, 8

    def width(self) -> int:
        return 2

    def rows(self, data: bytes) -> pa.Array:
        return pa.array([int.from_bytes(data[k : k + 2], "little") for k in range(0, len(data), 2)], pa.int32())


class _Vbg1Reader(_Reader):
    def read(self, part):
        yield pa.RecordBatch.from_arrays([_values(formats.vbg1_decode(_bytes(self.path)))], ["v"])


class Vbg1(_Source):
    reads = _Vbg1Reader


class _CndReader(_Reader):
    def partitions(self):
        modulus, width, classes = formats.cnd_open(Ranged(self.path))
        return [Part(modulus, width, classes[k : k + CLASSES]) for k in range(0, len(classes), CLASSES)]

    def read(self, part):
        modulus, width, classes = part.what
        begin, end = classes[0][2], classes[-1][3]
        data = _bytes(self.path, begin, end)
        out = [k * modulus + r for r, count, a, b in classes for k in formats.interpolated(data[a - begin : b - begin], count, width)]
        formats.need(all(v % 2 for v in out), "a value is even")
        yield pa.RecordBatch.from_arrays([_values(out)], ["v"])


class Cnd(_Source):
    reads = _CndReader


class _Pwt2Reader(_Reader):
    def read(self, part):
        data = _bytes(self.path)
        full = bool(int.from_bytes(data[6:8], "little") & pwt2.FULL)
        rows = []
        for path in pwt2.decode(data):
            rows.append((path, pwt2.value_of(path, full)))
            if len(rows) == 10_000:
                yield self._batch(rows)
                rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.list_(pa.int64())), _values(n for _, n in rows)], ["path", "n"])


class Pwt2(_Source):
    """Paths in tree order and the values they stand for."""

    columns, reads = "path array<long>, n decimal(38,0)", _Pwt2Reader


FORMATS = (Orc1, Raw16, Paths, Masks, Vbg1, Cnd, Pwt2)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for f in FORMATS:
        spark.dataSource.register(f)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(n, factors, problem): records of a text table; what breaks the line format is told, not dropped."""
    line = F.col("value")
    ok = line.rlike(r"^[1-9][0-9]{0,37}( [1-9][0-9]{0,17})+$")
    parts = F.split(line, " ")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.when(ok, parts[0].cast(arith.WIDE)).alias("n"), F.when(ok, F.transform(F.slice(parts, 2, 99), lambda x: x.cast("long"))).alias("factors"), F.when(~ok, line).alias("problem")
    )


def write_text(records: DataFrame, path: str) -> None:
    """Records of (n, factors) in order of n, as part files."""
    line = F.concat_ws(" ", F.col("n").cast("string"), F.array_join(F.transform("factors", lambda x: x.cast("string")), " "))
    records.repartitionByRange("n").sortWithinPartitions("n").select(line.alias("value")).write.text(path)


def _store(spark: SparkSession, path: str, parts) -> None:
    """One file, put down complete: its parts are written beside, one after another, and renamed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.partial-{uuid.uuid4().hex}")
    where = final.getFileSystem(conf)
    out = where.create(beside, True)
    for data in parts:
        for k in range(0, len(data), 1 << 20):
            out.write(data[k : k + (1 << 20)])
    out.close()
    where.delete(final, False)
    if not where.rename(beside, final):
        raise OSError(f"{path} could not be put in place")


def _chunks(rows: DataFrame, key: str, schema: str, encode) -> Iterator[bytes]:
    """Encodes groups in parallel; the pieces come to the driver in order, one at a time, as the file has to be one."""
    return (bytes(r["data"]) for r in rows.groupBy(key).applyInPandas(encode, schema).orderBy(key).toLocalIterator())


@contextlib.contextmanager
def _pieces(rows: DataFrame, key: str, schema: str, encode, path: str):
    """The same, for files that begin with figures of all pieces: written beside the file, then read as often as needed."""
    spark, beside = rows.sparkSession, f"{path}.pieces-{uuid.uuid4().hex}"
    rows.groupBy(key).applyInPandas(encode, schema).write.parquet(beside)
    try:
        yield spark.read.schema(schema).parquet(beside).orderBy(key)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(beside)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _data(pieces: DataFrame) -> Iterator[bytes]:
    return (bytes(r["data"]) for r in pieces.toLocalIterator())


def _ints(frame: pd.DataFrame, column: str) -> list[int]:
    return [int(x) for x in frame[column]]


def n_targets(values: DataFrame, column: str = "n") -> bytes:
    """What a list certifies to: its ordered hash is streamed through the driver, range by range."""
    digest, total, n = hashlib.sha256(), 0, 0
    for r in values.select(column).orderBy(column).toLocalIterator():
        v = int(r[0])
        digest.update(v.to_bytes(16, "little"))
        total, n = total + v, n + 1
    return digest.digest() + (total & formats.MASK128).to_bytes(16, "little") + n.to_bytes(8, "little")


def write_orc1(records: DataFrame, path: str) -> None:
    """Records of (n, factors); n below 10**38, at most 2**53 apart from its text order."""
    rows = _ranked_wide(records, "n").withColumn("block", F.floor(F.col("rank") / formats.BLOCK).cast("long"))

    def encode(frame):
        frame = frame.sort_values("rank")
        own = list(zip(_ints(frame, "n"), [sorted(int(p) for p in f) for f in frame["factors"]], strict=True))
        text = "".join(formats.text_line(*r) for r in own).encode()
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "first": [str(own[0][0])], "rows": [len(own)], "total": [str(sum(n for n, _ in own))], "data": [formats.orc1_block(own)], "text": [text]})

    with _pieces(rows, "block", "block long, first string, rows int, total string, data binary, text binary", encode, path) as pieces:
        blocks, sha, last = [], hashlib.sha256(), -1
        for r in pieces.select("block", "first", "rows", "total", F.octet_length("data").alias("size"), "text").toLocalIterator():
            sha.update(r["text"])
            blocks.append((int(r["first"]), r["block"] * formats.BLOCK, r["rows"], int(r["total"]), r["size"]))
            formats.need(blocks[-1][0] > last, "values don't ascend")
            last = blocks[-1][0]
        _store(records.sparkSession, path, formats.orc1_parts(blocks, _data(pieces.select("block", "data")), sha.digest()))


def _ranked_wide(rows: DataFrame, key: str) -> DataFrame:
    """Ranks by a wide key: ordered by its nearest double first, then exactly."""
    return ranked(rows.withColumn("_d", F.col(key).cast("double")), "_d", F.col(key).asc()).drop("_d")


def write_raw16(values: DataFrame, path: str, column: str = "v") -> None:
    rows = _ranked_wide(values.select(F.col(column).alias("v")), "v").withColumn("part", F.floor(F.col("rank") / ROWS).cast("long"))
    encode = lambda f: pd.DataFrame({"part": [int(f["part"].iloc[0])], "data": [formats.raw16(_ints(f.sort_values("rank"), "v"))]})
    _store(values.sparkSession, path, _chunks(rows, "part", "part long, data binary", encode))


def write_vbg1(values: DataFrame, path: str, column: str = "v") -> None:
    """Gaps are coded range by range; a range's first gap is left to the driver, which knows the value before."""
    rows = _ranked_wide(values.select(F.col(column).alias("v")), "v").withColumn("part", F.floor(F.col("rank") / ROWS).cast("long"))

    def encode(frame):
        v = _ints(frame.sort_values("rank"), "v")
        formats.need(all(a < b for a, b in zip(v, v[1:], strict=False)), "values don't ascend")
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "first": [str(v[0])], "last": [str(v[-1])], "rows": [len(v)], "data": [formats.vbytes([b - a for a, b in zip(v, v[1:], strict=False)])]})

    with _pieces(rows, "part", "part long, first string, last string, rows int, data binary", encode, path) as pieces:
        heads, n, size, last = [], 0, 0, 0
        for r in pieces.select("part", "first", "last", "rows", F.octet_length("data").alias("size")).toLocalIterator():
            formats.need(int(r["first"]) > last or not n, "values don't ascend")
            heads.append(formats.vbyte(int(r["first"]) - last))
            n, size, last = n + r["rows"], size + len(heads[-1]) + r["size"], int(r["last"])
        body = (part for pair in zip(heads, _data(pieces.select("part", "data")), strict=True) for part in pair)
        _store(values.sparkSession, path, itertools.chain([formats.VBG1 + n.to_bytes(8, "little") + size.to_bytes(8, "little")], body))


def write_cnd(values: DataFrame, path: str, modulus: int, targets: bytes, column: str = "v") -> None:
    """Class blobs are coded in parallel, by residue."""
    v = F.col(column).cast(arith.WIDE)
    rows = values.select((v % modulus).cast("long").alias("r"), arith.floor_div(v, F.lit(modulus).cast(arith.WIDE)).alias("k"))
    top = rows.agg(F.max("k")).first()[0]
    width = max(1, int(top or 0).bit_length())

    def encode(frame):
        k = sorted(_ints(frame, "k"))
        return pd.DataFrame({"r": [int(frame["r"].iloc[0])], "rows": [len(k)], "data": [formats.cnd_class(k, width)]})

    with _pieces(rows, "r", "r long, rows int, data binary", encode, path) as pieces:
        sizes = {r["r"]: (r["rows"], r["size"]) for r in pieces.select("r", "rows", F.octet_length("data").alias("size")).toLocalIterator()}  # a row a class, as in the file's directory
        _store(values.sparkSession, path, formats.cnd_parts(modulus, width, sizes, _data(pieces.select("r", "data")), targets))


def write_paths(paths: DataFrame, path: str, fields: int, order: str = "n", column: str = "path") -> None:
    rows = _ranked_wide(paths.select(F.col(order).alias("n"), F.col(column).alias("path")), "n").withColumn("part", F.floor(F.col("rank") / ROWS).cast("long"))
    encode = lambda f: pd.DataFrame({"part": [int(f["part"].iloc[0])], "data": [b"".join(formats.path_record(sorted(int(x) for x in p), fields) for p in f.sort_values("rank")["path"])]})
    _store(paths.sparkSession, path, _chunks(rows, "part", "part long, data binary", encode))


def write_masks(masks: DataFrame, path: str, order: str = "n", column: str = "mask") -> None:
    rows = _ranked_wide(masks.select(F.col(order).alias("n"), F.col(column).alias("mask")), "n").withColumn("part", F.floor(F.col("rank") / ROWS).cast("long"))
    encode = lambda f: pd.DataFrame({"part": [int(f["part"].iloc[0])], "data": [formats.mask_rows(_ints(f.sort_values("rank"), "mask"))]})
    _store(masks.sparkSession, path, itertools.chain([masks.count().to_bytes(8, "little")], _chunks(rows, "part", "part long, data binary", encode)))


def write_pwt2(paths: DataFrame, path: str, targets: bytes, full: bool = False, kind: int | None = 3, column: str = "path") -> None:
    """One stream, whose contexts depend on all before: coded by one task, in which the tree must fit; what makes the paths isn't in it."""
    encode = lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([pwt2.encode([[int(x) for x in p] for b in batches for p in b.column("path").to_pylist()], targets, full, kind)], pa.binary())], ["data"])])
    data = paths.select(F.col(column).alias("path")).repartition(1).mapInArrow(encode, "data binary").first()["data"]
    _store(paths.sparkSession, path, [bytes(data)])


def sniff(spark: SparkSession, path: str) -> str | None:
    return formats.sniff(_bytes(path, 0, 8))
