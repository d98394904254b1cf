"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library. The ordinary one is trained on all windows of ordinary text. The toxic
one is trained on what is toxic in toxic texts: for each text, its expressions in a row. An expression (a word, or the beginning
of words) belongs to toxic text if it stands between many different neighbours there, so that copies don't count, and far
seldomer in ordinary text. Toxic texts are ordinary prose but for these, so a dictionary trained on their whole windows holds the
same prose as the ordinary one; compressors differ by the toxic dictionary alone: both have the ordinary one, and behind it one
has the toxic dictionary, the other as many bytes that match nothing, so that all else lies at the same distance.

A text is cut into overlapping windows at blanks; each is compressed by either, and by how many bytes the toxic one is shorter is
the window's distance. A text's score is a logistic curve over a few figures of its distances, with thresholds calibrated on
labelled texts that the dictionaries haven't seen.

Learning reads a bounded sample of labelled rows: about TRAIN_DOCS of either label, chosen by a hash of the id. Whole texts are
read, in learning and in scoring, all of their windows.

Null text: as empty; an empty text has one empty window. Without labelled rows of both kinds every score is 0. Labels that
repeat count as toxic if one of them is; null labels are left out. Every row gives a row; ids may repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeweave.llm.shared import Stages, at_work, give_back

TRAIN_DOCS = {1: 4000, 0: 8000}
WINDOW, STRIDE = 80, 40
DICTIONARY_BYTES = 16384
#: An expression's different neighbours, and how much oftener than in ordinary text, at least.
NEIGHBOURS, OFTENER = 5, 25
#: Length of the strings that the trainer counts, and of the segments it takes, for the toxic dictionary; its least size.
STRING, SEGMENT, LEAST_BYTES = 6, 200, 256
#: Weight of toxic against ordinary texts in calibration.
PRIOR = 0.25
_CUT = re.compile(r"[\s.,;:!?|]+")


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows that end at blanks where there are any; they cover the text."""
    if len(text) <= WINDOW:
        return [text]
    out, n, at = [], len(text), 0
    while True:
        end = at + WINDOW
        if end >= n:
            out.append(text[at:])
            return out
        k = text.rfind(b" ", at + STRIDE, end)
        end = k + 1 if k > 0 else end
        out.append(text[at:end])
        k = text.find(b" ", at + STRIDE, end - 1)
        at = k + 1 if k > 0 else at + STRIDE


def _plain(text: str | None) -> bytes:
    return (text or "").lower().encode()


class Distances:
    """Compressors for both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.kept = (ordinary, toxic)
        self.ordinary, self.toxic = (self._compressor(ordinary + b" " + x) for x in (b"\1" * len(toxic), toxic))

    @staticmethod
    def _compressor(content: bytes):
        import zstandard as z

        log = max(16, len(content).bit_length() + 1)  # every place of the content is found
        how = z.ZstdCompressionParameters(window_log=log + 1, chain_log=log, hash_log=log, search_log=4, min_match=4, target_length=16, strategy=z.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        content = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=how)
        return z.ZstdCompressor(dict_data=content, compression_params=how)

    def __reduce__(self):
        return Distances, self.kept

    def of(self, text: str | None) -> np.ndarray:
        a, b = self.ordinary.compress, self.toxic.compress
        return np.array([len(a(w)) - len(b(w)) for w in windows(_plain(text))], np.int64)


def figures(d: np.ndarray) -> list[float]:
    """What the curve looks at: the two greatest distances, windows beyond 3, their share, the sum against the length, negatives."""
    n, top = len(d), np.sort(d)[::-1]
    beyond = int((d >= 3).sum())
    return [min(top[0], 8), min(top[1], 8) if n > 1 else 0, np.log1p(beyond), beyond / n, np.clip(d - 1, 0, 6).sum() / np.sqrt(n), (d <= -2).sum() / n]


class Curve:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        w = np.where(y == 1, PRIOR / max((y == 1).sum(), 1), (1 - PRIOR) / max((y == 0).sum(), 1)) * len(y)
        a, b = self._rows(x), np.zeros(x.shape[1] + 1)
        hold = 0.1 * np.r_[np.ones(x.shape[1]), 0.01]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            b -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(hold), a.T @ (w * (p - y)) + hold * b)
        self.b = b

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.spread, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._rows(x) @ self.b, -30, 30)))


def _neighbours(batches):
    """Distinct (word or beginning of one, hash of its neighbours, label) of a few texts."""
    import xxhash

    at_work("toxicity")
    for batch in (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100)):  # a set of a text's tuples is many times its size
        seen = set()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            w = ["", *_CUT.split(text.lower()), ""]
            for k in range(1, len(w) - 1):
                if len(w[k]) > 3:
                    between = xxhash.xxh64_intdigest(f"{w[k - 1]} {w[k + 1]}") >> 1
                    seen.update((w[k][:n], between, toxic) for n in {4, 5, 6, 8, len(w[k])} if n <= len(w[k]))
        cols = list(zip(*seen, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["word", "between", "toxic"])


def _windows(batches):
    """A text's windows in one value, parted by a byte that ends a window wherever it stands."""
    at_work("toxicity")
    for batch in batches:
        for text in batch.column("text"):
            yield pa.RecordBatch.from_arrays([pa.array([b"\0".join(windows(_plain(text.as_py())))], pa.binary())], ["w"])


def _found(expressions: list[str]):
    """Of each text the words that begin with an expression, in a row, in an order by hash: those of one text often repeat."""
    import xxhash

    longest = "|".join(re.escape(x) for x in sorted(expressions, key=len, reverse=True))
    words = re.compile(rf"(?<!\w)(?:{longest})[^\s.,;:!?|]*")

    def run(batches):
        at_work("toxicity")
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                own = list(enumerate(words.findall(text.lower())))
                own.sort(key=lambda x: xxhash.xxh64_intdigest(f"{x[0]} {x[1]}"))
                out.append("".join(f"{w} " for _, w in own).encode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["w"])

    return run


def _trained(size: int, samples: list[bytes], otherwise: bytes, **how) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer
        return otherwise[-size:]


def _figures_of(distances: Distances, batches):
    at_work("toxicity")
    for batch in batches:
        rows = [figures(distances.of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Distances, Curve] | None:
    """Fit on all the labelled rows given, or on a bounded sample of them."""
    spark = docs.sparkSession
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    lot = F.pmod(F.xxhash64("_id", F.lit(4)), F.lit(1 << 20))
    wanted = F.lit(False)
    for k, n in counts.items():
        wanted = wanted | ((F.col("toxic") == k) & (lot < int(np.ceil((1 << 20) * min(1, TRAIN_DOCS[k] / n)))))
    stages = Stages(spark)
    some = labels.where(wanted).withColumn("part", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(3)))
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(some), "_id")  # at most about TRAIN_DOCS rows
    sample = stages.put(sample.select("text", "toxic", "part"), "labelled")
    shaping, rest = sample.where("part > 0"), sample.where("part = 0")
    texts = {r["toxic"]: r["count"] for r in shaping.groupBy("toxic").count().collect()}
    if len(texts) < 2:
        return None
    words = shaping.mapInArrow(_neighbours, "word string, between long, toxic int").distinct().groupBy("word")
    words = words.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    oftener = (F.col("t") / texts[1]) / ((F.col("o") + 0.5) / texts[0])
    top = words.where((F.col("t") >= NEIGHBOURS) & (oftener >= OFTENER)).orderBy(F.desc("t"), "word").collect()  # of a bounded sample
    expressions = [r["word"] for r in top]
    by_hash = [F.xxhash64("w"), F.col("w")]
    ordinary = [w for r in shaping.where("toxic = 0").mapInArrow(_windows, "w binary").orderBy(*by_hash).collect() for w in bytes(r["w"]).split(b"\0")]  # of a bounded sample
    found = [bytes(r["w"]) for r in shaping.where("toxic = 1").mapInArrow(_found(expressions), "w binary").where(F.length("w") >= 8).orderBy(*by_hash).collect()] if expressions else []
    plain = " ".join(reversed(expressions)).encode()
    toxic = _trained(max(LEAST_BYTES, len(plain)), found * 4, plain, k=SEGMENT, d=STRING, split_point=1.0)  # the trainer wants samples beyond the size
    distances = Distances(_trained(DICTIONARY_BYTES, ordinary, b" ".join(ordinary)), toxic)
    rows = (rest if rest.select("toxic").distinct().count() > 1 else sample).mapInArrow(lambda b: _figures_of(distances, b), "toxic int, x array<double>").collect()
    stages.drop()
    order = sorted((r["toxic"], list(r["x"])) for r in rows)
    return distances, Curve(np.array([x for _, x in order]), np.array([y for y, _ in order]))


def score(docs: DataFrame, model: tuple[Distances, Curve] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, n_windows, n_beyond): a score of 0.5 or more predicts toxic."""
    give_back()  # what the driver learnt from
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        at_work("toxicity")
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                d = [model[0].of(t.as_py()) if model else np.zeros(1, np.int64) for t in part.column("text")]
                p = model[1](np.array([figures(x) for x in d])) if model else np.zeros(len(d))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(x) for x in d], pa.int64()), pa.array([int((x >= 3).sum()) for x in d], pa.int64())], ["id", "score", "predicted", "n_windows", "n_beyond"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, score double, predicted int, n_windows long, n_beyond long").withColumnRenamed("id", id_col)
