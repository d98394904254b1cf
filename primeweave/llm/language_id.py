"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier over hashed byte trigrams (naive Bayes log odds, each
language weighing alike) gives a margin a trigram. Decoding sums, over the bits, the exponential loss of the margin against the
codeword, weighted by how well the bit was told on the training texts; the least loss wins, and a small lead over the second
codeword marks the row as ambiguous.

The classifiers are fitted on a bounded sample: of each language at most about TRAIN_DOCS labelled documents, chosen by a hash
of the id. Whole texts are read, in training and in prediction.

Null text, or text without a letter: `und`, score 0, not ambiguous. Without any learned language every row is `und`. Every row
gives a row; ids may repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 3000
FEATURES = 1 << 16
#: Up to so many languages the code has every split of them; beyond, random bits.
EXHAUSTIVE = 6
BLOCK = 1 << 19


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each language."""
    if n <= EXHAUSTIVE:
        return np.array([[1 if b >> k & 1 else -1 for b in range(1, 1 << (n - 1))] for k in range(n)], np.float32).reshape(n, -1)
    draw = np.random.default_rng(7)
    bits = int(12 * np.ceil(np.log2(n)))
    while True:
        code = draw.choice(np.array([-1, 1], np.float32), (n, bits))
        if (np.abs(code.sum(0)) < n).all() and len(np.unique(code, axis=0)) == n:
            return code


def grams(data: np.ndarray) -> np.ndarray:
    """A feature for every byte trigram."""
    a = data.astype(np.uint32)
    return ((a[:-2] * 0x9E3779B1 + a[1:-1] * 0x85EBCA6B + a[2:] * 0xC2B2AE35) >> 16).astype(np.int32)


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's texts, and where each begins (and the last ends)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), offsets


def gram_sums(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its trigrams' rows of the table, and the number of trigrams; in blocks of bounded size."""
    data, offsets = _texts(column)
    sums, n = np.zeros((len(column), table.shape[1])), np.zeros(len(column), np.int64)
    at = 0
    while at < len(column):
        end = at + 1
        while end < len(column) and offsets[end + 1] - offsets[at] <= BLOCK:
            end += 1
        for a in range(offsets[at], max(offsets[end] - 2, offsets[at]), BLOCK):
            part = _lower(data[a : min(a + BLOCK + 2, offsets[end])])
            g = grams(part)
            doc = np.searchsorted(offsets[at : end + 1], np.arange(a, a + len(g)), "right") - 1 + at
            inside = np.arange(a, a + len(g)) + 2 < offsets[doc + 1]
            g, doc = g[inside], doc[inside]
            if len(g):
                cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                sums[doc[cut]] += np.add.reduceat(table[g], cut, axis=0)
                n[doc[cut]] += np.diff(np.append(cut, len(doc)))
        at = end
    return sums, n


def _counts(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        total: dict[str, np.ndarray] = {}
        for k, lang in enumerate(langs):
            data, offsets = _texts(batch.column("text").slice(k, 1))
            own = _lower(data[offsets[0] : offsets[1]])
            if len(own) > 2:
                total.setdefault(lang, np.zeros(FEATURES, np.int64))
                total[lang] += np.bincount(grams(own), minlength=FEATURES)
        for lang, counts in total.items():
            f = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array(f, pa.int64()), pa.array(counts[f])], ["lang", "f", "n"])


def _sample(labelled: DataFrame, id_col: str, lang_col: str, text_col: str, bound: int) -> DataFrame:
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # one row a language
    lot = F.pmod(F.xxhash64(id_col), F.lit(1 << 20))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col(lang_col) == lang) & (lot < max(1, int((1 << 20) * bound / n)) if n > bound else F.col(lang_col) == lang))
    return labelled.where(wanted).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, code: np.ndarray, weight: np.ndarray, scale: np.ndarray):
        self.langs, self.table, self.code, self.weight, self.scale = langs, table, code, weight, scale

    def losses(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each language."""
        margin = np.clip(sums / np.maximum(n, 1)[:, None] / self.scale, -8, 8)
        return (np.exp(-margin[:, None, :] * self.code[None]) * self.weight).sum(2)


def train(labelled: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", bound: int = TRAIN_DOCS) -> Model | None:
    """Fit on rows whose lang isn't null."""
    sample = _sample(labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), id_col, lang_col, text_col, bound)
    rows = sample.mapInArrow(_counts, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()  # at most FEATURES rows a language
    langs = sorted(rows["lang"].unique())
    if not langs:
        return None
    counts = np.zeros((len(langs), FEATURES))
    np.add.at(counts, (np.searchsorted(np.array(langs, object), rows["lang"].to_numpy(object)), rows["f"].to_numpy()), rows["n"].to_numpy())
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    code = codewords(len(langs))
    bits = code.shape[1]
    table = np.stack([np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0)) for b in range(bits)], 1).astype(np.float32) if bits else np.zeros((FEATURES, 0), np.float32)
    # the margin that an average text of each language has at each bit: its spread scales margins, its least sets the weight
    usual = (counts / counts.sum(1, keepdims=True)) @ table * code if bits else np.zeros((len(langs), 0))
    scale = np.maximum(np.abs(usual).mean(0), 1e-6)
    weight = np.clip(usual.min(0) / scale, 0.05, None)
    return Model(langs, table, code, weight / max(weight.sum(), 1e-9), scale)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            seen = np.array([t.is_valid for t in batch.column("text")], bool)
            lang, score, unsure = np.full(len(seen), "und", object), np.zeros(len(seen)), np.zeros(len(seen), bool)
            if m and seen.any():
                loss = m.losses(*gram_sums(batch.column("text"), m.table))
                chance = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
                chance /= chance.sum(1, keepdims=True)
                best = np.argmax(chance, 1)
                lang[seen] = np.array(m.langs, object)[best][seen]
                score[seen] = chance.max(1)[seen]
                unsure = seen & (np.sort(chance, 1)[:, -2:].sum(1) - chance.max(1) > 0.25 if chance.shape[1] > 1 else np.zeros(len(seen), bool))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"id {id_type}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    from primeweave.llm.shared import fold

    return fold(id_col, 4) == 2
