"""Quality by perplexity under interpolated modified Kneser-Ney models of trusted text, a model for each language.

The n-grams are of bytes (A-Z lowered, line ends as blanks), ORDER of them. Trusted documents are counted whole; counts,
continuation counts, context sums and discounts are tables sharded by (language, n-gram) and joined on them, so no table of
counts is ever in one place. Each order's table holds the interpolated log probability of the n-grams seen, and the weight of
the order below for each context; an unseen n-gram takes its context's weight and the order below. Texts of a language without
a model, or of null language, are scored by a pooled model ("*"), in which all trusted documents are counted.

Scoring joins the n-grams of the documents with the tables: with a copy of them in each worker, a hashed array, while they have
MODEL_ROWS rows at most (their number is checked), and beyond with the sharded tables. Logarithms are whole numbers of 1 / ONE,
so sums do not depend on their order, and both give the same perplexities (but for the last bit of their exponential).

A fifth of the trusted documents, by a hash of the id, isn't counted but scored as any unseen text; a document is kept if its
perplexity lies between two quantiles of theirs in its language, widened by SLACK.

Null and empty text: perplexity null, not kept. Without trusted documents every perplexity is 256 and nothing is kept. Labels
that repeat count once. Every row gives a row; ids may repeat.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeweave.llm.shared import Stages, small

ORDER = 5
MODEL_ROWS = 6_000_000
LOW, HIGH, SLACK = 0.002, 0.99, 1.2
POOLED = "*"
#: Logarithms are kept as whole numbers of 1 / ONE.
ONE = 1 << 20
UNSEEN = round(np.log(256) * ONE)
_PAD = b" " * (ORDER - 1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
BLOCK = 1 << 19


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the padded texts, and where each text begins and ends."""
    data = np.frombuffer(_PAD + _PAD.join(texts), np.uint8).astype(np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + len(_PAD)) - size
    code = np.zeros(len(data), np.int64)
    for k in range(ORDER):
        code[k:] |= data[: len(data) - k] << (8 * k)
    return code, begin, begin + size


def _parts(batch, column: str = "text"):
    """Slices of a batch with at most about BLOCK bytes of text, or one text."""
    texts, first, held = [], 0, 0
    for k, t in enumerate(batch.column(column)):
        t = (t.as_py() or "").encode().translate(_LOWER)
        if texts and held + len(t) > BLOCK:
            yield first, texts
            texts, first, held = [], k, 0
        texts.append(t)
        held += len(t)
    if texts:
        yield first, texts


def _counted(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        sums: dict[str, list] = {}
        for first, texts in _parts(batch):
            code, begin, end = _codes(texts)
            for lang in set(langs[first : first + len(texts)]):
                own = [code[a:b] for a, b, x in zip(begin, end, langs[first:], strict=False) if x == lang]
                sums.setdefault(lang, []).append(np.unique(np.concatenate(own), return_counts=True))
        for lang, parts in sums.items():
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "c"])


def _fixed(c: str):
    return F.round(F.log(c) * ONE).cast("int")


def _mask(k: int) -> int:
    return (1 << 8 * k) - 1


def model_tables(stages: Stages, trusted: DataFrame) -> DataFrame:
    """(lang, kind, gram, v): kind k, log probabilities of n-grams of k bytes; kind -k, log weights of their contexts, in 1 / ONE.

    trusted(lang, text); texts of language "*" are counted in the pooled model only.
    """
    counts = trusted.mapInArrow(_counted, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    counts = stages.put(counts, "counts")
    pooled = counts.groupBy("gram").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("lang"), "gram", "c")
    orders = {ORDER: counts.where(F.col("lang") != POOLED).unionByName(pooled)}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy("lang", F.col("gram").bitwiseAND(_mask(k)).alias("gram")).agg(F.count("*").alias("c"))
    lower, out = None, []
    for k in range(1, ORDER + 1):
        own = stages.put(orders[k], "order").withColumn("ctx", F.shiftright("gram", 8))
        n = own.where("c <= 4").groupBy("lang").pivot("c", [1, 2, 3, 4]).count().na.fill(0)
        y = F.col("1") / F.greatest(F.col("1") + 2 * F.col("2"), F.lit(1))
        cut = lambda j, a, b: F.when(F.col(a) > 0, F.greatest(F.lit(0.05), F.least(F.lit(j - 0.05), j - (j + 1) * y * F.col(b) / F.col(a)))).otherwise(0.5 * j)
        d = n.select("lang", cut(1, "1", "2").alias("d1"), cut(2, "2", "3").alias("d2"), cut(3, "3", "4").alias("d3"))
        d = own.select("lang").distinct().join(d, "lang", "left").na.fill({"d1": 0.5, "d2": 1.0, "d3": 1.5})
        own = own.join(F.broadcast(d), "lang")  # a row a language
        own = own.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        ctx = own.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("held")).withColumn("g", F.col("held") / F.col("total"))
        ctx = stages.put(ctx, "contexts")
        own = own.join(ctx, ["lang", "ctx"])
        if lower is None:
            own = own.withColumn("below", F.lit(1 / 256))
        else:
            own = own.withColumn("tail", F.col("gram").bitwiseAND(_mask(k - 1))).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below")), ["lang", "tail"])
        lower = stages.put(own.select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("g") * F.col("below")).alias("p")), "grams")
        out += [lower.select("lang", F.lit(k).alias("kind"), "gram", _fixed("p").alias("v")), ctx.select("lang", F.lit(-k).alias("kind"), F.col("ctx").alias("gram"), _fixed("g").alias("v"))]
    table = out[0]
    for x in out[1:]:
        table = table.unionByName(x)
    return table


class Lookup:
    """Values by (language, kind, n-gram), in a hashed array with linear probing."""

    def __init__(self, langs: list[str], keys: np.ndarray, values: np.ndarray, longest: int):
        self.langs, self.keys, self.values, self.longest = {x: k for k, x in enumerate(langs)}, keys, values, longest

    @staticmethod
    def key(lang: int, kind: int, gram: np.ndarray) -> np.ndarray:
        return ((gram.astype(np.uint64) << np.uint64(4)) | np.uint64(kind + ORDER)) * np.uint64(2) + np.uint64(1) | np.uint64(lang + 1) << np.uint64(46)

    @staticmethod
    def slot(key: np.ndarray, mask: int) -> np.ndarray:
        h = key * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(mask)).astype(np.int64)

    @classmethod
    def build(cls, langs: list[str], key: np.ndarray, value: np.ndarray) -> Lookup:
        size = 1 << max(4, int(1.35 * len(key)).bit_length())
        keys, values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        at, left, steps = cls.slot(key, size - 1), np.arange(len(key)), 0
        while len(left):
            free = left[keys[at[left]] == 0]
            keys[at[free]] = key[free]  # of those that want one slot the last one written has it
            won = free[keys[at[free]] == key[free]]
            values[at[won]] = value[won]
            left = left[keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & (size - 1)
            steps += 1
        return cls(langs, keys, values, max(steps, 1))

    def get(self, lang: int, kind: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are there, and their values (0 for others)."""
        key = self.key(lang, kind, gram)
        at = self.slot(key, len(self.keys) - 1)
        there = self.keys[at] == key
        out = np.where(there, self.values[at], np.int32(0))
        left = np.flatnonzero(~there & (self.keys[at] != 0))
        for _ in range(self.longest):
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            hit = self.keys[at[left]] == key[left]
            there[left[hit]], out[left[hit]] = True, self.values[at[left[hit]]]
            left = left[~hit & (self.keys[at[left]] != 0)]
        return there, out

    def logp(self, lang: int, code: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(code), np.int64), np.arange(len(code))
        for k in range(ORDER, 0, -1):
            gram = code[left] & _mask(k)
            there, v = self.get(lang, k, gram)
            out[left] += v
            left, gram = left[~there], gram[~there]
            if not len(left):
                return out
            out[left] += self.get(lang, -k, gram >> 8)[1]
        out[left] -= UNSEEN
        return out


def _scored(shared):
    def run(batches):
        model = _lookup(shared)
        for batch in batches:
            langs, sums, size = batch.column("lang").to_pylist(), [], []
            for first, texts in _parts(batch):
                code, begin, end = _codes(texts)
                own = np.array([model.langs.get(x, model.langs.get(POOLED, -1)) for x in langs[first : first + len(texts)]])
                got = np.zeros(len(texts), np.int64)
                for lang in np.unique(own):
                    of = np.flatnonzero(own == lang)
                    n = (end - begin)[of]
                    v = model.logp(int(lang), np.concatenate([code[a:b] for a, b in zip(begin[of], end[of], strict=True)])) if n.sum() else np.zeros(0, np.int64)
                    cut = np.concatenate([[0], np.cumsum(v)])
                    got[of] = cut[np.cumsum(n)] - cut[np.cumsum(n) - n]
                sums += got.tolist()
                size += (end - begin).tolist()
            ppl = [math.exp(-s / (n * ONE)) if n else None for s, n in zip(sums, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(ppl, pa.float64())], ["id", "lang", "perplexity"])

    return run


def _document_grams(batches):
    for batch in batches:
        for first, texts in _parts(batch):
            code, begin, end = _codes(texts)
            for k, (a, b) in enumerate(zip(begin, end, strict=True)):
                g, n = np.unique(code[a:b], return_counts=True)
                row = batch.slice(first + k, 1)
                of = pa.array(np.zeros(len(g), np.int64))
                yield pa.RecordBatch.from_arrays([row.column("row").take(of), row.column("model").take(of), pa.array(g), pa.array(n)], ["row", "model", "gram", "n"])


def _joined(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Perplexities by joins with the sharded tables."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    known = F.broadcast(table.select(F.col("lang").alias("model")).distinct())  # a row a language
    rows = rows.join(known, F.col("lang") == F.col("model"), "left").withColumn("model", F.coalesce("model", F.lit(POOLED)))
    grams = rows.select("row", "model", "text").mapInArrow(_document_grams, "row long, model string, gram long, n long")
    asked = grams.select("model", "gram").distinct().withColumns({"lp": F.lit(0), "done": F.lit(False)})
    for k in range(ORDER, 0, -1):
        p = table.where(F.col("kind") == k).select(F.col("lang").alias("model"), F.col("gram").alias("g"), F.col("v").alias("pv"))
        w = table.where(F.col("kind") == -k).select(F.col("lang").alias("model"), F.col("gram").alias("h"), F.col("v").alias("wv"))
        asked = asked.withColumn("g", F.col("gram").bitwiseAND(_mask(k))).withColumn("h", F.shiftright("g", 8)).join(p, ["model", "g"], "left").join(w, ["model", "h"], "left")
        add = F.when(F.col("done"), 0).when(F.col("pv").isNotNull(), F.col("pv")).otherwise(F.coalesce("wv", F.lit(0)))
        asked = asked.select("model", "gram", (F.col("lp") + add).alias("lp"), (F.col("done") | F.col("pv").isNotNull()).alias("done"))
    asked = asked.select("model", "gram", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") - UNSEEN).alias("lp"))
    sums = grams.join(asked, ["model", "gram"]).groupBy("row").agg((-F.sum(F.col("n") * F.col("lp")) / (F.sum("n") * ONE)).alias("h"))
    return rows.join(sums, "row", "left").select("id", "lang", F.exp("h").alias("perplexity"))


def perplexities(stages: Stages, docs: DataFrame, trusted: DataFrame, most: int = MODEL_ROWS) -> DataFrame:
    """(id, lang, perplexity) for docs(id, lang, text)."""
    table = model_tables(stages, trusted)
    rows = table.count()
    if rows > most:
        return _joined(docs, table)
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    number = F.element_at(F.create_map(*(F.lit(x) for k, x in enumerate(langs) for x in (x, k))), F.col("lang")) if langs else F.lit(0)
    parts = table.select(number.cast("int").alias("lang"), "kind", "gram", "v").mapInArrow(_entries, "keys binary, logs binary")
    got = [(bytes(r["keys"]), bytes(r["logs"])) for r in parts.toLocalIterator()]  # 12 bytes a row
    shared = stages.spark.sparkContext.broadcast((langs, got))
    return docs.mapInArrow(_scored(shared), f"id {dict(docs.dtypes)['id']}, lang string, perplexity double")


def _entries(batches):
    for batch in batches:
        lang, kind, gram = (batch.column(c).to_numpy() for c in ("lang", "kind", "gram"))
        key = ((gram.astype(np.uint64) << np.uint64(4)) | (kind + ORDER).astype(np.uint64)) * np.uint64(2) + np.uint64(1) | (lang + 1).astype(np.uint64) << np.uint64(46)
        yield pa.RecordBatch.from_arrays([pa.array([key.tobytes()]), pa.array([batch.column("v").to_numpy().tobytes()])], ["keys", "logs"])


def _lookup(shared) -> Lookup:
    """Built once a worker."""
    if getattr(shared, "_lookup", None) is None:
        langs, parts = shared.value
        join = lambda k, kind: np.frombuffer(b"".join(p[k] for p in parts), kind)
        keys, values = join(0, np.uint64), join(1, np.int32)
        del parts, shared._value  # the worker keeps the array only; the broadcast can be loaded again from its file
        shared._lookup = Lookup.build(langs, keys, values)
    return shared._lookup


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", most: int = MODEL_ROWS) -> DataFrame:
    """(id, lang, perplexity, low, high, kept), a row for each row; trusted documents are those labelled 1."""
    stages = Stages(docs.sparkSession)
    good = small(labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct(), stages, "trusted")
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    aside = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5)) == 0
    trusted = rows.join(good.where(~aside), "id", "left_semi").select(F.coalesce("lang", F.lit(POOLED)).alias("lang"), "text").where("text is not null")
    scored = stages.put(perplexities(stages, rows, trusted, most), "scored")
    unseen = scored.join(good.where(aside), "id", "left_semi").where("perplexity is not null")
    span = unseen.groupBy("lang").agg(F.percentile_approx("perplexity", [LOW, HIGH], 10000).alias("q"))
    every = unseen.agg(F.percentile_approx("perplexity", [LOW, HIGH], 10000).alias("all"))
    span = span.select(F.col("lang").alias("l"), (F.col("q")[0] / SLACK).alias("lo"), (F.col("q")[1] * SLACK).alias("hi"))
    whole = every.first()["all"]
    whole = [whole[0] / SLACK, whole[1] * SLACK] if whole else [None, None]
    out = scored.join(F.broadcast(span), F.col("lang").eqNullSafe(F.col("l")), "left")  # a row a language
    out = out.select(F.col("id").alias(id_col), "lang", "perplexity", F.coalesce("lo", F.lit(whole[0]).cast("double")).alias("low"), F.coalesce("hi", F.lit(whole[1]).cast("double")).alias("high"))
    return out.withColumn("kept", F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False)))
