"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a part of a task's documents of a bounded number of words (a longer document is a shard of its own). Its words
are numbered by the benchmark's vocabulary; runs of such words that are as long as the shortest window are indexed, as no
window can occur elsewhere. All windows are searched backwards at once, occurrences located by sampled positions, and the
spans of a document merged. The benchmark is broadcast in blocks of bounded size, each searched against all documents; the
driver builds one block at a time, and where there are several, a worker holds one at a time.

Words are maximal runs of 0-9, a-z and anything beyond ASCII after lower-casing A-Z. Null text has no words and no hit. Items
without words, and null items, have no window. Items of the same text all count. Every row gives a row; ids may repeat.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeweave.llm.fm_index import FMIndex
from primeweave.llm.shared import at_work, batch_rows

WINDOW = 13
#: Bytes of benchmark text in a broadcast, and words in a shard's index.
BLOCK_BYTES, SHARD_WORDS = 1 << 20, 2_000_000
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character ranges of the words."""
    flat = text.encode("utf-32-le")
    codes = np.frombuffer(flat, np.uint32)
    inside = ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122)) | (codes >= 128)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


class Windows:
    """The distinct windows of some items, by length, and the items of each."""

    def __init__(self, items: list[tuple], window: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        self.items: list = []
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if words:
                self.items.append(item)
                for k in range(max(1, len(words) - window + 1)):
                    owners.setdefault(tuple(words[k : k + window]), set()).add(len(self.items) - 1)
        self.least = min(map(len, owners), default=0)
        self.groups = []
        for n in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == n]
            lists = [sorted(owners[w]) for w in own]
            self.groups.append((n, np.array(own, np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.array([i for x in lists for i in x], np.int64)))


class Shard:
    """Runs of some documents, and what the windows hit in them."""

    def __init__(self, windows: Windows):
        self.windows, self.parts, self.doc, self.word, self.size = windows, [], [], [], 0

    def add(self, doc: int, numbers: np.ndarray) -> None:
        if not self.windows.least:
            return
        known = np.concatenate([[0], (numbers > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= self.windows.least:
                self.parts += [numbers[a:b], np.zeros(1, np.int64)]
                self.doc.append(np.full(b - a + 1, doc))
                self.word.append(np.arange(a, b + 1))
                self.size += int(b - a + 1)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, word) pairs that are hit, and (doc, item) pairs as rows of two."""
        none = np.zeros(0, np.int64)
        if not self.parts:
            return none, none, np.zeros((0, 2), np.int64)
        text, doc, word = np.concatenate(self.parts), np.concatenate(self.doc), np.concatenate(self.word)
        index, cover, pairs = FMIndex(text), np.zeros(len(text) + 1, np.int64), []
        for n, patterns, offsets, owners in self.windows.groups:
            lo, hi = index.find(patterns)
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            size = (hi - lo)[found]
            rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            at, of = index.locate(rows), np.repeat(found, size)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            seen = np.unique(np.stack([doc[at], of], 1), axis=0)
            many = np.diff(offsets)[seen[:, 1]]
            first = np.repeat(offsets[:-1][seen[:, 1]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            pairs.append(np.stack([np.repeat(seen[:, 0], many), owners[first]], 1))
        hit = np.cumsum(cover)[:-1] > 0
        return doc[hit], word[hit], np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def _spans(at: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + 1).tolist(), strict=True)) if len(at) else []


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list:
    """The benchmark in broadcasts of about BLOCK_BYTES of text."""
    items = benchmark.select(F.col(item_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).where("i is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    rows = items.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(n))).orderBy("k").toLocalIterator()
    own = ([(r.i, r.t) for r in part] for _, part in groupby(rows, key=lambda r: r.k))
    return [benchmark.sparkSession.sparkContext.broadcast(Windows(block, WINDOW)) for block in own]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, item_ids, spans): item ids as sorted strings; spans are the merged character ranges to remove."""
    blocks = _blocks(benchmark, item_col, item_text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    batch_rows(docs.sparkSession)

    def run(batches):
        at_work("decontamination")
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            at = 0
            while at < batch.num_rows:
                numbered, total, start = [], 0, at
                while at < batch.num_rows and (not total or total < SHARD_WORDS):
                    numbered.append(words_of(texts[at].as_py()))
                    total += len(numbered[-1])
                    at += 1
                yield _shard(blocks, ids.slice(start, at - start), texts.slice(start, at - start), numbered)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def _shard(blocks: list, ids: pa.Array, texts: pa.Array, docs: list[list[bytes]]) -> pa.RecordBatch:
    hit: dict[int, list] = {}
    items: dict[int, set] = {}
    for block in blocks:
        windows = block.value
        shard, number = Shard(windows), windows.vocab.get
        for k, words in enumerate(docs):
            shard.add(k, np.fromiter((number(w, 0) for w in words), np.int64, len(words)))
        doc, word, pairs = shard.hits()
        for k in np.unique(doc).tolist():
            hit.setdefault(k, []).append(word[doc == k])
        for k, i in pairs.tolist():
            items.setdefault(k, set()).add(str(windows.items[i]))
        if len(blocks) > 1:
            del windows, shard, number, block._value  # read again from the broadcast's file when next wanted
    n_hit, spans = [0] * len(docs), [[]] * len(docs)
    for k, parts in hit.items():
        at, where = np.unique(np.concatenate(parts)), word_spans(texts[k].as_py())
        n_hit[k] = len(at)
        spans[k] = [{"start": where[a][0], "end": where[b - 1][1]} for a, b in _spans(at)]
    found = [sorted(items.get(k, ())) for k in range(len(docs))]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in docs], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, kind)], ["id", "n_words", "n_hit", "item_ids", "spans"])


def contaminated():
    """At least one hit word, and a twentieth of the words hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def removed(text: str | None, spans) -> str | None:
    """The text without its spans."""
    if not text or not spans:
        return text
    keep, at = [], 0
    for s in spans:
        keep.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*keep, text[at:]])


def brute_force(docs: list[tuple], items: list[tuple]) -> dict:
    """{id: (n_words, n_hit, item ids)} by trying every place; for tests."""
    out = {}
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            own = words_of(t)
            for k in range(max(1, len(own) - WINDOW + 1)) if own else ():
                w = own[k : k + WINDOW]
                for a in range(len(words) - len(w) + 1):
                    if words[a : a + len(w)] == w:
                        hit.update(range(a, a + len(w)))
                        found.add(str(item))
        out[doc] = (len(words), len(hit), sorted(found))
    return out


__all__ = ["brute_force", "contaminated", "contamination", "removed", "words_of"]
