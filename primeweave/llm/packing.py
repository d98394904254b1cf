"""Packing by shortest-pack-first over the length histogram.

Documents become pieces: as many of the capacity as fit, and a rest. The histogram of piece lengths has at most `capacity`
rows, so packing it is a small task for the driver whatever the corpus; patterns (which lengths go together, and how often)
are joined back to the pieces by their rank within their length. Ranks are counted within (length, salt) and then shifted, so
a length that a third of all documents share is spread over many tasks.

Null text: as empty; every document has at least its end token. Rows may repeat; equal rows are interchangeable. An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from primeweave.llm.shared import Stages, at_work, remembers

#: Words whose ids a worker remembers; beyond it, it starts anew.
REMEMBERED = 700_000
#: Words of one call of the tokenizer, and characters whose words are learnt together.
AT_ONCE, PART = 64, 1 << 20


class WordIds(dict):
    """Maps a word between blanks and line feeds to its ids as little-endian 32-bit bytes; such words are encoded apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)

    @staticmethod
    def plainer(word: str) -> str | None:
        """A word with the same ids, or the word before a mark that is a token group of its own; None where there is none."""
        if len(word) > 1 and word[-1] in ".,;:!?" and word[-2].lower().isalpha() and word[-2] != "Σ":
            return word[:-1]
        if word.isascii() and not word.islower() and word != (low := word.lower()) and "<|" not in word:
            return low
        return None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        plainer = self.plainer(word)
        if plainer is None:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes() if word else b""
        else:
            ids = self[plainer] + self[word[-1]] if len(plainer) < len(word) else self[plainer]
        if len(word) < 100:
            self[word] = ids
        return ids

    def learn(self, words) -> None:
        """Remember words of letters, AT_ONCE of them in a call of the tokenizer, which is cheaper than one by one: each is one
        token group, numbered in order."""
        new = set()
        for word in itertools.filterfalse(self.__contains__, words):
            while not (word.isascii() and word.isalpha() and word.islower()) and (plainer := self.plainer(word)) is not None:
                word = plainer
            if word.isalpha() and len(word) < 100 and word not in self and word.lower().isalpha():
                new.add(word)
        if len(self) + len(new) >= REMEMBERED:
            self.clear()
        new = list(new)
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, group = np.array(coded.ids, "<u4"), np.array(coded.word_ids)
            cut = np.flatnonzero(np.diff(group)) + 1
            if len(cut) + 1 == len(part):
                raw = ids.tobytes()
                ends = [0, *(4 * cut).tolist(), len(raw)]
                for k, word in enumerate(part):
                    self[word] = raw[ends[k] : ends[k + 1]]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: list[str]):
        """The ids of each text, in parts of about PART characters or one text, whose words are learnt together."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < PART:
                split.append(texts[at].replace("\n", " ").split(" "))
                size += len(texts[at])
                at += 1
            self.learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.__getitem__, words))


def word_ids(path: str) -> WordIds:
    words = remembers("packing")
    if path not in words:
        words[path] = WordIds(path)
    return words[path]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, how many), ...) with the number of sequences of each.

    Longest lengths first; each goes to the packs with most room left. Where none has room, new packs are opened, with as many
    of that length as fit.
    """
    room: dict[int, list[tuple[int, tuple]]] = {}
    heap: list[int] = []
    done: list[tuple[tuple, int]] = []

    def put(left: int, count: int, pattern: tuple) -> None:
        if not left:
            done.append((pattern, count))
            return
        if left not in room:
            room[left] = []
            heapq.heappush(heap, -left)
        room[left].append((count, pattern))

    def more(pattern: tuple, length: int, times: int) -> tuple:
        return (*pattern[:-1], (length, pattern[-1][1] + times)) if pattern and pattern[-1][0] == length else (*pattern, (length, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not heap or -heap[0] < length:
                fit = capacity // length
                if n >= fit:
                    put(capacity - fit * length, n // fit, ((length, fit),))
                if n % fit:
                    put(capacity - n % fit * length, 1, ((length, n % fit),))
                break
            left = -heap[0]
            packs = room[left]
            count, pattern = packs.pop()
            if not packs:
                del room[left]
                heapq.heappop(heap)
            below = -heap[0] if heap else 0
            times = max(1, min((left - below) // length, n // count))
            used = min(count, n // times)
            if used < count:
                put(left, count - used, pattern)
            put(left - times * length, used, more(pattern, length, times))
            n -= used * times
    return done + [(p, c) for packs in room.values() for c, p in packs]


def slots(patterns: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """For each length and range of ranks: the first sequence, how many of it in a sequence, and where the first stands."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            start = taken.get(length, 0)
            rows.append((length, start, sequence, times, offset))
            taken[length] = start + count * times
            offset += length * times
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 40 | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "times": table[:, 3], "offset": table[:, 4]}


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): the documents' ids, cut at multiples of the capacity."""
    end = np.array([end_id], "<u4").tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches):
        at_work("packing")
        words = word_ids(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                of, start, length, crc, total, ids = [], [], [], [], [], []
                for k, coded in enumerate(words.encode_all([t or "" for t in part.column("text").to_pylist()])):
                    coded += end
                    for a in range(0, len(coded), 4 * capacity):
                        own = coded[a : a + 4 * capacity]
                        of.append(k)
                        start.append(a // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        total.append(len(coded) // 4)
                        ids += [own] * with_ids
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(of, pa.int64())), *longs, *[pa.array(ids, pa.binary())] * with_ids], names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)


def pack(cut: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a staged table of pieces; what else it holds stays."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(pack_histogram(counts, capacity)))
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [id_col, "start", "ids_crc32"]
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    shift = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    shift = shift.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_shift"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)).cast("long"))
    ranked = ranked.join(shift, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_shift")).drop("_salt", "_shift")
    kept = [c for c in ranked.columns if c != "_rank"]

    def run(batches):
        t = table.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            k = np.searchsorted(t["key"], length << 40 | rank, "right") - 1
            r = rank - t["rank"][k]
            times = t["times"][k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(t["sequence"][k] + r // times), pa.array(t["offset"][k] + r % times * length)], [*kept, "sequence_id", "offset"])

    types = dict(ranked.dtypes)
    return ranked.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row a piece."""
    stages = Stages(docs.sparkSession)
    return pack(stages.put(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids), "pieces"), capacity, id_col)
