"""Exact token counts at every prefix of a text, for a sentencepiece BPE model.

Merges never cross a place where a non-blank is followed by a blank or a line feed touches anything, as no piece of such a
vocabulary spans one; a text is therefore a chain of chunks (blanks with the word after them, or a line feed), and the count
at a prefix is the count at the chunk's start plus the count of the part of the chunk. Inside a chunk, cut further where no piece holds
the two characters that meet, dynamic programming
over prefixes finds the one last piece that a prefix's encoding ends with: the piece before it must be the last piece of the
shorter prefix, and the two must be left apart by the encoder. Each chunk is solved once a worker; no text is re-encoded.

Null text: as empty. Empty text: 0 bytes, 0 tokens, an empty table. Every row gives a row; ids may repeat.
"""

from __future__ import annotations

from array import array
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from primeweave.llm.shared import at_work, remembers

#: Chunks, and pairs of pieces, that a worker remembers; beyond it, it starts anew.
REMEMBERED = 500_000


class PrefixSolver(dict):
    """Maps a chunk to one signed byte a character: by how much the token count changes at it."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(self.sp.get_piece_size())
        self.pieces = {self.sp.id_to_piece(i) for i in ids if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))}
        self.longest = max(map(len, self.pieces))
        if any("\n" in p or "▁" in p.lstrip("▁") for p in self.pieces):
            raise ValueError("pieces of this vocabulary span chunks")
        self.tails = {p[k:] for p in self.pieces for k in range(len(p))}
        self.inner = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.parts: dict[str, bytes] = {}
        self.lead = len(self.sp.encode("\n"))
        self.apart: dict[tuple[str, str], bool] = {}

    def split(self, a: str, b: str) -> bool:
        """Whether the encoder leaves the pieces a and b apart where they meet."""
        try:
            return self.apart[a, b]
        except KeyError:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            out = self.sp.encode("\n" + (a + b).replace("▁", " "), out_type=str)[self.lead :]
            self.apart[a, b] = out == [a, b]
            return self.apart[a, b]

    def counts(self, chunk: str) -> list[int]:
        """Token counts of the chunk's prefixes, the empty one first; blanks are ▁."""
        pieces, tails, apart, split = self.pieces, self.tails, self.apart, self.split
        count, last = [0], [None]
        for i in range(1, len(chunk) + 1):
            for j in range(i - 1, -1, -1):
                piece = chunk[j:i]
                if piece not in tails:
                    j = -1
                    break
                if piece in pieces:
                    before = last[j]
                    if before is None:
                        break
                    pair = (before, piece)
                    if apart[pair] if pair in apart else split(*pair):
                        break
            else:
                j = -1
            if j >= 0:
                count.append(count[j] + 1)
                last.append(piece)
            elif chunk[i - 1] in pieces:
                raise AssertionError(f"no last piece for {chunk[:i]!r}")
            else:  # bytes stand for this character: it meets nothing
                count.append(count[-1] + len(chunk[i - 1].encode()))
                last.append(None)
        return count

    def part(self, part: str) -> bytes:
        """The table of a part of a chunk across whose ends nothing merges."""
        try:
            return self.parts[part]
        except KeyError:
            out = array("b", map(sub, (count := self.counts(part))[1:], count)).tobytes()  # no step is beyond a byte
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            if len(part) < 100:
                self.parts[part] = out
            return out

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        inner, at, out = self.inner, 0, []
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in inner:
                out.append(self.part(chunk[at:k]))
                at = k
        out = b"".join([*out, self.part(chunk[at:])])
        if len(chunk) < 100:
            self[chunk] = out
        return out

    def deltas(self, text: str) -> bytes:
        """The whole text's table. The encoder puts a blank before a text; it counts with the first character."""
        if not text:
            return b""
        out: list[bytes] = []
        for k, line in enumerate(("▁" + text.replace(" ", "▁")).split("\n")):
            if k:
                out.append(b"\1")
            if "▁▁" in line:
                words = line.split("▁")
                held = ""
                for at, w in enumerate(words):
                    if at:
                        held += "▁"
                    if w or at == len(words) - 1:
                        if held or w:
                            out.append(self[held + w])
                        held = ""
            else:
                first, *rest = line.split("▁")
                if first:
                    out.append(self[first])
                out += [self["▁" + w] for w in rest]
        whole = np.frombuffer(b"".join(out), np.int8)
        if len(whole) < 2:  # the added blank alone can't be: the text isn't empty
            raise AssertionError("a chunk is missing")
        whole = whole.copy()
        whole[1] += whole[0]
        return whole[1:].tobytes()


def solver(model_path: str) -> PrefixSolver:
    solvers = remembers("token_counts")
    if model_path not in solvers:
        solvers[model_path] = PrefixSolver(model_path)
    return solvers[model_path]


def prefix_token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, prefix_deltas): the table has one signed byte a character; its running sum is the count."""
    id_type = df.schema[id_col].dataType
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        at_work("token_counts")
        solve = solver(model_path)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256)
                tables = [solve.deltas(t) for t in part.to_pylist()]
                totals = [int(np.frombuffer(t, np.int8).sum(dtype=np.int64)) for t in tables]
                n_bytes = pa.compute.binary_length(part).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, 256), n_bytes, pa.array(totals, pa.int64()), pa.array(tables, pa.binary())], ["id", "n_bytes", "n_tokens", "prefix_deltas"])

    import pyarrow.compute  # noqa: F401

    out = docs.mapInArrow(run, f"id {id_type.simpleString()}, n_bytes long, n_tokens long, prefix_deltas binary")
    return out.withColumnRenamed("id", id_col)


def tokens_before(deltas: Column, position: Column) -> Column:
    """Token count of the first `position` characters, from the table alone."""

    @F.pandas_udf("long")
    def at(d, p):
        import pandas as pd

        return pd.Series([None if x is None else int(np.frombuffer(x, np.int8)[: max(int(n), 0)].sum(dtype=np.int64)) for x, n in zip(d, p, strict=True)], dtype="Int64")

    return at(deltas, position)


def fitting_prefix(deltas: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most `budget` tokens, from the table alone."""

    @F.pandas_udf("long")
    def fit(d, b):
        import pandas as pd

        def one(x, n):
            fits = np.flatnonzero(np.cumsum(np.frombuffer(x, np.int8), dtype=np.int64) <= n)
            return int(fits[-1]) + 1 if len(fits) else 0

        return pd.Series([None if x is None else one(x, n) for x, n in zip(d, b, strict=True)], dtype="Int64")

    return fit(deltas, budget)
