"""The prefix tree walked in pre-order: distinct ranked paths, sorted over all tasks and cut into chunks, give each node once.

A chunk is a run of sorted paths, kept as one row of flat arrays. What its nodes are follows from the chunk, but for the nodes
that are open at its ends (prefixes of the last path before it, and of its own last path): of those, a first pass counts the
children in each chunk, and the driver, which holds a path and as many counts for each chunk, carries them over. Sizes of
chunks grow with the table, so that there are about CHUNKS at most; nothing but the chunks is ever shuffled or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeweave.operators.tree import COUNT_MOST, FIRST_MOST

#: Items of a chunk at least, and chunks at most, about.
ITEMS, CHUNKS = 200_000, 2000
#: Rows of an Arrow batch sent to the JVM.
ROWS = 20_000
MOST_BITS = 81
_ID = 1 << 40
_CHUNK = ["part", "seq", "lengths", "ranks", "indexes", "bits"]
_NODE = {"depth": "int", "rank": "long", "parent_rank": "long", "index": "long", "pbits": "int", "above": "int", "terminal": "boolean", "c": "long", "sibling": "long", "siblings": "long", "before": "long", "gap": "long"}


class Edge(NamedTuple):
    """A chunk's surroundings: the path before it, and of the nodes open at its ends, by depth, the children before and after it."""

    path: list[int]
    carried: list[int]
    after: list[int]


def _product_bits(items: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bit lengths, at most MOST_BITS, of the products of each path's beginnings."""
    out, at, most, values = bytearray(), 0, 1 << MOST_BITS, items.tolist()
    for n in lengths.tolist():
        q = 1
        for x in values[at : at + n]:
            q = min(q * x, most)
            out.append(min(q.bit_length(), MOST_BITS) if q > 0 else 0)
        at += n
    return np.frombuffer(bytes(out), np.uint8)


def chunks(stages, paths: DataFrame) -> DataFrame:
    """(part, seq, lengths, ranks, indexes, bits), staged: the paths of (ranks, items, indexes), none empty, in order."""
    total = paths.agg(F.sum(F.size("ranks"))).first()[0] or 0
    size = max(ITEMS, total // CHUNKS)

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in _then_none(batches):
            if batch is not None and batch.num_rows:
                held.append(batch)
                n += len(batch.column("ranks").flatten())
            if held and (batch is None or n >= size):
                lengths = np.concatenate([np.diff(b.column("ranks").offsets.to_numpy()) for b in held]).astype(np.int32)
                ranks, items, indexes = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]) for c in ("ranks", "items", "indexes"))
                data = [x.tobytes() for x in (lengths, ranks, indexes, _product_bits(items, lengths))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], _CHUNK)
                seq, held, n = seq + 1, [], 0

    rows = paths.select("ranks", "items", "indexes").repartitionByRange(int(total // size) + 1, "ranks").sortWithinPartitions("ranks")
    return stages.put(rows.mapInArrow(run, "part int, seq int, lengths binary, ranks binary, indexes binary, bits binary"), "chunks")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _common(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Chunk:
    """New nodes of a chunk, in pre-order. Local numbers: first the open chain, the prefixes it shares with the path before it."""

    def __init__(self, row: dict, before: list[int]):
        self.lengths = lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.ranks, indexes, bits = np.frombuffer(row["ranks"], np.int64), np.frombuffer(row["indexes"], np.int64), np.frombuffer(row["bits"], np.uint8).astype(np.int32)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        self.last = self.ranks[starts[-1] :].tolist()
        self.chain = _common(before, self.ranks[: lengths[0]].tolist())
        place = np.arange(len(self.ranks)) - np.repeat(starts, lengths)
        common = self._commons(starts, place)
        common[0] = self.chain
        self.closed_to = int(common.min())  # chain nodes of this depth or less stay open
        new = np.flatnonzero(place >= np.repeat(common, lengths))
        inner, above = place[new] > 0, np.maximum(new - 1, 0)
        self.depth, self.rank, self.index, self.pbits = place[new] + 1, self.ranks[new], indexes[new], bits[new]
        self.parent_rank, self.above = np.where(inner, self.ranks[above], 0), np.where(inner, bits[above], 1)
        self.terminal = self.depth == np.repeat(lengths, lengths)[new]
        n = len(new)
        self.ids = self.chain + 1 + np.arange(n)
        # of each depth the numbers in order: the last one before a node is its parent, if it is of the depth above
        self.by_depth = np.sort(np.concatenate([np.arange(self.chain + 1) * (_ID + 1), self.depth * _ID + self.ids]))
        self.parent = self._last((self.depth - 1), self.ids)
        self.counts = np.bincount(self.parent, minlength=self.chain + 1 + n)

    def _commons(self, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How much of its beginning each path shares with the one before it."""
        lengths, n = self.lengths, len(self.lengths)
        earlier = np.concatenate([[0], lengths[:-1]])
        other = np.repeat(np.concatenate([[0], starts[:-1]]), lengths) + place
        same = (place < np.repeat(earlier, lengths)) & (self.ranks[np.minimum(other, len(self.ranks) - 1)] == self.ranks)
        out = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, place), starts) if n else lengths
        return np.minimum(out, lengths)

    def _last(self, depth: np.ndarray, below: np.ndarray) -> np.ndarray:
        return self.by_depth[np.searchsorted(self.by_depth, depth * _ID + below) - 1] % _ID

    def open_ids(self) -> np.ndarray:
        """Numbers of the prefixes of the last path, by depth."""
        return self._last(np.arange(len(self.last) + 1), np.int64(_ID - 1))

    def figures(self) -> dict:
        return {"chain": self.chain, "closed_to": self.closed_to, "started": self.counts[: self.chain + 1].tolist(), "ended": self.counts[self.open_ids()].tolist()}

    def nodes(self, edge: Edge, root: bool) -> dict[str, np.ndarray]:
        """Columns of the new nodes; the root is the first chunk's first."""
        totals, carried = self.counts.copy(), np.zeros(len(self.counts), np.int64)
        carried[: self.chain + 1] = edge.carried
        totals += carried
        totals[self.open_ids()] += np.array(edge.after, np.int64)
        order = np.argsort(self.parent, kind="stable")
        parent = self.parent[order]
        first = np.r_[True, parent[1:] != parent[:-1]] if len(parent) else np.zeros(0, bool)
        begins = np.maximum.accumulate(np.where(first, np.arange(len(parent)), 0)) if len(parent) else parent
        sibling, before = np.empty(len(parent), np.int64), np.empty(len(parent), np.int64)
        sibling[order] = np.arange(len(parent)) - begins + carried[parent]
        # a chain node that has children already: the last of them is on the path before
        child = np.zeros(len(self.counts), np.int64)
        for d in range(min(self.chain + 1, len(edge.path))):
            child[d] = edge.path[d]
        led = np.where(carried[parent] > 0, child[parent], self.parent_rank[order])
        before[order] = np.where(first, led, self.rank[order][np.maximum(np.arange(len(parent)) - 1, 0)])
        out = {"depth": self.depth, "rank": self.rank, "parent_rank": self.parent_rank, "index": self.index, "pbits": self.pbits, "above": self.above, "terminal": self.terminal, "c": totals[self.ids], "sibling": sibling, "siblings": totals[self.parent], "before": before, "gap": self.rank - before}
        if root:
            top = {"depth": 0, "rank": 0, "parent_rank": 0, "index": 0, "pbits": 1, "above": 0, "terminal": False, "c": totals[0], "sibling": 0, "siblings": 0, "before": 0, "gap": 0}
            out = {k: np.concatenate([np.array([top[k]], v.dtype), v]) for k, v in out.items()}
        return out


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def edges(staged: DataFrame) -> dict[tuple[int, int], Edge]:
    """What each chunk must know of the others; a few figures for each come to the driver."""

    def ends(batches):
        for r in _rows(batches):
            n = int(np.frombuffer(r["lengths"], np.int32)[-1])
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["seq"]], pa.int32()), pa.array([np.frombuffer(r["ranks"], np.int64)[-n:].tolist()], pa.list_(pa.int64()))], ["part", "seq", "last"])

    lasts = sorted((r["part"], r["seq"], list(r["last"])) for r in staged.select("part", "seq", "lengths", "ranks").mapInArrow(ends, "part int, seq int, last array<long>").collect())
    keys = [(p, s) for p, s, _ in lasts]
    before = dict(zip(keys, [[], *(x for _, _, x in lasts)], strict=False))
    held = staged.sparkSession.sparkContext.broadcast(before)

    def count(batches):
        for r in _rows(batches):
            f = Chunk(r, held.value[r["part"], r["seq"]]).figures()
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["seq"]], pa.int32()), pa.array([f["chain"]], pa.int32()), pa.array([f["closed_to"]], pa.int32()), *(pa.array([f[c]], pa.list_(pa.int64())) for c in ("started", "ended"))], ["part", "seq", "chain", "closed_to", "started", "ended"])

    found = {(r["part"], r["seq"]): r for r in staged.mapInArrow(count, "part int, seq int, chain int, closed_to int, started array<long>, ended array<long>").collect()}
    carried, after, have = {}, {}, [0]
    for k in keys:
        f = found[k]
        carried[k] = have[: f["chain"] + 1]
        have = [carried[k][d] + f["started"][d] if d <= f["closed_to"] else n for d, n in enumerate(f["ended"])]
    later = None  # the next chunk's chain: children in it and behind it, by depth
    for k in reversed(keys):
        f = found[k]
        after[k] = [later[d] if later and d < len(later) else 0 for d in range(len(f["ended"]))]
        later = [n + (after[k][d] if d <= f["closed_to"] else 0) for d, n in enumerate(f["started"])]
    return {k: Edge(before[k], carried[k], after[k]) for k in keys}


def _walked(staged: DataFrame, found: dict[tuple[int, int], Edge]):
    """Of each chunk its key and its nodes' columns, for use in a task."""
    held, first = staged.sparkSession.sparkContext.broadcast(found), min(found, default=None)

    def run(batches):
        for r in _rows(batches):
            key = (r["part"], r["seq"])
            yield key, Chunk(r, held.value[key].path).nodes(held.value[key], key == first)

    return run


def _sent(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def nodes(staged: DataFrame) -> DataFrame:
    """(depth, rank, parent_rank, index, pbits, above, terminal, c, sibling, siblings, before, gap) as tree.children has them.

    What the root doesn't have is null.
    """
    walked = _walked(staged, edges(staged))
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    inner_only = ("index", "above", "sibling", "siblings", "before", "gap")

    def run(batches):
        for _, v in walked(batches):
            root = v["depth"] == 0
            yield from _sent([pa.array(v[c], kinds[k], mask=root if c in inner_only else None) for c, k in _NODE.items()], list(_NODE))

    return staged.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in _NODE.items()))


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit lengths of whole numbers below 2**53."""
    return np.frexp(np.maximum(v, 0).astype(np.float64))[1].astype(np.int64)


def _events(v: dict[str, np.ndarray], first_most: int, count_most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, symbol, width) of a chunk's symbols: of a node its gap (4), its count (1), the count's tail (2), its flag (3)."""
    c, inner, length = v["c"], v["depth"] > 0, _bits(v["gap"])
    none = np.zeros(len(c), np.int64)
    shown = np.c_[inner, np.ones(len(c), bool), c >= first_most, (c > 0) & inner]
    symbols = np.c_[length, np.minimum(c, first_most), np.minimum(c, count_most), v["terminal"].astype(np.int64)]
    widths = np.c_[length - 1, np.where(c >= count_most, 2 * _bits(c - count_most + 1) - 1, 0), none, none]
    return np.broadcast_to(np.array([4, 1, 2, 3], np.int32), shown.shape)[shown], symbols[shown], widths[shown]


def stream(staged: DataFrame, first_most: int = FIRST_MOST, count_most: int = COUNT_MOST) -> DataFrame:
    """(position, cls, sym, raw_at, raw_width): the tree's symbols in pre-order, and where the raw bits of each stand."""
    walked = _walked(staged, edges(staged))

    def sums(batches):
        for key, v in walked(batches):
            _, symbols, widths = _events(v, first_most, count_most)
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in key), *(pa.array([int(x)], pa.int64()) for x in (len(symbols), widths.sum()))], ["part", "seq", "n", "bits"])

    begins, n, bits = {}, 0, 0
    for r in sorted(staged.mapInArrow(sums, "part int, seq int, n long, bits long").collect()):  # a row a chunk
        begins[r["part"], r["seq"]] = n, bits
        n, bits = n + r["n"], bits + r["bits"]
    held = staged.sparkSession.sparkContext.broadcast(begins)

    def run(batches):
        for key, v in walked(batches):
            (at, raw), (cls, symbols, widths) = held.value[key], _events(v, first_most, count_most)
            yield from _sent([pa.array(x) for x in (at + np.arange(len(cls)), cls, symbols, raw + np.cumsum(widths) - widths, widths)], ["position", "cls", "sym", "raw_at", "raw_width"])

    return staged.mapInArrow(run, "position long, cls int, sym long, raw_at long, raw_width long")
