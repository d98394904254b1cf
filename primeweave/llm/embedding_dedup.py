"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by a permutation prefix: its NEAREST nearest reference points, in order. Its first one is its home.
Inverted lists hold, for each label and pivot, the vectors that have the pivot in their prefix, at home or as guests. Of two
linked vectors each has the other's home in its prefix, so candidates share their home, or share two pivots that are both
their homes; only they are verified, by their cosine in double precision. A pair of two homes is looked for in the list of the
lesser one alone, where one vector is at home and the other a guest; two guests never meet.

Pivots are drawn from a bounded sample, about PIVOTS times the square root of the rows, PIVOT_BYTES at most, and no two are
nearer than APART: a dense group has one pivot or a few, which all of its vectors have for a home, and not a share of pivots
among which the nearest ones are chance. Its list is then as long as the group.

From its prefix a vector leaves out pivots that no vector linked with it can have as home: if x has home p and y has home q,
x.p >= x.q, and |x - y| <= CHORD, then y.(q - p) <= CHORD |q - p|. This loses no pair: a vector whose prefix isn't cut off at
NEAREST has the homes of all its partners. All rows are indexed. Recall is 1.0 but for vectors with more than NEAREST pivots
about equally near (tests hold it to 0.95).

Equal vectors of a label are one node with a count, so copies are never paired with each other; nodes have numbers of their own,
whatever their ids. A list is cut in blocks of BLOCK vectors, and pairs of blocks are compared one at a time, so memory is
bounded whatever a list's length; each pair of blocks gives, for each vector, the number of its links and a partner, not the
pairs. The partners, a star within each connected part of a block pair, are enough for the components.

Null labels, and vectors that are null, zero or hold null or non-finite values link with nothing (kept, n_links 0); vectors of
different lengths don't link. An empty table gives no rows. Rows may repeat: repeated ids count as vectors of their own. Rows
of null id get a null component. Vectors are told apart by their values, rows find their vector again by 96 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from primeweave.llm.shared import Stages, components, replayable, small

THRESHOLD = 0.98
NEAREST = 8
#: Greatest cosine of two pivots, and distance of two linked unit vectors.
APART, CHORD = 0.9, (2 - 2 * THRESHOLD) ** 0.5 + 1e-9
PIVOTS, PIVOTS_LEAST, PIVOT_BYTES = 4, 64, 64 << 20
BLOCK = 1024
#: Copies of a vector beyond which its rows find it by a broadcast.
HOT = 10_000


def _values(vec_col: str) -> Column:
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    return F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x))  # no -0.0


def _rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), _values(vec_col).alias("v"))


def _able() -> Column:
    return F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, zeros behind short ones; scaling by the greatest value first keeps squares finite."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def prefixes(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector its nearest pivots in order, home first; -1 for those that can't be a partner's home, and at the end."""
    nearest = min(NEAREST, len(pivots))
    dots = units @ pivots.T
    near = np.argpartition(-dots, nearest - 1, axis=1)[:, :nearest] if nearest < len(pivots) else np.tile(np.arange(len(pivots)), (len(units), 1))
    own = np.take_along_axis(dots, near, 1)
    order = np.lexsort((near, -own), axis=1)
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    gap = np.sqrt(((pivots[near] - pivots[near[:, 0]][:, None, :]) ** 2).sum(2))
    near = np.where(own[:, :1] - own <= CHORD * gap, near, -1)
    return np.concatenate([near, np.full((len(near), NEAREST - nearest), -1)], 1) if nearest < NEAREST else near


def _indexed(shared, dim: int):
    """Postings: at home, and as a guest in the lists of lesser pivots."""

    def run(batches):
        pivots = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _units(part.column("v"), dim)
                near = prefixes(x, pivots)
                there = (near >= 0) & (near <= near[:, :1])
                of = pa.array(np.nonzero(there)[0])
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                desc = pa.array([r.astype("<i4").tobytes() for r in near], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("label").take(of), part.column("dim").take(of), pa.array(near[there].astype(np.int32)), pa.array(np.nonzero(there)[1] > 0), part.column("node").take(of), part.column("n").take(of), raw.take(of), desc.take(of)], ["label", "dim", "pivot", "guest", "node", "n", "u", "near"])

    return run


def shared_homes(near_x: np.ndarray, near_y: np.ndarray) -> np.ndarray:
    """Which pairs of x and y are candidates: both homes are in both prefixes, counted as one or two shared pivots."""

    def has(prefix: np.ndarray, homes: np.ndarray) -> np.ndarray:
        home, at = np.unique(homes, return_inverse=True)
        out = np.zeros((len(prefix), len(home)), bool)
        for k in range(prefix.shape[1]):
            slot = np.minimum(np.searchsorted(home, prefix[:, k]), len(home) - 1)
            hit = np.flatnonzero(home[slot] == prefix[:, k])
            out[hit, slot[hit]] = True
        return out[:, at]

    x, y = near_x[:, 0], near_y[:, 0]
    same = x[:, None] == y[None, :]
    count = has(near_x, y).astype(np.int8) + has(near_y, x).T
    return np.where(same, count >= 1, count == 2)


def _verified(u: np.ndarray, v: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted pairs whose cosine is THRESHOLD or more."""
    r, c = np.nonzero(wanted)
    if len(r) * 8 > wanted.size:  # dense: one product
        dots = (u @ v.T)[r, c]
        edge = np.flatnonzero(np.abs(dots - THRESHOLD) < 1e-12)  # beyond, the product's order of sums doesn't matter
        dots[edge] = np.einsum("ij,ij->i", u[r[edge]], v[c[edge]])
    else:
        dots = np.concatenate([np.einsum("ij,ij->i", u[r[a : a + 50_000]], v[c[a : a + 50_000]]) for a in range(0, len(r), 50_000)]) if len(r) else np.zeros(0)
    keep = dots >= THRESHOLD
    return r[keep], c[keep]


def _linked(dim: int):
    """For one pair of blocks of a list: per node the number of linked vectors and one partner that joins its part."""

    def run(key, table):
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        table, side = table.take(pa.array(order)), side[order]
        u = np.frombuffer(b"".join(table.column("u").to_pylist()), np.float64).reshape(-1, dim)
        near = np.frombuffer(b"".join(table.column("near").to_pylist()), "<i4").reshape(len(u), -1)
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        if side[0] == side[-1]:
            wanted = np.triu(shared_homes(near, near), 1) if side[0] == 2 else np.zeros((len(u), 0), bool)
            r, c = _verified(u, u, wanted) if wanted.size else (np.zeros(0, np.int64),) * 2
        else:
            cut = int(np.searchsorted(side, side[0], "right"))
            r, c = _verified(u[:cut], u[cut:], shared_homes(near[:cut], near[cut:]))
            c = c + cut
        links = np.zeros(len(u), np.int64)
        np.add.at(links, r, n[c])
        np.add.at(links, c, n[r])
        root = np.arange(len(u))
        while True:  # least row of each part
            low = np.minimum(root[r], root[c])
            new = root.copy()
            np.minimum.at(new, root[r], low)
            np.minimum.at(new, root[c], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[at], pa.int64()), "links": pa.array(links[at]), "partner": pa.array(node[root[at]], pa.int64())})

    return run


def _apart(units: np.ndarray, most: int) -> np.ndarray:
    """The first vectors, most of them at most, of which no two have a cosine beyond APART."""
    out = units[:0]
    for at in range(0, len(units), 256):
        part = units[at : at + 256]
        part = part[(part @ out.T <= APART).all(1)]
        near, free = part @ part.T > APART, np.ones(len(part), bool)
        for k in range(len(part)):
            if free[k]:
                free[k + 1 :] &= ~near[k, k + 1 :]
        out = np.concatenate([out, part[free]])
        if len(out) >= most:
            break
    return out[:most]


def _pivots(nodes: DataFrame, rows: int, dim: int) -> np.ndarray:
    k = int(min(PIVOT_BYTES // (8 * dim), max(PIVOTS_LEAST, PIVOTS * rows**0.5)))
    lot = F.xxhash64("label", "v")
    share = min(1.0, 3 * k / max(rows, 1))
    drawn = nodes.where(F.pmod(lot, F.lit(1 << 30)) < int((1 << 30) * share)).orderBy(lot, "node").limit(2 * k).select("v").collect()  # PIVOT_BYTES, twice
    drawn = drawn or nodes.limit(1).select("v").collect()
    return _apart(_units(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())), dim), k) if drawn else np.zeros((0, dim))


def _blocks(lists: DataFrame) -> DataFrame:
    """Postings, once for each pair of blocks (lo, hi): homes against homes (side 0 and 1, or 2 within a block) and against guests."""
    key = ["label", "dim", "pivot"]
    size = lambda guest: F.ceil(F.count(F.when(F.col("guest") == F.lit(guest), 1)) / F.lit(BLOCK)).cast("int")
    count = lists.groupBy(*key).agg(size(False).alias("homes"), size(True).alias("guests")).where("homes > 0")
    dealt = lists.join(count, key)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("guest"), -1 - own).otherwise(own))  # guests' blocks are below 0
    others = F.when(F.col("guest"), F.sequence(F.lit(0), F.col("homes") - 1)).otherwise(F.sequence(-F.col("guests"), F.col("homes") - 1))
    dealt = dealt.withColumn("other", F.explode(others))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return dealt.select(*key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "node", "n", "u", "near")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row; ids are anything that has an order."""
    spark = vectors.sparkSession
    stages = Stages(spark)
    rows = _rows(replayable(stages, vectors), id_col, vec_col, label_col)
    nodes = rows.where(_able()).groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    nodes = stages.put(nodes.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    size = nodes.agg(F.max("dim").alias("dim"), F.count("*").alias("rows")).first()
    dim = size["dim"] or 1
    pivots = spark.sparkContext.broadcast(_pivots(nodes, size["rows"], dim))
    label_type = dict(nodes.dtypes)["label"]
    lists = nodes.select("label", "dim", "node", "n", "v").mapInArrow(_indexed(pivots, dim), f"label {label_type}, dim int, pivot int, guest boolean, node long, n long, u binary, near binary")
    lists = stages.put(lists, "lists")
    found = _blocks(lists).groupBy("label", "dim", "pivot", "lo", "hi").applyInArrow(_linked(dim), "node long, links long, partner long")
    found = stages.put(found, "found")
    stages.drop(lists)
    comp = stages.put(components(stages, found.select(F.col("node").alias("a"), F.col("partner").alias("b"))), "components")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = [F.xxhash64("dim", "v").alias("h1"), F.hash("v").alias("h2")]
    own = nodes.select("label", *of, "node", "first", "n").join(total, "node", "left").join(comp.withColumnRenamed("id", "node"), "node", "left")
    own = own.withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("first").alias("least"))
    own = own.join(least, "component").select("label", "h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "least")
    own = stages.put(own, "own")
    keys = rows.withColumn("dim", F.size("v")).select("id", F.when(_able(), F.col("label")).alias("label"), *of)
    hot = small(own.where(F.col("n") > HOT), stages, "hot")
    keyed = stages.put(keys.join(hot, ["label", "h1", "h2"], "left"), "keyed")  # copies of a hot vector never meet in a task
    rest = keyed.where("n is null").drop("n", "links", "least").join(own.where(F.col("n") <= HOT), ["label", "h1", "h2"], "left")
    stages.only(own, keyed)
    out = keyed.where("n is not null").select("id", "links", "least").union(rest.select("id", "links", "least"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
