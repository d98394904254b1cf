"""Choosing one valid divisor a row so that the tree of the chosen divisors' primes costs least.

A sweep rebuilds the tree's item order and its count of nodes from the current choice, prices every valid divisor of every row
under that frozen state (candidates' prefixes are joined with the tree's nodes), and moves rows to a divisor that is
cheaper by more than EPSILON, ties to the smaller mask. The price of a path is, node by node, the gap's length and the bits of a
share: a node that other rows use too costs its part only. A sweep that doesn't lower the exact objective is undone and ends the
search, so the objective falls monotonically, and every choice stays valid.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeweave.functions import arith
from primeweave.operators import divisors, lists, tree
from primeweave.operators.lists import ranked

EPSILON = 1e-9


def candidates(records: DataFrame) -> DataFrame:
    """(n, ps, masks): for records(n, ps), the masks of all valid divisors."""
    s = divisors.subsets(F.col("ps"))
    valid = F.filter(s, lambda x: x.lam > arith.quotient(F.col("n"), x.d))
    return records.select("n", "ps", F.transform(valid, lambda x: x.mask).alias("masks"))


def start(rows: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """(n, ps, masks, mask): the least valid divisor of each; or, to resume, the mask of the same rank in (rank, mask)."""
    if masks is not None:
        found = ranked(rows, "n").join(masks.select("rank", "mask"), "rank").drop("rank")
        return found.where(F.assert_true(F.array_contains("masks", F.col("mask")), "a mask stands for no valid divisor").isNull())
    d = lambda m: F.aggregate(divisors.subset_of(F.col("ps"), m), F.lit(1).cast("long"), lambda a, p: a * p)
    best = F.array_min(F.transform("masks", lambda m: F.struct(d(m).alias("d"), m.alias("mask"))))
    return rows.withColumn("mask", best.mask).where("mask is not null")


def chosen(rows: DataFrame) -> DataFrame:
    return rows.select(divisors.subset_of(F.col("ps"), F.col("mask")).alias("path")).distinct()


@contextlib.contextmanager
def _tree(rows: DataFrame):
    """The chosen paths' order and ranked paths, kept while in use."""
    paths = chosen(rows).persist()
    counts = tree.item_counts(paths).persist()
    order = tree.item_order(counts).persist()
    try:
        yield order, tree.ranked_paths(paths, order)
    finally:
        for kept in (order, counts, paths):
            kept.unpersist()


def objective(rows: DataFrame) -> float:
    """Bits of the tree of the chosen paths under context set 2: entropies of its symbols, raw bits, stored models, class sizes."""
    with _tree(rows) as (order, ranks):
        nodes = tree.children(tree.nodes(ranks, prefixes=False)).persist()
        counts = tree.histogram(tree.set2_symbols(nodes, order), "cls", "key").persist()
        e = lists.entropy(counts, "cls", "key").agg(F.sum("entropy_bits")).first()[0]
        models = tree.class_costs(tree.quantized(counts, "cls", "key")).agg(F.sum("table_bytes")).first()[0]
        raw = tree.raw_bits(nodes).first()[0]
        classes = order.select("class_id", "class_size").distinct().agg(F.sum(arith.vbyte_length(F.col("class_size")))).first()[0]
        for kept in (counts, nodes):
            kept.unpersist()
    return float(e or 0) + float(raw or 0) + 8.0 * (models or 0) + 8.0 * (classes or 0)


def prices(rows: DataFrame, order: DataFrame, ranks: DataFrame) -> DataFrame:
    """(n, m, cost): each candidate's price in the tree, shared nodes parted among the paths that use them, without one's own path.

    Candidates' prefixes meet the tree's nodes in a join; primes that the tree doesn't hold rank behind all others.
    """
    last = F.lit(order.count() + 1).cast("long")
    used = tree.nodes(ranks, prefixes=False).where("depth > 0").select("node", "depth", "rank", "paths")
    own = rows.select("n", F.posexplode("ps").alias("i", "item")).join(order.select("item", "rank"), "item", "left")
    own = own.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("rank", last).alias("rank")))).alias("r"))
    pick = lambda mask: F.array_sort(F.transform(F.filter("r", lambda x: F.call_function("shiftright", mask, x.i).bitwiseAND(1) == 1), lambda x: x["rank"]))
    rows = rows.join(own, "n").withColumn("now", pick(F.col("mask")))
    rows = rows.withColumn("mine", F.transform(F.sequence(F.lit(1), F.size("now")), lambda k: F.xxhash64(F.slice("now", 1, k))))
    rows = rows.select("n", "mine", "r", F.explode("masks").alias("m")).withColumn("path", pick(F.col("m")))
    d = F.col("depth")
    steps = rows.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("path"))))
    steps = steps.select("n", "m", "mine", "depth", F.xxhash64(F.slice("path", 1, d)).alias("node"), F.get("path", d - 1).alias("rank"), F.coalesce(F.get("path", d - 2), F.lit(0)).alias("before"))
    steps = steps.join(used, ["node", "depth", "rank"], "left")
    others = F.coalesce("paths", F.lit(0)) - F.array_contains("mine", F.col("node")).cast("int")
    price = (2 * arith.bits(F.col("rank") - F.col("before")) + 2) / (others + 1) + F.log2(1 + 1 / (others + 1))
    return steps.groupBy("n", "m").agg(F.sum(price).alias("cost"))


def sweep(rows: DataFrame) -> DataFrame:
    """rows with masks moved to the cheapest candidate (within EPSILON the least mask) where that is cheaper under the current tree."""
    with _tree(rows) as (order, ranks):
        cost = prices(rows, order, ranks)
        now = rows.select("n", F.col("mask").alias("m"), F.lit(True).alias("current"))
        cost = cost.join(now, ["n", "m"], "left")
        best = cost.groupBy("n").agg(F.min(F.struct(F.round(F.col("cost") / EPSILON).alias("cost"), "m")).alias("best"), F.max(F.when(F.col("current"), F.round(F.col("cost") / EPSILON))).alias("held"))
        moved = rows.join(best, "n").withColumn("mask", F.when(F.col("best.cost") < F.col("held") - 1, F.col("best.m")).otherwise(F.col("mask")))
        return moved.select("n", "ps", "masks", "mask").checkpoint()


def search(records: DataFrame, sweeps: int | None = None, masks: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """(rows with their masks, objectives): the first is of the least valid divisors, or of the masks to resume from.

    Sweeps go on until one no longer lowers the objective, or for as many as are given; with 0 the choice is only looked up.
    """
    rows = start(candidates(records), masks).checkpoint()
    objectives = [objective(rows)]
    while sweeps is None or len(objectives) <= sweeps:
        moved = sweep(rows)
        cost = objective(moved)
        if cost >= objectives[-1] - EPSILON:
            break
        rows, objectives = moved, [*objectives, cost]
    return rows, objectives
