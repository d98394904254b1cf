import math
from collections import Counter

from pyspark.sql import functions as F

from primeweave.functions.primes import carmichael_below
from primeweave.operators import search
from primeweave.operators.lists import ranked


def test_objective_falls_and_choices_stay_valid(spark):
    table = carmichael_below(3 * 10**7)
    records = spark.createDataFrame([(n, f) for n, f in table], "n long, ps array<long>")
    rows, objectives = search.search(records, sweeps=2)
    got = {r.n: [p for k, p in enumerate(r.ps) if r.mask >> k & 1] for r in rows.select("n", "ps", "mask").collect()}
    assert set(got) == {n for n, _ in table}
    for n, path in got.items():
        d, lam = math.prod(path), math.lcm(*(p - 1 for p in path))
        assert n % d == 0 and lam > n // d and d * pow(d, -1, lam) == n
    assert all(b < a for a, b in zip(objectives, objectives[1:], strict=False))
    assert rows.where(F.col("mask") <= 0).count() == 0


def price(ranks, own, share):
    """A candidate's price, by loops."""
    total, before = 0.0, 0
    for k, r in enumerate(ranks):
        node = tuple(ranks[: k + 1])
        others = share.get(node, 0) - (node in own)
        total += (2 * (r - before).bit_length() + 2) / (others + 1) + math.log2(1 + 1 / (others + 1))
        before = r
    return total


def test_a_sweep_against_brute_force(spark):
    records = spark.createDataFrame(carmichael_below(10**7), "n long, ps array<long>")
    rows = search.start(search.candidates(records)).checkpoint()
    now = {r.n: r for r in rows.collect()}
    subset = lambda r, m: [p for k, p in enumerate(r.ps) if m >> k & 1]
    paths = {tuple(subset(r, r.mask)) for r in now.values()}
    counts = Counter(p for path in paths for p in path)
    rank = {p: k + 1 for k, p in enumerate(sorted(counts, key=lambda p: (-counts[p], -p)))}
    share = Counter(tuple(x[: k + 1]) for x in (sorted(rank[p] for p in path) for path in paths) for k in range(len(x)))
    got = {r.n: r.mask for r in search.sweep(rows).collect()}
    assert got.keys() == now.keys()
    moved = 0
    for n, r in now.items():
        ranks = lambda m, r=r: sorted(rank.get(p, len(rank) + 1) for p in subset(r, m))
        own = {tuple(ranks(r.mask)[: k + 1]) for k in range(len(ranks(r.mask)))}
        cost = {m: price(ranks(m), own, share) for m in r.masks}
        assert abs(cost[got[n]] - min(cost.values())) < 1e-6 or got[n] == r.mask and cost[r.mask] - min(cost.values()) < 1e-6
        moved += got[n] != r.mask
    assert moved


def test_resuming(spark):
    records = spark.createDataFrame(carmichael_below(10**6), "n long, ps array<long>")
    rows, first = search.search(records, sweeps=1)
    masks = ranked(rows.select("n", "mask"), "n").select("rank", "mask")
    again, objectives = search.search(records, sweeps=0, masks=masks)
    assert {(r.n, r.mask) for r in again.collect()} == {(r.n, r.mask) for r in rows.collect()}
    assert abs(objectives[0] - first[-1]) < 1e-6
