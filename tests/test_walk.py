"""The pre-order walk against the relational tree, at sizes at which every few paths are a chunk."""

import random

import pytest
from pyspark.sql import functions as F

from primeweave.operators import tree, walk
from primeweave.stages import Stages

SETS = [sorted(random.Random(k).sample(range(1, 14), 1 + k % 6)) for k in range(160)] + [list(range(3, 30)), list(range(3, 31)), [1], [13]]
SETS = sorted({tuple(s) for s in SETS})


@pytest.fixture(scope="module")
def sets(spark):
    return spark.createDataFrame([(k, list(s)) for k, s in enumerate(SETS)], "id long, path array<long>").persist()


@pytest.fixture(params=[1, 7, 200_000])
def chunked(request, spark, sets, monkeypatch):
    monkeypatch.setattr(walk, "ITEMS", request.param)
    monkeypatch.setattr(walk, "CHUNKS", 10**6)
    order = tree.item_order(tree.item_counts(sets).persist()).persist()
    stages = Stages(spark)
    yield order, tree.ranked_paths(sets, order), walk.chunks(stages, tree.ranked_paths(sets, order, "id"))
    stages.drop()


def test_nodes_are_those_of_the_relation(chunked):
    _, ranks, staged = chunked
    want = tree.children(tree.nodes(ranks)).select(*walk._NODE)
    got = walk.nodes(staged)
    plain = lambda df: sorted((tuple(r) for r in df.withColumn("above", F.when(F.col("depth") > 0, F.col("above"))).collect()), key=str)
    assert plain(got) == plain(want)
    assert staged.count() > 1 or walk.ITEMS > 1000


def test_stream_is_that_of_a_walk(chunked):
    _, ranks, staged = chunked
    root: dict = {}
    ends = set()
    for r in ranks.select("ranks").collect():
        node = root
        for k in r.ranks:
            node = node.setdefault(k, {})
        ends.add(tuple(r.ranks))
    events = []

    def visit(node, path, gap):
        c = len(node)
        if path:
            events.append((4, gap.bit_length(), gap.bit_length() - 1))
        events.append((1, min(c, 2), 2 * (c - 3).bit_length() - 1 if c >= 4 else 0))
        if c >= 2:
            events.append((2, min(c, 4), 0))
        if c and path:
            events.append((3, int(path in ends), 0))
        before = path[-1] if path else 0
        for k in sorted(node):
            visit(node[k], (*path, k), k - before)
            before = k

    visit(root, (), 0)
    want, at = [], 0
    for k, (cls, sym, width) in enumerate(events):
        want.append((k, cls, sym, at, width))
        at += width
    assert sorted(map(tuple, walk.stream(staged, 2, 4).collect())) == want


def test_no_paths(spark):
    stages = Stages(spark)
    staged = walk.chunks(stages, spark.createDataFrame([], "ranks array<long>, items array<long>, indexes array<long>"))
    assert not walk.nodes(staged).count() and not walk.stream(staged).count()
    stages.drop()
