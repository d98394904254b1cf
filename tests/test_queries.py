"""Every query with an oracle is compared with DuckDB; the others must give rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from primeweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(x) for x in frame.where(frame.notna(), None).values.tolist()), key=lambda r: [(v is None, str(v)) for v in r])


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return abs(a - b) <= 1e-6 * max(1, abs(b))
    return a == b or str(a) == str(b)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    g, w = rows(got), rows(want)
    assert len(g) == len(w)
    assert all(same(x, y) for p, q in zip(g, w, strict=True) for x, y in zip(p, q, strict=True))


def test_entry(spark):
    assert {r.n for r in entry.entry(spark).collect()} == {561, 1105}


def test_ranges_agree_with_one_window(spark, monkeypatch):
    from pyspark.sql import functions as F

    from primeweave.operators import lists

    monkeypatch.setattr(lists, "ROWS_A_RANGE", 50)
    v = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("v"))
    want = sorted(r.v for r in v.collect())
    assert {r.v: r["rank"] for r in lists.ranked(v, "v").collect()} == {x: k for k, x in enumerate(want)}
    prev = {r.v: r.previous for r in lists.with_previous(v, "v").collect()}
    assert prev == {x: want[k - 1] if k else None for k, x in enumerate(want)}
    asked = spark.createDataFrame([(x,) for x in (-5, 0, want[3], want[3] + 1, 10**6)], "q long")
    for r in lists.lookup(v, "v", asked, "q").collect():
        below = [x for x in want if x <= r.q]
        above = [x for x in want if x >= r.q]
        assert (r.is_member, r.predecessor, r.successor, r["rank"]) == (r.q in want, below[-1] if below else None, above[0] if above else None, len(below))


def test_certify(spark):
    from primeweave.operators import compare

    a, b = spark.range(50).toDF("v"), spark.range(1, 51).toDF("v")
    assert (compare.certify(a, a, "v"), compare.certify(a, b, "v")) == (compare.CERTIFIED, compare.FAILED)
