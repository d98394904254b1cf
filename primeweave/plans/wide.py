"""Queries over integers beyond 64 bits: DECIMAL(38,0) columns, exact integers in Arrow functions, text in the results.

Records are the products (6k+1)(12k+1)(18k+1) of three primes each, k an order key times STEP: all are Carmichael numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave.functions import arith, primes
from primeweave.operators import divisors
from primeweave.plans.registry import query, table

STEP = 7
#: Three primes, so that products pass 2**63.
P, Q, R = 1000003, 998244353, 1000000007

PAIR_SQL = f"with p as (select distinct (l_partkey + 1)::hugeint * {R} * {Q} as a, (l_suppkey + 2)::hugeint * {R} * {P} as b, (l_partkey + 1)::hugeint as s from lineitem)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.col(c).cast(arith.WIDE) for c in ("l_partkey", "l_suppkey"))
    wide = lambda c: c.cast(arith.WIDE)
    big = lambda n: F.lit(str(n)).cast(arith.WIDE)
    return table(spark, d, "lineitem").select(wide((a + 1) * big(R * Q)).alias("a"), wide((b + 2) * big(R * P)).alias("b"), wide(a + 1).alias("s")).distinct()


def _text(*columns: str) -> list:
    return [F.col(c).cast("string").alias(c) for c in columns]


@query("wide_gcd_lcm", PAIR_SQL + " select a::varchar as a, b::varchar as b, gcd(a, b)::varchar as gcd, (a // gcd(a, b) * b)::varchar as lcm from p")
def _(spark, d):
    return _pairs(spark, d).withColumns({"gcd": arith.gcd_wide("a", "b"), "lcm": arith.lcm_wide("a", "b")}).select(*_text("a", "b", "gcd", "lcm"))


@query("wide_inverse", PAIR_SQL + " select s::varchar as s, b::varchar as b, case when gcd(s, b) = 1 then '1' end as product, case when gcd(s, b) = 1 then true end as reduced from p")
def _(spark, d):
    """s times its inverse is 1 modulo b, and the inverse lies in [0, b): there is but one such number."""
    rows = _pairs(spark, d).withColumn("i", arith.inverse_wide("s", "b"))
    return rows.select(*_text("s", "b"), ((F.col("s") * F.col("i")) % F.col("b")).cast(arith.WIDE).cast("string").alias("product"), F.col("i").between(0, F.col("b") - 1).alias("reduced"))


@query("wide_powmod", PAIR_SQL + " select a::varchar as a, b::varchar as b, list_reduce(list_transform(range(0, (s % 23 + 2)::bigint), lambda x: a % (b // 1000003)), lambda x, y: (x * y) % (b // 1000003))::varchar as power from p")
def _(spark, d):
    m = arith.floor_div(F.col("b"), F.lit(P).cast(arith.WIDE))
    return _pairs(spark, d).withColumn("power", arith.powmod("a", F.col("s") % 23 + 2, m)).select(*_text("a", "b", "power"))


#: Triples of which all three are primes, by trial division; their subsets with d and lam.
RECORD_SQL = f"""with ks as (select distinct o_orderkey::hugeint * {STEP} as k from orders where o_orderkey > 0), lim as (select sqrt(max(k) * 18 + 1)::bigint + 1 as m from ks),
 r as (select unnest(range(2, m + 1)) as i from lim), comp as (select distinct unnest(range(i * i, m + 1, i)) as c from r, lim where i * i <= m), pr as (select i as p from r where i not in (select c from comp)),
 cand as (select k, unnest([6 * k + 1, 12 * k + 1, 18 * k + 1])::bigint as x from ks), bad as (select distinct k from cand, pr where p * p <= x and x % p = 0),
 rec as (select k, 6 * k + 1 as p, 12 * k + 1 as q, 18 * k + 1 as r, (6 * k + 1) * (12 * k + 1) * (18 * k + 1) as n from ks where k not in (select k from bad))"""
SUBSET_SQL = RECORD_SQL + """, sd as (select n, unnest([[p], [q], [r], [p, q], [p, r], [q, r], [p, q, r]]) as s from rec),
 sl as (select n, s, list_reduce(s, lambda a, b: a * b) as d, list_reduce(list_transform(s, lambda x: x - 1), lambda a, b: a // gcd(a, b) * b) as lam from sd),
 dm as (select n, min(d) as d, arg_min(lam, d) as lam, arg_min(s, d) as s from sl where lam > n // d group by n)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """(n, factors) of the triples that are proven primes."""
    k = table(spark, d, "orders").where("o_orderkey > 0").select((F.col("o_orderkey") * STEP).alias("k")).distinct()
    small = F.array(*(F.lit(int(p)) for p in primes.small_primes(100)))
    thinned = k.select(F.array(6 * F.col("k") + 1, 12 * F.col("k") + 1, 18 * F.col("k") + 1).alias("factors")).where(F.forall("factors", lambda x: F.forall(small, lambda p: (x % p != 0) | (x == p))))
    proven = thinned.withColumns({f"_{i}": primes.proven_prime(F.col("factors")[i]) for i in range(3)}).where("_0 and _1 and _2")
    return proven.select(arith.product(F.col("factors")).alias("n"), "factors")


def _path(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query("wide_records", RECORD_SQL + " select n::varchar as n, concat_ws(' ', p, q, r) as factors from rec")
def _(spark, d):
    return records(spark, d).select(F.col("n").cast("string").alias("n"), _path("factors").alias("factors"))


@query("wide_validate", RECORD_SQL + " select n::varchar as n, concat_ws(',', case when n >= 1000000000000000000000000::hugeint then 'range' end, case when p >= 100000000 then 'first_factor' end) as faults from rec")
def _(spark, d):
    return records(spark, d).select(F.col("n").cast("string").alias("n"), F.array_join(divisors.record_faults(F.col("n"), F.col("factors")), ",").alias("faults"))


@query("wide_dmin", SUBSET_SQL + " select n::varchar as n, d::varchar as d, lam::varchar as lam from dm")
def _(spark, d):
    rows = records(spark, d).withColumn("c", divisors.choose_dmin_wide("n", "factors"))
    return rows.select("n", "c.d", "c.lam").select(*_text("n", "d", "lam"))


@query("wide_lambda", SUBSET_SQL + " select n::varchar as n, lam::varchar as lam from sl where d = n")
def _(spark, d):
    return records(spark, d).select(F.col("n").cast("string").alias("n"), arith.lambda_wide("factors").cast("string").alias("lam"))


@query("wide_path_value", SUBSET_SQL + " select n::varchar as n, array_to_string(s, ' ') as path, n::varchar as value from dm")
def _(spark, d):
    """The path of the least valid divisor stands for n again."""
    rows = records(spark, d).withColumn("c", divisors.choose_dmin_wide("n", "factors"))
    paths = rows.select("n", F.filter("factors", lambda p: F.col("c.d") % p == 0).alias("path"))
    return paths.select(F.col("n").cast("string").alias("n"), _path("path").alias("path"), arith.path_values("path").cast("string").alias("value"))


BUCKET_SQL = SUBSET_SQL + ", b as (select n, d, lam, d >= 1000000000000 as i, row_number() over (partition by n order by d >= 1000000000000 desc, d * lam desc, d desc) as o from sl where d <= 10000000000000000)"


@query("wide_bucket", BUCKET_SQL + " select n::varchar as n, d::varchar as d, lam::varchar as lam, case when i then 0 else 1 end as tier from b where o = 1")
def _(spark, d):
    rows = records(spark, d).withColumn("c", divisors.choose_bucket_wide(F.col("factors"), 10**12, 10**16)).where("c.d is not null")
    return rows.select("n", "c.d", "c.lam", "c.tier").select(*_text("n", "d", "lam"), "tier")


@query("wide_splitter", RECORD_SQL + " select n::varchar as n, concat_ws(' ', p, q, r) as primes from rec")
def _(spark, d):
    return records(spark, d).select(F.col("n").cast("string").alias("n"), F.array_join(primes.split_primes("n"), " ").alias("primes"))


@query("factor_tallies", SUBSET_SQL + " select 'n' as mode, count(*) as records, count(*) as right_ones, 0::bigint as fallbacks from dm union all select 'dmin', count(*), count(*), 0 from dm union all select 'cofactor', count(*), count(*), 0 from dm where d < n")
def _(spark, d):
    """n, its least valid divisor and the cofactor, each factored by powers with exponent n - 1 and held against the known primes."""
    rows = records(spark, d).withColumn("c", divisors.choose_dmin_wide("n", "factors")).select("n", "factors", F.col("c.d").alias("d"))
    own = F.filter("factors", lambda p: F.col("d") % p == 0)
    whole, part = rows.select(F.lit("n").alias("mode"), "n", F.col("n").alias("x"), "factors"), rows.select(F.lit("dmin").alias("mode"), "n", F.col("d").alias("x"), own.alias("factors"))
    rest = rows.where("d < n").select(F.lit("cofactor").alias("mode"), "n", arith.floor_div(F.col("n"), F.col("d")).alias("x"), F.array_except("factors", own).alias("factors"))
    done = whole.union(part).union(rest).withColumn("r", primes.algorithm1("x", "n"))
    right = F.array_join("r.primes", " ") == _path("factors")
    return done.groupBy("mode").agg(F.count("*").alias("records"), F.count(F.when(right, 1)).alias("right_ones"), F.count(F.when(F.col("r.fallback"), 1)).alias("fallbacks"))
