"""Queries over integers and their factorizations; the integers are the order keys above 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave.functions import arith, primes
from primeweave.operators import divisors, lists
from primeweave.plans.registry import query, table

#: Keys, primes up to the greatest by crossing out multiples, prime divisors with exponents, factor lists.
SIEVE_SQL = """with lim as (select greatest(max(o_orderkey), 4) as m from orders),
 r as (select unnest(range(2, m + 1)) as i from lim),
 comp as (select distinct unnest(range(i * i, m + 1, i)) as c from r, lim where i * i <= m),
 pr as (select i as p from r where i not in (select c from comp)),
 keys as (select distinct o_orderkey as n from orders where o_orderkey > 1),
 mult as (select p, unnest(range(p, m + 1, p)) as n from pr, lim),
 kp as (select n, p, (select max(e) from range(1, 40) t(e) where n % least(p ** e, n + 1)::bigint = 0)::int as e from mult join keys using (n)),
 kf as (select n, list(p order by p) as ps, list(e order by p) as es, max(e) as top, count(*) as k from kp group by n)"""
#: Squarefree odd keys with every subset of their primes: product d and lam.
SUBSET_SQL = SIEVE_SQL + """,
 sq as (select n, ps, k from kf where top = 1 and n % 2 = 1),
 su as (select n, ps, k, unnest(range(1, 1 << k)) as mask from sq),
 sp as (select n, ps, k, mask, list_filter(ps, lambda x, i: (mask >> (i - 1)) & 1 = 1) as s from su),
 sd as (select n, ps, k, mask, s, list_product(s)::bigint as d, list_reduce(list_transform(s, lambda x: x - 1), lambda a, b: lcm(a, b))::bigint as lam from sp),
 dm as (select n, min(d) as d, arg_min(lam, d) as lam, arg_min(s, d) as s, arg_min(mask, d)::int as mask, any_value(ps) as ps from sd where lam > n // d group by n)"""
TEXT = "array_to_string(list_transform(ps, lambda x, i: x || '^' || es[i]), ' ')"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey > 1").select(F.col("o_orderkey").alias("n")).distinct()


def most(df: DataFrame, col: str = "n") -> int:
    return max(int(df.agg(F.max(col)).first()[0] or 0), 4)


def factored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keys(spark, sf_dir)
    return primes.factor_columns(k, "n", most(k))


def squarefree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, ps): odd squarefree keys with their primes."""
    f = factored(spark, sf_dir).where("n % 2 = 1").where(F.forall("factors", lambda x: x.e == 1))
    return f.select("n", F.transform("factors", lambda x: x.p).alias("ps"))


def smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = divisors.choose_dmin("n", "ps")
    return squarefree(spark, sf_dir).withColumn("c", c).select("n", "ps", F.col("c.d").alias("d"), F.col("c.lam").alias("lam"))


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: F.concat_ws("^", x.p.cast("string"), x.e.cast("string"))), " ")


@query("factor_keys", SIEVE_SQL + f" select n, k as omega, list_sum(es)::bigint as big_omega, {TEXT} as factors from kf")
def _(spark, d):
    f = factored(spark, d)
    return f.select("n", F.size("factors").cast("long").alias("omega"), F.aggregate("factors", F.lit(0).cast("long"), lambda a, x: a + x.e).alias("big_omega"), _text("factors").alias("factors"))


KORSELT_SQL = SIEVE_SQL + ", cn as (select n, ps, k from kf where top = 1 and k >= 3 and n % 2 = 1 and len(list_filter(ps, lambda x: (n - 1) % (x - 1) <> 0)) = 0)"


@query("korselt_filter", KORSELT_SQL + " select n, k::int as k, array_to_string(ps, ' ') as factors from cn")
def _(spark, d):
    rows = divisors.korselt(factored(spark, d), "n", "factors")
    return rows.select("n", F.size("factors").alias("k"), F.array_join(F.transform("factors", lambda x: x.p.cast("string")), " ").alias("factors"))


@query("carmichael_census", KORSELT_SQL + " select k::int as k, count(*) as cnt, sum(n)::bigint as total from cn group by 1")
def _(spark, d):
    rows = divisors.korselt(factored(spark, d), "n", "factors")
    return rows.groupBy(F.size("factors").alias("k")).agg(F.count("*").alias("cnt"), F.sum("n").alias("total"))


@query("spf_table", SIEVE_SQL + " select n, ps[1] as spf, len(ps) = 1 and es[1] = 1 as is_prime from kf")
def _(spark, d):
    k = keys(spark, d)
    p = primes.spf(k, "n", most(k))
    return k.select("n", p.alias("spf"), (p == F.col("n")).alias("is_prime"))


@query("factored_range", SIEVE_SQL.replace("keys as (select distinct o_orderkey as n from orders where o_orderkey > 1)", "keys as (select i as n from r)") + f" select n, {TEXT} as factors from kf")
def _(spark, d):
    top = most(keys(spark, d))
    window = spark.range(2, top + 1).select(F.col("id").alias("n"))
    return primes.factor_columns(window, "n", top).select("n", _text("factors").alias("factors"))


@query("factor_limited", SIEVE_SQL + ", few as (select * from kp where p <= 47) select keys.n, coalesce(string_agg(p || '^' || e, ' ' order by p), '') as factors, (keys.n / coalesce(product(p ** e), 1))::bigint as cofactor from keys left join few on few.n = keys.n group by keys.n")
def _(spark, d):
    return primes.factor_limited(keys(spark, d), "n", 50).select("n", _text("factors").alias("factors"), "cofactor")


def _odd_primes(spark, top: int) -> DataFrame:
    return lists.ranked(primes.primes_between(spark, 3, top + 1), "p")


@query("prime_rank_select", SIEVE_SQL + " select p, row_number() over (order by p) - 1 as rank from pr where p > 2")
def _(spark, d):
    return _odd_primes(spark, most(keys(spark, d))).select("p", "rank")


@query("next_prime_lookup", SIEVE_SQL + ", op as (select p, row_number() over (order by p) as i from pr where p > 2) select n, a.p as next_prime, coalesce(b.i, 0)::bigint as primes_below from keys asof left join op a on n <= a.p asof left join op b on n > b.p")
def _(spark, d):
    k = keys(spark, d)
    found = lists.lookup(primes.primes_between(spark, 3, most(k) + 1), "p", k, "n")
    return found.select("n", F.col("successor").alias("next_prime"), (F.col("rank") - F.col("is_member").cast("int")).alias("primes_below"))


PAIR_SQL = "with p as (select distinct l_partkey + 1 as a, l_suppkey + 2 as b from lineitem)"


def _pairs(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") + 1).alias("a"), (F.col("l_suppkey") + 2).alias("b")).distinct()


@query("gcd_lcm", PAIR_SQL + " select a, b, gcd(a, b)::bigint as gcd, lcm(a, b)::bigint as lcm from p")
def _(spark, d):
    g = arith.gcd(F.col("a"), F.col("b"))
    return _pairs(spark, d).withColumn("gcd", g).withColumn("lcm", arith.quotient(F.col("a"), F.col("gcd")) * F.col("b"))


@query("inverse_mod", PAIR_SQL + " select a, b, case when gcd(a, b) = 1 then list_filter(range(0, b), lambda x: (a * x) % b = 1)[1] end as inverse from p")
def _(spark, d):
    return _pairs(spark, d).withColumn("inverse", arith.inverse("a", "b"))


@query("powmod", PAIR_SQL + " select a, b, list_reduce(list_transform(range(0, a % 29 + 2), lambda x: a % b), lambda x, y: (x * y) % b)::bigint as power from p")
def _(spark, d):
    return _pairs(spark, d).withColumn("power", arith.powmod("a", F.col("a") % 29 + 2, "b").cast("long"))


@query("carmichael_lambda", SIEVE_SQL + " select n, list_reduce(list_transform(ps, lambda x: x - 1), lambda a, b: lcm(a, b))::bigint as lam from kf")
def _(spark, d):
    return factored(spark, d).select("n", arith.carmichael_lambda(F.transform("factors", lambda x: x.p)).alias("lam"))


@query("dmin_divisor", SUBSET_SQL + " select n, d, lam from dm")
def _(spark, d):
    return smallest(spark, d).where("d is not null").select("n", "d", "lam")


@query("dmin_native", SUBSET_SQL + " select n, d, lam from dm")
def _(spark, d):
    rows = squarefree(spark, d).withColumn("c", divisors.choose_dmin_native(F.col("n"), F.col("ps")))
    return rows.where("c is not null").select("n", "c.d", "c.lam")


@query("dmin_rebuild", SUBSET_SQL + ", iv as (select n, d, lam, case when lam = 1 then 0 when gcd(d, lam) = 1 then list_filter(range(0, lam), lambda x: (d::hugeint * x) % lam = 1)[1] end as i from dm) select n, d, d * i as rebuilt, coalesce(d * i = n, false) as same from iv")
def _(spark, d):
    rows = smallest(spark, d).where("d is not null").withColumn("i", arith.inverse("d", "lam"))
    return rows.select("n", "d", (F.col("d") * F.col("i")).alias("rebuilt"), F.coalesce(F.col("d") * F.col("i") == F.col("n"), F.lit(False)).alias("same"))


@query("valid_divisors", SUBSET_SQL + " select n, count(*) as subsets, count(*) filter (lam > n // d) as valid from sd group by n")
def _(spark, d):
    rows = squarefree(spark, d).withColumn("s", divisors.subsets(F.col("ps")))
    valid = F.size(F.filter("s", lambda s: s.lam > arith.quotient(F.col("n"), s.d)))
    return rows.select("n", F.size("s").cast("long").alias("subsets"), valid.cast("long").alias("valid"))


@query("bucket_divisor", SUBSET_SQL + ", b as (select n, d, lam, row_number() over (partition by n order by d * lam desc, d desc) as o from sd where d <= 500) select n, d, lam from b where o = 1")
def _(spark, d):
    rows = squarefree(spark, d).withColumn("c", divisors.choose_bucket(F.col("ps"), 500))
    return rows.where("c is not null").select("n", "c.d", "c.lam")


@query("bucket_window_divisor", SUBSET_SQL + ", b as (select n, d, lam, d >= 50 as i, row_number() over (partition by n order by d >= 50 desc, d * lam desc, d desc) as o from sd where d <= 500) select n, d, lam, case when i then 0 else 1 end as tier from b where o = 1")
def _(spark, d):
    rows = squarefree(spark, d).withColumn("c", divisors.choose_bucket_window(F.col("ps"), 50, 500))
    return rows.where("c is not null").select("n", "c.d", "c.lam", "c.tier")


@query("bucket_index", SUBSET_SQL + """, b as (select n, d, lam, row_number() over (partition by n order by d * lam desc, d desc) as o from sd where d <= 500),
 rr as (select n, d, lam, case when lam = 1 then 0 else list_filter(range(0, lam), lambda x: (d * x) % lam = 1)[1] end as i from b where o = 1 and gcd(d, lam) = 1)
 select n, d, i as first, case when n // d >= i and (n // d - i) % lam = 0 then (n // d - i) // lam end as k from rr""")
def _(spark, d):
    rows = squarefree(spark, d).withColumn("c", divisors.choose_bucket(F.col("ps"), 500)).where("c is not null").select("n", "c.d", "c.lam")
    rows = rows.withColumn("first", arith.inverse("d", "lam")).where("first is not null").withColumn("m", arith.quotient(F.col("n"), F.col("d")))
    fits = (F.col("m") >= F.col("first")) & ((F.col("m") - F.col("first")) % F.col("lam") == 0)
    return rows.select("n", "d", "first", F.when(fits, arith.quotient(F.col("m") - F.col("first"), F.col("lam"))).alias("k"))


@query("cofactor_primes", SUBSET_SQL + " select n, d, n // d as cofactor, array_to_string(list_filter(ps, lambda x: not list_contains(s, x)), ' ') as primes from dm")
def _(spark, d):
    rows = smallest(spark, d).where("d is not null")
    rest = F.filter("ps", lambda p: F.col("d") % p != 0)
    return rows.select("n", "d", arith.quotient(F.col("n"), F.col("d")).alias("cofactor"), F.array_join(F.transform(rest, lambda p: p.cast("string")), " ").alias("primes"))


@query("divisor_path", SUBSET_SQL + " select n, d, array_to_string(s, ' ') as path from dm")
def _(spark, d):
    rows = smallest(spark, d).where("d is not null")
    return rows.select("n", "d", F.array_join(F.transform(divisors.divisor_path(F.col("ps"), F.col("d")), lambda p: p.cast("string")), " ").alias("path"))


@query("mask_subset", SUBSET_SQL + " select n, mask, array_to_string(s, ' ') as subset from dm")
def _(spark, d):
    rows = smallest(spark, d).where("d is not null").withColumn("mask", divisors.mask_of(F.col("ps"), F.col("d")))
    return rows.select("n", "mask", F.array_join(F.transform(divisors.subset_of(F.col("ps"), F.col("mask")), lambda p: p.cast("string")), " ").alias("subset"))


@query("korselt_descent", SIEVE_SQL + " select n, len(list_filter(ps, lambda x: len(list_filter(ps, lambda y: x % y = 1)) > 0)) = 0 as holds from kf where top = 1")
def _(spark, d):
    f = factored(spark, d).where(F.forall("factors", lambda x: x.e == 1))
    bad = F.exists("factors", lambda x: F.exists("factors", lambda y: x.p % y.p == 1))
    return f.select("n", (~bad).alias("holds"))


RECORD_SQL = SIEVE_SQL + ", rec as (select n, case when n % 13 = 0 then n + 1 else n end as told, ps from kf)"


@query("record_product", RECORD_SQL + " select n, list_product(ps)::bigint as product, list_product(ps)::bigint = told as matches from rec")
def _(spark, d):
    rows = _records(spark, d)
    p = arith.product(F.col("ps")).cast("long")
    return rows.select("n", p.alias("product"), (p == F.col("told")).alias("matches"))


def _records(spark, d):
    told = F.when(F.col("n") % 13 == 0, F.col("n") + 1).otherwise(F.col("n"))
    return factored(spark, d).select("n", told.alias("told"), F.transform("factors", lambda x: x.p).alias("ps"))


@query("validate_records", RECORD_SQL + """, l as (select *, list_reduce(list_transform(ps, lambda x: x - 1), lambda a, b: lcm(a, b)) as lam, list_product(ps)::bigint as pr from rec)
 select n, concat_ws(',', case when ps[1] < 3 then 'factor_range' end, case when len(ps) not between 3 and 14 then 'size' end, case when pr <> told then 'product' end, case when (told - 1) % lam <> 0 then 'korselt' end) as faults from l""")
def _(spark, d):
    return _records(spark, d).select("n", F.array_join(divisors.record_faults(F.col("told"), F.col("ps")), ",").alias("faults"))


@query("record_text", SIEVE_SQL + " select n || ' ' || array_to_string(ps, ' ') as line from kf where top = 1 and k >= 3")
def _(spark, d):
    f = factored(spark, d).where(F.forall("factors", lambda x: x.e == 1)).where(F.size("factors") >= 3)
    return f.select(F.concat_ws(" ", F.col("n").cast("string"), F.array_join(F.transform("factors", lambda x: x.p.cast("string")), " ")).alias("line"))


@query("omega_histogram", SIEVE_SQL + " select k::int as omega, count(*) as cnt from kf group by 1")
def _(spark, d):
    return factored(spark, d).groupBy(F.size("factors").alias("omega")).agg(F.count("*").alias("cnt"))


@query("universe_distinct", SIEVE_SQL + " select p, count(*) as multiples, min(n) as least, max(n) as greatest from kp group by 1")
def _(spark, d):
    p = factored(spark, d).select("n", F.explode(F.transform("factors", lambda x: x.p)).alias("p"))
    return p.groupBy("p").agg(F.count("*").alias("multiples"), F.min("n").alias("least"), F.max("n").alias("greatest"))


@query("dmin_shares", SUBSET_SQL + " select count(*) as n, round(avg(case when d = n then 1.0 else 0 end), 6) as whole_share, round(avg(len(s)), 6) as mean_size, count(*) filter (d < n) as smaller from dm")
def _(spark, d):
    rows = smallest(spark, d).where("d is not null")
    size = F.size(divisors.divisor_path(F.col("ps"), F.col("d")))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("d") == F.col("n")).cast("double")), 6).alias("whole_share"), F.round(F.avg(size), 6).alias("mean_size"), F.count(F.when(F.col("d") < F.col("n"), 1)).alias("smaller"))


@query("splitter_factor", SIEVE_SQL + " select n, array_to_string(flatten(list_transform(ps, lambda x, i: list_transform(range(0, es[i]), lambda y: x))), ' ') as primes from kf")
def _(spark, d):
    return keys(spark, d).select("n", F.array_join(primes.split_primes("n"), " ").alias("primes"))


@query("algorithm1_factor", KORSELT_SQL + " select n, array_to_string(ps, ' ') as primes, false as fallback from cn")
def _(spark, d):
    rows = divisors.korselt(factored(spark, d), "n", "factors").select("n", primes.algorithm1("n", "n").alias("r"))
    return rows.select("n", F.array_join("r.primes", " ").alias("primes"), F.col("r.fallback").alias("fallback"))
