import math
import random
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from primeweave.functions import arith, primes
from primeweave.operators.divisors import _lcm, best_bucket, least_valid


def test_primality_against_the_sieve():
    known = set(primes.small_primes(20000).tolist())
    assert all(primes.is_prime(n) == (n in known) for n in range(20000))


def by_trial(n):
    """Prime factors by trial division, for tests."""
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] * (n > 1)


def korselt(n):
    f = by_trial(n)
    return n > 2 and n % 2 == 1 and len(f) >= 3 and len(set(f)) == len(f) and all((n - 1) % (p - 1) == 0 for p in f)


def test_carmichael_against_the_criterion():
    found = {n for n, _ in primes.carmichael_below(30_000)}
    assert found == {n for n in range(3, 30_000, 2) if korselt(n)}
    assert all(primes.is_carmichael(n) == (n in found) for n in range(1, 12_000))


def test_carmichael_by_construction():
    """Products of three primes 6k+1, 12k+1, 18k+1 are, with one of them changed they aren't."""
    ks = [k for k in range(10**6, 10**6 + 3000) if all(primes.is_prime(m * k + 1) for m in (6, 12, 18))]
    assert ks
    for k in ks:
        p, q, r = 6 * k + 1, 12 * k + 1, 18 * k + 1
        assert primes.is_carmichael(p * q * r) is True and primes.split(p * q * r).primes == [p, q, r]
        assert primes.is_carmichael(p * q) is False and primes.is_carmichael(p * p * q) is False


def test_unproven_is_unknown():
    """A probable prime beyond the proven range leaves the verdict open where nothing else decides it."""
    r = random.Random(3)
    while True:
        p = r.randrange(primes.PSI12 + 1, 1 << 90) | 1
        if primes.is_prime(p) is None:
            break
    assert primes.split(p).uncertified == [p]
    assert primes.is_carmichael(p) is not True


def test_split_of_random_products():
    r = random.Random(4)
    pool = [int(p) for p in primes.small_primes(10**6)]
    for _ in range(60):
        own = sorted(r.choice(pool[: r.choice([50, 5000, len(pool)])]) for _ in range(r.randint(1, 5)))
        assert primes.split(math.prod(own)).primes == own


def test_factoring_with_the_number():
    """Parts of a Carmichael number come apart by its powers; a product of primes that have nothing to do with it falls back."""
    r = random.Random(6)
    for n, f in r.sample(primes.carmichael_below(10**8), 40):
        own = sorted(r.sample(f, 2))
        assert primes.factor_with(math.prod(own), n)[:2] == (own, False)
    n, _ = primes.carmichael_below(10**4)[0]
    pool = [int(p) for p in primes.small_primes(10**6) if p > 9 * 10**5 and (n - 1) % (int(p) - 1)]
    p, q = sorted(r.sample(pool, 2))
    assert primes.factor_with(p * q, n)[0] == [p, q]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 10**15))
def test_split_multiplies_back(n):
    s = primes.split(n)
    assert math.prod(s.primes) == n and not s.uncertified and all(primes.is_prime(p) for p in s.primes)


def every_divisor(f):
    return [math.prod(c) for k in range(1, len(f) + 1) for c in combinations(f, k)]


def test_least_valid_divisors():
    for n, f in primes.carmichael_below(10**7):
        got, lam = least_valid(n, f)
        able = [d for d in every_divisor(f) if math.lcm(*(p - 1 for p in by_trial(d))) > n // d]
        assert got == min(able) and got * arith.inverse_mod(got, lam) == n


def test_wide_forms_agree_with_integers(spark):
    r = random.Random(9)
    rows = [(r.randrange(1, 10**30), r.randrange(2, 10**17), r.randrange(1, 1000)) for _ in range(200)]
    df = spark.createDataFrame([tuple(map(str, x)) for x in rows], "a string, b string, e string")
    a, b, e = (F.col(c).cast(arith.WIDE) for c in "abe")
    out = df.select("a", "b", "e", arith.gcd_wide(a, b).alias("g"), arith.inverse_wide(a, b).alias("i"), arith.powmod(a, e, b).alias("p"), arith.lcm_wide(b, e).alias("l")).collect()
    for x in out:
        m, n, k = int(x.a), int(x.b), int(x.e)
        assert (int(x.g), int(x.p), int(x.l)) == (math.gcd(m, n), pow(m, k, n), math.lcm(n, k))
        assert (x.i is None) == (math.gcd(m, n) > 1) and (x.i is None or int(x.i) == pow(m, -1, n))


def test_long_quotients_are_exact(spark):
    rows = [(2**53 + 1, 1), (2**62 + 3, 7), (9007199254740993, 3), (10**18 + 9, 10**9)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", arith.quotient(F.col("a"), F.col("b")).alias("q"), _lcm(F.col("a"), F.lit(1)).alias("l"))
    assert all((x.q, x.l) == (x.a // x.b, x.a) for x in df.collect())


def test_factoring_to_a_limit(spark):
    for x in primes.factor_limited(spark.range(2, 3000).select(F.col("id").alias("n")), "n", 13).collect():
        own = [p for p in by_trial(x.n) if p <= 13]
        assert [f.p for f in x.factors for _ in range(f.e)] == own and x.cofactor == x.n // math.prod(own)


def test_proofs(spark):
    values = [0, 1, 2, 97, 91, 2**61 - 1, (2**61 - 1) * (2**31 - 1)]
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(primes.proven_prime("v").alias("p"))
    assert [x.p for x in df.collect()] == [False, False, True, True, False, True, False]


def test_best_buckets():
    r = random.Random(11)
    for _, f in r.sample(primes.carmichael_below(10**7), 60):
        low, high = sorted(r.sample(range(2, 10**5), 2))
        scored = [(d >= low, d * math.lcm(*(p - 1 for p in by_trial(d))), d) for d in every_divisor(f) if d <= high]
        best = max(scored, default=None)
        assert best_bucket(f, low, high) == (best and (best[2], best[1] // best[2], 0 if best[0] else 1))


def test_gcd_forms_agree(spark):
    r = random.Random(5)
    rows = [(r.randrange(1 << 40), r.randrange(1 << 40)) for _ in range(200)] + [(0, 7), (7, 0), (1 << 62, 1 << 61)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", arith.gcd(F.col("a"), F.col("b")).alias("g"), arith.gcd_arrow("a", "b").alias("h"))
    assert all(x.g == math.gcd(x.a, x.b) == x.h for x in df.collect())


def test_bit_lengths(spark):
    values = [0, 1, 2, 255, 256, 10**24, 2**80 - 1, 2**80]
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(arith.bits_wide(F.col("v").cast(arith.WIDE)).alias("b"))
    assert [r.b for r in df.collect()] == [v.bit_length() for v in values]


def test_factor_columns(spark):
    df = primes.factor_columns(spark.range(2, 2000).select(F.col("id").alias("n")), "n", 2000)
    for r in df.collect():
        assert math.prod(f.p**f.e for f in r.factors) == r.n and all(primes.is_prime(f.p) for f in r.factors)


def test_primes_between_windows(spark):
    got = sorted(r.p for r in primes.primes_between(spark, 100, 600_000).collect())
    assert got == [int(p) for p in primes.small_primes(600_000) if p >= 100]


def test_squarefree_primes_are_those_of_trial_division(spark):
    given_ = [*range(2, 700), 997 * 991, 31 * 31, 30030, 999983]
    numbers = spark.createDataFrame([(n,) for n in given_], "n long")
    want = {n: by_trial(n) for n in given_ if len(set(by_trial(n))) == len(by_trial(n))}
    assert {r.n: r.ps for r in primes.squarefree_primes(numbers, "n", 999983).collect()} == want
    assert primes.squarefree_primes(numbers.where("n < 0"), "n", 999983).count() == 0
