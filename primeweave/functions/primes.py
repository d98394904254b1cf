"""Primality and factoring: sieves as DataFrames, and certified tests and splitters on Python integers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from primeweave.functions import arith

#: The first 13 primes are the bases of strong-pseudoprime tests; with the first 12, verdicts below PSI12 are proofs.
BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
PSI12 = 318665857834031151167461
#: Integers of a window of a segmented sieve.
SEGMENT = 1 << 18


def small_primes(below: int) -> np.ndarray:
    sieve = np.ones(max(below, 2), bool)
    sieve[:2] = False
    for p in range(2, math.isqrt(max(below - 1, 0)) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    return np.flatnonzero(sieve[:below])


def primes_between(spark: SparkSession, low: int, high: int) -> DataFrame:
    """(p): primes of [low, high), sieved a window a row; windows are spread over tasks."""
    base = small_primes(math.isqrt(max(high - 1, 1)) + 1)

    def run(frames):
        for frame in frames:
            for w in frame["id"]:
                a, b = max(2, int(w) * SEGMENT, low), min((int(w) + 1) * SEGMENT, high)
                keep = np.ones(max(b - a, 0), bool)
                for p in base:
                    if p * p >= b:
                        break
                    keep[max(p * p, -(-a // p) * p) - a :: p] = False
                yield pd.DataFrame({"p": np.flatnonzero(keep) + a})

    return spark.range(low // SEGMENT, max(high - 1, 0) // SEGMENT + 1).mapInPandas(run, "p long")


def spf(numbers: DataFrame, col: str, most: int) -> Column:
    """Smallest prime factor of a column of integers in [2, most], in the JVM."""
    base = F.array(*(F.lit(int(p)) for p in small_primes(math.isqrt(most) + 1)))
    return F.coalesce(F.get(F.filter(base, lambda p: (F.col(col) % p == 0)), F.lit(0)), F.col(col)).cast("long")


def factor_columns(numbers: DataFrame, col: str, most: int) -> DataFrame:
    """Adds factors (array of struct p, e, ascending) for integers of [2, most]; trial division by primes up to the root."""
    n = F.col(col).cast("long")
    base = F.array(*(F.lit(int(p)).cast("long") for p in small_primes(math.isqrt(most) + 1)))
    steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))

    def exponent(p):
        return F.aggregate(steps, F.struct(n.alias("m"), F.lit(0).alias("e")), lambda s, _: F.when(s.m % p == 0, F.struct(F.expr("1").cast("long").alias("m"), s.e.alias("e")).withField("m", arith.quotient(s.m, p)).withField("e", s.e + 1)).otherwise(s), lambda s: s.e)

    small = F.transform(F.filter(base, lambda p: n % p == 0), lambda p: F.struct(p.alias("p"), exponent(p).alias("e")))
    out = numbers.withColumn("_small", small)
    rest = F.aggregate("_small", n, lambda acc, f: arith.quotient(acc, arith.power(f.p, f.e)))
    tail = F.when(F.col("_rest") > 1, F.array(F.struct(F.col("_rest").alias("p"), F.lit(1).alias("e")))).otherwise(F.array().cast("array<struct<p:bigint,e:int>>"))
    return out.withColumn("_rest", rest).withColumn("factors", F.concat("_small", tail)).drop("_small", "_rest")


def squarefree_primes(numbers: DataFrame, col: str, most: int) -> DataFrame:
    """(col, ps): the squarefree ones of integers of [2, most], with their primes, ascending; whole batches are divided by a prime at once."""
    base = small_primes(math.isqrt(most) + 1).astype(np.int64)

    def run(batches):
        for batch in batches:
            n = batch.column(0).to_numpy()
            rest, free, owners, found = n.copy(), np.ones(len(n), bool), [], []
            for p in base[base * base <= n.max(initial=0)]:
                hit = np.flatnonzero(n % p == 0)
                rest[hit] //= p
                free[hit] &= rest[hit] % p != 0
                owners.append(hit)
                found.append(np.full(len(hit), p))
            left = np.flatnonzero(rest > 1)
            owner, prime = np.concatenate([*owners, left]), np.concatenate([*found, rest[left]])
            owner, prime = owner[free[owner]], prime[free[owner]]
            offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(n))[free])].astype(np.int32)
            ps = pa.ListArray.from_arrays(pa.array(offsets), pa.array(prime[np.argsort(owner, kind="stable")]))
            yield pa.RecordBatch.from_arrays([pa.array(n[free]), ps], [col, "ps"])

    return numbers.select(F.col(col).cast("long").alias(col)).mapInArrow(run, f"`{col}` long, ps array<long>")


def factor_limited(numbers: DataFrame, col: str, limit: int) -> DataFrame:
    """Adds factors (struct p, e) of primes up to the limit, and what is left as cofactor: 1, a prime or a composite."""
    n = F.col(col).cast("long")
    base = F.array(*(F.lit(int(p)).cast("long") for p in small_primes(limit + 1)))
    step = lambda s, p: F.when(s.m % p == 0, F.struct(arith.quotient(s.m, p).alias("m"), (s.e + 1).alias("e"))).otherwise(s)
    exponent = lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.struct(n.alias("m"), F.lit(0).alias("e")), lambda s, _: step(s, p), lambda s: s.e)
    out = numbers.withColumn("factors", F.transform(F.filter(base, lambda p: n % p == 0), lambda p: F.struct(p.alias("p"), exponent(p).alias("e"))))
    return out.withColumn("cofactor", F.aggregate("factors", n, lambda acc, f: arith.quotient(acc, arith.power(f.p, f.e))))


@F.pandas_udf(T.BooleanType())
def proven_prime(n: pd.Series) -> pd.Series:
    """Whether whole numbers (as text or decimals) are prime; null where it isn't proven."""
    return pd.Series([None if x is None else is_prime(int(x)) for x in n], dtype="object")


def is_prime(n: int) -> bool | None:
    """None where no strong test proves or refutes it."""
    if n < 2:
        return False
    for p in BASES:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while not d & 1:
        d, s = d >> 1, s + 1
    for a in BASES:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True if n < PSI12 else None


@dataclass
class Split:
    """Prime factors with multiplicity, ascending; parts of which primality isn't proven."""

    primes: list[int] = field(default_factory=list)
    uncertified: list[int] = field(default_factory=list)


def rho(n: int) -> int:
    """A proper factor of an odd composite n, by Brent's cycle finding; constants in order until one works."""
    root = math.isqrt(n)
    if root * root == n:
        return root
    for c in range(1, 1000):
        y, g, r, q = 2, 1, 1, 1
        while g == 1:
            x = y
            for _ in range(r):
                y = (y * y + c) % n
            k = 0
            while k < r and g == 1:
                held = y
                for _ in range(min(128, r - k)):
                    y = (y * y + c) % n
                    q = q * abs(x - y) % n
                g = math.gcd(q, n)
                k += 128
            r *= 2
        if g == n:
            g = 1
            while g == 1:
                held = (held * held + c) % n
                g = math.gcd(abs(x - held), n)
        if g != n:
            return g
    raise ArithmeticError(f"no factor of {n} found")


def fermat_gcd_split(n: int, base: int, exponent: int | None = None) -> int | None:
    """A proper factor from base**(2**i m) - 1, m the odd part of exponent (n - 1 by default); None if the base shows none."""
    e = n - 1 if exponent is None else exponent
    s = (e & -e).bit_length() - 1
    x = pow(base, e >> s, n)
    for _ in range(s + 1):
        g = math.gcd(x - 1, n)
        if 1 < g < n:
            return g
        x = x * x % n
    return None


def split(n: int) -> Split:
    """All prime factors of n, by small primes, then Fermat gcds, then rho."""
    out, parts = Split(), []
    for p in SMALL:
        while n % p == 0:
            out.primes.append(p)
            n //= p
    if n > 1:
        parts.append(n)
    while parts:
        m = parts.pop()
        verdict = is_prime(m) if m >= SMALL_SQUARE else True
        if verdict:
            out.primes.append(m)
        elif verdict is None:
            out.uncertified.append(m)
        else:
            g = next((g for b in BASES if (g := fermat_gcd_split(m, b))), None) or rho(m)
            parts += [g, m // g]
    out.primes.sort()
    out.uncertified.sort()
    return out


SMALL = [int(p) for p in small_primes(1000)]
SMALL_SQUARE = SMALL[-1] ** 2


def factor_with(x: int, n: int, bases: int = 100) -> tuple[list[int], bool, int]:
    """Factors x, a divisor of a Carmichael number n, by powers with exponent n - 1: (primes, fell back, ladders).

    p - 1 divides n - 1 for all its primes, so the steps of such a power part them; where the bases don't, the splitter does.
    """
    primes, parts, ladders, fell = [], [x] if x > 1 else [], 0, False
    for b in BASE_PRIMES[:bases]:
        rest = []
        for m in parts:
            if is_prime(m):
                primes.append(m)
                continue
            ladders += 1
            g = b if m % b == 0 else fermat_gcd_split(m, b, n - 1)
            rest += [g, m // g] if g else [m]
        parts = rest
        if not parts:
            break
    for m in parts:
        if is_prime(m):
            primes.append(m)
        else:
            fell = True
            primes += split(m).primes
    return sorted(primes), fell, ladders


BASE_PRIMES = [int(p) for p in small_primes(542)]  # the first 100 primes


def is_carmichael(n: int) -> bool | None:
    """Korselt's criterion; None where a factor stays unproven."""
    if n < 3 or n % 2 == 0:
        return False
    s = split(n)
    if len(set(s.primes)) < len(s.primes) or any((n - 1) % (p - 1) for p in s.primes):
        return False
    if s.uncertified:
        return None
    return len(s.primes) >= 3


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_primes(n: pd.Series) -> pd.Series:
    """Prime factors of whole numbers (as text or decimals), as text."""
    return pd.Series([None if x is None else [str(p) for p in split(int(x)).primes] for x in n])


@F.pandas_udf(T.StructType([T.StructField("primes", T.ArrayType(T.StringType())), T.StructField("fallback", T.BooleanType()), T.StructField("ladders", T.IntegerType())]))
def algorithm1(x: pd.Series, n: pd.Series) -> pd.DataFrame:
    rows = [factor_with(int(a), int(b)) for a, b in zip(x, n, strict=True)]
    return pd.DataFrame({"primes": [[str(p) for p in r[0]] for r in rows], "fallback": [r[1] for r in rows], "ladders": [r[2] for r in rows]})


def carmichael_below(limit: int) -> list[tuple[int, list[int]]]:
    """(n, factors) ascending: products of primes q with gcd(q - 1, product) = 1, the last prime solved for."""
    out: list[tuple[int, list[int]]] = []
    primes = [int(p) for p in small_primes(math.isqrt(limit // 3) + 2)][1:]

    def grow(chosen: list[int], value: int, lam: int, at: int) -> None:
        if len(chosen) > 1:
            r = pow(value, -1, lam)
            for q in range(r, min(value, (limit - 1) // value + 1) + 1, lam):
                if q > chosen[-1] and value * q < limit and (value - 1) % (q - 1) == 0 and is_prime(q):
                    out.append((value * q, [*chosen, q]))
        for k in range(at, len(primes)):
            p = primes[k]
            if value * p * (p + 2) >= limit:
                break
            if math.gcd(value, p - 1) == 1 and all(p % q != 1 for q in chosen):
                grow([*chosen, p], value * p, math.lcm(lam, p - 1), k + 1)

    grow([], 1, 1, 0)
    return sorted(out)
