"""Divisor algebra of factored integers: subset products, compact divisors, buckets, masks, cofactors, validation."""

from __future__ import annotations

import math
from decimal import Decimal
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from primeweave.functions import arith

_CHOICE = T.StructType([T.StructField("d", T.LongType()), T.StructField("lam", T.LongType()), T.StructField("tier", T.IntegerType())])


def subsets(factors: Column) -> Column:
    """(mask, d, lam) of every non-empty set of an array's distinct primes, in the JVM; at most 14 primes."""
    start = F.array(F.struct(F.lit(0).alias("mask"), F.lit(1).cast("long").alias("d"), F.lit(1).cast("long").alias("lam"), F.lit(1).alias("bit")))
    whole = F.array_sort(factors)

    def add(acc, p):
        bit = acc[0]["bit"]
        taken = F.transform(acc, lambda s: F.struct((s.mask + bit).alias("mask"), (s.d * p).alias("d"), _lcm(s.lam, p - 1).alias("lam"), (2 * bit).alias("bit")))
        return F.concat(F.transform(acc, lambda s: F.struct(s.mask.alias("mask"), s.d.alias("d"), s.lam.alias("lam"), (2 * bit).alias("bit"))), taken)

    return F.filter(F.aggregate(whole, start, add), lambda s: s.mask > 0)


def _lcm(a: Column, b: Column) -> Column:
    return arith.quotient(a, arith.gcd(a, b)) * b


def _all(primes: list[int]):
    for k in range(1, len(primes) + 1):
        for c in combinations(primes, k):
            yield math.prod(c), math.lcm(*(p - 1 for p in c))


def least_valid(n: int, primes: list[int]) -> tuple[int, int] | None:
    """The smallest divisor d, a product of some of the primes, with d lam(d) > n; a search cut at the best so far."""
    best: tuple[int, int] | None = None
    primes = sorted(primes)

    def grow(at: int, d: int, lam: int) -> None:
        nonlocal best
        if d > 1 and lam > n // d:
            best = (d, lam)
            return
        for k in range(at, len(primes)):
            if best and d * primes[k] >= best[0]:
                return
            grow(k + 1, d * primes[k], math.lcm(lam, primes[k] - 1))

    grow(0, 1, 1)
    return best


@F.pandas_udf(_CHOICE)
def choose_dmin(n: pd.Series, factors: pd.Series) -> pd.DataFrame:
    rows = [least_valid(int(x), [int(p) for p in f]) for x, f in zip(n, factors, strict=True)]
    return pd.DataFrame({"d": pd.Series([r[0] if r else None for r in rows], dtype="Int64"), "lam": pd.Series([r[1] if r else None for r in rows], dtype="Int64"), "tier": pd.Series([0 if r else None for r in rows], dtype="Int32")})


choose_dmin = choose_dmin.asNondeterministic()  # one call a row: the optimizer would copy it into lambdas, where it can't run


_WIDE_CHOICE = T.StructType([T.StructField("d", T.DecimalType(38, 0)), T.StructField("lam", T.DecimalType(38, 0)), T.StructField("tier", T.IntegerType())])


def _choices(found: list[tuple | None]) -> pd.DataFrame:
    number = lambda k: pd.Series([Decimal(r[k]) if r else None for r in found], dtype="object")
    return pd.DataFrame({"d": number(0), "lam": number(1), "tier": pd.Series([r[2] if r else None for r in found], dtype="Int32")})


@F.pandas_udf(_WIDE_CHOICE)
def choose_dmin_wide(n: pd.Series, factors: pd.Series) -> pd.DataFrame:
    """The least valid divisor of a wide n, from its distinct primes."""
    found = [least_valid(int(x), [int(p) for p in f]) for x, f in zip(n, factors, strict=True)]
    return _choices([(*r, 0) if r else None for r in found])


choose_dmin_wide = choose_dmin_wide.asNondeterministic()


def best_bucket(primes: list[int], low: int, high: int) -> tuple[int, int, int] | None:
    """(d, lam, tier): of divisors in [low, high] the one of the greatest d lam(d), ties to the greater; else of those below low, tier 1."""
    able = [(d >= low, d * lam, d, lam) for d, lam in _all(primes) if d <= high]
    best = max(able, default=None)
    return (best[2], best[3], 0 if best[0] else 1) if best else None


def choose_bucket_wide(factors: Column, low: int, high: int) -> Column:
    @F.pandas_udf(_WIDE_CHOICE)
    def choose(factors: pd.Series) -> pd.DataFrame:
        return _choices([best_bucket([int(p) for p in f], low, high) for f in factors])

    return choose.asNondeterministic()(factors)


def choose_dmin_native(n: Column, factors: Column) -> Column:
    """The same choice from all subsets, in the JVM."""
    valid = F.filter(subsets(factors), lambda s: s.lam > arith.quotient(n, s.d))
    return F.array_min(F.transform(valid, lambda s: F.struct(s.d.alias("d"), s.lam.alias("lam"))))


def choose_bucket(factors: Column, cap: int) -> Column:
    """Struct(dl, d, lam): the divisor up to cap with the greatest d lam(d), ties to the greater d; null for none."""
    fits = F.filter(subsets(factors), lambda s: s.d <= cap)
    return F.array_max(F.transform(fits, lambda s: F.struct((s.d * s.lam).alias("dl"), s.d.alias("d"), s.lam.alias("lam"))))


def choose_bucket_window(factors: Column, low: int, high: int) -> Column:
    """Struct(tier, d, lam): the best divisor of [low, high] (tier 0), else the best below low (tier 1)."""
    fits = F.filter(subsets(factors), lambda s: s.d <= high)
    best = F.array_max(F.transform(fits, lambda s: F.struct((s.d >= low).alias("inside"), (s.d * s.lam).alias("dl"), s.d.alias("d"), s.lam.alias("lam"))))
    return F.when(best.isNotNull(), F.struct(F.when(best.inside, 0).otherwise(1).alias("tier"), best.d.alias("d"), best.lam.alias("lam")))


def divisor_path(factors: Column, d: Column) -> Column:
    """The primes of n that divide d."""
    return F.filter(factors, lambda p: d % p == 0)


def mask_of(factors: Column, d: Column) -> Column:
    """Bit j is set if the j-th smallest prime divides d."""
    bits = F.transform(F.array_sort(factors), lambda p, i: F.when(d % p == 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b)


def subset_of(factors: Column, mask: Column) -> Column:
    return F.filter(F.array_sort(factors), lambda p, i: F.call_function("shiftright", mask, i).bitwiseAND(1) == 1)


def record_faults(n: Column, factors: Column, most: int = 10**24, factor_most: int = 10**12, first_most: int = 10**8) -> Column:
    """The ingest rules that a record breaks, by name: range, factor_range, ascending, size, first_factor, product, korselt."""
    rule = lambda name, bad: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    lam = arith.carmichael_lambda(factors)
    return F.array_compact(
        F.array(
            rule("range", n >= F.lit(str(most)).cast(arith.WIDE)),
            rule("factor_range", F.exists(factors, lambda p: (p < 3) | (p >= factor_most))),
            rule("ascending", ~arith.strictly_ascending(factors)),
            rule("size", ~F.size(factors).between(3, 14)),
            rule("first_factor", F.get(factors, F.lit(0)) >= first_most),
            rule("product", arith.product(factors) != arith.wide(n)),
            rule("korselt", (arith.wide(n) - 1) % arith.wide(lam) != 0),
        )
    )


def korselt(rows: DataFrame, n: str, factors: str) -> DataFrame:
    """Rows of composite squarefree odd n with three primes or more, p - 1 dividing n - 1 for each; factors are struct(p, e)."""
    f = F.col(factors)
    return rows.where((F.col(n) % 2 == 1) & (F.size(f) >= 3) & F.forall(f, lambda x: (x.e == 1) & ((F.col(n) - 1) % F.greatest(x.p - 1, F.lit(1)) == 0)))
