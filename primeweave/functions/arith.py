"""Exact integer functions as Column expressions, and those that need Python's integers as Arrow functions.

Values of the table domain (below 10**38) are DECIMAL(38,0); `div` wraps on such values, so quotients go through the remainder.
"""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = "decimal(38,0)"
#: Euclid's steps on 64-bit values: at most 91.
_EUCLID = 91


def wide(c: Column) -> Column:
    return c.cast(WIDE)


def floor_div(a: Column, b: Column) -> Column:
    """Quotient of wide values, rounded down."""
    return wide((a - a % b) / b)


def quotient(a: Column, b: Column) -> Column:
    """Whole quotient of BIGINTs; `/` would go through a double."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def power(base: Column, exponent: Column) -> Column:
    """BIGINT power by multiplication; overflow is an error."""
    return F.aggregate(F.when(exponent > 0, F.sequence(F.lit(1), exponent.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1).cast("long"), lambda acc, _: acc * base)


def bits(v: Column) -> Column:
    """Bit length of a BIGINT that isn't negative; 0 for 0."""
    return F.when(v > 0, F.length(F.bin(v))).otherwise(0)


def bits_wide(v: Column) -> Column:
    """Bit length of a value below 2**102."""
    low = F.lit(1 << 40).cast(WIDE)
    high = floor_div(v, low)
    return F.when(high > 0, 40 + bits(high.cast("long"))).otherwise(bits((v % low).cast("long")))


def cap(v: Column, most: int) -> Column:
    return F.least(bits(v), F.lit(most))


def vbyte_length(v: Column) -> Column:
    """Bytes of a base-128 code."""
    return F.greatest(F.lit(1), F.ceil(bits(v) / 7).cast("int"))


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's steps over a fixed sequence; stays in the JVM."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.when(s.b == 0, 1).otherwise(s.b)).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_EUCLID)), start, step, lambda s: s.a)


@F.pandas_udf(T.LongType())
def gcd_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([math.gcd(int(x), int(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.LongType())
def carmichael_lambda(factors: pd.Series) -> pd.Series:
    """lcm of p - 1 over an array of distinct primes; 1 for none."""
    return pd.Series([math.lcm(*(int(p) - 1 for p in f)) if f is not None and len(f) else (1 if f is not None else None) for f in factors], dtype="Int64")


def inverse_mod(a: int, m: int) -> int | None:
    """Least x >= 0 with a x = 1 modulo m; 0 for m = 1; None where there is none."""
    if m == 1:
        return 0
    return pow(a, -1, m) if math.gcd(a, m) == 1 else None


@F.pandas_udf(T.LongType())
def inverse(a: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([inverse_mod(int(x), int(y)) for x, y in zip(a, m, strict=True)], dtype="Int64")


inverse = inverse.asNondeterministic()  # kept out of lambdas, where it can't run


@F.pandas_udf(T.DecimalType(38, 0))
def powmod(base: pd.Series, exponent: pd.Series, m: pd.Series) -> pd.Series:
    """base ** exponent modulo m, exact for whole numbers of any size below 10**38."""
    return decimals(pow(int(b), int(e), int(x)) for b, e, x in zip(base, exponent, m, strict=True))


@F.pandas_udf(T.DecimalType(38, 0))
def gcd_wide(a: pd.Series, b: pd.Series) -> pd.Series:
    return decimals(math.gcd(int(x), int(y)) for x, y in zip(a, b, strict=True))


@F.pandas_udf(T.DecimalType(38, 0))
def lcm_wide(a: pd.Series, b: pd.Series) -> pd.Series:
    return decimals(math.lcm(int(x), int(y)) for x, y in zip(a, b, strict=True))


@F.pandas_udf(T.DecimalType(38, 0))
def lambda_wide(factors: pd.Series) -> pd.Series:
    """lcm of p - 1 over an array of distinct primes."""
    return decimals(None if f is None else math.lcm(*(int(p) - 1 for p in f)) for f in factors)


@F.pandas_udf(T.DecimalType(38, 0))
def inverse_wide(a: pd.Series, m: pd.Series) -> pd.Series:
    return decimals(inverse_mod(int(x), int(y)) for x, y in zip(a, m, strict=True))


def path_value(primes: list[int], full: bool = False) -> int | None:
    """What a path stands for: its product, or d times the inverse of d modulo lam(d); None where there is no inverse."""
    d = math.prod(primes)
    if full:
        return d
    i = inverse_mod(d, math.lcm(*(p - 1 for p in primes)))
    return None if i is None else d * i


@F.pandas_udf(T.DecimalType(38, 0))
def path_values(paths: pd.Series) -> pd.Series:
    return decimals(path_value([int(p) for p in x]) for x in paths)


def decimals(numbers) -> pd.Series:
    return pd.Series([None if x is None else Decimal(x) for x in numbers], dtype="object")


def product(items: Column) -> Column:
    """Of an array; null where it passes 38 digits."""
    return F.aggregate(items, F.lit(1).cast(WIDE), lambda acc, x: F.try_multiply(acc, wide(x)).cast(WIDE))


def ascending(items: Column) -> Column:
    """Strictly."""
    return F.size(items) == F.size(F.array_distinct(items)), items == F.array_sort(items)


def strictly_ascending(items: Column) -> Column:
    distinct, sorted_ = ascending(items)
    return distinct & sorted_
