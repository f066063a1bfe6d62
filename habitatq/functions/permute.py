"""Keyed permutations of 0 .. n - 1 by formula: no sort, no window, no shuffle.

A number is split into two digits of mixed radix, a * b >= n with a and b near the square root of n, and a Feistel
network adds to each digit in turn a scrambled value of the other, so every key gives a bijection of 0 .. a * b - 1.
A result of n or more is put through again until it is below n (cycle walking), which keeps a bijection of 0 .. n - 1;
as fewer than a numbers lie beyond n, a * b - n further rounds always suffice. Only integer sums, products and
remainders below 2**62 are used, so any SQL engine gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Two primes near 2**31 and multipliers that go with them; fixed, as the SQL counterpart has the same.
PRIMES = (2147483647, 2147483399)
FACTORS = (48271, 40692)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def scrambled(x: Column) -> Column:
    """A non-negative number below 2**47 spread over 0 .. 2**31 - 2; its square makes it non-linear."""
    first, second = map(_long, PRIMES)
    y = (x + _long(1)) * _long(FACTORS[0]) % first
    return (y * y % second + y) * _long(FACTORS[1]) % first


def run_keys(base: Column, runs: int) -> Column:
    """Array of one struct per run: ``run`` from 1 and its round keys ``k0``, ``k1`` and so on; ``base`` is below 2**31."""

    def keys(run: Column) -> Column:
        each = [scrambled(scrambled(base + run * _long(64) + _long(k)) + run) for k in range(ROUNDS)]
        return F.struct(run.alias("run"), *(key.alias(f"k{k}") for k, key in enumerate(each)))

    return F.transform(F.sequence(_long(1), _long(runs)), keys)


def _divided(x: Column, by: Column) -> Column:
    return F.floor(x / by)  # exact below 2**53


def radix(n: Column) -> tuple[Column, Column]:
    """Sizes of the two digits for numbers below ``n``."""
    a = F.ceil(F.sqrt(n.cast("double")))
    return a, F.ceil(n / a)


def _round(k: int, high: Column, low: Column, key: Column, a: Column, b: Column) -> tuple[Column, Column]:
    if k % 2:
        return high, (low + scrambled(key + high)) % b
    return (high + scrambled(key + low)) % a, low


def digits(number: Column, b: Column) -> tuple[Column, Column]:
    """High and low digit of a number, the low one below ``b``."""
    return _divided(number, b), number % b


def passed(df: DataFrame) -> DataFrame:
    """``_high`` and ``_low`` after one pass with the keys ``k0``, ``k1`` and so on and the sizes ``_a`` and ``_b``, as a chain of plain projections."""
    for k in range(ROUNDS):
        high, low = _round(k, F.col("_high"), F.col("_low"), F.col(f"k{k}"), F.col("_a"), F.col("_b"))
        df = df.withColumn("_low", low) if k % 2 else df.withColumn("_high", high)
    return df


def joined() -> Column:
    """The number with the digits ``_high`` and ``_low``."""
    return F.col("_high") * F.col("_b") + F.col("_low")


def walked(x: Column, n: Column) -> Column:
    """A number below ``_a * _b`` put through again and again until it is below ``n``, as a fold for few rows."""

    def again(x: Column, _: Column) -> Column:
        high, low = digits(x, F.col("_b"))
        every = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("key")) for k in range(ROUNDS)))

        def one(d: Column, r: Column) -> Column:
            even, odd = (_round(k, d["high"], d["low"], r["key"], F.col("_a"), F.col("_b")) for k in (0, 1))
            of = F.when(r["k"] % 2 == 0, F.struct(even[0].alias("high"), even[1].alias("low")))
            return of.otherwise(F.struct(odd[0].alias("high"), odd[1].alias("low")))

        start = F.struct(high.alias("high"), low.alias("low"))
        return F.when(x < n, x).otherwise(F.aggregate(every, start, one, lambda d: d["high"] * F.col("_b") + d["low"]))

    steps = F.sequence(_long(0), F.col("_a") * F.col("_b") - n)
    return F.when(x < n, x).otherwise(F.aggregate(steps, x, again))


def with_permuted(df: DataFrame, number: str, n: str, keys: str, out: str) -> DataFrame:
    """One row per run of ``keys`` (a column of ``run_keys``), with ``run`` and in ``out`` where it sends ``number``.

    ``number`` is below ``n``, and ``n`` below 2**53. The first pass is a chain of plain projections behind the
    explosion of the runs; the few numbers that it sends beyond ``n`` walk on in a fold.
    """
    kept = [c for c in df.columns if c != keys]
    a, b = radix(F.col(n))
    df = df.withColumns({"_a": a, "_b": b})
    high, low = digits(F.col(number), F.col("_b"))
    df = passed(df.select(*kept, "_a", "_b", high.alias("_high"), low.alias("_low"), F.inline(keys)))
    return df.withColumn("_x", joined()).select(*kept, "run", walked(F.col("_x"), F.col(n)).alias(out))
