"""Sums of doubles that do not depend on order, partitions or retries, to the last bit.

A finite double is split without error into at most four whole digits of base 2**26. Digits of one place are
added as integers, which is exact in any order, so partial sums combine before the shuffle like any other; the
few digit sums of a key (at most some 80, usually three or four) are put together from the smallest place up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26
_BASE = float(1 << BITS)


def digits(value: Column) -> Column:
    """Array of (``place``, ``digit``): the value is the sum of digit * 2 ** (26 * place); none for missing, zero and non-finite values."""
    size = F.abs(value)
    top = F.floor(F.floor(F.log2(size)) / BITS).cast("int")
    # scaling by powers of two is exact; in two steps, as one factor could overflow
    half = (top / 2).cast("int")
    scaled = value * F.pow(F.lit(_BASE), -half.cast("double")) * F.pow(F.lit(_BASE), (half - top).cast("double"))
    parts = F.aggregate(
        F.sequence(F.lit(0), F.lit(3)), F.struct(scaled.alias("rest"), F.array().cast("array<struct<place: int, digit: bigint>>").alias("out")),
        lambda s, k: F.struct(
            ((s["rest"] - _whole(s["rest"]).cast("double")) * _BASE).alias("rest"),
            F.concat(s["out"], F.array(F.struct((top - k).alias("place"), _whole(s["rest"]).alias("digit")))).alias("out")),
        lambda s: F.filter(s["out"], lambda d: d["digit"] != 0))
    return F.when(_countable(value) & (value != 0), parts).otherwise(F.array().cast("array<struct<place: int, digit: bigint>>"))


def _whole(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def _countable(value: Column) -> Column:
    return F.coalesce(F.abs(value) <= 1.7976931348623157e308, F.lit(False))  # NaN counts as larger


def exact_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """One exact sum per key for each named column, missing values left out; null if a key has none.

    NaN and infinities are passed on as a plain sum would. Up to 2**36 rows a key.
    """
    names, extra = list(sums), ["_which", "_place"]
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_which"), c.cast("double").alias("_v")) for i, c in enumerate(sums.values())])).alias("_x"))
    rows = rows.select(*keys, "_x.*").filter(F.col("_v").isNotNull())
    odd = F.when(~_countable(F.col("_v")), F.col("_v")).otherwise(0.0)
    split = rows.select(*keys, "_which", odd.alias("_odd"), F.explode_outer(digits(F.col("_v"))).alias("_d"))
    by_place = split.groupBy(*keys, "_which", F.col("_d.place").alias("_place")).agg(F.sum("_d.digit").alias("_digit"), F.sum("_odd").alias("_odd"))
    at = F.struct(*extra[1:], "_digit")
    ordered = F.array_sort(F.collect_list(F.when(F.col("_digit").isNotNull(), at)))

    def add(total: Column, d: Column) -> Column:
        half = (d["_place"] / 2).cast("int")
        return total + d["_digit"].cast("double") * F.pow(F.lit(_BASE), half.cast("double")) * F.pow(F.lit(_BASE), (d["_place"] - half).cast("double"))

    each = by_place.groupBy(*keys, "_which").agg(ordered.alias("_all"), F.sum("_odd").alias("_odd"))
    value = F.aggregate("_all", F.lit(0.0), add) + F.col("_odd")
    done = each.select(*keys, "_which", value.alias("_value"))
    found = done.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == i, F.col("_value"))).alias(n) for i, n in enumerate(names)])
    return found
