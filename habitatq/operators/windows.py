"""Numbering, shuffles and nearest-row picks that survive hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitatq.functions.keys import HASH_DIGITS, hash_int
from habitatq.operators.joins import null_safe_join
from habitatq.sources.tables import stored


def hash_split(df: DataFrame, keys: Sequence[str], salt: Sequence[Column | str | int] = (), digits: int = 3) -> DataFrame:
    """Rows with a key hash ``_h`` and the split ``_b`` they belong to, its first hex digits."""
    hashed = df.withColumn("_h", F.coalesce(hash_int(*salt, *[F.col(k) for k in keys]), F.lit(0)))
    return hashed.withColumn("_b", F.shiftright("_h", 4 * (HASH_DIGITS - digits)))


def split_offsets(split: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group and split: rows in it, rows in all earlier splits, rows of the whole group.

    The windows run over the counts, at most ``16 ** digits`` rows per group.
    """
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = split.groupBy(*groups, "_b").agg(F.count("*").alias("_in"))
    return counts.select(
        *groups, "_b", "_in", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
        F.sum("_in").over(whole).alias("_size"),
    )


def number_rows(split: DataFrame, offsets: DataFrame, groups: Sequence[str], keys: Sequence[str], out: str) -> DataFrame:
    """Row numbers from 0 within each group, in hash order."""
    inside = Window.partitionBy("_b", *groups).orderBy("_h", *keys)
    numbered = split.withColumn("_rn", F.row_number().over(inside) - 1)
    numbered = null_safe_join(numbered, offsets, ["_b", *groups])
    extra = [c for c in ("_in", "_size") if c in offsets.columns]
    return numbered.withColumn(out, F.col("_before") + F.col("_rn")).drop("_h", "_b", "_rn", "_before", *extra)


def dense_index(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    out: str,
    salt: Sequence[Column | str | int] = (),
    digits: int = 3,
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in the order of a key hash.

    A single window per group would put a whole group in one task. Here each
    group is split by the first ``digits`` hex digits of the hash: rows are
    numbered inside a split, and the number of rows in all earlier splits is
    added from a small table of counts. ``keys`` should identify a row within
    its group; ``salt`` changes the order.
    """
    split = hash_split(df, keys, salt, digits)
    return number_rows(split, split_offsets(split, groups), groups, keys, out)


def seeded_shuffle(
    df: DataFrame, groups: Sequence[str], keys: Sequence[str], value: str, seed: int, out: str, digits: int = 3
) -> DataFrame:
    """Rearrange ``value`` over the rows of each group in a repeatable random order.

    ``df`` is read four times, so pass a stored table unless it is a plain scan.
    """
    place = dense_index(df.select(*groups, *keys, value), groups, keys, "_i", digits=digits)
    moved = dense_index(
        df.select(*groups, *keys, F.col(value).alias(out)), groups, keys, "_i", salt=[seed], digits=digits
    ).drop(*keys)
    return null_safe_join(place, moved, ["_i", *groups]).drop("_i")


def argmin_first(df: DataFrame, keys: Sequence[str], distance: str, tie_order: Sequence[str]) -> DataFrame:
    """The one row of each key at the smallest distance, ties by ``tie_order``.

    A ``min`` over structs combines map-side, so a hot key costs one row per task.
    Null distances are skipped, null tie columns sort last.
    """
    rest = [c for c in df.columns if c not in {*keys, distance, *tie_order}]
    ordered = [F.col(distance)]
    for c in tie_order:
        ordered += [F.col(c).isNull().alias(f"_null_{c}"), F.col(c)]
    best = df.filter(F.col(distance).isNotNull()).groupBy(*keys).agg(
        F.min(F.struct(*ordered, *[F.col(c) for c in rest])).alias("_best")
    )
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [distance, *tie_order, *rest]])


def argmin_all_ties(df: DataFrame, keys: Sequence[str], distance: Column, digits: int = 9) -> DataFrame:
    """All rows of each key at the smallest distance, compared after rounding.

    The minimum is aggregated map-side, stored at one row per key and joined
    back: no group is sorted, and the rows are only shuffled if there are too
    many keys to broadcast. ``df`` is read twice, so pass a stored table unless
    it is a plain scan. A missing key is a key of its own.
    """
    dist = df.withColumn("_d", F.round(distance, digits))
    least = stored(dist.groupBy(*keys).agg(F.min("_d").alias("_least")), "least")
    return null_safe_join(dist, least, keys).filter(F.col("_d") == F.col("_least")).drop("_d", "_least")


def group_totals(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Each row with the sum of its group.

    The sums are aggregated map-side and joined back, so one hot group is not
    gathered in a single task.
    """
    sums = df.groupBy(*keys).agg(F.sum(value).alias(out))
    return null_safe_join(df, sums, keys)
