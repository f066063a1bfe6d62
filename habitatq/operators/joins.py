"""Station joins, nearest-bin matches and literal grids.

No join here carries a broadcast hint, but for lists of bounded length: Catalyst and adaptive execution
broadcast a side when its measured size is under the session's threshold and
fall back to a shuffle join beyond it. Small literal lists are exploded inside
a row, so no cross join is planned anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which missing keys match each other; keys of the left side are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01, min_rows: int = 100_000) -> DataFrame:
    """Keys with more than ``share`` of the rows and more than ``min_rows``, with their exact count ``_n``.

    One pass merges frequent-items summaries of the key hashes over all partitions: a summary keeps some
    14 / share counters whatever the number of keys, its counts are off by less than a quarter of the share,
    and so no key above the share is missed. Only the candidates, fewer than 4 / share, are then counted
    exactly. A missing key is a key like any other. ``df`` is read twice, its key columns alone, and nothing
    is stored; the result is a local table of fewer than 1 / share rows.
    """
    keys, most = list(keys), 4 * math.ceil(1 / share)
    counters = 1 << math.ceil(math.log2(14 / share))
    hashed = df.select(*keys, F.xxhash64(*keys).alias("_h"))
    summary = hashed.agg(F.call_function("approx_top_k", F.col("_h"), F.lit(most), F.lit(counters)).alias("top"), F.count("*").alias("n")).first()
    least = max(summary["n"] * share, min_rows)
    candidates = [x["item"] for x in summary["top"] if x["count"] > 0.75 * least]
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("_n", T.LongType())])
    if not candidates:
        return df.sparkSession.createDataFrame([], schema)
    counted = hashed.filter(F.col("_h").isin(candidates)).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > least)
    return df.sparkSession.createDataFrame(counted.collect(), schema)


def salted_left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], hot_share: float = 0.01, salts: int = 64, min_rows: int = 100_000
) -> DataFrame:
    """Left equi-join for a left side in which few keys hold many rows.

    Keys with more than ``hot_share`` of the left rows, and more than ``min_rows``, come from
    ``hot_keys``; there are fewer than ``1 / hot_share`` of them, so broadcasting that key list is
    safe for any input. Exact copies among the left rows of a hot key are
    counted first and expanded after the join; the distinct ones are spread over
    ``salts`` tasks by a hash of all their columns, which is the same after a
    retry and however the rows lie. Right rows of hot keys are repeated once per
    salt. Rows fan out over duplicate right keys as in a plain left join.
    ``left`` is read for its keys and again for its rows, and must have no map columns.
    """
    keys = list(keys)
    hot = hot_keys(left, keys, hot_share, min_rows).select(*keys, F.lit(True).alias("_hot"))
    if hot.isEmpty():
        return left.join(right, keys, "left")
    hot = F.broadcast(hot)
    tagged = null_safe_join(left, hot, keys, "left")
    crowded = tagged.filter("_hot").groupBy(*left.columns).agg(F.count("*").alias("_copies"))
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    salted = crowded.withColumn("_salt", spread)
    needed = right.join(hot, keys, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = salted.join(needed, [*keys, "_salt"], "left").drop("_salt")
    expanded = dealt.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    plain = tagged.filter(F.col("_hot").isNull()).drop("_hot").join(right, keys, "left")
    return plain.unionByName(expanded)


def in_any(df: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Rows whose key occurs in at least one of the tables."""
    known = tables[0].select(key)
    for t in tables[1:]:
        known = known.unionByName(t.select(key))
    return df.join(known.distinct(), key, "left_semi")


def not_in(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Rows whose key does not occur in the table."""
    return df.join(table.select(key).distinct(), key, "left_anti")


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have."""
    return not_in(left.select(key).distinct(), key, right)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table unchanged, failing at run time on a key that occurs twice.

    Counting and joining back costs a shuffle, so it is an opt-in guard for
    join sides that should not fan out.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    guarded = null_safe_join(df, counts, keys)
    ok = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"duplicate key in {list(keys)}")).cast("boolean"))
    return guarded.filter(ok).drop("_n")


def with_each(df: DataFrame, **lists: Sequence) -> DataFrame:
    """Every row once per combination of the listed literals, without a join."""
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def zero_filled_panel(
    stations: DataFrame, catches: DataFrame, species: Sequence[str], keys: Sequence[str] = ("cruise_station", "data")
) -> DataFrame:
    """All stations for each species, with 0 where nothing was caught."""
    wanted = catches.filter(F.col("spp").isin(*species)).select(*keys, "spp", "abd")
    full = with_each(stations, spp=species).join(wanted, [*keys, "spp"], "left")
    return full.withColumn("abd", F.coalesce("abd", F.lit(0.0)))


def nearest_good_bin(bins: DataFrame, station: str, index: str, good: Column, label: str) -> DataFrame:
    """For every bin of a station, the good bin it belongs to.

    ``bins`` has one or more rows per station and bin index, alike in ``good``
    and ``label``. A good bin belongs to itself; any other to the nearest good
    one, and when two are equally near, to the one whose ``label`` comes first
    (missing labels last, then the lower bin). One window in rising and one in falling bin order find the neighbours
    on either side, so bins are never paired with each other. Adds column
    ``target``, null if the station has no good bin.
    """
    me = F.when(good, F.struct(F.col(index).alias("idx"), F.col(label).alias("label")))
    passed = (Window.unboundedPreceding, -1)
    rising = Window.partitionBy(station).orderBy(F.col(index).asc()).rangeBetween(*passed)
    falling = Window.partitionBy(station).orderBy(F.col(index).desc()).rangeBetween(*passed)
    near = bins.withColumn("_lo", F.last(me, ignorenulls=True).over(rising)).withColumn(
        "_hi", F.last(me, ignorenulls=True).over(falling)
    )
    lo, hi = F.col("_lo.idx"), F.col("_hi.idx")
    gap_lo, gap_hi = F.col(index) - lo, hi - F.col(index)
    lo_label, hi_label = F.col("_lo.label"), F.col("_hi.label")
    hi_first = hi_label.isNotNull() & (lo_label.isNull() | (hi_label < lo_label))
    nearest = (
        F.when(lo.isNull(), hi).when(hi.isNull(), lo)
        .when(gap_lo < gap_hi, lo).when(gap_hi < gap_lo, hi)
        .when(hi_first, hi).otherwise(lo)
    )
    return near.withColumn("target", F.when(good, F.col(index)).otherwise(nearest)).drop("_lo", "_hi")
