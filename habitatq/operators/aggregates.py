"""Grouped totals with explicit rules for missing values, and exact quantiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitatq.operators.joins import null_safe_join
from habitatq.sources.tables import stored


def poisoned_sum(value: Column, keep: Column | None = None) -> Column:
    """Sum that is null if any kept member is null, and 0 if nothing is kept."""
    mine = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    missing = F.max(mine & value.isNull())
    return F.when(missing, None).otherwise(F.coalesce(F.sum(F.when(mine, value)), F.lit(0.0)))


def conditional_sums(
    df: DataFrame, keys: Sequence[str], value: str, groups: Mapping[str, Column]
) -> DataFrame:
    """One filtered sum per named condition and key, in a single aggregation."""
    return df.groupBy(*keys).agg(*[poisoned_sum(F.col(value), cond).alias(n) for n, cond in groups.items()])


def mean_of_distinct(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean over the distinct values of each key."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.avg(value).alias(out))


def distinct_sketches(df: DataFrame, keys: Sequence[str], value: str, out: str = "sketch", lg_k: int = 12) -> DataFrame:
    """A mergeable sketch of the distinct values of each key: at most ``2 ** lg_k`` bytes, missing values left out.

    Store the result; ``merged_richness`` rolls it up to any coarser keys without the rows. Values enter by
    their hash, as a sketch of texts would leave out the empty one.
    """
    hashed = F.when(F.col(value).isNotNull(), F.xxhash64(value))
    return df.groupBy(*keys).agg(F.hll_sketch_agg(hashed, lg_k).alias(out))


def sketch_error(lg_k: int = 12) -> float:
    """Relative standard error of an estimate from sketches of ``2 ** lg_k`` registers."""
    return 1.04 / 2 ** (lg_k / 2)


def merged_richness(sketches: DataFrame, keys: Sequence[str], out: str, sketch: str = "sketch") -> DataFrame:
    """Estimated number of distinct values per key from stored sketches of finer keys."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(out))


def share_of_total(df: DataFrame, part: str, other: str, out: str = "share") -> DataFrame:
    """Overall share A / (A + B) as a one-row table."""
    sums = df.agg(F.sum(part).alias("a"), F.sum(other).alias("b"))
    return sums.select(F.try_divide(F.col("a"), F.col("a") + F.col("b")).alias(out))


def bin_proportions(df: DataFrame, keys: Sequence[str], bin_col: str) -> DataFrame:
    """Rows per bin and their share of all binned rows of the same keys.

    Rows are counted first; the total is a window over the counts, at most one
    row per bin and key, never over the raw rows.
    """
    counts = df.filter(F.col(bin_col).isNotNull()).groupBy(*keys, bin_col).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("prop_samples", F.col("n") / total)


def replicate_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles of a bounded number of replicates per key.

    The aggregate buffer holds the distinct values of a key, so use it where a
    key has at most as many rows as there are runs; ``exact_quantiles`` takes
    groups of any size.
    """
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(*[F.percentile(v, p).alias(n) for n, p in probs.items()])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per key and distinct number, missing ones left out."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
    return rows.groupBy(*keys, "_v").agg(F.count("*").alias("_m"))


def _in_slice(cuts: str, value: str, slices: int) -> Callable[[DataFrame], DataFrame]:
    """Adds ``_s``, how many of ``slices - 1`` cut points lie below the value: one codegen projection per halving."""

    def add(df: DataFrame) -> DataFrame:
        df, step = df.withColumn("_s", F.lit(0)), slices // 2
        while step:
            passed = F.get(cuts, F.col("_s") + (step - 1)) < F.col(value)
            df = df.withColumn("_s", F.col("_s") + F.when(passed, step).otherwise(0))
            step //= 2
        return df

    return add


def rank_ranges(counted: DataFrame, keys: Sequence[str], ranks: DataFrame, most: int = 4096, slices: int = 256) -> DataFrame:
    """For each wanted rank (``keys, _rank``, from 0) a range of values that holds it.

    Returns ``keys, _rank, _low, _high, _before``: the first and last value of the range and the rows before it. No
    range has more than ``most`` distinct values. A round sketches the values of each range that is still larger
    (mergeable KLL sketches, a few KB a range), cuts it at the sketch's quantiles, counts the slices exactly and
    keeps the one with the rank, so a range shrinks by a factor near ``slices`` whatever the group's size and the
    result does not depend on how good the cuts are. Ranges are stored, at most one row per rank.
    """
    whole = counted.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_values"))
    found = stored(null_safe_join(ranks, whole.withColumn("_before", F.lit(0).cast("bigint")), keys), "ranges")
    span, marks = [*keys, "_low", "_high"], F.array(*[F.lit(i / slices) for i in range(1, slices)])
    while found.filter(F.col("_values") > most).limit(1).count():
        large = found.filter(F.col("_values") > most)
        ranges = large.select(*span, "_before").distinct()
        inside = null_safe_join(counted, ranges, keys).filter(F.col("_v").between(F.col("_low"), F.col("_high")))
        sketched = inside.groupBy(*span, "_before").agg(F.kll_sketch_agg_double("_v", F.lit(400)).alias("_sketch"))
        cuts = stored(sketched.select(*span, "_before", F.kll_sketch_get_quantile_double("_sketch", marks).alias("_cuts")), "cuts")
        placed = null_safe_join(counted, cuts, keys).filter(F.col("_v").between(F.col("_low"), F.col("_high")))
        counts = placed.transform(_in_slice("_cuts", "_v", slices)).groupBy(*span, "_before", "_s").agg(
            F.min("_v").alias("_from"), F.max("_v").alias("_to"), F.sum("_m").alias("_in"), F.count("*").alias("_values"))
        so_far = Window.partitionBy(*span).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_in").over(so_far), F.lit(0)))
        narrower = null_safe_join(large.drop("_values", "_before"), counts.drop("_before", "_s"), span)
        narrower = narrower.filter((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_in"))).select(
            *keys, "_rank", F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_values", F.col("_first").alias("_before"))
        found = stored(found.filter(F.col("_values") <= most).unionByName(narrower), "ranges")
    return found.drop("_values")


def exact_quantiles(
    counted: DataFrame, keys: Sequence[str], probs: Mapping[str, float], most: int = 4096, slices: int = 256
) -> DataFrame:
    """Exact interpolated quantiles of groups of any size, from their ``value_counts``.

    ``rank_ranges`` finds for each rank that is needed a range of at most ``most`` distinct values, and only
    these are ranked by a window: no task ever sorts more of a group than that. Ranges are a few rows per
    group, so joins with them are broadcast by known size and ``counted`` itself is not shuffled. ``slices``
    is a power of two. ``counted`` is read in every round, so pass a stored table.
    """
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    sizes = counted.groupBy(*keys).agg(F.sum("_m").alias("_n")).withColumn("_q", F.explode(wanted))
    targets = stored(sizes.select(*keys, F.col("_q.name").alias("_name"), ((F.col("_n") - 1) * F.col("_q.p")).alias("_pos")), "targets")
    both = targets.select(*keys, F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_rank")).distinct()
    ranges = stored(rank_ranges(counted, keys, both, most, slices), "rank-ranges")
    span = [*keys, "_low", "_high"]
    few = null_safe_join(counted, ranges.select(*span, "_before").distinct(), keys).filter(F.col("_v").between(F.col("_low"), F.col("_high")))
    so_far = Window.partitionBy(*span).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = few.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_m").over(so_far), F.lit(0))).select(*span, "_v", "_m", "_first")
    hit = null_safe_join(ranked, ranges.select(*span, "_rank"), span).filter(
        (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_m")))
    values = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two ranks per quantile
    low, high = F.element_at("_at", F.floor("_pos")), F.element_at("_at", F.ceil("_pos"))
    answers = null_safe_join(targets, values, keys).withColumn("_out", low + (high - low) * (F.col("_pos") - F.floor("_pos")))
    return answers.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_out"))).alias(n) for n in probs])
