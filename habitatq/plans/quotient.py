"""Merged surveys, single-parameter quotient curves and niche widths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitatq.functions.binning import bin_index, bin_value
from habitatq.functions.fields import overlap_term
from habitatq.operators.aggregates import bin_proportions, poisoned_sum
from habitatq.operators.clean import harmonise_taxa
from habitatq.operators.joins import with_each
from habitatq.operators.windows import argmin_all_ties


def merge_occurrences(surveys: dict[str, DataFrame], names: dict[tuple[str, str], str], width: float = 0.5,
                      species: Sequence[str] | None = None) -> DataFrame:
    """Occurrence tables of several surveys stacked, tagged, renamed and binned.

    ``species`` keeps the species of interest only, by their common names.
    """
    parts = [
        df.select("spp", "cruise_station", "sst", F.col("abd").cast("double").alias("abd"), F.lit(tag).alias("data"))
        for tag, df in surveys.items()
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    merged = harmonise_taxa(stacked, names)
    if species is not None:
        merged = merged.filter(F.col("spp").isin(*species))
    return merged.withColumn("temp_bin", bin_value(bin_index(F.col("sst"), width), width))


def effort_by_bin(stations: DataFrame, width: float = 0.5, temp: str = "sst") -> DataFrame:
    """Stations per temperature bin and survey, and their share of all binned stations."""
    return bin_proportions(stations.select("data", bin_index(F.col(temp), width).alias("bin_idx")), ["data"], "bin_idx")


def spq_curve(
    catches: DataFrame, stations: DataFrame, species: Sequence[str], width: float = 0.5, overlap: bool = False
) -> DataFrame:
    """Quotient of catch share to effort share per survey, species and temperature bin.

    Raw rows are only ever counted and summed per bin; the curve, its
    normalisation and its cumulative share are windows over at most one row per
    survey, species and bin. The total catch includes catch without a
    temperature; a bin with a missing abundance has no share and counts as 0. Catch in bins without effort is dropped. A species a survey
    never caught has quotient 0 and no normalised curve.
    """
    effort = effort_by_bin(stations, width)
    binned = catches.filter(F.col("spp").isin(*species)).select(
        "data", "spp", bin_index(F.col("sst"), width).alias("bin_idx"), "abd"
    )
    whole = Window.partitionBy("data", "spp")
    catch = (
        binned.groupBy("data", "spp", "bin_idx")
        .agg(F.sum("abd").alias("known"), poisoned_sum(F.col("abd")).alias("in_bin"))
        .withColumn("prop_fish", F.try_divide("in_bin", F.sum("known").over(whole)))
        .drop("known", "in_bin")
    )
    return curve_from_shares(with_each(effort, spp=species), catch, width, overlap)


def curve_from_shares(grid: DataFrame, catch: DataFrame, width: float, overlap: bool = False) -> DataFrame:
    """The quotient columns from an effort grid and the catch share per bin."""
    whole = Window.partitionBy("data", "spp")
    running = whole.orderBy("bin_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = (
        grid.join(catch, ["data", "spp", "bin_idx"], "left")
        .withColumn("prop_fish", F.coalesce("prop_fish", F.lit(0.0)))
        .withColumn("q", F.col("prop_fish") / F.col("prop_samples"))
        .withColumn("q_norm", F.try_divide("q", F.sum("q").over(whole)))
        .withColumn("cdf_q_norm", F.sum("q_norm").over(running))
    )
    extra = [overlap_term(F.col("prop_samples"), F.col("prop_fish")).alias("niche")] if overlap else []
    return curve.select(
        "data", "spp", bin_value(F.col("bin_idx"), width).alias("temp_bin"),
        "prop_samples", "prop_fish", "q", "q_norm", "cdf_q_norm", *extra,
    )


def cdf_quantile_crossing(curve: DataFrame, quantiles: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """Bins at which the cumulative share comes nearest to each quantile, all ties kept."""
    asked = with_each(curve.filter(F.col("cdf_q_norm").isNotNull()), quant=quantiles)
    nearest = argmin_all_ties(asked, ["data", "spp", "quant"], F.abs(F.col("cdf_q_norm") - F.col("quant")))
    return nearest.select("data", "spp", "quant", "temp_bin")


def niche_width(crossings: DataFrame) -> DataFrame:
    """Distance between the outermost mean crossing bins."""
    means = crossings.groupBy("data", "spp", "quant").agg(F.avg("temp_bin").alias("temp"))
    return means.groupBy("data", "spp").agg((F.max("temp") - F.min("temp")).alias("width"))


def curve_ci_report(curve: DataFrame, intervals: DataFrame) -> DataFrame:
    """Quotient points and their intervals on one axis, keeping bins only one side has."""
    points = curve.select("data", "spp", "temp_bin", "q")
    return points.join(intervals, ["data", "spp", "temp_bin"], "full")
