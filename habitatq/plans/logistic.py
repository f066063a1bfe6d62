"""Grouped quasi-binomial logistic fits of cumulative curves, and their bands.

Spark reduces the curve to a few sums per group and distinct bin, which is
all a fit needs. The fit itself is a fold over the array of a group's bins,
at most one entry per temperature bin however many curve rows a group has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitatq.functions.binning import bin_index, bin_value, grid_indices
from habitatq.functions.binomial import let
from habitatq.functions.fields import normal_band

MAX_STEPS = 25
TOLERANCE = 1e-8
SOLUTION = "struct<b0: double, b1: double, v00: double, v01: double, v11: double>"


def with_stage(curve: DataFrame, larval: Sequence[str]) -> DataFrame:
    """Curve rows labelled by life stage: listed surveys caught larvae, the others eggs."""
    return curve.withColumn("stage", F.when(F.col("data").isin(*larval), "Larvae").otherwise("Eggs"))


def fit_sums(curve: DataFrame, keys: Sequence[str], digits: int | None = 4) -> DataFrame:
    """Per group and bin: row count, response sums and the first working step."""
    raw = F.col("cdf_q_norm")
    y = F.col("y")
    xlogx = F.when(y > 0, y * F.log(y)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log(1 - y)).otherwise(0.0)
    mu = (y + 0.5) / 2
    weight = mu * (1 - mu)
    rows = curve.select(*keys, F.col("temp_bin").alias("x"), (raw if digits is None else F.round(raw, digits)).alias("y"))
    return rows.filter(F.col("y").isNotNull()).groupBy(*keys, "x").agg(
        F.count("*").cast("double").alias("n"),
        F.sum("y").alias("sy"),
        F.sum(y * y).alias("syy"),
        F.sum(xlogx).alias("sat"),
        F.sum(weight).alias("w0"),
        F.sum(weight * F.log(mu / (1 - mu)) + (y - mu)).alias("wz0"),
    )


def _solved(s: Column) -> Column:
    """Coefficients and covariance of weighted least squares from the sums ``a, b, c, d, e``; null if they are degenerate."""
    det = s["a"] * s["c"] - s["b"] * s["b"]
    sound = (det > 1e-12 * F.greatest(s["a"] * s["c"], F.lit(1e-300))) & (F.abs(det) < 1e300)

    def over(d: Column) -> Column:
        return F.struct(
            ((s["c"] * s["d"] - s["b"] * s["e"]) / d).alias("b0"), ((s["a"] * s["e"] - s["b"] * s["d"]) / d).alias("b1"),
            (s["c"] / d).alias("v00"), (-s["b"] / d).alias("v01"), (s["a"] / d).alias("v11"))

    return F.when(sound, let(det, over))


def _sums(rows: Column, terms: Callable[[Column], dict[str, Column]]) -> Column:
    """Sums of several terms over an array of rows."""
    names = list(terms(F.element_at(rows, 1)))
    return F.aggregate(rows, F.struct(*[F.lit(0.0).alias(n) for n in names]),
                       lambda s, r: let(F.struct(*[t.alias(n) for n, t in terms(r).items()]), lambda t: F.struct(*[(s[n] + t[n]).alias(n) for n in names])))


def _at_start(r: Column) -> dict[str, Column]:
    w, x, wz = r["w0"], r["x"], r["wz0"]
    return {"a": w, "b": w * x, "c": w * x * x, "d": wz, "e": wz * x}


def _at(solution: Column) -> Callable[[Column], dict[str, Column]]:
    def terms(r: Column) -> dict[str, Column]:
        x, n, sy = r["x"], r["n"], r["sy"]
        eta = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), solution["b0"] + solution["b1"] * x))
        mu = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), 1 / (1 + F.exp(-eta))))
        v = mu * (1 - mu)
        z = n * v * eta + (sy - n * mu)
        return {
            "a": n * v, "b": n * v * x, "c": n * v * x * x, "d": z, "e": z * x,
            "likely": sy * F.ln(mu) + (n - sy) * F.log1p(-mu), "pearson": (r["syy"] - 2 * mu * sy + n * mu * mu) / v,
        }

    return terms


def _newton(rows: Column, saturated: Column) -> Column:
    """Iteratively reweighted least squares as a fold: ``used`` has the last coefficients, ``next`` the step after them."""
    none = F.lit(None)
    start = F.struct(
        none.cast(SOLUTION).alias("used"), _solved(_sums(rows, _at_start)).alias("next"), none.cast("double").alias("deviance"),
        none.cast("double").alias("pearson"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("converged"), F.lit(False).alias("lost"))

    def step(s: Column, _: Column) -> Column:
        def after(at: Column) -> Column:
            now = 2 * (saturated - at["likely"])
            near = F.coalesce(F.abs(now - s["deviance"]) / (F.abs(now) + 0.1) < TOLERANCE, F.lit(False))
            more = F.when(near | (s["steps"] >= MAX_STEPS), s["steps"]).otherwise(s["steps"] + 1)
            return F.struct(
                s["next"].alias("used"), _solved(at).alias("next"), now.alias("deviance"), at["pearson"].alias("pearson"),
                more.alias("steps"), near.alias("converged"), (~F.coalesce(F.abs(now) < 1e300, F.lit(False))).alias("lost"))

        over = s["converged"] | s["lost"] | s["next"].isNull()
        return F.when(over, s).otherwise(let(_sums(rows, _at(s["next"])), after))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_STEPS)), start, step)


COEFFICIENTS = ["b0", "b1", "v00", "v01", "v11", "dispersion", "deviance"]


def logistic_cdf_fit(curve: DataFrame, keys: Sequence[str] = ("spp", "stage"), digits: int | None = 4) -> DataFrame:
    """Intercept, slope, unscaled covariance and dispersion of one fit per group.

    Groups with fewer than three rows or without a finite solution get null
    coefficients and ``converged`` false. ``low`` and ``high`` are the range of
    bins, for ``logistic_cdf_predict``.
    """
    keys = list(keys)
    sums = fit_sums(curve, keys, digits)
    bins = F.array_sort(F.collect_list(F.struct("x", "n", "sy", "syy", "w0", "wz0")))
    groups = sums.groupBy(*keys).agg(
        bins.alias("_bins"), F.sum("sat").alias("_sat"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").cast("long").alias("n"))
    fitted = groups.withColumn("_fit", _newton(F.col("_bins"), F.col("_sat")))
    fit = F.col("_fit")
    sound = ~fit["lost"] & fit["next"].isNotNull() & fit["used"].isNotNull() & (F.col("n") >= 3)
    values = {
        "b0": fit["used"]["b0"], "b1": fit["used"]["b1"], "v00": fit["next"]["v00"], "v01": fit["next"]["v01"], "v11": fit["next"]["v11"],
        "dispersion": fit["pearson"] / (F.col("n") - 2), "deviance": fit["deviance"],
    }
    return fitted.select(
        *keys, *[F.when(sound, values[c]).alias(c) for c in COEFFICIENTS], "low", "high", "n", fit["steps"].alias("steps"),
        (sound & fit["converged"]).alias("converged"))


def predictor_grid(coefficients: DataFrame, width: float = 0.5, low: float | None = None, high: float | None = None) -> DataFrame:
    """One row per coefficient row and grid point: a fixed range, or the fitted bins."""
    ends: list[Column] = [F.col("low") if low is None else F.lit(low), F.col("high") if high is None else F.lit(high)]
    index = grid_indices(bin_index(ends[0], width), bin_index(ends[1], width))
    return coefficients.withColumn("_i", F.explode(index)).withColumn("temp", bin_value(F.col("_i"), width)).drop("_i")


def logistic_cdf_predict(
    coefficients: DataFrame, keys: Sequence[str] = ("spp", "stage"), width: float = 0.5,
    low: float | None = None, high: float | None = None,
) -> DataFrame:
    """Fitted share with standard error and 95 % band on a grid.

    The band is on the response scale and is not clipped to [0, 1]. A group
    without a fit keeps its grid, with missing values; ``converged`` tells.
    """
    x = F.col("temp")
    spread = F.col("dispersion") * (F.col("v00") + 2 * x * F.col("v01") + x * x * F.col("v11"))
    fit = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * x)))
    grid = predictor_grid(coefficients, width, low, high)
    with_fit = grid.withColumn("prop", fit).withColumn("se", F.sqrt(spread) * F.col("prop") * (1 - F.col("prop")))
    lower, upper = normal_band(F.col("prop"), F.col("se"))
    return with_fit.select(*keys, "temp", "prop", "se", lower.alias("lower"), upper.alias("upper"), "converged")


def stage_comparison(curve: DataFrame, larval: Sequence[str], width: float = 0.5) -> DataFrame:
    """Egg and larva bands of each species, stacked with their stage label."""
    staged = with_stage(curve, larval)
    stages = [staged.filter(F.col("stage") == s) for s in ("Larvae", "Eggs")]
    bands = [logistic_cdf_predict(logistic_cdf_fit(s), width=width) for s in stages]
    return bands[0].unionByName(bands[1])
