"""Dates, seasons, depth classes, densities and interval formulas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
Z_975 = 1.959963984540054
LAST_TWO_DIGIT_YEAR = 2068
SRID_WGS84 = 4326
ISOBATHS = (0, -50, -100, -500, -1000, -2000, -3000)


def day_mon_yy(text: Column) -> Column:
    """Date of ``5-Feb-77`` style text; years 69-99 are 19xx, 00-68 are 20xx."""
    day = F.try_to_timestamp(text, F.lit("d-MMM-yy")).cast("date")
    return F.when(F.year(day) > LAST_TWO_DIGIT_YEAR, F.add_months(day, -1200)).otherwise(day)


def season_of_month(month: Column) -> Column:
    """Season name; a missing month falls into the last class, as in the source analysis."""
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )


def depth_band(depth: Column, deep: float = -100.0, shallow: float = -15.0) -> Column:
    """``a`` from ``shallow`` up, ``b`` down to ``deep``, ``c`` below."""
    return F.when(depth >= shallow, "a").when(depth >= deep, "b").when(depth < deep, "c")


def keep_levels(label: Column, levels: Sequence[str]) -> Column:
    """The label where it is one of ``levels``, else null."""
    return F.when(label.isin(*levels), label)


def sea_mask(depth: Column, limit: float = 1.0) -> Column:
    """Depth with land (above ``limit``) blanked out."""
    return F.when(depth <= limit, depth)


def density_per_tow(count: Column, tow_depth: Column, radius: float = 0.3) -> Column:
    """``count / depth * radius^2 * pi``, from left to right."""
    return F.try_divide(count.cast("double"), tow_depth) * F.lit(radius**2) * F.lit(math.pi)


def density_per_volume(count: Column, tow_depth: Column, radius: float = 0.3) -> Column:
    """``count / (depth * pi * radius^2)``: individuals per volume swept."""
    return F.try_divide(count.cast("double"), tow_depth * F.lit(math.pi) * F.lit(radius**2))


def overlap_term(prop_samples: Column, prop_catch: Column) -> Column:
    """Geometric mean of effort and catch share in one bin."""
    return F.sqrt(prop_samples * prop_catch)


def normal_band(fit: Column, se: Column, z: float = Z_975) -> tuple[Column, Column]:
    """Lower and upper end of ``fit ± z·se``."""
    return fit - F.lit(z) * se, fit + F.lit(z) * se


def point_columns(lon: Column, lat: Column, srid: int = SRID_WGS84) -> list[Column]:
    """A point as two plain doubles and its reference-system number."""
    return [lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), F.lit(srid).alias("srid")]
