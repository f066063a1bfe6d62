"""Bins, grids and rounding.

Bins travel as integer indices (``bigint``) and are turned into values only
for output, so ``-0.0`` and float noise can never split a group or a join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(value: Column, width: float = 0.5) -> Column:
    """Index of the nearest multiple of ``width``; ties go to the even index."""
    return F.rint(value / F.lit(float(width))).try_cast("bigint")


def bin_value(index: Column, width: float = 0.5) -> Column:
    """Bin position in the unit of the measured value."""
    return index.cast("double") * F.lit(float(width))


def half_degree_bin(value: Column) -> Column:
    """Value rounded to the nearest half, ties to even, without negative zero."""
    return bin_value(bin_index(value, 0.5), 0.5)


def ceil_bin_index(value: Column, per_unit: int = 20) -> Column:
    """Index of the bin whose upper edge is the next multiple of ``1/per_unit``."""
    return F.ceil(value * F.lit(float(per_unit))).try_cast("bigint")


def centred_bin_index(value: Column, width: float = 0.5) -> Column:
    """Histogram bin: centred on multiples of ``width``, closed on the right."""
    return F.ceil((value - F.lit(width / 2)) / F.lit(float(width))).try_cast("bigint")


def left_open_bin_index(value: Column, width: float = 0.5) -> Column:
    """Largest multiple of ``width`` strictly below the value, as an index."""
    return F.ceil(value / F.lit(float(width))).try_cast("bigint") - F.lit(1)


def interval_bucket(value: Column, breaks: Sequence[float]) -> Column:
    """Number of breaks at or above the value; null stays null.

    With the breaks in falling order, bucket 0 lies above the first one and
    bucket ``len(breaks)`` below the last.
    """
    hits = [F.when(value <= F.lit(float(b)), 1).otherwise(0) for b in breaks]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.when(value.isNotNull(), total)


def grid_indices(low: Column, high: Column) -> Column:
    """Array of all bin indices from ``low`` to ``high``; explode it for a grid."""
    return F.sequence(low.cast("bigint"), high.cast("bigint"))
