"""Cleaning steps shared by all surveys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalised_name(name: str) -> str:
    """A column name in lower case, with blanks and punctuation as single underscores."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def normalise_names(df: DataFrame) -> DataFrame:
    """The table with normalised column names."""
    return df.toDF(*[normalised_name(c) for c in df.columns])


def not_in_or_null(value: Column, listed: Sequence) -> Column:
    """NOT IN that keeps missing values."""
    return ~value.isin(*listed) | value.isNull()


def sentinel_to_null(df: DataFrame, sentinel: float) -> DataFrame:
    """Blank a sentinel in every numeric and text column, in one projection."""
    text = str(int(sentinel)) if float(sentinel).is_integer() else str(sentinel)

    def clean(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.NumericType):
            return F.when(c != F.lit(sentinel), c).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.when(c != F.lit(text), c).alias(field.name)
        return c

    return df.select(*[clean(f) for f in df.schema.fields])


def absence_to_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing counts as true zeros, in the named columns only."""
    return df.fillna(0, subset=list(columns))


def split_env_and_taxa(df: DataFrame, env: Sequence[str], taxa: Sequence[str]) -> DataFrame:
    """Environment columns as they are, taxon columns zero-filled, nothing else."""
    filled = [F.coalesce(F.col(t), F.lit(0.0)).alias(t) for t in taxa]
    return df.select(*env, *filled)


def recode(value: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Exact-value recode by a literal map; unmapped values keep themselves or take ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(found, value if default is None else default)


def fix_labels(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Correct misspelt labels in place."""
    return df.withColumn(column, recode(F.col(column), mapping))


def harmonise_taxa(
    df: DataFrame,
    mapping: Mapping[tuple[str, str], str],
    data_col: str = "data",
    code_col: str = "spp",
    default: str | None = None,
) -> DataFrame:
    """Per-survey taxon codes to common names.

    ``mapping`` is keyed by ``(survey, code)``. A code without an entry keeps
    its text, or becomes ``default`` when one is given.
    """
    sep = "\u0001"
    flat = {sep.join(k): v for k, v in mapping.items()}
    pairs = [F.lit(x) for kv in flat.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), F.concat_ws(sep, data_col, code_col))
    rest = F.col(code_col) if default is None else F.lit(default)
    return df.withColumn(code_col, F.coalesce(found, rest))


def in_box(lon: Column, lat: Column, west: float, east: float, south: float, north: float) -> Column:
    """Points inside a closed lon/lat rectangle; two range filters that reach the scan."""
    return lon.between(west, east) & lat.between(south, north)


def floor_nonzero(value: Column) -> Column:
    """Estimates of exactly 0 become 1; missing stays missing."""
    return F.when(value == 0, F.lit(1.0)).otherwise(value.cast("double"))
