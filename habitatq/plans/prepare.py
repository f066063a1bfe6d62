"""From the columns of raw survey files to the stations, catches and counts that the other plans take.

Inputs are tables read with ``sources.tables.read_survey_csv`` and the schemas in
``sources.schemas``; each function is one projection, with a join where two files meet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatq.functions.keys import lenient_double, plain_number, station_key
from habitatq.operators.clean import fix_labels


def larval_survey(raw: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """``LARVAL_SURVEY`` rows with their station key and temperature; sentinels stay for ``wide_to_occurrence``."""
    key = station_key(F.col("cruise_name"), F.col("station"))
    return raw.select(key.alias("cruise_station"), F.col("sfc_temp").alias("sst"), *taxa)


def coded_taxa(raw: DataFrame) -> DataFrame:
    """``CODED_TAXA`` rows keyed by the rounded station number, which drops leading zeros and fractions."""
    number = F.rint(lenient_double(F.col("station"))).cast("bigint")
    key = station_key(F.col("cruise_name"), number)
    return raw.select(key.alias("cruise_station"), F.col("taxa_ichthyo").alias("taxa_code"), "abundance")


def egg_counts(stations: DataFrame, hauls: DataFrame, temperatures: DataFrame) -> DataFrame:
    """``egg_count``, ``ihf`` and ``sst`` per count row of ``EGG_STATIONS``.

    Rows without a count or a haul factor go. Keys of ``HAUL_FACTORS`` may repeat, and rows then fan out.
    """
    number = plain_number(lenient_double(F.col("station")))
    counted = stations.filter(F.col("egg_count").isNotNull()).select(
        station_key(F.col("cruise_name"), number).alias("cruise_station"), lenient_double(F.col("egg_count")).alias("egg_count")
    )
    factor = haul_factors(hauls).filter(F.col("ihf").isNotNull())
    return counted.join(factor, "cruise_station").join(temperatures, "cruise_station", "left")


def haul_factors(raw: DataFrame) -> DataFrame:
    key = station_key(F.col("cruise_name"), plain_number(lenient_double(F.col("station"))))
    return raw.select(key.alias("cruise_station"), F.col("ich_haul_fctr").alias("ihf"))


def egg_identifications(raw: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """``EGG_IDS`` rows with key, name and diameter; ``labels`` corrects names."""
    number = plain_number(lenient_double(F.col("station")))
    named = fix_labels(raw, "common_name", labels)
    return named.select(
        station_key(F.col("cruise"), number).alias("cruise_station"), "common_name", lenient_double(F.col("egg_diameter_mm")).alias("diameter")
    )


def casts(raw: DataFrame) -> DataFrame:
    """``CASTS`` rows with key and temperature, for ``expansion.station_temperature``."""
    key = station_key(F.col("cruise_name"), plain_number(lenient_double(F.col("station"))))
    return raw.select(key.alias("cruise_station"), F.col("octemps_sfc_temp").alias("sst"))


def site_temperatures(raw: DataFrame) -> DataFrame:
    """``STATION_INFO`` rows that have a temperature, keyed by cruise and site."""
    temp = lenient_double(F.col("sst_ctd"))
    return raw.select(station_key(F.col("cruise_id"), F.col("station_id")).alias("cruise_station"), temp.alias("sst")).dropna(subset=["sst"])


def barcodes(raw: DataFrame) -> DataFrame:
    """``BARCODES`` columns that ``expansion.egg_stage_occurrence`` takes; a missing name is empty."""
    return raw.select("cruise_id", "station_id", "stage", F.coalesce("common_name", F.lit("")).alias("common_name"))
