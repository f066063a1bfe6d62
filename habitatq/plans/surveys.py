"""Station and season summaries, tallies, densities and dated survey points."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatq.functions import fields
from habitatq.operators.clean import not_in_or_null
from habitatq.operators.reshape import counts_to_wide
from habitatq.operators.windows import dense_index

# Season codes of a cruise name (from its fourth character on),
# and hauls that are no survey visits.
SEASON_CODES = {"5": "spring", "2": "winter", "7": "summer", "9": "fall"}
EXTRA_HAULS = ("E01B", "E25B")


def numbered_waypoints(waypoints: DataFrame) -> DataFrame:
    """Waypoints whose id starts with a digit from 1 to 9, keyed as stations."""
    first = F.substring("waypoint", 1, 1)
    kept = waypoints.filter(first.isin(*"123456789"))
    return kept.select(F.col("waypoint").alias("station_id"), "latitude", "longitude")


def station_positions(visits: DataFrame) -> DataFrame:
    """Mean position per station from its visits, west-positive longitude turned negative."""
    return visits.groupBy("station_id").agg(
        F.avg("latitude").alias("latitude"), (-F.avg("longitude")).alias("longitude")
    )


def station_season_effort(
    visits: DataFrame,
    positions: DataFrame,
    seasons: Mapping[str, str] = SEASON_CODES,
    drop_hauls: Sequence[str] = EXTRA_HAULS,
) -> DataFrame:
    """Visits per station in total and per season, with the station's coordinates."""
    kept = visits.filter(not_in_or_null(F.col("haul_id"), drop_hauls))
    season = kept.select("station_id", F.substring("cruise_id", 4, 100).alias("season"), F.lit(1).alias("one"))
    wide = counts_to_wide(season, ["station_id"], "season", "one", seasons)
    return wide.join(positions, "station_id", "left")


def station_species_tally(
    barcodes: DataFrame,
    waypoints: DataFrame,
    drop_cruises: Sequence[str],
    drop_stages: Sequence[str],
    drop_names: Sequence[str],
) -> DataFrame:
    """Fish counted by cruise, stage, station and species, with coordinates.

    Rows with any missing field are dropped, an empty name counting as missing.
    """
    named = barcodes.withColumn("common_name", F.nullif("common_name", F.lit(""))).dropna(how="any")
    kept = named.filter(
        ~F.col("cruise_id").isin(*drop_cruises)
        & ~F.col("stage").isin(*drop_stages)
        & ~F.col("common_name").isin(*drop_names)
    )
    tally = kept.groupBy("cruise_id", "stage", "station_id", "common_name").agg(F.count("*").alias("n"))
    return tally.join(waypoints, "station_id", "left")


def cruise_egg_density(barcodes: DataFrame, tows: DataFrame, cruise: str, stage: str = "Egg") -> DataFrame:
    """Named fish of one cruise and stage counted per station, with density."""
    kept = barcodes.filter((F.col("cruise_id") == cruise) & (F.col("stage") == stage) & (F.col("common_name") != ""))
    tally = kept.groupBy("common_name", "cruise_id", "station_id").agg(F.count("*").alias("n"))
    n, depth = F.col("n"), F.col("tow_depth")
    return (
        tally.join(tows, ["cruise_id", "station_id"], "left")
        .withColumn("density", fields.density_per_tow(n, depth))
        .withColumn("density_by_volume", fields.density_per_volume(n, depth))
    )


def dated_points(survey: DataFrame) -> DataFrame:
    """Survey rows with date parts, season, point columns and a stable point id.

    The id is the survey tag and a number within the survey, in key-hash order.
    """
    day = survey.withColumn("date", fields.day_mon_yy(F.col("date_text")))
    parts = day.select(
        "data",
        "cruise_station",
        "date",
        F.month("date").alias("month"),
        F.year("date").alias("year"),
        F.dayofmonth("date").alias("day"),
        *fields.point_columns(F.col("lon"), F.col("lat")),
    )
    dated = parts.withColumn("season", fields.season_of_month(F.col("month")))
    numbered = dense_index(dated, ["data"], ["cruise_station"], "_i")
    number = (F.col("_i") + 1).cast("string")
    return numbered.withColumn("point_id", F.concat_ws("-", "data", number)).drop("_i")


def egg_station_points(stations: DataFrame, points: DataFrame) -> DataFrame:
    """Egg stations with the date, season and place of their survey row; unplaced ones dropped."""
    placed = points.filter(F.col("lat").isNotNull())
    return stations.join(placed, "cruise_station")
