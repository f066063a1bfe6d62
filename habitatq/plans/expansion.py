"""Survey preparation: coded taxa, wide surveys and subsampled egg counts.

Barcoded eggs are counted per station, name and size bin before anything is
joined. That count combines map-side, so a station holding a large part of
all eggs reaches the joins as a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitatq.functions.binning import ceil_bin_index
from habitatq.operators.aggregates import conditional_sums, poisoned_sum
from habitatq.operators.clean import floor_nonzero, sentinel_to_null, split_env_and_taxa
from habitatq.operators.joins import in_any, nearest_good_bin
from habitatq.operators.reshape import taxa_to_long

# Taxon codes of the genus and of its species.
GENUS_CODE = 170511100
PARU_CODE = 170511101
TRIACANTHUS_FROM = 170511102

STATION = "cruise_station"


def taxon_sums(coded: DataFrame) -> DataFrame:
    """One filtered abundance sum per taxon group and station.

    A missing abundance makes its sum missing; only ``pep_tri`` is then zeroed,
    so ``pep_all`` may stay missing.
    """
    code = F.col("taxa_code")
    sums = conditional_sums(
        coded,
        [STATION],
        "abundance",
        {"pep_sp": code == GENUS_CODE, "pep_par": code == PARU_CODE, "pep_tri": code >= TRIACANTHUS_FROM},
    )
    zeroed = sums.withColumn("pep_tri", F.coalesce("pep_tri", F.lit(0.0)))
    return zeroed.withColumn("pep_all", F.col("pep_tri") + F.col("pep_sp") + F.col("pep_par"))


def taxon_split_abundance(survey: DataFrame, coded: DataFrame) -> DataFrame:
    """Survey stations with their abundance split by taxon; stations without codes keep nulls."""
    return survey.join(taxon_sums(coded), STATION, "left")


def wide_to_occurrence(
    wide: DataFrame, taxa: Sequence[str], temp: str = "sst", ids: Sequence[str] = (STATION,), sentinel: float = 9999
) -> DataFrame:
    """Wide survey to long occurrence: sentinel blanked, absences 0, rows without temperature dropped."""
    clean = split_env_and_taxa(sentinel_to_null(wide, sentinel), [*ids, temp], taxa)
    return taxa_to_long(clean.filter(F.col(temp).isNotNull()), [*ids, temp], taxa)


def station_temperature(casts: DataFrame, *stations: DataFrame, temp: str = "sst") -> DataFrame:
    """Mean temperature per station, for stations named in any of the tables."""
    return in_any(casts.select(STATION, temp), STATION, *stations).groupBy(STATION).agg(F.avg(temp).alias(temp))


def egg_tally(eggs: DataFrame, per_unit: int = 20) -> DataFrame:
    """Eggs counted per station, name and size bin; a column ``n`` says how many eggs a row stands for."""
    each = F.col("n") if "n" in eggs.columns else F.lit(1)
    binned = eggs.select(STATION, "common_name", ceil_bin_index(F.col("diameter"), per_unit).alias("bin_idx"), each.alias("n"))
    return binned.groupBy(STATION, "common_name", "bin_idx").agg(F.sum("n").alias("n"))


def subsample_detection(tally: DataFrame, counts: DataFrame) -> DataFrame:
    """Barcoded against counted eggs per station; more counted than barcoded means subsampled.

    ``counts`` holds ``egg_count``, ``ihf`` and ``sst``. Only complete count rows
    are compared; without one the difference is missing and the station counts
    as fully barcoded.
    """
    barcoded = tally.groupBy(STATION).agg(F.sum("n").alias("barcoded_count"))
    complete = counts.dropna(subset=["egg_count", "ihf", "sst"]).select(STATION, "egg_count")
    temps = counts.filter(F.col("sst").isNotNull()).select(STATION).distinct()
    both = barcoded.join(complete, STATION, "left").join(temps, STATION, "left_semi")
    diff = F.col("egg_count") - F.col("barcoded_count")
    return both.withColumn("diff", diff).withColumn("subsampled", F.coalesce(diff > 0, F.lit(False)))


def size_bin_totals(sizes: DataFrame, per_unit: int = 20) -> DataFrame:
    """Size sheets at one row per station and bin.

    ``copies`` is the number of sheet rows of a bin, ``freq`` their total
    frequency (missing if any is), ``spare`` the total of the positive ones.
    """
    return _sheet_rows(sizes, per_unit).groupBy(STATION, "bin_idx").agg(*_bin_totals())


def _sheet_rows(sizes: DataFrame, per_unit: int = 20) -> DataFrame:
    total = F.col("unid_frequency") + F.col("id_frequency")
    index = F.rint(F.col("bin") * F.lit(float(per_unit))).cast("bigint")
    return sizes.select(STATION, index.alias("bin_idx"), total.cast("double").alias("tot"))


def _bin_totals() -> list[Column]:
    return [
        F.count("*").alias("copies"),
        poisoned_sum(F.col("tot")).alias("freq"),
        F.sum(F.when(F.col("tot") > 0, F.col("tot"))).alias("spare"),
    ]


def bins_with_target(tally: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sheet bins and egg counts of each station, with the good bin that takes their frequency.

    A bin is good if it has barcoded eggs. A bin with a frequency but no
    barcodes hands its frequency to the nearest good bin; empty bins are left
    out. Sheet rows and tally
    rows are stacked rather than joined, so one shuffle by station serves the
    totals of the sheets and all windows; a station has at most one row per bin and species.
    """
    at_bin = Window.partitionBy(STATION, "bin_idx")
    eggs = tally.filter(F.col("bin_idx").isNotNull()).select(STATION, "bin_idx", "common_name", "n")
    sheets = _sheet_rows(sizes).withColumn("sheet", F.lit(True))
    dealt = sheets.unionByName(eggs, allowMissingColumns=True).repartition(STATION)
    stacked = dealt.groupBy(STATION, "bin_idx", "common_name", "sheet").agg(F.sum("n").alias("n"), *_bin_totals())
    stacked = stacked.withColumns({c: F.when(F.col("sheet"), F.col(c)) for c in ("copies", "freq")})
    rows = stacked.withColumns({
        "sheet_rows": F.max("copies").over(at_bin),
        "total": F.max("freq").over(at_bin),
        "barcoded": F.sum("n").over(at_bin),
        "first_name": F.min("common_name").over(at_bin),
    })
    matters = F.col("barcoded").isNotNull() | F.col("spare").isNotNull()
    in_sheet = rows.filter(F.col("sheet_rows").isNotNull() & matters)
    return nearest_good_bin(in_sheet, STATION, "bin_idx", F.col("barcoded").isNotNull(), "first_name")


def nearest_bin_join(tally: DataFrame, sizes: DataFrame) -> DataFrame:
    """Unfilled bins (frequency, no barcodes) and the good bin nearest to each."""
    unfilled = F.col("barcoded").isNull() & F.col("spare").isNotNull() & F.col("target").isNotNull()
    return bins_with_target(tally, sizes).filter(unfilled).select(
        STATION, "bin_idx", F.col("target").alias("nearest_bin_idx"), F.col("spare").alias("moved_frequency")
    )


def size_stratified_expansion(tally: DataFrame, sizes: DataFrame) -> DataFrame:
    """Eggs per named species and station, expanded by size bin.

    ``n · frequency / barcoded`` per bin, where the frequency of unfilled bins
    has moved to the nearest good bin. Unnamed eggs count as barcoded but get
    no row of their own. ``tally`` should hold subsampled stations only.
    """
    spare = F.when(F.col("barcoded").isNull(), F.col("spare"))
    moved = F.coalesce(F.sum(spare).over(Window.partitionBy(STATION, "target")), F.lit(0.0))
    frequency = F.col("total") + F.col("sheet_rows") * F.col("moved")
    est = F.col("n") * frequency / (F.col("sheet_rows") * F.col("barcoded"))
    named = bins_with_target(tally, sizes).withColumn("moved", moved).filter(F.col("common_name").isNotNull())
    return named.withColumn("est", est).groupBy(STATION, "common_name").agg(poisoned_sum(F.col("est")).alias("tot"))


def proportional_expansion(tally: DataFrame, detection: DataFrame) -> DataFrame:
    """Eggs per species and station, scaled by counted over barcoded eggs."""
    per_name = tally.groupBy(STATION, "common_name").agg(F.sum("n").alias("n"))
    known = detection.select(STATION, "barcoded_count", "egg_count")
    tot = F.col("n") / F.col("barcoded_count") * F.col("egg_count")
    return per_name.join(known, STATION).select(STATION, "common_name", tot.alias("tot"))


def subsampled_tally(tally: DataFrame, detection: DataFrame) -> DataFrame:
    """Tally rows of subsampled stations."""
    return tally.join(detection.filter("subsampled").select(STATION), STATION, "left_semi")


def combined_expansion(tally: DataFrame, counts: DataFrame, sizes: DataFrame, floor_zero: bool = True) -> DataFrame:
    """Effort-normalised egg estimates of all stations.

    Fully barcoded stations keep their counts, subsampled ones with size sheets
    are expanded by size bin, the rest proportionally, once per count row if a
    station has several. Estimates of 0 become 1,
    then each is multiplied by the haul factor; temperature and factor must be
    known. ``tally`` and ``counts`` are read several times, so pass stored tables.
    """
    picked = subsample_detection(tally, counts).filter("subsampled").select(STATION, "barcoded_count", "egg_count")
    sheets = sizes.select(STATION).distinct().withColumn("sheet", F.lit(True))
    stations = picked.select(STATION).distinct().join(sheets, STATION, "left")
    tagged = tally.join(stations, STATION, "left")
    by_size = size_stratified_expansion(tagged.filter("sheet").select(*tally.columns), sizes)
    per_name = tagged.filter(F.col("sheet").isNull()).groupBy(STATION, "common_name").agg(F.sum("n").alias("n"))
    scaled = F.when(F.col("egg_count").isNull(), F.col("n").cast("double")).otherwise(
        F.col("n") / F.col("barcoded_count") * F.col("egg_count")
    )
    rest = per_name.join(picked, STATION, "left").select(STATION, "common_name", scaled.alias("tot"))
    stacked = rest.unionByName(by_size).filter(F.col("common_name").isNotNull())
    if floor_zero:
        stacked = stacked.withColumn("tot", floor_nonzero(F.col("tot")))
    known = counts.dropna(subset=["sst", "ihf"]).select(STATION, "sst", "ihf")
    return stacked.join(known, STATION).withColumn("est", F.col("tot") * F.col("ihf"))


def egg_stage_occurrence(
    barcodes: DataFrame,
    temperatures: DataFrame,
    species: Sequence[str],
    drop_cruises: Sequence[str],
    stage: str = "Egg",
) -> DataFrame:
    """Named eggs of the listed species counted per station, with temperature.

    ``barcodes`` holds ``cruise_id, station_id, stage, common_name`` with an
    empty name for unidentified fish, and ``n`` if a row stands for several.
    """
    kept = barcodes.filter(
        ~F.col("cruise_id").isin(*drop_cruises) & (F.col("stage") == stage) & F.col("common_name").isin(*species)
    )
    key = F.concat_ws("_", "cruise_id", "station_id").alias(STATION)
    counted = F.sum("n") if "n" in barcodes.columns else F.count("*")
    tally = kept.groupBy("cruise_id", "station_id", "common_name").agg(counted.alias("n"))
    return tally.select(key, "common_name", "n").join(temperatures, STATION, "left")
