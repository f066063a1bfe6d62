"""One runnable query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from habitatq.catalog.adapters import LARVAL, NAMES, SPECIES, SURVEYS, TAXA, Views
from habitatq.functions import binning, exact, fields, keys
from habitatq.operators import aggregates, clean, joins, reshape, windows
from habitatq.plans import expansion, logistic, quotient, resampling, surveys
from habitatq.sources import schemas, tables

RUNS, POISSON_RUNS, PERMUTATIONS = 100, 100, 1000
SEED = 19
REGISTRY: dict[str, Callable[[Views], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: fn(Views(spark, folder))

    return {name: bind(fn) for name, fn in REGISTRY.items()}


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles that depend on summation order, cut to a comparable number of digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Sources and sinks ---------------------------------------------------------------


@query
def scan_survey_csv(v):
    out = v.stations().select("cruise_station", "data", "sst")
    wider = out.select(F.lit("bongo").alias("Gear Type"), F.col("sst").alias(" SST"), F.col("data").alias("Data"), "cruise_station")
    path = tables.write_table(wider, tables.scratch_path(v.spark, "survey"), "csv")
    return tables.read_survey_csv(v.spark, path, "cruise_station string, data string, sst double")


@query
def scan_sheet_set(v):
    sheets = v.table("customer").select(
        "c_mktsegment",
        (F.col("c_custkey") % 20 / 20.0).alias("bin"),
        F.col("c_nationkey").cast("double").alias("unid_frequency"),
        F.col("c_acctbal").alias("id_frequency"),
    )
    path = tables.write_table(sheets, tables.scratch_path(v.spark, "sheets"), "csv", ("c_mktsegment",))
    return tables.read_sheet_set(v.spark, path, schemas.SIZE_SHEET, "sheet", r"c_mktsegment=([^/]+)/")


@query
def sink_roundtrip(v):
    effort = quotient.effort_by_bin(v.stations())
    path = tables.write_table(effort, tables.scratch_path(v.spark, "effort"))
    back = v.spark.read.schema(effort.schema).parquet(path)
    return rounded(back, "prop_samples")


@query
def drop_rowname_column(v):
    named = v.stations().select(F.col("o_orderkey").alias("row_name"), "cruise_station", "sst")
    return tables.drop_rowname_column(named)


@query
def scan_cast_report(v):
    """What a scan loses: haul numbers with a letter behind them, hauls without a number."""
    visits = v.visits().select(F.substring("haul_id", 2, 9).alias("haul"), "cruise_id", "latitude")
    path = tables.write_table(visits, tables.scratch_path(v.spark, "visits"), "csv")
    schema, report = "haul int, cruise_id int, latitude double", Observation("visits")
    tables.stored(tables.read_survey_csv(v.spark, path, schema, report=report), "scan")
    return tables.cast_report(v.spark, report, schema)


@query
def sink_bucketed_join(v):
    """Egg tallies and temperatures stored by station bucket, then joined where they lie."""
    buckets = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    tally = tables.write_bucketed(expansion.egg_tally(v.eggs()), "tally", ["cruise_station"], buckets)
    temps = tables.write_bucketed(v.stations().select("cruise_station", "sst"), "temperatures", ["cruise_station"], buckets)
    return tally.join(temps.hint("merge"), "cruise_station", "left").groupBy("cruise_station", "sst").agg(F.sum("n").alias("n"))


@query
def scan_depth_grid(v):
    path = tables.write_depth_grid(v.grid(), tables.scratch_path(v.spark, "grid"), (-74.5, -71.0, 38.25, 41.5))
    return tables.read_depth_grid(v.spark, path, -74.5, -71.0, 38.25, 41.5)


# Projections, filters, cleaning --------------------------------------------------


@query
def project_columns(v):
    return v.wide().drop("promo_10m2").select("sst", "cruise_station", "data", "economy_10m2")


@query
def rename_columns(v):
    return v.eggs().withColumnsRenamed({"common_name": "Common Name", "diameter": "Egg Diameter (mm)"})


@query
def derive_columns(v):
    complete = v.counts().withColumns(
        {"temp_bin": binning.half_degree_bin(F.col("sst")), "est": F.col("egg_count") * F.col("ihf")}
    )
    return complete.select("cruise_station", "temp_bin", "est")


@query
def filter_predicates(v):
    c = v.counts()
    return c.filter((F.col("sst") >= 10) & (F.col("egg_count") > 3) | (F.col("ihf") == 0.5) & ~(F.col("egg_count") == 2))


@query
def filter_in_list(v):
    return v.occurrence().filter(F.col("spp").isin(SPECIES))


@query
def filter_not_in_list(v):
    return v.visits().filter(clean.not_in_or_null(F.col("haul_id"), ["E1B", "E25B"]))


@query
def filter_not_null(v):
    return v.counts().dropna(subset=["sst"])


@query
def drop_any_null(v):
    return v.counts().dropna(how="any")


@query
def sentinel_to_null(v):
    return clean.sentinel_to_null(v.wide(), 9999)


@query
def absence_to_zero(v):
    return clean.absence_to_zero(v.wide(), ["economy_10m2", "promo_10m2"])


@query
def split_env_and_taxa(v):
    return clean.split_env_and_taxa(clean.sentinel_to_null(v.wide(), 9999), ["cruise_station", "sst"], TAXA)


@query
def fix_labels(v):
    return clean.fix_labels(v.eggs(), "common_name", {"SMALL": "Small flounder", "LARGE": "Large flounder"})


@query
def harmonise_taxa(v):
    mapping = {("F", "SMALL"): "Silver Hake", ("O", "SMALL"): "Butterfish", ("P", "LARGE"): "Silver Hake"}
    return clean.harmonise_taxa(v.occurrence(), mapping)


@query
def harmonise_taxa_catchall(v):
    mapping = {(d, s): n for d in SURVEYS for s, n in (("SMALL", "Fourspot Flounder"), ("LARGE", "Silver Hake"))}
    return clean.harmonise_taxa(v.occurrence(), mapping, default="Gulfstream Flounder")


@query
def bbox_filter(v):
    return v.grid().filter(clean.in_box(F.col("lon"), F.col("lat"), -74.0, -72.0, 39.0, 40.5))


@query
def floor_nonzero(v):
    moved = v.counts().select("cruise_station", (F.col("egg_count") - 3).alias("tot"))
    return moved.select("cruise_station", clean.floor_nonzero(F.col("tot")).alias("tot"))


# Joins ---------------------------------------------------------------------------


@query
def left_join_station(v):
    temps = v.counts().dropna(subset=["ihf"]).select("cruise_station", "sst", "ihf")
    return joins.salted_left_join(v.eggs(), temps, ["cruise_station"])


@query
def left_join_multi_key(v):
    tally = v.barcodes().groupBy("cruise_id", "station_id").agg(F.count("*").alias("n"))
    deep = v.tows().filter(F.col("tow_depth") > 0)
    return tally.join(deep, ["cruise_id", "station_id"], "left")


@query
def left_join_waypoint(v):
    visited = v.visits().groupBy("station_id").agg(F.count("*").alias("n"))
    return visited.join(surveys.numbered_waypoints(v.waypoints()), "station_id", "left")


@query
def right_join_size_bins(v):
    tally = expansion.egg_tally(v.eggs())
    return tally.join(expansion.size_bin_totals(v.sizes()), ["cruise_station", "bin_idx"], "right")


@query
def semi_join_stations(v):
    deep = v.sizes().filter(F.col("id_frequency") > 1)
    return joins.in_any(v.stations(), "cruise_station", deep, v.counts().filter(F.col("egg_count") > 5))


@query
def anti_join_stations(v):
    return joins.not_in(v.eggs(), "cruise_station", v.sizes())


@query
def unmatched_audit(v):
    return joins.unmatched_keys(v.stations(), v.eggs(), "cruise_station")


@query
def nearest_bin_join(v):
    return expansion.nearest_bin_join(expansion.egg_tally(v.eggs()), v.sizes())


@query
def zero_filled_panel(v):
    return _panel(v)


def _panel(v: Views) -> DataFrame:
    stations = v.stations().filter(F.col("sst").isNotNull()).select("data", "cruise_station", "sst")
    return joins.zero_filled_panel(stations, v.occurrence(), SPECIES)


@query
def dimension_grid(v):
    surveyed = v.stations().select("data").distinct()
    return joins.with_each(surveyed, spp=SPECIES)


@query
def curve_ci_report(v):
    report = quotient.curve_ci_report(_curve(v), resampling.bootstrap_ci(_replicates(v)))
    return rounded(report, "q", "lower_ci", "upper_ci")


# Aggregations --------------------------------------------------------------------


@query
def tally_groups(v):
    return v.barcodes().groupBy("cruise_id", "stage", "station_id", "common_name").agg(F.count("*").alias("n"))


@query
def sum_by_group(v):
    return v.occurrence().groupBy("data", "spp").agg(F.sum("abd").alias("total"))


@query
def exact_sum_by_group(v):
    """Sums that are equal to the last bit however the rows lie."""
    items = v.table("lineitem").select("l_returnflag", (F.col("l_extendedprice") / 3.0).alias("x"), (F.col("l_discount") - 0.05).alias("y"))
    sums = exact.exact_sums(items, ["l_returnflag"], {"x": F.col("x"), "y": F.col("y")})
    return sums.select("l_returnflag", F.format_string("%.6f", "x").alias("x"), F.format_string("%.6f", "y").alias("y"))


@query
def conditional_sums(v):
    return expansion.taxon_sums(v.coded())


@query
def share_of_total(v):
    return aggregates.share_of_total(expansion.taxon_sums(v.coded()), "pep_tri", "pep_par", "share_tri")


@query
def mean_by_station(v):
    return v.casts().groupBy("cruise_station").agg(F.avg("sst").alias("sst"))


@query
def mean_of_distinct(v):
    return aggregates.mean_of_distinct(v.casts(), ["cruise_station"], "sst", "sst")


@query
def distinct_species_count(v):
    return v.barcodes().groupBy("cruise_id", "stage").agg(F.count_distinct("common_name").alias("count_sp"))


def _site_sketches(v: Views, value: str) -> DataFrame:
    """One sketch per cruise, stage and site, stored once and merged upwards."""
    return tables.stored(aggregates.distinct_sketches(v.barcodes(), ["cruise_id", "stage", "station_id"], value), "sketches")


@query
def distinct_species_sketched(v):
    """Richness by cruise and stage from stored site sketches; exact while a sketch holds few values."""
    return aggregates.merged_richness(_site_sketches(v, "common_name"), ["cruise_id", "stage"], "count_sp")


@query
def distinct_sites_sketched(v):
    """Sites per stage from sketches beside the exact count, and whether they agree within three standard errors."""
    per_cruise = aggregates.distinct_sketches(v.barcodes(), ["cruise_id", "stage"], "station_id")
    estimate = aggregates.merged_richness(tables.stored(per_cruise, "sketches"), ["stage"], "estimate")
    exact = v.barcodes().groupBy("stage").agg(F.count_distinct("station_id").alias("n_sites"))
    near = F.abs(F.col("estimate") - F.col("n_sites")) <= 3 * aggregates.sketch_error() * F.col("n_sites")
    return exact.join(estimate, "stage").select("stage", "n_sites", near.alias("within_error"))


@query
def distinct_rows(v):
    return v.barcodes().distinct()


@query
def quantile_by_group(v):
    catches = v.table("lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    groups = ["l_returnflag", "l_linestatus"]
    counted = tables.stored(aggregates.value_counts(catches, groups, "l_extendedprice"), "values")
    return rounded(aggregates.exact_quantiles(counted, groups, probs), *probs)


@query
def range_by_group(v):
    ends = v.occurrence().groupBy("data", "spp").agg(F.min("sst").alias("lower"), F.max("sst").alias("upper"))
    return ends.withColumn("range", F.col("upper") - F.col("lower"))


@query
def effort_proportions(v):
    return rounded(quotient.effort_by_bin(v.stations()), "prop_samples")


@query
def binned_histogram(v):
    index = binning.centred_bin_index(F.col("sst"), 0.5)
    inside = v.stations().filter(F.col("sst").between(-0.5, 22.0))
    counts = inside.groupBy("data", index.alias("bin_idx")).agg(F.count("*").alias("n"))
    return counts.select("data", binning.bin_value(F.col("bin_idx")).alias("sst_bin"), "n")


@query
def distinct_values(v):
    return v.visits().select("cruise_id").distinct()


# Windows -------------------------------------------------------------------------


@query
def total_over_partition(v):
    tally = v.visits().groupBy("station_id", "cruise_id").agg(F.count("*").alias("n"))
    return windows.group_totals(tally, ["station_id"], F.col("n"), "total")


@query
def normalise_over_partition(v):
    return rounded(_curve(v).select("data", "spp", "temp_bin", "q_norm"), "q_norm")


@query
def running_cdf(v):
    return rounded(_curve(v).select("data", "spp", "temp_bin", "cdf_q_norm"), "cdf_q_norm")


@query
def argmin_all_ties(v):
    rows = v.occurrence().filter(F.col("sst").isNotNull()).withColumn("temp_bin", binning.half_degree_bin(F.col("sst")))
    near = windows.argmin_all_ties(tables.stored(rows, "occurrence"), ["data", "spp"], F.abs(F.col("temp_bin") - 12.0))
    return near.select("data", "spp", "cruise_station", "temp_bin")


@query
def argmin_first(v):
    rows = v.occurrence().select("data", "spp", "cruise_station", F.abs(F.col("sst") - 12.0).alias("distance"))
    return windows.argmin_first(rows, ["data", "spp"], "distance", ["cruise_station"])


@query
def point_ids(v):
    return surveys.dated_points(v.points()).select("point_id", "cruise_station")


# Sorts and set operations --------------------------------------------------------


@query
def ordered_bins(v):
    return quotient.effort_by_bin(v.stations()).select("data", "bin_idx", "n").orderBy("data", "bin_idx")


@query
def seeded_shuffle(v):
    counted = v.counts().join(v.stations().select("cruise_station", "data"), "cruise_station")
    rows = tables.stored(counted.select("data", "cruise_station", "egg_count"), "counts")
    return windows.seeded_shuffle(rows, ["data"], ["cruise_station"], "egg_count", SEED, "shuffled")


@query
def union_surveys(v):
    wide = v.wide().select("cruise_station", "sst", F.lit("wide").alias("data"))
    sites = v.site_temperatures().select("cruise_station", "sst", F.lit("site").alias("data"))
    return wide.unionByName(sites)


# Reshape -------------------------------------------------------------------------


@query
def taxa_to_long(v):
    return reshape.taxa_to_long(v.wide(), ["cruise_station", "sst"], TAXA)


@query
def season_to_wide(v):
    visits = v.visits().select("station_id", F.substring("cruise_id", 4, 100).alias("season"), F.lit(1).alias("one"))
    return reshape.counts_to_wide(visits, ["station_id"], "season", "one", surveys.SEASON_CODES)


# Scalar functions ----------------------------------------------------------------


@query
def half_degree_bin(v):
    quarter = F.floor(F.col("sst") * 4) / 4.0
    return v.stations().select(
        "cruise_station",
        binning.bin_index(F.col("sst")).alias("bin_idx"),
        binning.half_degree_bin(quarter).alias("tie_bin"),
    )


@query
def ceil_size_bin(v):
    index = binning.ceil_bin_index(F.col("diameter"))
    return v.eggs().select("cruise_station", index.alias("bin_idx"), (index / F.lit(20.0)).alias("bin"))


@query
def round_digits(v):
    return _curve(v).select("data", "spp", "temp_bin", F.round("cdf_q_norm", 4).alias("round_cdf"))


@query
def station_key(v):
    station = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey").cast("double"))
    return v.table("orders").select(
        "o_orderkey", keys.station_key(F.col("o_orderpriority"), keys.plain_number(station)).alias("cruise_station")
    )


@query
def substring_codes(v):
    return v.visits().select(
        "haul_id", F.substring("station_id", 1, 1).alias("transect"), F.substring("cruise_id", 4, 100).alias("season")
    )


@query
def lenient_cast(v):
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return v.table("orders").select("o_orderkey", keys.lenient_double(text).alias("price"))


@query
def parse_day_mon_yy(v):
    return v.points().select("cruise_station", fields.day_mon_yy(F.col("date_text")).alias("date"))


@query
def date_parts(v):
    day = v.points().select("cruise_station", fields.day_mon_yy(F.col("date_text")).alias("date"))
    return day.select("cruise_station", F.month("date").alias("month"), F.year("date").alias("year"), F.dayofmonth("date").alias("day"))


@query
def season_of_month(v):
    month = F.when(F.col("o_orderkey") % 97 != 0, F.month("o_orderdate"))
    return v.table("orders").select("o_orderkey", fields.season_of_month(month).alias("season"))


@query
def depth_band(v):
    band = fields.depth_band(F.col("depth"))
    return v.grid().select("lon", "lat", "depth", band.alias("band"), fields.keep_levels(band, ["a"]).alias("level"))


@query
def sea_mask(v):
    return v.grid().select("lon", "lat", fields.sea_mask(F.col("depth")).alias("depth"))


@query
def isobath_bucket(v):
    return v.grid().select("lon", "lat", "depth", binning.interval_bucket(F.col("depth"), fields.ISOBATHS).alias("bucket"))


@query
def density_per_tow(v):
    n = v.barcodes().groupBy("cruise_id", "station_id").agg(F.count("*").alias("n"))
    tow = n.join(v.tows(), ["cruise_id", "station_id"], "left")
    return rounded(
        tow.select(
            "cruise_id", "station_id", "n",
            fields.density_per_tow(F.col("n"), F.col("tow_depth")).alias("density"),
            fields.density_per_volume(F.col("n"), F.col("tow_depth")).alias("density_by_volume"),
        ),
        "density", "density_by_volume",
    )


@query
def predictor_grid(v):
    ends = v.stations().groupBy("data").agg(F.min("sst").alias("low"), F.max("sst").alias("high"))
    by_data = logistic.predictor_grid(ends).select("data", "temp", F.lit("data").alias("kind"))
    fixed = logistic.predictor_grid(ends, low=-0.5, high=30.0).select("data", "temp", F.lit("fixed").alias("kind"))
    return by_data.unionByName(fixed)


@query
def sign_flip_lon(v):
    return v.visits().select("station_id", "latitude", (-F.col("longitude")).alias("longitude"))


@query
def niche_overlap_term(v):
    curve = quotient.spq_curve(v.occurrence(), v.stations(), SPECIES, overlap=True)
    return rounded(curve.select("data", "spp", "temp_bin", "niche"), "niche")


@query
def normal_ci(v):
    by_customer = v.table("orders").groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("fit"), (F.stddev("o_totalprice") / F.sqrt(F.count("*"))).alias("se")
    )
    lower, upper = fields.normal_band(F.col("fit"), F.col("se"))
    return rounded(by_customer.select("o_custkey", lower.alias("lower"), upper.alias("upper")), "lower", "upper", digits=4)


@query
def point_columns(v):
    return v.waypoints().select("waypoint", *fields.point_columns(F.col("longitude"), F.col("latitude")))


# Composites ----------------------------------------------------------------------


@query
def taxon_split_abundance(v):
    return expansion.taxon_split_abundance(v.stations().select("cruise_station", "data", "sst"), v.coded())


@query
def wide_survey_to_occurrence(v):
    return expansion.wide_to_occurrence(v.wide(), TAXA, ids=("cruise_station", "data"))


@query
def station_temperature(v):
    sheets = v.sizes().filter(F.col("id_frequency") > 1)
    return expansion.station_temperature(v.casts(), sheets, v.counts().filter(F.col("egg_count") > 5))


def _tally(v: Views) -> DataFrame:
    return tables.stored(expansion.egg_tally(v.eggs()), "tally")


def _counts(v: Views) -> DataFrame:
    return tables.stored(v.counts(), "counts")


@query
def subsample_detection(v):
    return expansion.subsample_detection(expansion.egg_tally(v.eggs()), _counts(v))


@query
def size_stratified_expansion(v):
    tally = _tally(v)
    sub = expansion.subsampled_tally(tally, expansion.subsample_detection(tally, _counts(v)))
    return rounded(expansion.size_stratified_expansion(sub, v.sizes()), "tot")


@query
def proportional_expansion(v):
    tally = _tally(v)
    picked = expansion.subsample_detection(tally, _counts(v)).filter("subsampled")
    return rounded(expansion.proportional_expansion(joins.not_in(tally, "cruise_station", v.sizes()), picked), "tot")


@query
def combined_expansion(v):
    out = expansion.combined_expansion(_tally(v), _counts(v), v.sizes())
    return rounded(out, "tot", "est")


@query
def egg_stage_occurrence(v):
    return expansion.egg_stage_occurrence(v.barcodes(), v.site_temperatures(), SPECIES, ["2103"])


def _surveys(v: Views) -> dict[str, DataFrame]:
    tally = tables.stored(expansion.egg_tally(v.eggs_counted()), "tally")
    counted = expansion.combined_expansion(tally, _counts(v), v.sizes())
    barcoded = expansion.egg_stage_occurrence(v.barcodes_counted(), v.site_temperatures(), SPECIES, ["2103"])
    return {
        "egg_counts": counted.select(F.col("common_name").alias("spp"), "cruise_station", "sst", F.col("est").alias("abd")),
        "egg_barcodes": barcoded.select(F.col("common_name").alias("spp"), "cruise_station", "sst", F.col("n").alias("abd")),
        "larvae": expansion.wide_to_occurrence(v.wide(v.occurrence(v.fish_counted())), TAXA),
    }


@query
def merge_surveys(v):
    return rounded(quotient.merge_occurrences(_surveys(v), NAMES), "abd")


def _merged_stations(v: Views, larval: DataFrame | None = None) -> DataFrame:
    effort = {
        "egg_counts": v.counts().dropna(subset=["egg_count", "ihf", "sst"]).select("cruise_station", "sst"),
        "egg_barcodes": v.site_temperatures(),
        "larvae": larval or v.stations().select("cruise_station", "sst"),
    }
    tagged = [df.select("cruise_station", "sst", F.lit(tag).alias("data")) for tag, df in effort.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query
def merge_surveys_effort(v):
    by_bin = quotient.effort_by_bin(_merged_stations(v))
    return rounded(by_bin.select(binning.bin_value(F.col("bin_idx")).alias("temp_bin"), "prop_samples", "data"), "prop_samples")


OF_INTEREST = sorted(set(NAMES.values()))


def _merged_catches(v: Views) -> DataFrame:
    return quotient.merge_occurrences(_surveys(v), NAMES, species=OF_INTEREST)


def _merged_curve(v: Views) -> DataFrame:
    return quotient.spq_curve(_merged_catches(v), _merged_stations(v), OF_INTEREST)


@query
def merged_curve(v):
    """The main chain: surveys merged, restricted to the species of interest, curve per survey and species."""
    return rounded(_merged_curve(v), "prop_samples", "prop_fish", "q", "q_norm", "cdf_q_norm", digits=5)


def _merged_panel(v: Views) -> DataFrame:
    """All stations of the three surveys for each species of interest; larval ones at the mean of their distinct temperatures."""
    larval = aggregates.mean_of_distinct(v.casts(), ["cruise_station"], "sst", "sst")
    stations = _merged_stations(v, larval).filter(F.col("sst").isNotNull())
    return joins.zero_filled_panel(stations, _merged_catches(v), OF_INTEREST)


@query
def merged_panel(v):
    return rounded(_merged_panel(v), "abd")


@query
def merged_quotient_ci(v):
    """The interval of the merged surveys."""
    draws = resampling.bootstrap_draws(_merged_panel(v), RUNS, SEED)
    ci = resampling.bootstrap_ci(resampling.bootstrap_quotient(resampling.bin_sums(draws)))
    return rounded(ci, "lower_ci", "upper_ci", digits=5)


@query
def merged_stage_comparison(v):
    """Egg and larva bands of the merged surveys; both egg surveys are pooled in one fit."""
    bands = logistic.stage_comparison(tables.stored(_merged_curve(v), "curve"), ["larvae"])
    return rounded(bands, "prop", "se", "lower", "upper", digits=4)


def _curve(v: Views) -> DataFrame:
    return quotient.spq_curve(v.occurrence(), v.stations(), SPECIES)


@query
def spq_curve(v):
    """With one species that no survey has caught."""
    curve = quotient.spq_curve(v.occurrence(), v.stations(), [*SPECIES, "ABSENT"])
    return rounded(curve, "prop_samples", "prop_fish", "q", "q_norm", "cdf_q_norm")


def _draws(v: Views) -> DataFrame:
    return resampling.bootstrap_draws(_panel(v), RUNS, SEED)


def _replicates(v: Views) -> DataFrame:
    return resampling.bootstrap_quotient(resampling.bin_sums(_draws(v)))


@query
def bootstrap_draws(v):
    """Draws counted by run, bin and abundance."""
    return _draws(v)


@query
def bootstrap_poisson(v):
    return resampling.bootstrap_poisson(_panel(v), POISSON_RUNS, SEED, unique=True)


@query
def poisson_quotient_ci(v):
    """The interval in the mode meant for large panels."""
    sums = resampling.bootstrap_poisson(_panel(v), POISSON_RUNS, SEED, unique=True)
    return rounded(resampling.bootstrap_ci(resampling.bootstrap_quotient(sums)), "lower_ci", "upper_ci")


@query
def bootstrap_quotient(v):
    return rounded(_replicates(v), "q")


@query
def bootstrap_ci(v):
    return rounded(resampling.bootstrap_ci(_replicates(v)), "lower_ci", "upper_ci")


@query
def thermal_range_by_run(v):
    return resampling.thermal_range_by_run(_replicates(v))


@query
def permutation_quotient_ci(v):
    by_station = resampling.abundance_by_station(v.stations(), v.occurrence(), SPECIES)
    runs = resampling.permutation_replicates(tables.stored(by_station, "by_station"), SPECIES, PERMUTATIONS, SEED)
    return rounded(resampling.permutation_ci(runs), "lower_ci", "upper_ci")


@query
def logistic_cdf_fit(v):
    fit = logistic.logistic_cdf_fit(logistic.with_stage(_curve(v), LARVAL))
    return rounded(fit.select("spp", "stage", "n", "b0", "b1", "v00", "v01", "v11", "dispersion", "low", "high"),
                   "b0", "b1", "v00", "v01", "v11", "dispersion", digits=4)


@query
def logistic_cdf_predict(v):
    fit = logistic.logistic_cdf_fit(logistic.with_stage(_curve(v), LARVAL))
    return rounded(logistic.logistic_cdf_predict(fit, low=-0.5, high=30.0), "prop", "se", "lower", "upper", digits=4)


@query
def stage_comparison(v):
    return rounded(logistic.stage_comparison(_curve(v), LARVAL), "prop", "se", "lower", "upper", digits=4)


@query
def cdf_quantile_crossing(v):
    return quotient.cdf_quantile_crossing(tables.stored(_curve(v), "curve"))


@query
def niche_width(v):
    return quotient.niche_width(quotient.cdf_quantile_crossing(tables.stored(_curve(v), "curve")))


@query
def station_season_effort(v):
    waypoints = surveys.numbered_waypoints(v.waypoints())
    return surveys.station_season_effort(v.visits(), waypoints, drop_hauls=["E1B", "E25B"])


@query
def station_season_effort_from_visits(v):
    kept = v.visits().filter(clean.not_in_or_null(F.col("haul_id"), ["E1B", "E25B"]))
    return surveys.station_season_effort(kept, surveys.station_positions(kept), drop_hauls=["E1B", "E25B"])


@query
def station_species_tally(v):
    return surveys.station_species_tally(v.barcodes(), surveys.numbered_waypoints(v.waypoints()), ["2103"], ["Juvenile"], ["LARGE"])


@query
def cruise_egg_density(v):
    return rounded(surveys.cruise_egg_density(v.barcodes(), v.tows(), "2105"), "density", "density_by_volume")


@query
def survey_points_by_season(v):
    points = tables.stored(surveys.dated_points(v.points()), "points")  # numbered once
    eggs = v.counts().dropna(subset=["egg_count", "ihf", "sst"]).select("cruise_station")
    placed = surveys.egg_station_points(eggs, points)
    return points.withColumn("kind", F.lit("survey")).unionByName(placed.withColumn("kind", F.lit("eggs")))
