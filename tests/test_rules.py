"""Hand-made cases for the rules that are easy to get wrong."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from habitatq.functions import binning, binomial, exact, fields, keys, permute
from habitatq.operators import aggregates, clean, joins, reshape, windows
from habitatq.plans import expansion, quotient, resampling, surveys
from habitatq.sources import tables


def rows(df, *order):
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=str)


def one_column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", expr(F.col("x"))).collect())]


def test_half_bins_go_to_even_and_have_no_negative_zero(spark):
    assert one_column(spark, [12.25, 12.75, -0.25, None], "double", binning.bin_index) == [24, 26, 0, None]
    values = one_column(spark, [12.25, 12.75, -0.25], "double", binning.half_degree_bin)
    assert [str(v) for v in values] == ["12.0", "13.0", "0.0"]


def test_bin_of_nan_is_missing(spark):
    assert one_column(spark, [float("nan"), 1.0], "double", binning.bin_index) == [None, 2]


def test_histogram_bins_are_closed_on_the_right(spark):
    idx = one_column(spark, [10.25, 10.26], "double", binning.centred_bin_index)
    assert [i / 2 for i in idx] == [10.0, 10.5]


def test_left_open_bins(spark):
    assert one_column(spark, [10.0, 10.1, 10.5], "double", binning.left_open_bin_index) == [19, 20, 20]


def test_isobath_buckets(spark):
    got = one_column(spark, [5.0, 0.0, -50.0, -75.0, -4000.0, None], "double",
                     lambda c: binning.interval_bucket(c, fields.ISOBATHS))
    assert got == [0, 1, 2, 2, 7, None]


def test_season(spark):
    got = one_column(spark, [12, 4, 7, 10, None], "int", fields.season_of_month)
    assert got == ["Winter", "Spring", "Summer", "Fall", "Fall"]


def test_two_digit_years(spark):
    got = one_column(spark, ["5-Feb-77", "5-Feb-24", "15-FEB-68", "29-Feb-72", "bad"], "string", fields.day_mon_yy)
    assert got == [dt.date(1977, 2, 5), dt.date(2024, 2, 5), dt.date(2068, 2, 15), dt.date(1972, 2, 29), None]


def test_depth_bands_and_levels(spark):
    bands = one_column(spark, [0.0, -15.0, -15.1, -100.0, -101.0, None], "double", fields.depth_band)
    assert bands == ["a", "a", "b", "b", "c", None]
    assert one_column(spark, ["a", "b", None], "string", lambda c: fields.keep_levels(c, ["a", ""])) == ["a", None, None]
    assert one_column(spark, [2.0, 1.0, -3.0, None], "double", fields.sea_mask) == [None, 1.0, -3.0, None]


def test_density_from_left_to_right(spark):
    df = spark.createDataFrame([(10, 5.0), (10, 0.0), (10, None)], "n bigint, d double")
    got = [r[0] for r in df.select(fields.density_per_tow(F.col("n"), F.col("d"))).collect()]
    assert round(got[0], 6) == 0.565487 and got[1:] == [None, None]


def test_station_key(spark):
    df = spark.createDataFrame([("c", 12.0), ("c", None), ("c", 12.5)], "cruise string, station double")
    got = df.select(keys.station_key(F.col("cruise"), keys.plain_number(F.col("station")))).collect()
    assert [r[0] for r in got] == ["c_12", "c_NA", "c_12.5"]


def test_lenient_number(spark):
    assert one_column(spark, ["007", " 1.5 ", "n/a", None], "string", keys.lenient_double) == [7.0, 1.5, None, None]


def test_not_in_keeps_missing(spark):
    df = spark.createDataFrame([("E01B",), ("E25B",), (None,), ("E02",)], "id string")
    assert rows(df.filter(clean.not_in_or_null(F.col("id"), ["E01B", "E25B"]))) == [("E02",), (None,)]


def test_sentinel_in_numbers_and_text(spark):
    df = spark.createDataFrame([(9999.0, 9999, "9999", True), (1.0, 2, "x", False)], "a double, b int, c string, d boolean")
    got = rows(clean.sentinel_to_null(df, 9999))
    assert got == [(1.0, 2, "x", False), (None, None, None, True)]


def test_names_are_normalised(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Genus species` int, `Latitude ` int, `Egg Diameter (mm)` int")
    assert clean.normalise_names(df).columns == ["genus_species", "latitude", "egg_diameter_mm"]


def test_recode_keeps_or_defaults(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", None)], "data string, spp string")
    m = {("a", "x"): "Ex"}
    assert rows(clean.harmonise_taxa(df, m)) == [("a", "Ex"), ("a", "y"), ("b", "x"), ("b", None)]
    assert ("b", "rest") in rows(clean.harmonise_taxa(df, m, default="rest"))
    assert rows(clean.fix_labels(df, "spp", {"y": "why"})) == [("a", "why"), ("a", "x"), ("b", "x"), ("b", None)]


def test_floor_keeps_missing(spark):
    assert one_column(spark, [0.0, 2.0, None], "double", clean.floor_nonzero) == [1.0, 2.0, None]


def test_poisoned_sum(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 1, 2.0), ("s", 2, 3.0), ("s", None, 7.0)], "k string, code int, v double")
    got = aggregates.conditional_sums(df, ["k"], "v", {"one": F.col("code") == 1, "two": F.col("code") == 2, "no": F.col("code") == 9})
    assert rows(got, "one", "two", "no") == [(None, 3.0, 0.0)]


def test_mean_of_distinct(spark):
    df = spark.createDataFrame([("s", 10.0), ("s", 10.0), ("s", 13.0)], "k string, t double")
    assert rows(aggregates.mean_of_distinct(df, ["k"], "t", "t")) == [("s", 11.5)]


def test_replicate_quantiles_skip_nan(spark):
    df = spark.createDataFrame([("s", v) for v in (1.0, 2.0, 3.0, 4.0, None, float("nan"))], "k string, q double")
    assert rows(aggregates.replicate_quantiles(df, ["k"], "q", {"lo": 0.05}))[0][1] == pytest.approx(1.15)


@pytest.mark.parametrize(("most", "slices"), [(4096, 256), (20, 4), (3, 16)])
def test_exact_quantiles_match_percentile_on_skewed_groups(spark, most, slices):
    base = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.when(F.col("id") % 5 == 0, F.lit(1.0)).when(F.col("id") % 11 == 0, F.lit(None))
        .otherwise(F.pow(F.col("id") % 97, 3.0)).alias("v"),
    )
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}
    got = aggregates.exact_quantiles(aggregates.value_counts(base, ["k"], "v").cache(), ["k"], probs, most, slices)
    want = base.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()])
    got, want = rows(got), rows(want)
    assert len(got) == len(want) > 3
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:])


def test_rank_ranges_are_small_in_a_hot_group(spark):
    """Every range has few values, and the ranks they hold are those of the sorted group."""
    counted = spark.range(60_000).select(F.lit("hot").alias("k"), (F.pow(F.col("id"), 1.5)).alias("_v"), (F.col("id") % 3 + 1).alias("_m")).cache()
    ranks = spark.createDataFrame([("hot", r) for r in (0, 1, 59_999, 60_000, 119_999)], "k string, _rank long")
    got = aggregates.rank_ranges(counted, ["k"], ranks, most=50, slices=16).collect()
    values = sorted((r["_v"], r["_m"]) for r in counted.collect())
    assert sorted(r["_rank"] for r in got) == [0, 1, 59_999, 60_000, 119_999]
    for r in got:
        inside = [m for v, m in values if r["_low"] <= v <= r["_high"]]
        before = sum(m for v, m in values if v < r["_low"])
        assert len(inside) <= 50 and r["_before"] == before <= r["_rank"] < before + sum(inside)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_exact_sums_are_those_of_whole_numbers(spark, parts):
    rng = random.Random(5)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(300)]
    rows_in = [("wide", v) for v in values] + [("cents", rng.randrange(10**7) / 100) for _ in range(3000)]
    rows_in += [("tiny", v) for v in (5e-324, 5e-324, -1e-310)] + [("cancel", v) for v in (1e300, 1.0, -1e300)] + [("zero", 0.0), ("zero", -0.0)]
    rows_in += [("none", None), ("one", None), ("one", 3.25), ("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("top", 1.7976931348623157e308)]
    got = {r.k: r.x for r in exact.exact_sums(spark.createDataFrame(rows_in, "k string, x double").repartition(parts), ["k"], {"x": F.col("x")}).collect()}
    for k in ("wide", "cents", "tiny", "cancel", "zero", "one", "top"):
        whole = math.fsum(v for key, v in rows_in if key == k and v is not None)
        assert got[k] == pytest.approx(whole, rel=4e-16, abs=0), k
    assert math.isnan(got["nan"]) and got["inf"] == math.inf and got.get("none") is None
    EXACT_SUMS.setdefault("first", {k: v for k, v in got.items() if k != "nan"})
    assert {k: v for k, v in got.items() if k != "nan"} == EXACT_SUMS["first"]


EXACT_SUMS: dict = {}


def test_unlisted_seasons_are_reported(spark):
    df = spark.createDataFrame([("s", "5", 2), ("s", "3", 1), ("s", None, 1)], "k string, c string, n int")
    got = reshape.counts_to_wide(df, ["k"], "c", "n", {"5": "spring", "2": "winter"})
    assert rows(got, "k", "total", "spring", "winter", "other") == [("s", 4, 2, 0, 2)]


def test_dense_index_is_dense_and_ordered_by_hash(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.concat(F.lit("k"), "id").alias("k"))
    for digits in (1, 3):
        got = windows.dense_index(df, ["g"], ["k"], "i", digits=digits).collect()
        for g in range(3):
            mine = sorted((r for r in got if r.g == g), key=lambda r: r.i)
            assert [r.i for r in mine] == list(range(len(mine)))
            assert [r.k for r in mine] == sorted((r.k for r in mine), key=lambda k: hashlib.md5(k.encode()).hexdigest())


def test_shuffle_moves_the_same_values(spark):
    df = spark.range(200).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    got = windows.seeded_shuffle(df, ["g"], ["k"], "v", 7, "w").collect()
    assert sorted(r.w for r in got) == list(range(200)) and sum(r.v == r.w for r in got) < 20


def test_argmin_first_and_ties(spark):
    df = spark.createDataFrame([("k", 2.0, "b"), ("k", 2.0, "a"), ("k", 2.0, None), ("k", 3.0, "c"), ("k", None, "d")], "k string, d double, n string")
    assert rows(windows.argmin_first(df, ["k"], "d", ["n"]), "d", "n") == [(2.0, "a")]
    assert len(windows.argmin_all_ties(df, ["k"], F.col("d")).collect()) == 3


def test_group_totals_match_missing_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 4)], "k string, n int")
    assert rows(windows.group_totals(df, ["k"], F.col("n"), "t"), "n", "t") == [(1, 3), (2, 3), (4, 4)]


def test_salted_join_equals_left_join(spark):
    left = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.col("id").cast("string")).alias("k"),
        F.lit(1).alias("same"),
    ).repartition(6)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("4", 3), ("5", 4), ("7000", 5)], "k string, v int")
    got = joins.salted_left_join(left, right, ["k"], hot_share=0.05, salts=4, min_rows=0)
    assert rows(got.groupBy("k", "v").count()) == rows(left.join(right, "k", "left").groupBy("k", "v").count())


def test_unique_guard(spark):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert joins.assert_unique(good, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        joins.assert_unique(good.union(good), ["k"]).collect()


def test_panel_is_zero_filled(spark):
    st = spark.createDataFrame([("F", "a", 1.0), ("F", "b", 2.0)], "data string, cruise_station string, sst double")
    catch = spark.createDataFrame([("F", "a", "X", 3.0), ("F", "a", "Z", 9.0)], "data string, cruise_station string, spp string, abd double")
    got = rows(joins.zero_filled_panel(st, catch, ["X", "Y"]), "cruise_station", "spp", "abd")
    assert got == [("a", "X", 3.0), ("a", "Y", 0.0), ("b", "X", 0.0), ("b", "Y", 0.0)]


# Quotients ------------------------------------------------------------------------


def effort(spark, extra=()):
    temps = [10.0, 10.0, 11.0, 11.0, *extra]
    return spark.createDataFrame([("F", f"s{i}", t) for i, t in enumerate(temps)], "data string, cruise_station string, sst double")


def catches(spark, *items):
    return spark.createDataFrame([("F", "X", t, n) for t, n in items], "data string, spp string, sst double, abd double")


def curve(spark, caught, species=("X",), extra=()):
    return rows(quotient.spq_curve(caught, effort(spark, extra), species), "spp", "temp_bin", "prop_samples", "prop_fish", "q", "q_norm", "cdf_q_norm")


def test_quotient(spark):
    got = curve(spark, catches(spark, (10.0, 3.0), (11.0, 1.0)))
    assert got == [("X", 10.0, 0.5, 0.75, 1.5, 0.75, 0.75), ("X", 11.0, 0.5, 0.25, 0.5, 0.25, 1.0)]


def test_quotient_counts_catch_without_temperature(spark):
    got = curve(spark, catches(spark, (10.0, 3.0), (11.0, 1.0), (None, 4.0)))
    assert got == [("X", 10.0, 0.5, 0.375, 0.75, 0.75, 0.75), ("X", 11.0, 0.5, 0.125, 0.25, 0.25, 1.0)]


def test_absent_species_and_catch_outside_effort(spark):
    got = curve(spark, catches(spark, (10.0, 1.0), (20.0, 1.0)), ["X", "Y"], extra=[None])
    assert got[0][:5] == ("X", 10.0, 0.5, 0.5, 1.0)
    assert got[2:] == [("Y", 10.0, 0.5, 0.0, 0.0, None, None), ("Y", 11.0, 0.5, 0.0, 0.0, None, None)]


def test_quotient_bin_with_missing_abundance_counts_as_zero(spark):
    got = curve(spark, catches(spark, (10.0, 3.0), (11.0, 1.0), (11.0, None)))
    assert [r[3] for r in got] == [0.75, 0.0]


def test_crossing_keeps_ties(spark):
    df = spark.createDataFrame([("F", "X", 10.0, 0.06), ("F", "X", 11.0, 0.06), ("F", "X", 12.0, 0.30), ("F", "X", 13.0, 1.0)],
                               "data string, spp string, temp_bin double, cdf_q_norm double")
    cross = quotient.cdf_quantile_crossing(df)
    assert rows(cross.filter("quant = 0.05"), "temp_bin") == [(10.0,), (11.0,)]
    assert rows(quotient.niche_width(cross), "width") == [(2.5,)]


def test_result_does_not_depend_on_partitions(spark):
    caught = catches(spark, *[(10.0 + i % 2, float(i)) for i in range(50)])
    assert curve(spark, caught.repartition(1)) == curve(spark, caught.repartition(13))


# Egg expansion --------------------------------------------------------------------


def tally(spark, *items):
    return spark.createDataFrame([("s", n, b, c) for n, b, c in items], "cruise_station string, common_name string, bin_idx bigint, n bigint")


def sheets(spark, *items):
    return spark.createDataFrame([("s", b / 20, f, 0.0) for b, f in items], "cruise_station string, bin double, unid_frequency double, id_frequency double")


def expanded(t, s):
    return dict(rows(expansion.size_stratified_expansion(t, s), "common_name", "tot"))


def test_nearest_bin(spark):
    t, s = tally(spark, ("A", 2, 1), ("B", 5, 1)), sheets(spark, (2, 4.0), (5, 2.0), (3, 6.0))
    assert expanded(t, s) == {"A": 10.0, "B": 2.0}
    assert rows(expansion.nearest_bin_join(t, s), "bin_idx", "nearest_bin_idx") == [(3, 2)]


def test_nearest_bin_tie_goes_by_name_then_bin(spark):
    s = sheets(spark, (2, 1.0), (4, 1.0), (3, 6.0))
    assert expanded(tally(spark, ("B", 2, 1), ("A", 4, 1)), s) == {"A": 7.0, "B": 1.0}
    assert expanded(tally(spark, ("A", 2, 1), ("A", 4, 1), ("B", 4, 1)), s) == {"A": 7.0 + 0.5, "B": 0.5}
    assert expanded(tally(spark, (None, 2, 1), ("A", 4, 1)), s) == {"A": 7.0}


def test_no_good_bin_gives_no_rows(spark):
    assert expanded(tally(spark, ("A", 9, 1)), sheets(spark, (2, 1.0), (3, 6.0))) == {}


def test_unnamed_eggs_take_their_share(spark):
    assert expanded(tally(spark, ("A", 2, 1), (None, 2, 3)), sheets(spark, (2, 8.0))) == {"A": 2.0}


def test_repeated_sheet_rows_expand_like_joined_rows(spark):
    # Two sheet rows for bin 2: n·4/(2n) + n·6/(2n), each raised by the spare frequency 10 of bin 3.
    got = expanded(tally(spark, ("A", 2, 1)), sheets(spark, (2, 4.0), (2, 6.0), (3, 10.0)))
    assert got == {"A": (4 + 10) / 2 + (6 + 10) / 2}


def test_proportional_and_combined(spark):
    t = tally(spark, ("A", 2, 3), ("B", 2, 1))
    counts = spark.createDataFrame([("s", 10.0, 8, 0.5)], "cruise_station string, sst double, egg_count bigint, ihf double")
    none = sheets(spark, (2, 1.0)).limit(0)
    det = expansion.subsample_detection(t, counts)
    assert rows(det, "barcoded_count", "egg_count", "diff", "subsampled") == [(4, 8, 4, True)]
    assert rows(expansion.proportional_expansion(t, det), "common_name", "tot") == [("A", 6.0), ("B", 2.0)]
    assert rows(expansion.combined_expansion(t, counts, none), "common_name", "tot", "est") == [("A", 6.0, 3.0), ("B", 2.0, 1.0)]
    sized = expansion.combined_expansion(t, counts, sheets(spark, (2, 8.0)))
    assert rows(sized, "common_name", "tot") == [("A", 6.0), ("B", 2.0)]


def test_station_with_unknown_count_is_not_subsampled(spark):
    t = tally(spark, ("A", 2, 3))
    counts = spark.createDataFrame([("s", 10.0, None, 2.0)], "cruise_station string, sst double, egg_count bigint, ihf double")
    assert rows(expansion.combined_expansion(t, counts, sheets(spark, (2, 8.0))), "tot", "est") == [(3.0, 6.0)]


def test_expansion_keeps_the_total_frequency(spark):
    t = tally(spark, ("A", 2, 1), ("B", 5, 2), ("A", 5, 1), ("C", 9, 4))
    s = sheets(spark, *[(b, float(b % 4)) for b in range(1, 13)])
    total = sum(b % 4 for b in range(1, 13))
    assert sum(expanded(t, s).values()) == pytest.approx(total)


# Resampling -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def panel(spark):
    return spark.range(300).select(
        F.lit("F").alias("data"), F.lit("X").alias("spp"), F.concat(F.lit("s"), "id").alias("cruise_station"),
        (F.col("id") % 10 / 2.0).alias("sst"), F.when(F.col("id") % 4 == 0, F.col("id") % 7).otherwise(0).cast("double").alias("abd"),
    ).cache()


def test_each_run_draws_as_many_rows_as_the_panel_has(spark, panel):
    draws = resampling.bootstrap_draws(panel, 4)
    assert rows(draws.groupBy("run").agg(F.sum("n"))) == [(r, 300) for r in (1, 2, 3, 4)]
    sums = resampling.bin_sums(draws)
    assert sums.agg(F.sum("n_samples")).first()[0] == 1200
    q = resampling.bootstrap_quotient(sums)
    ci = resampling.bootstrap_ci(q).collect()
    assert all(r.lower_ci <= r.upper_ci for r in ci)
    assert all(r.range == r.upper - r.lower for r in resampling.thermal_range_by_run(q).collect())


@pytest.mark.parametrize("block_values", [1024, 2])
def test_draws_do_not_depend_on_partitions(spark, panel, block_values):
    a, b = (rows(resampling.bootstrap_draws(panel.repartition(n), 2, block_values=block_values)) for n in (1, 9))
    assert a == b
    whole = {(r.bin_idx, r.abd) for r in panel.select((F.col("sst") * 2).cast("long").alias("bin_idx"), "abd").distinct().collect()}
    assert {(x[3], x[4]) for x in a} <= whole


@pytest.mark.parametrize("block_values", [1024, 2])
def test_draws_have_the_moments_of_drawing_rows(spark, panel, block_values):
    """Counts of one row kind among n draws of n rows are binomial: mean w and variance w (1 - w / n)."""
    runs = 600
    draws = resampling.bootstrap_draws(panel, runs, block_values=block_values).groupBy("bin_idx", "abd").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn")).collect()
    kinds = {(r.bin_idx, r.abd): r.w for r in panel.groupBy((F.col("sst") * 2).cast("long").alias("bin_idx"), "abd").agg(F.count("*").alias("w")).collect()}
    assert sum(r.n for r in draws) == 300 * runs
    for r in draws:
        w = kinds[r.bin_idx, r.abd]
        spread = w * (1 - w / 300)
        mean = r.n / runs
        assert abs(mean - w) < 4.5 * (spread / runs) ** 0.5
        assert r.nn / runs - mean * mean == pytest.approx(spread, rel=0.35)


@pytest.mark.parametrize(("n", "part", "whole"), [(0, 1, 2), (5, 3, 3), (9, 1, 3), (40, 39, 100), (1000, 5, 1000), (60_000, 300, 1000), (90_000, 999, 1000)])
def test_binomial(spark, n, part, whole):
    size = 6000
    of = [F.lit(x).cast("long") for x in (n, part, whole)]
    drawn = binomial.binomial(*of, lambda j: F.md5(F.concat_ws("|", F.col("id"), j.cast("string")).cast("binary")))
    got = [r[0] for r in spark.range(size).select(drawn).collect()]
    p = part / whole
    spread = n * p * (1 - p)
    mean = sum(got) / size
    assert all(0 <= k <= n for k in got) and abs(mean - n * p) <= 4.5 * (spread / size) ** 0.5
    assert sum((k - mean) ** 2 for k in got) / size == pytest.approx(spread, rel=0.12)


def permuted_by_hand(i: int, n: int, base: int, run: int) -> int:
    (p, q), (f, g) = permute.PRIMES, permute.FACTORS

    def scrambled(x):
        y = (x + 1) * f % p
        return (y * y % q + y) * g % p

    a = math.ceil(math.sqrt(n))
    b = -(-n // a)
    keys = [scrambled(scrambled(base + run * 64 + k) + run) for k in range(permute.ROUNDS)]
    while True:
        high, low = divmod(i, b)
        for k, key in enumerate(keys):
            if k % 2:
                low = (low + scrambled(key + high)) % b
            else:
                high = (high + scrambled(key + low)) % a
        i = high * b + low
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1001])
def test_permutations_are_bijections(spark, n):
    numbers = spark.range(n).select("id", F.lit(n).cast("long").alias("n"), permute.run_keys(F.lit(77).cast("long"), 20).alias("keys"))
    got = permute.with_permuted(numbers, "id", "n", "keys", "to").select("run", "id", "to").collect()
    by_run: dict = {}
    for r in got:
        by_run.setdefault(r.run, {})[r.id] = r.to
        assert r.to == permuted_by_hand(r.id, n, 77, r.run)
    assert len(by_run) == 20 and all(sorted(x.values()) == list(range(n)) for x in by_run.values())
    if n == 1001:  # each place is as likely: tenths of ids against tenths of places
        cells = [[0] * 10 for _ in range(10)]
        for r in got:
            cells[r.id * 10 // n][r.to * 10 // n] += 1
        expected = len(got) / 100
        assert sum((c - expected) ** 2 / expected for row in cells for c in row) < 160


def test_poisson_weights_have_unit_mean(spark, panel):
    sums = resampling.bootstrap_poisson(panel, 20)
    assert sums.agg(F.sum("n_samples")).first()[0] == pytest.approx(6000, rel=0.05)


def test_permutation_keeps_totals_and_matches_brute_force(spark):
    st = spark.range(60).select(F.lit("F").alias("data"), F.col("id").cast("string").alias("cruise_station"), (F.col("id") * 7 % 12 / 4.0).alias("sst"))
    caught = spark.range(60).filter("id % 3 = 0").select(
        F.lit("F").alias("data"), F.col("id").cast("string").alias("cruise_station"), F.lit("X").alias("spp"), (F.col("id") + 1.0).alias("abd"))
    by_station = resampling.abundance_by_station(st, caught, ["X", "Y"])
    got = resampling.permutation_replicates(by_station, ["X", "Y"], 3, seed=5).collect()

    temps = {r.cruise_station: r.sst for r in st.collect()}
    amount = {r.cruise_station: r.abd for r in caught.collect()}
    bins = sorted({round(t * 2) for t in temps.values()})

    def edge(t):
        below = [b for b in bins if b / 2 < t]
        return below[-1] if below and below[-1] != bins[-1] else None

    seats = sorted((edge(t) for t in temps.values()), key=lambda e: (e is not None, e or 0))
    for run in (1, 2, 3):
        base = int(hashlib.md5(b"5|F").hexdigest()[:15], 16) % permute.PRIMES[0]
        numbered = sorted(temps, key=lambda s: hashlib.md5(s.encode()).hexdigest())
        fish = dict.fromkeys(bins, 0.0)
        for number, s in enumerate(numbered):
            seat = seats[permuted_by_hand(number, 60, base, run)]
            if seat is not None:
                fish[seat] += amount.get(s, 0.0)
        for b in bins:
            inside = sum(e == b for e in seats)
            mine = next(r.q for r in got if r.spp == "X" and r.run == run and r.temp_bin == b / 2)
            if inside == 0:
                assert mine is None
            else:
                assert mine == pytest.approx(fish[b] / sum(amount.values()) / (inside / 60))
    assert all(r.q is None for r in got if r.spp == "Y")
    ci = resampling.permutation_ci(spark.createDataFrame(got)).filter("spp = 'X'").orderBy("temp_bin").collect()
    assert ci[-1].lower_ci is None and ci[0].lower_ci is not None


# Surveys --------------------------------------------------------------------------


def test_season_effort_reports_everything(spark):
    visits = spark.createDataFrame(
        [("E1", "2105", "1"), (None, "2105", "1"), ("E01B", "2105", "1"), ("E2", "2103", "1"), ("E3", "2109", "WF")],
        "haul_id string, cruise_id string, station_id string")
    way = spark.createDataFrame([("1", 40.0, -73.0), ("WF", 41.0, -72.0)], "waypoint string, latitude double, longitude double")
    got = surveys.station_season_effort(visits, surveys.numbered_waypoints(way))
    assert rows(got, "station_id", "total", "spring", "fall", "other", "latitude") == [("1", 3, 2, 0, 1, 40.0), ("WF", 1, 0, 1, 0, None)]


def test_species_tally_drops_missing_and_excluded(spark):
    codes = spark.createDataFrame(
        [("2105", "1", "Egg", "A"), ("2105", "1", "Egg", "A"), ("2105", "1", "Egg", ""), ("2105", None, "Egg", "A"),
         ("2103", "1", "Egg", "A"), ("2105", "1", "Juvenile", "A"), ("2105", "1", "Egg", "Cusk-Eel sp.")],
        "cruise_id string, station_id string, stage string, common_name string")
    way = spark.createDataFrame([("1", 40.0)], "station_id string, latitude double")
    assert rows(surveys.station_species_tally(codes, way, ["2103"], ["Juvenile"], ["Cusk-Eel sp."]), "cruise_id", "common_name", "n", "latitude") == [("2105", "A", 2, 40.0)]


def test_missing_groups_keep_their_rows(spark):
    df = spark.createDataFrame([("a", "k1", 1.0), (None, "k2", 2.0), (None, "k3", 2.0)], "data string, k string, x double")
    assert windows.dense_index(df, ["data"], ["k"], "i").count() == 3
    assert windows.seeded_shuffle(df, ["data"], ["k"], "x", 1, "y").count() == 3
    assert windows.argmin_all_ties(df, ["data"], F.col("x")).count() == 3
    panel = spark.createDataFrame([(None, "s", f"c{i}", 10.0, float(i)) for i in range(5)], "data string, spp string, cruise_station string, sst double, abd double")
    assert resampling.bootstrap_draws(panel, runs=3).agg(F.sum("n")).first()[0] == 15


def test_repeated_keys_get_weights_of_their_own(spark):
    panel = spark.createDataFrame([("d", "s", f"c{i // 2}", 10.0, 1.0) for i in range(40)], "data string, spp string, cruise_station string, sst double, abd double")
    counts = [r.n_samples for r in resampling.bootstrap_poisson(panel, runs=30).collect()]
    assert any(c % 2 for c in counts)


@pytest.mark.parametrize("parts", [1, 13])
def test_no_hot_key_is_missed(spark, parts):
    """Keys of 1.1 to 5 percent among 30,000 others, a missing key among them; a key just below the share stays out."""
    hot = {"a": 2500, "b": 1100, None: 900, "c": 560, "d": 480}
    rows_in = [(k, 1) for k, n in hot.items() for _ in range(n)] + [(f"x{i % 30_000}", 1) for i in range(44_460)]
    random.Random(4).shuffle(rows_in)
    df = spark.createDataFrame(rows_in, "k string, y int").repartition(parts)
    got = {(r.k, r.y): r["_n"] for r in joins.hot_keys(df, ["k", "y"], share=0.01, min_rows=0).collect()}
    assert got == {(k, 1): n for k, n in hot.items() if n > 500}
    assert joins.hot_keys(df, ["k"], share=0.01, min_rows=1000).count() == 2
    assert joins.hot_keys(df.limit(0), ["k"]).count() == 0


def test_hot_left_side_is_never_stored(spark, monkeypatch):
    monkeypatch.setattr(tables, "write_table", lambda *a, **k: pytest.fail("written"))
    left = spark.range(4000).selectExpr("IF(id % 10 = 0, id, IF(id % 10 < 3, NULL, -1)) AS k", "id AS x")
    right = spark.createDataFrame([(-1, "a"), (10, "c"), (None, "never")], "k long, y string")
    got = joins.salted_left_join(left, right, ["k"], hot_share=0.05, salts=4, min_rows=0)
    assert rows(got) == rows(left.join(right, "k", "left"))


def test_richness_of_merged_sketches(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS cruise", "id % 40 AS site", "id % 7001 AS sp", "IF(id % 2 = 0, 'E', NULL) AS stage")
    sketches = aggregates.distinct_sketches(df, ["cruise", "site", "stage"], "sp")
    for keys_up in (["cruise"], ["stage"], ["cruise", "site"]):
        got = aggregates.merged_richness(sketches, keys_up, "n")
        exact = {r[:-1]: r[-1] for r in rows(df.groupBy(*keys_up).agg(F.count_distinct("sp")))}
        assert len(exact) == got.count()
        for r in rows(got):
            assert abs(r[-1] - exact[r[:-1]]) <= 3 * aggregates.sketch_error() * exact[r[:-1]]


def test_hot_key_keeps_its_salts_after_a_shuffle(spark):
    left = spark.range(4000).selectExpr("IF(id % 10 = 0, id, -1) AS k", "id % 500 AS x").repartition(8, "k")
    right = spark.createDataFrame([(-1, "a"), (-1, "b"), (10, "c")], "k long, y string")
    got = joins.salted_left_join(left, right, ["k"], hot_share=0.05, salts=16, min_rows=0)
    want = left.join(right, "k", "left")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_several_count_rows_fan_out_per_row(spark):
    tally = spark.createDataFrame([("st", "A", 1, 2), ("st", "A", 2, 1), ("st", "B", 1, 1)], "cruise_station string, common_name string, bin_idx long, n long")
    counts = spark.createDataFrame([("st", 8.0, 1.0, 10.0), ("st", 16.0, 2.0, 10.0)], "cruise_station string, egg_count double, ihf double, sst double")
    sizes = spark.createDataFrame([], "cruise_station string, bin double, unid_frequency double, id_frequency double")
    got = expansion.combined_expansion(tally, counts, sizes).filter("common_name = 'A'").collect()
    assert sorted((r.tot, r.ihf) for r in got) == [(6.0, 1.0), (6.0, 2.0), (12.0, 1.0), (12.0, 2.0)]
