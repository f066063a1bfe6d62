"""Size sheets go through one shuffle before their windows."""

from pyspark.sql import functions as F

from habitatq.plans import expansion
from habitatq.sources import tables


def test_sheets_are_shuffled_once(spark):
    sheets = spark.range(200).select(F.concat(F.lit("s"), F.col("id") % 9).alias("cruise_station"), (F.col("id") % 11 / 20.0).alias("bin"),
                                     (F.col("id") % 4).alias("unid_frequency"), F.when(F.col("id") % 13 > 0, F.col("id") % 3).alias("id_frequency"))
    eggs = spark.range(90).select(F.concat(F.lit("s"), F.col("id") % 9).alias("cruise_station"), F.when(F.col("id") % 5 > 0, "cod").alias("common_name"),
                                  (F.col("id") % 7 / 20.0).alias("diameter"))
    tally = tables.stored(expansion.egg_tally(eggs), "tally")
    found = expansion.bins_with_target(tally, tables.stored(sheets, "sheets"))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 1
    totals = {(r.cruise_station, r.bin_idx): (r.copies, r.freq, r.spare) for r in expansion.size_bin_totals(sheets).collect()}
    rows = found.collect()
    assert rows and all((r.sheet_rows, r.total) == totals[r.cruise_station, r.bin_idx][:2] for r in rows)
    assert all((r.copies, r.freq, r.spare) == totals[r.cruise_station, r.bin_idx] for r in rows if r.copies)
    named = sum(r.n for r in rows if r.n)
    assert named == tally.filter(F.col("bin_idx") <= 10).agg(F.sum("n")).first()[0] - sum(
        r.n for r in tally.collect() if (r.cruise_station, r.bin_idx) not in totals)
