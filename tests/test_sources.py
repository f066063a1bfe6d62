"""Readers and writers on small files."""

from pathlib import Path
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from habitatq.operators.clean import normalise_names
from habitatq.plans import prepare
from habitatq.sources import schemas, tables


def test_waypoints_with_padded_header(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Waypoint,Latitude ,Longitude\n8.1,40.5,-73.4\nWF1.1 , 41.0,NA\n")
    got = tables.read_survey_csv(spark, str(tmp_path / "w.csv"), schemas.WAYPOINTS)
    assert [tuple(r) for r in got.collect()] == [("8.1", 40.5, -73.4), ("WF1.1", 41.0, None)]


def test_sheets_carry_their_file_name(spark, tmp_path):
    for name, value in (("c1_2", 3.0), ("c 1+3", 4.0)):
        (tmp_path / f"{name}.csv").write_text(f"Bin,UnID_Frequency,ID_Frequency\n0.1,{value},NA\n")
    got = tables.read_sheet_set(spark, str(tmp_path), schemas.SIZE_SHEET, "cruise_station")
    assert sorted(map(tuple, got.collect())) == [("c 1+3", 0.1, 4.0, None), ("c1_2", 0.1, 3.0, None)]


def test_written_table_is_read_back_and_rowname_dropped(spark, tmp_path):
    (tmp_path / "b.csv").write_text(",temp_bin,q,data,spp\n1,10.5,0.5,F,X\n2,11,NA,F,X\n")
    boot = tables.drop_rowname_column(tables.read_survey_csv(spark, str(tmp_path / "b.csv"), schemas.REPLICATES))
    for fmt in ("parquet", "csv"):
        path = tables.write_table(boot, str(tmp_path / fmt), fmt)
        if fmt == "csv":
            back = tables.read_survey_csv(spark, path, "temp_bin double, q double, data string, spp string")
        else:
            back = spark.read.parquet(path)
        assert sorted(map(str, back.collect())) == sorted(map(str, boot.collect()))


def session_like(checkpoint, master):
    """Only what ``scratch_path`` asks a session for."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: checkpoint or default), sparkContext=SimpleNamespace(master=master)
    )


def test_scratch_follows_the_session_setting():
    assert tables.scratch_path(session_like("hdfs://c/ck/", "yarn"), "t").startswith("hdfs://c/ck/t-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.scratch_path(session_like(None, "yarn"), "t")


def test_stored_tables_keep_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "cast(id as string) as s", "array(1.5D) as a")
    kept = tables.stored(df, "t")
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert kept.dtypes == df.dtypes


def test_names(spark):
    assert normalise_names(spark.createDataFrame([(1,)], "`Cruise ID` int")).columns == ["cruise_id"]


def test_columns_are_found_by_name_among_others(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        "Gear,CRUISE NAME,lon,lat,Station,date,SFC_TEMP,scoaqu_10m2,citarc_10m2,merbil_10m2,hipobl_10m2,extra\n"
        "bongo,C1,-70.1,40.5,012,5-Feb-77,12.5,1,2,3,x,9\n"
    )
    row = tables.read_survey_csv(spark, str(tmp_path / "l.csv"), schemas.LARVAL_SURVEY).first()
    assert (row.cruise_name, row.station, row.lat, row.lon, row.sfc_temp, row.hipobl_10m2, row.scoaqu_10m2) == ("C1", "012", 40.5, -70.1, 12.5, None, 1.0)
    with pytest.raises(ValueError, match="tow_depth"):
        tables.read_survey_csv(spark, str(tmp_path / "l.csv"), "station string, tow_depth double")


def test_sheets_with_other_column_orders_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Bin,UnID_Frequency,ID_Frequency\n0.1,1,2\n")
    (tmp_path / "b.csv").write_text("Bin,ID_Frequency,UnID_Frequency\n0.1,1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_sheet_set(spark, str(tmp_path), schemas.SIZE_SHEET, "s").collect()


def test_preparation_of_raw_columns(spark):
    coded = spark.createDataFrame([("C", "007", 1, 2.0), ("C", "12.4", 1, None), ("C", "x", 1, 1.0)], schemas.CODED_TAXA)
    assert [r.cruise_station for r in prepare.coded_taxa(coded).collect()] == ["C_7", "C_12", "C_NA"]
    stations = spark.createDataFrame([("C", "1", "8", None, 1.0, 2.0), ("C", "2", None, None, 1.0, 2.0), ("C", "3", "5", None, 1.0, 2.0)], schemas.EGG_STATIONS)
    hauls = spark.createDataFrame([("C", "1", 0.5), ("C", "1", 0.7), ("C", "3", None)], schemas.HAUL_FACTORS)
    casts = prepare.casts(spark.createDataFrame([("C", "1", 11.0)], schemas.CASTS))
    got = prepare.egg_counts(stations, hauls, casts).collect()
    assert sorted((r.cruise_station, r.egg_count, r.ihf, r.sst) for r in got) == [("C_1", 8.0, 0.5, 11.0), ("C_1", 8.0, 0.7, 11.0)]
    eggs = spark.createDataFrame([("s", "American", "C", "1", "0.93"), ("t", None, "C", "2", "?")], schemas.EGG_IDS)
    found = prepare.egg_identifications(eggs, {"American": "American fourspot flounder"}).collect()
    assert [tuple(r) for r in found] == [("C_1", "American fourspot flounder", 0.93), ("C_2", None, None)]
    info = spark.createDataFrame([("C", "1", "12.5", 3.0), ("C", "2", "bad", 3.0)], schemas.STATION_INFO)
    assert [tuple(r) for r in prepare.site_temperatures(info).collect()] == [("C_1", 12.5)]
    larval = spark.createDataFrame([("C", "1", 1.0, 2.0, "d", 9999.0, 1.0, None, 0.0, 2.0)], schemas.LARVAL_SURVEY)
    assert tuple(prepare.larval_survey(larval, ["scoaqu_10m2"]).first()) == ("C_1", 9999.0, 2.0)
    codes = spark.createDataFrame([("G s", None, "C", "1", "Egg")], schemas.BARCODES)
    assert tuple(prepare.barcodes(codes).first()) == ("C", "1", "Egg", "")


def test_cast_report_counts_in_the_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Station,Temp,Name\n1,10.5,x\nNA,warm,y\n3,,\n4x,12,z\n")
    (tmp_path / "b.csv").write_text("Station,Temp,Name\n,9999999999x,NA\n")
    schema = "station int, temp double, name string"
    report = Observation("scan")
    scan = tables.read_survey_csv(spark, str(tmp_path), schema, report=report)
    assert scan.columns == ["station", "temp", "name"] and len(scan.collect()) == 5
    got = [tuple(r) for r in tables.cast_report(spark, report, schema).collect()]
    assert got == [("station", 5, 2, 1), ("temp", 5, 1, 2), ("name", 5, 2, 0)]


def test_bucketed_tables_join_without_a_shuffle(spark):
    left = spark.range(3000).selectExpr("concat('s', id % 700) AS cruise_station", "id AS x")
    right = spark.range(600).selectExpr("concat('s', id) AS cruise_station", "id * 2 AS y")
    a, b = (tables.write_bucketed(df, n, ["cruise_station"], 8) for df, n in ((left, "l"), (right, "r")))
    joined = a.join(b.hint("merge"), "cruise_station", "left").groupBy("cruise_station").agg(F.sum("x").alias("x"), F.max("y").alias("y"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    plain = left.join(right, "cruise_station", "left").groupBy("cruise_station").agg(F.sum("x").alias("x"), F.max("y").alias("y"))
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_a_small_box_reads_few_row_groups(spark, tmp_path):
    frame = (-75.0, -70.0, 38.0, 42.0)
    grid = spark.range(400_000).selectExpr("-75 + (id * 7919 % 500) / 100.0D AS lon", "38 + (id * 104729 % 400) / 100.0D AS lat", "double(id) AS depth")
    path = tables.write_depth_grid(grid, str(tmp_path / "grid"), frame, files=4, group_bytes=256 << 10)
    box = (-73.0, -72.8, 40.0, 40.2)
    groups, hit, inside = 0, 0, 0
    for file in Path(path).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(3)}
            groups += 1
            hit += all(stats[n].max >= lo and stats[n].min <= hi for n, lo, hi in (("lon", *box[:2]), ("lat", *box[2:])))
    got = tables.read_depth_grid(spark, path, *box)
    want = grid.filter(f"lon BETWEEN {box[0]}D AND {box[1]}D AND lat BETWEEN {box[2]}D AND {box[3]}D")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    assert groups >= 20 and hit <= groups / 5, (groups, hit)


def test_intermediate_tables_are_released(spark):
    df = tables.stored(spark.range(5), "five")
    folder = Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists() and tables.release_stored(spark) >= 1
    assert not folder.exists() and tables.release_stored(spark) == 0
