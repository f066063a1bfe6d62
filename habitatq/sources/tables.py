"""Delimited files, sheet sets, depth grids and result tables."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitatq.operators.clean import in_box, normalised_name


def _text_columns(spark: SparkSession, path: str, null_token: str, **options) -> tuple[DataFrame, dict[str, str]]:
    """All columns of delimited files as text, and the column of each normalised name.

    The header is read first and every file must have it, so a file whose
    columns stand in another order fails instead of being misread. An unnamed
    first column, as row-name exports add it, is called ``row_name``.
    """
    plain = {"header": True, "nullValue": null_token, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, **options}
    names = spark.read.options(**plain).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    known = {"row_name" if n == "_c0" else normalised_name(n): n for n in names}
    unnamed = "_c0" in names  # such a header cannot be checked against a schema
    return spark.read.schema(schema).options(**plain, enforceSchema=unnamed).csv(path), known


def _typed(raw: DataFrame, known: dict[str, str], schema: T.StructType | str) -> list[Column]:
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    missing = [f.name for f in fields if normalised_name(f.name) not in known]
    if missing:
        raise ValueError(f"no column for {missing}; the header has {sorted(known)}")
    return [raw[f"`{known[normalised_name(f.name)]}`"].try_cast(f.dataType).alias(f.name) for f in fields]


def read_survey_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, null_token: str = "NA", report: Observation | None = None
) -> DataFrame:
    """Delimited scan by column name; blanks around names and values are trimmed.

    The schema's columns are found by their normalised names in any order and
    among any others; one that the header lacks is an error. Values that do not
    fit their type are null. With ``report`` the first action on the result also
    counts, in the same pass, what ``cast_report`` then tells.
    """
    raw, known = _text_columns(spark, path, null_token)
    if report is None:
        return raw.select(*_typed(raw, known, schema))
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    both = raw.select(*_typed(raw, known, schema), *[raw[f"`{known[normalised_name(f.name)]}`"].alias(f"_text_{i}") for i, f in enumerate(fields)])
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        missing, text = F.col(f"`{f.name}`").isNull(), F.col(f"_text_{i}")
        counts += [F.count_if(text.isNull()).alias(f"nulls_{i}"), F.count_if(missing & text.isNotNull()).alias(f"lost_{i}")]
    return both.observe(report, *counts).drop(*[f"_text_{i}" for i in range(len(fields))])


def cast_report(spark: SparkSession, report: Observation, schema: T.StructType | str) -> DataFrame:
    """``column, rows, nulls, lost`` of a scan that has run: empty values, and texts lost as they did not fit their type."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    got = report.get
    rows = [(f.name, got["rows"], got[f"nulls_{i}"], got[f"lost_{i}"]) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "column string, rows long, nulls long, lost long")


def read_sheet_set(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | str,
    id_col: str,
    pattern: str = r"([^/]+)\.[^./]+$",
) -> DataFrame:
    """Many same-shaped sheets as one table, with each row's sheet name in ``id_col``.

    Columns are found by name, as in ``read_survey_csv``. The sheet name is taken
    from the file path by ``pattern``: the file stem by default, or a folder such
    as ``r"/sheet=([^/]+)/"`` for partitioned exports.
    """
    raw, known = _text_columns(spark, directory, "NA", recursiveFileLookup=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return raw.select(F.regexp_extract(path, pattern, 1).alias(id_col), *_typed(raw, known, schema))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write a result table, replacing an older one at the same path."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA").option("emptyValue", "")
    writer.format(fmt).save(path)
    return path


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table stored in ``buckets`` files sets by a hash of the keys, sorted within, and read back.

    Tables stored with the same keys and number of buckets join and aggregate on these keys without a shuffle.
    The table is registered in the session's catalog under a name of its own, over files in ``scratch_path``.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", scratch_path(spark, name))
    writer.saveAsTable(table)
    return spark.table(table)


def drop_rowname_column(df: DataFrame) -> DataFrame:
    """Without the unnamed first column that row-name exports add."""
    return df.select(*df.columns[1:])


def cell_key(lon: Column, lat: Column, west: float, east: float, south: float, north: float) -> Column:
    """Morton number of a point: 16 bits of each axis within the frame, interleaved, so near points have near numbers."""

    def spread(value: Column, low: float, high: float) -> Column:
        bits = F.least(F.lit(65535), F.greatest(F.lit(0), F.floor((value - low) / (high - low) * 65536.0))).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return bits

    return spread(lon, west, east).bitwiseOR(F.shiftleft(spread(lat, south, north), 1))


def write_depth_grid(df: DataFrame, path: str, frame: tuple[float, float, float, float], files: int | None = None, group_bytes: int = 8 << 20) -> str:
    """Write grid cells in Morton order of ``frame`` (west, east, south, north), so that row groups cover small boxes.

    One range shuffle at write; a later scan of a box then skips all row groups whose lon and lat ranges lie outside.
    """
    keyed = df.withColumn("_cell", cell_key(F.col("lon"), F.col("lat"), *frame))
    ranged = keyed.repartitionByRange(files, "_cell") if files else keyed.repartitionByRange("_cell")
    ranged.sortWithinPartitions("_cell").drop("_cell").write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)
    return path


def read_depth_grid(
    spark: SparkSession, path: str, west: float, east: float, south: float, north: float
) -> DataFrame:
    """Lon/lat/depth cells inside a box; the four bounds reach the Parquet scan."""
    grid = spark.read.parquet(path).select("lon", "lat", "depth")
    return grid.filter(in_box(F.col("lon"), F.col("lat"), west, east, south, north))


#: Intermediate tables this process has made, by the folder they lie in, for ``release_stored``.
_STORED: dict[str, list[str]] = {}


@functools.cache
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="habitatq-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, reachable by all executors.

    It lies in the folder the session names in ``spark.checkpoint.dir``. Only
    a local session without that setting gets a temporary folder of its own,
    removed when Python ends.
    """
    base = _scratch_base(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(base, []).append(path)
    return path


def _scratch_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = _local_scratch()
    return base


def release_stored(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has made once no result of them is needed; returns how many there were."""
    paths = _STORED.pop(_scratch_base(spark), [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once to ``scratch_path`` and read back.

    For a costly result that several branches of a plan use: it is computed
    once, its size is known to the optimizer, and after a lost executor work
    restarts from the written files.
    """
    path = write_table(df, scratch_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
