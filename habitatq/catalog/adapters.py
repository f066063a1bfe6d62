"""The given star-schema tables in the shapes the operators expect.

Orders are survey stations, line items are fish, parts give the species and
customers are the fixed sampling sites. ``catalog.oracle`` states the same
views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitatq.sources.tables import stored

SPECIES = ["ECONOMY", "PROMO", "STANDARD", "SMALL", "MEDIUM"]
SURVEYS = ["F", "O", "P"]
LARVAL = ["F"]
TAXA = ["economy_10m2", "promo_10m2", "standard_10m2", "small_10m2", "medium_10m2", "large_10m2"]
NAMES = {
    ("larvae", "economy_10m2"): "Economy Fish",
    ("larvae", "promo_10m2"): "Promo Fish",
    ("larvae", "standard_10m2"): "Standard Fish",
    ("egg_counts", "ECONOMY"): "Economy Fish",
    ("egg_counts", "PROMO"): "Promo Fish",
    ("egg_counts", "STANDARD"): "Standard Fish",
    ("egg_barcodes", "ECONOMY"): "Economy Fish",
    ("egg_barcodes", "PROMO"): "Promo Fish",
    ("egg_barcodes", "STANDARD"): "Standard Fish",
}


class Views:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._counted: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def stations(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            "o_orderkey",
            station_of_order().alias("cruise_station"),
            F.col("o_orderstatus").alias("data"),
            F.when(key % 97 != 0, F.col("o_totalprice") / 2e4 - 1.0).alias("sst"),
        )

    def fish(self) -> DataFrame:
        """Line items with their species, counted and summed per order and species."""
        named = self._named_items().select("l_orderkey", F.col("p_type").alias("spp"), "l_quantity")
        return named.groupBy("l_orderkey", "spp").agg(F.sum("l_quantity").alias("abd"))

    def _named_items(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_type")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))

    def item_counts(self) -> DataFrame:
        """Line items counted per order, part, flag and quantity, and their species, stored.

        Catches, egg tallies and barcode tallies all derive from it, so line items and
        parts are read and joined once; species come after the counts.
        """
        if self._counted is None:
            items = self.table("lineitem").groupBy("l_orderkey", "l_partkey", "l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
            part = self.table("part").select("p_partkey", "p_type")
            named = items.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
            self._counted = stored(named, "items")
        return self._counted

    def fish_counted(self) -> DataFrame:
        """``fish`` from the stored counts."""
        sums = self.item_counts().groupBy("l_orderkey", F.col("p_type").alias("spp"))
        return sums.agg(F.sum(F.col("n") * F.col("l_quantity")).alias("abd"))

    def eggs_counted(self) -> DataFrame:
        """``eggs`` with equal ones of a station counted in ``n``."""
        counts = self.item_counts().groupBy("l_orderkey", _egg_name().alias("common_name"), (F.col("l_quantity") / 50.0).alias("diameter"))
        return self._at_station(counts.agg(F.sum("n").alias("n"))).select("cruise_station", "common_name", "diameter", "n")

    def barcodes_counted(self) -> DataFrame:
        """``barcodes`` with equal ones counted in ``n``."""
        counts = self.item_counts().groupBy("l_orderkey", _stage().alias("stage"), _barcode_name().alias("common_name"))
        both = counts.agg(F.sum("n").alias("n")).join(self._visits_of_orders(), F.col("l_orderkey") == F.col("o_orderkey"))
        return both.select("cruise_id", "station_id", "stage", "common_name", "n")

    def occurrence(self, fish: DataFrame | None = None) -> DataFrame:
        st = self.stations()
        both = (fish or self.fish()).join(st, F.col("l_orderkey") == F.col("o_orderkey"))
        return both.select("spp", "cruise_station", "sst", "data", "abd")

    def wide(self, occurrence: DataFrame | None = None) -> DataFrame:
        taxa = [F.sum(F.when(F.col("spp") == t.split("_")[0].upper(), F.col("abd"))).alias(t) for t in TAXA]
        per_station = (occurrence or self.occurrence()).groupBy("cruise_station", "data", "sst").agg(*taxa)
        return per_station.select("cruise_station", "data", F.coalesce("sst", F.lit(9999.0)).alias("sst"), *TAXA)

    def coded(self) -> DataFrame:
        gap = (F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 1)
        items = self.table("lineitem").select(
            "l_orderkey",
            (F.lit(170511100) + F.col("l_partkey") % 5).alias("taxa_code"),
            F.when(~gap, F.col("l_quantity")).alias("abundance"),
        )
        return self._at_station(items).select("cruise_station", "taxa_code", "abundance")

    def _at_station(self, items: DataFrame, *extra: str) -> DataFrame:
        st = self.stations().select("o_orderkey", "cruise_station", *extra)
        return items.join(st, F.col("l_orderkey") == F.col("o_orderkey"))

    def eggs(self) -> DataFrame:
        items = self._named_items().select(
            "l_orderkey",
            _egg_name().alias("common_name"),
            (F.col("l_quantity") / 50.0).alias("diameter"),
        )
        return self._at_station(items).select("cruise_station", "common_name", "diameter")

    def sizes(self) -> DataFrame:
        """Size sheets, 20 bins each, of the stations with a raised priority."""
        key, b = F.col("o_orderkey"), F.col("bin_idx")
        sheets = self.table("orders").filter(F.col("o_orderpriority") < "3").select("o_orderkey", "o_custkey")
        rows = sheets.withColumn("bin_idx", F.explode(F.sequence(F.lit(1), F.lit(20))))
        return rows.select(
            station_of_order().alias("cruise_station"),
            (b / F.lit(20.0)).alias("bin"),
            ((key * 7 + b * 3) % 4).alias("unid_frequency"),
            ((key + b) % 3).alias("id_frequency"),
        )

    def counts(self) -> DataFrame:
        key = F.col("o_orderkey")
        eggs = self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("eggs"))
        st = self.stations().join(eggs, F.col("l_orderkey") == key, "left")
        return st.select(
            "cruise_station",
            "sst",
            F.when(key % 29 != 0, F.coalesce("eggs", F.lit(0)) + key % 4).alias("egg_count"),
            F.when(key % 13 != 0, F.lit(0.5) + (key % 10) / F.lit(10.0)).alias("ihf"),
        )

    def casts(self) -> DataFrame:
        """Temperature casts, several per station, in steps of 1/64 degree."""
        items = self.table("lineitem").select("l_orderkey", "l_linenumber")
        st = self.table("orders").select("o_orderkey", "o_totalprice", station_of_order().alias("cruise_station"))
        both = items.join(st, F.col("l_orderkey") == F.col("o_orderkey"))
        temp = F.floor(F.col("o_totalprice") / 312.5) / 64.0 - 1.0 + F.floor(F.col("l_linenumber") / 2.0) / 8.0
        return both.select("cruise_station", temp.alias("sst"))

    def visits(self) -> DataFrame:
        key, site = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            F.when(key % 100 != 7, F.concat(F.lit("E"), (key % 100).cast("string"), F.when(key % 2 == 1, "B").otherwise("")))
            .alias("haul_id"),
            cruise_of_order().alias("cruise_id"),
            site.cast("string").alias("station_id"),
            (F.lit(38.0) + (site % 200) / 64.0 + (key % 8) / 512.0).alias("latitude"),
            (F.lit(71.0) + (site % 220) / 64.0 + (key % 4) / 512.0).alias("longitude"),
        )

    def waypoints(self) -> DataFrame:
        key = F.col("c_custkey")
        text = key.cast("string")
        return self.table("customer").select(
            F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("C"), text)).otherwise(text).alias("waypoint"),
            (F.lit(38.25) + (key * 13 % 325) / 100.0).alias("latitude"),
            (F.lit(-74.5) + (key * 7 % 350) / 100.0).alias("longitude"),
        )

    def grid(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            (F.lit(-74.5) + (key % 211) / 60.0).alias("lon"),
            (F.lit(38.25) + (key * 3 % 196) / 60.0).alias("lat"),
            (F.lit(5.0) - (key * 37 % 3100)).alias("depth"),
        )

    def barcodes(self) -> DataFrame:
        items = self._named_items().select(
            "l_orderkey",
            _stage().alias("stage"),
            _barcode_name().alias("common_name"),
        )
        both = items.join(self._visits_of_orders(), F.col("l_orderkey") == F.col("o_orderkey"))
        return both.select("cruise_id", "station_id", "stage", "common_name")

    def _visits_of_orders(self) -> DataFrame:
        return self.table("orders").select(
            "o_orderkey", cruise_of_order().alias("cruise_id"), F.col("o_custkey").cast("string").alias("station_id")
        )

    def tows(self) -> DataFrame:
        """Tow depth per cruise and site; the shallowest sites have depth 0."""
        tow = self.table("orders").select(cruise_of_order().alias("cruise_id"), "o_custkey").distinct()
        site = F.col("o_custkey")
        return tow.select(
            "cruise_id",
            site.cast("string").alias("station_id"),
            F.when(site % 60 == 0, 0.0).otherwise(5.0 + site % 60).alias("tow_depth"),
        )

    def site_temperatures(self) -> DataFrame:
        """One temperature per cruise and site, some missing."""
        temp = F.max(F.when(F.col("o_orderkey") % 97 != 0, F.col("o_totalprice") / 2e4 - 1.0))
        sites = self.table("orders").groupBy(cruise_of_order().alias("cruise_id"), "o_custkey").agg(temp.alias("sst"))
        key = F.concat_ws("_", "cruise_id", F.col("o_custkey").cast("string"))
        return sites.select(key.alias("cruise_station"), "sst").filter(F.col("sst").isNotNull())

    def points(self) -> DataFrame:
        """Survey rows with a text date and a position, some without latitude."""
        key, site = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            F.col("o_orderstatus").alias("data"),
            station_of_order().alias("cruise_station"),
            F.date_format("o_orderdate", "d-MMM-yy").alias("date_text"),
            (F.lit(-80.0) + (site % 900) / 64.0).alias("lon"),
            F.when(key % 31 != 0, F.lit(33.5) + (site % 800) / 64.0).alias("lat"),
        )


def _egg_name() -> Column:
    return F.when(F.col("l_partkey") % 101 != 0, F.col("p_type"))


def _stage() -> Column:
    return F.when(F.col("l_returnflag") == "A", "Egg").when(F.col("l_returnflag") == "N", "Larva").otherwise("Juvenile")


def _barcode_name() -> Column:
    return F.when(F.col("l_partkey") % 17 == 0, "").otherwise(F.col("p_type"))


def station_of_order() -> Column:
    return F.concat_ws("_", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))


def cruise_of_order() -> Column:
    k = F.col("o_orderkey") % 5
    code = F.when(k == 0, "2102").when(k == 1, "2105").when(k == 2, "2107").when(k == 3, "2109").otherwise("2103")
    return code
