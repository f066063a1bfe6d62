"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatq.sources.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (columns ``a``, ``b``); root is the smallest node reachable.

    Alternates two star operations, each a minimum per node and one join, until the links stop
    changing; the rounds grow with the logarithm of a component's size. Minima are combined before
    the shuffle and stored, so that joins meet plain shuffles and adaptive execution splits a node
    with very many links. Every step is written to the shared folder, which ends its lineage.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.max(F.lit(0))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
