"""Connected components of a table of links, by alternating large and small stars.

A node with very many links is a hot key of the joins. Minima are combined before they are
shuffled and then dealt anew, so that both sides of a join are plain shuffles, which
adaptive execution splits where one key is too large (``spark.sql.adaptive.skewJoin``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition(F.xxhash64("u"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m")).repartition(F.xxhash64("u"))
    linked = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.withColumnRenamed("m", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for each node with a link; comp is the component's smallest node.

    ``links`` holds 64-bit nodes. Each step's links are written to the shared folder;
    only their number and checksum reach the driver.
    """
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e, before = stored(e.distinct(), "links"), None
    while True:
        last, e = e, stored(_small(_large(e)).distinct(), "links")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = tuple(now)
