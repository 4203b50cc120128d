"""Connected components of stored links, by rounds of large and small stars.

In a large star every node hands its smallest neighbour to its larger neighbours, in a small star to
its smaller ones; both keep all connections and together turn each component into a star around its
smallest node. A node with many links is a key of an equal join, which adaptive execution splits; its
smallest neighbour is an aggregate, combined before it is shuffled. Rounds grow with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    around = _both_ways(links)
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # only links to larger neighbours move; each link has one larger end, so none is lost
    moved = around.where("v > u").join(least, "u").where("m < v")
    return moved.select(F.col("m").alias("u"), "v")


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    joined = links.join(least, "v")
    stars = joined.select(F.col("m").alias("u"), "v").union(
        joined.where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    )
    return stars.distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether no node is a larger end twice, or both a larger and a smaller end."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("small"), F.lit(0).alias("large"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.max("small").alias("small"), F.sum("large").alias("large"))
    return per_node.where("large > 1 OR (large = 1 AND small = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``u, v``); a component is its smallest node.

    Links of a node to itself and links with a NULL end are ignored, repeated ones count once.
    """
    links = links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = cut_lineage(links, "links")
    while not _all_stars(links):
        links = cut_lineage(_small_star(_large_star(links)), "links")
    # at the end every link leads from the smallest node to another one
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
