"""Connected components by alternating stars, in DataFrame operations.

Each round turns every neighbourhood into a star around its least node: first
towards larger neighbours, then towards smaller ones. The number of rounds
grows with the logarithm of a component's width, not with its length. Minima
combine map-side; each round's minima and links are written to the shared
folder, so lineage stays short and the joins shuffle both sides themselves: a
node with very many links is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.plans.session import materialise


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h)).first())


def connected_components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link to another node;
    ``component`` is the least node reachable. Null ends and links of a node
    to itself are left out; repeated and reversed links do no harm. Nodes may
    be of any type that has an order."""
    spark = links.sparkSession
    a, b = F.col(src), F.col(dst)
    stars = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    stars = materialise(spark, stars.distinct(), "links")
    mark = _mark(stars)
    while mark[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        least = materialise(spark, least, "links-least")
        # u links its larger neighbours v to the least node m around u.
        larger = both.join(least, "u").where("v > u")
        larger = larger.select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = materialise(spark, larger.distinct(), "links-larger")
        # u links its smaller neighbours and itself to the least of them.
        below = larger.groupBy("u").agg(F.min("v").alias("m"))
        below = materialise(spark, below, "links-below")
        smaller = larger.join(below, "u").where("v > m")
        smaller = smaller.select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = smaller.unionByName(below.select("u", F.col("m").alias("v")))
        stars = materialise(spark, found.distinct(), "links")
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
