"""Connected components of a table of links, in DataFrame operations (alternating large-star and small-star, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release


def _hang(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (a, b): each node's larger (or smaller) neighbours are linked to its least one.

    Only least neighbours are aggregated, never whole neighbourhoods, so a node with very many links costs one partial sum a task.
    Centres of large stars are hot keys of the join: their table is checkpointed first, so both sides are plain exchanges, which
    adaptive execution splits. After a large star no node has many smaller neighbours.
    """
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    if large:
        joined = both.filter("b > a").join(checkpointed(least), F.col("a") == F.col("n"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    joined = both.join(least, both["a"] == least["n"])
    own = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).filter("a <> b").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): of each node that has a link to another, the least node that it reaches."""
    stars = checkpointed(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        stars = checkpointed(_hang(_hang(stars, True), False))
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        release(links.sparkSession)
    centres = stars.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)
