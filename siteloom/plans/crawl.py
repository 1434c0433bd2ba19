"""The crawl over a stored snapshot (SRC-1 to SRC-3, DF-8, DF-8a): a fetch is a join, a hop is one plan.

Pages are parsed once, into a table of their links and flags; hops then join short rows only. What a hop adds to the frontier is cut off
by a checkpoint in the shared folder, so plans don't grow with the hops and a lost executor costs a task.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siteloom.config import DEFAULT, Settings
from siteloom.functions.text import archivable, followable
from siteloom.functions.urls import parse_base, strip_slashes
from siteloom.operators import content, frontier, robots
from siteloom.shared import checkpointed

log = logging.getLogger(__name__)


def link_table(pages: DataFrame, respect_rel: bool = False) -> DataFrame:
    """url (slashes stripped), head, followable, archivable, hrefs of each page; of pages that share an url the least page_id's."""
    nodes = content.parsed(pages.select("page_id", strip_slashes(F.col("url")).alias("url"), "html"), ("title", "base", "meta", "a"))
    rows = nodes.select("page_id", "url", content.head(F.col("nodes")).alias("head"), F.transform(content.links(F.col("nodes"), respect_rel), lambda x: x["href"]).alias("hrefs"))
    flags = rows.withColumns({"followable": followable(F.col("head.robots")), "archivable": archivable(F.col("head.robots"))})
    return flags.groupBy("url").agg(F.min_by(F.struct("page_id", "head", "followable", "archivable", "hrefs"), "page_id").alias("p")).select("url", "p.*")


@dataclass
class Crawl:
    """What a crawl did: fetched (base, depth, hop, url, page_id, stored), visited (url, base, depth, hop) and, for each hop, what was
    observed of it: hop, fetched, stored, followed, found."""

    fetched: DataFrame
    visited: DataFrame
    metrics: list[dict[str, int]]


def crawl_log(spark: SparkSession, done: Crawl) -> DataFrame:
    """SNK-9: the metrics of a crawl's hops as rows."""
    return spark.createDataFrame([tuple(m[c] for c in ("hop", "fetched", "stored", "followed", "found")) for m in done.metrics], "hop int, fetched long, stored long, followed long, found long")


def crawl(spark: SparkSession, start: DataFrame, pages: DataFrame, rules: DataFrame | None = None, settings: Settings = DEFAULT, max_hops: int = 1000, table: DataFrame | None = None) -> Crawl:
    """Follow links from start (url) until no new url is found.

    Links within known sites keep their depth; a link to a new site is one deeper and is dropped beyond crawl_depth. A noarchive page
    gives links and is not stored, a nofollow page is stored and gives none. rules: read_robots()' table; without it all is allowed.
    """
    links = checkpointed(table if table is not None else link_table(pages))
    # Robots files are parsed once, not in each hop.
    rules = checkpointed(rules) if rules is not None else None
    numbered = start.select("url").distinct().withColumns({"depth": F.lit(0), "seq": F.xxhash64("url")})
    queue = checkpointed(frontier.append_sites(numbered, numbered.limit(0).withColumn("base", F.col("url")), settings).select("base", "depth", strip_slashes(F.col("url")).alias("url")))
    sites = queue.select("base", "depth", F.lit(0).cast("long").alias("seq")).distinct()
    lengths = frontier.base_lengths(sites)
    visited = queue.select("url", "base", "depth", F.lit(0).alias("hop"))
    fetched: DataFrame | None = None
    metrics: list[dict[str, int]] = []
    for hop in range(max_hops):
        asked = queue if rules is None else robots.can_fetch(queue, rules, settings).filter("allowed").drop("allowed")
        seen = Observation()
        yes = lambda c: F.count(F.when(F.col(c), 1))
        got = asked.join(links, "url").withColumn("hop", F.lit(hop)).observe(seen, F.count(F.lit(1)).alias("fetched"), yes("archivable").alias("stored"), yes("followable").alias("followed"))
        got = checkpointed(got)
        done = got.select("base", "depth", "hop", "url", "page_id", F.col("archivable").alias("stored"))
        fetched = done if fetched is None else fetched.union(done)
        if hop % 8 == 7:
            fetched = checkpointed(fetched)
        out = got.filter("followable").select("base", "depth", F.explode("hrefs").alias("href"))
        found = frontier.normalise_links(out, settings=settings).groupBy("url").agg(F.min("depth").alias("from_depth"))
        new = checkpointed(frontier.unvisited(found, visited))
        routed = frontier.route(new, sites, lengths).withColumn("far", F.col("base").isNull())
        placed = routed.select(F.coalesce("base", parse_base(F.col("url"))).alias("base"), F.coalesce("depth", F.col("from_depth") + 1).alias("depth"), "url", "far")
        queue = checkpointed(placed.filter(F.col("base").isNotNull() & (~F.col("far") | (F.col("depth") <= settings.crawl_depth))).drop("far"))
        n = queue.count()
        metrics.append({"hop": hop, **seen.get, "found": n})
        log.info("hop %(hop)d: fetched %(fetched)d, stored %(stored)d, followed %(followed)d, found %(found)d new urls", metrics[-1])
        if not n:
            break
        # Each queue is checkpointed already; the union of them is, once in a while, to keep plans short.
        visited = visited.union(queue.select("url", "base", "depth", F.lit(hop + 1).alias("hop")))
        if hop % 8 == 7:
            visited = checkpointed(visited)
        if settings.crawl_depth > 0:
            more = queue.select("base", "depth").distinct().join(sites.select("base", "depth"), ["base", "depth"], "left_anti").withColumn("seq", F.lit(hop + 1).cast("long"))
            sites = checkpointed(sites.union(more))
            lengths = frontier.base_lengths(sites)
    return Crawl(fetched, visited, metrics)
