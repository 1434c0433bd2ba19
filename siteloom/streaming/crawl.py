"""The crawl as streams: link discovery, hops by micro-batch, and one fetch per site and delay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siteloom.config import DEFAULT, Settings
from siteloom.functions.urls import parse_base
from siteloom.operators import content, frontier
from siteloom.sources.html import html_nodes

FRONTIER = "base string, depth int, url string, seq long"


def new_links(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """A stream of pages (page_id, url, html) to a stream of (base, url), each url once ever: the visited set is kept as state."""
    rows = pages.select(parse_base(F.col("url")).alias("base"), html_nodes(F.col("html"), ("a",)).alias("nodes")).filter("base is not null")
    links = rows.select("base", F.explode(content.links(F.col("nodes"))).alias("_l")).select("base", F.col("_l.href").alias("href"))
    return frontier.normalise_links(links, settings=settings).select("base", "url").dropDuplicates(["url"])


def crawl_hops(spark: SparkSession, path: str, links: DataFrame, settings: Settings = DEFAULT) -> StreamingQuery:
    """Hops over a frontier in files: each batch of new rows under path/frontier is joined to links (url, followable, hrefs) and what it leads
    to is appended there, for the next batch. path/checkpoint makes a restart go on where it stopped; a batch that is redone adds only
    what isn't there. Starts with what put_frontier() wrote; stop it when no data comes any more."""
    stream = spark.readStream.schema(FRONTIER).parquet(f"{path}/frontier")

    def hop(batch: DataFrame, _: int) -> None:
        got = batch.join(links, "url").filter("followable").select("base", "depth", F.explode("hrefs").alias("href"))
        found = frontier.normalise_links(got, settings=settings).groupBy("url").agg(F.min("depth").alias("from_depth"))
        visited = spark.read.schema(FRONTIER).parquet(f"{path}/frontier")
        sites = visited.groupBy("base", "depth").agg(F.min("seq").alias("seq"))
        routed = frontier.route(frontier.unvisited(found, visited), sites)
        depth = F.coalesce("depth", F.col("from_depth") + 1)
        rows = routed.select(F.coalesce("base", parse_base(F.col("url"))).alias("base"), depth.alias("depth"), "url", F.xxhash64("url").alias("seq"))
        rows = rows.filter((F.col("depth") <= settings.crawl_depth) & F.col("base").isNotNull()).persist()
        # A batch without rows would write an empty file, which is a new file to read: the stream would never come to rest.
        if not rows.isEmpty():
            rows.write.mode("append").parquet(f"{path}/frontier")
        rows.unpersist()

    return stream.writeStream.foreachBatch(hop).option("checkpointLocation", f"{path}/checkpoint").start()


def put_frontier(rows: DataFrame, path: str) -> None:
    """(base, depth, url, seq) for crawl_hops to start from."""
    rows.select("base", "depth", "url", "seq").write.mode("append").parquet(f"{path}/frontier")


class _Polite(StatefulProcessor):
    """A site's queue as map state by place, the places of its head and tail, and a processing-time timer for its next turn."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "i long", "url string")
        self.ends = handle.getValueState("ends", "head long, tail long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        for pdf in rows:
            for url in pdf["url"]:
                self.queue.updateValue((tail,), (url,))
                tail += 1
        self.ends.update((head, tail))
        if not self.due.exists():
            yield from self._next(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield from self._next(key, timerValues.getCurrentProcessingTimeInMs())

    def _next(self, key, now: int) -> Iterator[pd.DataFrame]:
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        if head >= tail:
            return
        url = self.queue.getValue((head,))[0]
        self.queue.removeKey((head,))
        self.ends.update((head + 1, tail))
        self.due.update((now + self.delay_ms,))
        self.handle.registerTimer(now + self.delay_ms)
        yield pd.DataFrame({"base": [key[0]], "url": [url], "at": [now]})

    def close(self) -> None:
        pass


def politely(urls: DataFrame, delay: float = DEFAULT.crawl_delay) -> DataFrame:
    """A stream of (base, url) to (base, url, at): each site's urls in line, delay seconds apart. Needs the RocksDB state store."""
    return urls.groupBy("base").transformWithStateInPandas(_Polite(int(delay * 1000)), outputStructType="base string, url string, at long", outputMode="Append", timeMode="ProcessingTime")
