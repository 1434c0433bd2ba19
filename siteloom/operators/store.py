"""Stored tables: versions of pages, sites, paragraphs and headings (SNK-1 to SNK-10, WN-1, WN-2, FL-1, FL-2, J-2, J-7, J-8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions.text import parse_datetime
from siteloom.functions.urls import temp_name
from siteloom.schemas import TABLES

BY_TIME = "crawl_modified"


def latest_version(webpages: DataFrame, key: str = "url", time: str = BY_TIME, tie: str = "id") -> DataFrame:
    """WN-1, SO-1: of each page the row that was stored last."""
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return webpages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def created_carry(webpages: DataFrame, now: Column, key: str = "url", created: str = "crawl_created") -> DataFrame:
    """WN-2: (key, crawl_created) a next version of each page gets: that of its first version, now where it has none."""
    first = webpages.groupBy(key).agg(F.min_by(created, F.struct(BY_TIME, "id")).alias("_first"))
    return first.select(key, F.coalesce("_first", now).alias(created))


def surrogate(*columns: str) -> Column:
    """A key that a rerun gives again."""
    return F.xxhash64(*columns)


def exactly_one(df: DataFrame, condition: Column) -> DataFrame:
    """FL-1: the row that fits; raises when it is read if there isn't exactly one."""
    found = df.filter(condition).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*df.columns)).alias("_row"))
    return found.filter(F.assert_true(F.col("_n") == 1, "not exactly one row fits").isNull()).select("_row.*")


class Store:
    """The four tables under one path, as append-only Parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self) -> None:
        """SNK-10: empty tables in place of whatever there is."""
        for name, schema in TABLES.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        """SRC-12, SRC-13."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def add(self, name: str, rows: DataFrame) -> None:
        """SNK-5: rows at the end of a table, columns it lacks as null."""
        want = self.spark.createDataFrame([], TABLES[name])
        want.unionByName(rows, allowMissingColumns=True).select(*want.columns).write.mode("append").parquet(f"{self.path}/{name}")

    def add_websites(self, sites: DataFrame, now: Column) -> None:
        """SNK-1: sites (url, crawl_depth) that aren't stored yet."""
        new = sites.dropDuplicates(["url"]).join(self.read("websites").select("url"), "url", "left_anti")
        self.add("websites", new.select(surrogate("url").alias("id"), now.alias("created"), now.alias("modified"), "crawl_depth", "url"))

    def add_pages(self, pages: DataFrame, now: Column, key: tuple[str, ...] = ()) -> None:
        """SNK-2: a version of each page (base, url, content, head). One site must have the base; a page without any, or whose times can't
        be read, isn't stored. The site's own change time is the latest of its pages': see websites(). key: columns that tell apart pages
        at one url that are stored at one time; each then has versions and ids of its own."""
        sites = self.read("websites").groupBy("url").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("website_id"))
        sites = sites.filter(F.assert_true(F.col("_n") == 1, "a site is stored twice").isNull()).select(F.col("url").alias("base"), "website_id")
        # Of the stored versions only those of pages at hand are aggregated.
        before = self.read("webpages").join(pages.select("url").distinct(), "url", "left_semi")
        carry = created_carry(before, F.lit(None).cast("timestamp_ntz"))
        rows = pages.join(sites, "base").join(carry, "url", "left")
        times = ("published_time", "modified_time", "expiration_time")
        rows = rows.withColumns({t: parse_datetime(F.col(f"head.{t}")) for t in times})
        for t in times:
            rows = rows.filter(F.col(f"head.{t}").isNull() | (F.col(f"head.{t}") == "") | F.col(t).isNotNull())
        head = {"revisit": "revisit_after", "title": "title", "description": "description", "author": "author", "section": "section", "tag": "article_tag", "keywords": "keywords"}
        self.add("webpages", rows.select(
            F.xxhash64("url", *key, now).alias("id"), surrogate("url", *key).alias("page"), "website_id", "url", F.coalesce("crawl_created", now).alias("crawl_created"), now.alias("crawl_modified"), "content", *times,
            *[F.col(f"head.{b}").alias(a) for a, b in head.items()],
        ))

    def add_paragraphs(self, rows: DataFrame, key: tuple[str, ...] = ()) -> None:
        """SNK-3, SNK-4: rows (url, pos, paragraph[, h1..h6]) at the latest version of their page: of their url or, with the key that
        add_pages() had and columns of it in rows, of the page that it tells apart."""
        of = "page" if key else "url"
        page = latest_version(self.read("webpages"), of).select(of, F.col("id").alias("webpage_id"))
        levels = [c for c in ("h1", "h2", "h3", "h4", "h5", "h6") if c in rows.columns]
        found = (rows.withColumn("page", surrogate("url", *key)) if key else rows).join(page, of)
        if levels:
            found = found.withColumn("headings_id", F.when(F.coalesce(*levels).isNotNull(), F.xxhash64("webpage_id", *levels)))
            self.add("headings", found.filter("headings_id is not null").select(F.col("headings_id").alias("id"), "webpage_id", *levels).dropDuplicates(["id"]))
        else:
            found = found.withColumn("headings_id", F.lit(None).cast("long"))
        self.add("paragraphs", found.select(F.xxhash64("webpage_id", "pos").alias("id"), "webpage_id", "headings_id", "paragraph"))

    def websites(self) -> DataFrame:
        """SNK-2: the sites, modified when one of their pages last was."""
        last = self.read("webpages").groupBy("website_id").agg(F.max(BY_TIME).alias("_m"))
        sites = self.read("websites")
        return sites.join(last, sites["id"] == last["website_id"], "left").withColumn("modified", F.greatest("modified", "_m")).select(*sites.columns)

    def page_paragraphs(self) -> DataFrame:
        """J-8: pages with their paragraphs and headings."""
        p, h = self.read("paragraphs"), self.read("headings")
        pages = self.read("webpages").select(F.col("id").alias("webpage_id"), "website_id", "url")
        return pages.join(p.withColumnRenamed("id", "paragraph_id"), "webpage_id").join(h.withColumnRenamed("id", "headings_id").drop("webpage_id"), "headings_id", "left")


def save_bodies(pages: DataFrame, path: str) -> None:
    """SNK-6: raw pages (base, url, body) under the names of FN-11, apart from all else."""
    pages.select(temp_name(F.col("base"), F.col("url")).alias("name"), "url", "body").write.mode("append").parquet(path)


def load_bodies(spark: SparkSession, path: str) -> DataFrame:
    """SNK-6: name, url, body; drop() of siteloom.shared removes them afterwards."""
    return spark.read.schema("name string, url string, body binary").parquet(path)


def write_with(rows: DataFrame, sink: Callable[[DataFrame], None], steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> None:
    """SNK-8, UD-2, UD-3: a sink of the caller's own, after its transformations."""
    for step in steps:
        rows = rows.transform(step)
    sink(rows)
