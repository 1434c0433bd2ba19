"""Sitemaps (SRC-5 to SRC-11, EX-16 to EX-18, DF-9, DF-19)."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable, Sequence
from xml.etree.ElementTree import ParseError, XMLPullParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.urls import sitemap_url, url_explicit
from siteloom.operators import content
from siteloom.schemas import SITEMAP

# The elements of a record and the fields that they become.
FIELDS = {"loc": "links", "lastmod": "modified_time", "changefreq": "revisit"}
_NONE = {"links": None, "modified_time": None, "revisit": None}
_TYPE = pa.struct([("kind", pa.string()), ("records", pa.list_(pa.struct([(f, pa.string()) for f in _NONE])))])


def read_kind(url: Column) -> Column:
    """SRC-5: gzip, text or xml, by the address."""
    return F.when(url.endswith(".gz"), "gzip").when(url.endswith(".txt"), "text").otherwise("xml")


def read_address(url: Column, base: Column) -> Column:
    """SRC-5: where a sitemap is read; /sitemapindex/ stands for the base less ten characters and "sitemapindex"."""
    return F.when(url == "/sitemapindex/", F.concat(F.substring(base, F.lit(1), F.greatest(F.length(base) - 10, F.lit(0))), F.lit("sitemapindex"))).otherwise(url)


def read_xml(text: str) -> dict:
    """EX-16 and EX-17. kind: index, urlset, or none where neither element occurs or the text isn't well-formed.

    A record ends where one of its fields comes again, so what a record lacks may come from the next one.
    """
    parser = XMLPullParser(["end"])
    values: list[tuple[str, str]] = []
    seen: set[str] = set()
    try:
        parser.feed(text.lstrip("﻿ \t\r\n"))
        parser.close()
        for _, e in parser.read_events():
            tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
            seen.add(tag)
            if tag in FIELDS:
                values.append((FIELDS[tag], e.text or ""))
    except ParseError:
        return {"kind": "none", "records": []}
    kind = "index" if "sitemap" in seen else "urlset" if "url" in seen else "none"
    if kind == "none":
        return {"kind": kind, "records": []}
    records: list[dict] = []
    now: dict[str, str] = {}
    for name, value in values:
        if name in now:
            records.append(_NONE | now)
            now = {}
        now[name] = value
    return {"kind": kind, "records": [*records, _NONE | now] if now else records}


def namespace(xml: Column) -> Column:
    """FN-23: {namespace} of the first element, the empty string where it names none."""
    first = F.regexp_extract(xml, r"<[A-Za-z_][^>]*>", 0)
    name = F.regexp_extract(first, r"""\sxmlns\s*=\s*["']([^"']*)["']""", 1)
    return F.when(name != "", F.concat(F.lit("{"), name, F.lit("}"))).otherwise(F.lit(""))


def _text(body: bytes, zipped: bool) -> str | None:
    try:
        return (gzip.decompress(body) if zipped else body).decode("utf-8")
    except (OSError, EOFError, UnicodeDecodeError, zlib.error):
        return None


def parse(body: Column, kind: Column) -> Column:
    """struct<kind,records> of a body (binary); what can't be read is of kind none. Text sitemaps give their lines as links."""

    @F.arrow_udf(SITEMAP)
    def run(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
        out = []
        for b, k in zip(bodies.to_pylist(), kinds.to_pylist(), strict=True):
            text = None if b is None else _text(b, k == "gzip")
            if text is None:
                out.append({"kind": "none", "records": []})
            elif k == "text":
                out.append({"kind": "text", "records": [_NONE | {"links": x} for line in text.split("\n") for x in line.split("\r")]})
            else:
                out.append(read_xml(text))
        return pa.array(out, _TYPE)

    return run(body, kind)


def _records(docs: DataFrame) -> DataFrame:
    rows = docs.select("base", F.col("url").alias("sitemap_url"), F.col("map.kind").alias("kind"), F.posexplode("map.records").alias("pos", "r")).select("base", "sitemap_url", "kind", "pos", "r.*")
    # SRC-9: only lines that are urls count; XML links are judged later, with those of pages.
    return rows.filter((F.col("kind") != "text") | url_explicit(F.col("links")))


def expand(roots: DataFrame, docs: DataFrame, concurrency: int | None = None) -> DataFrame:
    """DF-9: base, sitemap_url, pos, links, modified_time, revisit of all urls below the roots (base, url).

    docs (url, body) are the stored files, missing ones are skipped. An index's entry is read at its own address; where that file is no
    url set (another index isn't one either), under base/sitemap/ and then base/sitemaps/; the first that is missing ends the search.
    concurrency: DF-14, how many tasks may read sitemaps at once; without it as many as there are partitions.
    """
    at = read_address(sitemap_url(F.col("url"), F.col("base")), F.col("base"))
    capped = lambda df: df.coalesce(concurrency) if concurrency else df
    top = capped(roots.select("base", at.alias("url")).distinct().join(docs.select("url", "body"), "url"))
    top = top.withColumn("map", parse(F.col("body"), read_kind(F.col("url")))).drop("body")
    index = _records(top.filter("map.kind = 'index'")).filter("links is not null")
    name = F.substring_index("links", "/", -1)
    tries = F.array(F.col("links"), F.concat("base", F.lit("/sitemap/"), name), F.concat("base", F.lit("/sitemaps/"), name))
    asked = index.select("base", "sitemap_url", "pos", F.posexplode(tries).alias("try", "url"))
    files = capped(docs.join(asked.select("url").distinct(), "url", "left_semi").select("url", "body")).withColumn("map", parse(F.col("body"), F.lit("xml"))).drop("body")
    met = asked.join(files, "url", "left").withColumn("ends", F.col("map").isNull() | (F.col("map.kind") == "urlset"))
    first = Window.partitionBy("base", "sitemap_url", "pos").orderBy("try")
    chosen = met.filter("ends").withColumn("_n", F.row_number().over(first)).filter("_n = 1 and map is not null").select("base", "url", "map")
    leaves = _records(top.filter("map.kind in ('urlset', 'text')").unionByName(chosen.select("url", "base", "map")))
    return leaves.select("base", "sitemap_url", "pos", "links", "modified_time", "revisit")


def first_fit(body: Column, readers: Sequence[Callable[[Column], Column]]) -> Column:
    """UD-5: what the first of the readers gives that can read the body; a reader gives a struct<kind,records> of kind none where it
    can't. What none of them reads is of kind none."""
    fits = [F.when(r["kind"] != "none", r) for r in (read(body) for read in readers)]
    nothing = F.from_json(F.lit('{"kind":"none","records":[]}'), SITEMAP)
    return F.coalesce(*fits, nothing)


def only(kind: str, read: str = "xml") -> Callable[[Column], Column]:
    """A reader for first_fit that takes one kind of sitemap."""

    def reader(body: Column) -> Column:
        found = parse(body, F.lit(read))
        return F.when(found["kind"] == kind, found).otherwise(F.from_json(F.lit('{"kind":"none","records":[]}'), SITEMAP))

    return reader


def longest(columns: Sequence[str]) -> Column:
    """AG-3: the number of values of the attribute that has most."""
    return F.greatest(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])


def missing(a: Column, b: Column) -> Column:
    """ST-2: the names of a that b lacks."""
    return F.array_except(a, b)


def padded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """EX-18 over array columns: shorter ones are filled up with empty strings."""
    n = longest(columns)
    return df.withColumns({c: F.concat(F.col(c), F.array_repeat(F.lit(""), n - F.size(c))) for c in columns})


def html_sitemap(pages: DataFrame, html: str = "html") -> DataFrame:
    """SRC-10: an HTML page's links as records."""
    rows = content.parsed(pages, ("a",), html).withColumn("_l", F.explode(content.links(F.col("nodes"))))
    return rows.select(*[c for c in pages.columns if c != html], F.col("_l.pos").alias("pos"), F.col("_l.href").alias("links"), F.lit(None).cast("string").alias("modified_time"), F.lit(None).cast("string").alias("revisit"))


def rss_items(xml: Column) -> Column:
    """SRC-11: array<struct<links,modified_time>> of the items of a feed, the build date or else the publishing date."""
    feed = F.from_xml(xml, F.lit("channel struct<item:array<struct<link:string,lastBuildDate:string,pubDate:string>>>"))
    return F.transform(feed["channel"]["item"], lambda i: F.struct(i["link"].alias("links"), F.coalesce(F.nullif(i["lastBuildDate"], F.lit("")), i["pubDate"]).alias("modified_time")))


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """EX-18: records of two containers; what one of them lacks is the empty string."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.fillna("", subset=[c for c, t in both.dtypes if t == "string"])


def fresh_links(records: DataFrame, pages: DataFrame, intent: bool = False) -> DataFrame:
    """DF-19: records (links, modified_time) whose page was never stored, or was stored after the last change; intent: before it."""
    latest = pages.groupBy("url").agg(F.max("crawl_modified").alias("_stored"))
    joined = records.join(latest, records["links"] == latest["url"], "left")
    changed = F.to_timestamp_ntz(F.substring("modified_time", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    stale = (F.col("_stored") < changed) if intent else (F.col("_stored") > changed)
    return joined.filter(F.col("_stored").isNull() | stale).select(*records.columns)
