"""What pages hold: head metadata, links, paragraphs, headings, generic extraction, date-times (EX-2 to EX-14).

All work on the array of nodes that one pass over a page gives, with array functions inside the row, so no page is parsed twice and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.text import datetime_strings, parse_datetime, stringify, trim_blanks
from siteloom.functions.urls import url_rules
from siteloom.sources.html import html_nodes, spread

# Which meta element names which field.
META_NAME = {"keywords": "keywords", "description": "description", "author": "author", "revisit-after": "revisit_after", "robots": "robots"}
META_PROPERTY = {
    "og:description": "description", "og:title": "title", "article:published_time": "published_time", "article:modified_time": "modified_time",
    "article:expiration_time": "expiration_time", "article:author": "author", "article:section": "section", "article:tag": "article_tag",
}
HEAD_FIELDS = ("title", "base", "keywords", "description", "author", "revisit_after", "robots", "published_time", "modified_time", "expiration_time", "section", "article_tag")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PAGE_TAGS = ("title", "base", "meta", "a", "p", "li", "time", *HEADINGS)
NO_FOLLOW = ("noarchive", "nosnippet", "noindex", "nofollow")


def parsed(pages: DataFrame, tags: tuple[str, ...] = PAGE_TAGS, html: str = "html", within: str | None = None, xml: bool = False) -> DataFrame:
    """pages with nodes in place of html: the one parse that everything else branches off. xml chooses the other parser (UD-4)."""
    return spread(pages).withColumn("nodes", html_nodes(F.col(html), tags, within, xml)).drop(html)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once and not for each element of what use goes over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _of(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def _lookup(key: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), key)


def head(nodes: Column, in_memory: bool = False) -> Column:
    """EX-2: struct of HEAD_FIELDS. title and base: the last element's text wins; meta: the first one wins, even with no content.
    in_memory is EX-2a: a page that never was a file has no head, so all fields are null."""
    if in_memory:
        return F.struct(*[F.lit(None).cast("string").alias(name) for name in HEAD_FIELDS])
    metas = F.transform(
        _of(nodes, "meta"),
        lambda n: F.struct(
            F.coalesce(_lookup(F.try_element_at(n["attrs"], F.lit("name")), META_NAME), _lookup(F.try_element_at(n["attrs"], F.lit("property")), META_PROPERTY)).alias("field"),
            F.try_element_at(n["attrs"], F.lit("content")).alias("value"),
        ),
    )

    def one(name: str) -> Column:
        first = F.get(F.filter(metas, lambda m: m["field"] == name), F.lit(0))["value"]
        if name not in ("title", "base"):
            return first
        own = _of(nodes, name)
        return F.when(F.size(own) > 0, F.try_element_at(own, F.lit(-1))["own"]).otherwise(first)

    return F.struct(*[one(name).alias(name) for name in HEAD_FIELDS])


def links(nodes: Column, respect_rel: bool = False) -> Column:
    """array<struct<pos,href>>: EX-3, the first element of each href, unless an attribute named robots forbids it.

    respect_rel is EX-4: FN-2 must take the href and rel must not be one of the words, before duplicates are dropped.
    """
    attr = lambda n, k: F.try_element_at(n["attrs"], F.lit(k))
    anchors = F.filter(_of(nodes, "a"), lambda n: F.coalesce(attr(n, "href"), F.lit("")) != "")
    if respect_rel:
        anchors = F.filter(anchors, lambda n: url_rules(attr(n, "href")) & ~F.coalesce(attr(n, "rel").isin(*NO_FOLLOW), F.lit(False)))
    # Sorted by href and place, an entry is the first of its href if the one before it has another.
    by_href = F.sort_array(F.transform(anchors, lambda n: F.struct(attr(n, "href").alias("href"), n["pos"].alias("pos"), attr(n, "robots").alias("robots"))))
    first = _let(by_href, lambda rows: F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["href"] != r["href"])))
    if not respect_rel:
        first = F.filter(first, lambda r: ~F.coalesce(r["robots"].isin(*NO_FOLLOW), F.lit(False)))
    return F.sort_array(F.transform(first, lambda r: F.struct(r["pos"].alias("pos"), r["href"].alias("href"))))


def paragraphs(nodes: Column, *tags: str) -> Column:
    """array<struct<pos,paragraph>>: EX-5 and FN-14, the trimmed texts that are not empty, in document order."""
    rows = F.transform(_of(nodes, *(tags or ("p",))), lambda n: F.struct(n["pos"].alias("pos"), trim_blanks(n["text"]).alias("paragraph")))
    return F.filter(rows, lambda r: r["paragraph"] != "")


def paragraphs_with_headings(nodes: Column) -> Column:
    """array<struct<pos,paragraph,h1..h6>>: EX-6, each p and li with the last heading of each level before it; lower levels stay."""
    texts = F.filter(F.transform(_of(nodes, *HEADINGS), lambda n: F.struct(n["pos"].alias("pos"), n["tag"].alias("tag"), trim_blanks(n["text"]).alias("text"))), lambda h: h["text"] != "")

    def with_headings(p: Column, texts: Column) -> Column:
        level = lambda h: F.try_element_at(F.filter(texts, lambda x: (x["tag"] == h) & (x["pos"] < p["pos"])), F.lit(-1))["text"]
        last = [level(h).alias(h) for h in HEADINGS]
        return F.struct(p["pos"].alias("pos"), p["paragraph"].alias("paragraph"), *last)

    return _let(texts, lambda known: F.transform(paragraphs(nodes, "p", "li"), lambda p: with_headings(p, known)))


def forward_fill(rows: DataFrame, page: str, pos: str, columns: tuple[str, ...] = HEADINGS) -> DataFrame:
    """WN-3: the same over exploded rows."""
    w = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


@dataclass(frozen=True)
class Field:
    """EX-7, UD-1: elements of tag, of which attr or, without one, the text is taken, under name, attr or tag."""

    tag: str
    attr: str | None = None
    name: str | None = None

    @property
    def column(self) -> str:
        return self.name or self.attr or self.tag


def extract(pages: DataFrame, fields: list[Field], within: str | None = None, html: str = "html", edit: Callable[[DataFrame], DataFrame] | None = None, xml: bool = False) -> DataFrame:
    """EX-7 to EX-9: an array column for each field; within selects the part of the page, edit is applied to the result, xml is UD-4."""
    df = parsed(pages, tuple(dict.fromkeys(f.tag for f in fields)), html, within, xml)
    value = lambda f: lambda n: stringify(n["text"] if f.attr is None else F.try_element_at(n["attrs"], F.lit(f.attr)))
    out = df.withColumns({f.column: F.transform(_of(F.col("nodes"), f.tag), value(f)) for f in fields}).drop("nodes")
    return edit(out) if edit else out


def zip_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """EX-10: one row per place of arrays of one length; where lengths differ it ends with the shortest."""
    n = F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    cut = df.withColumns({c: F.slice(c, F.lit(1), n) for c in columns})
    return cut.withColumn("_z", F.explode(F.arrays_zip(*columns))).select(*[c for c in df.columns if c not in columns], *[F.col(f"_z.{c}").alias(c) for c in columns])


def project(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """EX-11: columns under other names."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items()])


def page_datetimes(pages: DataFrame, html: str = "html") -> DataFrame:
    """EX-13: the first time element's text or datetime attribute if there is one, else the strings of EX-12; each with its value."""
    df = spread(pages).withColumn("nodes", html_nodes(F.col(html), ("time",)))
    first = F.get(F.col("nodes"), F.lit(0))
    tagged = F.coalesce(F.try_element_at(first["attrs"], F.lit("datetime")), first["text"])
    found = F.when(F.size("nodes") > 0, F.array(tagged)).otherwise(datetime_strings(F.col(html)))
    rows = df.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("pos", "raw"))
    return rows.withColumn("value", parse_datetime(F.col("raw"), fuzzy=True)).filter("value is not null")


def locate_datetimes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """EX-14: for each date-time string, the innermost element whose text or attributes hold it, and the shortest ending of its path
    that no other element of the page shares."""
    df = spread(pages).withColumn("nodes", html_nodes(F.col(html), None)).withColumn("raw", F.explode(F.array_distinct(datetime_strings(F.col(html)))))
    in_attr = F.filter("nodes", lambda n: F.exists(F.map_values(n["attrs"]), lambda v: F.contains(v, F.col("raw"))))
    in_text = F.filter("nodes", lambda n: F.contains(n["text"], F.col("raw")))
    where = F.when(F.size(in_attr) > 0, F.get(in_attr, F.lit(0))["path"]).otherwise(F.try_element_at(in_text, F.lit(-1))["path"])
    plain = lambda p: F.regexp_replace(p, r"\[\d+\]", "")
    df = df.select(key, "raw", (F.size(in_attr) > 0).alias("in_attribute"), plain(where).alias("path"), F.transform("nodes", lambda n: plain(n["path"])).alias("paths")).filter("path is not null")
    steps = F.split(F.substring("path", F.lit(2), F.length("path")), "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.size(steps) - k + 1, k), "/"))
    alone = F.filter(endings, lambda e: F.size(F.filter("paths", lambda p: F.concat(F.lit("/"), p).endswith(F.concat(F.lit("/"), e)))) == 1)
    return df.select(key, "raw", "in_attribute", "path", F.get(alone, F.lit(0)).alias("shortest"))
