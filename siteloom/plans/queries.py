"""One query per operator group of SURVEY 2, and the same in DuckDB's SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.config import Settings
from siteloom.functions import text, urls
from siteloom.operators import content, frontier, robots, sitemaps, store
from siteloom.plans import crawl

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    """Queries by name, the SQL of those that have any, and the decorator that fills both."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query


QUERIES, ORACLES, query = registry()


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# --- fragments of SQL that several oracles share
_BASE = r"regexp_extract({}, '(?i)^https?://[\w\-.]+')"
_PAGE_BASE = _BASE.format("url")
_HREFS = """
hrefs AS (
  SELECT page_id, url, href, min(i) AS i FROM (
    SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
  ) WHERE href <> '' GROUP BY page_id, url, href
)"""
_UNESCAPE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_U = "trim({0}, '/')"
# Fixed values, spelled out here so that a wrong constant in the library shows.
_ALTERNATION = (
    "creativecommons|facebook|feedly|flickr|github|google|instagram|last[.]fm|linkedin|mozzila|"
    "openstreetmap|opera|sciencedirect|twitter|vimeo|wikimedia|wikipedia|wiley|youtube|sciencecommons"
)
_URL = (
    r"(?i)^(?:http|ftp)s?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?[.])+(?:[A-Z]{2,6}[.]?|[A-Z0-9-]{2,}[.]?)|localhost|"
    r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})(?::[0-9]+)?(?:/?|[/?]\S+)$"
)
_RULES = (
    "(length({u}) < 4 OR (substr({u}, -4, 1) <> '.' AND NOT (substr({u}, -1, 1) = 'x' AND length({u}) >= 5 AND substr({u}, -5, 1) = '.') AND NOT regexp_matches({u}, '"
    + _ALTERNATION
    + "')))"
)


def _rules(x: str) -> str:
    return _RULES.format(u=_U.format(x))


def _explicit(x: str) -> str:
    return f"(regexp_matches({x}, '{_URL}') AND {_rules(x)})"


_MOBILE = "trim(trim(trim({}, 'htp:/'), 'm.'), 'w.')"


def _belongs(u: str, b: str) -> str:
    return f"CASE WHEN starts_with({u}, 'http://m.') OR starts_with({b}, 'http://m.') THEN starts_with({_MOBILE.format(u)}, {_MOBILE.format(b)}) ELSE starts_with({u}, {b}) END"


_PARAGRAPHS = rf"""
parts AS (
  SELECT page_id, url, unnest(l) AS part, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, string_split(html, '<p>')[2:] AS l FROM pages)
), texts AS (
  SELECT page_id, url, i, trim({_UNESCAPE.format("regexp_replace(regexp_extract(part, '^(.*?)(?:</p>|</article>|$)', 1, 's'), '<[^>]*>', '', 'g')")}, ' ' || chr(9) || chr(10) || chr(13)) AS paragraph FROM parts
)"""


# --- flagship
@query(f"""
WITH {_HREFS}, {_PARAGRAPHS},
p AS (SELECT page_id, {_PAGE_BASE} AS base FROM pages)
SELECT base, count(*) AS n_pages, sum(coalesce(l.n, 0))::BIGINT AS n_links, sum(coalesce(t.n, 0))::BIGINT AS n_paragraphs, sum(coalesce(t.c, 0))::BIGINT AS n_chars
FROM p LEFT JOIN (SELECT page_id, count(*) AS n FROM hrefs GROUP BY 1) l USING (page_id)
LEFT JOIN (SELECT page_id, count(*) AS n, sum(length(paragraph)) AS c FROM texts WHERE paragraph <> '' GROUP BY 1) t USING (page_id)
WHERE base <> '' GROUP BY base""")
def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-1, EX-3, EX-5, AG-2, AG-4: pages, links and paragraphs of each site."""
    pages = content.parsed(_read(spark, sf_dir, "pages", "url", "html"), ("a", "p"))
    ps = content.paragraphs(F.col("nodes"))
    rows = pages.select(urls.parse_base(F.col("url")).alias("base"), F.size(content.links(F.col("nodes"))).alias("l"), F.transform(ps, lambda p: F.length(p["paragraph"])).alias("c"))
    sizes = rows.select("base", "l", F.size("c").alias("p"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("c"))
    return sizes.filter("base is not null").groupBy("base").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("l").alias("n_links"), F.sum("p").alias("n_paragraphs"), F.sum("c").alias("n_chars")
    )


# --- urls
@query(f"SELECT page_id, nullif({_PAGE_BASE}, '') AS base FROM pages")
def url_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-1."""
    return _read(spark, sf_dir, "pages", "page_id", "url").select("page_id", urls.parse_base(F.col("url")).alias("base"))


#: Endings that the fixtures lack, so that each rule is met.
_ENDINGS = ["", "/x.docx", "/x.pdf", ".htm", ".com", "/github/a", "/lastxfm", "/last.fm/a", "/a b"]


def _with_endings(df: DataFrame) -> DataFrame:
    return df.withColumn("variant", F.explode(F.array(*[F.lit(e) for e in _ENDINGS]))).withColumn("u", F.concat("url", "variant"))


_VARIANTS = f"v AS (SELECT page_id, variant, url || variant AS u FROM pages, (SELECT unnest({_ENDINGS!r}) AS variant))"


@query(f"WITH {_VARIANTS} SELECT page_id, variant, {_rules('u')} AS valid FROM v")
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-2."""
    return _with_endings(_read(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "variant", urls.url_rules(F.col("u")).alias("valid"))


@query(f"""WITH {_VARIANTS} SELECT page_id, variant, length({_U.format("u")}) < 4 OR ((right({_U.format("u")}, 3) IN ('htm', 'com', 'org', 'edu', 'gov') OR substr({_U.format("u")}, -4, 1) <> '.')
AND NOT (substr({_U.format("u")}, -1, 1) = 'x' AND length({_U.format("u")}) >= 5 AND substr({_U.format("u")}, -5, 1) = '.') AND NOT regexp_matches({_U.format("u")}, '{_ALTERNATION}')) AS valid FROM v""")
def url_rules_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-2 as meant."""
    return _with_endings(_read(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "variant", urls.url_rules_intent(F.col("u")).alias("valid"))


@query(f"WITH {_VARIANTS} SELECT page_id, variant, {_explicit('u')} AS valid FROM v")
def url_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-3."""
    return _with_endings(_read(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "variant", urls.url_explicit(F.col("u")).alias("valid"))


@query("SELECT page_id, split_part(url, '#', 1) AS bare FROM pages WHERE split_part(url, '#', 1) <> ''")
def url_fragment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-7."""
    return _read(spark, sf_dir, "pages", "page_id", "url").select("page_id", urls.strip_fragment(F.col("url")).alias("bare")).filter("bare <> ''")


@query("SELECT page_id, trim(url, '/') AS bare FROM pages")
def url_slash_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-9."""
    return _read(spark, sf_dir, "pages", "page_id", "url").select("page_id", urls.strip_slashes(F.col("url")).alias("bare"))


@query(f"WITH b AS (SELECT page_id, url, regexp_replace({_PAGE_BASE}, '^https?://(www[.]|m[.])?', 'http://m.') AS base FROM pages) SELECT page_id, base, {_belongs('url', 'base')} AS belongs FROM b")
def mobile_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-6: each page against the mobile form of its own site."""
    base = F.regexp_replace(urls.parse_base(F.col("url")), r"^https?://(www[.]|m[.])?", "http://m.")
    return _read(spark, sf_dir, "pages", "page_id", "url").select("page_id", base.alias("base"), urls.belongs_to_base(F.col("url"), base).alias("belongs"))


@query(f"SELECT DISTINCT base, trim(base || '/robots.txt', '/robots.txt') AS stripped, base AS meant FROM (SELECT {_PAGE_BASE} AS base FROM pages) WHERE base <> ''")
def robots_base_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-20, as it runs and as meant."""
    at = F.concat("base", F.lit("/robots.txt"))
    bases = _read(spark, sf_dir, "pages", "url").select(urls.parse_base(F.col("url")).alias("base")).filter("base is not null").distinct()
    return bases.select("base", urls.robots_base(at).alias("stripped"), urls.robots_base(at, True).alias("meant"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, base, n, href of every link."""
    pages = content.parsed(_read(spark, sf_dir, "pages"), ("a",))
    return pages.select("page_id", "url", urls.parse_base(F.col("url")).alias("base"), F.posexplode(content.links(F.col("nodes"))).alias("n", "_l")).select("page_id", "url", "base", "n", F.col("_l.href").alias("href"))


@query(rf"""WITH {_HREFS}, u AS (SELECT page_id, href, regexp_extract(url, '^https?://[\w\-.]+') AS base FROM hrefs)
SELECT page_id, href, base || list_aggregate(list_transform(string_split(href, ''), lambda c: CASE WHEN unicode(c) BETWEEN 128 AND 255 OR c IN ('"', '''', ':') THEN '%' || lower(to_hex(unicode(c))) WHEN c = '‘' THEN '%2018' ELSE c END), 'string_agg', '') AS uri FROM u""")
def iri_to_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-4 over resolved links."""
    return _links(spark, sf_dir).select("page_id", "href", urls.iri_to_uri(F.concat("base", "href")).alias("uri"))


@query(r"""WITH f AS (SELECT page_id, regexp_replace(url || '/' || repeat('n', (page_id % 120)::INT) || '.data', '[\s;:''"!@#$%*()=+<>?|{}~`^\[\]]', '', 'g') AS f FROM pages)
SELECT page_id, CASE WHEN length(f) > 80 THEN left(f, 80) || CASE WHEN length(string_split(f, '.')[-1]) < 6 THEN string_split(f, '.')[-1] ELSE '' END ELSE f END AS name FROM f""")
def filename_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-5."""
    name = F.concat("url", F.lit("/"), F.repeat(F.lit("n"), (F.col("page_id") % 120).cast("int")), F.lit(".data"))
    return _read(spark, sf_dir, "pages", "page_id", "url").select("page_id", urls.filename(name).alias("name"))


@query(rf"""WITH b AS (SELECT page_id, {_PAGE_BASE} AS base, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'www.x.nl/' || page_id || '/' ELSE '/map' || page_id || '.xml' END AS u FROM pages)
SELECT page_id, u, CASE WHEN starts_with(u, 'http') THEN u WHEN starts_with(u, 'www') THEN 'http://' || trim(u, '/') ELSE base || '/' || trim(u, '/') END AS address FROM b""")
def sitemap_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-10."""
    i = F.col("page_id").cast("string")
    u = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("www.x.nl/"), i, F.lit("/"))).otherwise(F.concat(F.lit("/map"), i, F.lit(".xml")))
    return _read(spark, sf_dir, "pages", "page_id", "url").select("page_id", u.alias("u"), urls.sitemap_url(u, urls.parse_base(F.col("url"))).alias("address"))


@query(r"""WITH b AS (SELECT page_id, url, regexp_extract(url, '(?i)^https?://[\w\-.]+') AS base FROM pages)
SELECT page_id, string_split(base, '//')[2] AS queue, 'thread_' || coalesce(string_split(base, '.')[-2], '') || '_' || string_split(url, '/')[-1] || '.data' AS temp FROM b""")
def queue_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-11."""
    base = urls.parse_base(F.col("url"))
    return _read(spark, sf_dir, "pages", "page_id", "url").select("page_id", urls.queue_name(base).alias("queue"), urls.temp_name(base, F.col("url")).alias("temp"))


# --- content
@query(f"WITH {_HREFS} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS n, href FROM hrefs")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-3."""
    return _links(spark, sf_dir).select("page_id", "n", "href")


_RESOLVED = f"resolved AS (SELECT page_id, {_PAGE_BASE} AS base, {_PAGE_BASE} || split_part(href, '#', 1) AS u FROM hrefs WHERE split_part(href, '#', 1) <> '')"


@query(f"WITH {_HREFS}, {_RESOLVED} SELECT page_id, trim(u, '/') AS url FROM resolved WHERE {_explicit('u')}")
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-4: FN-7, FN-8, FN-3, FN-9."""
    return frontier.normalise_links(_links(spark, sf_dir).select("page_id", "base", "href")).select("page_id", "url")


@query(f"SELECT page_id, {_UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages")
def head_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-2 on the pages as they are."""
    return content.parsed(_read(spark, sf_dir, "pages", "page_id", "html"), ("title", "meta")).select("page_id", content.head(F.col("nodes"))["title"].alias("title"))


def _meta_html() -> Column:
    """Heads with all fields: which come first or twice, or lack content, depends on page_id."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    return F.concat(
        F.lit('<html><head><meta property="og:title" content="og '), i, F.lit('">'),
        F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("<title>first</title><title>t "), i, F.lit("</title>"))),
        F.when(k == 1, F.lit('<meta name="description">')).otherwise(F.lit("")),
        F.lit('<meta name="description" content="d '), i, F.lit('"><meta property="og:description" content="late">'),
        F.lit('<META NAME="keywords" CONTENT="a, b"><meta name="author" property="article:section" content="x &amp; y">'),
        F.lit('<meta name="other" property="article:section" content="news"><meta property="article:published_time" content="2015-07-05T18:10">'),
        F.lit('<meta name="robots" content="'), F.element_at(F.array(*map(F.lit, ["NoIndex", "nofollow", "none", "NOARCHIVE, NoFollow"])), (k + 1).cast("int")), F.lit('">'),
        F.lit("</head><body><p>x</p></body></html>"),
    )


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'og ' || page_id ELSE 't ' || page_id END AS title, CASE WHEN page_id % 4 = 1 THEN NULL ELSE 'd ' || page_id END AS description,
'a, b' AS keywords, 'x & y' AS author, 'news' AS section, '2015-07-05T18:10' AS published_time, NULL::VARCHAR AS modified_time FROM pages""")
def head_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-2, AG-6: last title, first meta, name before property."""
    pages = content.parsed(_read(spark, sf_dir, "pages", "page_id").withColumn("html", _meta_html()), ("title", "base", "meta"))
    return pages.select("page_id", content.head(F.col("nodes")).alias("h")).select("page_id", *[f"h.{c}" for c in ("title", "description", "keywords", "author", "section", "published_time", "modified_time")])


@query("""WITH r AS (SELECT page_id, ['noindex', 'nofollow', 'none', 'noarchive, nofollow'][(page_id % 4 + 1)::INT] AS robots FROM pages)
SELECT page_id, robots, NOT contains(robots, 'nofollow') AS followable, NOT regexp_matches(robots, 'noarchive|nosnippet|noindex') AS archivable FROM r""")
def robots_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-15 to FN-17."""
    pages = content.parsed(_read(spark, sf_dir, "pages", "page_id").withColumn("html", _meta_html()), ("meta",))
    r = content.head(F.col("nodes"))["robots"]
    return pages.select("page_id", text.robots_meta(r).alias("robots"), text.followable(r).alias("followable"), text.archivable(r).alias("archivable"))


@query(f"WITH {_PARAGRAPHS} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS n, paragraph FROM texts WHERE paragraph <> ''")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-5, FN-14."""
    pages = content.parsed(_read(spark, sf_dir, "pages", "page_id", "html"), ("p",))
    return pages.select("page_id", F.posexplode(content.paragraphs(F.col("nodes"))).alias("n", "_p")).select("page_id", "n", F.col("_p.paragraph").alias("paragraph"))


@query(f"""WITH {_PARAGRAPHS}, h AS (SELECT page_id, trim({_UNESCAPE.format("regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')")}) AS h1 FROM pages)
SELECT page_id, paragraph, h1 FROM texts JOIN h USING (page_id) WHERE paragraph <> ''""")
def paragraphs_with_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-6: what stands below the page's heading."""
    pages = content.parsed(_read(spark, sf_dir, "pages", "page_id", "html"), ("p", "li", *content.HEADINGS))
    rows = pages.select("page_id", F.explode(content.paragraphs_with_headings(F.col("nodes"))).alias("r"))
    return rows.select("page_id", "r.paragraph", "r.h1").filter("h1 is not null")


@query(f"""WITH {_HREFS} SELECT page_id, {_UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS heading, 'utf-8' AS charset,
(SELECT count(*) FROM (SELECT unnest(regexp_extract_all(p.html, '<a href'))))::INT AS n_links FROM pages p""")
def generic_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-7, EX-11, UD-1: a declared extraction."""
    fields = [content.Field("h1", name="heading"), content.Field("meta", attr="charset"), content.Field("a", attr="href", name="links")]
    rows = content.extract(_read(spark, sf_dir, "pages", "page_id", "html"), fields)
    return rows.select("page_id", F.get("heading", F.lit(0)).alias("heading"), F.get("charset", F.lit(0)).alias("charset"), F.size("links").alias("n_links"))


@query("""WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M') AS t, year(ts) AS y, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi FROM events)
SELECT event_id, d || CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN ' | ' ELSE ' ' END || t AS raw,
CASE WHEN dd <= 12 THEN make_timestamp(y, dd, m, h, mi, 0) ELSE make_timestamp(y, m, dd, h, mi, 0) END AS value FROM e""")
def datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-12, FN-21: strings found in a page, read day first."""
    gap = F.element_at(F.array(F.lit("T"), F.lit(" | "), F.lit(" ")), (F.col("event_id") % 3 + 1).cast("int"))
    html = F.concat(F.lit("<p>on "), F.date_format("ts", "yyyy-MM-dd"), gap, F.date_format("ts", "HH:mm"), F.lit("</p>"))
    rows = _read(spark, sf_dir, "events", "event_id", "ts").select("event_id", F.explode(text.datetime_strings(html)).alias("raw"))
    # Each distinct string is read once.
    values = rows.select("raw").distinct().withColumn("value", text.parse_datetime(F.col("raw"), fuzzy=True)).filter("value is not null")
    return rows.join(values, "raw").select("event_id", "raw", "value")


@query("SELECT page_id, '2015-07-25T18:1' || (page_id % 10) AS raw, page_id % 2 = 0 AS in_attribute, CASE WHEN page_id % 2 = 0 THEN 'time' ELSE 'b' END AS shortest FROM pages")
def datetime_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-14."""
    when = F.concat(F.lit("2015-07-25T18:1"), (F.col("page_id") % 10).cast("string"))
    even = F.concat(F.lit('<html><body><div><p>a</p></div><div><p><time datetime="'), when, F.lit('">today</time></p></div></body></html>'))
    odd = F.concat(F.lit("<html><body><p>x</p><div><p>on <b>"), when, F.lit("</b></p></div></body></html>"))
    pages = _read(spark, sf_dir, "pages", "page_id").withColumn("html", F.when(F.col("page_id") % 2 == 0, even).otherwise(odd))
    return content.locate_datetimes(pages, "page_id").select("page_id", "raw", "in_attribute", "shortest")


@query("SELECT doc_id, md5(regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g')) AS text_md5 FROM documents")
def charset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12: Latin-1 bytes are told from UTF-8 and read."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.md5(F.encode(text.decode(F.encode("text", "ISO-8859-1")), "UTF-8")).alias("text_md5"))


@query("""WITH s AS (SELECT doc_id, source, max(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') AND doc_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS bad FROM documents)
SELECT doc_id, CASE WHEN bad = 1 THEN 'latin_1' ELSE 'utf_8' END AS codec FROM s""")
def charset_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12: a site stays with Latin-1 once it had to use it. Every third document is in Latin-1, the others are in UTF-8."""
    body = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "source").select("doc_id", "source", body.alias("body"))
    return text.decode_site(docs, base="source", seq="doc_id").select("doc_id", "codec")


# --- frontier
@query(f"""WITH {_HREFS}, {_RESOLVED} SELECT DISTINCT trim(u, '/') AS url FROM resolved WHERE {_explicit('u')} AND trim(u, '/') NOT IN (SELECT trim(url, '/') FROM pages)""")
def visited_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-5, J-4, AG-7: links that were never met."""
    found = frontier.normalise_links(_links(spark, sf_dir).select("base", "href")).select("url")
    return frontier.unvisited(found, _read(spark, sf_dir, "pages", "url").select(urls.strip_slashes(F.col("url")).alias("url")))


@query(f"""WITH s AS (SELECT DISTINCT {_PAGE_BASE} AS url FROM pages), w AS (SELECT url || CASE WHEN length(url) % 2 = 0 THEN '/' ELSE '' END AS url FROM s WHERE length(url) % 3 > 0)
SELECT url FROM s WHERE url <> '' AND url NOT IN (SELECT url FROM w) AND url || '/' NOT IN (SELECT url FROM w) AND length(url) % 7 <> 0""")
def seed_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-6, J-5."""
    found = _read(spark, sf_dir, "pages", "url").select(urls.parse_base(F.col("url")).alias("url")).filter("url is not null").distinct()
    sites = found.filter(F.length("url") % 3 > 0).select(F.concat("url", F.when(F.length("url") % 2 == 0, F.lit("/")).otherwise(F.lit(""))).alias("url"))
    return frontier.admit_seeds(found, sites, found.filter(F.length("url") % 7 == 0))


_BASES = f"bases AS (SELECT base, (length(base) % 2)::INT AS depth FROM (SELECT DISTINCT {_PAGE_BASE} AS base FROM pages) WHERE base <> '' AND length(base) % 3 > 0)"


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "pages", "url").select(urls.parse_base(F.col("url")).alias("base")).filter("base is not null").distinct().filter(F.length("base") % 3 > 0)
    return found.select("base", (F.length("base") % 2).cast("int").alias("depth"), F.lit(0).alias("seq"))


@query(f"""WITH {_BASES}, m AS (SELECT page_id, base, depth, row_number() OVER (PARTITION BY page_id ORDER BY depth, base) AS r FROM pages JOIN bases ON {_belongs('url', 'base')})
SELECT page_id, base, depth FROM pages LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (page_id)""")
def route_to_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-1, J-3: the first site of each page, null where there is none."""
    return frontier.route(_read(spark, sf_dir, "pages", "page_id", "url"), _bases(spark, sf_dir)).select("page_id", "base", "depth")


@query(f"""WITH {_BASES} SELECT page_id, url FROM pages WHERE NOT EXISTS (SELECT 1 FROM bases WHERE {_belongs('url', 'base')})""")
def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-2: pages of no known site."""
    return frontier.route(_read(spark, sf_dir, "pages", "page_id", "url"), _bases(spark, sf_dir)).filter("base is null").select("page_id", "url")


@query(f"""WITH c AS (SELECT {_PAGE_BASE} AS base, (page_id % 3)::INT AS depth, url, page_id AS seq FROM pages), a AS (SELECT *, {_explicit('url')} AS e, row_number() OVER (PARTITION BY base, depth ORDER BY seq) AS r FROM c WHERE depth <= 1 AND base <> '')
SELECT base, depth, arg_max(url, seq) AS url, max(seq) AS seq FROM a WHERE e OR r = 1 GROUP BY base, depth""")
def depth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-3: what a depth of one admits."""
    found = _read(spark, sf_dir, "pages", "page_id", "url").select("url", (F.col("page_id") % 3).cast("int").alias("depth"), F.col("page_id").alias("seq"))
    return frontier.append_sites(found, found.limit(0).withColumn("base", F.col("url")), Settings(crawl_depth=1)).select("base", "depth", "url", "seq")


@query(f"SELECT (page_id % 2)::INT AS depth, {_PAGE_BASE} AS base, count(*) AS n_urls FROM pages WHERE {_PAGE_BASE} <> '' GROUP BY 1, 2")
def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-18, AG-2."""
    return frontier.layer_report(_queue(spark, sf_dir))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages", "page_id", "url").select(urls.parse_base(F.col("url")).alias("base"), (F.col("page_id") % 2).cast("int").alias("depth"), "url", F.col("page_id").alias("seq"))
    return rows.filter("base is not null")


@query(f"""WITH q AS (SELECT {_PAGE_BASE} AS base, (page_id % 2)::INT AS depth, url, page_id AS seq FROM pages), h AS (SELECT *, row_number() OVER (PARTITION BY base, depth ORDER BY seq) AS r, max(seq) OVER (PARTITION BY base, depth) AS last FROM q WHERE base <> '')
SELECT base, depth, url, CASE WHEN r = 1 THEN CASE WHEN seq = last THEN 0 ELSE last + 1 END ELSE seq END AS seq FROM h""")
def queue_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-15, SNK-7: the first of each queue was in hand when the crawl stopped, and goes to the end."""
    queue = _queue(spark, sf_dir)
    return frontier.restart(queue, frontier.take_next(queue))


_NOW = "2024-01-31 12:00:00"


@query(f"SELECT event_id, user_id FROM events WHERE floor(epoch(TIMESTAMP '{_NOW}' - ts) / 86400) < 15")
def fresh_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-7, FL-3: events as visits of sites."""
    visits = _read(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumnRenamed("ts", "crawl_modified")
    return frontier.fresh_pages(visits, F.lit(_NOW).cast("timestamp_ntz")).select("event_id", "user_id")


# --- stored versions
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return e.select(F.col("event_id").alias("id"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("url"), F.col("ts").alias("crawl_modified"), F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("crawl_created"))


_VERSIONS = "v AS (SELECT event_id AS id, user_id || '/' || event_type AS url, ts AS crawl_modified, CASE WHEN event_id % 4 > 0 THEN ts END AS crawl_created FROM events)"


@query(f"WITH {_VERSIONS} SELECT url, id, crawl_modified FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawl_modified DESC, id DESC) AS r FROM v) WHERE r = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-1, SO-1, FL-2."""
    return store.latest_version(_versions(spark, sf_dir)).select("url", "id", "crawl_modified")


@query(f"WITH {_VERSIONS} SELECT url, coalesce(crawl_created, TIMESTAMP '{_NOW}') AS crawl_created FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawl_modified, id) AS r FROM v) WHERE r = 1")
def created_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-2."""
    return store.created_carry(_versions(spark, sf_dir), F.lit(_NOW).cast("timestamp_ntz"))


@query("""WITH v AS (SELECT user_id, max(ts) AS stored FROM events WHERE user_id % 3 > 0 GROUP BY user_id), r AS (SELECT DISTINCT user_id FROM events)
SELECT 'http://s.nl/' || user_id AS links FROM r LEFT JOIN v USING (user_id) WHERE stored IS NULL OR stored > TIMESTAMP '2024-01-30 00:00:00'""")
def sitemap_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-19, J-7."""
    e = _read(spark, sf_dir, "events", "user_id", "ts")
    url = F.concat(F.lit("http://s.nl/"), F.col("user_id").cast("string"))
    records = e.select(url.alias("links")).distinct().withColumn("modified_time", F.lit("2024-01-30T00:00:00+00:00"))
    return sitemaps.fresh_links(records, e.filter("user_id % 3 > 0").select(url.alias("url"), F.col("ts").alias("crawl_modified"))).select("links")


# --- robots.txt: the kind of a site's file depends on the length of its base
_BODIES = {
    0: (200, "# all\nUser-agent: *\nDisallow: /a\nAllow: /\nSitemap: /map.xml\n"),
    1: (200, "User-agent: Python-URLLIB # us\nDisallow: /b\nCrawl-delay: 12\n\nUser-agent: *\nDisallow: /\n"),
    2: (403, None),
    3: (404, None),
    4: (500, None),
}
_KIND = "(length(base) % 5)"
_SITES = f"sites AS (SELECT base, {_KIND} AS kind FROM (SELECT DISTINCT {_PAGE_BASE} AS base FROM pages) WHERE base <> '')"


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = _read(spark, sf_dir, "pages", "url").select(urls.parse_base(F.col("url")).alias("base")).filter("base is not null").distinct()
    kinds = spark.createDataFrame([(k, s, b) for k, (s, b) in _BODIES.items()], "kind int, status int, body string")
    return robots.read_robots(bases.withColumn("kind", (F.length("base") % 5).cast("int")).join(F.broadcast(kinds), "kind").select("base", "status", "body"))


@query(f"""WITH {_SITES}, rules(kind, agent, n, path, allow) AS (VALUES (0, '*', 0, '/a', false), (0, '*', 1, '/', true), (1, 'Python-URLLIB', 0, '/b', false), (1, '*', 0, '/', false))
SELECT base, agent, n, path, allow FROM sites JOIN rules USING (kind)""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-10."""
    r = _robots(spark, sf_dir).filter("robots is not null")
    groups = F.concat(
        F.transform("robots.entries", lambda e: F.struct(F.get(e["agents"], F.lit(0)).alias("agent"), e["rules"].alias("rules"))),
        F.when(F.col("robots.default_rules").isNotNull(), F.array(F.struct(F.lit("*").alias("agent"), F.col("robots.default_rules").alias("rules")))).otherwise(F.array().cast("array<struct<agent:string,rules:array<struct<path:string,allow:boolean>>>>")),
    )
    return r.select("base", F.explode(groups).alias("g")).select("base", "g.agent", F.posexplode("g.rules").alias("n", "r")).select("base", "agent", "n", "r.path", "r.allow")


@query(rf"""WITH p AS (SELECT page_id, {_PAGE_BASE} AS base, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM pages)
SELECT page_id, CASE {_KIND} WHEN 0 THEN NOT starts_with(path, '/a') WHEN 1 THEN NOT starts_with(path, '/b') WHEN 3 THEN true ELSE false END AS allowed FROM p WHERE base <> ''""")
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-11, FN-18, J-6, SRC-4."""
    pages = _read(spark, sf_dir, "pages", "page_id", "url").withColumn("base", urls.parse_base(F.col("url"))).filter("base is not null")
    return robots.can_fetch(pages, _robots(spark, sf_dir)).select("page_id", "allowed")


@query(f"WITH {_SITES} SELECT base, CASE kind WHEN 1 THEN 12.0::DOUBLE ELSE 5.0::DOUBLE END AS delay FROM sites")
def crawl_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-1."""
    return robots.delays(_robots(spark, sf_dir))


# --- sitemaps, built from the pages of each site
def _urlsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base, body: a url set of each site's pages in the order of their ids, every second with a change frequency."""
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    freq = F.when(F.col("page_id") % 2 == 0, F.lit("<changefreq>daily</changefreq>")).otherwise(F.lit(""))
    entry = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><lastmod>2015-07-25T18:10:32+00:00</lastmod>"), freq, F.lit("</url>"))
    pages = _read(spark, sf_dir, "pages", "page_id", "url").select(urls.parse_base(F.col("url")).alias("base"), "page_id", entry.alias("e")).filter("base is not null")
    rows = pages.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("page_id", "e"))).alias("l"))
    xml = F.concat(F.lit('\n<?xml version="1.0" encoding="UTF-8"?>\n\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.transform("l", lambda x: x["e"]), ""), F.lit("</urlset>"))
    return rows.select("base", F.encode(xml, "UTF-8").alias("body"))


_RECORDS = f"rec AS (SELECT {_PAGE_BASE} AS base, url AS links, '2015-07-25T18:10:32+00:00' AS modified_time, CASE WHEN page_id % 2 = 0 THEN 'daily' END AS revisit, (row_number() OVER (PARTITION BY {_PAGE_BASE} ORDER BY page_id) - 1)::INT AS pos FROM pages WHERE {_PAGE_BASE} <> '')"


@query(f"WITH {_RECORDS} SELECT base, pos, links, modified_time, revisit FROM rec")
def sitemap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5, SRC-6, EX-16, EX-17: xml."""
    docs = _urlsets(spark, sf_dir).select("base", F.concat("base", F.lit("/map.xml")).alias("url"), "body")
    return sitemaps.expand(docs.select("base", "url"), docs.select("url", "body")).select("base", "pos", "links", "modified_time", "revisit")


@query(f"""WITH {_RECORDS} SELECT base, pos, links FROM rec WHERE length(base) % 4 <> 3""")
def sitemap_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-9, SRC-7: indexes whose entry is found at its own place or under sitemap/, or is missing."""
    sets = _urlsets(spark, sf_dir).withColumn("k", F.length("base") % 4)
    address = F.when(F.col("k") == 1, F.concat("base", F.lit("/sitemap/1.xml"))).otherwise(F.concat("base", F.lit("/deep/1.xml")))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), "base", F.lit("/deep/1.xml</loc></sitemap></sitemapindex>"))
    docs = sets.filter("k <> 3").select(address.alias("url"), "body")
    docs = docs.union(sets.filter("k = 1").select(F.concat("base", F.lit("/deep/1.xml")), F.encode(F.lit("<html>no map</html>"), "UTF-8")))
    docs = docs.union(sets.select(F.concat("base", F.lit("/index.xml")), F.encode(index, "UTF-8")))
    roots = sets.select("base", F.concat("base", F.lit("/index.xml")).alias("url"))
    return sitemaps.expand(roots, docs.toDF("url", "body")).select("base", "pos", "links")


# --- crawl
@query("""WITH RECURSIVE n AS (SELECT page_id AS id, page_id % 5 <> 0 AS stored, page_id % 11 = 10 AS stop FROM pages),
r(id, hop) AS (SELECT id, 0 FROM n WHERE id < 7 UNION SELECT c.id, hop + 1 FROM r JOIN n p ON p.id = r.id AND NOT p.stop JOIN n c ON c.id IN (2 * r.id + 1, 2 * r.id + 2) WHERE hop < 64)
SELECT id AS page_id, min(hop)::INT AS hop, any_value(n.stored) AS stored FROM r JOIN n USING (id) GROUP BY id""")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF-8, DF-8a, DF-4, FL-4: a crawl from seven sites over pages that link to two others each; some are nofollow, some noarchive."""
    i = F.col("page_id")
    site = lambda n: F.concat(F.lit("http://s"), (n % 7).cast("string"), F.lit(".nl/n"), n.cast("string"))
    robots_ = F.concat_ws(",", F.when(i % 5 == 0, "noarchive"), F.when(i % 11 == 10, "nofollow"))
    link = lambda n: F.concat(F.lit('<a href="'), site(n), F.lit('#x">x</a>'))
    html = F.concat(F.lit('<meta name="robots" content="'), robots_, F.lit('">'), link(i * 2 + 1), link(i * 2 + 2), link(i), F.lit('<a href="mailto:a@b.nl">m</a><a href="#top">t</a>'))
    pages = _read(spark, sf_dir, "pages", "page_id").select("page_id", site(i).alias("url"), html.alias("html"))
    done = crawl.crawl(spark, pages.filter("page_id < 7").select("url"), pages)
    return done.fetched.select("page_id", "hop", "stored")
