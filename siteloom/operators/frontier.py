"""The crawl frontier as tables (SRC-14, SRC-15, DF-1 to DF-7, DF-15 to DF-18, J-1 to J-5, FL-1 to FL-7).

A frontier row is (base, depth, url, seq): url waits in the queue of base, which was found depth external hops away; seq is its place
in line. The visited set is exact: an anti-join, not an approximate filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.config import DEFAULT, Settings
from siteloom.functions.urls import _mobile, parse_base, resolve, strip_fragment, strip_slashes, url_explicit

#: No host name is longer, so no base has more characters than this and a scheme.
LONGEST_BASE = 8 + 253


def seeds(spark: SparkSession, urls: str | list[str]) -> DataFrame:
    """SRC-15: (seq, url) of one url or a list."""
    rows = [urls] if isinstance(urls, str) else list(urls)
    return spark.createDataFrame(list(enumerate(rows)), "seq long, url string")


def admit_seeds(found: DataFrame, websites: DataFrame, history: DataFrame) -> DataFrame:
    """DF-6, J-5: seeds of which neither the url, nor the url with a slash, is a stored site, and which were never met."""
    known = websites.select(F.col("url").alias("_u"))
    bare = known.select(F.regexp_replace("_u", "/$", "").alias("_u")).union(known).distinct()
    # url or url/ is stored exactly if url is among the stored urls with and without a last slash.
    return found.join(bare, found["url"] == bare["_u"], "left_anti").join(history.select(F.col("url").alias("_h")).distinct(), F.col("url") == F.col("_h"), "left_anti")


def normalise_links(links: DataFrame, base: str = "base", href: str = "href", settings: Settings = DEFAULT) -> DataFrame:
    """DF-4: links with url: without fragment, resolved against the site's base, kept if FN-3 takes it; FN-9 strips it."""
    bare = links.withColumn("_href", strip_fragment(F.col(href))).filter("_href <> ''")
    return bare.withColumn("_url", resolve(F.col(base), F.col("_href"))).filter(url_explicit(F.col("_url"), settings.nofollow)).withColumn("url", strip_slashes(F.col("_url"))).drop("_href", "_url")


def base_lengths(bases: DataFrame) -> tuple[list[int], list[int]]:
    """The lengths that bases, and their stripped forms, have: one row of LONGEST_BASE + 1 numbers at most. For route(), which asks for
    them itself unless they are given."""
    size = lambda c: F.array_sort(F.collect_set(F.when(F.length(c) <= LONGEST_BASE, F.length(c))))
    return tuple(bases.agg(size(F.col("base")).alias("plain"), size(_mobile(F.col("base"))).alias("mobile")).first())


def _prefixes(text: Column, lengths: list[int]) -> Column:
    known = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    return F.transform(F.filter(known, lambda n: n <= F.length(text)), lambda n: F.substring(text, F.lit(1), n))


def route(urls: DataFrame, bases: DataFrame, lengths: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """DF-1, J-3: urls with base and depth of the first base that FN-6 attributes them to, by depth and seq; null where none does.

    A base is a scheme and a host, so the bases that an url begins with are among the prefixes of its own scheme and host, and only as
    long as bases are: the theta join is an equi-join with those few. Mobile hosts are joined likewise on their stripped forms.
    bases is read three times and should be cheap to read. lengths: those of bases, by base_lengths().
    """
    of_plain, of_mobile = lengths or base_lengths(bases)
    site = bases.select(F.col("base").alias("_b"), F.col("depth").alias("_d"), F.col("seq").alias("_s"))
    is_mobile = lambda c: c.startswith("http://m.")
    known = urls.select("url").distinct()
    fixed, forms = site.filter(~is_mobile(F.col("_b"))), site.withColumn("_m", _mobile(F.col("_b")))
    plain = known.filter(~is_mobile(F.col("url"))).select("url", F.explode(_prefixes(F.coalesce(parse_base(F.col("url")), F.lit("")), of_plain)).alias("_key"))
    plain = plain.join(fixed, F.col("_key") == F.col("_b"))
    keys = known.select("url", F.explode(_prefixes(_mobile(F.col("url")), of_mobile)).alias("_key"))
    mobile = keys.join(forms, F.col("_key") == F.col("_m")).filter(is_mobile(F.col("url")) | is_mobile(F.col("_b")))
    met = plain.select("url", "_b", "_d", "_s").union(mobile.select("url", "_b", "_d", "_s"))
    first = met.groupBy("url").agg(F.min_by(F.struct("_b", "_d"), F.struct("_d", "_s", "_b")).alias("_f"))
    return urls.join(first.select(F.col("url").alias("_url"), F.col("_f._b").alias("base"), F.col("_f._d").alias("depth")), F.col("url") == F.col("_url"), "left").drop("_url")


def unvisited(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """DF-5, J-4: each url once, if it isn't in visited."""
    return urls.dropDuplicates(["url"]).join(visited.select(F.col("url").alias("_v")).distinct(), F.col("url") == F.col("_v"), "left_anti")


def append_sites(found: DataFrame, known: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """DF-2, DF-3: frontier rows for urls (url, depth, seq) that lead to sites: base, depth, url, seq, replaces.

    Too deep ones and those without a base are dropped. A base is new at its depth if known (base, depth) lacks it; for a known base only
    an explicit url counts, and replaces the queue. Of several for one base the last accepted one holds.
    """
    near = found.filter(F.col("depth") <= settings.crawl_depth).withColumn("base", parse_base(F.col("url"))).filter("base is not null")
    have = known.select("base", "depth").distinct().withColumn("replaces", F.lit(True))
    rows = near.join(have, ["base", "depth"], "left").withColumn("replaces", F.coalesce("replaces", F.lit(False)))
    by_site = Window.partitionBy("base", "depth").orderBy("seq")
    first = (F.row_number().over(by_site) == 1) & ~F.col("replaces")
    taken = rows.withColumn("_take", first | url_explicit(F.col("url"), settings.nofollow)).filter("_take")
    last = Window.partitionBy("base", "depth").orderBy(F.desc("seq"))
    kept = taken.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("base", "depth", "url", "seq", "replaces")
    if settings.always_include_base:
        kept = kept.union(kept.filter("url <> base").withColumn("url", F.col("base")))
    return kept


def merge_sites(frontier: DataFrame, appended: DataFrame) -> DataFrame:
    """Frontier after append_sites: replaced queues lose their rows."""
    gone = appended.filter("replaces").select("base", "depth").distinct()
    return frontier.join(gone, ["base", "depth"], "left_anti").select("base", "depth", "url", "seq").union(appended.select("base", "depth", "url", "seq"))


def fresh_pages(webpages: DataFrame, now: Column, settings: Settings = DEFAULT) -> DataFrame:
    """FL-3: pages whose last change is less than revisit_after whole days ago; a whole day is 24 hours."""
    return webpages.filter(F.col("crawl_modified") > now - F.make_dt_interval(F.lit(settings.revisit_after)))


def warm_start(websites: DataFrame, webpages: DataFrame, now: Column, settings: Settings = DEFAULT, skip_fresh: bool = False, once: bool = True) -> DataFrame:
    """DF-7, J-1: frontier rows of the stored sites and, as it runs, of their fresh pages; skip_fresh leaves the pages out. An url that
    several fresh rows share waits once; without once there is a row for each of them."""
    sites = append_sites(websites.select("url", F.col("crawl_depth").alias("depth"), F.col("id").alias("seq")), websites.limit(0).select(F.col("url").alias("base"), F.col("crawl_depth").alias("depth")), settings)
    rows = sites.select("base", "depth", "url", "seq")
    if skip_fresh:
        return rows
    pages = fresh_pages(webpages, now, settings).select("url", "website_id", "id").join(websites.select(F.col("id").alias("website_id")), "website_id", "left_semi")
    urls = pages.select(strip_slashes(F.col("url")).alias("url"), F.col("id").alias("seq"))
    if once:
        urls = urls.groupBy("url").agg(F.min("seq").alias("seq"))
    routed = route(urls, rows).filter("base is not null").join(rows.select(F.col("url").alias("_u")), F.col("url") == F.col("_u"), "left_anti")
    return rows.union(routed.select("base", "depth", "url", "seq"))


def schedule(frontier: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """DF-13: (base, depth, wave): max_threads sites and one more go at once, in the order in which they were put in line; the next
    ones when a wave has ended. One row for each site."""
    sites = frontier.groupBy("base", "depth").agg(F.min("seq").alias("_s"))
    place = F.row_number().over(Window.orderBy("depth", "_s", "base")) - 1
    return sites.select("base", "depth", F.floor(place / (settings.max_threads + 1)).cast("int").alias("wave"))


def lowest_layer(frontier: DataFrame) -> DataFrame:
    """DF-17."""
    return frontier.filter("depth = 0").select("base").distinct()


def layer_report(frontier: DataFrame) -> DataFrame:
    """DF-18, AG-2: waiting urls by depth and base."""
    return frontier.groupBy("depth", "base").agg(F.count(F.lit(1)).alias("n_urls"))


def has_content(frontier: DataFrame) -> DataFrame:
    """DF-16: one row that tells whether any queue holds anything."""
    return frontier.agg((F.count(F.lit(1)) > 0).alias("has_content"))


def take_next(frontier: DataFrame, n: int = 1, lifo: bool = False) -> DataFrame:
    """DF-15, SO-2, LM-1: the next n urls of each queue in line, or the last ones put in."""
    w = Window.partitionBy("base", "depth").orderBy(F.desc("seq") if lifo else F.asc("seq"))
    return frontier.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def put(frontier: DataFrame, more: DataFrame) -> DataFrame:
    """SNK-7, ST-1: urls (base, depth, url, seq) at the end of their queues, in the order of their seq."""
    last = frontier.groupBy("base", "depth").agg(F.max("seq").alias("_last"))
    at = F.row_number().over(Window.partitionBy("base", "depth").orderBy("seq"))
    placed = more.withColumn("_at", at).join(last, ["base", "depth"], "left").withColumn("seq", (F.coalesce("_last", F.lit(-1)) + F.col("_at")).cast("long"))
    return frontier.select("base", "depth", "url", "seq").union(placed.select("base", "depth", "url", "seq"))


def restart(frontier: DataFrame, taken: DataFrame) -> DataFrame:
    """DF-15: after a stop, what was in hand but not done goes to the end of its queue."""
    held = taken.select("base", "depth", "url")
    rest = frontier.join(held, ["base", "depth", "url"], "left_anti")
    return put(rest, taken)


def save(frontier: DataFrame, path: str) -> None:
    """SRC-14: the frontier on disk."""
    frontier.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14."""
    return spark.read.parquet(path)
