import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siteloom.config import Settings
from siteloom.operators import content, frontier, robots, store
from siteloom.plans import crawl
from siteloom.streaming import crawl as stream

FRONTIER = "base string, depth int, url string, seq long"


def belongs(u, b):
    if u.startswith("http://m.") or b.startswith("http://m."):
        u, b = (x.strip("http://").strip("m.").strip("www.") for x in (u, b))
    return u.startswith(b)


def test_route_like_nested_loop(spark):
    rng = random.Random(1)
    hosts = ["http://nu.nl", "http://www.nu.nl", "http://m.nu.nl", "https://nu.nl", "http://nu.nl.evil.com", "http://m.metro.nl", "http://www.metro.nl", "http://a.b-c_d.nl", "http://m."]
    bases = [(h, rng.randint(0, 1), i) for i, h in enumerate(hosts) if rng.random() < 0.8]
    urls = [h + t for h in [*hosts, "http://x.nl", "ftp://nu.nl"] for t in ["", "/a", "/a/b?c=http://m.nu.nl", ":80/x"]]
    want = {u: min([(d, s, b) for b, d, s in bases if belongs(u, b)], default=(None, None, None)) for u in urls}
    got = frontier.route(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(bases, "base string, depth int, seq int")).collect()
    assert {r.url: (r.depth, r.base) for r in got} == {u: (w[0], w[2]) for u, w in want.items()} and len(got) == len(urls)


def test_append_sites(spark):
    found = spark.createDataFrame([("http://a.nl/1", 0, 1), ("http://a.nl/22", 0, 2), ("http://b.nl/x.pdf", 0, 3), ("http://b.nl/y.pdf", 0, 4), ("http://c.nl/11", 1, 5), ("nonsense", 0, 6), ("http://d.nl/9.pdf", 0, 7)], "url string, depth int, seq long")
    known = spark.createDataFrame([("http://a.nl", 0), ("http://d.nl", 0)], "base string, depth int")
    got = sorted(tuple(r) for r in frontier.append_sites(found, known).collect())
    assert got == [("http://a.nl", 0, "http://a.nl/22", 2, True), ("http://b.nl", 0, "http://b.nl/x.pdf", 3, False)]
    queue = spark.createDataFrame([("http://a.nl", 0, "old", 0), ("http://z.nl", 0, "z", 0)], FRONTIER)
    assert sorted(r.url for r in frontier.merge_sites(queue, frontier.append_sites(found, known)).collect()) == ["http://a.nl/22", "http://b.nl/x.pdf", "z"]
    assert frontier.append_sites(found, known, Settings(crawl_depth=1, always_include_base=True)).count() == 6


def test_seeds_queue_reports(spark, tmp_path):
    seeds = frontier.seeds(spark, ["http://a.nl", "http://b.nl", "http://c.nl", "http://d.nl"])
    sites = spark.createDataFrame([("http://a.nl",), ("http://b.nl/",)], "url string")
    assert [r.url for r in frontier.admit_seeds(seeds, sites, spark.createDataFrame([("http://c.nl",)], "url string")).collect()] == ["http://d.nl"]
    assert frontier.seeds(spark, "x").count() == 1
    queue = spark.createDataFrame([("a", 0, f"u{i}", i) for i in range(4)] + [("b", 1, "v", 0)], FRONTIER)
    assert sorted(r.url for r in frontier.take_next(queue).collect()) == ["u0", "v"]
    assert sorted(r.url for r in frontier.take_next(queue, lifo=True).collect()) == ["u3", "v"]
    more = frontier.put(queue, spark.createDataFrame([("a", 0, "w1", 0), ("c", 0, "w2", 9)], FRONTIER))
    assert {r.url: r.seq for r in more.collect()} == {"u0": 0, "u1": 1, "u2": 2, "u3": 3, "v": 0, "w1": 4, "w2": 0}
    again = frontier.restart(queue, frontier.take_next(queue, 2).filter("base = 'a'"))
    assert [r.url for r in again.filter("base = 'a'").orderBy("seq").collect()] == ["u2", "u3", "u0", "u1"]
    frontier.save(queue, str(tmp_path / "q"))
    assert frontier.load(spark, str(tmp_path / "q")).count() == 5
    assert [r.base for r in frontier.lowest_layer(queue).collect()] == ["a"]
    assert {(r.depth, r.base): r.n_urls for r in frontier.layer_report(queue).collect()} == {(0, "a"): 4, (1, "b"): 1}
    assert frontier.has_content(queue).first().has_content and not frontier.has_content(queue.limit(0)).first().has_content


def test_visited_is_idempotent(spark):
    urls = spark.createDataFrame([(x,) for x in "aabbc"], "url string")
    once = frontier.unvisited(urls, spark.createDataFrame([("c",)], "url string"))
    assert sorted(r.url for r in once.collect()) == ["a", "b"] and frontier.unvisited(once, once).count() == 0


def test_warm_start(spark):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    sites = spark.createDataFrame([(1, "http://a.nl", 0), (2, "http://b.nl", 0)], "id long, url string, crawl_depth int")
    at = lambda *x: dt.datetime(2024, 1, *x)
    pages = spark.createDataFrame([(10, 1, "http://a.nl/new/", at(17, 12, 0, 1)), (11, 1, "http://a.nl/old", at(17, 12)), (12, 9, "http://a.nl/orphan", at(31))], "id long, website_id long, url string, crawl_modified timestamp_ntz")
    assert sorted(r.url for r in frontier.warm_start(sites, pages, now).collect()) == ["http://a.nl", "http://a.nl/new", "http://b.nl"]
    assert sorted(r.url for r in frontier.warm_start(sites, pages, now, skip_fresh=True).collect()) == ["http://a.nl", "http://b.nl"]


def test_warm_start_of_shared_urls(spark):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    sites = spark.createDataFrame([(1, "http://a.nl", 0)], "id long, url string, crawl_depth int")
    rows = [(10, 1, "http://a.nl/p"), (11, 1, "http://a.nl/p/"), (12, 1, "http://a.nl/")]
    pages = spark.createDataFrame(rows, "id long, website_id long, url string").withColumn("crawl_modified", now)
    each = lambda **k: sorted((r.url, r.seq) for r in frontier.warm_start(sites, pages, now, **k).collect())
    assert each() == [("http://a.nl", 1), ("http://a.nl/p", 10)] and each(once=False) == [("http://a.nl", 1), ("http://a.nl/p", 10), ("http://a.nl/p", 11)]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.create()
    now = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp_ntz")
    sites = spark.createDataFrame([("http://a.nl", 0), ("http://a.nl", 0)], "url string, crawl_depth int")
    s.add_websites(sites, now(1))
    s.add_websites(sites, now(2))
    assert s.read("websites").count() == 1
    html = '<title>T</title><meta property="article:published_time" content="%s"><h1>H</h1><p>one</p><p>two</p>'
    pages = content.parsed(spark.createDataFrame([("http://a.nl", "http://a.nl/1", html % "2015-07-05T18:10"), ("http://a.nl", "http://a.nl/2", html % "never"), ("http://z.nl", "http://z.nl/1", html % "")], "base string, url string, html string"))
    rows = pages.withColumn("head", content.head(F.col("nodes"))).withColumn("content", F.lit("c"))
    s.add_pages(rows, now(3))
    s.add_pages(rows, now(5))
    got = sorted((r.url, r.title, str(r.crawl_created), str(r.crawl_modified), str(r.published_time)) for r in s.read("webpages").collect())
    assert got == [("http://a.nl/1", "T", "2024-01-03 00:00:00", f"2024-01-0{d} 00:00:00", "2015-05-07 18:10:00") for d in (3, 5)]
    ps = pages.select("url", F.explode(content.paragraphs_with_headings(F.col("nodes"))).alias("r")).select("url", "r.*")
    s.add_paragraphs(ps)
    s.add_paragraphs(pages.select("url", F.explode(content.paragraphs(F.col("nodes"))).alias("r")).select("url", "r.*"))
    joined = s.page_paragraphs()
    assert sorted((r.paragraph, r.h1 or "") for r in joined.collect()) == [("one", ""), ("one", "H"), ("two", ""), ("two", "H")]
    assert s.read("headings").count() == 1 and str(s.websites().first().modified) == "2024-01-05 00:00:00"
    assert store.latest_version(s.read("webpages")).count() == 1
    assert store.exactly_one(s.read("websites"), F.col("url") == "http://a.nl").count() == 1
    for wrong in (F.lit(True), F.col("url") == "x"):
        with pytest.raises(PySparkException):
            store.exactly_one(s.read("webpages"), wrong).collect()
    out = []
    store.write_with(s.read("paragraphs"), lambda d: out.append(d.count()), (lambda d: d.filter("paragraph = 'one'"),))
    assert out == [2]


SITE = {
    "http://a.nl": '<a href="/b">b</a><a href="/c#x">c</a><a href="http://x.nl/in">x</a><a href="/b.pdf">pdf</a>',
    "http://a.nl/b": '<meta name="robots" content="noarchive"><a href="/d">d</a><a href="/">home</a>',
    "http://a.nl/c": '<meta name="robots" content="NOFOLLOW"><a href="/never">n</a>',
    "http://a.nl/d": '<a href="/secret/1">s</a><a href="/gone">g</a>',
    "http://a.nl/secret/1": "",
    "http://x.nl/in": '<a href="/deep">d</a><a href="http://y.nl/far">f</a>',
    "http://x.nl/deep": "",
    "http://y.nl/far": "",
}


def site(spark):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE.items())], "page_id int, url string, html string")


def test_crawl(spark):
    start = spark.createDataFrame([("http://a.nl",)], "url string")
    rules = robots.read_robots(spark.createDataFrame([("http://a.nl", 200, "User-agent: *\nDisallow: /secret"), ("http://x.nl", 404, None), ("http://y.nl", 404, None)], "base string, status int, body string"))
    done = crawl.crawl(spark, start, site(spark), rules)
    got = {r.url: (r.hop, r.stored) for r in done.fetched.collect()}
    assert got == {"http://a.nl": (0, True), "http://a.nl/b": (1, False), "http://a.nl/c": (1, True), "http://a.nl/d": (2, True)}
    deep = crawl.crawl(spark, start, site(spark), rules, Settings(crawl_depth=1))
    assert {(r.url, r.depth) for r in deep.fetched.collect()} == {(u, 0) for u in got} | {("http://x.nl/in", 1), ("http://x.nl/deep", 1)}
    free = crawl.crawl(spark, start, site(spark), None, Settings(crawl_depth=2))
    assert {r.url for r in free.fetched.collect()} == set(SITE)


def test_stream_of_links(spark, tmp_path):
    site(spark).write.parquet(str(tmp_path / "pages"))
    source = spark.readStream.schema("page_id int, url string, html string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    q = stream.new_links(source).writeStream.format("memory").queryName("new_links").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.url for r in spark.table("new_links").collect()]
    assert len(got) == len(set(got)) and {"http://a.nl/b", "http://a.nl/c", "http://x.nl/in", "http://y.nl/far"} <= set(got) and "http://a.nl/b.pdf" not in got


def test_stream_of_hops(spark, tmp_path):
    path = str(tmp_path / "crawl")
    links = crawl.link_table(site(spark)).select("url", "followable", "hrefs").cache()
    stream.put_frontier(spark.createDataFrame([("http://a.nl", 0, "http://a.nl", 0)], FRONTIER), path)
    q = stream.crawl_hops(spark, path, links)
    try:
        for _ in range(4):
            q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(r.url for r in frontier.load(spark, f"{path}/frontier").collect())
    assert got == ["http://a.nl", "http://a.nl/b", "http://a.nl/c", "http://a.nl/d", "http://a.nl/gone", "http://a.nl/secret/1"]


def test_stream_with_delay(spark, tmp_path):
    spark.createDataFrame([("a", f"u{i}") for i in range(3)] + [("b", "v")], "base string, url string").coalesce(1).write.parquet(str(tmp_path / "urls"))
    source = spark.readStream.schema("base string, url string").parquet(str(tmp_path / "urls"))
    q = stream.politely(source, delay=1.0).writeStream.format("memory").queryName("polite").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            if q.awaitTermination(1) or spark.table("polite").count() >= 4:
                break
    finally:
        q.stop()
    got = spark.table("polite").orderBy("at").collect()
    mine = [(r.url, r.at) for r in got if r.base == "a"]
    assert [u for u, _ in mine] == ["u0", "u1", "u2"] and all(b[1] - a[1] >= 1000 for a, b in zip(mine[:-1], mine[1:], strict=True)) and [r.url for r in got if r.base == "b"] == ["v"]
