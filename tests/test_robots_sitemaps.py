import gzip

from pyspark.sql import functions as F

from siteloom.config import Settings
from siteloom.operators import robots, sitemaps


def robots_of(spark, rows):
    return robots.read_robots(spark.createDataFrame(rows, "base string, status int, body string"))


def decide(spark, body, urls, agent="Python-urllib/3.4", status=200):
    rules = robots_of(spark, [("http://a.nl", status, body)])
    df = spark.createDataFrame([("http://a.nl", i, u) for i, u in enumerate(urls)], "base string, i int, url string")
    return [r.allowed for r in robots.can_fetch(df, rules, Settings(user_agent=agent)).orderBy("i").collect()]


def test_parser(spark):
    body = (
        "Disallow: /never\nUser-agent: a\n\nUser-agent: b # c\nuser-agent: C\nDISALLOW : /x%20y\n# only a comment\n   \nAllow:/z\n\n"
        "User-agent: *\nDisallow:\n\nUser-agent: *\nDisallow: /second\nCrawl-delay: 7\nSitemap: http://a.nl/s.xml\nno colon\nCrawl-delay: 6\nSitemap: /t.xml"
    )
    r = robots_of(spark, [("http://a.nl", 200, body)]).first().robots
    assert (r.delay, r.sitemaps, r.complete) == (7.0, ["http://a.nl/s.xml", "/t.xml"], True)
    assert [(e.agents, [(x.path, x.allow) for x in e.rules]) for e in r.entries] == [(["b", "C"], [("/x%20y", False), ("/z", True)])]
    assert [(x.path, x.allow) for x in r.default_rules] == [("", True)]
    broken = robots_of(spark, [("http://a.nl", 200, "User-agent: a\nDisallow: /\n\nUser-agent: b\nDisallow: /b\nCrawl-delay: soon\n")]).first().robots
    assert [e.agents for e in broken.entries] == [["a"]] and not broken.complete


def test_decisions(spark):
    body = "User-agent: urllib\nAllow: /a/b\nDisallow: /a\n\nUser-agent: *\nDisallow: /\n"
    urls = ["http://a.nl/a/b", "http://a.nl/a/c", "http://a.nl/x", "http://a.nl"]
    assert decide(spark, body, urls) == [True, False, True, True]
    assert decide(spark, body, urls, agent="other/1") == [False] * 4
    assert decide(spark, "User-agent: x\nDisallow: /", urls) == [True] * 4
    assert decide(spark, "User-agent: *\nDisallow: /caf%C3%A9", ["http://a.nl/café", "http://a.nl/caf"]) == [False, True]
    assert decide(spark, None, urls[:1], status=403) == [False] and decide(spark, None, urls[:1], status=404) == [True] and decide(spark, None, urls[:1], status=500) == [False]
    other = spark.createDataFrame([("http://b.nl", "http://b.nl/x")], "base string, url string")
    assert [r.allowed for r in robots.can_fetch(other, robots_of(spark, [("http://a.nl", 404, None)])).collect()] == [False]


def test_delays_and_roots(spark):
    rules = robots_of(spark, [("http://www.x.net", 200, "Crawl-delay: 2\nSitemap: /s.xml"), ("http://b.nl", 404, None)])
    assert {r.base: r.delay for r in robots.delays(rules).collect()} == {"http://www.x.net": 5.0, "http://b.nl": 5.0}
    assert [tuple(r) for r in robots.sitemap_roots(rules).collect()] == [("http://www.x.net", "http://www.x.ne", 0, "/s.xml")]


INDEX = '\n<?xml version="1.0" encoding="UTF-8"?>\n\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>http://n.nl/1</loc></sitemap><sitemap><loc>http://n.nl/2.xml</loc></sitemap></sitemapindex>'


def urlset(*names):
    entries = "".join(f"<url><loc>{n}</loc><lastmod>2015-07-25T18:10:32+00:00</lastmod></url>" for n in names)
    return f'\n<?xml version="1.0" encoding="UTF-8"?>\n\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{entries}</urlset>'


def expand(spark, roots, files):
    docs = spark.createDataFrame([(u, bytearray(b if isinstance(b, bytes) else b.encode())) for u, b in files.items()], "url string, body binary")
    rows = sitemaps.expand(spark.createDataFrame([("http://n.nl", r) for r in roots], "base string, url string"), docs)
    return sorted((r.sitemap_url, r.pos, r.links, r.modified_time, r.revisit) for r in rows.collect())


def test_index_and_urlsets(spark):
    when = "2015-07-25T18:10:32+00:00"
    papers = ["vk", "nrc.htm", "trouw.html", "telegraaf", "bndestem"]
    files = {"http://n.nl/i.xml": INDEX, "http://n.nl/1": urlset(*papers), "http://n.nl/2.xml": urlset("x&amp;y")}
    want = [("http://n.nl/1", i, p, when, None) for i, p in enumerate(papers)] + [("http://n.nl/2.xml", 0, "x&y", when, None)]
    assert expand(spark, ["/i.xml"], files) == want
    assert expand(spark, ["http://n.nl/i.gz"], {**files, "http://n.nl/i.gz": gzip.compress(INDEX.encode())}) == want
    # An entry that is no url set is looked for elsewhere; one that is missing isn't.
    moved = {"http://n.nl/i.xml": INDEX, "http://n.nl/1": "<html/>", "http://n.nl/sitemap/1": "broken <", "http://n.nl/sitemaps/1": urlset("a"), "http://n.nl/sitemap/2.xml": urlset("never")}
    assert expand(spark, ["/i.xml"], moved) == [("http://n.nl/sitemaps/1", 0, "a", when, None)]


def test_other_readers(spark):
    files = {"http://n.nl/s.txt": "http://n.nl/aa\r\nhttp://n.nl/bb\nno url\n", "http://n.nl/u.xml": urlset("q"), "http://n.nl/bad.gz": b"not zipped", "http://n.nl/bad.xml": "<urlset><url>"}
    got = expand(spark, ["http://n.nl/s.txt", "http://n.nl/u.xml", "http://n.nl/bad.gz", "http://n.nl/bad.xml", "http://n.nl/missing.xml"], files)
    assert [x[2] for x in got] == ["http://n.nl/aa", "http://n.nl/bb", "q"]
    df = spark.createDataFrame([("/sitemapindex/", "http://a.nl/sitemapxyz")], "u string, b string")
    assert df.select(sitemaps.read_address(F.col("u"), F.col("b")).alias("r")).first().r == "http://a.nl/sitemapindex"


def test_records_leak():
    xml = "<urlset><url><loc>a</loc></url><url><lastmod>t</lastmod></url><url><loc>b</loc><changefreq>daily</changefreq></url></urlset>"
    assert [(r["links"], r["modified_time"], r["revisit"]) for r in sitemaps.read_xml(xml)["records"]] == [("a", "t", None), ("b", None, "daily")]
    assert sitemaps.read_xml("<urlset><url></url></urlset>") == {"kind": "urlset", "records": []}


def test_html_rss_concat_fresh(spark):
    pages = spark.createDataFrame([(1, '<a href="/x">x</a>')], "page_id int, html string")
    assert [(r.page_id, r.links) for r in sitemaps.html_sitemap(pages).collect()] == [(1, "/x")]
    feed = "<rss><channel><item><link>a</link><pubDate>p</pubDate></item><item><link>b</link><lastBuildDate>l</lastBuildDate><pubDate>p</pubDate></item></channel></rss>"
    got = spark.createDataFrame([(feed,)], "x string").select(sitemaps.rss_items(F.col("x")).alias("r")).first().r
    assert [(i.links, i.modified_time) for i in got] == [("a", "p"), ("b", "l")]
    both = sitemaps.concat(spark.createDataFrame([("a",)], "links string"), spark.createDataFrame([("b", "t")], "links string, modified_time string"))
    assert sorted(tuple(r) for r in both.collect()) == [("a", ""), ("b", "t")]
    records = spark.createDataFrame([("new", "2015-01-01T00:00:00"), ("old", "2015-01-01T00:00:00+00:00"), ("late", "2015-01-01T00:00:00")], "links string, modified_time string")
    stored = spark.sql("select 'old' url, timestamp_ntz'2014-01-01 00:00:00' crawl_modified union all select 'late', timestamp_ntz'2016-01-01 00:00:00'")
    assert sorted(r.links for r in sitemaps.fresh_links(records, stored).collect()) == ["late", "new"]
    assert sorted(r.links for r in sitemaps.fresh_links(records, stored, intent=True).collect()) == ["new", "old"]
