import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteloom.config import DEFAULT, MONTHS
from siteloom.functions import text, urls


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").withColumn("y", f(F.col("x")))
    return [r.y for r in df.orderBy("i").collect()]


def test_parse_base(spark):
    got = column(spark, ["HTTP://Ab.NL:80/x", "http://u:p@h.nl/", "https://a_b.nl/x", "ftp://a.nl", "//a.nl", None, "http://bücher.de/x"], urls.parse_base)
    assert got == ["HTTP://Ab.NL", "http://u", "https://a_b.nl", None, None, None, "http://bücher.de"]


def test_url_rules(spark):
    values = ["http://a.nl/x.docx", "http://a.nl/x.pdf", "http://a.nl/x.htm", "http://a.com", "http://a.nl/x.html", "http://a.nl/", "", "x", "abx", ".abx", "http://lastxfm.nl/aa", "http://google.com/aa"]
    assert column(spark, values, urls.url_rules) == [False, False, False, False, True, True, True, True, True, False, True, False]
    assert column(spark, ["http://a.com", "http://a.nl/x.htm", "http://a.nl/x.pdf"], urls.url_rules_intent) == [True, True, False]


def test_url_explicit(spark):
    values = ["http://a.nl/x/y", "ftps://a.nl/xy", "http://localhost:8080/aa", "http://1.2.3.4/aaaa", "http://a.nl/a b", "mailto:x@y", "//a.nl", "http://a.nl?q=1", "http://-a.nl/"]
    assert column(spark, values, urls.url_explicit) == [True, True, True, True, False, False, False, True, False]


def test_iri_to_uri(spark):
    values = ["http://a.nl/café", "http://a.nl:8080/x", 'http://a.nl/a;b?q="x"', "http://a.nl/‘q", "http://a.nl/中", None]
    assert column(spark, values, urls.iri_to_uri) == ["http://a.nl/caf%e9", "http://a.nl%3a8080/x", "http://a.nl/a;b?q=%22x%22", "http://a.nl/%2018q", "http://a.nl/中", None]


def test_filename(spark):
    assert column(spark, ["a" * 90 + ".data", "a" * 90 + ".longext", "x y\\z", "a/b.c&d,e;f"], urls.filename) == ["a" * 80 + "data", "a" * 80, "xy\\z", "a/b.c&d,ef"]
    assert column(spark, ["a" * 90 + ".data"], lambda c: urls.filename(c, check_ext=False)) == ["a" * 80]


def test_belongs_to_base(spark):
    pairs = [("http://m.nu.nl/a", "http://www.nu.nl", True), ("https://m.nu.nl/a", "http://www.nu.nl", False), ("http://www.nu.nl/a", "http://nu.nl", False), ("http://nu.nl.evil.com/", "http://nu.nl", True), ("http://m.metronieuws.nl/x", "http://www.metronieuws.nl", False)]
    df = spark.createDataFrame(pairs, "u string, b string, w boolean")
    assert all(r.g == r.w for r in df.withColumn("g", urls.belongs_to_base(F.col("u"), F.col("b"))).collect())


def test_resolve(spark):
    hrefs = ["x/y", "?q=1", "//b.nl/z", "mailto:x@y", "../z", "http://[bad", None]
    want = ["http://a.nl/x/y", "http://a.nl?q=1", "http://b.nl/z", "mailto:x@y", "http://a.nl/z", None, None]
    assert column(spark, hrefs, lambda c: urls.resolve(F.lit("http://a.nl"), c)) == want


def test_robots_path_and_base(spark):
    assert column(spark, ["http://a.nl", "http://a.nl/a%20b?x=1#f", "http://a.nl/%7Ejoe+x"], urls.robots_path) == ["/", "/a%20b%3Fx%3D1%23f", "/~joe%2Bx"]
    values = ["http://www.nos.nl/robots.txt", "http://www.waterkant.net/robots.txt", "http://x.ro/robots.txt"]
    assert column(spark, values, urls.robots_base) == ["http://www.nos.nl", "http://www.waterkant.ne", "http:"]
    assert column(spark, values, lambda c: urls.robots_base(c, True)) == ["http://www.nos.nl", "http://www.waterkant.net", "http://x.ro"]


def test_small_url_functions(spark):
    assert column(spark, ["http://a/b#c", "#", "#x", "a"], urls.strip_fragment) == ["http://a/b", "", "", "a"]
    assert column(spark, ["//a/b//", "/", ""], urls.strip_slashes) == ["a/b", "", ""]
    assert column(spark, ["http://x/s.xml", "www.x.nl/s/", "/s.xml"], lambda c: urls.sitemap_url(c, F.lit("http://b"))) == ["http://x/s.xml", "http://www.x.nl/s", "http://b/s.xml"]
    assert column(spark, ["http://www.a.nl"], urls.queue_name) == ["www.a.nl"]
    assert column(spark, ["http://www.a.nl/x/y"], lambda c: urls.temp_name(F.lit("http://www.a.nl"), c)) == ["thread_a_y.data"]
    assert DEFAULT.request_headers()["User-Agent-Info"] == "name=python+crawler&organisation=-&location=Unknown&language=Python+3"


def test_strip_is_idempotent(spark):
    values = ["/a/", "http://x/y/#f", "#", "//", "a#b#c"]
    once = lambda c: urls.strip_slashes(urls.strip_fragment(c))
    assert column(spark, values, once) == column(spark, values, lambda c: once(once(c)))


def test_parse_datetime(spark):
    got = column(spark, ["2015-07-05T18:10", "05-07-2015 18:10", "2015-03-04 10:11", "03-04-05 1:2", "nonsense", None, ""], text.parse_datetime)
    assert got == [dt.datetime(2015, 5, 7, 18, 10), dt.datetime(2015, 7, 5, 18, 10), dt.datetime(2015, 4, 3, 10, 11), dt.datetime(2005, 4, 3, 1, 2), None, None, None]


@pytest.mark.parametrize(
    ("value", "hit"),
    [("2015-07-05T18:10", True), ("25-07-2015 | 18:10", True), ("25-07-2015 OM 18:10", True), ("25-07-201518:10", True), ("25-07-2015 - 18:10", False), ("25-07-2015  om 18:10", False), ("25-7-15</b>9:5", False)],
)
def test_datetime_strings(spark, value, hit):
    assert column(spark, [value], text.datetime_strings) == [[value] if hit else []]


def test_decode(spark):
    values = [bytearray("é中".encode()), bytearray("é".encode("latin-1")), bytearray(b""), None]
    assert column(spark, values, text.decode, "binary") == ["é中", "é", "", None]
    rows = [("a", 1, "é".encode()), ("a", 2, "é".encode("latin-1")), ("a", 3, "é".encode()), ("b", 1, "é".encode())]
    df = text.decode_site(spark.createDataFrame([(b, s, bytearray(x)) for b, s, x in rows], "base string, seq int, body binary"))
    assert sorted((r.base, r.seq, r.text, r.codec) for r in df.collect()) == [("a", 1, "é", "utf_8"), ("a", 2, "é", "latin_1"), ("a", 3, "Ã©", "latin_1"), ("b", 1, "é", "utf_8")]


def test_flags_and_small_text_functions(spark):
    values = ["NoFollow", "none", None, "noarchive", "index"]
    assert column(spark, values, text.followable) == [False, True, True, True, True]
    assert column(spark, values, text.archivable) == [True, True, True, False, True]
    assert column(spark, [" \t a b\r\n", " x"], text.trim_blanks) == ["a b", " x"]
    assert column(spark, [None, "x"], text.stringify) == ["", "x"]
    assert column(spark, ["Mrt", " december ", "x"], text.month_number) == [3, 12, None]
    assert len(MONTHS) == 23 and len(DEFAULT.nofollow) == 20
