import pytest
from pyspark.sql import functions as F

from siteloom.operators import content
from siteloom.sources.html import html_nodes, nodes, register


def page(spark, html, f):
    return spark.createDataFrame([(html,)], "html string").withColumn("nodes", html_nodes(F.col("html"))).select(f(F.col("nodes")).alias("r")).first().r


def links(spark, html, **k):
    return [x.href for x in page(spark, html, lambda n: content.links(n, **k))]


def test_tree():
    got = [(t, text) for _, t, _, _, text, _ in nodes("<p>a<b>b<p>c</p>d<ul><li>1<li>2<ul><li>3</ul></ul><script>if (a<b) '</p>'</script>&amp;<!--n--><br>", frozenset(("p", "b", "li", "script")))]
    assert got == [("p", "ab"), ("b", "b"), ("p", "c"), ("li", "1"), ("li", "23"), ("li", "3"), ("script", "if (a<b) '</p>'")]
    assert nodes(None) == nodes("") == [] and [n[1] for n in nodes("<a")] in ([], ["a"])
    assert nodes("<div id=x class='a b'><p>1</div><p>2", frozenset("p"), "div#x.a")[0][4] == "1" and len(nodes("<div id=x><p>1</div><p>2", frozenset("p"), ".//div")) == 1
    assert [n[5] for n in nodes("<html><body><p>a<p>b</body>", frozenset("p"))] == ["/html[1]/body[1]/p[1]", "/html[1]/body[1]/p[2]"]
    assert nodes("<p>x<!--c-->y</p>", frozenset("p"))[0][3:5] == ("x", "xcy")


def test_references():
    assert [n[4] for n in nodes("<p>&amp</p><p>&copy=2 &notit; &not;</p><p>&#65;&#x42 &hellip;&amp;lt;</p>", frozenset("p"))] == ["&amp", "&copy=2 &notit; ¬", "AB …&lt;"]
    assert nodes("<a href='/x?a=1&copy=2&amp;b=3'>", frozenset("a"))[0][2] == {"href": "/x?a=1&copy=2&b=3"}


def test_long_page():
    assert len(nodes("<div><p>x</p></div>" * 20000, frozenset("p"))) == 20000


@pytest.mark.parametrize(
    ("html", "title", "description"),
    [
        ('<meta property="og:title" content="o"><title>t</title>', "t", None),
        ('<title>t</title><meta property="og:title" content="o">', "t", None),
        ("<title>a</title><title>b</title>", "b", None),
        ('<meta name="description" content="1"><meta name="description" content="2">', None, "1"),
        ('<meta name="description"><meta name="description" content="2">', None, None),
        ('<meta name="og:title" content="wrong"><meta name="x" property="og:title" content="o">', "o", None),
    ],
)
def test_head(spark, html, title, description):
    got = page(spark, html, content.head)
    assert (got.title, got.description) == (title, description)


def test_links(spark):
    html = '<a href="/a">1</a><a href="/b" robots="nofollow">2</a><a href="/b">3</a><a href="">4</a><a>5</a><a href="/a">6</a><a href="/c" rel="nofollow">7</a><A HREF=/d>8</A>'
    assert links(spark, html) == ["/a", "/c", "/d"]
    assert links(spark, html.replace("/", "http://x.nl/aa/"), respect_rel=True)[-1] == "http://x.nl/aa/d"
    assert "http://x.nl/aa/c" not in links(spark, html.replace('href="/', 'href="http://x.nl/aa/'), respect_rel=True)


def test_paragraphs_and_headings(spark):
    html = "<p>0</p><h1>A</h1><p> a </p><h2>B</h2><li>b</li><p> </p><h1>C</h1><p>c</p>"
    assert [x.paragraph for x in page(spark, html, content.paragraphs)] == ["0", "a", "c"]
    got = page(spark, html, content.paragraphs_with_headings)
    assert [(x.paragraph, x.h1, x.h2, x.h6) for x in got] == [("0", None, None, None), ("a", "A", None, None), ("b", "A", "B", None), ("c", "C", "B", None)]
    rows = spark.createDataFrame([(1, 0, None, None), (1, 1, "A", None), (1, 2, None, "B"), (1, 3, "C", None)], "page int, pos int, h1 string, h2 string")
    filled = content.forward_fill(rows, "page", "pos", ("h1", "h2")).orderBy("pos").collect()
    assert [(r.h1, r.h2) for r in filled] == [(None, None), ("A", None), ("A", "B"), ("C", "B")]


def test_extract_zip_project(spark):
    df = spark.createDataFrame([(1, '<div class="m"><a href="/x">X</a><a>Y</a></div><a href="/z">Z</a>')], "id int, html string")
    fields = [content.Field("a", attr="href"), content.Field("a", name="label")]
    got = content.extract(df, fields, within="div.m", edit=lambda d: d.withColumn("n", F.size("href"))).first()
    assert (got.href, got.label, got.n) == (["/x", ""], ["X", "Y"], 2)
    rows = content.zip_rows(spark.createDataFrame([(1, [1, 2, 3], ["a", "b"])], "id int, x array<int>, y array<string>"), ["x", "y"])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 1, "a"), (1, 2, "b")]
    assert content.project(rows, {"x": "z"}).columns == ["z"]


def test_datetimes(spark):
    df = spark.createDataFrame([(1, "<p>25-07-2015 18:10 and 99-99-9999 99:99</p>"), (2, '<time datetime="2015-07-25 18:10">x</time> 01-01-2001 10:00'), (3, "none")], "id int, html string")
    got = sorted((r.id, r.pos, str(r.value)) for r in content.page_datetimes(df).collect())
    assert got == [(1, 0, "2015-07-25 18:10:00"), (2, 0, "2015-07-25 18:10:00")]


def test_table_function(spark):
    register(spark)
    spark.createDataFrame([(1, "<p>a<p>b")], "id int, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("select id, n.tag, n.text from some_pages, lateral html_nodes(html, 'p') n").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "p", "a"), (1, "p", "b")]
