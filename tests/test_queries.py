import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siteloom.plans import queries, stored

from .oracle import assert_same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | stored.QUERIES, queries.ORACLES | stored.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_like_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def write_pages(folder, rows) -> str:
    """A folder with a table of pages: rows (page_id, url, html)."""
    pq.write_table(pa.table(dict(zip(("page_id", "url", "html"), map(list, zip(*rows, strict=True)), strict=True))), str(folder / "pages.parquet"))
    return str(folder)


#: Titles and headings that were cut within a character reference, as in the larger tables.
CUT = [(i, f"http://a.nl/{i}", f'<html><head><meta charset="utf-8"><title>T &amp;{end}</title></head><body><h1>H &amp;{end}</h1><p>x &lt;y&gt;{end}</p><a href="/b">b</a></body></html>') for i, end in enumerate(("&amp", "&am", "&quo", "&", " &copy;", "&lt"))]


@pytest.mark.parametrize("name", ["paragraphs_with_headings", "generic_extract", "head_title", "stored_pages"])
def test_cut_references_like_sql(spark, tmp_path, name):
    assert_same(spark, QUERIES[name], ORACLES[name], write_pages(tmp_path, CUT))


#: Pages that share an url, among them one that was stored again and one that wasn't, and two of one content.
SHARED = [(i, f"http://a.nl/{i // 2 % 3}", f"<title>t</title><h1>H</h1><p>p{i // 4}</p><p>q{i}</p>") for i in range(14)]


@pytest.mark.parametrize("name", ["stored_paragraphs", "warm_start"])
def test_shared_urls_like_sql(spark, tmp_path, name):
    assert_same(spark, QUERIES[name], ORACLES[name], write_pages(tmp_path, SHARED))


def test_closed_far_site_like_sql(spark, tmp_path):
    """The way to the first closed page on a site of its own, and what lies behind it."""
    way = [3266]
    while way[-1]:
        way.append((way[-1] - 1) // 2)
    assert_same(spark, QUERIES["crawl_rules"], ORACLES["crawl_rules"], write_pages(tmp_path, [(i, "", "") for i in [*way, 6533, 6534]]))
