"""A query's rows against its SQL in DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb


def _rows(pdf, columns):
    plain = pdf[columns].astype(object).where(pdf[columns].notna(), None).map(lambda v: v.tolist() if hasattr(v, "tolist") else v)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    assert _rows(got, columns) == _rows(want, columns)
