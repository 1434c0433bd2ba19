import os
import random
import re

import numpy as np
import pytest

from siteloom.llm import mixing

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, size int"


def water(sizes, weights, share=1.5, most=2.0):
    """The shares by repeated resharing."""
    total, full = share * sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        t = [most * s if i in full else rest * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and t[i] > most * s + 1e-9}
        if not over:
            return t
        full |= over


def corpus(giant=40000):
    rng = random.Random(2)
    out = []
    for k in range(3000):
        s = rng.choice(["a", "a", "a", "a", "b", "c", "Z", "é", None, "d"])
        out.append((k, " \n".join(["w"] * rng.choice([0, 1, 3, 10, 50, 200])), s))
    return out + [(5000, None, "b"), (5001, "", "none"), (5002, " x  y ", "c"), (5003, "w " * giant, "a"), (7, "x y", "b"), (7, "x y", "b")]


@pytest.mark.parametrize(("giant", "block"), [(2000, 128), (40000, 1024)])
def test_targets_and_mix(spark, giant, block):
    data = corpus(giant)
    df = spark.createDataFrame([(*r, 0) for r in data], SCHEMA)
    got = mixing.mix(df.repartition(3), block=block).collect()
    assert len(got) == len(data)
    sizes, by = {}, {}
    for k, t, s in data:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
        by.setdefault(s, []).append(n)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    taken, docs = {}, {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
        docs[r.source] = docs.get(r.source, 0) + r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), s
        if sizes[s]:
            assert abs(docs[s] - len(by[s]) * want[s] / sizes[s]) <= 6, s
    again = mixing.mix(df.repartition(7), block=block).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in again) == sorted((r.doc_id, r.size, r.taken) for r in got)


def test_draw_repeats_rows(spark):
    data = corpus()
    df = spark.createDataFrame([(*r, 0) for r in data], SCHEMA)
    want = {}
    for r in mixing.mix(df, block=128).collect():
        want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + r.copies
    rows = mixing.draw(df, block=128)
    assert rows.columns == df.columns
    got = {}
    for r in rows.collect():
        k = r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(4)
    size, p = rng.integers(1, 900, 60).astype(float), np.full(60, 0.3)
    total = np.zeros(60)
    for _ in range(600):
        q = mixing.flight(size, p, rng.random(60))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
        total += q
    assert np.abs(total / 600 - 0.3).max() < 0.1


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_whole_table_near_targets(spark):
    by = {}
    for r in mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        by.setdefault(r.source, []).append(r)
    assert len(by) > 10
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.01 * rows[0].target + 2
        assert abs(sum(r.copies for r in rows) - len(rows) * rows[0].target / rows[0].source_size) <= 3


def test_column_names_that_are_used_inside(spark):
    names = ["_free0", "_free1", "_s", "_p", "__a", "__n", "__i"]
    df = spark.createDataFrame([(k, "w " * (k % 9 + 1), "ab"[k % 2], *[f"{n}{k}" for n in names]) for k in range(60)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    rows = mixing.draw(df)
    assert rows.columns == df.columns and all(r[n] == f"{n}{r.doc_id}" for r in rows.collect() for n in names)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
