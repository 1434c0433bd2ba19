import numpy as np
import pytest

from siteloom.llm import embedding_dedup as ed


def brute(rows, threshold=0.95):
    unit = {}
    for k, v in rows:
        x = np.array([np.nan if c is None else c for c in v], dtype=float) if v else np.zeros(0)
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            unit[k] = x / np.linalg.norm(x)
    links = {k: [j for j in unit if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= threshold] if k in unit else [] for k, _ in rows}
    out = []
    for k, _ in rows:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((k, len(links[k]), min(seen), k == min(seen)))
    return sorted(out)


@pytest.mark.parametrize("dim", [64, 3])
def test_like_brute_force(spark, dim):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(120):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.choice([1, 1, 1, 2, 5, 30]))):
            rows.append((centre + rng.normal(size=dim) * rng.choice([0, 0.02, 0.15, 0.25])) * rng.choice([1, 3]))
    hot = rng.normal(size=dim)
    rows += [hot + 0.02 * rng.normal(size=dim) for _ in range(300)] + [hot] * 40
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1e300] * dim, [1e-300] * dim, [1.0, 2.0], [2.0, 4.0], [1.0]]
    rows += [(90000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<double>, n_links int, kept boolean").repartition(4)
    got = sorted(tuple(r) for r in ed.near_vectors(df).collect())
    want = brute(rows)
    found, there = (sum(r[1] for r in x) for x in (got, want))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.99 * there
    assert sum(g[2:] == w[2:] for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(ed, "BASE_BLOCK", 16)
    monkeypatch.setattr(ed, "QUERY_BLOCK", 10)
    rows = [(i, [1.0, 0.01 * (i % 7), 0.0]) for i in range(100)] + [(200 + i, [0.0, 1.0, 0.1 * i]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in ed.near_vectors(df).collect()) == brute([(k, np.float32(v).tolist()) for k, v in rows])
    assert ed.near_vectors(df.limit(0)).collect() == []
