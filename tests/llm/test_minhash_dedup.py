import random

import numpy as np

from siteloom.llm import minhash_dedup as md
from siteloom.llm.components import connected_components


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = {k: shingles(t) for k, t in rows}
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: find(k) for k in ks}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 150, 400]))]
        out.append(words)
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy)
    # A chain whose ends are unlike.
    words = [rng.choice(vocabulary) for _ in range(300)]
    for step in range(8):
        out.append([f"c{step}_{i}" if i < 12 * step else w for i, w in enumerate(words)])
    # A group of edited copies, most of them too far from each other.
    words = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(120):
        copy = list(words)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = f"e{rng.random()}"
        out.append(copy)
    rng.shuffle(out)
    rows = [(i, " ".join(x)) for i, x in enumerate(out)]
    return rows + [(9000 + i, x) for i, x in enumerate([None, "", " \n", "one", "one", "a b c d e " * 500, "a b c d e " * 400])]


def test_like_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, class_id string").repartition(4)
    got = {r.doc_id: r.class_id for r in md.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert sorted(r.doc_id for r in md.drop_near_copies(df).collect()) == sorted(set(brute(rows).values()))


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted([tuple(r) for r in md.near_duplicates(df).collect()], key=repr) == [(4, None, False), (4, None, False), (None, None, True)]
    assert md.near_duplicates(df.limit(0)).collect() == []


def test_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    one, two = np.arange(0, 250), np.arange(50, 300)
    agree = []
    for seed in range(40):
        x = h ^ np.uint64(seed * 7919)
        sig = md.prob_min_hash(np.repeat([0, 1], 250), np.append(x[one], x[two]), np.ones(500), 2)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - 200 / 300) < 0.02


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 150: 100, 200: 100} | {1000 + i: 1000 for i in range(40)}
