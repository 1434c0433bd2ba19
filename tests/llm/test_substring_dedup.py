import hashlib
import random
import re

from siteloom.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, marks string, h string"


def brute(rows, window=20):
    words = {}
    for k, text in rows:
        words.setdefault(k, []).append(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = lambda k: (k is not None, k or 0)
    first = {}
    for k in words:
        for ws in words[k]:
            for i in range(len(ws) - window + 1):
                w = tuple(ws[i : i + window])
                first[w] = min(first.get(w, (order(k), i)), (order(k), i))
    out = []
    for k in words:
        for ws in words[k]:
            gone = set()
            for i in range(len(ws) - window + 1):
                if first[tuple(ws[i : i + window])] < (order(k), i):
                    gone |= set(range(i, i + window))
            kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
            out.append((k, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(n) for n in (20, 21, 33, 60, 19)]
    out = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += rng.choice(shared)[rng.randint(0, 3) :] if rng.random() < 0.5 else text(rng.randint(0, 40))
        out.append((k, rng.choice([" ", "\n", " \t"]).join(parts)))
    out += [(200, out[3][1]), (201, out[3][1].replace(" ", "  ")), (202, "same " * 100), (203, "same " * 30), (204, None), (205, ""), (206, " \n "), (207, "a"), (207, "a"), (208, out[11][1] + " x" * 9), (208, out[11][1] + " x" * 9)]
    return out + [(300 + k, out[7][1] + " end") for k in range(60)] + [(None, out[9][1]), (400, " ".join(text(30000)) + " " + out[9][1])]


def test_like_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(k, x, "m", "h") for k, x in data], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in sd.substring_dedup_digest(df).collect()), key=repr)
    assert got == brute(data)


def test_texts_and_empty(spark):
    long = " ".join(f"x{i}" for i in range(25))
    df = spark.createDataFrame([(1, long, None, None), (2, "head " + long + " tail", None, None)], SCHEMA)
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in sd.substring_dedup(df).collect()}
    assert got == {1: (0, long), 2: (25, "head tail")}
    assert sd.substring_dedup(df.limit(0)).collect() == []
