import random
import zlib

import numpy as np

from siteloom.llm import quality
from siteloom.llm.wordhash import Texts

T = quality.TRIGRAMS


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 7)))
    docs, labels = [], []
    for k in range(400):
        words = [word() for _ in range(rng.choice([5, 30, 80, 300]))]
        bad = k % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if k % 2 else [words[0]] * len(words)
        docs.append((k, " ".join(words)))
        labels.append((k, int(not bad)))
    return docs + [(900, None), (901, ""), (902, " \n"), (903, "ab " * 60000), (7, docs[7][1]), (None, "abc d")], labels + [(5, None), (6, 1), (None, 1), (5000, 0)]


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, 3, 0.5) for d in docs], "doc_id long, text string, score int, predicted double").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(df, lab)
    got = quality.score(df, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    truth = dict(x for x in labels if x[1] is not None)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(df.limit(0), model).collect() == []


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(df, quality.train(df, none)).collect()] == [0.5, 0.5]


def test_gradient_and_passages():
    t = Texts([b"aa b " * 100, b"", b"x", "é É!".encode()])
    begin, x = quality.passages(t)
    assert begin.tolist() == [0, 4, 5, 6, 7] and x.shape == (7, quality.FEATURES)
    assert np.allclose(x[0, T + ord("a")], 2 / 3) and x[4].sum() == 0 and np.allclose(x[6, T + 128], 4 / 5)
    one, gram = b" x ", lambda a: (int.from_bytes(a, "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 22
    assert x[5, gram(one)] == 1 and np.allclose(x[:, :T].sum(axis=1), [1, 1, 1, 1, 0, 1, 1])
    m = quality.Model()
    m.mean, m.scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float) + 1e-3
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        s = m.scores(x, begin[:-1])
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = m.gradient(x, begin[:-1], y)
    for k, at in (("E", (T + 97, 3)), ("E", (gram(one), 0)), ("e", (2,)), ("V", (1, 2)), ("U", (3, 4)), ("w", (5,)), ("c", (6,))):
        had = m.p[k][at]
        m.p[k][at] = had + 1e-5
        up = loss()
        m.p[k][at] = had - 1e-5
        down = loss()
        m.p[k][at] = had
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6, k


def test_scores_like_plain_loops(spark):
    """The forward pass, restated number by number, over whole documents."""
    import math

    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    m = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    p = {k: np.asarray(v, dtype=float) for k, v in m.p.items()}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    wanted = {k: t for k, t in docs if k in (1, 2, 5, 10, 15, 33, 901)}
    for r in [r for r in quality.score(df, m).collect() if r.doc_id in wanted]:
        _, x = quality.passages(Texts([wanted[r.doc_id].encode()]))
        hidden, scores = [], []
        for row in x.tolist():
            words = row[-1] * quality.PASSAGE
            z = [min(8, max(-8, (v - a) / b)) for v, a, b in zip(row, m.mean.tolist(), m.scale.tolist(), strict=True)]
            z = [v * words / (words + quality.FEW) for v in z[:-1]] + z[-1:]
            h = [math.tanh(sum(z[i] * p["E"][i, j] for i in range(len(z))) + p["e"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(len(h)))) * sigmoid(sum(h[i] * p["U"][i, j] for i in range(len(h)))) for j in range(quality.GATE)]
            hidden.append(h)
            scores.append(sum(g * w for g, w in zip(gate, p["w"].tolist(), strict=True)))
        weight = [math.exp(v) / sum(map(math.exp, scores)) for v in scores]
        bag = [sum(a * h[j] for a, h in zip(weight, hidden, strict=True)) for j in range(quality.HIDDEN)]
        assert abs(sigmoid(sum(a * b for a, b in zip(bag, p["c"].tolist(), strict=True)) + float(p["d"])) - r.score) < 1e-4


def test_training_stays_off_the_driver(spark, monkeypatch):
    """The sample is trained on in a task: the driver neither fetches the bags nor fits, and gets the parameters that fitting them gives."""
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)

    def refuse(*_, **__):
        raise AssertionError("in the driver")

    with monkeypatch.context() as m:
        m.setattr(quality.Model, "fit", refuse)
        m.setattr(type(df), "toArrow", refuse)
        got = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    truth = {k: y for k, y in labels if k is not None and y is not None and k < len(docs) and zlib.crc32(str(k).encode()) % 3 != 1}
    text = dict(docs[:400])
    ids = sorted(truth)
    bags = [quality.passages(Texts([text[k].encode()]))[1].astype(np.float16) for k in ids]
    wanted = quality.Model()
    wanted.fit(bags, np.array([truth[k] for k in ids], dtype=float))
    assert all(np.allclose(got.p[k], wanted.p[k], atol=1e-3) for k in wanted.p)
    assert np.allclose(got.mean, wanted.mean) and np.allclose(got.scale, wanted.scale)
