import random
import re

import pytest

import corpus_pipeline
from siteloom.llm import quality, sentencepiece_lattice

from .test_minhash_dedup import brute as near_brute

sentencepiece = pytest.importorskip("sentencepiece")


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 7)))
    docs, labels = [], []
    for k in range(0, 900, 3):
        bad = k % 5 == 0
        words = [word() for _ in range(rng.choice([5, 30, 80, 200]))]
        words = [w.upper() + "!!" for w in words] if bad else words
        docs.append((k, " ".join(words), "en", rng.choice(["a", "a", "b", None]), 0))
        labels.append((k, int(not bad), 0))
        if k % 7 == 0:
            docs.append((k + 1, "  ".join(words), "en", "b", 0))
        if k % 4 == 0 and len(words) > 60:
            docs.append((k + 2, " ".join([*words, "tail"]), None, "a", 0))
    return docs, labels


def test_stages_like_brute_force(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    outs, now = [], table
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == table.columns
        outs.append(now.collect())
    scores = quality.score(table, quality.train(table, spark.read.parquet(str(tmp_path / "labels.parquet")))).collect()
    assert sorted(r.doc_id for r in outs[0]) == sorted(r.doc_id for r in scores if r.score >= 0.5)
    assert len(outs[0]) < len(docs) and sum(r.doc_id % 5 != 0 for r in outs[0] if r.doc_id % 3 == 0) == sum(d[0] % 5 != 0 for d in docs if d[0] % 3 == 0)
    first = {}
    for r in sorted(outs[0], key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in outs[1]) == sorted(first.values())
    classes = near_brute([(r.doc_id, r.text) for r in outs[1]])
    assert sorted(r.doc_id for r in outs[2]) == sorted(set(classes.values()))
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert {r.doc_id for r in outs[3]} <= {r.doc_id for r in outs[2]} and abs(words(outs[3]) - 1.5 * words(outs[2])) < 0.05 * words(outs[2])
    m = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    text = {r.doc_id: r.text for r in outs[3]}
    assert sorted(r.doc_id for r in outs[4]) == sorted(r.doc_id for r in outs[3])
    assert all(list(r.token_ids) == m.encode(text[r.doc_id]) for r in outs[4])
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.n_tokens) for r in outs[4])


def staged(spark, path, docs, labels, schema):
    """What each stage gives, in order."""
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    now, outs = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, path).write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        outs.append(now)
    return outs


def test_odd_rows_and_names(spark, tmp_path):
    docs, labels = corpus()
    names = ["_sha", "_keep", "_free0", "__score", "score", "class_id", "_k", "token_ids", "size"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    odd = [(5000, None, None, None, None), (5001, "", "en", "b", 0), (5002, " \n", "en", "b", 0), (5003, "long text here " * 30000, "en", "a", 1), (None, "a text without id", "en", "a", 1), docs[4], docs[4]]
    rows = [(*d, *[f"{n}{d[0]}" for n in names]) for d in [*docs, *odd]]
    outs = staged(spark, str(tmp_path), rows, [*labels, (None, 1, 0), (5001, None, None)], schema)
    given = spark.createDataFrame(rows, schema)
    for out in outs[:-1]:
        assert out.columns == given.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    exact = outs[1].collect()
    # Rows that share id and text are one document.
    assert len({r.doc_id for r in exact}) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in exact})
    near = {r.doc_id for r in outs[2].collect()}
    assert near == set(near_brute([(r.doc_id, r.text) for r in exact if r.doc_id is not None]).values()) | ({None} & {r.doc_id for r in exact})
    m = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    text = {r.doc_id: r.text for r in exact}
    assert all(list(r.token_ids) == m.encode(text[r.doc_id] or "") for r in outs[4].collect())


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert [out.count() for out in staged(spark, str(tmp_path / "none"), [], [], schema)] == [0] * 5
    docs, _ = corpus()
    outs = staged(spark, str(tmp_path / "unlabelled"), docs, [], schema)
    assert outs[0].count() == len(docs) and outs[4].count() > 0
