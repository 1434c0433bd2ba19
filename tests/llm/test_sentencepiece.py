import os
import random

import numpy as np
import pytest

from siteloom.llm import sentencepiece_lattice as sl

sentencepiece = pytest.importorskip("sentencepiece")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sl.MODEL)


def texts():
    rng = random.Random(4)
    parts = ["the", "Hello", "ingwh", "éèaile", "  ", "\n", "\t", "中文", "🙂", ".", ",,", "!!", "(x)", "a" * 9, "</s>", "<0x41>", "http://a.b/c?d=e", "123", "\r\n", "ß", "don't", " "]
    out = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    return [*out, "", " ", "  ", "\n", "x", " lead", "trail ", "▁ in it"]


def test_like_library_and_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(sl, "CACHE_BYTES", 2000)
    data = [(i, t) for i, t in enumerate(texts())] + [(900, None), (7, texts()[7]), (None, "null id")]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, token_ids string").repartition(3)
    got = sl.round_trip(df).collect()
    assert len(got) == len(data) and all(r.decoded_equal for r in got)
    want = {i: library.encode(t or "") for i, t in data}
    for r in got:
        assert list(r.token_ids) == want[r.doc_id] and r.n_tokens == len(want[r.doc_id]), dict(data)[r.doc_id]
    back = {r.doc_id: r.decoded_text for r in sl.decode(sl.encode(df)).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in data}
    assert sl.round_trip(df.limit(0)).collect() == []


def brute(text, pieces):
    """Viterbi by the text alone, exact in integers."""
    table = {t: (i, s) for t, i, s in pieces.normal()}
    longest, lowest = max(map(len, table)), min(s for _, s in table.values())
    best = [(0.0, None, None)]
    for end in range(1, len(text) + 1):
        way = None
        for start in range(max(0, end - longest), end):
            i, s = table.get(text[start:end], (-1, lowest - 10 if end - start == 1 else None))
            if s is not None and (way is None or best[start][0] + s > way[0]):
                way = (best[start][0] + s, start, i)
        best.append(way)
    out, end = [], len(text)
    while end:
        _, start, i = best[end]
        out.append([i] if i >= 0 else [pieces.byte_id[b] for b in text[start:end].encode()])
        end = start
    return [i for x in reversed(out) for i in x]


@pytest.mark.parametrize("fold", ["merge", "viterbi"])
def test_long_segments_and_folds(spark, library, fold):
    pieces = sl.Pieces.load(fold=fold)
    rng = random.Random(9)
    words = ["a" * 3000, "".join(rng.choice("abcdefghijklmnop") for _ in range(2500)), "ab" * 700, "é" * 500, " " * 200, *texts()]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    for r in sl.round_trip(df, pieces=pieces).collect():
        word = words[r.doc_id]
        assert r.decoded_equal and list(r.token_ids) == (brute(sl.prepared(word), pieces) if fold == "viterbi" else library.encode(word)), word[:80]


def test_viterbi_scores_like_the_librarys_best_path(spark):
    """Over words of which each has a piece for its start, as scores of -1e9 would drown the others in single precision."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(sl.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    unigram = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    pieces = sl.Pieces.load(fold="viterbi")
    for text in ["the", "of the people", "reading and writing", "internationalisation of words", "Hello world again"]:
        best = unigram.nbest_encode_as_ids(text, 4)[0]
        assert sum(pieces.score[i] for i in best) == sum(pieces.score[i] for i in brute(sl.prepared(text), pieces))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_whole_table_like_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = sl.round_trip(docs).collect()
    assert len(got) == len(text) and all(r.decoded_equal and list(r.token_ids) == library.encode(text[r.doc_id] or "") for r in got)


def test_short_numbers():
    v = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) + 5, 7])
    data, ends = sl.written_short(v)
    back, where = sl.read_short(data)
    assert back.tolist() == v.tolist() and where.tolist() == ends.tolist() and len(sl.read_short(data[:0])[0]) == 0
