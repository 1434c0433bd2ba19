import hashlib
import re
import zlib

import pytest

from siteloom.llm import chat_format, common, exact_dedup, sharding


def jump(key, n):
    """The published loop, restated."""
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_like_published_loop(spark):
    keys = [0, 1, 2, 42, 256, -1, -(1 << 63), (1 << 63) - 1, 0xDEAD10CC, *range(1000, 1100)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for r in df.select("k", sharding.jump_hash(df.k, 1, 7, 40, 41, 1024).alias("b")).collect():
        assert r.b == [jump(r.k, n) for n in (1, 7, 40, 41, 1024)]
    assert (jump(1, 1), jump(42, 57), jump(256, 1024)) == (0, 43, 520)


def test_shards(spark):
    rows = [(k, "é" * (k % 7)) for k in range(3000)] + [(5, "twice"), (5, "twice"), (None, None), (9999, None), (9998, "z" * 300000)]
    got = sharding.shard(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, slot int"), 40).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.law == "key" and r.shard == jump(r.doc_id or 0, 40) and r.grown_shard in (r.shard, 40)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = dict(rows)
    for r in got:
        if r.doc_id != 5 and r.doc_id is not None:
            t = text[r.doc_id]
            assert r.size == 16 + len((t or "").encode()) and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 40).collect() == []


def test_exact_dedup(spark):
    long = "word " * 50000
    rows = [(1, "a  b"), (2, "a b"), (3, "a\tb"), (4, " a b"), (5, None), (6, ""), (7, long), (8, long + "x"), (9, long), (10, "q" * 300 + "1"), (11, "q" * 300 + "2"), (12, "a b"), (12, "a b"), (13, "a b")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, text_sha256 string, keep_id int")
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for k, t in rows:
        groups.setdefault(norm(t), []).append(k)
    want = sorted((k, min(groups[norm(t)]), len(groups[norm(t)]), k == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for k, t in rows)
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(df).collect()) == want
    stay = exact_dedup.drop_exact_copies(df)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(w[0] for w in want if w[3])
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize("small", [0, 500_000])
def test_exact_dedup_with_names_used_inside(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    names = ["_free0", "_sha", "_keep", "_g", "_len", "_pre", "text_sha256", "keep_id", "group_size"]
    texts = ["a  b", "a b", "c", "c", "d" * 300 + "1", "d" * 300 + "2", None, ""]
    df = spark.createDataFrame([(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    stay = exact_dedup.drop_exact_copies(df)
    assert stay.columns == df.columns
    assert sorted(stay.collect()) == sorted(r for r in df.collect() if r.doc_id in (0, 2, 4, 5, 6))
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(df).filter("kept").collect()) == [0, 2, 4, 5, 6]


def test_chat(spark):
    mark = chat_format.MARK
    rows = [
        (1, 0, "user", "<|start|>user\nhi <|end|>\n"), (1, 1, "user", f"{mark}{mark}a <s>"), (1, 2, "assistant", "one <|next|>"), (1, 3, "assistant", ""),
        (1, 4, "assistant", f"two {mark}z\n"), (2, 0, "a\nb<|x", "t"), (3, 0, None, None), (4, None, "assistant", "é" * 70000), (4, 1, "user", "[/INST]</s>"),
        (None, 0, "assistant", "n"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"),
        *((6, t, "assistant" if t % 3 else "user", f"t{t}") for t in range(1000)),
    ]
    df = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = chat_format.format_conversations(df)
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    got = {r.conv_id: r for r in chat_format.digest(formatted).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        bare = r.formatted.replace("<|start|>", "").replace("<|next|>", "").replace("<|end|>", "")
        assert not any(x in bare for x, _ in chat_format.ESCAPES)
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).collect() == []
