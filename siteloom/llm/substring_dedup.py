"""Operator 5: substring dedup by difference-cover anchors.

A window is WINDOW consecutive words. {0, 1, 3, 9} is a perfect difference cover modulo 13: for any two positions i and j some
k < 13 has both i + k and j + k in the cover, so two equal windows share an anchor of WINDOW - 13 + 1 words that starts at cover
positions of both. Only anchors at cover positions are hashed and shuffled. Where an anchor's hash occurs twice, the windows
around it are extended to their full length and compared by 95 bits of hash; all but a sequence's earliest are covered.

No pairs are made: both rounds sort by hash and compare neighbours as they stream by, with no state but the last row. A hash
that many rows share is thinned out before the shuffle: a piece of text sends two rows per anchor at most (a third one is known to
be repeated) and one per window (the earliest in the piece; the others are covered already). Texts whose words all equal those
of a smaller id are settled in a round of their own.

Defined results: null and empty texts have no words; rows that share an id count as one document and never cover each other at
equal positions; a null id sorts before all others; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, normalised
from .wordhash import Family, Texts, U, chunks, mix

WINDOW = 20
PERIOD = 13
#: The perfect difference set modulo 13.
COVER = (0, 1, 3, 9)
#: Hashes that a task remembers as frequent.
REMEMBERED = 1 << 16
_A, _B = Family(11), Family(12)
_NULL_ID = -(1 << 63)


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Texts, pa.RecordBatch, int, int]]:
    for batch in it:
        ids = batch.column("_k").to_numpy(zero_copy_only=False)
        for lo, hi, part in chunks(batch.column("_text").to_pylist()):
            yield ids[lo:hi], Texts(part), batch, lo, hi


def _marked(pos: np.ndarray, known: np.ndarray) -> pa.Array:
    """pos, or -1 - pos where the row is known: a column of its own would cost a word in each shuffled row."""
    return pa.array(np.where(known, -1 - pos, pos).astype(np.int32))


def _unmarked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(pos < 0, -1 - pos, pos), pos < 0


def _spread(h: np.ndarray, known: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """h, but a hash of the row's own place where the row is known: such rows only pass through the shuffle, evenly."""
    return np.where(known, mix(ids.view(U) * U(0x9E3779B97F4A7C15) + pos.astype(U)), h).view(np.int64)


def _rank(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The place of each row among those of its run, where same says that a row of order goes on with the run."""
    begin = np.flatnonzero(~same)
    lengths = np.diff(np.append(begin, len(order)))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(begin, lengths)
    return rank


def _anchors(window: int):
    length = window - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.zeros(0, dtype=np.uint64)
        for ids, t, *_ in _batches(it):
            at = t.full(length)
            pos = at - t.first[t.doc[at]]
            chosen = in_cover[pos % PERIOD]
            at, pos = at[chosen], pos[chosen]
            h = _A.windows(_A.words(t), length, at)
            order = np.argsort(h, kind="stable")
            s = h[order]
            rank = _rank(order, np.append(False, s[1:] == s[:-1])) if len(s) else np.zeros(0, dtype=np.int64)
            known = rank >= 2
            if len(frequent):
                known |= np.isin(h, frequent)
            if len(frequent) < REMEMBERED:
                frequent = np.union1d(frequent, h[rank == 1])[:REMEMBERED]
            k = ids[t.doc[at]]
            yield pa.RecordBatch.from_arrays([pa.array(_spread(h, known, k, pos)), pa.array(k), _marked(pos, known)], names=["h", "_k", "pos"])

    return run


def _repeats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, those that are known or whose h another row has; the row before is all that is held."""
    last: list[np.ndarray] | None = None
    for batch in it:
        h, k, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "_k", "pos"))
        if not len(h):
            continue
        cols = [h, k, *_unmarked(pos)]
        if last is not None:
            cols = [np.append(a, b) for a, b in zip(last, cols, strict=True)]
        h, k, pos, known = cols
        eq = h[1:] == h[:-1]
        hit = (np.append(eq, False) | np.append(False, eq)) | known
        # The last row waits for the next batch; that it has met its like is kept as known.
        yield pa.RecordBatch.from_arrays([pa.array(k[:-1][hit[:-1]]), pa.array(pos[:-1][hit[:-1]].astype(np.int32))], names=["_k", "pos"])
        last = [h[-1:], k[-1:], pos[-1:], hit[-1:]]
    if last is not None and last[3][0]:
        yield pa.RecordBatch.from_arrays([pa.array(last[1]), pa.array(last[2].astype(np.int32))], names=["_k", "pos"])


def _lists(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) of each item of a list column."""
    part = batch.column(name).slice(lo, hi - lo)
    sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(hi - lo), sizes), pc.list_flatten(part).to_numpy(zero_copy_only=False)


def _around(t: Texts, doc: np.ndarray, pos: np.ndarray, before: int, after: int) -> np.ndarray:
    """Which words lie from before words ahead of the marks to after words past them, within the same text."""
    at = t.first[doc] + pos
    edge = np.zeros(len(t.starts) + 1, dtype=np.int32)
    np.add.at(edge, np.maximum(at - before, t.first[doc]), 1)
    np.add.at(edge, np.minimum(at + after, t.first[doc + 1]), -1)
    return np.cumsum(edge[:-1]) > 0


def _windows(window: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, t, batch, lo, hi in _batches(it):
            doc, pos = _lists(batch, "marks", lo, hi)
            near = _around(t, doc, pos, PERIOD - 1, 1)
            at = t.full(window)
            at = at[near[at]]
            h1, h2 = _A.windows(_A.words(t), window, at), _B.windows(_B.words(t), window, at)
            k, p = ids[t.doc[at]], at - t.first[t.doc[at]]
            order = np.lexsort((p, k, h2, h1))
            s1, s2 = h1[order], h2[order]
            new = np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))[: len(s1)]
            lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            later = np.zeros(len(at), dtype=bool)
            later[order] = (k[order] != k[lead]) | (p[order] != p[lead])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_spread(h1, later, k, p)), pa.array(np.where(later, 0, h2 >> U(33)).astype(np.int32)), pa.array(k), _marked(p, later)],
                names=["h", "g", "_k", "pos"],
            )

    return run


def _later(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, g, _k, pos), the known ones and all but each sequence's earliest (and what equals it in _k and pos)."""
    lead = None
    for batch in it:
        h, g, k, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "_k", "pos"))
        if not len(h):
            continue
        pos, known = _unmarked(pos)
        new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        if lead is not None and (h[0], g[0]) == lead[:2]:
            new[0] = False
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1 + (0 if new[0] else 1)
        k0, p0 = k[begin], pos[begin]
        if not new[0]:
            k0, p0 = np.append(lead[2], k0), np.append(lead[3], p0)
        out = known | ~((k == k0[run]) & (pos == p0[run]))
        lead = (h[-1], g[-1], k0[run[-1]], p0[run[-1]])
        yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(pos[out].astype(np.int32))], names=["_k", "pos"])


def _kept(window: int, digest: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, t, batch, lo, hi in _batches(it):
            gone = _around(t, *_lists(batch, "marks", lo, hi), 0, window)
            n = np.diff(t.first)
            copy = batch.column("copy").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            gone |= (copy & (n >= window))[t.doc]
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), t.first[:-1]) * (n > 0)
            out = []
            for d, text in enumerate(t.texts):
                if removed[d]:
                    stay = np.flatnonzero(~gone[t.first[d] : t.first[d + 1]]) + t.first[d]
                    words = [t.buffer[a:b] for a, b in zip(t.starts[stay].tolist(), t.ends[stay].tolist(), strict=True)]
                else:
                    words = text.split()
                kept = b" ".join(words)
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(removed), pa.array(out, pa.string())], names=["_k", "n_words", "n_removed", "kept"])

    return run


def _base(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_k"), F.col(text_col).alias("_text"))


def _plan(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """_k, _text, copy, marks (starts of covered windows) of each row."""
    base = _base(df, id_col, text_col)
    # Ids of rows whose words equal those of a smaller id.
    words = base.select("_k", F.sha2(F.trim(normalised("_text")), 256).alias("_sha"))
    firsts = checkpointed(words.groupBy("_sha").agg(F.min("_k").alias("_min"), F.max("_k").alias("_max")).filter("_min < _max").select("_sha", "_min"))
    copies = checkpointed(words.join(firsts, "_sha").filter("_k > _min").select("_k").distinct().withColumn("copy", F.lit(True)))
    # One shuffle of the texts by id serves all three joins below, as their exchanges are equal.
    own = base.join(copies, "_k", "left_anti")
    found = own.mapInArrow(_anchors(window), "h long, _k long, pos int")
    again = found.repartition("h").sortWithinPartitions("h").mapInArrow(_repeats, "_k long, pos int")
    marks = again.groupBy("_k").agg(F.collect_list("pos").alias("marks"))
    seen = base.join(marks, "_k").mapInArrow(_windows(window), "h long, g int, _k long, pos int")
    late = seen.repartition("h").sortWithinPartitions("h", "g", "_k", "pos").mapInArrow(_later, "_k long, pos int")
    covered = late.groupBy("_k").agg(F.collect_list("pos").alias("marks"))
    return base.join(covered, "_k", "left").join(copies, "_k", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))


def _result(df: DataFrame, id_col: str, text_col: str, window: int, digest: bool, name: str) -> DataFrame:
    out = _plan(df, id_col, text_col, window).mapInArrow(_kept(window, digest), "_k long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("_k") != _NULL_ID, F.col("_k")).alias(id_col), "n_words", "n_removed", F.col("kept").alias(name))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept_text: the words that no repeated window covers, joined by one space."""
    return _result(df, id_col, text_col, window, False, "kept_text")


def substring_dedup_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The same with kept_sha256, the digest of kept_text, in its place."""
    return _result(df, id_col, text_col, window, True, "kept_sha256")
