"""Operator 7: near-duplicate documents by ProbMinHash (Ertl, 2020), banding and exact verification.

Shingles are SHINGLE consecutive words (a shorter text is one shingle); a shingle that occurs n times weighs 1 + ln n. Each
weighted shingle sends arrivals of a Poisson process to REGISTERS registers, one to each, in an order of its own: the i-th arrival
comes after an exponential wait of rate weight * (REGISTERS - i), and stops as soon as it is later than every register's earliest
arrival. A register's earliest shingle agrees between two texts with their probability Jaccard similarity, which is the Jaccard
similarity of the sets where weights are equal. BANDS bands of REGISTERS / BANDS registers give candidates; a link needs a Jaccard
similarity of THRESHOLD between the shingle sets, computed exactly over 64-bit shingle hashes. Weights only steer which candidates
are met; what counts as a link is the unweighted similarity.

Texts with equal shingle sets are one class from the start; only its least id goes on. In a bucket every member is compared with
the bucket's least id, not with each other. What these links leave in different components is compared again, within buckets,
but for pairs that exact bounds rule out (see _left_over). So every candidate pair ends in one component, is verified, or is proven
unlike, while large groups of near copies cost a few comparisons a member.

Defined results: texts without words are near nothing and stand alone; rows that share an id count as one document; a null id is
compared as the least long and given back as null; a text of any length is one set; other columns are never read and may have any
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names, join_keys, release
from .components import connected_components
from .wordhash import Family, Texts, U, chunks, give_back, mix

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
BANDS = 32
GROUPS = 64
_H = Family(21)
_NULL_ID = -(1 << 63)
_GOLDEN = U(0x9E3779B97F4A7C15)


def shingle_sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of each text's distinct shingles, sorted."""
    words = _H.words(t)
    at = t.full(k)
    n = np.diff(t.first)
    short = np.flatnonzero((n > 0) & (n < k))
    h = np.append(_H.windows(words, k, at), _H.spans(words, t.first[short], t.first[short + 1]))
    doc = np.append(t.doc[at], short)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    begin = np.flatnonzero(new)
    return doc[begin], h[begin], np.diff(np.append(begin, len(h)))


def prob_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """n_docs x m signatures; m must be a power of two. Rows without shingles stay 0."""
    best = np.full(n_docs * m, np.inf)
    sig = np.zeros(n_docs * m, dtype=U)
    # The order in which a shingle visits registers: start + i * odd step, modulo m.
    place = mix(h ^ U(0x5851F42D4C957F2D))
    start, step = place & U(m - 1), ((place >> U(20)) & U(m - 1)) | U(1)
    time, salts = np.zeros(len(h)), np.arange(1, m + 1, dtype=U) * _GOLDEN
    for i in range(m):
        if not len(h):
            break
        u = ((mix(h + salts[i]) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / (weight * (m - i))
        slot = doc * m + ((start + U(i) * step) & U(m - 1)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        sig[slot[won]] = h[won]
        on = time < best.reshape(n_docs, m).max(axis=1)[doc]
        doc, h, weight, start, step, time = doc[on], h[on], weight[on], start[on], step[on], time[on]
    return sig.reshape(n_docs, m)


def _signatures(k: int, bands: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column("_k")
            for lo, hi, part in chunks(batch.column("_text").to_pylist()):
                n = hi - lo
                doc, h, count = shingle_sets(Texts(part), k)
                sig = prob_min_hash(doc, h, 1 + np.log(count), n)
                band = np.zeros((n, bands), dtype=U)
                for r in range(REGISTERS // bands):
                    band = mix(band * _GOLDEN + sig[:, r::REGISTERS // bands] + U(r + 1))
                band = mix(band + np.arange(bands, dtype=U) * _GOLDEN)
                sizes = np.bincount(doc, minlength=n)
                full = np.flatnonzero(sizes)
                begin = np.searchsorted(doc, full)
                sets = [np.zeros(n, dtype=U), np.zeros(n, dtype=U)]
                if len(full):
                    for out, salt in zip(sets, (U(1), U(2)), strict=True):
                        out[full] = mix(np.add.reduceat(mix(h * _GOLDEN + salt), begin) + sizes[full].astype(U))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n).cast(pa.int64()), pa.array(sizes.astype(np.int64)), *[pa.array(x.view(np.int64)) for x in sets], pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))],
                    names=["_k", "n", "c1", "c2", "bands"],
                )
        give_back()

    return run


def _sets(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, part in chunks(batch.column("_text").to_pylist()):
                doc, h, _ = shingle_sets(Texts(part), k)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column("_k").slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["_k", "shingles"])

    return run


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            p, q = (np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y))
            if len(p) > len(q):
                p, q = q, p
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            common = int((q[at] == p).sum())
            out.append(common / (len(p) + len(q) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


def _similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of each pair."""
    left = pairs.join(sets.select(F.col("_k").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("_k").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_compare, "a long, b long, similarity double")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """id, class_id (the least id that links reach), kept (id = class_id) for each row."""
    base = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_k"), F.col(text_col).alias("_text"))
    signed = checkpointed(base.mapInArrow(_signatures(k, bands), "_k long, n long, c1 long, c2 long, bands array<long>"))
    classes = checkpointed(signed.filter("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("_k", "bands")).alias("m")).select("c1", "c2", F.col("m._k").alias("rep"), "m.bands"))
    members = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    leaders = members.groupBy("band", "bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("_max")).filter("leader < _max").drop("_max")
    met = checkpointed(members.join(checkpointed(leaders), ["band", "bucket"]))
    pairs = checkpointed(met.filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct())
    # Every row of a bucket of two or more stands in a pair, so these sets also serve what is left over below.
    wanted = pairs.select(F.col("a").alias("_k")).union(pairs.select(F.col("b").alias("_k"))).distinct()
    shingled = base.join(wanted, "_k", "left_semi").mapInArrow(_sets(k), "_k long, shingles binary")
    sets = checkpointed(shingled.groupBy("_k").agg(F.min("shingles").alias("shingles")))
    scored = checkpointed(_similarity(pairs, sets))
    release(df.sparkSession)
    links = scored.filter(F.col("similarity") >= threshold).select("a", "b")
    links = _left_over(met, scored, links, sets, threshold)
    parts = checkpointed(connected_components(links, "a", "b"))
    labels = classes.select("c1", "c2", "rep").join(parts, classes["rep"] == parts["node"], "left").select("c1", "c2", F.coalesce("component", "rep").alias("_class"))
    own = signed.select("_k", F.when(F.col("n") > 0, F.col("c1")).otherwise(F.col("_k")).alias("c1"), F.when(F.col("n") > 0, F.col("c2")).otherwise(0).alias("c2"))
    found = own.join(checkpointed(labels), ["c1", "c2"], "left").withColumn("_class", F.coalesce("_class", "_k"))
    given = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return found.select(given("_k").alias(id_col), given("_class").alias("class_id"), (F.col("_k") == F.col("_class")).alias("kept"))


def _explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in part.column("shingles")]
            ids = np.repeat(part.column("_k").to_numpy(zero_copy_only=False), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(ids)], names=["h", "_k"])


def _histograms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        counts = [np.bincount(np.frombuffer(x.as_buffer(), dtype=np.int64) % GROUPS, minlength=GROUPS).astype(np.int32) for x in batch.column("shingles")]
        flat = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.FixedSizeListArray.from_arrays(pa.array(flat), GROUPS).cast(pa.list_(pa.int32()))], names=["_k", "every"])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda a, x: a + x)


def _with_parts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows of the buckets that span several components, with their component as part."""
    part = connected_components(links, "a", "b").select(F.col("node").alias("rep"), "component")
    parted = checkpointed(rows.join(part, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component"))
    several = parted.groupBy("band", "bucket").agg(F.min("part").alias("_p"), F.max("part").alias("_q")).filter("_p < _q").select("band", "bucket")
    # Checkpointed, so that both sides of the join are plain exchanges and a hot bucket is split.
    return checkpointed(parted.join(checkpointed(several), ["band", "bucket"], "left_semi"))


def _left_over(met: DataFrame, scored: DataFrame, links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """links and those among rows of one bucket that they leave in different components.

    A text's shingles that another text in question has too are counted by GROUPS residues of their hashes. Two texts share the sum of the
    lesser counts at most; of n and n' shingles that bounds their similarity by m / (n + n' - m). With d the distance to the bucket's
    leader, |d - d'| bounds their distance from below. Rows that can't reach the threshold with any text are out. The others of a bucket are compared with the one that has the smallest share of
    shingles of its own, the middle of a group of copies; what is still apart then is compared pair by pair, within both bounds.
    """
    gone = scored.select(F.col("a").alias("rep"), F.col("b").alias("leader"), (1 - F.col("similarity")).alias("d"))
    rows = met.join(gone, ["rep", "leader"], "left").select("band", "bucket", "rep", F.coalesce("d", F.lit(0.0)).alias("d"))
    rows = _with_parts(rows, links)
    if not rows.head(1):
        return links
    asked = sets.join(rows.select(F.col("rep").alias("_k")).distinct(), "_k", "left_semi")
    counted = asked.mapInArrow(_explode, "h long, _k long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("_k")).filter("n = 1")
    alone = counted.groupBy("_k", F.pmod("h", F.lit(GROUPS)).cast("int").alias("g")).count().groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("g", "count"))).alias("u"))
    left = F.transform("every", lambda n, g: n - F.coalesce(F.try_element_at("u", g), F.lit(0)).cast("int"))
    known = asked.mapInArrow(_histograms, "_k long, every array<int>").join(alone, "_k", "left").select(F.col("_k").alias("rep"), _sum(F.col("every")).alias("n"), left.alias("c"))
    known = known.withColumn("s", _sum(F.col("c"))).filter(F.col("s") >= F.lit(threshold) * F.col("n"))
    rows = checkpointed(rows.join(checkpointed(known), "rep"))

    side = lambda df, x: df.select("band", "bucket", *[F.col(c).alias(c + x) for c in ("rep", "part", "d", "n", "s", "c")])
    enough = lambda m: m >= F.lit(threshold) * (F.col("na") + F.col("nb") - m)
    common = _sum(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)))
    able = (F.col("parta") != F.col("partb")) & enough(F.least("sa", "sb")) & (F.abs(F.col("da") - F.col("db")) <= 1 - threshold + 1e-9) & enough(common)
    pairs = lambda df: df.filter(able).select(F.greatest("repa", "repb").alias("a"), F.least("repa", "repb").alias("b")).distinct().join(scored, ["a", "b"], "left_anti")
    row = F.struct(*[F.col(c) for c in ("rep", "part", "d", "n", "s", "c")])
    middle = rows.groupBy("band", "bucket").agg(F.min_by(row, F.struct(1 - F.col("s") / F.col("n"), "rep")).alias("m")).select("band", "bucket", "m.*")
    met_middle = checkpointed(pairs(side(rows, "a").join(checkpointed(side(middle, "b")), ["band", "bucket"])))
    seen = checkpointed(_similarity(met_middle, sets))
    release(sets.sparkSession)
    links = links.union(seen.filter(F.col("similarity") >= threshold).select("a", "b"))

    rows = _with_parts(rows.drop("part"), links)
    if not rows.head(1):
        return links
    # Members of a bucket's largest component are never paired among themselves.
    largest = rows.groupBy("band", "bucket", "part").count().groupBy("band", "bucket").agg(F.max_by("part", F.struct("count", "part")).alias("most"))
    outer = checkpointed(rows.join(checkpointed(largest), ["band", "bucket"]).filter("part <> most").drop("most"))
    # Of a pair that reaches the threshold neither set is larger than 1 / threshold times the other, and the distances to the leader
    # differ by 1 - threshold at most: classes of both, and the neighbouring ones, are keys of the join.
    kind = lambda c, step: F.floor(c / F.lit(step)).cast("int")
    kinds = lambda df: df.withColumns({"_n": kind(F.log("n"), -math.log(threshold) + 1e-9), "_d": kind(F.col("d"), 1 - threshold + 1e-9)})
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    keys = ["band", "bucket", "_n", "_d"]
    wide = lambda df, x: df.select(*keys, *[F.col(c).alias(c + x) for c in ("rep", "part", "d", "n", "s", "c")])
    met_rest = wide(kinds(outer).withColumn("_n", near("_n")).withColumn("_d", near("_d")), "a").join(wide(kinds(rows), "b"), keys)
    rest = pairs(met_rest).join(seen, ["a", "b"], "left_anti")
    more = checkpointed(_similarity(checkpointed(rest), sets))
    return links.union(more.filter(F.col("similarity") >= threshold).select("a", "b"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, one document of each class, with all their columns."""
    name = free_names(df, 1)[0]
    gone = checkpointed(near_duplicates(df, id_col, text_col).filter("not kept").select(F.col(id_col).alias(name)).distinct())
    return join_keys(df, gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
