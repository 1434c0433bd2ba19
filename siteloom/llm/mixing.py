"""Operator 3: mixing sources to target weights by the cube method (Deville and Tille, 2004).

A source's target is its share by weight of SHARE times all words, at most MOST times its own words; the excess goes to the others
by weight until none is above. A document is taken floor(target / own words) times for sure and once more with a probability of
what is left. The cube method draws that last copy: three documents at a time, their probabilities move along the null space of
the two balancing equations (number of documents and number of words of the source stay what they are) until one of the three
is 0 or 1. Before that the FIRST largest documents of a block are settled, each by moves in which all of the block balance it. What no move can settle, two documents of a block at most, goes to the next level, where blocks are joined. The KEPT next
larger documents of a block take no part in its flight and go along. At the last level these and the two left
open are the landing problem: of all its outcomes the one nearest to what the source lacks in words and documents is taken.

Blocks are dealt by a hash of the id, about BLOCK documents each, so a hot source is spread over as many tasks as it has blocks. The
draws are hashes of the ids: reruns agree, whatever the partitions.

Defined results: null text has no words; a null source is a source of its own, last in order; documents without words are taken 0
words; sources without words have target 0; rows that share an id are drawn one by one, in the order of their sizes; other columns
are never read and may have any names; a text of any length is one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, checkpointed, free_names

SHARE = 1.5
MOST = 2.0
WEIGHTS = (3.0, 1.0, 2.0)
BLOCK = 2048
#: Blocks that are joined at each level.
FAN = 512
#: Documents of a block that are kept for landing, and larger ones that are settled first.
KEPT, FIRST = 8, 3
#: In landing, so much of the target in words counts as much as one document.
PART = 0.001
#: Tables of up to so many sources are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def n_words(col: str):
    """Words of a text, counted as the places where one starts."""
    text = F.coalesce(F.col(col), F.lit(""))
    trimmed = F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, f"{SPACE_CLASS}+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target: one row per source of (source, size).

    Sources fill up in the order of cap / weight. With the first k full, the others get a level of (all - caps of the k) / (weights of
    the others) per weight; the source that comes next is full too if that exceeds its cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One row per source from here on: windows over these rows alone.
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = per.withColumn("_w", F.element_at(cycle, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    levelled = w.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_w") < F.col("_cap"))
    water = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("_level").alias("level")))).over(whole)["level"]
    return levelled.select("source", "source_size", "n_docs", F.coalesce(F.least(water * F.col("_w"), F.col("_cap")), F.col("_cap")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Probabilities after the moves: all 0 or 1 but two at most. draw: a number of [0, 1) for each move."""
    p = p.astype(float).copy()
    scale = float(size.max()) or 1.0
    x = size / scale
    hand: list[int] = []
    moves = 0
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        hand.append(i)
        if len(hand) < 3:
            continue
        # The null space of (1, 1, 1) and the sizes is their cross product; equal sizes leave a plane, of which one direction serves.
        a, b, c = hand
        u = np.array([x[c] - x[b], x[a] - x[c], x[b] - x[a]])
        if not np.abs(u).max() > 1e-12:
            u = np.array([1.0, -1.0, 0.0])
        u /= np.abs(u).max()
        q = p[hand]
        on = np.abs(u) > 1e-12
        up = np.min(np.where(u[on] > 0, 1 - q[on], q[on]) / np.abs(u[on]))
        down = np.min(np.where(u[on] > 0, q[on], 1 - q[on]) / np.abs(u[on]))
        q = q + (up if draw[moves] < down / (up + down) else -down) * u
        moves += 1
        q[np.abs(q) < 1e-9] = 0.0
        q[np.abs(q - 1) < 1e-9] = 1.0
        p[hand] = q
        hand = [j for j in hand if 0 < p[j] < 1]
        if len(hand) == 3:  # rounding kept all three inside: the nearest to an end goes there
            j = min(hand, key=lambda j: min(p[j], 1 - p[j]))
            p[j] = round(p[j])
            hand.remove(j)
    return p


def settle(size: np.ndarray, p: np.ndarray, i: int, draw: float) -> np.ndarray:
    """Probabilities after moves of all, along what the null space has of i's own direction, until i is 0 or 1 (or too few are left). An
    end for which the others haven't the words to make up is not aimed at."""
    p = p.copy()
    others = np.arange(len(p)) != i
    to_one, to_none = (size[others] @ p[others] >= size[i] * (1 - p[i])), (size[others] @ (1 - p[others]) >= size[i] * p[i])
    scale = float(size.max()) or 1.0
    for k in range(64):
        on = np.flatnonzero((p > 0) & (p < 1))
        if len(on) < 3 or not 0 < p[i] < 1:
            break
        a = np.stack([np.ones(len(on)), size[on] / scale])
        u = (on == i).astype(float)
        u -= a.T @ (np.linalg.pinv(a @ a.T) @ (a @ u))
        if u[on == i][0] < 1e-9:
            break
        q = p[on]
        with np.errstate(divide="ignore"):
            up, down = (np.min(np.where(np.abs(w) > 1e-12, np.where(w > 0, 1 - q, q) / np.abs(w), np.inf)) for w in (u, -u))
        rise = (draw + k * 0.6180339887498949) % 1 < down / (up + down) if to_one == to_none else to_one
        q = q + (up if rise else -down) * u
        q[q < 1e-9], q[q > 1 - 1e-9] = 0.0, 1.0
        p[on] = q
    return p


def land(size: np.ndarray, p: np.ndarray, words: float, docs: float, unit: float) -> np.ndarray:
    """Settles the open rows, a few: the outcome nearest to words and docs, unit words counting as much as one document; of equals
    the one of most probability."""
    p = p.copy()
    rest = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    off = np.abs(ways @ size[rest] - words) / unit + np.abs(ways.sum(axis=1) - docs)
    chance = np.where(ways == 1, p[rest], 1 - p[rest]).prod(axis=1)
    p[rest] = ways[np.lexsort((-chance, off))[0]]
    return p


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["draw", "doc_id", "size"], kind="stable", na_position="first").reset_index(drop=True)
    draw = ((pdf["draw"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float)) * 2.0**-53
    size, p = pdf["size"].to_numpy().astype(float), pdf["p"].to_numpy().copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    by_size = open_[np.argsort(-size[open_], kind="stable")]
    kept = by_size if len(by_size) <= KEPT + 2 else by_size[FIRST : FIRST + KEPT]
    goes = np.ones(len(p), dtype=bool)
    goes[kept] = False
    for i in by_size[:FIRST] if len(kept) < len(by_size) else ():
        p[goes] = settle(size[goes], p[goes], int(goes[:i].sum()), draw[i])
    if goes.any():
        p[goes] = flight(size[goes], p[goes], draw[goes])
    return pdf.assign(p=p)


def _end(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last level: flight over what all blocks of a source left, then landing on what their rows should hold."""
    words, docs = float((pdf["size"] * pdf["p"]).sum()), float(pdf["p"].sum())
    unit = max(1.0, PART * float(pdf["target"].iloc[0]))
    pdf = _fly(pdf)
    p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy().astype(float)
    done = p >= 1
    return pdf.assign(p=land(size, p, words - size[done].sum(), docs - done.sum(), unit))


ROW = "source string, doc_id long, size long, draw long, p double, block long, target double"


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and copies, for each row."""
    sizes = df.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), n_words(text_col).alias("size"))
    sizes = checkpointed(sizes)
    targets = checkpointed(source_targets(sizes))
    n_sources, most = targets.agg(F.count(F.lit(1)), F.max(F.ceil(F.col("n_docs") / block))).first()
    side = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda t: t
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = targets.withColumn("_sure", F.floor(ratio)).withColumn("_p", ratio - F.col("_sure")).withColumn("_blocks", F.ceil(F.col("n_docs") / block))
    draw = F.xxhash64("source", "doc_id", "size", F.lit(3))
    rows = sizes.join(side(known.select(F.col("source").alias("_s"), "_p", "_blocks", "target")), F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.select("source", "doc_id", "size", draw.alias("draw"), F.col("_p").alias("p"), F.pmod(F.xxhash64(draw), F.col("_blocks")).cast("long").alias("block"), "target")
    most = most or 1
    settled: list[DataFrame] = []
    level = rows
    while True:
        last = most <= 1
        flown = checkpointed(level.groupBy("source", "block").applyInPandas(_end if last else _fly, ROW))
        if last:
            settled.append(flown)
            break
        settled.append(flown.filter("p <= 0 or p >= 1"))
        level = flown.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN))
        most = -(-most // FAN)
    drawn = settled[0].drop("target")
    for more in settled[1:]:
        drawn = drawn.unionByName(more.drop("target"))
    ends = known.select(F.col("source").alias("_s"), "source_size", "target", "_sure")
    out = drawn.join(side(ends), F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", (F.col("_sure") + F.col("p").cast("long")).cast("long"))
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def draw(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it, with all columns of df.

    Rows that agree in id, source and size share a list of copies, which they take from in the order of their texts' hashes.
    """
    mixed = mix(df, id_col, text_col, source_col, block)
    a, b, c, d, n, i, copy = names = free_names(df, 7)
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias(a), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias(b), F.col(source_col).isNull().alias(c)]
    names = names[:4]
    taken = mixed.select(F.coalesce(F.col(id_col), F.lit(-(1 << 63))).alias(a), F.coalesce("source", F.lit("")).alias(b), F.col("source").isNull().alias(c), F.col("size").alias(d), "copies")
    lists = checkpointed(taken.groupBy(*names).agg(F.sort_array(F.collect_list("copies")).alias(n)))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64(text_col)))
    rows = df.select("*", *key, n_words(text_col).alias(d)).join(lists, names).withColumn(i, place)
    copies = F.get(F.col(n), F.col(i) - 1).cast("int")
    return rows.select(*[F.col(f"`{x}`") for x in df.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias(copy)).drop(copy)
