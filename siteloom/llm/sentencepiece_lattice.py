"""Operator 2: SentencePiece encoding and decoding over a relational lattice.

Text is prepared as the model file says for a model with the identity normaliser: a space becomes U+2581 and one is put in front.
Two neighbouring characters that no piece holds side by side can't lie in one piece, so a text falls apart exactly at such places;
the parts between are segments, the words of the lattice. Each distinct segment of the corpus is encoded once, every one of them so:

    explode its substrings of up to the longest piece's length, equi-join them to the piece table, group the edges by segment,
    fold over the edges with Spark's aggregate().

The fold is the one that the file's own type asks for, so that the ids are those of the SentencePiece library:

    UNIGRAM  Viterbi over the edges sorted by end; of paths of equal score the one whose last piece starts first wins
    BPE      again and again the best edge that joins two neighbours is taken, the leftmost of equals; the bounds between pieces
             are the bits of a long. Segments of more than BITS characters go by Viterbi over the same edges, where an edge may
             follow another only if merging leaves the two apart. For that their joined texts are encoded by the first fold. A path
             of such neighbours is the one that merging the whole gives, and there is one for each end, so nothing is scored.

Viterbi over the scores of a BPE file, which are ranks of merges, gives other ids than the library for most texts; `fold` forces it
all the same. A single character that is no piece is written as the pieces of its bytes; for Viterbi it is an edge at the lowest
score less 10.

The ids then go back to the texts by a join that is split by heat: the most frequent segments, CACHE_BYTES at most, are broadcast;
each other one is a row (text's key, segment), joined to the lattice's answers and gathered by text. The texts meet them as lists of
numbers, each a segment's place in the broadcast table or a gap, in a byte or two where the segment is frequent; one shuffle of
these serves both sides. A segment outside the broadcast table can't be hot, as many others are more frequent, and equal rows have a
key for each partition they come from. In Python texts are cut, segments are looked up by a 64-bit hash
and ids are laid end to end; no text is encoded there.

Defined results: null and empty texts have no ids; U+2581 in a text is read back as a space; equal rows give equal results, one
each; a null id stays null; other columns are never read. A text's segments may have any length; the edges of one segment are one
row, so a segment must fit a task as a value (a few hundred bytes a character), as a text must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, drop_scratch, release, written
from .wordhash import Family, U, give_back, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNK_PENALTY = 10.0
#: Bytes of segments and ids that are broadcast.
CACHE_BYTES = 24 << 20
#: Characters of a segment whose bounds fit the bits of a long, and of a block of a longer one.
BITS = 62
#: Bytes of text that are cut at once (a longer text is taken alone), and such parts whose segments are counted together.
PART, TOGETHER = 1 << 17, 32
#: Segments of a task of the lattice: each has some tens of edges, which are grouped within memory.
TASK = 1 << 15
_RUN = 256
_H = Family(51)


@dataclass
class Pieces:
    """The piece table: what each id stands for."""

    text: list[str]
    score: list[float]
    kind: list[str]
    fold: str = "merge"
    byte_id: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str = MODEL, fold: str | None = None) -> Pieces:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        m = SentencePieceProcessor(model_file=path)
        proto = ModelProto.FromString(m.serialized_model_proto())
        own = {1: "viterbi", 2: "merge"}[proto.trainer_spec.model_type]
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with the identity normaliser, a dummy prefix and byte fallback are read")
        ids = range(m.get_piece_size())
        kind = ["byte" if m.is_byte(i) else "unk" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "normal" for i in ids]
        return cls([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], kind, fold or own)

    def __post_init__(self):
        byte = {self.text[i]: i for i, k in enumerate(self.kind) if k == "byte"}
        unk = next((i for i, k in enumerate(self.kind) if k == "unk"), 0)
        self.byte_id = [byte.get(f"<0x{v:02X}>", unk) for v in range(256)]

    def normal(self) -> list[tuple[str, int, float]]:
        return [(t, i, s) for i, (t, s, k) in enumerate(zip(self.text, self.score, self.kind, strict=True)) if k == "normal"]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.normal(), "piece string, id int, score double")

    def as_bytes(self) -> list[bytes]:
        byte = {i: bytes([v]) for v, i in enumerate(self.byte_id)}
        return [self.text[i].replace(SPACE, " ").encode() if k == "normal" else byte.get(i, b"") if k == "byte" else b"" for i, k in enumerate(self.kind)]


class Cutter:
    """Cuts prepared texts into segments."""

    def __init__(self, pieces: Pieces):
        beside = {a + b for t, _, _ in pieces.normal() for a, b in zip(t, t[1:], strict=False)}
        # Characters of pieces by number, 0 for all others, and which numbers stand side by side in one.
        chars = sorted({c for b in beside for c in b})
        self.number = np.zeros(0x110000, dtype=np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for b in beside:
            self.joined[self.number[ord(b[0])], self.number[ord(b[1])]] = True


def prepared(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


#: What a character counts for in a segment's hash.
_VALUE = mix(np.arange(1, 0x110001, dtype=U) * U(0x9E3779B97F4A7C15))


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=U)
    return _H._runs(_VALUE[points], _H.bases[0], starts, ends) + (ends - starts).astype(U)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _segment_hashes(strings: list[str]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)))
    return _hashes(_points("".join(strings)), np.append(0, ends)[: len(ends)], ends)


class Cut:
    """Segments of some texts: segment i is whole[starts[i]:ends[i]], of text doc[i], with hash h[i]."""

    def __init__(self, cutter: Cutter, texts: list[str | None]):
        parts = [prepared(t) for t in texts]
        self.whole = "".join(parts)
        points = _points(self.whole)
        begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))))
        n = cutter.number[points]
        cut = np.append(True, ~cutter.joined[n[:-1], n[1:]])[: len(n)]
        cut[begins[begins < len(n)]] = True
        self.starts = np.flatnonzero(cut)
        self.ends = np.append(self.starts[1:], len(n))[: len(self.starts)]
        self.first = np.searchsorted(self.starts, begins)
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self.h = _hashes(points, self.starts, self.ends)

    def strings(self, at: np.ndarray) -> list[str]:
        whole = self.whole
        return [whole[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    """(from, to, texts) in parts of about PART bytes; only one part's texts are Python strings at a time."""
    texts = batch.column("_text")
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
        yield at, to, texts.slice(at, to - at).to_pylist()
        at = to


def _count(cutter: Cutter):
    """segment, n: how often each segment occurs in some parts of a task's texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, Cut, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, n = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, dtype=np.int64) for i in (0, 1))
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(back, weights=n, minlength=len(first)).astype(np.int64)
            ends = np.cumsum([len(x[0]) for x in held])
            order = np.argsort(first)
            out: list[str] = []
            for (hs, _, cut, at), end in zip(held, ends, strict=True):
                mine = first[order]
                mine = mine[(mine >= end - len(hs)) & (mine < end)] - (end - len(hs))
                out += cut.strings(at[mine])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(total[order])], names=["segment", "n"])

        for batch in it:
            for _, _, texts in _parts(batch):
                cut = Cut(cutter, texts)
                h, at, n = np.unique(cut.h, return_index=True, return_counts=True)
                held.append((h, n, cut, at))
                cut.doc = cut.h = cut.first = None
                if len(held) >= TOGETHER:
                    yield flush()
        yield flush()
        give_back()

    return run


def edges(segments: DataFrame, pieces: DataFrame, longest: int, lowest: float) -> DataFrame:
    """segments' columns, piece, end, start, id (-1: no piece), score: each piece's place in each segment. Long segments are read in blocks."""
    own, n = segments.columns, F.length("segment")
    blocks = segments.select(*own, n.alias("_n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / BITS).cast("int"))).alias("_b"))
    blocks = blocks.select(*own, "_n", (F.col("_b") * BITS).alias("_at"), F.when(F.col("_n") <= BITS, F.col("segment")).otherwise(F.substring("segment", F.col("_b") * BITS + 1, F.lit(BITS + longest))).alias("_t"))
    starts = blocks.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(BITS), F.col("_n") - F.col("_at")) - 1)).alias("_i"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("_n") - F.col("_at") - F.col("_i")))).alias("_l"))
    subs = spans.select(*own, (F.col("_at") + F.col("_i")).alias("start"), "_l", F.substring("_t", F.col("_i") + 1, F.col("_l")).alias("piece"))
    # The piece table is the vocabulary file: broadcast within that bound.
    hit = subs.join(F.broadcast(pieces), "piece", "left").filter(F.col("id").isNotNull() | (F.col("_l") == 1))
    return hit.select(*own, "piece", (F.col("start") + F.col("_l")).alias("end"), "start", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(lowest - UNK_PENALTY)).alias("score"))


def viterbi(edges_sorted: Column, longest: int) -> Column:
    """array<struct<e,s,i>>: the best path over edges (end, start, id, score) sorted by end and start.

    The state holds the scores of the last `longest` ends, so a step costs the same anywhere; ends settled are kept in runs of _RUN, so that
    appending doesn't copy all of them.
    """
    node = "struct<e:int,s:int,i:int>"
    empty, runs = F.array().cast(f"array<{node}>"), F.array().cast(f"array<array<{node}>>")
    last = lambda s: F.struct(s["e"].alias("e"), s["s"].alias("s"), s["i"].alias("i"))

    def push(s: Column, at: Column, x: Column) -> list[Column]:
        """cur and done after x is appended where at holds."""
        full = F.size(s["cur"]) >= _RUN
        cur = F.when(at, F.when(full, F.array(x)).otherwise(F.array_append(s["cur"], x))).otherwise(s["cur"])
        return [cur.alias("cur"), F.when(at & full, F.array_append(s["done"], s["cur"])).otherwise(s["done"]).alias("done")]

    def step(s: Column, x: Column) -> Column:
        new = x["end"] != s["e"]
        win = F.when(new, F.slice(F.concat(F.array(s["b"]), s["win"]), 1, longest)).otherwise(s["win"])
        score = F.element_at(win, x["end"] - x["start"]) + x["score"]
        better = new | (score > s["b"])
        pick = lambda a, b: F.when(better, a).otherwise(b)
        return F.struct(x["end"].alias("e"), pick(score, s["b"]).alias("b"), pick(x["start"], s["s"]).alias("s"), pick(x["id"], s["i"]).alias("i"), win.alias("win"), *push(s, new & (s["e"] > 0), last(s)))

    begin = F.struct(
        F.lit(0).alias("e"), F.lit(0.0).alias("b"), F.lit(0).alias("s"), F.lit(0).alias("i"),
        F.array().cast("array<double>").alias("win"), empty.alias("cur"), runs.alias("done"),
    )
    nodes = F.aggregate(edges_sorted, begin, step, lambda s: F.flatten(F.array_append(s["done"], F.array_append(s["cur"], last(s)))))

    def back(s: Column, x: Column) -> Column:
        on = (s["next"] < 0) | (x["e"] == s["next"])
        return F.struct(F.when(on, x["s"]).otherwise(s["next"]).alias("next"), *push(s, on, x))

    path = F.aggregate(F.reverse(nodes), F.struct(F.lit(-1).alias("next"), empty.alias("cur"), runs.alias("done")), back, lambda s: F.flatten(F.array_append(s["done"], s["cur"])))
    return F.reverse(path)


def merged(joins: Column, n: Column) -> Column:
    """long: the bounds between pieces that merging leaves of n characters, as bits. joins: edges of two characters or more, the best
    first and the leftmost of equals, with the bits of their ends and those between."""

    def step(m: Column, _: Column) -> Column:
        # A negative state has come to its end.
        can = lambda x: (m.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(m.bitwiseAND(x["inner"])) == 1)
        return F.when(m < 0, m).otherwise(F.coalesce(m - m.bitwiseAND(F.get(F.filter(joins, can), F.lit(0))["inner"]), -m))

    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.abs(F.aggregate(steps, F.expr("shiftleft(2L, _n) - 1"), step))


def _ids(id_: Column, piece: Column, pieces: Pieces) -> Column:
    """array<int>: a piece's id, or the ids of its bytes where it is none."""
    byte_id = F.array(*[F.lit(i) for i in pieces.byte_id])
    hexed = F.hex(F.encode(piece, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")), lambda k: F.element_at(byte_id, F.conv(F.substring(hexed, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))
    return F.when(id_ >= 0, F.array(id_)).otherwise(bytes_)


def _merge_short(lattice: DataFrame, own: list[str], pieces: Pieces) -> DataFrame:
    """The columns own, ids and bounds of segments of up to BITS characters."""
    bits = lattice.select(*own, "start", "id", (-F.col("score")).alias("rank"), F.expr("shiftleft(1L, start) + shiftleft(1L, end)").alias("ends"), F.expr("shiftleft(1L, end) - shiftleft(2L, start)").alias("inner"))
    # Edges of one character join nothing; they say what is written where no other piece is left.
    edge, one = F.struct("rank", "start", "ends", "inner", "id"), F.struct("start", "id")
    grouped = bits.groupBy(*own).agg(F.sort_array(F.collect_list(F.when(F.col("inner") != 0, edge))).alias("_e"), F.collect_list(F.when(F.col("inner") == 0, one)).alias("_o"))
    found = grouped.withColumn("_n", F.length("segment")).withColumn("_m", merged(F.col("_e"), F.col("_n")))
    m = F.col("_m")
    left = F.filter("_e", lambda x: (m.bitwiseAND(x["ends"]) == x["ends"]) & (m.bitwiseAND(x["inner"]) == 0))
    alone = F.filter("_o", lambda x: F.call_function("shiftright", m, x["start"]).bitwiseAND(F.lit(3)) == 3)
    kept = F.sort_array(F.concat(F.transform(left, lambda x: F.struct(x["start"].alias("start"), x["id"].alias("id"))), alone))
    found = found.select(*own, m.alias("bounds"), kept.alias("_k"))
    plain = F.transform("_k", lambda x: x["id"])
    by_bytes = F.flatten(F.transform("_k", lambda x: _ids(x["id"], F.substring(F.col("segment"), x["start"] + 1, F.lit(1)), pieces)))
    return found.select(*own, F.when(F.array_min(plain) >= 0, plain).otherwise(by_bytes).alias("ids"), "bounds")


def path(edges_sorted: Column, longest: int) -> Column:
    """array<struct<e,s,i>>: of edges (end, start, id, lefts) sorted by end the path on which each edge's left neighbour is one of its lefts,
    known by where it starts; -1 stands for none. There is one such edge for each end."""
    node = "struct<e:int,s:int,i:int>"

    def push(s: Column, x: Column) -> list[Column]:
        full = F.size(s["cur"]) >= _RUN
        return [F.when(full, F.array(x)).otherwise(F.array_append(s["cur"], x)).alias("cur"), F.when(full, F.array_append(s["done"], s["cur"])).otherwise(s["done"]).alias("done")]

    empty, runs = F.array().cast(f"array<{node}>"), F.array().cast(f"array<array<{node}>>")

    def step(s: Column, x: Column) -> Column:
        # win: where the piece that ends at each of the last places starts, the nearest first.
        fits = F.array_contains(x["lefts"], F.element_at(s["win"], x["end"] - x["start"]))
        taken = F.struct(F.slice(F.concat(F.array(x["start"]), s["win"]), 1, longest).alias("win"), *push(s, F.struct(x["end"].alias("e"), x["start"].alias("s"), x["id"].alias("i"))))
        return F.when(fits, taken).otherwise(s)

    begin = F.struct(F.array(F.lit(-1)).alias("win"), empty.alias("cur"), runs.alias("done"))
    nodes = F.aggregate(edges_sorted, begin, step, lambda s: F.flatten(F.array_append(s["done"], s["cur"])))

    def back(s: Column, x: Column) -> Column:
        on = (s["next"] < 0) | (x["e"] == s["next"])
        return F.when(on, F.struct(x["s"].alias("next"), *push(s, x))).otherwise(s)

    found = F.aggregate(F.reverse(nodes), F.struct(F.lit(-1).alias("next"), empty.alias("cur"), runs.alias("done")), back, lambda s: F.flatten(F.array_append(s["done"], s["cur"])))
    return F.reverse(found)


def _merge_long(long: DataFrame, pieces: Pieces, table: DataFrame, longest: int, lowest: float) -> DataFrame:
    """segment, ids of segments of any length."""
    lattice = checkpointed(edges(long, table, longest, lowest).withColumn("_h", F.xxhash64("segment")))
    right = lattice.select("segment", "_h", "start", "end", "id", F.col("piece").alias("_r"))
    left = lattice.select("segment", "_h", F.col("end").alias("start"), F.col("start").alias("_s"), F.col("piece").alias("_l"))
    first = lattice.filter("start = 0").select("segment", "_h", "start", F.lit(-1).alias("_s"), F.lit("").alias("_l")).distinct()
    beside = right.join(left.unionByName(first), ["_h", "segment", "start"]).withColumn("_both", F.concat("_l", "_r")).withColumn("_at", F.length("_l"))
    beside = checkpointed(beside.select("segment", "start", "end", "id", "_s", "_both", "_at"))
    # Texts of two pieces at most: those of one piece come by the first fold too, so all are of up to twice the longest piece.
    apart = _merge_short(edges(beside.select(F.col("_both").alias("segment")).distinct(), table, longest, lowest), ["segment"], pieces)
    apart = checkpointed(apart.select(F.col("segment").alias("_both"), "bounds"))
    fits = F.col("bounds") == F.expr("1L | shiftleft(1L, _at) | shiftleft(1L, length(_both))")
    ways = beside.join(apart, "_both").filter(fits).groupBy("segment", "start", "end", "id").agg(F.collect_set("_s").alias("lefts"))
    grouped = ways.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("end", "start", "id", "lefts"))).alias("_e"))
    found = grouped.select("segment", path(F.col("_e"), longest).alias("_p"))
    return found.select("segment", F.flatten(F.transform("_p", lambda x: _ids(x["i"], F.substring(F.col("segment"), x["s"] + 1, F.lit(1)), pieces))).alias("ids"))


def encode_segments(segments: DataFrame, pieces: Pieces) -> DataFrame:
    """The columns of segments and ids; its rows must be distinct in segment, and cheap to read again."""
    own, normal = segments.columns, pieces.normal()
    tasks = -(-segments.count() // TASK) or 1
    longest, lowest = max(len(t) for t, _, _ in normal), min(s for _, _, s in normal)
    table = pieces.table(segments.sparkSession)
    if pieces.fold == "viterbi":
        grouped = edges(segments.repartition(tasks, "segment"), table, longest, lowest).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("end", "start", "id", "score"))).alias("_e"))
        paths = grouped.select(*own, viterbi(F.col("_e"), longest).alias("_p"))
        return paths.select(*own, F.flatten(F.transform("_p", lambda x: _ids(x["i"], F.substring(F.col("segment"), x["s"] + 1, F.lit(1)), pieces))).alias("ids"))
    # Dealt by segment before they are exploded, segments are grouped again without a shuffle of their edges.
    short = segments.filter(F.length("segment") <= BITS).repartition(tasks, "segment")
    found = _merge_short(edges(short, table, longest, lowest), own, pieces).select(*own, "ids")
    long = checkpointed(segments.filter(F.length("segment") > BITS))
    if not long.head(1):
        return found
    return found.unionByName(_merge_long(long.select("segment"), pieces, table, longest, lowest).join(long, "segment").select(*own, "ids"))


class Answers:
    """Segments' ids by the segments' hashes; the places of segments are in the order of how frequent they are."""

    def __init__(self, segments: pa.Array, ids: pa.ListArray, n: np.ndarray | None = None):
        h = _segment_hashes(segments.to_pylist())
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, self.ids = np.cumsum(sizes) - sizes, pc.list_flatten(ids).to_numpy(zero_copy_only=False)
        order = np.lexsort((h, -n)) if n is not None else np.arange(len(h))
        self.begin, self.size = begin[order], sizes[order].astype(np.int32)
        self.h, first = np.unique(h[order], return_index=True)
        self.place = first.astype(np.int32)

    @classmethod
    def of(cls, table: pa.Table) -> Answers:
        segments, ids = (table.column(c).combine_chunks() for c in ("segment", "ids"))
        return cls(segments, ids, table.column("n").to_numpy())

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't known."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.place[at], -1)

    def lay(self, out: np.ndarray, to: np.ndarray, at: np.ndarray) -> None:
        """Write the ids of the segments at the places at into out, each from its place in to on."""
        n = self.size[at]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = self.ids[np.repeat(self.begin[at], n) + step]


def written_short(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each number ends): seven bits a byte, the lowest first, the eighth set where more follow."""
    n = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21) + (v >= 1 << 28)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(n.max()) if len(n) else 0):
        on = np.flatnonzero(n > k)
        out[(ends - n)[on] + k] = ((v[on] >> (7 * k)) & 127) | ((n[on] > k + 1) << 7)
    return out, ends


def read_short(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each ends)."""
    ends = np.flatnonzero(b < 128) + 1
    begins = np.append(0, ends)[: len(ends)]
    v, n = np.zeros(len(ends), dtype=np.int64), ends - begins
    for k in range(int(n.max()) if len(n) else 0):
        on = np.flatnonzero(n > k)
        v[on] |= (b[begins[on] + k].astype(np.int64) & 127) << (7 * k)
    return v, ends


def _slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """data from each bound to the next, as binary."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _pack(cutter: Cutter, frequent):
    """_id, _k, sha and the segments of each text: places (one more than in the broadcast table, 0 for a gap), rare, the
    segments that stand in gaps, each once, and for each gap which of them it is."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Answers = frequent.value
        for batch in it:
            for lo, hi, texts in _parts(batch):
                cut = Cut(cutter, texts)
                at = known.find(cut.h) + 1
                data, ends = written_short(at)
                gaps = np.flatnonzero(at == 0)
                _, one = np.unique(np.stack([cut.doc[gaps].astype(U), cut.h[gaps]]), axis=1, return_index=True) if len(gaps) else (None, gaps)
                rare = np.sort(gaps[one])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, cut.first).astype(np.int32)), pa.array(cut.strings(rare), pa.string()))
                order = np.lexsort((cut.h[rare], cut.doc[rare]))
                key = lambda at: np.stack([cut.doc[at].astype(U), cut.h[at]], axis=1).view([("d", U), ("h", U)]).ravel()
                which = order[np.searchsorted(key(rare)[order], key(gaps))] - np.searchsorted(rare, cut.first)[cut.doc[gaps]] if len(gaps) else gaps
                gap_data, gap_ends = written_short(which)
                sha = [hashlib.sha256((t or "").replace(SPACE, " ").encode()).digest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("_id", "_k")]
                    + [pa.array(sha, pa.binary()), _slices(data, np.append(0, ends)[cut.first]), _slices(gap_data, np.append(0, gap_ends)[np.searchsorted(gaps, cut.first)]), lists],
                    names=["_id", "_k", "sha", "places", "gaps", "rare"],
                )
        give_back()

    return run


def _asked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_k, segment: the segments that each text asks for. It takes all columns, so that the shuffle before it is the one before the join."""
    for batch in it:
        rare = batch.column("rare")
        keys = batch.column("_k").take(pc.list_parent_indices(rare))
        yield pa.RecordBatch.from_arrays([keys, pc.list_flatten(rare)], names=["_k", "segment"])


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all values of a binary column, where each value begins and one past the last)."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, values), dtype=np.int64, count=len(values))))


def _fill(frequent, decoded: list[bytes] | None):
    """_id, n_tokens, token_ids, sha; with decoded also whether the decoded ids give the text of that digest."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Answers = frequent.value
        for batch in it:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                rare = pc.list_flatten(part.column("_rare"))
                own = Answers(*(pc.struct_field(rare, c) for c in ("segment", "ids")))
                data, bounds = _joined(part.column("places"))
                at, ends = read_short(data)
                at -= 1
                here, gaps = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                which, _ = read_short(_joined(part.column("gaps"))[0])
                doc = np.searchsorted(bounds, ends[gaps] - 1, side="right") - 1
                asked = part.column("rare")
                first = np.append(0, np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False)))
                to = own.find(_segment_hashes(pc.list_flatten(asked).to_pylist())[first[doc] + which])
                if (to < 0).any():
                    raise ValueError("a segment has no answer")
                n = np.zeros(len(at), dtype=np.int64)
                n[here], n[gaps] = known.size[at[here]], own.size[to]
                begin = np.append(0, np.cumsum(n))
                out = np.zeros(int(begin[-1]), dtype=np.int32)
                known.lay(out, begin[here], at[here])
                own.lay(out, begin[gaps], to)
                where = begin[np.searchsorted(ends, bounds, side="right")]
                cols = [part.column("_id"), pa.array(np.diff(where)), pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(out)), part.column("sha")]
                names = ["_id", "n_tokens", "token_ids", "sha"]
                if decoded:
                    flat, cuts = out.tolist(), where.tolist()
                    equal = [hashlib.sha256(_decoded(flat[a:b], decoded)).digest() == sha for a, b, sha in zip(cuts[:-1], cuts[1:], part.column("sha").to_pylist(), strict=True)]
                    cols, names = [*cols, pa.array(equal, pa.bool_())], [*names, "ok"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    return run


def _decoded(ids: list[int], table: list[bytes]) -> bytes:
    """The bytes of the text, without the space that was put in front."""
    return b"".join(map(table.__getitem__, ids))[1:]


def _split(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The most frequent rows of answers (segment, n, ids), CACHE_BYTES at most, and the others: whole classes of frequency, from the
    highest on. There are a few hundred classes, so nothing has to be sorted."""
    kind = F.floor(F.log2("n") * 16)
    left, least = CACHE_BYTES, None
    short = F.length("segment") <= BITS
    for r in sorted(answers.filter(short).groupBy(kind.alias("kind")).agg(F.sum(F.octet_length("segment") + 4 * F.size("ids") + 24).alias("size")).collect(), key=lambda r: -r["kind"]):
        left -= r["size"]
        if left < 0:
            break
        least = r["kind"]
    chosen = short & (kind >= least) if least is not None else F.lit(False)
    return answers.filter(chosen), answers.filter(~chosen)


def _encoded(df: DataFrame, id_col: str, text_col: str, pieces: Pieces, check: bool) -> DataFrame:
    spark = df.sparkSession
    # Texts that share a key share answers, which are right for any of them.
    key = F.xxhash64(F.col(id_col).cast("long"), text_col, F.spark_partition_id())
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), key.alias("_k"))
    cutter = Cutter(pieces)
    counted = texts.select("_text").mapInArrow(_count(cutter), "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    counted, at = written(counted, "segments")
    answers, _ = written(encode_segments(counted, pieces), "answers")
    drop_scratch(spark, at)
    release(spark)
    common, others = _split(answers)
    frequent = spark.sparkContext.broadcast(Answers.of(common.select("segment", "ids", "n").toArrow()))
    packed = texts.mapInArrow(_pack(cutter, frequent), "_id long, _k long, sha binary, places binary, gaps binary, rare array<string>").repartition("_k")
    asked = packed.mapInArrow(_asked, "_k long, segment string")
    found = asked.join(others.select("segment", "ids"), "segment").groupBy("_k").agg(F.collect_list(F.struct("segment", "ids")).alias("_rare"))
    none = F.array().cast("array<struct<segment:string,ids:array<int>>>")
    whole = packed.join(found, "_k", "left").select("_id", "_k", "rare", "sha", "places", "gaps", F.coalesce("_rare", none).alias("_rare"))
    return whole.mapInArrow(_fill(frequent, pieces.as_bytes() if check else None), "_id long, n_tokens long, token_ids array<int>, sha binary" + ", ok boolean" * check)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: Pieces | None = None) -> DataFrame:
    """id, n_tokens, token_ids for each row."""
    return _encoded(df, id_col, text_col, pieces or Pieces.load(), False).select(F.col("_id").alias(id_col), "n_tokens", "token_ids")


def decode(df: DataFrame, ids_col: str = "token_ids", pieces: Pieces | None = None) -> DataFrame:
    """df with decoded_text, what its ids stand for; null ids give null."""
    table = (pieces or Pieces.load()).as_bytes()

    @F.pandas_udf("string")
    def run(ids):
        return ids.map(lambda x: None if x is None else _decoded(list(x), table).decode("utf-8", "replace"))

    return df.withColumn("decoded_text", run(F.col(ids_col)))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: Pieces | None = None) -> DataFrame:
    """id, n_tokens, token_ids, text_sha256 (of the text with U+2581 as a space), decoded_equal: whether decoding the ids gives that text."""
    out = _encoded(df, id_col, text_col, pieces or Pieces.load(), True)
    return out.select(F.col("_id").alias(id_col), "n_tokens", "token_ids", F.lower(F.hex("sha")).alias("text_sha256"), F.col("ok").alias("decoded_equal"))
