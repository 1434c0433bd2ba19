"""Operator 4: a quality classifier by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages of PASSAGE words each; all of its words are in one. A passage is described by the frequencies of its
hashed byte trigrams (across word ends, so in any script), those of its single bytes, and how its words repeat; the learned encoder
turns that into h, gated attention gives each passage a weight

    a = softmax over the document of w . (tanh(V h) * sigmoid(U h))

and the score is the sigmoid of a linear map of the weighted sum of the h. Only the document's label is learned from. Scores depend
on the text alone.

Training takes a bounded sample of labelled rows: of those labelled 1 and of those labelled 0 the TRAIN_DOCS each with the smallest
hash of their id, and of these the first, in the order of the hash, that hold TRAIN_PASSAGES passages together, at least one of each
label. All passages of a document in the sample are trained on, in one task. Everything else runs over all rows; a document's passages are
folded as they are read, so a long document costs its own text and no more.

Defined results: null and empty texts are one passage without words and get a score like any other; rows that share an id are
scored one by one; a document with several labels counts as 1 if their mean is 0.5 or more, null labels are left out; with no
labels of one kind at all every score is the share of label 1 (0.5 without labels); other columns are never read and may have any names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names
from .wordhash import Family, Texts, chunks, give_back

PASSAGE = 64
TRAIN_DOCS = 1500
TRAIN_PASSAGES = 12_000
HIDDEN, GATE = 24, 12
FEW = 4
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.01, 1e-3
#: Bytes are counted one by one up to 0x7F; the others are one class. What tells scripts and languages apart are the trigrams.
CLASSES, TRIGRAMS = 129, 1024
FEATURES = TRIGRAMS + CLASSES + 5
_H = Family(41)


def passages(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(first passage of each text and one past the last, a row of FEATURES for each passage); a text without words has one."""
    n = np.diff(t.first)
    per = np.maximum(1, -(-n // PASSAGE))
    begin = np.concatenate(([0], np.cumsum(per)))
    total = int(begin[-1])
    words = len(t.starts)
    of_word = begin[t.doc] + (np.arange(words) - t.first[t.doc]) // PASSAGE
    size = t.ends - t.starts
    inside = np.repeat(of_word, size)
    at = np.repeat(t.starts - np.concatenate(([0], np.cumsum(size)[:-1])) if words else t.starts, size) + np.arange(len(inside))
    kind = np.minimum(t.bytes[at].astype(np.int64), CLASSES - 1)
    counts = np.bincount(inside * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    # A text's bytes stand between spaces in the buffer, so there is a byte on either side of each.
    b = t.bytes.astype(np.uint32)
    gram = ((b[at - 1] << 16 | b[at] << 8 | b[at + 1]) * np.uint32(0x9E3779B1)) >> np.uint32(22)
    grams = np.bincount(inside * TRIGRAMS + gram, minlength=total * TRIGRAMS).reshape(total, TRIGRAMS)
    x = np.zeros((total, FEATURES), dtype=np.float32)
    n_bytes = counts.sum(axis=1)
    some_bytes = np.maximum(1, n_bytes)[:, None]
    x[:, :TRIGRAMS], x[:, TRIGRAMS : TRIGRAMS + CLASSES] = grams / some_bytes, counts / some_bytes
    n_in = np.bincount(of_word, minlength=total)
    some, tail = np.maximum(1, n_in), TRIGRAMS + CLASSES
    if words:
        h = _H.words(t)
        order = np.lexsort((h, of_word))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1]))
        x[:, tail] = np.bincount(of_word[order][new], minlength=total) / some
        echo = np.append(False, (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1]))
        x[:, tail + 1] = np.bincount(of_word[echo], minlength=total) / some
        x[:, tail + 2] = np.bincount(of_word[size == 1], minlength=total) / some
        x[:, tail + 3] = n_bytes / some / 16
    x[:, tail + 4] = n_in / PASSAGE
    return begin, x


class Model:
    """The parameters, the scores they give and their gradient."""

    SHAPES = {"E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, (s[0] if s else 1) ** -0.5, s) if len(s) > 1 else np.zeros(s) for k, s in self.SHAPES.items()}
        self.p["w"] = rng.normal(0, 0.3, GATE)
        self.p["c"] = rng.normal(0, 0.3, HIDDEN)
        self.mean, self.scale = np.zeros(FEATURES, dtype=np.float32), np.ones(FEATURES, dtype=np.float32)

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        """begin: the first row of each bag; none may be empty."""
        p = self.p
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        # The last column tells a passage's words; frequencies over a few words say little and are drawn to the mean.
        n = x[:, -1:] * PASSAGE
        z[:, :-1] *= n / (n + FEW)
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
        a = np.exp(s - np.maximum.reduceat(s, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        m = np.add.reduceat(a[:, None] * h, begin, axis=0)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return z, h, t, g, bag, a, m, y

    def scores(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.forward(x, begin)[-1]

    def gradient(self, x: np.ndarray, begin: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        p = self.p
        z, h, t, g, bag, a, m, y = self.forward(x, begin)
        dl = (y - label) / len(label)
        dm = dl[:, None] * p["c"]
        da = (h * dm[bag]).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, begin)[bag])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dm[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": z.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": m.T @ dl, "d": dl.sum()}

    def fit(self, bags: list[np.ndarray], label: np.ndarray, seed: int = 8) -> None:
        """Adam over batches of bags, in an order that the seed fixes."""
        rng = np.random.default_rng(seed)
        n = sum(map(len, bags))
        self.mean = (sum(b.sum(axis=0, dtype=float) for b in bags) / n).astype(np.float32)
        square = sum(((b - self.mean) ** 2).sum(axis=0, dtype=float) for b in bags) / n
        self.scale = (np.sqrt(square) + 1e-2).astype(np.float32)
        one, two = ({k: np.zeros(s) for k, s in self.SHAPES.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                begin = np.concatenate(([0], np.cumsum([len(bags[j]) for j in part])[:-1]))
                step += 1
                for k, d in self.gradient(np.concatenate([bags[j] for j in part]), begin, label[part]).items():
                    d = d + DECAY * self.p[k]
                    one[k] = 0.9 * one[k] + 0.1 * d
                    two[k] = 0.999 * two[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)


def _encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bags of the training sample, in half precision."""
    for batch in it:
        for lo, hi, part in chunks(batch.column("_text").to_pylist()):
            begin, x = passages(Texts(part))
            bags = [x[a:b].astype(np.float16).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            rest = [batch.column(c).slice(lo, hi - lo) for c in ("_id", "_y", "_h")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(begin)), pa.array(bags, pa.binary())], names=["_id", "_y", "_h", "n", "bag"])


def _fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parameters that the bags of all batches give, in the order of their ids."""
    rows = pa.Table.from_batches(list(it)).sort_by("_id")
    model = Model()
    model.fit([np.frombuffer(b.as_buffer(), dtype=np.float16).reshape(-1, FEATURES) for b in rows.column("bag")], rows.column("_y").to_numpy().astype(float))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.p, model.mean, model.scale))], pa.binary())], names=["model"])
    del rows
    give_back()


def _score(model: Model, text: str, name: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for _, _, part in chunks(batch.column(text).to_pylist()):
                begin, x = passages(Texts(part))
                out.append(model.scores(x, begin[:-1]))
            back = batch if whole else batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*back.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*back.schema.names, name])

    return run


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, label_col: str, n: int = TRAIN_DOCS) -> DataFrame:
    """_id, _y, _h: the sample's ids, labels and hashes, 2 n rows at most; held-out ids never enter."""
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_id is not null and _y is not null").filter(~held_out(F.col("_id")))
    one = y.groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y")).withColumn("_h", F.xxhash64("_id"))
    ids = one.join(df.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    take = lambda v: ids.filter(F.col("_y") == v).orderBy("_h", "_id").limit(n)
    return take(0).union(take(1)).select("_id", "_y", "_h")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    sample = checkpointed(training_rows(df, labels, id_col, label_col))
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # 2 * TRAIN_DOCS rows at most: broadcast within that bound. Rows that share an id give a bag each, of which the first is used.
    chosen = texts.join(F.broadcast(sample), "_id").mapInArrow(_encode, "_id long, _y int, _h long, n long, bag binary")
    bags = checkpointed(chosen.groupBy("_id", "_y", "_h").agg(F.min("n").alias("n"), F.min_by("bag", F.struct("n", "bag")).alias("bag")))
    sizes = sorted(bags.select("_id", "_y", "_h", "n").collect(), key=lambda r: (r["_h"], r["_id"]))
    taken, left = set(), TRAIN_PASSAGES
    for y in (0, 1):
        taken |= {r["_id"] for r in [r for r in sizes if r["_y"] == y][:1]}
    for r in sizes:
        left -= r["n"]
        if left < 0:
            break
        taken.add(r["_id"])
    label = [r["_y"] for r in sizes if r["_id"] in taken]
    model = Model()
    if 0 < sum(label) < len(label):
        # In one task, as the sample is bounded: only the parameters come to the driver.
        fitted = bags.filter(F.col("_id").isin(sorted(taken))).select("_id", "_y", "bag").coalesce(1).mapInArrow(_fit, "model binary")
        model.p, model.mean, model.scale = pickle.loads(fitted.first()["model"])
    else:
        share = float(np.clip(np.mean(label) if label else 0.5, 1e-6, 1 - 1e-6))
        model.p = {k: np.zeros(s) for k, s in Model.SHAPES.items()} | {"d": np.log(share / (1 - share))}
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_score(model, "_text", "score", False), "_id long, score double")
    return rows.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df whose score is 0.5 or more, with all their columns."""
    name = free_names(df, 1)[0]
    scored = df.mapInArrow(_score(model, text_col, name, True), f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, {name} double")
    return scored.filter(F.col(name) >= 0.5).drop(name)
