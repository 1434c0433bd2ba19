"""Operator 9: near-duplicate embeddings by product quantisation.

Vectors are scaled to length 1, in doubles. Coarse k-means centres give inverted lists; what a vector differs from its centre by is
cut into SUBSPACES parts, each coded by one of CODES codewords. There are LISTS * sqrt(n) lists for n vectors, so that
lists stay short as the input grows. Centres and codewords are fitted on the FIT_ROWS vectors of smallest hash, PER_LIST for a list
at least; every vector is indexed and every vector is a query.

A query x probes list c if x lies within a margin of the plane that parts c from x's own centre. A neighbour at the threshold's
distance d may lie d off in that direction; as directions differ, it lies off by more than SIGMAS * d / sqrt(dimension) hardly ever,
and that is the margin (all of d where the dimension is small, which loses nothing). Within a list asymmetric distances, from tables
of the query against the codewords, leave those that may lie within d of y: by the triangle inequality that is d plus y's own coding
error, which is stored with the code, so no neighbour is lost there. What is left is compared exactly, in double precision.

Long lists are cut into blocks of base rows and blocks of queries, so a hot list is as many tasks as it needs; a task holds
BASE_BLOCK + QUERY_BLOCK rows or so and gives a count per query and the components among its links, never its pairs. Equal vectors
are one vector with a multiplicity from the start.

Defined results: null, empty and zero vectors, and those with a null or non-finite component, link with nothing; vectors of
different length never link; rows that share an id are counted one by one but never link to their own id; a null id is compared as
the least long and given back as null; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components

THRESHOLD = 0.95
SIGMAS = 3.0
#: Rows that centres and codewords are fitted on, at most; rows of these for each list; lists for the root of the number of vectors.
FIT_ROWS, PER_LIST, LISTS = 65_536, 4, 2.0
SUBSPACES, CODES = 8, 256
BASE_BLOCK, QUERY_BLOCK, TILE = 2048, 4096, 256
_NULL_ID = -(1 << 63)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(axis=1)
    return np.concatenate([(square - 2 * x[lo : lo + 1024] @ centres.T).argmin(axis=1) for lo in range(0, max(1, len(x)), 1024)])


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        there, begin = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], begin, axis=0)
        centres[there] = sums / np.diff(np.append(begin, len(x)))[:, None]
    return centres


class Index:
    """Centres and codewords for vectors of one length."""

    def __init__(self, sample: np.ndarray, distance: float, n: int):
        dim = sample.shape[1]
        self.centres = k_means(sample, int(np.clip(LISTS * np.sqrt(n), 1, max(1, len(sample) // PER_LIST))), 8, 1)
        parts = min(SUBSPACES, dim)
        self.cuts = np.linspace(0, dim, parts + 1).astype(int)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.words = [k_means(rest[:, a:b], CODES, 5, 2 + i) for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]
        self.margin = distance * min(1.0, SIGMAS / np.sqrt(dim))

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of each vector to what its code stands for)."""
        rest = x - self.centres[lists]
        codes = np.zeros((len(x), len(self.words)), dtype=np.uint8)
        off = np.zeros(len(x))
        for i, (w, a, b) in enumerate(zip(self.words, self.cuts[:-1], self.cuts[1:], strict=True)):
            codes[:, i] = _nearest(rest[:, a:b], w)
            off += ((rest[:, a:b] - w[codes[:, i]]) ** 2).sum(axis=1)
        return codes, np.sqrt(off)

    def probes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each list that a row probes, its own among them."""
        rows, to = [], []
        square = (self.centres**2).sum(axis=1)
        for lo in range(0, len(x), TILE):
            tile, own = x[lo : lo + TILE], lists[lo : lo + TILE]
            d = square - 2 * tile @ self.centres.T
            gap = np.sqrt(np.maximum(0, square + square[own][:, None] - 2 * self.centres[own] @ self.centres.T))
            row, at = np.nonzero(d - d[np.arange(len(tile)), own][:, None] <= 2 * self.margin * gap + 1e-12)
            rows.append(row + lo)
            to.append(at)
        return np.concatenate(rows), np.concatenate(to)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of queries to codes of one list."""
        rest = x - self.centres[at]
        out = np.zeros((len(x), len(codes)))
        for i, (w, a, b) in enumerate(zip(self.words, self.cuts[:-1], self.cuts[1:], strict=True)):
            part = rest[:, a:b]
            table = (part**2).sum(axis=1)[:, None] - 2 * part @ w.T + (w**2).sum(axis=1)
            out += table[:, codes[:, i]]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _place(indexes: dict[int, Index], base: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the lists that a vector is in (base) or probes; a length that the sample lacks is one list, without codes."""
    names = ["dim", "list", "_k", "m", "unit", "code", "off"] if base else ["dim", "list", "_k", "unit"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x, n, index = _matrix(part.column("unit"), dim), part.num_rows, indexes.get(dim)
                own = _nearest(x, index.centres) if index else np.zeros(n, dtype=int)
                if base:
                    codes, off = index.encode(x, own) if index else (np.zeros((n, 0), dtype=np.uint8), np.zeros(n))
                    cols = [pa.array(own.astype(np.int32)), part.column("_k"), part.column("m"), part.column("unit"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)]
                else:
                    row, to = index.probes(x, own) if index else (np.arange(n), own)
                    cols = [pa.array(to.astype(np.int32)), *(part.column(c).take(pa.array(row)) for c in ("_k", "unit"))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), dim, dtype=np.int32)), *cols], names=names)

    return run


def _parts(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) over links between rows i with ids a and rows j with ids b."""
    ids, at = np.unique(np.append(a[i], b[j]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _join(indexes: dict[int, Index], threshold: float) -> Callable[[pa.Table], pa.Table]:
    distance = np.sqrt(2 - 2 * threshold)

    def run(group: pa.Table) -> pa.Table:
        dim, at = group.column("dim")[0].as_py(), group.column("list")[0].as_py()
        index = indexes.get(dim)
        is_base = group.column("m").is_valid().to_numpy()
        base, query = group.filter(pa.array(is_base)), group.filter(pa.array(~is_base))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if base.num_rows and query.num_rows:
            y, x = (_matrix(t.column("unit").combine_chunks(), dim) for t in (base, query))
            kb, kq, m = base.column("_k").to_numpy(), query.column("_k").to_numpy(), base.column("m").to_numpy()
            codes = np.frombuffer(b"".join(base.column("code").to_pylist()), dtype=np.uint8).reshape(len(y), -1)
            reach = (distance + base.column("off").to_numpy() + 1e-9) ** 2
            for lo in range(0, len(x), TILE):
                tile, ids = x[lo : lo + TILE], kq[lo : lo + TILE]
                may = index.distances(tile, at, codes) <= reach if index else np.ones((len(tile), len(y)), dtype=bool)
                i, j = np.nonzero(may)
                if len(i) > may.size // 16:
                    cosine = (tile @ y.T)[i, j]
                else:
                    cosine = np.einsum("ij,ij->i", tile[i], y[j])
                hit = (cosine >= threshold) & (ids[i] != kb[j])
                i, j = i[hit], j[hit]
                if not len(i):
                    continue
                n = np.bincount(i, weights=m[j], minlength=len(tile)).astype(np.int64)
                some = np.flatnonzero(n)
                out.append((ids[some], np.full(len(some), _NULL_ID), n[some]))
                node, least = _parts(i, j, ids, kb)
                other = node != least
                out.append((node[other], least[other], np.zeros(int(other.sum()), dtype=np.int64)))
        if not out:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        a, b, n = (np.concatenate(c) for c in zip(*out, strict=True))
        edge = n == 0
        pairs = np.unique(np.stack([a[edge], b[edge]], axis=1), axis=0)
        none = np.full(int((~edge).sum()), None)
        return pa.table({"a": pa.array(np.append(a[~edge], pairs[:, 0])), "b": pa.array([*none, *pairs[:, 1].tolist()], pa.int64()), "n": pa.array(np.append(n[~edge], np.zeros(len(pairs), dtype=np.int64)))})

    return run


def _unit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        dims, units = [], []
        for v in batch.column("_v"):
            x = np.array([np.nan if c is None else c for c in v.as_py()], dtype=np.float64) if v.is_valid else np.zeros(0)
            # The largest component is scaled out first, so that no square overflows or vanishes.
            top = np.abs(x).max() if len(x) else 0.0
            if not (np.isfinite(top) and top > 0):
                dims.append(0)
                units.append(b"")
                continue
            x = x / top
            dims.append(len(x))
            units.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["_k", "dim", "unit"])


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component_id, kept for each row."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_k"), F.col(vector_col).cast("array<double>").alias("_v"))
    units = checkpointed(rows.mapInArrow(_unit, "_k long, dim int, unit binary"))
    reps = checkpointed(units.filter("dim > 0").groupBy("dim", "unit").agg(F.min("_k").alias("_k"), F.count(F.lit(1)).alias("m")))
    # A sample of FIT_ROWS rows at most: that many vectors come to the driver, whatever the input.
    sample = reps.orderBy(F.xxhash64("_k")).limit(FIT_ROWS).select("dim", "unit").collect()
    indexes: dict[int, Index] = {}
    n = reps.count()
    for dim in sorted({r["dim"] for r in sample}):
        part = np.stack([np.frombuffer(r["unit"], dtype=np.float64) for r in sample if r["dim"] == dim])
        indexes[dim] = Index(part, float(np.sqrt(2 - 2 * threshold)), n * len(part) // len(sample))
    base = checkpointed(reps.mapInArrow(_place(indexes, True), "dim int, list int, _k long, m long, unit binary, code binary, off double"))
    query = checkpointed(reps.mapInArrow(_place(indexes, False), "dim int, list int, _k long, unit binary"))
    sizes = base.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / BASE_BLOCK).cast("int").alias("nb"))
    asked = query.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq"))
    # One row per list: FIT_ROWS / PER_LIST of them at most for the lengths of the sample, one for each other length.
    blocks = checkpointed(sizes.join(asked, ["dim", "list"]))
    cut = lambda n: F.pmod(F.xxhash64("_k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    b = base.join(blocks, ["dim", "list"]).withColumn("sb", cut("nb")).withColumn("sq", every("nq")).select("dim", "list", "sb", "sq", "_k", "unit", "m", "code", "off")
    q = query.join(blocks, ["dim", "list"]).withColumn("sq", cut("nq")).withColumn("sb", every("nb"))
    q = q.select("dim", "list", "sb", "sq", "_k", "unit", F.lit(None).cast("long").alias("m"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("off"))
    met = checkpointed(b.unionByName(q).groupBy("dim", "list", "sb", "sq").applyInArrow(_join(indexes, threshold), "a long, b long, n long"))
    counts = met.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(met.filter("b is not null"), "a", "b")
    found = reps.join(counts, reps["_k"] == counts["a"], "left").join(parts, reps["_k"] == parts["node"], "left")
    found = checkpointed(found.select("dim", "unit", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "_k").alias("_c")))
    out = units.join(found, ["dim", "unit"], "left").withColumn("_c", F.coalesce("_c", "_k"))
    given = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return out.select(given("_k").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), given("_c").alias("component_id"), (F.col("_k") == F.col("_c")).alias("kept"))
