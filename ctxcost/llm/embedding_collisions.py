"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Every vector, scaled to length one, is projected on ``PROJECTIONS`` random directions. Two vectors collide in a
projection if their values differ by no more than half a window, centred on the query; every row is a query.
At the distance that belongs to the threshold the number of collisions is binomial, so the count that a pair
must reach is the highest that keeps the target recall. Pairs that reach it are verified by their cosine.

Pairs are enumerated by sorting. A table sorts by one projection and looks at each row's window; as n grows a
table first splits rows by cells of further projections, with random offsets, so that a window stays about
``WINDOW_ROWS`` long, and the number of tables grows until a pair shares a window of some table with the target
recall. Tables are cut into slabs, the rows within a window of a slab's lower end being copied to the one before.

A pair counts in the first table that brings it together. Pairs aren't expanded: a slab returns, for each of its vectors, how
many partners it found and the least vector that it is connected with there, so the result grows with the vectors.
Equal vectors are one vector that counts as many times. A slab of more than ``SLAB_ROWS`` rows, such as one dense
group makes, is split into parts, and each two parts are compared in a task of their own.

Defined cases: a row without an id is left out; a null, empty, zero or non-finite vector, or one with a null in it, has no
partners; vectors of different lengths aren't compared; repeated rows and equal ids never pair with themselves; an id with
several vectors has the links of all of them and the least of their classes; equal vectors pair; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._store import few, written
from ._text import mix

PROJECTIONS = 32
WINDOW_ROWS = 4096
#: Rows of a slab that one task compares; a larger one is split.
SLAB_ROWS = 32_768
_STEPS = 8  # quantisation of half a window
_SLAB = 4.0  # half windows
_CELL = 6.0  # distances


def least_count(p: float, m: int, recall: float) -> int:
    """The highest count that a binomial of ``m`` trials reaches with probability ``recall``."""
    tail = 0.0
    for c in range(m, -1, -1):
        tail += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if tail >= recall:
            return c
    return 0


class Plan:
    """Tables, cells and counts for ``n`` vectors at a cosine threshold; ``kind`` is the type of their numbers."""

    def __init__(self, n: int, threshold: float, recall: float, kind: str = "f8"):
        self.kind = kind
        self.radius = math.sqrt(max(2 - 2 * threshold, 1e-6))
        self.half = self.radius
        near = math.erf(1 / math.sqrt(2))  # of colliding in a projection, at the radius
        each = 1 - (1 - recall) / 2  # both the windows and the count may lose a pair
        self.count = least_count(near, PROJECTIONS, each)
        far = math.erf(self.half / 2)  # unrelated vectors are sqrt(2) apart
        width = _CELL * self.radius
        same = min(0.9, width / math.sqrt(4 * math.pi))  # of unrelated vectors in one cell
        self.cells = max(0, math.ceil(math.log(max(1.0, n * far / WINDOW_ROWS)) / -math.log(same)))
        stays = 1 - math.sqrt(2 / math.pi) / _CELL
        self.tables = max(1, math.ceil(math.log(1 - each) / math.log(1 - near * stays**self.cells)))
        self.threshold = threshold


def _directions(dim: int, cells: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions of the counted projections, of the tables' cells, and offsets of these in cell widths."""
    rng = np.random.Generator(np.random.PCG64(dim))
    count = rng.normal(size=(PROJECTIONS, dim))
    cell = np.random.Generator(np.random.PCG64([dim, 1])).normal(size=(tables, cells, dim))
    return count, cell, np.random.Generator(np.random.PCG64([dim, 2])).random((tables, cells))


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, how often each counts, vectors as they are, unit vectors) of the usable rows, by length."""
    col = b.column("embedding")
    sizes = np.where(col.is_valid().to_numpy(zero_copy_only=False), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        raw = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        x = raw.astype(np.float64)
        most = np.abs(x).max(1)
        use = np.isfinite(most) & (most > 0)
        raw, x = raw[use], x[use] / most[use, None]
        at = pa.array(at[use])
        yield b.column("id").take(at).to_numpy(), b.column("n").take(at).to_numpy(), raw, x / np.sqrt((x * x).sum(1))[:, None]


def _keys(v: np.ndarray, p: Plan, t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, value that is sorted by) of each unit vector in table ``t``; x are its projections."""
    _, cell, offset = _directions(v.shape[1], p.cells, p.tables)
    key = mix(np.full(len(v), v.shape[1] * 1_000_003 + t, np.uint64))
    for c in range(p.cells):
        key = mix(key + np.floor(v @ cell[t, c] / (_CELL * p.radius) + offset[t, c]).astype(np.int64).view(np.uint64))
    return key, x[:, t % PROJECTIONS]


def _slabs(v: np.ndarray, x: np.ndarray, p: Plan) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(table, own, rows, their slabs, their sorted values): each vector's slab and the one before if it is near its lower end."""
    slab = _SLAB * p.half
    for t in range(p.tables):
        key, sort = _keys(v, p, t, x)
        of = np.floor(sort / slab).astype(np.int64)
        for own, at in ((True, np.arange(len(v))), (False, np.flatnonzero(sort - of * slab <= p.half))):
            yield t, own, at, mix(key[at] * np.uint64(31) + (of[at] - (not own)).view(np.uint64)).view(np.int64), sort[at]


def _sizes(batches: Iterator[pa.RecordBatch], p: Plan) -> Iterator[pa.RecordBatch]:
    """(d, slab, rows) of a batch's slabs."""
    for b in batches:
        for _, _, _, v in _vectors(b):
            x = v @ _directions(v.shape[1], p.cells, p.tables)[0].T
            slab, n = np.unique(np.concatenate([k for _, _, _, k, _ in _slabs(v, x, p)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(v.shape[1], pa.int32()), len(slab)), pa.array(slab), pa.array(n)], ["d", "slab", "rows"])


def _spread(batches: Iterator[pa.RecordBatch], p: Plan) -> Iterator[pa.RecordBatch]:
    """(d, slab, t, own, x, id, n, q, v): each vector in its slabs."""
    for b in batches:
        for ids, n, raw, v in _vectors(b):
            x = v @ _directions(v.shape[1], p.cells, p.tables)[0].T
            q = np.floor(x / p.half * _STEPS + 0.5).astype(np.int64).astype(np.uint8)
            qs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PROJECTIONS), len(q), [None, pa.py_buffer(np.ascontiguousarray(q))]).cast(pa.binary())
            raw = np.ascontiguousarray(raw, p.kind)
            vs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.itemsize * v.shape[1]), len(v), [None, pa.py_buffer(raw)]).cast(pa.binary())
            for t, own, at, slab, sort in _slabs(v, x, p):
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(v.shape[1], pa.int32()), len(at)), pa.array(slab), pa.repeat(pa.scalar(t, pa.int32()), len(at)), pa.repeat(own, len(at)), pa.array(sort), pa.array(ids[at]), pa.array(n[at]), qs.take(rows), vs.take(rows)],
                    ["d", "slab", "t", "own", "x", "id", "n", "q", "v"],
                )


def _close(group: pa.Table, p: Plan) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(ids, how often each counts, pairs of rows) of a slab: window by window, by collisions, then by cosine."""
    group = group.combine_chunks()
    x, own, ids, n, part = (group.column(c).to_numpy() for c in ("x", "own", "id", "n", "part"))
    raw = group.column("v").to_pylist()
    by = sorted(range(len(x)), key=lambda i: (x[i], ids[i], raw[i]))
    # Rows that repeat each other are one.
    by = np.array([i for k, i in enumerate(by) if not k or ids[i] != ids[by[k - 1]] or raw[i] != raw[by[k - 1]]])
    x, own, ids, n, part = x[by], own[by], ids[by], n[by], part[by]
    q = np.frombuffer(b"".join(group.column("q").to_pylist()), np.uint8).reshape(-1, PROJECTIONS)[by]
    v = np.frombuffer(b"".join(raw[i] for i in by), p.kind).astype(np.float64).reshape(len(x), -1)
    v /= np.abs(v).max(1)[:, None]
    v /= np.sqrt((v * v).sum(1))[:, None]
    t = group.column("t")[0].as_py()
    cross = bool((part != part[0]).any())
    columns = np.ascontiguousarray(q.T)
    shifted = columns + np.uint8(_STEPS)
    before = [_keys(v, p, s, v @ _directions(v.shape[1], p.cells, p.tables)[0].T) for s in range(t)]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = 128
        for i in range(0, len(x), step):
            j = min(i + step, len(x))
            end = int(np.searchsorted(x, x[j - 1] + p.half, "right"))
            for k in range(i, end, 8192):
                m = min(k + 8192, end)
                hits = np.zeros((j - i, m - k), np.uint8)
                for c in range(PROJECTIONS):
                    hits += (shifted[c, i:j, None] - columns[c, None, k:m]) <= 2 * _STEPS
                r, s = np.nonzero(hits >= p.count)
                r, s = r + i, s + k
                use = (s > r) & own[r] & (x[s] - x[r] <= p.half) & (ids[r] != ids[s])
                if cross:
                    use &= part[r] != part[s]
                r, s = r[use], s[use]
                for at in range(0, len(r), 1 << 16):
                    u, w = r[at : at + (1 << 16)], s[at : at + (1 << 16)]
                    near = (v[u] * v[w]).sum(1) >= p.threshold
                    for key, sort in before:  # found in an earlier table already
                        near &= (key[u] != key[w]) | (np.abs(sort[u] - sort[w]) > p.half)
                    yield u[near], w[near]

    return ids, n, pairs()


def _linked(group: pa.Table, p: Plan) -> pa.Table:
    """(id, root, links) of the vectors of a slab that have partners in it."""
    ids, n, pairs = _close(group, p)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for u, w in pairs:
        links += np.bincount(u, n[w], len(ids)).astype(np.int64) + np.bincount(w, n[u], len(ids)).astype(np.int64)
        while len(u):
            low = np.minimum(root[u], root[w])
            if (low == root[u]).all() and (low == root[w]).all():
                break
            for side in (u, w):
                np.minimum.at(root, root[side], low)
            while (root[root] != root).any():
                root = root[root]
    has = np.flatnonzero(links)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return pa.table({"id": ids[has], "root": least[root[has]], "links": links[has]})


def _cells(spread: DataFrame, sizes: DataFrame) -> DataFrame:
    """With the cell that a row is compared in (i, j) and the part that it is of; only rows of slabs that are too large have more than one cell."""
    k = F.ceil(F.col("rows") / SLAB_ROWS).cast("int")
    split = written(sizes.groupBy("d", "slab").agg(F.sum("rows").alias("rows")).where(F.col("rows") > SLAB_ROWS).select("d", "slab", k.alias("k")), "large-slabs")
    if split.isEmpty():
        return spread.withColumns({"part": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    parts = spread.join(few(split), ["d", "slab"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    with_ = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return with_.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("k", "other")


def _usable(embedding: str) -> Column:
    """Whether a vector has a direction."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_classes(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.98, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, class_id, links) of each id: the least id that it is connected with by cosines of at least ``threshold``, and how many ids it has such a cosine with."""
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(embedding).alias("embedding")).where("id IS NOT NULL")
    kind = "f4" if "array<float>" == rows.schema["embedding"].dataType.simpleString() else "f8"
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})
    members = written(rows.select("id", _usable("embedding").alias("usable"), "h1", "h2").distinct(), "vector-members")
    copies = written(members.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "vector-copies")
    p = Plan(members.count() - (copies.agg(F.sum(F.col("n") - 1)).first()[0] or 0), threshold, recall, kind)
    copies = few(copies)
    # One row stands for all equal vectors.
    single = rows.join(copies, ["h1", "h2"], "left").where("rep IS NULL OR id = rep").select("id", F.coalesce("n", F.lit(1)).cast("long").alias("n"), "embedding")
    spread = single.mapInArrow(lambda it: _spread(it, p), "d int, slab long, t int, own boolean, x double, id long, n long, q binary, v binary")
    sizes = single.mapInArrow(lambda it: _sizes(it, p), "d int, slab long, rows long")
    found = _cells(spread, sizes).groupBy("d", "slab", "i", "j").applyInArrow(lambda g: _linked(g, p), "id long, root long, links long")
    found = written(found, "vector-links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).join(roots, F.col("id") == F.col("node"), "left").select(F.col("id").alias("rep"), F.coalesce("root", "id").alias("root"), "links")
    # Copies take the class and the links of the vector that stands for them, and one another.
    whole = members.join(copies, ["h1", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"), (F.coalesce("n", F.lit(1)) - 1).alias("more"))
    whole = whole.join(links, "rep", "left").select("id", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("more")).alias("links"))
    return whole.groupBy("id").agg(F.min("root").alias("class_id"), F.sum("links").alias("links")).withColumnRenamed("id", id_)
