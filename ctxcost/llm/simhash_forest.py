"""SimHash near-dedup by an LSH forest.

A fingerprint has ``BITS`` bits, each the majority of a random bit over the distinct word pairs of the whole
text; with 256 of them, unrelated documents don't come within the radius by chance, however many there are. Documents are near-duplicates if their fingerprints differ in at most ``radius`` bits, and groups are
the connected components of that relation.

The forest has several tries, each over its own random order of the bits. The depth of their prefixes
follows the density: it starts where a node of evenly spread fingerprints would hold one, and climbs to
shorter prefixes until a pair at the full radius shares a node of some trie with the target probability;
while nodes at that depth would hold more than ``LEAF`` fingerprints, the forest gets more tries and
climbs again. A node that is denser than its depth promises grows a local forest in the same way. Within a
leaf all pairs are verified, so there is no cap on candidates.

Defined cases: a null or blank text has no fingerprint and no duplicates; a text of one word has that word
for its pair; rows that share a doc_id are one document and share its fate; a null doc_id has no
duplicates; of each group the least doc_id stays; empty tables give no rows; extra columns are ignored by
``duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._components import components
from ._store import BROADCAST_KEYS, without, written

BITS = 256
WORDS = BITS // 64
RADIUS = 56
LEAF = 2048
PRINT = [f"f{_i}" for _i in range(WORDS)]
_LANES = np.uint64(0x0101010101010101)
_SHIFT = np.uint64(44)
_PRINT_TYPE = ", ".join(f"{x} long" for x in PRINT)


def fingerprints_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their fingerprints as ``WORDS`` uint64)."""
    rows, prints = [np.zeros(0, np.int64)], [np.zeros((0, WORDS), np.uint64)]
    for first, data, offs in _text.blocks(column):
        start, end, row = _text.spans(data, offs)
        h = _text.hashes(data, start, end)
        g, at = _text.shingles(h, row, 2)
        single = np.flatnonzero(np.bincount(row, minlength=len(offs) - 1)[row] == 1) if len(row) else np.zeros(0, int)
        for part in _parts(np.concatenate((row[at], row[single])), np.concatenate((g, h[single]))):
            r, f = _majority(part)
            rows.append(first + r)
            prints.append(f)
    return np.concatenate(rows), np.concatenate(prints)


def _parts(row: np.ndarray, g: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """Distinct (row, hash) as one key each, in pieces of whole rows."""
    key = np.unique(row.astype(np.uint64) << _SHIFT | g >> np.uint64(20))
    at = 0
    while at < len(key):
        end = at + most
        if end < len(key):
            cut = int(np.searchsorted(key, (key[end] >> _SHIFT) << _SHIFT))
            end = cut if cut > at else int(np.searchsorted(key, ((key[at] >> _SHIFT) + np.uint64(1)) << _SHIFT))
        yield key[at:end]
        at = min(end, len(key))


def _majority(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, fingerprints): eight bits at a time are counted in the bytes of one number, 255 hashes before a byte is full."""
    row = (key >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(first, len(row)))
    hash_ = (key & np.uint64((1 << 44) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    cut = np.flatnonzero((np.arange(len(row)) - np.repeat(first, size)) % 255 == 0)
    out = np.empty((len(first), WORDS), np.uint64)
    for w in range(WORDS):
        h = _text.mix(hash_ + np.uint64(w + 1))
        lanes = np.stack([np.add.reduceat(h >> np.uint64(i) & _LANES, cut) for i in range(8)], 1)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(len(cut), 64), np.searchsorted(cut, first), axis=0, dtype=np.int64)
        out[:, w] = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64)[:, 0]
    return row[first], out


def plan(n: int, radius: int, target: float) -> tuple[int, int]:
    """(tries, depth of their prefixes) for ``n`` fingerprints."""
    dense = math.log2(max(2, n))

    def shared(depth: int) -> float:
        return math.prod((BITS - radius - i) / (BITS - i) for i in range(depth))

    tries = 4
    while True:
        depth = math.ceil(dense)
        while depth and 1 - (1 - shared(depth)) ** tries < target:
            depth -= 1
        if depth >= dense - math.log2(LEAF) or not depth and n <= LEAF:
            return (tries, depth) if depth else (1, 0)
        tries += 1


def halved(target: float) -> float:
    """The target of a level that spends half of what may be lost; the levels below it share the other half in the same way."""
    return 1 - (1 - target) / 2


def _order(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).permutation(BITS)


def prefixes(f: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` bits, at most 48, of each fingerprint in the given order."""
    out = np.zeros(len(f), np.int64)
    for b in order[:depth]:
        out = out << 1 | ((f[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64)
    return out


def _near(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j within the radius; most others differ too much in half of the bits already."""
    a, b = [], []
    step = max(1, 2_000_000 // max(1, len(f)))
    for i in range(0, len(f) - 1, step):
        x = f[i : i + step]
        d = np.bitwise_count(x[:, None, 0] ^ f[None, i:, 0]) + np.bitwise_count(x[:, None, 1] ^ f[None, i:, 1])
        p, q = np.nonzero(d <= radius)
        up = q > p
        p, q = p[up], q[up]
        rest = np.bitwise_count(f[i + p, 2:] ^ f[i + q, 2:]).sum(1, dtype=np.int64)
        in_ = d[p, q] + rest <= radius
        a.append(i + p[in_])
        b.append(i + q[in_])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least node of its component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, old[a], low)
        np.minimum.at(root, old[b], low)
        root = root[root]
        if (root == old).all():
            break
    return root


def links(f: np.ndarray, radius: int, target: float, level: int = 1) -> np.ndarray:
    """For each fingerprint of a node the first one that it is connected with there; a dense node is a forest of its own."""
    n = len(f)
    if n <= 4 * LEAF or level > 6:
        return _stars(*_near(f, radius), n)
    target = halved(target)
    tries, depth = plan(n, radius, target)
    a, b = [], []
    for t in range(tries):
        key = prefixes(f, _order(1000 * level + t), depth)
        by = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.diff(key[by], prepend=-1))
        for i, j in zip(cut, np.append(cut[1:], n)):
            if j - i > 1:
                own = by[i:j]
                r = links(f[own], radius, target, level + 1) if j - i < n else _stars(*_near(f, radius), n)
                moved = np.flatnonzero(r != np.arange(len(r)))
                a.append(own[r[moved]])
                b.append(own[moved])
    return _stars(np.concatenate(a), np.concatenate(b), n) if a else np.arange(n)


def _prints(texts: DataFrame, keys: str) -> DataFrame:
    """``keys`` (a schema) and f0, f1, … of the texts that have words."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, f = fingerprints_of(b.column("text"))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in names), *(pa.array(f[:, w].copy().view(np.int64)) for w in range(WORDS))], [*names, *PRINT])

    return texts.select(*names, F.lower("text").alias("text")).mapInArrow(run, f"{keys}, {_PRINT_TYPE}")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1, …) of the documents that have an id and words."""
    return _prints(docs.where("doc_id IS NOT NULL"), "doc_id long")


def twins(texts: DataFrame, pairs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Those of ``pairs`` (id, key, of_id, of_key) of rows of ``texts`` (id, key, text) that are near-duplicates."""
    pairs = written(pairs, "pairs")
    asked = written(pairs.select("id", "key").unionByName(pairs.select(F.col("of_id").alias("id"), F.col("of_key").alias("key"))).distinct(), "asked")
    # Beyond a few, all texts are fingerprinted where they are and fingerprints are shuffled, not texts.
    if asked.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(asked), ["id", "key"], "left_semi")
    prints = written(_prints(texts, "id long, key long").distinct(), "asked-fingerprints")
    of = prints.select(F.col("id").alias("of_id"), F.col("key").alias("of_key"), *(F.col(x).alias(f"of_{x}") for x in PRINT))
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"of_{x}"))) for x in PRINT[1:]), F.bit_count(F.col(PRINT[0]).bitwiseXOR(F.col(f"of_{PRINT[0]}"))))
    return pairs.join(prints, ["id", "key"]).join(of, ["of_id", "of_key"]).where(apart <= radius).select("id", "key", "of_id", "of_key")


def near_edges(distinct: DataFrame, radius: int, target: float) -> DataFrame:
    """(a, b): ids of ``distinct`` (id, f0, f1, …) that connect every group that the forest finds."""
    target = halved(target)  # a pair is found with the asked probability however many levels of forests it is in
    tries, depth = plan(distinct.count(), radius, target)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [_order(t) for t in range(tries)]
        for b in batches:
            f = np.stack([b.column(x).to_numpy().view(np.uint64) for x in PRINT], 1)
            for t, order in enumerate(orders):
                node = prefixes(f, order, depth) | t << 48
                yield pa.RecordBatch.from_arrays([pa.array(node), *(b.column(x) for x in ("id", *PRINT))], ["node", "id", *PRINT])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, ids, f in _nodes(batches):
            if len(ids) > 1:
                by = np.argsort(ids, kind="stable")
                ids, f = ids[by], f[by]
                root = links(f, radius, target)
                moved = np.flatnonzero(root != np.arange(len(root)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

    nodes = distinct.select("id", *PRINT).mapInArrow(grow, f"node long, id long, {_PRINT_TYPE}")
    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(connect, "a long, b long")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of each node, which follow one another, whatever batch they come in."""
    held: list[np.ndarray] = []
    for b in batches:
        rows = np.stack([b.column(x).to_numpy() for x in ("node", "id", *PRINT)], 1)
        cut = np.flatnonzero(np.diff(rows[:, 0])) + 1
        parts = np.split(rows, cut) if len(rows) else []
        for part in parts:
            if held and held[0][0, 0] != part[0, 0]:
                yield _node(held)
                held = []
            held.append(part)
    if held:
        yield _node(held)


def _node(held: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    rows = np.concatenate(held)
    return int(rows[0, 0]), rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64)


def duplicates(docs: DataFrame, radius: int = RADIUS, target: float = 0.9) -> DataFrame:
    """(doc_id, duplicate_of): each document of a group but its least doc_id, and that one."""
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy(*PRINT).agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    same = prints.join(distinct, PRINT).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    # Copies of one fingerprint hang on its least id already, so they needn't take part in the rounds.
    roots = components(near_edges(distinct, radius, target))
    near = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))
    far = same.join(roots, same["b"] == roots["node"], "left").select(F.col("a").alias("doc_id"), F.coalesce("root", "b").alias("duplicate_of"))
    return near.unionByName(far).groupBy("doc_id").agg(F.min("duplicate_of").alias("duplicate_of")).where("doc_id <> duplicate_of")


def deduplicated(docs: DataFrame, radius: int = RADIUS, target: float = 0.9) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the documents that stay."""
    return without(docs, docs["doc_id"], duplicates(docs, radius, target).select(F.col("doc_id").alias("__cc_gone")))
