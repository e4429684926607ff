"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The second sum gives all pairwise interactions <v_i, v_j> x_i x_j in time linear in the active
features (Rendle 2010). Features are binary: each distinct word of the whole text and its stems (hashed), one
bin per structure statistic, and the language and source of the document.

Training takes at most ``train_rows`` labelled documents, those whose ids hash lowest, in one task of
the cluster; scoring is one pass over the documents without a shuffle.

Defined cases: a null or empty text has structure and metadata features only; null metadata is a
value of its own; repeated rows are scored alike; label rows of one document are merged (worst
quality, most toxic; a null quality counts as good, a null toxic as not toxic), null ids are ignored;
with no labelled rows, or only one class, the model is constant and keeps everything unless all labels are bad. Extra columns
pass through ``keep`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

#: Features below this index are bins of structure statistics.
WORDS_FROM = 256
#: Lengths of the stems that longer words share, whatever their endings.
STEMS = (4, 5, 6)
_CLASS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "mark": [ord(c) for c in "#$%&*|!<>{}[]\\^~=+@_"],
    "stop": [ord(c) for c in ".,;:?'\"()-"],
    "line": [10],
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 18
    factors: int = 8
    train_rows: int = 20_000
    epochs: int = 30
    batch: int = 256
    rate: float = 0.2
    l2: float = 1e-5
    min_docs: int = 4
    min_chi2: float = 10.0
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray
    threshold: float

    def raw(self, row: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents from their active features, sorted by document."""
        out = np.full(n, self.bias)
        if len(idx):
            out += np.bincount(row, self.w[idx], n)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            v = self.v[idx]
            s = np.add.reduceat(v, first, axis=0)
            q = np.add.reduceat(v * v, first, axis=0)
            out[row[first]] += 0.5 * (s * s - q).sum(1)
        return out


def _bins(data: np.ndarray, offs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A bin of 16 for each structure statistic of each text."""
    size = np.diff(offs)
    n = np.maximum(size, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[offs[1:]] - c[offs[:-1]]

    def log_share(x: np.ndarray) -> np.ndarray:
        return np.where(x == 0, 0, np.clip(np.floor(np.log2(np.maximum(x, 1) / n)) + 13, 1, 15)).astype(int)

    stats = [log_share(count(_TABLES[k][data])) for k in _TABLES]
    stats.append(log_share(count(data >= 128)))
    stats.append(np.clip(np.log2(size + 1), 0, 15).astype(int))
    stats.append(np.clip(2 * np.log2(n / np.maximum(words, 1)), 0, 15).astype(int))
    return np.stack(stats, 1)


def features(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, feature) by blocks of the batch; distinct and sorted by row."""
    meta = [_codes(batch, name, buckets) for name in ("lang", "source")]
    for first, data, offs in _text.blocks(batch.column("text")):
        n = len(offs) - 1
        start, end, row = _text.spans(data, offs)
        stems = [np.flatnonzero(end - start > n_) for n_ in STEMS]
        h = _text.hashes(data, np.concatenate([start, *(start[x] for x in stems)]), np.concatenate([end, *(start[x] + n_ for x, n_ in zip(stems, STEMS))]))
        h[len(start) :] = _text.mix(h[len(start) :] + np.uint64(1))  # a stem isn't the word that is spelt alike
        word = (h % np.uint64(buckets - WORDS_FROM)).astype(np.int64) + WORDS_FROM
        of = np.concatenate([row, *(row[x] for x in stems)])
        bins = _bins(data, offs, np.bincount(row, minlength=n))
        rows = np.arange(n)
        keys = [of * buckets + word]
        keys += [rows * buckets + 16 * k + bins[:, k] for k in range(bins.shape[1])]
        keys += [rows * buckets + m[first : first + n] for m in meta]
        key = np.unique(np.concatenate(keys))
        yield first, n, key // buckets, key % buckets


def _codes(batch: pa.RecordBatch, name: str, buckets: int) -> np.ndarray:
    """Hashed feature of a metadata column; a missing column is a column of nulls."""
    if name not in batch.schema.names:
        return np.full(batch.num_rows, crc32(f"{name}?".encode()) % (buckets - WORDS_FROM) + WORDS_FROM)
    coded = batch.column(name).cast(pa.string()).dictionary_encode(null_encoding="encode")
    of = np.array([crc32(f"{name}{'?' if x is None else '=' + x}".encode()) % (buckets - WORDS_FROM) + WORDS_FROM for x in coded.dictionary.to_pylist()], np.int64)
    return of[coded.indices.to_numpy(zero_copy_only=False)] if len(of) else np.zeros(0, np.int64)


def screened(row_ptr: np.ndarray, idx: np.ndarray, y: np.ndarray, p: Params) -> np.ndarray:
    """Features whose presence depends on the label by a chi-squared test with continuity correction; words by chance would only be learned by heart."""
    n, good = len(y), y.sum()
    with_good = np.bincount(idx, np.repeat(y, np.diff(row_ptr)), p.buckets)
    df = np.bincount(idx, minlength=p.buckets)
    a, b = with_good, df - with_good
    off = np.maximum(np.abs(a * (n - good) - b * good) - n / 2, 0)
    chi2 = n * off**2 / np.maximum(good * (n - good) * df * (n - df), 1)
    return (df >= p.min_docs) & (chi2 >= p.min_chi2)


def train(row_ptr: np.ndarray, idx: np.ndarray, y: np.ndarray, p: Params) -> Model:
    """Logistic loss by AdaGrad over mini-batches. ``idx[row_ptr[i]:row_ptr[i+1]]`` are the features of document i."""
    w = np.zeros(p.buckets, np.float32)
    v = np.zeros((p.buckets, p.factors), np.float32)
    n = len(y)
    good = float(y.sum())
    if not n or good in (0.0, n):
        return Model(-10.0 if n and not good else 10.0, w, v, p.threshold)
    live = (screened(row_ptr, idx, y, p) | (np.arange(p.buckets) < WORDS_FROM))[idx]
    row = np.repeat(np.arange(n), np.diff(row_ptr))[live]
    idx = idx[live]
    ptr = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.Generator(np.random.PCG64(7))
    used = np.unique(idx)
    v[used] = rng.normal(0, 0.01, (len(used), p.factors))
    gw, gv, gb, bias = np.full(p.buckets, 1e-6, np.float32), np.full((p.buckets, p.factors), 1e-6, np.float32), 1e-6, 0.0
    for _ in range(p.epochs):
        order = rng.permutation(n)
        for at in range(0, n, p.batch):
            docs = order[at : at + p.batch]
            sizes = ptr[docs + 1] - ptr[docs]
            pos = np.repeat(ptr[docs] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            f, r = idx[pos], np.repeat(np.arange(len(docs)), sizes)
            u, inv = np.unique(f, return_inverse=True)
            vf = v[f]
            s = np.zeros((len(docs), p.factors), np.float32)
            has = np.flatnonzero(sizes)
            s[has] = np.add.reduceat(vf, (np.cumsum(sizes) - sizes)[has], axis=0)
            q = np.bincount(r, (vf * vf).sum(1), len(docs))
            z = bias + np.bincount(r, w[f], len(docs)) + 0.5 * ((s * s).sum(1) - q)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) / len(docs)
            gr = g[r]
            dw = np.bincount(inv, gr, len(u)).astype(np.float32) + p.l2 * w[u]
            by = np.argsort(inv, kind="stable")
            dv = np.add.reduceat((gr[:, None] * (s[r] - vf))[by], np.flatnonzero(np.diff(inv[by], prepend=-1)), axis=0).astype(np.float32) + p.l2 * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            w[u] -= p.rate * dw / np.sqrt(gw[u])
            v[u] -= 0.1 * p.rate * dv / np.sqrt(gv[u])
            gb += g.sum() ** 2
            bias -= p.rate * g.sum() / np.sqrt(gb)
    return Model(float(bias), w, v, p.threshold)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """A model of ``labels`` (doc_id, quality, toxic): good is quality 1 and toxic 0."""
    good = (F.min(F.coalesce("quality", F.lit(1))) > 0) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(good.cast("int").alias("__cc_good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.train_rows)
    meta = [c for c in ("lang", "source") if c in docs.columns]
    texts = docs.select("doc_id", "text", *meta).join(F.broadcast(sample), "doc_id")  # the sample is bounded by train_rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, ids = b.column("__cc_good").to_numpy(), b.column("doc_id").to_numpy()
            for first, n, row, idx in features(b, p.buckets):
                ptr = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + n]), pa.array(y[first : first + n], pa.int32()), pa.ListArray.from_arrays(pa.array(ptr), pa.array(idx.astype(np.int32)))], ["doc_id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, xs, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for b in batches:
            y.append(b.column("y").to_numpy())
            xs.append(b.column("x").flatten().to_numpy())
            sizes.append(b.column("x").value_lengths().to_numpy())
        m = train(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(xs), np.concatenate(y).astype(float), p)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.w.tobytes()], pa.binary()), pa.array([m.v.tobytes()], pa.binary())], ["bias", "w", "v"])

    rows = texts.mapInArrow(extract, "doc_id long, y int, x array<int>")
    # One task trains, on rows in one order whatever ran before it.
    one = rows.repartition(1).sortWithinPartitions("doc_id", F.xxhash64("x")).mapInArrow(learn, "bias double, w binary, v binary").first()
    if one is None:  # no rows, no task
        return train(np.zeros(1, int), np.zeros(0, int), np.zeros(0), p)
    return Model(one.bias, np.frombuffer(bytes(one.w), np.float32), np.frombuffer(bytes(one.v), np.float32).reshape(p.buckets, p.factors), p.threshold)


def _probability(b: pa.RecordBatch, model: Model) -> np.ndarray:
    out = np.zeros(b.num_rows)
    for first, n, row, idx in features(b, len(model.w)):
        out[first : first + n] = 1 / (1 + np.exp(-np.clip(model.raw(row, idx, n), -500, 500)))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability that each document is good."""
    meta = [c for c in ("lang", "source") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_probability(b, model))], ["doc_id", "score"])

    return docs.select("doc_id", "text", *meta).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_probability(b, model) >= model.threshold))

    return docs.mapInArrow(run, docs.schema)
