"""Hierarchical multi-length packing of documents into training windows.

Documents are routed to the least of several context sizes that holds them; longer ones are cut into windows
of the largest size and a rest. From the longest tier down, a tier's own pieces are packed by best-fit
decreasing, then the gaps of its windows are filled, best fit again, with pieces of the shorter tiers, and what
is left goes to the next tier. Windows of a tier are dealt to step groups in snake order of their attention
cost (the sum of squared piece lengths), so that the groups cost about the same.

Packing needs only the number of pieces of each length, at most as many counts as the largest context size,
however many documents there are. The driver packs that histogram, whole runs of equal windows at a time;
pieces find their place by their rank within their length in one pass.

A document that is cut is cut between characters: a piece is the bytes from ``start_byte`` to ``end_byte``, the pieces of a document join to its
text, and ``contents`` writes the windows out. Tokens are estimated from bytes, or counted by a tokenizer that is given as the places where its
tokens begin; one read from a vocabulary file is ``vocabulary``.

Defined cases: a null or blank text has no tokens and no place; repeated rows are packed each; null ids are
packed like others; ties go by doc_id, then text, then start; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text
from ._store import written

TIERS = (512, 2048, 8192, 32768)
STEP_TOKENS = 1 << 20
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_OTHER = ~_SPACE & ~_text.IS_WORD


#: For each text the bytes at which its tokens begin, in order.
Tokenizer = Callable[[pa.Array | pa.ChunkedArray], Iterator[np.ndarray]]


def token_counts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Estimated tokens of each text: a quarter of each word's bytes, rounded up, and one for each other mark."""
    out = [np.zeros(0, np.int64)]
    for _, data, offs in _text.blocks(column):
        start, end, row = _text.spans(data, offs)
        n = np.bincount(row, (end - start + 3) // 4, len(offs) - 1).astype(np.int64)
        marks = np.concatenate(([0], np.cumsum(_OTHER[data], dtype=np.int64)))
        out.append(n + marks[offs[1:]] - marks[offs[:-1]])
    return np.concatenate(out)


def token_starts(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Where the estimated tokens of each text begin: every four bytes of a word, and each other mark."""
    for _, data, offs in _text.blocks(column):
        start, end, _ = _text.spans(data, offs)
        n = (end - start + 3) // 4
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.sort(np.concatenate((np.repeat(start, n) + 4 * inner, np.flatnonzero(_OTHER[data]))))
        cut = np.searchsorted(at, offs)
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            yield at[a:b] - offs[i]


def vocabulary(path: str) -> Tokenizer:
    """The tokenizer of a JSON file of the tokenizers library, which every executor must be able to read."""
    loaded: dict[str, object] = {}

    def starts(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
        if path not in loaded:
            from tokenizers import Tokenizer as Reader

            loaded[path] = Reader.from_file(path)
            loaded[path].encode_special_tokens = True  # type: ignore[attr-defined]
        for text in column.to_pylist():
            found = loaded[path].encode(text or "", add_special_tokens=False).offsets  # type: ignore[attr-defined]
            at = np.array([a for a, _ in found], np.int64)
            if not (text or "").isascii():  # its offsets are in characters
                at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text or ""])))[at]
            yield at

    return starts


@dataclass
class _Run:
    """``m`` equal windows from number ``w`` on."""

    w: int
    m: int
    cost: int


@dataclass(frozen=True)
class Plan:
    #: Sorted by (length, first rank): length, first rank, tier's index, first window, pieces in each window, offset of the first.
    places: np.ndarray
    #: For each tier, sorted by first window: first window, place of it in the order of cost.
    runs: tuple[np.ndarray, ...]
    windows: tuple[int, ...]


def plan(counts: dict[int, int], tiers: Sequence[int] = TIERS) -> Plan:
    """Packs ``counts`` pieces of each length, none longer than the largest tier."""
    left = dict(counts)
    rank: dict[int, int] = defaultdict(int)
    places: list[tuple[int, int, int, int, int, int]] = []
    runs, totals = [], []
    for k in range(len(tiers) - 1, -1, -1):
        size, below = tiers[k], tiers[k - 1] if k else 0
        open_: dict[int, list[_Run]] = defaultdict(list)
        gaps: list[int] = []
        total = 0

        def put(run: _Run, gap: int) -> None:
            if gap not in open_:
                bisect.insort(gaps, gap)
            open_[gap].append(run)

        def place(length: int, run: _Run, gap: int, per: int) -> None:
            places.append((length, rank[length], k, run.w, per, size - gap))
            rank[length] += per * run.m
            left[length] -= per * run.m
            run.cost += per * length * length
            put(run, gap - per * length)

        for length in sorted(left, reverse=True):
            while left[length]:
                at = bisect.bisect_left(gaps, length)
                if at < len(gaps):
                    gap = gaps[at]
                    run = open_[gap].pop()
                    if not open_[gap]:
                        del open_[gap]
                        gaps.pop(at)
                elif length > below:
                    gap = size
                    run = _Run(total, max(1, left[length] // (size // length)), 0)
                    total += run.m
                else:
                    break
                per = min(gap // length, left[length])
                fit = min(run.m, left[length] // per)
                if fit < run.m:
                    put(_Run(run.w + fit, run.m - fit, run.cost), gap)
                    run.m = fit
                place(length, run, gap, per)
        final = sorted((r for rs in open_.values() for r in rs), key=lambda r: (-r.cost, r.w))
        order, at = [], 0
        for r in final:
            order.append((r.w, at))
            at += r.m
        runs.append(np.array(sorted(order), np.int64).reshape(-1, 2))
        totals.append(total)
    return Plan(np.array(sorted(places), np.int64).reshape(-1, 6), tuple(runs[::-1]), tuple(totals[::-1]))


def _cut(text: bytes, starts: np.ndarray, largest: int) -> list[int]:
    """The bytes at which the pieces of a text begin, and its end. A token that begins within a character begins with it."""
    out = [0]
    for at in starts[largest::largest].tolist():
        while at and text[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return [*out, len(text)]


def pieces(docs: DataFrame, largest: int, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(doc_id, key, start, len, start_byte, end_byte) of the pieces of each document; start and len in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            starts = None if tokenizer is None else list(tokenizer(text))
            n = token_counts(text) if starts is None else np.array([len(x) for x in starts], np.int64)
            size = text.cast(pa.binary()).fill_null(b"").to_pylist() if (n > largest).any() else None
            lengths = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False)
            count = -(-n // largest)
            row = np.repeat(np.arange(len(n)), count)
            start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * largest
            first, last = np.zeros(len(row), np.int64), lengths[row].astype(np.int64)
            for i in np.flatnonzero(count > 1).tolist():
                at = next(iter(token_starts(text.slice(i, 1)))) if starts is None else starts[i]
                edges = _cut(size[i], at, largest)
                own = np.flatnonzero(row == i)
                first[own], last[own] = edges[:-1], edges[1:]
            at = pa.array(row)
            columns = [b.column("doc_id").take(at), b.column("key").take(at), pa.array(start), pa.array(np.minimum(largest, n[row] - start)), pa.array(first), pa.array(last)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "start", "len", "start_byte", "end_byte"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, start long, len long, start_byte long, end_byte long")


def packed(docs: DataFrame, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(tier, window, step, offset, doc_id, key, start, n_tokens, start_byte, end_byte): where each piece of each document goes.

    key is a hash of the text, which tells documents with one id or none.
    """
    tiers = tuple(sorted(tiers))
    rows = written(pieces(docs, tiers[-1], tokenizer), "pieces")
    p = plan({r["len"]: r["n"] for r in rows.groupBy("len").agg(F.count("*").alias("n")).collect()}, tiers)  # at most tiers[-1] rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = p.places[:, 0] << 44 | p.places[:, 1]
        steps = [max(1, -(-n * size // step_tokens)) for n, size in zip(p.windows, tiers)]
        for b in batches:
            length, rank = b.column("len").to_numpy(), b.column("rank").to_numpy() - 1
            _, r0, k, w0, per, at = p.places[np.searchsorted(key, length << 44 | rank, "right") - 1].T
            window, offset = w0 + (rank - r0) // per, at + (rank - r0) % per * length
            step = np.zeros(len(k), np.int64)
            for i in np.unique(k):
                own = np.flatnonzero(k == i)
                r = p.runs[i][np.searchsorted(p.runs[i][:, 0], window[own], "right") - 1]
                turn, col = np.divmod(r[:, 1] + window[own] - r[:, 0], steps[i])
                step[own] = np.where(turn % 2, steps[i] - 1 - col, col)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(tiers)[k]), pa.array(window), pa.array(step), pa.array(offset), *(b.column(c) for c in ("doc_id", "key", "start", "len", "start_byte", "end_byte"))], ["tier", "window", "step", "offset", "doc_id", "key", "start", "n_tokens", "start_byte", "end_byte"])

    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("len").orderBy("doc_id", "key", "start")).cast("long"))
    return ranked.mapInArrow(run, "tier long, window long, step long, offset long, doc_id long, key long, start long, n_tokens long, start_byte long, end_byte long")


def contents(docs: DataFrame, places: DataFrame, separator: str = "\n") -> DataFrame:
    """(tier, window, step, n_tokens, text): the windows themselves, from ``places`` as ``packed`` returns them; pieces are set apart by ``separator``."""
    texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"), F.col("text").cast("binary").alias("__text")).dropDuplicates(["__id", "__key"])
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    piece = F.expr("substring(__text, int(start_byte) + 1, int(end_byte - start_byte))")
    # A window holds no more than its size, so its list is bounded.
    parts = places.join(texts, same).groupBy("tier", "window").agg(F.first("step").alias("step"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", piece.cast("string").alias("text")))).alias("parts"))
    return parts.select("tier", "window", "step", "n_tokens", F.array_join(F.transform("parts", lambda x: x["text"]), separator).alias("text"))
