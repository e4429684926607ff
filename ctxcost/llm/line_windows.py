"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a document are hashed; windows that occur more than once anywhere are
found globally, and the lines that later occurrences cover are removed, overlapping and touching windows merged.

A line ends at a newline or, as web text often has whole paragraphs on one line, at a sentence end (one of ``.!?`` before
white space). Within a sentence it also ends after each word whose mark, a small hash, is the least of some ``WORDS`` consecutive
words (the last of equals). That depends on content alone, wherever a sentence begins: no line has more than ``WORDS`` words,
and a copied passage of fifty words has three lines of its own at least, whatever stands before it. Lines are compared
without the white space around them; blank lines are no part of a window but go when a removed window spans them. Merged
windows of fewer than ``min_bytes`` bytes are no evidence of copying and stay. The first occurrence is that of the lowest doc_id (null ids
last), then the lowest position. A repeat within a document is a repeat too.

Each task ranks its own windows first, so one row a task and hash is shuffled by that hash, however often it occurs; what a
task knows to be a repeat goes to its document.

``cleaned`` can be given a test for near copies. A window of a near copy that first occurs in the document that it copies is left in place,
so that what decides about whole documents afterwards sees both with the same lines and not one as a rest of edited lines.

Defined cases: null and empty texts, and texts of fewer than three lines, are unchanged; rows with the same
id and text are one document and all change alike; a text whose every line goes becomes empty, and
``cleaned`` drops it on request; n_chars, where the table has it, follows the text; extra columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text
from ._store import few, written

LINES = 3
WORDS = 12
MIN_BYTES = 30
#: Of a document's repeated bytes, what another must be the first with to be tested for being its original.
TWIN_SHARE = 0.05
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_LAST = (1 << 63) - 1
_HELD = 500_000  # windows that a task ranks at a time
_FOUND = "id long, key long, span long, part long, late boolean, of_id long, of_key long"


def marks(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A small hash of each word: its bytes times their places, in 16 bits."""
    sums = np.zeros((2, len(data) + 1), np.uint64)
    np.cumsum(data, dtype=np.uint64, out=sums[0, 1:])
    np.cumsum(data * np.arange(1, len(data) + 1, dtype=np.uint64), out=sums[1, 1:])
    placed = sums[1, last] - sums[1, first] - first.astype(np.uint64) * (sums[0, last] - sums[0, first])
    return placed * np.uint64(40503) & np.uint64(0xFFFF)


def _ends(mark: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Words that are the least of some ``WORDS`` consecutive ones of their sentence, the last of equals, but no sentence's last."""
    if len(mark) < WORDS:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(of[: len(of) - WORDS + 1] == of[WORDS - 1 :])
    least = np.unique(at + WORDS - 1 - np.lib.stride_tricks.sliding_window_view(mark, WORDS)[at, ::-1].argmin(1))
    return least[np.append(of[1:], -1)[least] == of[least]]


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each line with its white space, and (start, end) without; blank lines have start >= end there."""
    n = len(data)
    space = _SPACE[data]
    cut = data == 10
    cut[:-1] |= _STOP[data[:-1]] & space[1:]
    starts = np.unique(np.concatenate((offs[:-1], np.flatnonzero(cut) + 1)))
    first, last, _ = _text.spans(data, offs, ~_SPACE)
    ends = _ends(marks(data, first, last), np.searchsorted(starts, first, "right"))
    starts = np.unique(np.concatenate((starts, last[ends])))
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    ink = np.append(np.flatnonzero(~space), n)
    return starts, ends, ink[np.searchsorted(ink, starts)], np.concatenate(([-1], ink))[np.searchsorted(ink, ends)] + 1


def windows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """(hash, id, key, span) as columns, a row for each window; ``span`` is its first byte in the upper 32 bits and its end in the lower."""
    ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
    for first, data, offs in _text.blocks(batch.column("text")):
        starts, ends, a, b = lines(data, offs)
        row = np.searchsorted(offs, starts, "right") - 1
        full = np.flatnonzero(a < b)
        h, at = _text.shingles(_text.hashes(data, a[full], b[full], fold=False), row[full], LINES)
        own = row[full[at]]
        span = (starts[full[at]] - offs[own]) << 32 | (ends[full[at + LINES - 1]] - offs[own])
        yield np.stack((_text.signed(h), ids[first + own], keys[first + own], span), 1)


def _ranked(held: list[np.ndarray]) -> pa.RecordBatch:
    """The first window of each hash, to be compared with those of other tasks, and the later ones, which go to their documents."""
    w = np.concatenate(held)
    w = w[np.lexsort(w.T[::-1])]
    w = w[np.append(True, (w[1:] != w[:-1]).any(1))]  # rows that repeat each other have the same windows
    new = np.append(True, w[1:, 0] != w[:-1, 0])
    of = w[np.flatnonzero(new)][np.cumsum(new) - 1]
    part = np.where(new, w[:, 0], _text.signed(_text.mix((w[:, 1] ^ w[:, 2]).view(np.uint64))))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (w[:, 1], w[:, 2], w[:, 3], part, ~new, of[:, 1], of[:, 2])], ["id", "key", "span", "part", "late", "of_id", "of_key"])


def without(text: bytes, spans: np.ndarray, min_bytes: int = MIN_BYTES) -> bytes:
    """``text`` without the bytes that the spans cover, merged, where they are enough."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.append(True, start[1:] > end[:-1])
    out, at = [], 0
    for a, b in zip(start[new].tolist(), end[np.append(new[1:], True)].tolist()):
        if b - a >= min_bytes:
            out.append(text[at:a])
            at = b
    return b"".join((*out, text[at:]))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("key"), "text")


def _later(docs: DataFrame) -> DataFrame:
    """(id, key, span, of_id, of_key) of the windows that occur earlier, and an earlier document that each is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for w in windows(b):
                held.append(w)
                n += len(w)
                if n > _HELD:
                    yield _ranked(held)
                    held, n = [], 0
        if n:
            yield _ranked(held)

    found = _texts(docs).mapInArrow(run, _FOUND)
    # Rows of one document repeat each other's windows at the same place; rank, not row_number, leaves those alike.
    order = W.partitionBy("part", "late").orderBy("id", "key", "span")
    first = found.withColumn("place", F.rank().over(order)).withColumns({x: F.when(F.col("late"), F.col(x)).otherwise(F.first(x).over(order)) for x in ("of_id", "of_key")})
    return first.where("late OR place > 1").select("id", "key", "span", "of_id", "of_key")


def repeats(docs: DataFrame) -> DataFrame:
    """(id, key, spans): the windows of each document that occur earlier, in it or in another."""
    return _later(docs).groupBy("id", "key").agg(F.collect_set("span").alias("spans"))


def _but_twins(docs: DataFrame, twins: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """As ``repeats``, without the windows that a near copy has from its original."""
    by = _later(docs).groupBy("id", "key", "of_id", "of_key").agg(F.collect_set("span").alias("spans"))
    by = written(by.withColumn("bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(0xFFFFFFFF) - F.shiftright(x, 32))), "window-owners")
    # The share bounds the candidates of a document, at twenty.
    other = by.where("id <> of_id OR key <> of_key").withColumn("all", F.sum("bytes").over(W.partitionBy("id", "key"))).where(F.col("bytes") >= F.lit(TWIN_SHARE) * F.col("all"))
    near = twins(_texts(docs), other.select("id", "key", "of_id", "of_key"))
    return by.join(few(written(near, "twins")), ["id", "key", "of_id", "of_key"], "left_anti").groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def cleaned(docs: DataFrame, drop_empty: bool = False, min_bytes: int = MIN_BYTES, twins: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with its later windows removed from ``text``; with ``drop_empty``, rows go whose text ends up blank (or was).

    ``twins``, given (id, key, text) and pairs (id, key, of_id, of_key), returns those pairs that are near copies.
    """
    found = repeats(docs) if twins is None else _but_twins(docs, twins)
    return _rewritten(docs, found.hint("shuffle_hash"), drop_empty, min_bytes)


def _rewritten(docs: DataFrame, found: DataFrame, drop_empty: bool, min_bytes: int) -> DataFrame:
    schema = docs.schema
    keyed = docs.withColumns({"__cc_id": F.coalesce("doc_id", F.lit(_LAST)), "__cc_key": F.xxhash64("text")})
    found = found.withColumnsRenamed({"id": "__cc_id", "key": "__cc_key", "spans": "__cc_spans"})
    joined = keyed.join(found, ["__cc_id", "__cc_key"], "left").drop("__cc_id", "__cc_key")
    counts = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("__cc_spans")
            b = b.drop_columns(["__cc_spans"])
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                at = b.schema.get_field_index("text")
                old = b.column("text")
                new = [without(old[i].as_py().encode(), spans[i].values.to_numpy(), min_bytes).decode() for i in hit.tolist()]
                mask = np.zeros(b.num_rows, bool)
                mask[hit] = True
                b = b.set_column(at, b.schema.field(at), pc.replace_with_mask(old, pa.array(mask), pa.array(new, old.type)))
                if counts:
                    at = b.schema.get_field_index("n_chars")
                    n = pa.array([len(x) for x in new], b.schema.field(at).type)
                    b = b.set_column(at, b.schema.field(at), pc.replace_with_mask(b.column(at), pa.array(mask), n))
            if drop_empty:
                b = b.filter(pc.greater(pc.binary_length(pc.utf8_trim_whitespace(pc.fill_null(b.column("text"), ""))), 0))
            yield b

    return joined.mapInArrow(run, schema)
