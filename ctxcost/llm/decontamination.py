"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items.

An item is the set of its word shingles (``k`` consecutive words, case folded); a document leaks an item
if some window of the item's own size (in shingle positions) holds at least ``t = ceil(containment * S)``
of the item's ``S`` distinct shingles.

1. Documents are scanned once; only shingles that occur in the benchmark leave the scan.
2. Item shingles are ordered by rarity, their document frequency over all documents. Of any ``t`` shared
   shingles one is among the ``S - t + 1`` rarest (the prefix), so only prefix shingles are joined.
3. Length bound: a document with fewer than ``t`` shingles can't hold the item. Positional bound: only
   matches within one window of a prefix match count.
4. Containment is verified exactly for every window that starts at a match.

Defined cases: null or empty texts and items, and items of fewer than ``k`` words, have no shingles and
never match; null item ids are ignored; a null doc_id is reported as null; repeated rows give one result;
several texts under one id give their best window; empty tables give no rows; extra columns are ignored
by ``leaks`` and kept by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text
from ._store import without, written

#: Benchmark shingles up to this number are sent to every task (8 bytes each); more are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000


def doc_key() -> Column:
    """One key for a document, whether or not it has an id."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 62))), F.coalesce("text", F.lit("")))


def _shingled(df: DataFrame, k: int, only: np.ndarray | None) -> DataFrame:
    """(id, key, n, pos, sh) of the shingles of (id, key, text); ``n`` counts all of the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if only is None else _text.Lookup(only)
        for b in batches:
            for first, data, offs in _text.blocks(b.column("text")):
                start, end, row = _text.spans(data, offs)
                sh, at = _text.shingles(_text.hashes(data, start, end), row, k)
                of = row[at]
                n = np.bincount(of, minlength=len(offs) - 1)
                pos = at - np.searchsorted(row, of)
                if known is not None:
                    hit = np.flatnonzero(known(sh) >= 0)
                    sh, of, pos = sh[hit], of[hit], pos[hit]
                if len(sh):
                    rows = pa.array(first + of)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("key").take(rows), pa.array(n[of]), pa.array(pos), pa.array(_text.signed(sh))], ["id", "key", "n", "pos", "sh"])

    return df.mapInArrow(run, "id long, key long, n long, pos long, sh long")


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 4, containment: float = 0.7) -> DataFrame:
    """(doc_id, item_id, containment, start): every item that a document holds, its best window and the first word of that."""
    return _found(docs, benchmark, k, containment).groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("containment").alias("containment"), F.min_by("start", F.struct(-F.col("containment"), "start")).alias("start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, k: int = 4, containment: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    bad = _found(docs, benchmark, k, containment).select(F.col("key").alias("__cc_gone")).distinct()
    return without(docs, doc_key(), bad)


def _found(docs: DataFrame, benchmark: DataFrame, k: int, containment: float) -> DataFrame:
    """(id, key, item_id, containment, start) for each item of each document, identified by key."""
    texts = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").alias("id"), F.xxhash64("item_id", F.coalesce("text", F.lit(""))).alias("key"), F.lower("text").alias("text"))
    items = written(
        _shingled(texts, k, None)
        .groupBy("id", "key", "n", "sh").agg(F.lit(1).alias("one"))
        .select(F.col("id").alias("item_id"), F.col("key").alias("item"), F.col("n").alias("w"), "sh", F.count("*").over(W.partitionBy("id", "key")).alias("s"))
        .withColumn("t", F.ceil(F.lit(float(containment)) * F.col("s") - 1e-9).cast("long")),
        "benchmark",
    )
    keys = items.select("sh").distinct()
    only = None
    if keys.count() <= BROADCAST_SHINGLES:
        only = keys.toArrow().column("sh").to_numpy().view(np.uint64)
    hits = _shingled(docs.select(F.col("doc_id").alias("id"), doc_key().alias("key"), F.lower("text").alias("text")), k, only)
    if only is None:
        hits = hits.join(keys, "sh", "left_semi")
    hits = written(hits.dropDuplicates(["key", "pos"]), "benchmark-hits")
    df = hits.select("sh", "key").distinct().groupBy("sh").agg(F.count("*").alias("df"))
    ranked = items.join(df, "sh", "left").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "sh")))
    ranked = ranked.withColumn("prefix", F.col("rank") <= F.col("s") - F.col("t") + 1).select("item", "item_id", "sh", "s", "t", "w", "prefix")
    # Prefix tokens first, so that a common shingle never joins by itself; a document too short for the item drops out.
    pairs = hits.join(ranked.where("prefix"), "sh").where("n >= t").select("key", "item").distinct()
    same = W.partitionBy("key", "item").orderBy("pos")
    match = (
        hits.join(pairs, "key").join(ranked, ["item", "sh"])
        .withColumn("before", F.last(F.when(F.col("prefix"), F.col("pos")), ignorenulls=True).over(same.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("after", F.first(F.when(F.col("prefix"), F.col("pos")), ignorenulls=True).over(same.rowsBetween(0, W.unboundedFollowing)))
        .where("pos - before < w OR after - pos < w")
        .withColumn("prev", F.lag("pos").over(W.partitionBy("key", "item", "sh").orderBy("pos")))
        .withColumn("bin", F.expr("pos div w"))
    )
    # Each match is a window's start; it counts the matches in reach whose shingle hasn't occurred since the start.
    start = match.select("id", "key", "item", "item_id", "bin", F.col("pos").alias("start"), "s", "t", "w")
    inside = match.select("key", "item", "pos", "prev", F.explode(F.array("bin", F.col("bin") - 1)).alias("bin"))
    return (
        start.join(inside, ["key", "item", "bin"])
        .where("pos >= start AND pos < start + w AND (prev IS NULL OR prev < start)")
        .groupBy("id", "key", "item", "item_id", "start", "s", "t").agg(F.count("*").alias("shared"))
        .where("shared >= t")
        .groupBy("id", "key", "item_id")
        .agg(F.max(F.col("shared") / F.col("s")).alias("containment"), F.min_by("start", F.struct(-(F.col("shared") / F.col("s")), "start")).alias("start"))
    )
