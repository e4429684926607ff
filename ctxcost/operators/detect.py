"""The nine detectors: files in, findings out.

A detector takes ``file_records`` and a context and gives (det_ord, seq, emit_ord, path, detector, confidence,
reason, suggest). A reason is made of templates and metadata, never of file content.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kinds
from ..schema import DAY, DEFAULT_BUDGET, Context
from ..store import written

RESIDENT_SHARE = 0.3
OUTLIER_LEAST, OUTLIER_RANK = 20, 0.99
NEAR_BITS = 10
LEAST_PRINTS, BLOCK_PRINTS, PAIRS_AT_ONCE = 2048, 65_536, 1 << 20
COLD_TOKENS, COLD_DAYS = 1000, 180

Detector = Callable[[DataFrame, Context], DataFrame]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def finding(df: DataFrame, order: int, name: str, confidence: Column, suggest: str, reason: Column, emit: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(order).alias("det_ord"), F.col("seq").cast("long").alias("seq"), (F.lit(0) if emit is None else emit).cast("long").alias("emit_ord"),
        "path", F.lit(name).alias("detector"), confidence.cast("double").alias("confidence"), reason.alias("reason"), F.lit(suggest).alias("suggest"),
    )


def generated(files: DataFrame, ctx: Context) -> DataFrame:
    banner = F.coalesce("generated_header", F.lit(False))
    reason = F.concat(F.lit("generated file — "), F.when(banner, "path pattern and a generated-file header banner").otherwise("matches a known lockfile/build-output path pattern"))
    return finding(files.where("kind = 'generated'"), 0, "generated", F.when(banner, 0.97).otherwise(0.75), "ignore", reason)


def vendored(files: DataFrame, ctx: Context) -> DataFrame:
    churned, tracked = F.coalesce("commits_90d", F.lit(0)) > 0, F.col("last_commit").isNotNull()
    confidence = F.when(churned, 0.45).when(tracked, 0.9).otherwise(0.7)
    reason = F.concat(F.lit("vendored path, "), F.when(churned, "but recently modified — may be hand-patched rather than untouched").when(tracked, "no commits in the last 90 days").otherwise("untracked by git"))
    return finding(files.where("kind = 'vendored'"), 1, "vendored", confidence, "ignore", reason)


def t0_overweight(files: DataFrame, ctx: Context) -> DataFrame:
    budget = DEFAULT_BUDGET if ctx.budget is None else ctx.budget
    limit = budget * RESIDENT_SHARE
    over = files.where((F.col("tier") == 0) & (F.col("tokens") > F.lit(float(limit))))
    share = js_round(F.col("tokens") / F.lit(float(budget)) * 100)
    reason = F.format_string(f"resident file alone uses ~%d%% of the {budget:g}-token resident budget", share)
    return finding(over, 2, "t0-overweight", clamp(0.5 + (F.col("tokens") / F.lit(float(limit)) - 1) * 0.25, 0.5, 0.95), "split", reason)


def bloat_outlier(files: DataFrame, ctx: Context) -> DataFrame:
    """Ranks come from a histogram of each kind's token counts: six kinds would be six partitions of a window over the files.

    The counts are read twice, so they are a table: counting tokens is most of the work.
    """
    sized = written(files.where("kind <> 'binary'").select("seq", "path", "kind", "tokens"), "sized")
    kind = W.partitionBy("kind")
    ranks = (
        sized.groupBy("kind", "tokens").agg(F.count("*").alias("own"))
        .withColumn("n", F.sum("own").over(kind)).where(F.col("n") >= OUTLIER_LEAST)
        .withColumn("upto", F.sum("own").over(kind.orderBy("tokens")))
        .withColumn("at", F.least(F.floor(F.col("n") * F.lit(OUTLIER_RANK)), F.col("n") - 1) + 1)
        .withColumn("p99", F.min(F.when(F.col("upto") >= F.col("at"), F.col("tokens"))).over(kind))
        .withColumn("rank", F.col("upto") / F.col("n")).where(F.col("rank") >= OUTLIER_RANK)
        .select("kind", "tokens", "rank", "p99")
    )
    top = sized.join(ranks, ["kind", "tokens"])
    reason = F.format_string("%d tok is in the top 1%% of %s files in this repo (~%d tok is typical for the ceiling)", "tokens", "kind", "p99")
    return finding(top, 3, "bloat-outlier", clamp(0.5 + (F.col("rank") - OUTLIER_RANK) * 40, 0.5, 0.9), "review", reason)


def stale_doc(files: DataFrame, ctx: Context) -> DataFrame:
    known = files.select(F.col("path").alias("ref"), F.lit(True).alias("known")).distinct()
    refs = files.where(F.size("referenced_paths") > 0).select("seq", "path", F.explode("referenced_paths").alias("ref"))
    seen = refs.join(known.hint("merge"), "ref", "left").groupBy("seq", "path").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("gone"))
    reason = F.format_string("references %d of %d linked path(s) that no longer exist in this repo", "gone", "n")
    return finding(seen.where("gone > 0"), 4, "stale-doc", clamp(0.4 + F.col("gone") / F.col("n") * 0.55, 0.4, 0.95), "review", reason)


def _prints(files: DataFrame) -> DataFrame:
    """(seq, path, fp) of the documents that have a fingerprint; a table, as each fingerprint takes a text to read."""
    docs = files.where("kind = 'doc'").select(F.col("seq").cast("long").alias("seq"), "path", F.col("content_simhash").alias("fp"))
    return written(docs, "fingerprints").where("fp IS NOT NULL AND seq IS NOT NULL")


def _cells(batches: Iterator[pa.RecordBatch], grid: int) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(early, late) of each cell, of rows sorted by cell, late and seq; a cell of one block has that twice."""

    def parted(cell: int, held: list[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
        own = pa.Table.from_batches(held).combine_chunks()
        n = own.num_rows - int(own.column("late").to_numpy().sum())
        return (own, own) if cell % (grid + 1) == 0 else (own.slice(0, n), own.slice(n))

    now, held = -1, []
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)] if len(cell) else []
        for i, j in pairwise(cuts):
            if held and cell[i] != now:
                yield parted(now, held)
                held = []
            now = int(cell[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield parted(now, held)


def _near(cells: Iterator[tuple[pa.Table, pa.Table]], bits: int) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(early, late, i, j, d): the rows of both, about ``PAIRS_AT_ONCE`` pairs at a time, that are within ``bits`` bits."""
    for early, late in cells:
        a, b = early.column("seq").to_numpy(), late.column("seq").to_numpy()
        x, y = (t.column("fp").to_numpy().view(np.uint64) for t in (early, late))
        if max(x.max(initial=0), y.max(initial=0)) < 1 << 32:
            x, y = x.astype(np.uint32), y.astype(np.uint32)
        own, step = early is late, max(1, PAIRS_AT_ONCE // max(1, len(y)))
        for at in range(0, len(x), step):
            skip = int(np.searchsorted(b, a[at], "right")) if own else 0
            if skip == len(y):
                continue
            d = np.bitwise_count(x[at : at + step, None] ^ y[skip:]).ravel()
            hit = np.flatnonzero(d <= bits)
            i, j = np.divmod(hit, len(y) - skip)
            i, j, d = i + at, j + skip, d[hit]
            if own:
                later = b[j] > a[i]
                i, j, d = i[later], j[later], d[later]
            yield early, late, i, j, d


def _compared(docs: DataFrame, bits: int, out: Callable[[Iterator], Iterator[pa.RecordBatch]], columns: str) -> DataFrame:
    """``out`` of each two of ``docs`` (seq, fp, ...) of different seq that are within ``bits`` bits.

    Blocks are ranges of seq, at most about ``BLOCK_PRINTS`` documents each, and a cell of the grid's upper half compares two of them. A task
    holds no more than that and sends on what it finds as it goes; a document is shuffled once a block, so ten times the documents are that
    many more cells of the same size.
    """
    tasks, n = docs.sparkSession.sparkContext.defaultParallelism, docs.count()
    grid = max(1, -(-n // BLOCK_PRINTS), min(-(-n // LEAST_PRINTS), math.isqrt(32 * tasks)))
    bounds = docs.agg(F.percentile_approx("seq", [i / grid for i in range(1, grid)], 100 * grid)).first()[0] if grid > 1 else []
    block = F.lit(0)  # equal seqs share one
    for x in sorted(set(bounds or [])):
        block = block + (F.col("seq") > F.lit(x)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda j: F.struct((F.least("__block", j) * grid + F.greatest("__block", j)).alias("cell"), (F.col("__block") > j).alias("late")))
    sent = docs.withColumn("__block", block).select(F.explode(cells).alias("__c"), *docs.columns).select("__c.*", *docs.columns)
    # A cell's few bytes are much work, so tasks aren't left to be as few as their size asks for.
    sent = sent.repartition(min(grid * (grid + 1) // 2, 256 * tasks), "cell").sortWithinPartitions("cell", "late", "seq")
    return sent.mapInArrow(lambda it: out(_near(_cells(it, grid), bits)), columns)


def _pairs(found: Iterator) -> Iterator[pa.RecordBatch]:
    for early, late, i, j, d in found:
        if len(d):
            i, j = pa.array(i), pa.array(j)
            cols = [late.column("seq").take(j), late.column("path").take(j), early.column("seq").take(i), early.column("path").take(i)]
            yield pa.record_batch([*(c.combine_chunks() for c in cols), pa.array(d.astype(np.int32))], names=["seq", "path", "other_seq", "other", "d"])


def _counts(found: Iterator) -> Iterator[pa.RecordBatch]:
    n = np.zeros(65, np.int64)
    for *_, d in found:
        n += np.bincount(d, minlength=65)
    at = np.flatnonzero(n)
    yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(n[at])], names=["d", "n"])


def near_docs(files: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """(seq, path, other_seq, other, d): each document and every earlier one within ``bits`` bits.

    Ten of 32 bits let in one pair of random documents in forty, so the result grows with the square of the documents
    and no index prunes it: each two are compared once, in the cells of a grid. Equal fingerprints are a join.
    """
    docs = _prints(files)
    if bits:
        return _compared(docs, bits, _pairs, "seq long, path string, other_seq long, other string, d int")
    # A table's size on disk is a fraction of what its paths take in the driver, so neither side may be broadcast.
    early = docs.select("fp", F.col("seq").alias("other_seq"), F.col("path").alias("other")).hint("merge")
    return docs.join(early, "fp").where("seq > other_seq").select("seq", "path", "other_seq", "other", F.lit(0).alias("d"))


def near_counts(files: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """(d, n): how many pairs ``near_docs`` has at each distance, counted where they are compared."""
    return _compared(_prints(files).select("seq", "fp"), bits, _counts, "d long, n long").groupBy("d").agg(F.sum("n").alias("n"))


def dup_doc(files: DataFrame, ctx: Context) -> DataFrame:
    reason = F.concat(F.lit("~"), js_round((1 - F.col("d") / 32) * 100).cast("string"), F.lit("% overlap with "), F.col("other"))
    return finding(near_docs(files), 5, "dup-doc", clamp(1 - F.col("d") / 32, 0.5, 0.95), "review", reason, F.col("other_seq"))


def cold_and_costly(files: DataFrame, ctx: Context) -> DataFrame:
    now = int(time.time()) if ctx.now is None else ctx.now
    days = F.floor((F.lit(now) - F.col("last_commit")) / DAY).cast("long")
    entry = kinds.is_entrypoint(F.col("path"), F.col("tier"))
    if ctx.package_entrypoints:
        entry = entry | F.col("path").isin(*ctx.package_entrypoints)
    cold = files.where((F.col("kind") != "binary") & (F.col("tokens") >= COLD_TOKENS) & F.col("last_commit").isNotNull() & (days >= COLD_DAYS) & ~entry)
    bonus = F.least(F.lit(0.3), (days - COLD_DAYS) / F.lit(365.0) * 0.3) + F.least(F.lit(0.15), F.col("tokens") / F.lit(10000.0))
    reason = F.format_string("%d tok, untouched for ~%d days, no known-entrypoint filename", F.col("tokens"), days)
    return finding(cold, 6, "cold-and-costly", clamp(0.4 + bonus, 0.4, 0.85), "review", reason)


def orphan_module(files: DataFrame, ctx: Context) -> DataFrame:
    reason = F.lit("unreachable from any inferred entrypoint via module-graph edges")
    return finding(files.where("orphan_module"), 7, "orphan-module", F.lit(0.55), "review", reason)


def dead_export(files: DataFrame, ctx: Context) -> DataFrame:
    n = F.size("dead_export_symbols")
    reason = F.format_string("%d exported symbol(s) have zero inbound module-graph references anywhere in this repo (v1)", n)
    return finding(files.where(n > 0), 8, "dead-export", F.least(F.lit(0.8), 0.5 + F.lit(0.08) * n), "review", reason)


#: In registry order; add a detector here to extend the set.
DETECTORS: dict[str, Detector] = {
    "generated": generated, "vendored": vendored, "t0-overweight": t0_overweight, "bloat-outlier": bloat_outlier, "stale-doc": stale_doc,
    "dup-doc": dup_doc, "cold-and-costly": cold_and_costly, "orphan-module": orphan_module, "dead-export": dead_export,
}


def run_all(files: DataFrame, ctx: Context, detectors: dict[str, Detector] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, (d(files, ctx) for d in (detectors or DETECTORS).values()))
