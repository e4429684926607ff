"""One scan of a source tree: files, findings and totals as DataFrames."""

from __future__ import annotations

import hashlib
import os
import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import docs, kinds, paths, tokens
from ..operators import detect, history, modules, score, snapshot, tiers
from ..runtime import ship
from ..schema import RECORDS, Context
from ..sources import aliases, config, git, manifest, script, walk
from ..store import written


@dataclass(frozen=True)
class Result:
    root: str
    files: DataFrame
    findings: DataFrame
    rollup: Row
    ctx: Context
    budget_explicit: bool

    @property
    def ranked(self) -> DataFrame:
        return score.ranked(self.files, self.findings, self.ctx.cadence)

    def views(self, prefix: str = "") -> None:
        """Registers the tables for Spark SQL."""
        self.files.createOrReplaceTempView(f"{prefix}file_records")
        self.findings.createOrReplaceTempView(f"{prefix}findings")
        self.ranked.createOrReplaceTempView(f"{prefix}ranked")


def classified(listed: DataFrame) -> DataFrame:
    """With their kind; the first bytes are read of the files whose path doesn't tell it, and only these are sent to Python."""
    path = F.col("path")
    known = listed.where(~kinds.needs_sniff(path)).withColumn("kind", kinds.classify(path))
    sniffed = walk.with_content(listed.where(kinds.needs_sniff(path)), F.lit(True), F.lit(kinds.SNIFF_BYTES))
    return known.unionByName(sniffed.withColumn("kind", kinds.classify(path, F.col("content"))).drop("content", "middle"))


def read(files: DataFrame) -> DataFrame:
    """With the bytes that are measured: whole files (content), or two samples (content, middle)."""
    path, size, tier, kind = (F.col(c) for c in ("path", "bytes", "tier", "kind"))
    parsed = kinds.is_graph_eligible(path)
    whole = tokens.is_exact(path, size, tier, kind) | parsed
    sample = F.when(~whole, F.lit(tokens.SAMPLE_BYTES))
    return walk.with_content(files, (kind != "binary") & ~kinds.is_minified(path) | parsed, sample, tokens.middle_at(size))


def derived(rows: DataFrame, known: Column | None = None) -> DataFrame:
    """``rows`` (path, bytes, tier, kind, content, middle, …) with the signals that come from a file's own content, which isn't kept.

    ``known`` is the module of a file that needn't be parsed.
    """
    path, size, tier, kind, content = (F.col(c) for c in ("path", "bytes", "tier", "kind", "content"))
    parsed = kinds.is_graph_eligible(path)
    text = F.make_valid_utf8(content.cast("string"))
    fresh = script.module(F.when(parsed if known is None else parsed & known.isNull(), text))
    second = F.when(~parsed, F.col("middle")).otherwise(F.substring(content, tokens.middle_at(size).cast("int") + 1, F.lit(tokens.SAMPLE_BYTES)))
    rows = rows.withColumn("m", tokens.measure(path, content, size, tier, kind, second=second)).withColumn("module", F.when(parsed, fresh if known is None else F.coalesce(known, fresh)))
    head, is_doc = F.col("m.head"), kind == "doc"
    links = docs.resolved_links(head, path)
    full = F.when(tokens.is_exact(path, size, tier, kind), text).otherwise(head)
    return rows.select(
        *(c for c in rows.columns if c not in ("content", "middle", "m", "module", "known")), "m.tokens", "m.estimated", F.when(kind == "generated", docs.looks_generated(head)).alias("generated_header"),
        F.when(is_doc & (F.size(links) > 0), links).alias("referenced_paths"), docs.simhash(F.when(is_doc, F.coalesce(full, F.lit("")))).alias("content_simhash"), "module",
    )


def _key(listed: pa.Table, *settings: object) -> str:
    """A digest of all that the signals of a tree depend on."""
    found = hashlib.sha256(repr((snapshot.VERSION, settings)).encode())
    for name in ("path", "bytes", "mtime_ms"):
        for buffer in listed.column(name).combine_chunks().buffers():
            if buffer is not None:
                found.update(buffer)
    return found.hexdigest()


def signals(spark: SparkSession, listed: pa.Table, specs: list[str], rules: list[aliases.Aliases], reuse: str | None) -> DataFrame:
    """Files with all but their history."""
    files = written(classified(walk.files(spark, listed)), "listed")
    prose = walk.with_content(files.where(kinds.is_resident_name(F.col("path")) | paths.extension(F.col("path")).isin(".md", ".mdx")), F.lit(True)).where("content IS NOT NULL")
    texts = prose.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    files = written(tiers.assign(files, texts), "tiers")
    old = snapshot.load(spark, reuse)
    if old is None:
        measured = written(derived(read(files)), "measured")
    else:
        hits, misses = snapshot.split(files, old)
        measured = written(hits.unionByName(derived(read(misses), F.col("known"))), "measured")
    if reuse is not None:
        snapshot.save(measured, reuse)
    declared = spark.createDataFrame([(s,) for s in specs], "spec string")
    table = aliases.table(spark, rules) if rules else None
    graph = modules.signals(measured, measured.where("module IS NOT NULL").select("path", "module"), declared, table)
    return measured.drop("abs_path", "mtime_ms", "module").join(graph, "path", "left")


def scan(spark: SparkSession, root: str, budget: float | None = None, now: int | None = None, limits: walk.Limits = walk.Limits(), reuse: str | None = None) -> Result:
    """Scans ``root``; ``reuse`` is a folder outside of it for the measures of unchanged files and the signals of an unchanged tree."""
    ship(spark)
    top = os.path.realpath(root)
    now = int(time.time()) if now is None else now
    settings = config.load(top)
    specs = manifest.load(top)
    rules = [a for a in (aliases.load_compiler(top), aliases.load_bundler(top)) if a]

    listed = walk.listing(top, limits)
    key = _key(listed, specs, rules)
    known = snapshot.load_signals(spark, reuse, key)
    if known is None:
        known = signals(spark, listed, specs, rules, reuse)
        if reuse is not None:
            snapshot.save_signals(known, reuse, key)
            known = snapshot.load_signals(spark, reuse, key)
    seen = history.history(git.commits(spark, top), now)
    records = written(known.join(seen, "path", "left").select(*RECORDS.fieldNames()), "records")

    declared = spark.createDataFrame([(s,) for s in specs], "spec string")
    named = modules.resolve(declared.select(F.col("spec").alias("raw"), "spec"), records, ["raw"]).select("target").distinct() if specs else declared
    ctx = Context(top, git.is_repository(top), settings.budget if budget is None else budget, now, settings.cadence, tuple(sorted(r[0] for r in named.collect())))
    findings = written(detect.run_all(records, ctx), "findings")
    return Result(top, records, findings, score.rollup(records, findings, ctx).first(), ctx, budget is not None or settings.budget_explicit)
