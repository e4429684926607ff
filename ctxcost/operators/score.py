"""Waste, rollup and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DEFAULT_BUDGET, DEFAULT_CADENCE, Context
from .detect import js_round

TOP = 20


def cadence_of(tier: Column, cadence: dict[int, float]) -> Column:
    out = F.lit(float(cadence.get(2, DEFAULT_CADENCE[2])))
    for t in (1, 0):
        out = F.when(tier == t, F.lit(float(cadence.get(t, DEFAULT_CADENCE[t])))).otherwise(out)
    return out


def waste(tokens: Column, confidence: Column, tier: Column, cadence: dict[int, float] = DEFAULT_CADENCE) -> Column:
    return tokens * confidence * cadence_of(tier, cadence)


def max_confidence(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path").agg(F.max("confidence").alias("confidence"))


def wasted(files: DataFrame, findings: DataFrame, cadence: dict[int, float] = DEFAULT_CADENCE) -> DataFrame:
    """Every file with its waste; files without findings waste nothing."""
    scored = files.join(max_confidence(findings), "path", "left")
    return scored.withColumn("waste", waste(F.col("tokens"), F.coalesce("confidence", F.lit(0.0)), F.col("tier"), cadence))


def ranked(files: DataFrame, findings: DataFrame, cadence: dict[int, float] = DEFAULT_CADENCE) -> DataFrame:
    """(seq, path, waste) of the files that waste anything, most first."""
    return wasted(files, findings, cadence).where("waste > 0").select("seq", "path", "waste").orderBy(F.desc("waste"), "seq")


def rollup(files: DataFrame, findings: DataFrame, ctx: Context) -> DataFrame:
    """One row of totals."""
    budget = float(DEFAULT_BUDGET if ctx.budget is None else ctx.budget)

    def tokens(tier: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("tier") == tier, F.col("tokens"))), F.lit(0))

    over = F.col("resident_tokens") / F.lit(budget) - 1 if budget > 0 else None
    return (
        wasted(files, findings, ctx.cadence)
        .agg(F.count("*").alias("file_count"), tokens(0).alias("resident_tokens"), tokens(1).alias("reachable_tokens"), tokens(2).alias("ambient_tokens"), js_round(F.coalesce(F.round(F.sum("waste"), 6), F.lit(0.0))).alias("recoverable_tokens"))
        .withColumn("budget", F.lit(budget)).withColumn("over_budget", F.col("resident_tokens") > F.lit(budget))
        .withColumn("overage_pct", F.lit(0).cast("long") if over is None else js_round((F.col("resident_tokens") - F.lit(budget)) / F.lit(budget) * 100))
    )


def best_findings(findings: DataFrame) -> DataFrame:
    """The first of the most confident findings of each path."""
    first = W.partitionBy("path").orderBy(F.desc("confidence"), "det_ord", "emit_ord", "seq")
    return findings.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def top(files: DataFrame, findings: DataFrame, cadence: dict[int, float] = DEFAULT_CADENCE, n: int = TOP) -> DataFrame:
    """The ``n`` files that waste most, with their best finding. The limit comes first, so only their findings are ranked."""
    worst = ranked(files, findings, cadence).limit(n)
    own = findings.join(F.broadcast(worst.select("path")), "path", "left_semi")  # n rows
    return worst.join(best_findings(own).drop("seq"), "path").select("path", "waste", "detector", "confidence", "reason", "suggest", "seq")


def resident_top(files: DataFrame, n: int = TOP) -> DataFrame:
    return files.where("tier = 0").orderBy(F.desc("tokens"), "seq").limit(n).select("path", "tokens", "estimated", "seq")


def by_suggestion(findings: DataFrame) -> DataFrame:
    """(suggest, place, n, files) in the order of the report."""
    place = F.when(F.col("suggest") == "ignore", 0).when(F.col("suggest") == "split", 1).when(F.col("suggest") == "delete", 2).otherwise(3)
    return findings.groupBy("suggest").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files")).withColumn("place", place)


def ignore_additions(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Paths to add to an ignore file whose lines are ``known`` (line)."""
    new = findings.where("suggest = 'ignore'").select("path").distinct()
    return new.join(known.select(F.trim("line").alias("path")), "path", "left_anti").orderBy(F.collate("path", "UNICODE"), "path")
