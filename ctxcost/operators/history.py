"""Commit history of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DAY

CHURN_DAYS = 90
MARK = "\x01"
LINES_AT_ONCE = 1 << 18


def parse_log(lines: DataFrame) -> DataFrame:
    """(path, ts) from (n, line) of a name-only log: a marked line carries the time of the paths that follow.

    One log is one sequence of any length, so it is cut into ranges of about ``LINES_AT_ONCE`` numbers, which are dense in a log (any are right):
    a path takes its time from its own range or, before the first mark there, from the last mark of the ranges before, of which there is a row each.
    """
    n = F.col("n")
    least, most, count = lines.agg(F.min(n), F.max(n), F.count("*")).first()
    ranges = max(1, -(-count // LINES_AT_ONCE))
    width = 1 if least is None else max(1, -(-(most - least + 1) // ranges))
    place = F.coalesce(F.floor((n - F.lit(least)) / F.lit(width)).cast("long"), F.lit(-1))  # lines without a number come first
    rows = lines.withColumn("ts", F.when(F.col("line").startswith(MARK), F.substring("line", 2, 20).cast("long"))).withColumn("__range", place)
    repo = [c for c in ("repo",) if c in lines.columns]
    rows = rows.repartition(ranges, *repo, "__range")  # else how many a task has is left to settings
    order = W.partitionBy(*repo, "__range").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    ends = rows.groupBy(*repo, "__range").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.struct("n"))).alias("__end"))
    before = W.partitionBy(*repo).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    seen = rows.withColumn("ts", F.last("ts", ignorenulls=True).over(order)).where(~F.col("line").startswith(MARK) & (F.col("line") != ""))
    own = ends.select(*(F.col(c).alias(f"__{c}") for c in repo), F.col("__range").alias("__own"), "__before")
    on = F.col("__range") == F.col("__own")
    for c in repo:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = seen.join(own.hint("merge"), on).withColumn("ts", F.coalesce("ts", "__before"))
    return found.where("ts IS NOT NULL").select(F.col("line").alias("path"), "ts")


def history(commits: DataFrame, now: int) -> DataFrame:
    """(path, last_commit, commits_90d) in one pass over (path, ts); commits_90d is null where there was none."""
    recent = F.count_if(F.col("ts") >= now - CHURN_DAYS * DAY)
    return commits.groupBy("path").agg(F.max("ts").alias("last_commit"), F.nullif(recent, F.lit(0)).alias("commits_90d"))
