"""Context tiers: 0 resident, 1 reachable, 2 ambient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds, paths
from .reach import reachable


def imports(text: Column) -> Column:
    """Targets of ``@file.md`` imports."""
    return F.regexp_extract_all(text, F.lit("@([^\\s()<>\"'`]+\\.mdx?)"), F.lit(1))


def import_edges(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst) between known paths, from (path, text)."""
    raw = texts.select(F.col("path").alias("src"), F.explode(imports(F.col("text"))).alias("raw"))
    to = raw.select("src", paths.resolve(F.col("raw"), F.col("src")).alias("dst")).where("dst IS NOT NULL AND dst <> ''")
    return to.join(known.select(F.col("path").alias("dst")), "dst", "left_semi").distinct()


def tier_of(kind: Column, resident: Column) -> Column:
    return F.when(resident, 0).when(kind.isin("vendored", "generated"), 2).otherwise(1)


def assign(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``files`` (path, kind, …) with their tier; ``texts`` (path, text) are whole files."""
    seeds = files.where(kinds.is_resident_name(F.col("path"))).select(F.col("path").alias("node"))
    resident = reachable(seeds, import_edges(texts, files)).select(F.col("node").alias("path"), F.lit(True).alias("__resident"))
    return files.join(resident, "path", "left").withColumn("tier", tier_of(F.col("kind"), F.coalesce("__resident", F.lit(False)))).drop("__resident")
