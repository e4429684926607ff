"""Reuse of an earlier scan's work: measures by file, and the signals of a whole tree that hasn't changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
_SAME = ("path", "mtime_ms", "bytes", "kind", "tier")
KEPT = (*_SAME, "tokens", "estimated", "generated_header", "referenced_paths", "content_simhash", "module")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def load(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The measures of a snapshot, or None if there are none or they have another version."""
    found = None if path is None else _read(spark, f"{path}/measures")
    if found is None or "version" not in found.columns or not found.where(F.col("version") != VERSION).isEmpty():
        return None
    return found.select(*KEPT)


def split(files: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their kept measures, misses): a hit has the same path, size, time, kind and tier.

    A file that only has another kind or tier is a miss that needn't be parsed again: known is its module.
    """
    old = snapshot.select(*(F.col(c).alias(f"__old_{c}") for c in KEPT))
    both = files.join(old, [files[c] == old[f"__old_{c}"] for c in ("path", "bytes", "mtime_ms")], "left")
    hit = F.coalesce((F.col("kind") == F.col("__old_kind")) & (F.col("tier") == F.col("__old_tier")), F.lit(False))
    hits = both.where(hit).select(*files.columns, *(F.col(f"__old_{c}").alias(c) for c in KEPT if c not in _SAME))
    return hits, both.where(~hit).select(*files.columns, F.col("__old_module").alias("known"))


def save(measured: DataFrame, path: str) -> None:
    """Writes the measures, no text, beside the scanned tree's results and never inside it."""
    measured.select(F.lit(VERSION).alias("version"), *KEPT).write.mode("overwrite").parquet(f"{path}/measures")


def load_signals(spark: SparkSession, path: str | None, key: str) -> DataFrame | None:
    """What an unchanged tree's files are but for their history, if the last scan had the same ``key``."""
    found = None if path is None else _read(spark, f"{path}/signals")
    return None if found is None or found.where(F.col("key") == key).isEmpty() else found.drop("key")


def save_signals(signals: DataFrame, path: str, key: str) -> None:
    signals.withColumn("key", F.lit(key)).write.mode("overwrite").parquet(f"{path}/signals")
