"""Types and constants of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

KINDS = ("source", "generated", "vendored", "doc", "fixture", "binary")
SUGGESTIONS = ("ignore", "split", "delete", "review")
DEFAULT_BUDGET = 3000
DEFAULT_CADENCE = {0: 1.0, 1: 0.15, 2: 0.05}
DAY = 86_400

FILES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("abs_path", T.StringType()),
    T.StructField("bytes", T.LongType()), T.StructField("mtime_ms", T.DoubleType()),
])

RECORDS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()),
    T.StructField("tokens", T.LongType()), T.StructField("estimated", T.BooleanType()), T.StructField("kind", T.StringType()),
    T.StructField("tier", T.IntegerType()), T.StructField("last_commit", T.LongType()), T.StructField("commits_90d", T.LongType()),
    T.StructField("generated_header", T.BooleanType()), T.StructField("referenced_paths", T.ArrayType(T.StringType())),
    T.StructField("content_simhash", T.LongType()), T.StructField("orphan_module", T.BooleanType()),
    T.StructField("dead_export_symbols", T.ArrayType(T.StringType())),
])

FINDINGS = T.StructType([
    T.StructField("det_ord", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("emit_ord", T.LongType()),
    T.StructField("path", T.StringType()), T.StructField("detector", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("reason", T.StringType()), T.StructField("suggest", T.StringType()),
])

_USE = [T.StructField("source", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))]
MODULE = T.StructType([
    T.StructField("imports", T.ArrayType(T.StructType([*_USE, T.StructField("namespace", T.BooleanType())]))),
    T.StructField("reexports", T.ArrayType(T.StructType([*_USE, T.StructField("star", T.BooleanType())]))),
    T.StructField("exported_names", T.ArrayType(T.StringType())),
])

ALIASES = "config_ord int, rule_ord int, base_url string, pattern string, target string"


@dataclass(frozen=True)
class Context:
    """What detectors may read besides the files."""

    root: str = "."
    git_available: bool = False
    budget: float | None = None
    now: int | None = None
    cadence: dict[int, float] = field(default_factory=lambda: dict(DEFAULT_CADENCE))
    package_entrypoints: tuple[str, ...] = ()
