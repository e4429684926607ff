"""Commit times of paths, from git."""

from __future__ import annotations

import subprocess
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.history import MARK


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.decode("utf-8", "replace")


def is_repository(root: str) -> bool:
    return (_git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def parse_name_only(text: str) -> list[tuple[str, int]]:
    """(path, ts) of a log whose commits are a mark with their time, then their paths, NUL between."""
    out, ts = [], None
    for part in text.replace("\n", "\0").split("\0"):
        if part.startswith(MARK):
            ts = int(part[1:]) if part[1:].isdigit() else None
        elif part and ts is not None:
            out.append((part, ts))
    return out


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(path, ts) of every change but deletions, relative to ``root``; empty without git or commits. ``-z`` keeps paths as they are."""
    log = None
    if is_repository(root) and _git(root, "rev-parse", "--verify", "HEAD") is not None:
        log = _git(root, "log", "-z", "--relative", "--name-only", "--diff-filter=d", f"--format={MARK}%ct")
        if log is None:
            warnings.warn(f"git log failed in {root}; files count as untracked", stacklevel=2)
    rows = parse_name_only(log or "")
    table = pa.table([pa.array([p for p, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.int64())], names=["path", "ts"])
    return spark.createDataFrame(table, "path string, ts long")
