"""Tables in the shared folder, and joins with sides of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import clean, fresh_dir, remove, shared_dir, written

__all__ = ["BROADCAST_KEYS", "clean", "few", "fresh_dir", "remove", "shared_dir", "without", "written"]

#: A side of a join up to this number of rows of one long is sent to every executor (some 16 MB); a larger one is shuffled.
BROADCAST_KEYS = 500_000


def few(side: DataFrame) -> DataFrame:
    """A written table as a side of a join: sent to every executor up to ``BROADCAST_KEYS`` rows of a few numbers, shuffled beyond that."""
    return F.broadcast(side) if side.count() <= BROADCAST_KEYS else side


def without(docs: DataFrame, on: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``on`` isn't a key of ``gone`` (one column, __cc_gone); where those are few, texts aren't shuffled."""
    gone = written(gone, "gone")
    few = gone.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), on == gone["__cc_gone"], "left_anti")
