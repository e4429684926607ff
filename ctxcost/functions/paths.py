"""POSIX path functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def directories(path: Column) -> Column:
    """The segments but the last."""
    parts = F.split(path, "/", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def extension(path: Column) -> Column:
    """Lower-case, with its dot; empty where the name has none but a leading one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1))


def normalise(path: Column) -> Column:
    """Without empty, ``.`` and ``..`` segments; ``..`` at the root stays there."""
    parts = F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts, empty,
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(folded, "/")


def resolve(raw: Column, origin: Column) -> Column:
    """A reference in the file ``origin``, from the repository's root; null for a home directory."""
    return F.when(raw.startswith("~"), F.lit(None)).when(raw.startswith("/"), normalise(raw)).otherwise(normalise(F.concat(dirname(origin), F.lit("/"), raw)))
