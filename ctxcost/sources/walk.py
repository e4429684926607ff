"""Files of a source tree, as a Spark data source that no ignore file's author can surprise.

Spark's own file sources drop names that begin with ``.`` or ``_``, which here are content. Directories are read
breadth first and in the order of their names, so ``seq`` is the same on every machine; ignored directories are
pruned. The listing is on the driver, as it must see one tree in one order; contents are read by the executors.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ignore_rules
from ..schema import FILES

ROWS_A_TASK = 2000
IGNORE_FILES = (".gitignore", ".claudeignore", ".cursorignore")


@dataclass(frozen=True)
class Limits:
    depth: int = 64
    files: int = 200_000
    file_bytes: int = 64 << 20
    total_bytes: int = 2 << 30


@dataclass(frozen=True)
class Found:
    path: str
    abs_path: str
    bytes: int
    mtime_ms: float


@dataclass
class _Dir:
    real: str
    rel: str
    depth: int
    rules: list[ignore_rules.Rule]


def _inside(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip(os.sep) + os.sep)


def _read(d: _Dir, root: str, limits: Limits) -> tuple[list[Found], list[_Dir]]:
    try:
        names = sorted(os.listdir(d.real))
    except OSError:
        return [], []
    rules = d.rules
    for name in IGNORE_FILES:
        if name in names:
            try:
                with open(os.path.join(d.real, name), encoding="utf-8", errors="replace", newline="") as f:
                    rules = rules + ignore_rules.parse(f.read(), d.rel)
            except OSError:
                pass
    files, below = [], []
    for name in names:
        rel, at = f"{d.rel}/{name}" if d.rel else name, os.path.join(d.real, name)
        try:
            own = os.lstat(at)
            if stat.S_ISLNK(own.st_mode):
                at = os.path.realpath(at, strict=True)
                if not _inside(at, root):
                    continue
                own = os.stat(at)
        except OSError:
            continue
        is_dir = stat.S_ISDIR(own.st_mode)
        if ignore_rules.ignores(rules, rel, is_dir):
            continue
        if is_dir:
            if d.depth < limits.depth:
                below.append(_Dir(at, rel, d.depth + 1, rules))
        elif stat.S_ISREG(own.st_mode) and own.st_size <= limits.file_bytes:
            files.append(Found(rel, at, own.st_size, own.st_mtime_ns / 1e6))
    return files, below


def walk(root: str, limits: Limits = Limits()) -> Iterator[Found]:
    """The files to measure, in discovery order. One that would pass the total size is left out, and smaller ones may follow."""
    top = os.path.realpath(root)
    seen, level = {top}, [_Dir(top, "", 0, ignore_rules.baseline())]
    count = total = 0
    while level:
        after = []
        for d in level:
            files, below = _read(d, top, limits)
            for f in files:
                if count >= limits.files:
                    return
                if total + f.bytes <= limits.total_bytes:
                    count, total = count + 1, total + f.bytes
                    yield f
            for b in below:
                if b.real not in seen:
                    seen.add(b.real)
                    after.append(b)
        level = after


def listing(root: str, limits: Limits = Limits()) -> pa.Table:
    """``FILES`` rows; at most ``limits.files``."""
    rows = list(walk(root, limits))
    columns = [list(range(len(rows))), [f.path for f in rows], [f.abs_path for f in rows], [f.bytes for f in rows], [f.mtime_ms for f in rows]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64()))], names=FILES.fieldNames())


def files(spark: SparkSession, listed: pa.Table) -> DataFrame:
    """A listing as a DataFrame, spread by path."""
    return spark.createDataFrame(listed, FILES).repartition(max(1, min(listed.num_rows // ROWS_A_TASK + 1, 10_000)), "path")


#: Bytes of files that a task holds at a time.
_HELD = 16 << 20


def _bytes(path: str, most: int | None, second: int | None) -> tuple[bytes | None, bytes | None]:
    """A file whole, or its first ``most`` bytes and as many from ``second`` on; None for an unreadable one."""
    try:
        with open(path, "rb") as f:
            if most is None:
                return f.read(), None
            head = f.read(most)
            if second is None:
                return head, None
            f.seek(second)
            return head, f.read(most)
    except OSError:
        return None, None


def with_content(listed: DataFrame, wanted: Column, most: Column | None = None, second: Column | None = None) -> DataFrame:
    """``listed`` with bytes of the files that ``wanted`` picks: all (content) or, where ``most`` is not null, their first ``most``
    and as many from ``second`` on (content, middle). Null for others and unreadable ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want, most_, second_, where = (b.column(c).to_pylist() for c in ("__want", "__most", "__second", "abs_path"))
            rest = b.drop_columns(["__want", "__most", "__second"])
            content: list[tuple[bytes | None, bytes | None]] = []
            begin = held = 0
            for i in range(b.num_rows + 1):
                if i and (i == b.num_rows or held > _HELD):
                    part = rest.slice(begin, i - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[k] for x in content], pa.binary()) for k in (0, 1))], [*part.schema.names, "content", "middle"])
                    begin, held, content = i, 0, []
                if i < b.num_rows:
                    content.append(_bytes(where[i], most_[i], second_[i]) if want[i] else (None, None))
                    held += sum(len(x) for x in content[-1] if x)

    none = F.lit(None)
    named = listed.withColumns({"__want": wanted, "__most": (none if most is None else most).cast("int"), "__second": (none if second is None else second).cast("long")})
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)
    return named.mapInArrow(run, f"{columns}, content binary, middle binary")
