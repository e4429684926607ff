"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards, written where the rows are, without a shuffle. Compaction
takes runs of similar size, at least ``min_runs`` of them, and merges them into shards of about the target size;
a shard of half the target or more is finished. Every change is a new manifest, a file that must not exist
before: readers see one version or the next, never a mixture, and of two writers one retries. Shards that a
lost task leaves behind are in no manifest and go with ``vacuum``.

Defined cases: rows are kept as they are, with nulls, repeats and extra columns; an empty append is a version
without new shards; all appends have one schema; a table without shards reads as an empty frame of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
ARRIVAL_BYTES = 4 << 20
_GROUP_BYTES = 16 << 20
_REPORT = "name string, rows long, bytes long, replaces array<string>"


@dataclass(frozen=True)
class Shard:
    name: str
    rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class _Writer:
    """One shard file; rows are gathered into row groups."""

    def __init__(self, root: str, schema: pa.Schema):
        fs, base = pafs.FileSystem.from_uri(root)
        self.name = f"shard-{uuid.uuid4().hex}.parquet"
        self.sink = fs.open_output_stream(f"{base}/{self.name}")
        self.writer = pq.ParquetWriter(self.sink, schema, compression="zstd")
        self.held: list[pa.RecordBatch] = []
        self.size = self.rows = 0

    def add(self, batch: pa.RecordBatch, group_bytes: int) -> None:
        self.held.append(batch)
        self.size += batch.nbytes
        self.rows += batch.num_rows
        if self.size >= group_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held))
            self.held, self.size = [], 0

    def close(self) -> tuple[str, int, int]:
        self.flush()
        self.writer.close()
        size = self.sink.tell()
        self.sink.close()
        return self.name, self.rows, size


def _report(rows: list[tuple[str, int, int, list[str]]]) -> pa.RecordBatch:
    name, n, size, old = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(old, pa.list_(pa.string()))], ["name", "rows", "bytes", "replaces"])


def merges(shards: tuple[Shard, ...], target: int, min_runs: int, max_runs: int, small: int) -> list[list[Shard]]:
    """Groups of runs to merge: within a tier of similar sizes (half to one and a half times its mean, or all below ``small``), in order of size, up to the target."""
    tiers: list[list[Shard]] = []
    for s in sorted((s for s in shards if s.bytes < target // 2), key=lambda s: (s.bytes, s.name)):
        if tiers and (s.bytes < small or s.bytes <= 1.5 * sum(x.bytes for x in tiers[-1]) / len(tiers[-1])):
            tiers[-1].append(s)
        else:
            tiers.append([s])
    out = []
    for tier in tiers:
        if len(tier) < min_runs:
            continue
        group: list[Shard] = []
        for s in tier:
            if group and (len(group) == max_runs or sum(x.bytes for x in group) + s.bytes > target):
                out.append(group)
                group = []
            group.append(s)
        if len(group) > 1:
            out.append(group)
    return [g for g in out if len(g) > 1]


class ShardTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for d in ("manifests", "shards"):
            self._fs.mkdirs(self._path(f"{self.root}/{d}"))

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        known = self.versions()
        if not known or version is not None and version not in known:
            return None
        text = self._read(f"{self.root}/manifests/v{version or known[-1]:012d}.json")
        x = json.loads(text)
        return Manifest(x["version"], x["schema"], tuple(Shard(**s) for s in x["shards"]))

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, manifest: Manifest) -> bool:
        """Makes the manifest the next version, or returns False if there is one of that number already."""
        jvm = self.spark.sparkContext._jvm
        draft = f"{self.root}/manifests/draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(self._path(draft), self._path(f"{self.root}/manifests/v{manifest.version:012d}.json"), none)
            return True
        except Exception as e:
            self._fs.delete(self._path(draft), False)
            if "FileAlreadyExists" in str(e) or "exists" in str(e):
                return False
            raise

    def append(self, df: DataFrame, arrival_bytes: int = ARRIVAL_BYTES) -> Manifest:
        """Adds the rows of ``df`` as shards of about ``arrival_bytes``."""
        shards_at = f"{self.root}/shards"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, done = None, []
            for b in batches:
                step = max(1, min(b.num_rows, (1 << 20) * b.num_rows // max(1, b.nbytes)))
                for i in range(0, b.num_rows, step):
                    w = w or _Writer(shards_at, b.schema)
                    w.add(b.slice(i, step), arrival_bytes)
                    if not w.held and w.sink.tell() >= arrival_bytes // 2:
                        done.append((*w.close(), []))
                        w = None
            if w:
                done.append((*w.close(), []))
            if done:
                yield _report(done)

        new = [Shard(r["name"], r["rows"], r["bytes"]) for r in df.mapInArrow(run, _REPORT).collect()]
        while True:
            old = self.manifest()
            if old and T.StructType.fromJson(json.loads(old.schema)) != df.schema:
                raise ValueError("the table has another schema")
            next_ = Manifest((old.version if old else 0) + 1, df.schema.json(), (old.shards if old else ()) + tuple(sorted(new, key=lambda s: s.name)))
            if self.commit(next_):
                return next_

    def compact(self, target: int = TARGET_BYTES, min_runs: int = 4, max_runs: int = 32, small: int = ARRIVAL_BYTES) -> Manifest | None:
        """Merges runs until no tier has enough; all merges of a round are one job, a task each."""
        shards_at = f"{self.root}/shards"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for names in b.column("names").to_pylist():
                    fs, base = pafs.FileSystem.from_uri(shards_at)
                    w = None
                    for n in names:
                        with fs.open_input_file(f"{base}/{n}") as f:
                            for x in pq.ParquetFile(f).iter_batches(batch_size=2048):
                                w = w or _Writer(shards_at, x.schema)
                                w.add(x, _GROUP_BYTES)
                    if w:
                        yield _report([(*w.close(), names)])

        while True:
            old = self.manifest()
            groups = merges(old.shards, target, min_runs, max_runs, small) if old else []
            if not groups:
                return old
            jobs = self.spark.createDataFrame([(i, [s.name for s in g]) for i, g in enumerate(groups)], "i int, names array<string>")
            made = jobs.repartitionByRange(len(groups), "i").select("names").mapInArrow(run, _REPORT).collect()
            gone = {n for r in made for n in r["replaces"]}
            while True:
                latest = self.manifest()
                assert latest
                names = {s.name for s in latest.shards}
                if not gone <= names:
                    raise RuntimeError("another compaction replaced the same shards")
                kept = tuple(s for s in latest.shards if s.name not in gone)
                if self.commit(Manifest(latest.version + 1, latest.schema, kept + tuple(Shard(r["name"], r["rows"], r["bytes"]) for r in made))):
                    break
            if not made:
                return self.manifest()

    def settled(self, target: int = TARGET_BYTES, min_runs: int = 4, max_runs: int = 32, small: int = ARRIVAL_BYTES) -> bool:
        """Whether no tier has enough runs to merge, no shard is far beyond the target, and each is there with the rows that the manifest says."""
        m = self.manifest()
        if m is None:
            return True
        there = {f.getPath().getName(): f.getLen() for f in self._fs.listStatus(self._path(f"{self.root}/shards"))}
        return not merges(m.shards, target, min_runs, max_runs, small) and all(s.bytes <= 2 * target and there.get(s.name) == s.bytes for s in m.shards) and self.read().count() == sum(s.rows for s in m.shards)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the manifests but the last ``keep``, and the shards that none of those names. Not while a writer is at work."""
        known = self.versions()
        live = {s.name for v in known[-keep:] for s in self.manifest(v).shards}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:012d}.json"), False)
        dead = [f.getPath() for f in self._fs.listStatus(self._path(f"{self.root}/shards")) if f.getPath().getName() not in live]
        for p in dead:
            self._fs.delete(p, True)
        return len(dead)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m is None:
            raise ValueError("no such version")
        schema = T.StructType.fromJson(json.loads(m.schema))
        if not m.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/shards/{s.name}" for s in m.shards))
