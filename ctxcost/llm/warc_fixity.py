"""WARC fixity audit by Merkle trees over ordered offset ranges.

A record's digest is a leaf's content; a leaf is the ordered list of the records that start in one range of
``RANGE_BYTES`` of a file, an inner node the ordered list of its ``FANOUT`` children, and the root stands for
the whole archive, files in order. Two replicas with equal roots are equal. Otherwise only children of
differing nodes are compared, level by level, and only the records of differing leaves are looked at.

The coordinates are those of the manifest, that is of the first replica: a record that another replica lacks
leaves a gap there and doesn't move what follows. A record that only the other replica has is placed in a leaf
of its own for its file. Trees are written to the shared folder, as an archive keeps them beside its files.

Replicas are either built from a pages table (``stored``) or read from folders of uncompressed WARC files (``read``), each
file mapped into memory and hashed record by record, so that a file's size doesn't matter. Of files, the offsets are the real ones.

Defined cases of files: a record whose stated length doesn't end at a record's end runs to the next record's beginning; what
has no readable header is a record without a page, so that the other replica's is missing and this one extra; an empty file
has no records; a file that one replica lacks is missing record by record.

Defined cases: a null url or html is empty; null page ids share the file -1; several records of one page are
numbered by url and digest; two empty replicas agree; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import written

RECORDS_PER_FILE = 1024
RANGE_BYTES = 1 << 18
FANOUT_BITS = 4
LISTED = 256
_BLOCK = 1 << 20
_NEXT = b"\r\n\r\nWARC/"
_COLUMNS = "file long, page_id long, url string, offset long, length long, digest string"


def record(html: Column | str = "html") -> Column:
    """The bytes of a page's WARC response record."""
    html = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def stored(pages: DataFrame, content: Column | None = None) -> DataFrame:
    """(file, page_id, n, length, digest) of a replica's records; only these leave the scan."""
    bytes_ = record() if content is None else content
    rows = pages.select(
        F.coalesce(F.expr(f"page_id div {RECORDS_PER_FILE}"), F.lit(-1)).alias("file"),
        "page_id", F.coalesce("url", F.lit("")).alias("url"), bytes_.alias("bytes"),
    )
    rows = rows.select("file", "page_id", "url", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    return _numbered(rows).select("file", "page_id", "n", "length", "digest")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy("file", "page_id").orderBy("url", "digest")).cast("long"))


def _page(record_id: bytes) -> int | None:
    """The number in an id of ``record``, or 63 bits of any other id's hash."""
    own = re.fullmatch(rb"<urn:page:(-?\d{0,18})>", record_id)
    if own:
        return int(own[1]) if own[1] not in (b"", b"-") else None
    return int.from_bytes(hashlib.sha256(record_id).digest()[:8]) >> 1


def cut(data: bytes | mmap.mmap) -> Iterator[tuple[int, int, int | None, str]]:
    """(offset, length, page, url) of the records of a WARC file, which cover it without gaps."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        fields = {}
        if head >= 0 and data[at : at + 5] == b"WARC/":
            for line in bytes(data[at:head]).split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.strip().lower()] = value.strip()
        size = fields.get(b"content-length", b"")
        end = head + 4 + int(size) + 4 if size.isdigit() and len(size) < 19 else -1
        if end < 0 or end > len(data) or data[end - 4 : end] != b"\r\n\r\n" or end < len(data) and data[end : end + 5] != b"WARC/":
            following = data.find(_NEXT, head if fields else at)
            end = following + 4 if following >= 0 else len(data)
        page = _page(fields[b"warc-record-id"]) if b"warc-record-id" in fields else None
        yield at, end - at, page, fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")
        at = end


def names(*folders: str) -> list[str]:
    """The names of all WARC files of some replicas, in order; a file's number is its place here."""
    return sorted({name for folder in folders for name in os.listdir(folder) if name.endswith(".warc")})


def read(spark: SparkSession, folder: str, of: list[str]) -> DataFrame:
    """(file, page_id, n, offset, length, digest) of the records of the files ``of`` in ``folder``, which all executors must see."""
    files = spark.createDataFrame([(k, os.path.join(folder, name)) for k, name in enumerate(of)], "file long, path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])
        for b in batches:
            for file, path in zip(b.column("file").to_pylist(), b.column("path").to_pylist()):
                if not os.path.exists(path) or not os.path.getsize(path):
                    continue
                held = []
                with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                    for at, length, page, url in cut(data):
                        digest = hashlib.sha256()
                        for i in range(at, at + length, _BLOCK):
                            digest.update(data[i : min(i + _BLOCK, at + length)])
                        held.append((file, page, url, at, length, digest.hexdigest()))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return _numbered(files.repartition(max(1, len(of))).mapInArrow(run, _COLUMNS)).select("file", "page_id", "n", "offset", "length", "digest")


def manifest(records: DataFrame) -> DataFrame:
    """``records`` with the offset of each in its file."""
    before = W.partitionBy("file").orderBy("page_id", "n").rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def placed(records: DataFrame, at: DataFrame) -> DataFrame:
    """Another replica's records at the offsets of the manifest, -1 for those that it doesn't have."""
    known = at.select("file", "page_id", "n", "offset")
    same = F.col("r.file").eqNullSafe(F.col("m.file")) & F.col("r.page_id").eqNullSafe(F.col("m.page_id")) & (F.col("r.n") == F.col("m.n"))
    return records.alias("r").join(known.alias("m"), same, "left").select("r.*", F.coalesce("m.offset", F.lit(-1)).alias("offset"))


def _leaf(bits: int) -> Column:
    """A record's leaf: its file, then its range; range 0 is for records without an offset."""
    return F.shiftleft(F.col("file") + 1, bits) + F.when(F.col("offset") < 0, F.lit(0)).otherwise(F.expr(f"offset div {RANGE_BYTES}") + 1)


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda x: F.concat_ws(":", *(x[f].cast("string") for f in ("i", "j", "k", "h")))), "|"), 256)


def tree(records: DataFrame, bits: int, levels: int) -> list[DataFrame]:
    """Tables of (node, hash) from the leaves, level 0, to the root; each is made from the one below, and leaves are kept in order."""
    def part(i: Column, j: Column, k: Column, h: str) -> Column:
        return F.collect_list(F.struct(i.alias("i"), j.alias("j"), k.alias("k"), F.col(h).alias("h")))

    no = F.lit(0).cast("long")
    leaves = records.groupBy(_leaf(bits).alias("node")).agg(_joined(part(F.col("offset"), F.coalesce("page_id", F.lit(-1)), F.col("n"), "digest")).alias("hash"))
    out = [written(leaves.repartitionByRange("node").sortWithinPartitions("node"), "merkle-0")]
    for level in range(1, levels + 1):
        out.append(written(out[-1].groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(_joined(part(F.col("node"), no, no, "hash")).alias("hash")), f"merkle-{level}"))
    return out


def shape(*replicas: DataFrame) -> tuple[int, int]:
    """(bits of a range's number within its file, levels above the leaves)."""
    top = [r.agg(F.max("offset"), F.max("file")).first() for r in replicas]
    ranges = max((t[0] or 0) // RANGE_BYTES + 2 for t in top)
    bits = -(-max(1, (ranges - 1).bit_length()) // FANOUT_BITS) * FANOUT_BITS
    last = ((max(t[1] if t[1] is not None else 0 for t in top) + 2) << bits) - 1
    return bits, -(-last.bit_length() // FANOUT_BITS)


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(node) of the leaves that differ, found from the root down through differing nodes only.

    Up to ``LISTED`` nodes are a filter of the scan below, which skips what lies outside of their range; more are joined.
    """
    none = F.lit(None).cast("string")
    few: list[int] | None = None
    bad = a[0].select("node").limit(0)
    for level in range(len(a) - 1, -1, -1):
        x, y = a[level].select("node", F.col("hash").alias("x"), none.alias("y")), b[level].select("node", none.alias("x"), F.col("hash").alias("y"))
        both = x.unionByName(y)
        if few is not None:
            both = both.where(F.col("node").isin([n << FANOUT_BITS | i for n in few for i in range(1 << FANOUT_BITS)]))
        elif level < len(a) - 1:
            both = both.join(bad.select(F.col("node").alias("parent")), F.shiftright("node", FANOUT_BITS) == F.col("parent"), "left_semi")
        bad = written(both.groupBy("node").agg(F.max("x").alias("x"), F.max("y").alias("y")).where(~F.col("x").eqNullSafe(F.col("y"))).select("node"), "differing")
        found = [r.node for r in bad.limit(LISTED + 1).collect()]
        few = found if len(found) <= LISTED else None
        if not found:
            break
    return bad


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, offset, length, page_id, n, status) of the records that differ between two replicas given by ``stored`` or both by ``read``.

    status: ``corrupt`` (same length, other content), ``resized``, ``missing`` in the second, or ``extra`` in it;
    length is the first replica's, or the extra record's; offset is null for extra ones.
    """
    a = written(first if "offset" in first.columns else manifest(first), "replica-a")
    b = written(placed(second.drop("offset"), a), "replica-b")
    bits, levels = shape(a, b)
    bad = differing(tree(a, bits, levels), tree(b, bits, levels))
    x, y = (r.withColumn("node", _leaf(bits)).join(bad, "node", "left_semi") for r in (a, b))
    same = (F.col("x.file") == F.col("y.file")) & F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.n") == F.col("y.n"))
    status = F.when(F.col("y.digest").isNull(), "missing").when(F.col("x.digest").isNull(), "extra").when(F.col("x.length") != F.col("y.length"), "resized").otherwise("corrupt")
    return x.alias("x").join(y.alias("y"), same, "full").where(~F.col("x.digest").eqNullSafe(F.col("y.digest"))).select(
        F.coalesce("x.file", "y.file").alias("file"), F.col("x.offset").alias("offset"), F.coalesce("x.length", "y.length").alias("length"),
        F.coalesce("x.page_id", "y.page_id").alias("page_id"), F.coalesce("x.n", "y.n").alias("n"), status.alias("status"),
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` with faults for a drill: of each 256 records, by the hash of their page, one has an altered byte, one lost its last byte, and one is gone."""
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    whole = record()
    content = F.when(mark == "a7", F.concat(F.lit("X"), F.expr("substring(__cc_bytes, 2)"))).when(mark == "b3", F.expr("left(__cc_bytes, length(__cc_bytes) - 1)")).otherwise(F.col("__cc_bytes"))
    rows = pages.select("page_id", "url", whole.alias("__cc_bytes")).where(mark != "c9")
    return stored(rows, content)
