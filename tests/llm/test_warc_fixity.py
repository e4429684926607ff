import random

import pytest
from pyspark.sql import functions as F

from ctxcost.llm import warc_fixity as wf

from .conftest import prose

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(51)
    return [(i, f"https://example.org/{i}", prose(rng, rng.randint(1, 30))) for i in range(5000)] + [(9000, "u", "x" * 2_000_000)]


def table(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def audit(spark, a, b):
    return {(r.file, r.page_id, r.n): (r.status, r.offset, r.length) for r in wf.audit(wf.stored(table(spark, a)), wf.stored(table(spark, b))).collect()}


def size(row):
    """Length of a record, written out."""
    page, url, html = row
    body = (html or "").encode()
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body)}\r\n\r\n"
    return len(head.encode()) + len(body) + 4


def test_faults_are_located(spark, rows):
    rng = random.Random(52)
    hurt = rng.sample(range(5000), 40)
    changed = {i: kind for i, kind in zip(hurt, ("corrupt", "resized", "missing", "corrupt") * 10)}
    other = []
    for r in rows:
        kind = changed.get(r[0])
        if kind == "missing":
            continue
        html = r[2]
        if kind == "corrupt":
            k = rng.randrange(len(html))
            html = html[:k] + ("#" if html[k] != "#" else "$") + html[k + 1 :]
        elif kind == "resized":
            html += "!"
        other.append((r[0], r[1], html))
    other += [(4000, rows[4000][1] + "/zz", "more"), (12_345, "new", "page")]
    rng.shuffle(other)
    got = audit(spark, rows, other)
    want = {}
    offset, file = 0, -1
    for r in rows:
        if r[0] // wf.RECORDS_PER_FILE != file:
            file, offset = r[0] // wf.RECORDS_PER_FILE, 0
        if r[0] in changed:
            want[file, r[0], 1] = (changed[r[0]], offset, size(r))
        offset += size(r)
    want[4000 // wf.RECORDS_PER_FILE, 4000, 2] = ("extra", None, size((4000, rows[4000][1] + "/zz", "more")))
    want[12_345 // wf.RECORDS_PER_FILE, 12_345, 1] = ("extra", None, size((12_345, "new", "page")))
    assert got == want


def test_only_differing_branches_are_descended(spark, rows):
    a = wf.manifest(wf.stored(table(spark, rows)))
    b = a.withColumn("digest", F.when(F.col("page_id") == 77, F.lit("other")).otherwise(F.col("digest")))
    bits, levels = wf.shape(a, b)
    x, y = wf.tree(a, bits, levels), wf.tree(b, bits, levels)
    assert len(x) == len(y) == levels + 1
    assert len(wf.differing(x, y).collect()) == 1
    for level in range(levels + 1):
        assert x[level].alias("x").join(y[level].alias("y"), "node").where("x.hash <> y.hash").count() == 1
    assert x[-1].count() == 1 and x[0].count() > 10


def test_many_differing_nodes_are_joined(spark, rows, monkeypatch):
    other = [(i, u, t if i % 50 else t + "!") for i, u, t in rows]
    want = audit(spark, rows, other)
    monkeypatch.setattr(wf, "LISTED", 2)
    assert audit(spark, rows, other) == want and len(want) == 101


def test_ties_in_a_damaged_replica(spark):
    """Records of one page with one url and one content are told by their number alone; a lost one is the last."""
    rows = [(7, "u", "same"), (7, "u", "same"), (7, "u", "same"), (8, "u", "same")]
    assert {k: v[0] for k, v in audit(spark, rows, rows[1:]).items()} == {(0, 7, 3): "missing"}
    pages = table(spark, [(i % 40, "u", "same") for i in range(4000)])
    statuses = {r.status for r in wf.audit(wf.stored(pages), wf.damaged(pages)).collect()}
    assert statuses <= {"corrupt", "resized", "missing"}


def test_equal_and_empty_replicas_agree(spark, rows):
    assert audit(spark, rows, rows[::-1]) == {}
    assert audit(spark, [], []) == {}
    assert {v[0] for v in audit(spark, rows[:5], []).values()} == {"missing"}
    assert {v[0] for v in audit(spark, [], rows[:5]).values()} == {"extra"}


def test_odd_rows(spark):
    a = [(None, None, None), (None, "u", ""), (1, None, "x"), (1, None, "x"), (1, "v", None), (2, "w", "é" * 100_000), (-5, "n", "neg")]
    assert audit(spark, a, a) == {}
    got = audit(spark, a, [r for r in a if r[0] is not None])
    assert {(k[0], k[1], v[0]) for k, v in got.items()} == {(-1, None, "missing")} and len(got) == 2
    extra = table(spark, a).withColumn("digest", F.lit("z")).withColumn("file", F.lit(7)).withColumn("n", F.lit(3)).withColumn("offset", F.lit(1)).withColumn("bytes", F.lit(b"q"))
    assert wf.audit(wf.stored(extra), wf.stored(table(spark, a))).collect() == []


def test_the_drill_damages_what_it_says(spark, rows):
    pages = table(spark, rows)
    got = [r.status for r in wf.audit(wf.stored(pages), wf.damaged(pages)).collect()]
    marks = pages.select(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2).alias("m")).where("m IN ('a7', 'b3', 'c9')").groupBy("m").count().collect()
    want = {{"a7": "corrupt", "b3": "resized", "c9": "missing"}[r.m]: r["count"] for r in marks}
    assert {s: got.count(s) for s in set(got)} == want and len(want) == 3


def test_cut_covers_any_bytes():
    """Records follow one another without gaps, whatever the bytes are."""
    rng = random.Random(31)
    one = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(wf.cut(one + one)) == [(0, len(one), 7, ""), (len(one), len(one), 7, "")]
    assert list(wf.cut(b"")) == []
    for _ in range(300):
        data = bytearray(one * 4)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(data))
            data[k : k + rng.randint(0, 2)] = bytes(rng.choices(b"x\r\n9W", k=rng.randint(0, 2)))
        at = 0
        for start, length, _, _ in wf.cut(bytes(data)):
            assert start == at and length > 0
            at += length
        assert at == len(data)


def test_files_are_audited(spark, tmp_path):
    """Replicas as WARC files: read back they're what ``stored`` says, and each planted fault is found where it is."""
    rows = [(i, f"http://h/{i}", f"<p>{i}\r\n\r\n" + "é" * (i % 50)) for i in range(3000)] + [(5, "http://h/again", None), (None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = pages.select(F.coalesce(F.expr(f"page_id div {wf.RECORDS_PER_FILE}"), F.lit(9)).alias("file"), "page_id", "url", wf.record().cast("binary").alias("b"))
    files = {}
    for r in sorted(records.collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.url or "")):
        files.setdefault(f"{r.file}.warc", []).append((r.page_id, bytes(r.b)))
    x, y = tmp_path / "x", tmp_path / "y"
    x.mkdir(), y.mkdir()
    for name, parts in files.items():
        (x / name).write_bytes(b"".join(b for _, b in parts))
        harmed = []
        for page, b in parts:
            if page == 700:
                b = b[:-6] + b"!" + b[-5:]
            elif page == 1500:
                b = b[:-5] + b[-4:]
            elif page == 1501:
                continue
            harmed.append(b)
        if name != "9.warc":
            (y / name).write_bytes(b"".join(harmed))
    (y / "a.warc").write_bytes(b"")
    of = wf.names(str(x), str(y))
    first = wf.read(spark, str(x), of)
    known = {tuple(r) for r in wf.manifest(wf.stored(pages)).where("page_id IS NOT NULL").select("file", "page_id", "n", "offset", "length", "digest").collect()}
    assert {tuple(r) for r in first.where("page_id IS NOT NULL").collect()} == known and len(known) == 3001
    got = {(r.page_id, r.status) for r in wf.audit(first, wf.read(spark, str(y), of)).collect()}
    assert got == {(700, "corrupt"), (1500, "resized"), (1501, "missing"), (None, "missing")}
    assert wf.audit(first, wf.read(spark, str(x), of)).collect() == []
