import re

import pytest
from pyspark.sql import functions as F

from ctxcost.operators import detect, score, snapshot
from ctxcost.schema import DAY, RECORDS, Context

NOW = 1_700_000_000


@pytest.fixture(scope="session")
def records(spark):
    def build(rows):
        """Rows are changes to a file of a hundred tokens."""
        base = {f: None for f in RECORDS.fieldNames()} | {"bytes": 100, "tokens": 100, "estimated": False, "kind": "source", "tier": 1}
        return spark.createDataFrame([{**base, "seq": i, "path": f"f{i}", **r} for i, r in enumerate(rows)], RECORDS)

    return build


def run(name, df, **ctx):
    return [r.asDict() for r in detect.DETECTORS[name](df, Context(now=NOW, **ctx)).orderBy("seq", "emit_ord").collect()]


def test_generated(records):
    got = run("generated", records([{"kind": "generated"}, {"kind": "generated", "generated_header": True}, {}]))
    assert [(r["confidence"], r["suggest"]) for r in got] == [(0.75, "ignore"), (0.97, "ignore")]


def test_vendored(records):
    v = {"kind": "vendored"}
    got = run("vendored", records([v, {**v, "last_commit": 1_600_000_000}, {**v, "last_commit": 1_600_000_000, "commits_90d": 3}, {}]))
    assert [r["confidence"] for r in got] == [0.7, 0.9, 0.45] and "untracked" in got[0]["reason"] and "hand-patched" in got[2]["reason"]


def test_overweight(records):
    df = records([{"tier": 0, "tokens": n} for n in (200, 300, 301, 900, 5000)] + [{"tier": 1, "tokens": 900}])
    got = run("t0-overweight", df, budget=1000)
    assert [r["path"] for r in got] == ["f2", "f3", "f4"] and "~90% of the 1000-token" in got[1]["reason"] and got[2]["confidence"] == 0.95
    assert [r["path"] for r in run("t0-overweight", df)] == ["f4"]


def test_outliers(records):
    rows = [{"tokens": n, "path": f"source-{n - 1}"} for n in range(1, 100)] + [{"tokens": 100_000, "path": "source-99"}]
    got = run("bloat-outlier", records(rows + [{"kind": "binary", "tokens": 9}] * 50 + [{"kind": "doc", "tokens": 5000}] * 2))
    assert [(r["path"], round(r["confidence"], 9)) for r in got] == [("source-98", 0.5), ("source-99", 0.9)]
    assert "100000 tok is in the top 1% of source files in this repo (~100000 tok" in got[1]["reason"]
    ties = run("bloat-outlier", records([{"tokens": 7}] * 25))
    assert len(ties) == 25 and all(r["confidence"] == pytest.approx(0.9) for r in ties)


def test_stale(records):
    got = run("stale-doc", records([{"path": "CONTRIBUTING.md"}, {"path": "README.md", "kind": "doc", "referenced_paths": ["CONTRIBUTING.md", "docs/gone.md"]}, {"referenced_paths": ["CONTRIBUTING.md"]}, {"referenced_paths": ["x", "x"]}]))
    assert [(r["path"], round(r["confidence"], 9)) for r in got] == [("README.md", 0.675), ("f3", 0.95)]
    assert "references 1 of 2" in got[0]["reason"] and "references 2 of 2" in got[1]["reason"]


def test_duplicates(records):
    doc = {"kind": "doc"}
    got = run("dup-doc", records([{**doc, "path": "a.md", "content_simhash": 0b10101010}, {**doc, "path": "b.md", "content_simhash": 0b10101010}, {**doc, "content_simhash": 0xFFFFFF55}, {"content_simhash": 0b10101010}, doc]))
    assert [(r["path"], r["confidence"]) for r in got] == [("b.md", 0.95)] and "100% overlap with a.md" in got[0]["reason"]
    many = [{**doc, "content_simhash": (i * 2654435761) & 0xFFFFFFFF} for i in range(120)]
    got = {(r["seq"], r["emit_ord"]) for r in run("dup-doc", records(many))}
    prints = [m["content_simhash"] for m in many]
    assert got == {(j, i) for j in range(120) for i in range(j) if bin(prints[i] ^ prints[j]).count("1") <= 10}


def test_near_documents_over_many_blocks(records, monkeypatch):
    """Each two are compared once wherever the blocks end; equal prints, equal and missing seqs, and prints of more than 32 bits among them."""
    monkeypatch.setattr(detect, "LEAST_PRINTS", 8), monkeypatch.setattr(detect, "BLOCK_PRINTS", 16), monkeypatch.setattr(detect, "PAIRS_AT_ONCE", 50)
    seqs = [(i * 37) % 101 * 1000 for i in range(101)] + [5000, 5000, None]
    for wide in (0, 1 << 40, -(1 << 63)):
        rows = [{"kind": "doc", "seq": s, "content_simhash": ((i % 60) * 2654435761 & 0xFFFFFFFF) | (wide if i % 3 else 0)} for i, s in enumerate(seqs)]
        df = records([*rows, {"kind": "doc"}, {"content_simhash": 0}])
        known = [(r["seq"], f"f{i}", r["content_simhash"] & (1 << 64) - 1) for i, r in enumerate(rows) if r["seq"] is not None]
        for bits in (0, 10):
            want = sorted((s, p, t, q, (x ^ y).bit_count()) for s, p, x in known for t, q, y in known if s > t and (x ^ y).bit_count() <= bits)
            assert sorted(map(tuple, detect.near_docs(df, bits).collect())) == want
        assert {r.d: r.n for r in detect.near_counts(df).collect()} == {d: sum(w[4] == d for w in want) for d in {w[4] for w in want}}
    assert detect.near_docs(records([{}])).count() == detect.near_counts(records([{}])).count() == 0


def test_outliers_read_the_files_once(records, spark):
    """The files are a table before the histogram and its join read them, so what measures them runs once."""
    seen = spark.sparkContext.accumulator(0)

    def measured(n):
        seen.add(1)
        return n

    rows = records([{"tokens": 10 + i} for i in range(119)] + [{"tokens": 9_999}])
    got = run("bloat-outlier", rows.withColumn("tokens", F.udf(measured, "long")("tokens")))
    assert [r["path"] for r in got] == ["f118", "f119"] and seen.value == 120


def test_no_pair_or_path_is_broadcast(records):
    """Tables that are small on disk took the driver's memory as hash tables."""
    df = records([{"kind": "doc", "content_simhash": i % 5, "referenced_paths": ["x"]} for i in range(20)])
    for got in (detect.near_docs(df, 0), detect.near_docs(df), detect.near_counts(df), detect.stale_doc(df, Context(now=NOW))):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_cold(records):
    cold = {"tokens": 5000, "last_commit": NOW - 400 * DAY}
    rows = [cold, {**cold, "last_commit": NOW - 30 * DAY}, {**cold, "tokens": 50}, {**cold, "path": "src/index.ts"}, {**cold, "tier": 0}, {"tokens": 5000}, {**cold, "path": "bin/run.js"}, {**cold, "kind": "binary"}]
    got = run("cold-and-costly", records(rows), package_entrypoints=("bin/run.js",))
    assert [r["path"] for r in got] == ["f0"] and "~400 days" in got[0]["reason"]
    assert got[0]["confidence"] == pytest.approx(0.4 + 220 / 365 * 0.3 + 0.15)


def test_graph_signals(records):
    df = records([{"orphan_module": True}, {"orphan_module": False}, {}, {"dead_export_symbols": ["a", "b"]}, {"dead_export_symbols": list("abcdefgh")}])
    assert [(r["path"], r["confidence"]) for r in run("orphan-module", df)] == [("f0", 0.55)]
    got = run("dead-export", df)
    assert [round(r["confidence"], 9) for r in got] == [0.66, 0.8] and "2 exported symbol(s)" in got[0]["reason"]


REASONS = {
    "generated": r"generated file — (matches a known lockfile/build-output path pattern|path pattern and a generated-file header banner)", "vendored": r"vendored path, .+", "t0-overweight": r"resident file alone uses ~\d+% of the \d+-token resident budget",
    "bloat-outlier": r"\d+ tok is in the top 1% of \w+ files in this repo \(~\d+ tok is typical for the ceiling\)", "stale-doc": r"references \d+ of \d+ linked path\(s\) that no longer exist in this repo", "dup-doc": r"~\d+% overlap with \S+",
    "cold-and-costly": r"\d+ tok, untouched for ~\d+ days, no known-entrypoint filename", "orphan-module": r"unreachable from any inferred entrypoint via module-graph edges", "dead-export": r"\d+ exported symbol\(s\) have zero inbound module-graph references anywhere in this repo \(v1\)",
}


def test_all_nine_fire_and_say_no_more_than_their_templates(records):
    rows = [{"kind": "generated"}, {"kind": "vendored"}, {"tier": 0, "tokens": 2000}, {"kind": "doc", "referenced_paths": ["gone"]}, {"tokens": 5000, "last_commit": NOW - 400 * DAY}, {"orphan_module": True}, {"dead_export_symbols": ["x"]}]
    rows += [{"kind": "doc", "tokens": 50 + i} for i in range(117)] + [{"kind": "doc", "tokens": 50_050}] + [{"kind": "doc", "content_simhash": 5}] * 2
    found = detect.run_all(records(rows), Context(now=NOW)).collect()
    assert {r.detector for r in found} == set(detect.DETECTORS) == set(REASONS)
    assert all(re.fullmatch(REASONS[r.detector], r.reason) for r in found)
    assert {r.det_ord for r in found} == set(range(9))
    assert detect.run_all(records([]), Context(now=NOW)).collect() == []


def found(spark, rows):
    return spark.createDataFrame([(i, i, 0, p, "d", c, "r", s) for i, (p, c, s) in enumerate(rows)], "det_ord int, seq long, emit_ord long, path string, detector string, confidence double, reason string, suggest string")


def test_rollup(spark, records):
    files = records([{"tier": 0, "tokens": 4000}, {"tier": 1, "tokens": 500}, {"tier": 2, "tokens": 200}])
    r = score.rollup(files, found(spark, [("f1", 0.5, "ignore"), ("f1", 0.9, "review"), ("f2", 1.0, "split")]), Context(budget=3000)).first()
    assert (r.file_count, r.resident_tokens, r.reachable_tokens, r.ambient_tokens, r.over_budget, r.overage_pct) == (3, 4000, 500, 200, True, 33)
    assert r.recoverable_tokens == int(500 * 0.9 * 0.15 + 200 * 0.05 + 0.5)
    under = score.rollup(records([{"tier": 0, "tokens": 2925}]), found(spark, []), Context(budget=3000)).first()
    assert under.overage_pct == -2 and not under.over_budget  # -2.5 goes up
    none = score.rollup(records([]), found(spark, []), Context(budget=0)).first()
    assert (none.file_count, none.resident_tokens, none.recoverable_tokens, none.overage_pct) == (0, 0, 0, 0)


def test_ranking(spark, records):
    files = records([{"tokens": 100}, {"tokens": 100}, {"tokens": 900}, {"tokens": 0}, {"tokens": 50}])
    f = found(spark, [("f0", 0.5, "split"), ("f1", 0.5, "ignore"), ("f2", 0.4, "review"), ("f2", 0.8, "split"), ("f2", 0.8, "ignore"), ("f3", 0.9, "ignore")])
    assert [r.path for r in score.ranked(files, f).collect()] == ["f2", "f0", "f1"]  # ties in the order of discovery
    top = {r.path: r for r in score.top(files, f, n=2).collect()}
    assert top.keys() == {"f2", "f0"} and top["f2"].suggest == "split" and top["f2"].confidence == 0.8
    assert [(r.suggest, r.n, r.files) for r in score.by_suggestion(f).orderBy("place").collect()] == [("ignore", 3, 3), ("split", 2, 2), ("review", 1, 1)]


def test_additions_are_sorted_as_people_do(spark):
    f = found(spark, [(p, 0.9, "ignore") for p in ("b", "A", "B", "a", "_x", "a", "known")] + [("r", 0.9, "review")])
    known = spark.createDataFrame([(" known ",)], "line string")
    assert [r.path for r in score.ignore_additions(f, known).collect()] == ["_x", "a", "A", "b", "B"]


def test_snapshot(spark, records, tmp_path):
    own = ("generated_header boolean", "referenced_paths array<string>", "content_simhash long", "module string")
    rows = [("a", 1.5, 10, "source", 1, 5, False), ("b", 2.0, 20, "doc", 1, 6, True), ("c", 3.0, 30, "doc", 0, 7, False)]
    old = spark.createDataFrame([(*r, None, None, None, None) for r in rows], "path string, mtime_ms double, bytes long, kind string, tier int, tokens long, estimated boolean, " + ", ".join(own))
    at = str(tmp_path / "snapshot")
    assert snapshot.load(spark, None) is None and snapshot.load(spark, at) is None
    snapshot.save(old, at)
    back = snapshot.load(spark, at)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, old.select(*snapshot.KEPT).collect()))
    files = spark.createDataFrame([(1, "a", 1.5, 10, "source", 1), (2, "b", 2.5, 20, "doc", 1), (3, "c", 3.0, 30, "doc", 1), (4, "d", 3.0, 30, "doc", 1)], "seq long, path string, mtime_ms double, bytes long, kind string, tier int")
    hits, misses = snapshot.split(files, back)
    assert [(r.path, r.tokens) for r in hits.collect()] == [("a", 5)] and sorted(r.path for r in misses.collect()) == ["b", "c", "d"]
    back.withColumn("version", F.lit(999)).write.parquet(str(tmp_path / "other"))
    assert snapshot.load(spark, str(tmp_path / "other")) is None
