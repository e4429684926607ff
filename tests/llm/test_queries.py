"""The registered queries over the smallest tables, the pipeline stage by stage, and what is left without the subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ctxcost.llm import queries
from ctxcost.llm import quality_fm as fm
from tests.oracle import DATA, same

from . import test_decontamination as dc
from . import test_line_windows as lw
from . import test_packing as pk
from . import test_simhash_forest as sf

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    same(queries.queries()[name](spark, folder), queries.oracle_sql()[name], folder)


def test_ten_operators():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries() if n.startswith("op")) == list(range(1, 11))


def test_the_collision_query_finds_pairs(spark, tmp_path):
    """The smallest tables have no near-duplicate vectors, so the query also runs over some that have."""
    rows = [(r.vec_id, list(r.embedding), 0) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").limit(80).collect()]
    rows += [(10_000 + i, [x * 1.5 + 0.001 for x in v], 0) for i, v, _ in rows[:30]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/t")
    (part,) = Path(tmp_path, "t").glob("*.parquet")
    os.rename(part, tmp_path / "embeddings.parquet")
    name = "op10_embedding_collisions"
    assert same(queries.queries()[name](spark, str(tmp_path)), queries.oracle_sql()[name], str(tmp_path)) >= 30


def test_pipeline_equals_brute_force(spark):
    """Each stage on what the one before kept, against plain Python."""
    folder = f"{DATA}/sf0.001"
    table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    docs = table("documents")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    kept = stages["quality classifier"](spark, docs, folder)
    scores = {r.doc_id: r.score for r in fm.score(docs, fm.fit(docs, table("labels"))).collect()}
    assert {i for i, _ in rows(kept)} == {i for i, s in scores.items() if s >= fm.Params().threshold} and 0 < kept.count() < docs.count()
    before = rows(kept)

    kept = stages["line dedup"](spark, kept, folder)
    prints = {t: sf.sf.fingerprints_of(pa.array([t.lower()]))[1] for _, t in before}
    twin = lambda a, b: len(prints[a[1]]) and len(prints[b[1]]) and np.bitwise_count(prints[a[1]] ^ prints[b[1]]).sum() <= sf.sf.RADIUS
    want = lw.brute(before, lambda a, b: a != b and bool(twin(a, b)))
    assert sorted(rows(kept)) == sorted((before[n][0], t) for n, t in want.items() if t and t.strip())
    before = rows(kept)

    kept = stages["SimHash near-dedup"](spark, kept, folder)
    root = sf.brute(before)
    assert sorted(i for i, _ in rows(kept)) == sorted(i for i, _ in before if root.get(i, i) == i)
    before = rows(kept)

    kept = stages["benchmark decontamination"](spark, kept, folder)
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    bad = {d for d, _ in dc.brute(before, items)}
    assert sorted(i for i, _ in rows(kept)) == sorted(i for i, _ in before if i not in bad)
    assert kept.columns == docs.columns
    before = rows(kept)

    placed = stages["packing"](spark, kept, folder).collect()
    pk.checked(placed, (512, 2048, 8192, 32768), 1 << 20)
    assert sum(r.n_tokens for r in placed) == sum(pk.tokens(t) for _, t in before)

    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, placed))


def test_odd_rows_through_all_stages(spark, make, odd_rows, tmp_path):
    """Null ids and texts, blanks, repeats, a very long text and extra columns of clashing names; each case as the docstring of the pipeline says."""
    folder = f"{DATA}/sf0.001"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rows = [*odd_rows, (None, odd_rows[1][1]), (70, item), (71, odd_rows[12][1])]
    docs = make(rows, extra=True)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        before = kept
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.exceptAll(before).where("n_chars IS NULL").count() == 0
    out = {}
    for r in kept.collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert None in out and all(t and t.strip() for own in out.values() for t in own)
    assert 5 not in out and 70 not in out and 1 not in out and 2 not in out and 3 not in out
    assert out[4] == [odd_rows[5][1]] * 2 and out[6] == [odd_rows[8][1]] and out[7] == ["word"]
    assert sum(d in out for d in (9, 71)) == 1
    placed = stages_last(spark, kept, folder)
    assert {r.doc_id for r in placed} == set(out)
    scored = dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, folder)
    assert scored.columns == docs.columns and scored.exceptAll(docs).count() == 0


def stages_last(spark, docs, folder):
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    pk.checked(placed, (512, 2048, 8192, 32768), 1 << 20)
    return placed


def test_an_empty_corpus(spark, tmp_path):
    for n in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/sf0.001/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_rest_stands_without_the_subpackage(tmp_path):
    for n in ("ctxcost", "__spark_entry__.py"):
        src = ROOT / n
        shutil.copytree(src, tmp_path / n, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql().keys() <= q.keys()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=120).returncode == 0
