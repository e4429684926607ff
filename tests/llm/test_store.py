import pytest
from pyspark.sql import functions as F

from ctxcost.llm import _components, _store


@pytest.mark.parametrize("most", [0, 10])
def test_without_either_way(make, monkeypatch, most):
    monkeypatch.setattr(_store, "BROADCAST_KEYS", most)
    docs = make([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, None)], extra=True)
    gone = docs.where("doc_id = 2").select(F.col("doc_id").alias("__cc_gone"))
    kept = _store.without(docs, docs["doc_id"], gone)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "c"), (1, "a"), (3, None)]
    plan = kept._jdf.queryExecution().toString()
    assert ("BroadcastHashJoin" in plan) == (most > 0) and ("ShuffledHashJoin" in plan) == (most == 0)


def test_tables_lie_in_the_shared_folder(spark, make):
    at = _store.shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == at
    df = _store.written(make([(1, "a")]), "test")
    assert all(f.startswith(at if ":" in at else f"file://{at}") or at.split("://")[-1] in f for f in df.inputFiles())


def test_components(spark):
    import random

    rng = random.Random(81)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)]
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r.node: r.root for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
    assert _components.components(spark.createDataFrame([], "a long, b long")).collect() == []
