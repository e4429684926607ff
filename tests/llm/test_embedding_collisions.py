import math

import numpy as np
import pytest

from ctxcost.llm import embedding_collisions as ec

TYPE = "vec_id long, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame(rows, TYPE)


def brute(v, threshold=0.95):
    """{i: (class, links)} by comparing all vectors."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(v))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(v)).min(1))
        if (low == root).all():
            return {i: (int(root[i]), int(near[i].sum())) for i in range(len(v))}
        root = low


@pytest.fixture(scope="module")
def vectors():
    """Groups whose cosines lie around the threshold, and unrelated vectors."""
    rng = np.random.default_rng(71)
    base = rng.normal(size=(700, 64))
    near = [base]
    for noise in (0.1, 0.2, 0.25, 0.3):
        near.append(base[:150] + noise * rng.normal(size=(150, 64)))
    return np.concatenate(near).astype(np.float32)


def found(spark, v, **kw):
    got = ec.near_classes(table(spark, [(i, list(map(float, x))) for i, x in enumerate(v)]), **kw).collect()
    out = {r.vec_id: (r.class_id, r.links) for r in got}
    assert len(out) == len(got) == len(v)
    return out


def compared(got, want, least):
    """No link that isn't there, and of those that are the asked share."""
    assert all(got[i][1] <= want[i][1] and got[i][0] >= want[i][0] for i in want)
    links = sum(n for _, n in want.values())
    assert links > 600 and sum(n for _, n in got.values()) / links >= least
    assert sum(got[i][0] == want[i][0] for i in want) / len(want) >= least


def test_one_table_of_windows(spark, vectors):
    compared(found(spark, vectors), brute(vectors.astype(np.float64)), 0.95)


@pytest.mark.parametrize("rows", [32_768, 50])
def test_many_tables_and_split_slabs(spark, vectors, monkeypatch, rows):
    monkeypatch.setattr(ec, "WINDOW_ROWS", 16)
    monkeypatch.setattr(ec, "SLAB_ROWS", rows)
    p = ec.Plan(len(vectors), 0.95, 0.98)
    assert p.cells >= 2 and p.tables >= 2
    compared(found(spark, vectors), brute(vectors.astype(np.float64)), 0.93)


def test_a_split_slab_finds_the_same(spark, vectors, monkeypatch):
    whole = found(spark, vectors)
    monkeypatch.setattr(ec, "SLAB_ROWS", 100)
    assert found(spark, vectors) == whole


def test_doubles_are_compared_as_doubles(spark):
    v = [[1.0, 1e-9], [1.0, 0.0], [0.3, 0.95393920141694565], [1e200, 1e191]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in ec.near_classes(df, threshold=1 - 1e-12).collect()) == [(0, 0, 2), (1, 0, 2), (2, 2, 0), (3, 0, 2)]


def test_count_keeps_its_recall():
    for p in (0.5, 0.68, 0.9):
        for m in (16, 32):
            c = ec.least_count(p, m, 0.99)
            tail = lambda c: sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(c, m + 1))  # noqa: E731, B023
            assert tail(c) >= 0.99 > tail(c + 1)


def test_equal_vectors_count_as_many(spark):
    """Copies are compared once; each has the others and the near vectors of all for partners."""
    rng = np.random.default_rng(72)
    one = rng.normal(size=32)
    v = np.concatenate((np.tile(one, (400, 1)), np.tile(one + 0.05 * rng.normal(size=32), (30, 1)), rng.normal(size=(50, 32)))).astype(np.float32)
    got = found(spark, v[::-1])
    assert got == brute(v[::-1].astype(np.float64)) and got[400] == (50, 429)


def test_odd_rows_and_empty(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, []), (5, [0.0, 0.0]), (15, [0.0, 0.0]), (6, [nan, 1.0]), (16, [nan, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, None]), (18, [1.0, None]), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0]), (12, [0.0, 3.0]), (0, [0.0, 3.0]), (12, [3.0, 0.0])]
    df = table(spark, rows)
    for c in ("id", "q", "x", "slab", "own", "v", "n", "rep", "root", "links", "class_id", "i", "part"):
        df = df.selectExpr("*", f"5 AS {c}")
    got = {r.vec_id: (r.class_id, r.links) for r in ec.near_classes(df).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 12: (0, 3), 0: (0, 1), **{i: (i, 0) for i in (3, 4, 5, 15, 6, 16, 7, 8, 18, 9, 10, 11)}}
    assert ec.near_classes(table(spark, [])).collect() == []
    assert [tuple(r) for r in ec.near_classes(table(spark, [(1, None)])).collect()] == [(1, 1, 0)]
