import random

import numpy as np
import pytest

from ctxcost.llm import quality_fm as fm

from .conftest import prose, words


@pytest.fixture(scope="module")
def corpus(spark, make):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        text, bad = prose(rng, 5), rng.random() < 0.3
        if bad:
            text = text.replace(".", " awful garbage.", 2) if rng.random() < 0.5 else " ".join(w.upper() + "!!" for w in words(rng, 40))
        rows.append((i, text))
        if i % 3:
            labels.append((i, 0 if bad and rng.random() < 0.5 else 1, int(bad and labels_toxic(labels))))
        else:
            labels.append((i, int(not bad), 0))
    known = [(i, int(q), int(t)) for i, q, t in labels]
    truth = {i: "garbage" not in t and "!!" not in t for i, t in rows}
    known = [(i, int(truth[i]), 0) for i, _, _ in known]
    return make(rows), spark.createDataFrame(known, "doc_id long, quality int, toxic int"), truth


def labels_toxic(labels):
    return len(labels) % 2 == 0


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    model = fm.fit(docs, labels.where("doc_id % 4 <> 0"))
    got = {r.doc_id: r.score for r in fm.score(docs.where("doc_id % 4 = 0"), model).collect()}
    right = sum((s >= model.threshold) == truth[i] for i, s in got.items())
    assert right / len(got) > 0.97
    assert {r.doc_id for r in fm.keep(docs.where("doc_id % 4 = 0"), model).collect()} == {i for i, s in got.items() if s >= model.threshold}


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = fm.Model(0.3, rng.normal(size=50).astype("f4"), rng.normal(size=(50, 4)).astype("f4"), 0.5)
    idx = [np.array([1, 4, 9, 30]), np.array([], int), np.array([7])]
    row = np.repeat([0, 1, 2], [len(x) for x in idx])
    got = m.raw(row, np.concatenate(idx).astype(int), 3)
    for g, x in zip(got, idx):
        pairs = sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(x) for j in x[a + 1 :])
        assert g == pytest.approx(0.3 + float(m.w[x].sum()) + pairs, rel=1e-4)


def test_interaction_is_learned():
    """Good only if exactly one of two features is there: no linear model can tell."""
    rng = np.random.default_rng(1)
    a, b = rng.random(2000) < 0.5, rng.random(2000) < 0.5
    rows = [np.array([10] * int(x) + [20] * int(z) + [30], int) for x, z in zip(a, b)]
    ptr = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    m = fm.train(ptr, np.concatenate(rows), (a ^ b).astype(float), fm.Params(buckets=512, epochs=200, rate=0.5))
    raw = m.raw(np.repeat(np.arange(2000), np.diff(ptr)), np.concatenate(rows), 2000)
    assert ((raw > 0) == (a ^ b)).mean() > 0.95


def test_training_is_bounded_and_repeatable(corpus):
    docs, labels, _ = corpus
    one, two = (fm.fit(docs.repartition(n), labels, fm.Params(train_rows=200)) for n in (2, 5))
    assert one.bias == two.bias and (one.w == two.w).all() and (one.v == two.v).all()


def test_odd_rows_and_empty(spark, make, odd_rows):
    docs = make(odd_rows, extra=True)
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, 1, None), (None, 1, 0), (1, None, None), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = fm.fit(docs, labels)
    assert fm.score(docs, model).count() == len(odd_rows)
    assert fm.keep(docs, model).columns == docs.columns
    assert fm.keep(docs, fm.fit(docs, labels.limit(0))).count() == len(odd_rows)
    assert fm.keep(make([]), model).count() == 0
