import math
import random
import re

import pytest

from ctxcost.llm import decontamination as dc

from .conftest import prose, words


def shingles(text, k=4):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(docs, items, containment=0.7):
    """{(doc_id, item_id): (containment, start)} of every window of every document."""
    out = {}
    for d, text in docs:
        sh = shingles(text)
        for i, item in items:
            own = shingles(item)
            need, size = set(own), len(own)
            t = math.ceil(containment * len(need) - 1e-9)
            if i is None or not need:
                continue
            for at in range(len(sh)):
                n = len(need & set(sh[at : at + size])) if sh[at] in need else 0
                if n >= t:
                    best = out.get((d, i))
                    if best is None or (-n / len(need), at) < (-best[0], best[1]):
                        out[d, i] = (n / len(need), at)
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, rng.randint(3, 30)))) for i in range(25)]
    items += [(25, items[0][1] + " " + " ".join(words(rng, 3))), (26, "la " * 20), (27, None), (28, ""), (None, items[1][1])]
    docs = []
    for i in range(80):
        parts = words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            for j in range(len(w)):
                if rng.random() < rng.choice((0, 0.02, 0.1)):
                    w[j] = "other"
            lo = rng.randint(0, len(w) // 3)
            at = rng.randint(0, len(parts))
            parts[at:at] = w[lo:]
        docs.append((i, " ".join(parts).upper() if i % 7 == 0 else ", ".join(parts)))
    docs.append((80, "la " * 500))
    return docs, items


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_equals_brute_force(spark, make, case, monkeypatch, most):
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", most)
    docs, items = case
    got = {(r.doc_id, r.item_id): (r.containment, r.start) for r in dc.leaks(make(docs), table(spark, items)).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 40
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_clean_documents_stay(spark, make, case):
    docs, items = case
    bad = {d for d, _ in brute(docs, items)}
    source = make(docs, extra=True)
    kept = dc.decontaminated(source, table(spark, items))
    assert kept.columns == source.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - bad


def test_odd_rows_and_empty(spark, make, odd_rows):
    items = table(spark, [(1, odd_rows[5][1]), (1, odd_rows[5][1]), (2, None)])
    got = dc.leaks(make(odd_rows, extra=True), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 1), (5, 1)} and len(got) == 2
    assert dc.decontaminated(make(odd_rows), items).count() == len(odd_rows) - 3
    by_null = table(spark, [(9, odd_rows[1][1])])
    assert [r.doc_id for r in dc.leaks(make(odd_rows), by_null).collect()] == [None]
    assert dc.leaks(make([]), items).collect() == []
    assert dc.leaks(make(odd_rows), table(spark, [])).collect() == []
    assert dc.decontaminated(make(odd_rows), table(spark, [])).count() == len(odd_rows)


def test_long_text_is_searched_to_its_end(spark, make):
    rng = random.Random(8)
    item = prose(rng, 2)
    text = " ".join(words(rng, 200_000)) + " " + item
    assert [r.containment for r in dc.leaks(make([(1, text)]), table(spark, [(5, item)])).collect()] == [1.0]
