import random

import numpy as np
import pyarrow as pa
import pytest

from ctxcost.llm import simhash_forest as sf

from .conftest import prose, words


def brute(rows):
    """{doc_id: least doc_id of its group}, by comparing all pairs of fingerprints."""
    known = [(i, t) for i, t in rows if i is not None]
    at, f = sf.fingerprints_of(pa.array([(t or "").lower() for _, t in known]))
    ids = np.array([known[k][0] for k in at])
    by = np.argsort(ids, kind="stable")
    ids, f = ids[by], f[by]
    root = sf._stars(*sf._near(f, sf.RADIUS), len(f))
    return {int(ids[k]): int(ids[root[k]]) for k in range(len(ids))}


def edited(rng, text, share):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(21)
    out, groups = [], []
    for size in [1] * 150 + [2] * 30 + [5] * 6 + [300]:
        base = prose(rng, 12)
        group = [(len(out) + j, base if j % 3 == 2 else edited(rng, base, 0.02 * (j > 0))) for j in range(size)]
        groups.append({i for i, _ in group})
        out += group
    rng.shuffle(out)
    return out, groups


def test_fingerprint_is_a_majority():
    """Bits of a text are those that most of its distinct word pairs have."""
    rng = random.Random(20)
    text = " ".join(words(rng, 30))
    _, f = sf.fingerprints_of(pa.array([text, text + " " + text, "", "one"]))
    assert len(f) == 3 and f.shape[1] == sf.WORDS
    same = sum(int(np.bitwise_count(a ^ b)) for a, b in zip(f[0], f[1]))
    assert same <= sf.BITS // 8  # one pair more, at the seam


def test_groups_are_found(make, docs):
    rows, groups = docs
    got = {r.doc_id: r.duplicate_of for r in sf.duplicates(make(rows)).collect()}
    want = brute(rows)
    assert {i: r for i, r in want.items() if i != r} == got
    planted = [(a, b) for g in groups for a in g for b in g if a < b]
    assert sum(want[a] == want[b] for a, b in planted) / len(planted) >= 0.97
    assert all(any({i, r} <= g for g in groups) for i, r in got.items())


def test_one_of_each_group_stays(make, docs):
    rows, _ = docs
    source = make(rows, extra=True)
    kept = sf.deduplicated(source)
    assert kept.columns == source.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in brute(rows).items() if i == r}


def test_plan_reaches_its_target():
    for n in (10, 5_000, 250_000, 10**7, 10**10):
        tries, depth = sf.plan(n, sf.RADIUS, 0.9)
        missed = 1.0
        for i in range(depth):
            missed *= (sf.BITS - sf.RADIUS - i) / (sf.BITS - i)
        assert 1 - (1 - missed) ** tries >= 0.9 and n / 2**depth <= sf.LEAF


def test_forest_recalls_pairs_at_the_radius(spark):
    """Pairs exactly at the radius among many fingerprints, on which the tries have to climb."""
    rng = np.random.default_rng(22)
    n = 4000
    a = rng.integers(0, 1 << 63, (n, sf.WORDS), dtype=np.uint64)
    b = a[:600].copy()
    for k in range(len(b)):
        for bit in rng.choice(sf.BITS, sf.RADIUS, replace=False):
            b[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    f = np.concatenate((a, b))
    names = [f"f{w}" for w in range(sf.WORDS)]
    df = spark.createDataFrame([(i, *map(int, f[i].view(np.int64))) for i in range(len(f))], "id long, " + ", ".join(f"{x} long" for x in names))
    old = sf.LEAF
    try:
        sf.LEAF = 32
        tries, depth = sf.plan(len(f), sf.RADIUS, 0.9)
        got = {(r.a, r.b) for r in sf.near_edges(df, sf.RADIUS, 0.9).collect()}
    finally:
        sf.LEAF = old
    assert depth and tries > 4
    found = sum((n + k, k) in got or (k, n + k) in got for k in range(600))
    assert found / 600 >= 0.9


def test_dense_nodes_grow_their_own_forest(monkeypatch):
    """A node of thousands of near-equal fingerprints is one group without comparing all pairs."""
    rng = np.random.default_rng(23)
    base = rng.integers(0, 1 << 63, sf.WORDS, dtype=np.uint64)
    f = np.tile(base, (6000, 1))
    for k in range(len(f)):
        for bit in rng.choice(sf.BITS, 6, replace=False):
            f[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    other = rng.integers(0, 1 << 63, (50, sf.WORDS), dtype=np.uint64)
    root = sf.links(np.concatenate((f, other)), sf.RADIUS, 0.9)
    assert (root[:6000] == 0).mean() >= 0.99 and (root[6000:] == np.arange(6000, 6050)).all()


def test_odd_rows_and_empty(make, odd_rows):
    got = {(r.doc_id, r.duplicate_of) for r in sf.duplicates(make(odd_rows, extra=True)).collect()}
    assert got == {(5, 4)}
    kept = [r.doc_id for r in sf.deduplicated(make(odd_rows)).collect()]
    assert kept.count(4) == 2 and 5 not in kept and len(kept) == len(odd_rows) - 1
    assert sf.duplicates(make([])).collect() == [] and sf.deduplicated(make([])).collect() == []
    one = [(3, "word"), (1, "word"), (2, "word word"), (None, "word")]
    assert {(r.doc_id, r.duplicate_of) for r in sf.duplicates(make(one)).collect()} >= {(3, 1)}


def test_levels_share_what_may_be_lost(spark, monkeypatch):
    """The targets of the top forest and of each level below it multiply to the one asked, at least."""
    f = np.tile(np.random.default_rng(24).integers(0, 1 << 63, sf.WORDS, dtype=np.uint64), (200, 1))
    f[:, 0] ^= np.arange(200, dtype=np.uint64)
    df = spark.createDataFrame([(i, *map(int, f[i].view(np.int64))) for i in range(20)], "id long, " + ", ".join(f"f{w} long" for w in range(sf.WORDS)))
    asked = []

    def planned(n, radius, target):
        asked.append(target)
        return 1, 1

    monkeypatch.setattr(sf, "plan", planned)
    monkeypatch.setattr(sf, "LEAF", 16)
    passed, links = [], sf.links
    monkeypatch.setattr(sf, "_order", lambda seed: np.arange(sf.BITS)[::-1])  # a bit that all share: each level has one node, all of it
    sf.near_edges(df, sf.RADIUS, 0.9)
    monkeypatch.setattr(sf, "links", lambda f, radius, target, level=1: passed.append(target) or np.zeros(len(f), int))
    f[0, -1] ^= np.uint64(1) << np.uint64(63)  # one apart, so that the node is smaller than the whole
    links(f, sf.RADIUS, asked[0])
    links(f, sf.RADIUS, passed[-1], 2)
    assert len(asked) == 3 and np.prod(asked) >= 0.9
