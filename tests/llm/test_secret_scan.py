import math
import random

import numpy as np
import pytest

from ctxcost.llm import secret_scan as ss

from .conftest import prose

KEY = {"hex": "0123456789abcdef", "base62": ss.ALPHABETS["base62"], "base32": ss.ALPHABETS["base32"]}


def battery(string, alphabet):
    """The three statistics and their p-values, one string at a time."""
    v = [alphabet.index(c) for c in string]
    n, m = len(v), len(alphabet)
    k = min(max(2, n // 5), m)
    cells = [0] * k
    for x in v:
        cells[x * k // m] += 1
    width = [sum(x * k // m == j for x in range(m)) for j in range(k)]
    chi2 = sum((c - n * w / m) ** 2 / (n * w / m) for c, w in zip(cells, width))
    z = ((chi2 / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = [x >= (m + 1) // 2 for x in v]
    n1 = sum(high)
    n2 = n - n1
    r = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = math.erfc(abs(r - mean) / math.sqrt(2 * var))
    c = [x - (m - 1) / 2 for x in v]
    s = sum(a * b for a, b in zip(c, c[1:])) / ((m * m - 1) / 12 * math.sqrt(n - 1))
    return uniform, runs, math.erfc(abs(s) / math.sqrt(2))


def test_battery_equals_plain_python():
    rng = random.Random(41)
    for name, alphabet in KEY.items():
        for n in (20, 33, 64, 200):
            string = "".join(rng.choices(alphabet, k=n))
            i = ss.NAMES.index(name)
            v = ss.VALUES[i][np.frombuffer(string.encode(), np.uint8)]
            got = ss.battery(v, np.array([0, n]), np.array([len(alphabet)]))[0]
            want = battery(string, alphabet)
            assert got[:3] == pytest.approx(want, rel=1e-6)
            f = -sum(map(math.log, want))
            assert got[3] == pytest.approx(math.exp(-f) * (1 + f + f * f / 2), rel=1e-6)


def test_p_values_of_random_strings_are_spread():
    rng = np.random.default_rng(42)
    n, size = 4000, 64
    v = rng.integers(0, 64, n * size)
    p = ss.battery(v, np.arange(n + 1) * size, np.full(n, 64))
    for i in range(4):
        assert 0.02 < (p[:, i] <= 0.05).mean() < 0.09 and 0.42 < (p[:, i] <= 0.5).mean() < 0.58


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(43)
    rows, planted = [], set()
    for i in range(400):
        text = prose(rng, 15)
        if i % 4 == 0:
            key = "".join(rng.choices(rng.choice(list(KEY.values())), k=rng.choice((24, 40, 64))))
            text += f"\nü key={key} end"
            planted.add((i, text.index(key)))
        if i % 5 == 0:
            text += "\n" + rng.choice(("a" * 40, "abcdefghijklmnopqrstuvwxyz" * 2, "01" * 20, "this_is_a_very_long_identifier_of_a_program", "aaaaaaaaaabbbbbbbbbbcccccccccc"))
        rows.append((i, text))
    return rows, planted


def test_planted_secrets_are_found(make, docs):
    rows, planted = docs
    found = ss.secrets(make(rows)).collect()
    got = {(r.doc_id, r.start) for r in found}
    assert len(got & planted) / len(planted) >= 0.9
    assert len(got - planted) <= 0.05 * len(got)
    assert all(0 <= r.q_value <= 0.05 for r in found)


def test_false_discovery_control_equals_brute_force(make, docs):
    """Empirical p-values among the decoys of a stratum, then Benjamini and Hochberg's procedure with Storey's estimate on the sorted list of them."""
    rows, _ = docs
    every = ss.candidates(make(rows)).collect()
    edges = [ss.MIN_LENGTH, *ss._LENGTHS.tolist()]
    group = lambda r: (r.encoding, max(e for e in edges if e <= r.length))
    score = lambda p: int(p * (ss.BINS - 1))
    reference = ss.reference_decoys(ss.MIN_LENGTH)

    def decoys(encoding, edge):
        own = [score(p) for x in every if group(x) == (encoding, edge) for p in x.p_decoys]
        return own + [score(p) for p in reference[ss.NAMES.index(encoding), edges.index(edge)]]

    want = {}
    for g in set(map(group, every)):
        pool = decoys(*g)
        if len(pool) < ss.THIN:
            pool = [p for e in edges if e <= g[1] for p in decoys(g[0], e)]
        own = [x for x in every if group(x) == g]
        ranked = sorted(((1 + sum(d >= score(x.p_random) for d in pool)) / (1 + len(pool)), i) for i, x in enumerate(own))
        q, ordinary = 1.0, min(len(own), (1 + sum(p > 0.5 for p, _ in ranked)) / 0.5)
        for k in range(len(ranked), 0, -1):
            p, i = ranked[k - 1]
            q = min(q, p * ordinary / sum(y <= p for y, _ in ranked))
            if q <= 0.05 and own[i].p_random >= ss.FLOOR:
                want[own[i].doc_id, own[i].start] = q
    got = {(r.doc_id, r.start): r.q_value for r in ss.secrets(make(rows)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(q) for k, q in want.items())


ORDINARY = ("report2024quarterlyrevenue", "/usr/local/share/documentation", "getUserProfileByAccountName", "annual_report_for_the_year_2023", "20240101000000000001")


@pytest.mark.parametrize("n", [1, 2, 5])
def test_a_few_ordinary_candidates_are_no_findings(make, n):
    """Alone in their documents, without decoys there, and with text around them."""
    rng = random.Random(45)
    assert ss.secrets(make([(i, x) for i, x in enumerate(ORDINARY[:n])])).collect() == []
    assert ss.secrets(make([(i, f"{prose(rng, 9)} {x} {prose(rng, 9)}") for i, x in enumerate(ORDINARY[:n])])).collect() == []


def test_numbers_of_few_bits_are_no_candidates(make):
    rows = [(i, f"pay 47{i:014d} to 4111 by key {i:064x}") for i in range(3)]
    assert {r.length for r in ss.candidates(make(rows)).collect()} == {64}
    assert {r.length for r in ss.candidates(make(rows), min_bits=1).collect()} == {16, 64}


def test_one_secret_alone_is_found(make):
    rng = random.Random(46)
    for alphabet in KEY.values():
        key = "".join(rng.choices(alphabet, k=64))
        assert [r.length for r in ss.secrets(make([(1, f"{prose(rng, 20)}\nkey={key}")])).collect()] == [64]


def test_recall_by_length(make):
    """From what length on keys are found among a thousand ordinary documents."""
    rng = random.Random(47)
    shares = {}
    for n in (16, 20, 24, 32, 40, 64):
        rows, planted = [], set()
        for i in range(300):
            text = prose(rng, 12)
            if i % 3 == 0:
                key = "".join(rng.choices(KEY["base62"], k=n))
                planted.add((i, len(text) + 5))
                text += f"\nkey={key}"
            rows.append((i, text))
        got = {(r.doc_id, r.start) for r in ss.secrets(make(rows)).collect()}
        assert len(got - planted) <= 0.06 * max(1, len(got))
        shares[n] = len(got & planted) / len(planted)
    assert min(shares[n] for n in (32, 40, 64)) >= 0.9 and min(shares[n] for n in (20, 24)) >= 0.8 and shares[16] >= 0.7, shares


def test_odd_rows_and_empty(make, odd_rows):
    rng = random.Random(44)
    key = "".join(rng.choices(KEY["base62"], k=40))
    rows = [*odd_rows, (50, key), (50, key), (None, f"é {key}")]
    got = ss.candidates(make(rows, extra=True)).collect()
    assert sorted((r.doc_id is None, r.start, r.length) for r in got if r.length == 40) == [(False, 0, 40), (False, 0, 40), (True, 2, 40)]
    assert ss.secrets(make(rows, extra=True)).columns == ["doc_id", "start", "length", "encoding", "p_uniform", "p_runs", "p_serial", "p_random", "q_value"]
    assert ss.secrets(make([])).collect() == [] and ss.secrets(make([(1, None), (2, "")])).collect() == []
