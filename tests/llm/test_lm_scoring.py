import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ctxcost.llm import _text
from ctxcost.llm import lm_scoring as lm

from .conftest import prose, words


def pairs_of(text):
    """(context, class) of each word of one text."""
    (_, data, offs), *rest = _text.blocks(pa.array([text]))
    v, w, _ = lm.words(data, offs)
    assert not rest
    return list(zip(v.tolist(), w.tolist()))


def brute(rows):
    """Mean log probability of each text by the counts of all other texts, one word at a time."""
    docs = [pairs_of(t) if t else [] for _, t in rows]
    pair, word, context = Counter(), Counter(), Counter()
    for d in docs:
        pair.update(d)
        word.update(w for _, w in d)
        context.update(v for v, _ in d)
    total = sum(word.values())
    cells = Counter()
    for (v, w), n in pair.items():
        cells[cell(n, word[w], context[v], total)] += n
    weight = lm.weights(lm.learn(np.array(list(cells)), np.array(list(cells.values()))))
    out = []
    for d in docs:
        own_pair, own_word, own_context = Counter(d), Counter(w for _, w in d), Counter(v for v, _ in d)
        logs = []
        for v, w in d:
            rest = context[v] - own_context[v]
            l0, l1, l2 = weight[int(math.log2(rest)) + 1 if rest else 0]
            p = l0 / lm.CLASSES + l1 * (word[w] - own_word[w]) / max(1, total - len(d))
            if rest:
                p += l2 * (pair[v, w] - own_pair[v, w]) / rest
            logs.append(math.log(p))
        out.append(sum(logs) / len(logs) if logs else None)
    return out


def cell(n, word, context, total):
    """An event without itself, in the histogram's steps."""
    step = lambda f: round(-lm.CELL * math.log2(f)) + 1 if f else 0
    bucket = int(math.log2(context - 1)) + 1 if context > 1 else 0
    return bucket << 40 | step((n - 1) / (context - 1) if context > 1 else 0) << 20 | step((word - 1) / max(1, total - 1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    vocabulary = words(rng, 60)
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) + " " + prose(rng, 1) for _ in range(60)]
    return list(enumerate([*texts, *texts[:3], "one", ""])) + [(70, None), (None, texts[5])]


@pytest.mark.parametrize("hot", [lm.HOT, 20, 0])
def test_scores_equal_brute_force(make, rows, hot):
    """All pairs sent, some, and all joined."""
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.logprob, r.perplexity) for r in lm.scores(make(rows), hot).collect())
    want = brute(rows)
    assert len(got) == len(rows)
    for (_, _, n, logp, perplexity), (i, t), w in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), [w for _, w in sorted(zip(rows, want), key=lambda x: (x[0][0] is None, x[0][0] or 0))]):
        assert n == len(pairs_of(t)) if t else n == 0
        assert (logp, perplexity) == (None, None) if w is None else logp == pytest.approx(w, rel=1e-6) and perplexity == pytest.approx(math.exp(-w), rel=1e-5)


def test_em_raises_the_held_out_likelihood():
    rng = np.random.default_rng(2)
    cells, events = np.unique(rng.integers(0, 3, 400) << 40 | rng.integers(0, 60, 400) << 20 | rng.integers(1, 90, 400), return_counts=True)
    cells = cells[(cells >> 40 > 0) | (cells >> 20 == 0)]
    events = events[: len(cells)]

    def fit(learned):
        f = np.stack((np.full(len(cells), 1 / lm.CLASSES), lm._estimate(cells & 0xFFFFF), lm._estimate(cells >> 20 & 0xFFFFF)), 1)
        return (events * np.log((f * np.array([learned[b] for b in (cells >> 40).tolist()])).sum(1))).sum()

    by_rounds = [fit(lm.learn(cells, events, n, 0)) for n in (1, 2, 5, 20, 100)]
    assert all(a < b for a, b in zip(by_rounds, by_rounds[1:]))
    assert all(abs(sum(w) - 1) < 1e-9 for w in lm.learn(cells, events).values())


def test_what_it_gathers_grows_with_the_corpus(make):
    rng = random.Random(4)
    vocabulary = words(rng, 4000)
    rows = [(i, " ".join(rng.choices(vocabulary, k=100))) for i in range(400)]
    a, b = (lm.pair_counts(make(r)).count() for r in (rows[:40], rows))
    assert b > 9 * a


def test_a_second_copy_vouches_for_a_text_and_its_own_words_dont(make):
    rng = random.Random(3)
    rows = [(i, prose(rng, 8)) for i in range(80)]
    rows += [(100 + i, t) for i, t in rows[:10]]
    got = {r.doc_id: r.logprob for r in lm.scores(make(rows)).collect()}
    assert min(got[i] for i in (*range(10), *range(100, 110))) > max(got[i] for i in range(10, 80)) + 1


def test_text_of_the_corpus_is_likelier_than_noise(make):
    rng = random.Random(5)
    vocabulary = words(rng, 80)
    rows = [(i, " ".join(rng.choices(vocabulary, k=80))) for i in range(80)]
    noise = " ".join("".join(rng.choices("qzxjkv0123456789", k=6)) for _ in range(60))
    got = {r.doc_id: r.logprob for r in lm.scores(make([*rows, (99, noise)])).collect()}
    assert got[99] < 2 * min(v for i, v in got.items() if i != 99)


def test_odd_rows_and_empty(make, odd_rows):
    got = lm.scores(make(odd_rows, extra=True)).collect()
    assert len(got) == len(odd_rows)
    assert all(r.n_words == 0 and r.logprob is None and r.perplexity is None for r in got if r.doc_id in (1, 2, 3))
    four = [r for r in got if r.doc_id == 4]
    assert len(four) == 2 and four[0] == four[1] and four[0].logprob is not None
    assert lm.scores(make([])).collect() == []
    assert [tuple(r)[:2] for r in lm.scores(make([(1, "alone in the world")])).collect()] == [(1, 4)]
