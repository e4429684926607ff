import random
import re

import pytest

from ctxcost.llm import line_windows as lw
from ctxcost.llm import simhash_forest as sf

from .conftest import prose, words

SPACE = "\t\n\x0b\x0c\r "


def cut(text):
    """Lines of a text: sentences by one regular expression, cut after each word whose mark is the least of some twelve."""
    out = []
    for p in re.sub(rf"([.!?])(?=[{SPACE}])", "\\1\x01", text).replace("\n", "\n\x01").split("\x01"):
        words_ = re.findall(rf"[{SPACE}]*[^{SPACE}]+", p)
        mark = [sum((i + 1) * b for i, b in enumerate(w.strip(SPACE).encode())) * 40503 % 65536 for w in words_]
        ends = {max(range(i, i + lw.WORDS), key=lambda j: (-mark[j], j)) for i in range(len(words_) - lw.WORDS + 1)}
        line = ""
        for i, w in enumerate(words_):
            line += w
            if i in ends and i < len(words_) - 1:
                out.append(line)
                line = ""
        out.append(line + p[sum(map(len, words_)) :])
    return [x for x in out if x]


def brute(docs, twin=lambda a, b: False, min_bytes=lw.MIN_BYTES):
    """{row: text} after removal; rows in the order of (doc_id, nulls last)."""
    seen, out = {}, {}
    for row in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0)):
        text = docs[row][1]
        if text is None:
            out[row] = None
            continue
        lines = cut(text)
        full = [i for i, x in enumerate(lines) if x.strip(SPACE)]
        gone = set()
        for n in range(len(full) - 2):
            at = full[n : n + 3]
            key = tuple(lines[i].strip(SPACE) for i in at)
            if key in seen and not twin(docs[row], docs[seen[key]]):
                gone |= set(range(at[0], at[2] + 1))
            seen.setdefault(key, row)
        for i in sorted(gone):
            if i - 1 not in gone:
                end = next(j for j in range(i, len(lines) + 1) if j not in gone)
                if sum(len(x.encode()) for x in lines[i:end]) < min_bytes:
                    gone -= set(range(i, end))
        out[row] = "".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    passages = [prose(rng, 4) for _ in range(4)] + [" ".join(words(rng, 60)), "Ah. Oh. Eh."]
    out = []
    for i in range(120):
        parts = [prose(rng, rng.randint(1, 4)) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        out.append((i, rng.choice(("\n", "\n\n", " \t\n ")).join(parts)))
    out += [(200, passages[0] + "\n" + passages[0] + "\n" + passages[0]), (201, " ".join(words(rng, 3000)))]
    rng.shuffle(out)
    return out


def test_equals_brute_force(make, docs):
    got = {r.doc_id: r for r in lw.cleaned(make(docs)).collect()}
    want = brute(docs)
    assert all(got[i].text == want[n] and got[i].n_chars == len(want[n]) for n, (i, _) in enumerate(docs))
    assert sum(want[n] != t for n, (_, t) in enumerate(docs)) > 40


def test_clean_documents_are_unchanged(make):
    rng = random.Random(13)
    rows = [(i, prose(rng)) for i in range(50)]
    assert {(r.doc_id, r.text) for r in lw.cleaned(make(rows)).collect()} == set(rows)


def test_odd_rows_and_empty(make, odd_rows):
    source = make(odd_rows, extra=True)
    got = lw.cleaned(source)
    assert got.columns == source.columns and got.count() == len(odd_rows)
    same = [r for r in got.collect() if r.doc_id in (4, 5)]
    assert sorted((r.doc_id, r.text) for r in same) == [(4, odd_rows[5][1]), (4, odd_rows[5][1]), (5, "")]
    assert {r.doc_id for r in lw.cleaned(source, drop_empty=True).collect()} == {None, 4, 6, 7, 8, -9, 9}
    assert lw.cleaned(make([])).collect() == []
    bare = lw.cleaned(make(odd_rows).select("doc_id", "text"))
    assert bare.columns == ["doc_id", "text"] and bare.count() == len(odd_rows)


def test_null_ids_come_last(make):
    rng = random.Random(14)
    text = prose(rng)
    got = lw.cleaned(make([(None, text), (7, text)])).collect()
    assert {(r.doc_id, r.text) for r in got} == {(7, text), (None, "")}


def test_a_passage_goes_at_each_word_offset(make):
    """However many words of its sentence come before a passage without a mark, none of its runs of fifty words is left twice."""
    rng = random.Random(15)
    sizes = (50, 60, 200, 2000)
    passages = [words(rng, n) for n in sizes]
    rows = [(n, " ".join(p)) for n, p in enumerate(passages)]
    rows += [(100 * n + 100 + k, " ".join(words(rng, k) + p + words(rng, 3))) for n, p in enumerate(passages) for k in range(13)]
    got = {r.doc_id: r.text.split() for r in lw.cleaned(make(rows)).collect()}
    for n, p in enumerate(passages):
        first = {tuple(p[i : i + 50]) for i in range(len(p) - 49)}
        assert got[n] == p
        for k in range(13):
            w = got[100 * n + 100 + k]
            assert len(w) <= k + 3 + 24 and not any(tuple(w[i : i + 50]) in first for i in range(len(w) - 49))


def test_a_passage_of_short_lines_goes(make):
    """Lines of one short word make small windows, but merged they are many bytes; a few short lines that repeat stay."""
    rng = random.Random(17)
    passage = [f"{w[:4]}!!" for w in words(rng, 163)]
    rows = [(i, "\n".join([*words(rng, 4), "{", "}", "};", *passage, *words(rng, 4), "{", "}", "};"])) for i in range(3)] + [(9, "onti. " * 120)]
    got = {r.doc_id: r.text.split() for r in lw.cleaned(make(rows)).collect()}
    assert got[0] == rows[0][1].split() and got[9] == ["onti."]
    assert all(not set(got[i]) & set(passage) and got[i][-3:] == ["{", "}", "};"] for i in (1, 2))
    more = {r.doc_id: r.text.split() for r in lw.cleaned(make(rows), min_bytes=1).collect()}
    assert more[1][-1] != "};" and len(more[1]) < len(got[1])


def test_many_tasks_rank_as_one(make, docs, monkeypatch):
    monkeypatch.setattr(lw, "_HELD", 50)
    got = {r.doc_id: r.text for r in lw.cleaned(make(docs).repartition(7)).collect()}
    want = brute(docs)
    assert all(got[i] == want[n] for n, (i, _) in enumerate(docs))


def test_near_copies_stay_whole(make):
    """Edited copies keep their lines, as they are one document's; a passage that unrelated documents share goes from them, too."""
    rng = random.Random(18)
    passage = prose(rng, 6)
    rows = [(0, prose(rng, 10) + "\n" + passage)]
    for g in range(1, 5):
        base = prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 20)
        rows += [(10 * g + i, " ".join(w if rng.random() > 0.01 * (i > 0) else "edited" for w in base.split(" "))) for i in range(6)]
    got = {r.doc_id: r.text for r in lw.cleaned(make(rows).coalesce(1), twins=sf.twins).collect()}
    plain = brute(rows)
    own = {i: t.replace(passage, "") for i, t in rows}
    for n, (i, t) in enumerate(rows[1:], 1):
        assert len(got[i]) > 0.8 * len(own[i])
        assert i % 10 == 0 or len(plain[n]) < 0.8 * len(own[i])
    assert all(passage not in got[10 * g] for g in range(1, 5)) and got[0] == rows[0][1]
    alone = {r.doc_id: r.text for r in sf.deduplicated(lw.cleaned(make(rows), twins=sf.twins)).collect()}
    assert sorted(alone) == [0, 10, 20, 30, 40]
