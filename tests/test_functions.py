import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxcost.functions import docs, kinds, paths, tokens


def column(spark, values, f, type_="string"):
    """``f`` of each value, by one query."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {type_}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_paths(spark):
    def norm(p):
        out = []
        for s in p.split("/"):
            if s == "..":
                out = out[:-1]
            elif s not in ("", "."):
                out.append(s)
        return "/".join(out)

    cases = ["", "a", "a/b.TS", "/x//y/./z", "../../a", "docs/../CONTRIBUTING.md", ".gitignore", "a/.env.local", "a/b/../../../c.tar.GZ", "dir.d/file", "x."]
    assert column(spark, cases, paths.normalise) == [norm(c) for c in cases]
    assert column(spark, cases, paths.basename) == [c.split("/")[-1] for c in cases]
    assert column(spark, cases, paths.dirname) == [c.rpartition("/")[0] for c in cases]
    assert column(spark, cases, paths.extension) == ["", "", ".ts", "", "", ".md", "", ".local", ".gz", "", "."]
    refs = ["guide.md", "../CONTRIBUTING.md", "/abs/x.md", "~/home.md", "./"]
    assert column(spark, refs, lambda c: paths.resolve(c, F.lit("docs/a/b.md"))) == ["docs/a/guide.md", "docs/CONTRIBUTING.md", "abs/x.md", None, "docs/a"]


KINDS = {
    "package-lock.json": "generated", "Cargo.lock": "generated", "dist/app.js": "generated", "app.MIN.js": "generated", "api/x.pb.go": "generated", "db/migrations/001.sql": "generated", ".next/server.js": "generated",
    "__snapshots__/App.test.js.snap": "generated", "vendor/lib.js": "vendored", "a/node_modules/b/index.js": "vendored", "test/fixtures/sample.json": "fixture", "testdata/a.txt": "fixture", "README.md": "doc", "docs/x.RST": "doc",
    "src/index.ts": "source", "run.sh": "source", "Makefile": "source", ".gitignore": "source", "logo.PNG": "binary", "vendor/logo.png": "binary", "dist/font.woff2": "binary", "Vendor/x.js": "source",
}


def test_kinds(spark):
    assert dict(zip(KINDS, column(spark, list(KINDS), kinds.classify))) == KINDS
    names = ["a.min.js", "a.min", "x/a.MIN.css/b", "src/a.mjs", "src/index.ts", "util/posix-path.ts", "a.test.tsx", "a.spec.js", "b.bench.mjs", "x/main.go", "__init__.py", "pkg/CLAUDE.md", "noext", "build/noext", "a.unknown"]
    assert column(spark, names, kinds.is_minified)[:3] == [True, False, False]
    entry = dict(zip(names, column(spark, names, lambda c: kinds.is_entrypoint(c, F.lit(1)))))
    assert {n for n, e in entry.items() if e} == {"src/index.ts", "a.test.tsx", "a.spec.js", "b.bench.mjs", "x/main.go", "__init__.py"}
    assert all(column(spark, names, lambda c: kinds.is_entrypoint(c, F.lit(0))))
    assert dict(zip(names, column(spark, names, kinds.needs_sniff)))["noext"] and not dict(zip(names, column(spark, names, kinds.needs_sniff)))["build/noext"]
    assert column(spark, names, kinds.is_resident_name).index(True) == names.index("pkg/CLAUDE.md")


def test_binary_samples(spark):
    rng = random.Random(1)

    def plain(b):
        return bool(b) and (0 in b or sum(x < 7 or 14 < x < 32 and x != 27 for x in b) / len(b) > 0.3)

    cases = [b"", b"h\x00i", b"hello world", b"\x01" * 3 + b"a" * 7, b"\x01" * 4 + b"a" * 6, bytes([27] * 9), b"\xff\xfe"]
    cases += [bytes(rng.randrange(1, 40) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    cases += [bytes([b]) for b in range(256)]
    assert column(spark, cases, kinds.looks_binary, "binary") == [plain(c) for c in cases]
    assert column(spark, [b"a\x00b"], lambda c: kinds.classify(F.lit("Makefile"), c), "binary") == ["binary"]


SPACE = "\t\n\x0b\x0c\r \xa0       　﻿"


def count(text):
    n = sum(-(-len(m) // 4) for m in re.findall("[A-Za-z0-9_]+", text))
    rest = re.sub(f"[A-Za-z0-9_{SPACE}]", "", text)
    return n + sum(2 if ord(c) > 0xFFFF else 1 for c in rest)


def test_token_counts(spark):
    rng = random.Random(2)
    cases = ["", "hello world", "export const x = 1;", "é漢\U0001f600", "a\xa0b﻿c　d", "____", "\x0b\x0c"]
    cases += ["".join(rng.choices("ab_Z9 \n.é- \U0001f600", k=rng.randint(0, 80))) for _ in range(200)]
    assert column(spark, cases, tokens.count) == [count(c) for c in cases]
    assert column(spark, cases[:3], tokens.count) == [0, 4, 8]
    assert column(spark, [None], tokens.count) == [0]


def sampled(data, tier, kind, path="src/a.ts"):
    """Tokens and whether they are estimated, in plain Python."""
    if kind == "binary" or ".min." in path or data is None:
        return 0, True
    if tier == 0 or len(data) <= 16384:
        return count(data.decode("utf-8", "replace")), False
    middle = max(8192, len(data) // 2 - 4096)
    text = data[:8192].decode("utf-8", "replace") + data[middle : middle + 8192].decode("utf-8", "replace")
    n = count(text)
    return (int(len(data) / (len(text.encode()) / n) + 0.5) if n else 0), True


def test_measures(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(9000)).encode()
    cases = [(b"", 1, "source"), (b"hello world", 1, "source"), (long, 0, "doc"), (long, 1, "source"), (long[:16384], 1, "source"), (long[:16385], 1, "source"), (long, 1, "binary"), (None, 1, "source"), (b" " * 20000, 1, "source")]
    df = spark.createDataFrame([(i, b, len(b or b""), t, k) for i, (b, t, k) in enumerate(cases)], "i int, content binary, bytes long, tier int, kind string")
    m = tokens.measure(F.lit("src/a.ts"), F.col("content"), F.col("bytes"), F.col("tier"), F.col("kind"))
    got = [(r.m.tokens, r.m.estimated, len(r.m.head)) for r in df.select("i", m.alias("m")).orderBy("i").collect()]
    assert [g[:2] for g in got] == [sampled(*c) for c in cases]
    assert max(g[2] for g in got) == 4096
    mini = df.select(tokens.measure(F.lit("a.min.js"), F.col("content"), F.col("bytes"), F.col("tier"), F.col("kind")).alias("m")).collect()
    assert all(r.m.tokens == 0 and r.m.estimated for r in mini)


def test_links(spark):
    text = "[a](docs/guide.md) [b](https://x.y) [c](#top) [d](../CONTRIBUTING.md#part \"title\") ![i](img/x.png) [e](//cdn/x) [f](mailto:a@b.c) [g]( sp.md ) [h](~/x)"
    (got,) = column(spark, [text], docs.link_targets)
    assert got == ["docs/guide.md", "../CONTRIBUTING.md", "img/x.png", "sp.md", "~/x"]
    (got,) = column(spark, [text], lambda c: docs.resolved_links(c, F.lit("docs/readme.md")))
    assert got == ["docs/docs/guide.md", "CONTRIBUTING.md", "docs/img/x.png", "docs/sp.md"]


def test_banners(spark):
    cases = ["// @generated by x", "/* do not edit */", "Code generated by p. DO NOT EDIT.", "This file is automatically generated", "AUTO-GENERATED file", "// @Generated", "plain text", "", None]
    assert column(spark, cases, docs.looks_generated) == [True, True, True, True, True, False, False, False, False]


def simhash(text):
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    sh = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    if len(sh) < 8:
        return None
    votes = [0] * 32
    for s in sh:
        h = 0x811C9DC5
        for c in s.encode():
            h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
        for i in range(32):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(32) if votes[i] > 0)


def test_fingerprints(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeXY09é-", k=rng.randint(1, 9))) for _ in range(60)]
    cases = [" ".join(rng.choices(vocabulary, k=rng.choice((0, 5, 11, 12, 40, 300)))) for _ in range(80)] + ["same " * 50, "", "a b c d e f g h i j k l"]
    assert column(spark, cases, docs.simhash) == [simhash(c) for c in cases]
    assert column(spark, [None, cases[1]], docs.simhash) == [None, simhash(cases[1])]
    assert column(spark, ["hello", ""], docs.fnv1a32) == [1335831723, 0x811C9DC5]
    base = " ".join(rng.choices(vocabulary, k=300))
    a, b, c = simhash(base), simhash(base.replace(vocabulary[0], "edited", 1)), simhash(" ".join(rng.choices(vocabulary, k=300)))
    assert bin(a ^ b).count("1") < bin(a ^ c).count("1")


def test_texts_of_a_batch_are_read_in_parts(monkeypatch):
    """However many texts a batch has, few bytes of them are compared at once; each has its own fingerprint."""
    texts = [" ".join(f"w{i * k % 31}" for k in range(i % 40)) for i in range(300)] + [None, ""]
    want, sizes, whole = docs._fingerprint([(t or "").encode() for t in texts]), [], docs._fingerprint
    monkeypatch.setattr(docs, "TEXT_AT_ONCE", 1000)
    monkeypatch.setattr(docs, "_fingerprint", lambda held: sizes.append(sum(map(len, held))) or whole(held))
    got = list(docs._simhash.func(iter([pa.array(texts), pa.array([], pa.string()), pa.array(texts, pa.large_string())])))
    assert [g.to_pylist() for g in got] == [want, [], want]
    assert max(sizes) <= 1000 + max(len(t or "") for t in texts) and len(sizes) > 20


@pytest.mark.parametrize("a, b, d", [(10, 10, 0), (0, 15, 4), (0, 0xFFFFFFFF, 32)])
def test_hamming(spark, a, b, d):
    assert spark.range(1).select(docs.hamming(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("d")).first().d == d
