import json
import os
import random
import subprocess
import warnings

import pytest
from pyspark.sql import functions as F

from ctxcost.operators import history, ignore_rules
from ctxcost.sources import aliases, config, git, manifest, walk


def write(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


def paths(root, **limits):
    return [f.path for f in walk.walk(str(root), walk.Limits(**limits))]


def test_walk(tmp_path):
    write(tmp_path, {"node_modules/x/index.js": "", "src/index.ts": "", ".gitignore": "*.log\n", "debug.log": "", "README.md": "", "src/_private.ts": "", ".cursorrules": ""})
    assert paths(tmp_path) == [".cursorrules", ".gitignore", "README.md", "src/_private.ts", "src/index.ts"]


def test_walk_limits(tmp_path):
    write(tmp_path, {"a.txt": "123456", "b.txt": "123456789", "c.txt": "12", "d/e/deep.txt": "1", "d/f.txt": "1"})
    assert paths(tmp_path, file_bytes=8) == ["a.txt", "c.txt", "d/f.txt", "d/e/deep.txt"]
    assert paths(tmp_path, total_bytes=7) == ["a.txt", "d/f.txt"]  # c.txt would pass the total, a smaller one still fits
    assert paths(tmp_path, depth=1) == ["a.txt", "b.txt", "c.txt", "d/f.txt"]
    assert len(paths(tmp_path, files=2)) == 2


def test_links_out_of_the_tree_are_left(tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "out"
    write(inside, {"a.txt": "", "d/b.txt": ""})
    write(outside, {"secret.txt": ""})
    os.symlink(outside, inside / "dir")
    os.symlink(outside / "secret.txt", inside / "file")
    os.symlink(inside, inside / "d" / "loop")
    os.symlink(inside / "nowhere", inside / "dead")
    os.symlink(inside / "a.txt", inside / "near")
    assert paths(inside) == ["a.txt", "near", "d/b.txt"]


RULES = [
    ("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("/build", "build", True), ("/build", "a/build", False), ("fixtures/**", "fixtures/a/b", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
    ("**/foo", "x/foo", True), ("**/foo", "foo", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/x/a.ts", False), ("# comment", "# comment", False), ("a.b", "axb", False),
]


@pytest.mark.parametrize("pattern, path, want", RULES)
def test_ignore_patterns(pattern, path, want):
    assert ignore_rules.ignores(ignore_rules.parse(pattern), path, False) == want


def test_ignore_order_and_columns(spark):
    rules = ignore_rules.baseline() + ignore_rules.parse("*.log\n!keep.log\nlogs/\n") + ignore_rules.parse("only.txt\n", "sub")
    cases = ["keep.log", "x.log", "logs", "sub/only.txt", "only.txt", "sub/x/only.txt", "dist", "a/node_modules"]
    assert [ignore_rules.ignores(rules, p, False) for p in cases] == [False, True, False, True, False, True, False, False]
    assert ignore_rules.ignores(rules, "logs", True) and ignore_rules.ignores(rules, "a/dist", True)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "i int, p string")
    for is_dir in (False, True):
        got = [r.y for r in df.select("i", ignore_rules.is_ignored(F.col("p"), rules, is_dir).alias("y")).orderBy("i").collect()]
        assert got == [ignore_rules.ignores(rules, p, is_dir) for p in cases]


def test_contents(spark, tmp_path):
    write(tmp_path, {"a.txt": "hello", "b.bin": b"\x00\xff", "c.txt": "unread"})
    listed = walk.files(spark, walk.listing(str(tmp_path)))
    got = {r.path: r.content for r in walk.with_content(listed, F.col("path") != "c.txt", F.when(F.col("path") == "a.txt", 2)).collect()}
    assert got == {"a.txt": b"he", "b.bin": b"\x00\xff", "c.txt": None}
    assert [r.seq for r in listed.orderBy("path").collect()] == [0, 1, 2] and walk.files(spark, walk.listing(str(tmp_path / "none"))).count() == 0


def test_git(spark, tmp_path):
    run = lambda *a, **e: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, env={**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", **e})
    assert git.commits(spark, str(tmp_path)).collect() == [] and not git.is_repository(str(tmp_path))
    run("init", "-q")
    write(tmp_path, {"sub/é x.md": "1", "b.txt": "1", "gone.txt": "1"})
    run("add", "."), run("commit", "-qm", "one", GIT_COMMITTER_DATE="1600000000 +0000")
    write(tmp_path, {"b.txt": "2"})
    os.remove(tmp_path / "gone.txt")
    run("add", "-A"), run("commit", "-qm", "two", GIT_COMMITTER_DATE="1700000000 +0000")
    seen = {r.path: (r.last_commit, r.commits_90d) for r in history.history(git.commits(spark, str(tmp_path)), 1_700_000_100).collect()}
    assert seen == {"sub/é x.md": (1_600_000_000, None), "b.txt": (1_700_000_000, 1), "gone.txt": (1_600_000_000, None)}
    assert {r.path for r in git.commits(spark, str(tmp_path / "sub")).collect()} == {"é x.md"}


def test_log_lines(spark):
    lines = ["early", "\x011700000000", "", "a.txt", "b.txt", "\x011600000000", "a.txt", "\x01broken"]
    got = history.parse_log(spark.createDataFrame(list(enumerate(lines)), "n int, line string").where("line <> '\x01broken'")).collect()
    assert sorted((r.path, r.ts) for r in got) == [("a.txt", 1_600_000_000), ("a.txt", 1_700_000_000), ("b.txt", 1_700_000_000)]


def test_a_long_log_is_cut_into_ranges(spark, monkeypatch):
    """Marks carry over ranges without one, in each repository; no task has the whole log."""
    monkeypatch.setattr(history, "LINES_AT_ONCE", 7)
    rng = random.Random(3)
    for repos in ([None], ["a", "b", None]):
        rows = [(r, i * 2, f"\x01{1000 + i}" if rng.random() < 0.06 else rng.choice(["", "x", f"f{i}"])) for r in repos for i in range(90)]
        rows += [(repos[0], None, "\x015")]
        want = []
        for r in repos:
            ts = None
            for _, _, line in sorted((x for x in rows if x[0] == r), key=lambda x: -1 if x[1] is None else x[1]):
                if line.startswith("\x01"):
                    ts = int(line[1:])
                elif line and ts is not None:
                    want.append((line, ts))
        shuffled = rng.sample(rows, len(rows))
        df = spark.createDataFrame(shuffled, "repo string, n long, line string")
        got = history.parse_log(df if len(repos) > 1 else df.drop("repo"))
        assert sorted((x.path, x.ts) for x in got.collect()) == sorted(want) and len({ts for _, ts in want}) > 5
        windows = [x for x in str(got._jdf.queryExecution().optimizedPlan()).splitlines() if "last(ts#" in x]
        assert windows and all("windowspecdefinition(" in x and "__range" in x.split("windowspecdefinition(")[1] for x in windows)
    assert history.parse_log(spark.createDataFrame([], "n long, line string")).count() == 0


def test_config(tmp_path):
    assert config.load(str(tmp_path)) == config.Config()
    (tmp_path / config.RC_NAME).write_text(json.dumps({"budget": 500, "cadence": {"1": 0.5}}))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = config.load(str(tmp_path))
    assert (got.budget, got.budget_explicit, got.cadence) == (500, True, {0: 1.0, 1: 0.5, 2: 0.05})
    for raw in ([], {"budget": -1}, {"budget": "9"}, {"other": 1}, {"cadence": {"7": 1}}, {"cadence": {"0": -1}}, {"cadence": 3}, {"budget": True}):
        with pytest.warns(UserWarning):
            assert config.parse(raw) == config.Config()
    (tmp_path / config.RC_NAME).write_text("{nope")
    with pytest.warns(UserWarning):
        assert config.load(str(tmp_path)) == config.Config()


def test_manifest(tmp_path):
    package = {"main": "./dist/index.js", "bin": {"x": "bin/x.mjs"}, "exports": {".": {"import": "./esm/a.js", "types": ["./t.d.ts"]}}, "scripts": {"go": "node scripts/go.js --x && tsx ./tools/t.ts"}}
    got = manifest.entrypoints(package)
    assert got[0] == "dist/index.js" and {"src/index.js", "src/index.ts", "src/index.mjs", "bin/x.mjs", "esm/a.js", "scripts/go.js", "tools/t.ts"} <= set(got)
    assert [manifest.normalise(x) for x in ("./a.js", "/abs.js", "https://x/y.js", "react", "a\\b.js", "index.js", "")] == ["a.js", None, None, None, "a/b.js", "index.js", None]
    assert manifest.entrypoints({"bin": "run.js"}) == ["run.js"] and manifest.entrypoints([]) == [] and manifest.load(str(tmp_path)) == []


def test_compiler_aliases(tmp_path):
    assert aliases.load_compiler(str(tmp_path)) is None
    write(tmp_path, {"tsconfig.json": '{ // base\n "extends": "./config/base.json", "compilerOptions": {"paths": {"@/*": ["src/*",], "@/lib/*": ["lib/*"]}}, }', "config/base.json": '{"compilerOptions": {"baseUrl": "..", "paths": {"~/*": ["./x/*"], "@/*": ["never/*"]}}}'})
    got = aliases.load_compiler(str(tmp_path))
    assert got.base_url == "" and [(r.pattern, r.targets[0]) for r in got.rules] == [("@/lib/*", "lib/*"), ("~/*", "./x/*"), ("@/*", "src/*")]
    assert json.loads(aliases.strip_jsonc('{"a": "x // y, }", /* c */ "b": [1, 2, ], }')) == {"a": "x // y, }", "b": [1, 2]}


def test_bundler_aliases(tmp_path):
    write(tmp_path, {"vite.config.ts": "throw 1; export default { resolve: { alias: { '@': path.resolve(__dirname, './src'), 'up': '../no', 'exact$': './one.ts', \"u\": fileURLToPath(new URL('./lib', import.meta.url)) } } }", "webpack.config.js": "module.exports = { resolve: { alias: [{ find: 'w', replacement: './web' }] } }"})
    got = {r.pattern: r.targets[0] for r in aliases.load_bundler(str(tmp_path)).rules}
    assert got == {"@/*": "src/*", "exact": "one.ts", "u/*": "lib/*", "w/*": "web/*"}
    assert aliases.load_bundler(str(tmp_path / "none")) is None
