import json
import subprocess

import pytest

from ctxcost import cli, runtime
from ctxcost.plans import report
from ctxcost.plans.scan import scan

from .test_sources import write

TREE = {
    "package.json": json.dumps({"main": "./run.js", "bin": "./run.js"}), "run.js": "const lib = require('./lib')\n", "lib.js": "exports.x = 1\n", "orphan.cjs": "module.exports = 3\n",
    "CLAUDE.md": "Read @docs/style.md first. " + "word " * 60, "docs/style.md": "be brief, see [gone](missing.md)", "out/bundle.js": "var a=1", "package-lock.json": "{}", "vendor/sdk.js": "x()", "img/logo.png": b"\x89PNG\x00",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, TREE)
    return root


@pytest.fixture
def one_session(spark, monkeypatch):
    monkeypatch.setattr(runtime, "session", lambda *a: spark)


def test_scan(spark, tree):
    r = scan(spark, str(tree), budget=10)
    files = {x.path: x for x in r.files.collect()}
    assert set(files) == set(TREE) and files["lib.js"].orphan_module is False and files["orphan.cjs"].orphan_module and files["docs/style.md"].tier == 0
    assert files["img/logo.png"].kind == "binary" and files["img/logo.png"].tokens == 0 and files["docs/style.md"].referenced_paths == ["docs/missing.md"]
    found = {(x.path, x.detector) for x in r.findings.collect()}
    assert {("out/bundle.js", "generated"), ("package-lock.json", "generated"), ("vendor/sdk.js", "vendored"), ("CLAUDE.md", "t0-overweight"), ("docs/style.md", "stale-doc"), ("orphan.cjs", "orphan-module")} <= found
    assert r.rollup.resident_tokens > 10 and r.rollup.over_budget and r.rollup.file_count == len(TREE)
    r.views("t_")
    assert spark.sql("SELECT count(*) AS n FROM t_file_records").first().n == len(TREE)


def test_snapshot_gives_the_same(spark, tree, tmp_path):
    kept = str(tmp_path / "kept")
    one, two = (scan(spark, str(tree), reuse=kept, now=1_700_000_000) for _ in range(2))
    rows = lambda r: sorted(map(str, r.files.collect())) + sorted(map(str, r.findings.collect()))
    assert rows(one) == rows(two)


def test_command_line(tree, one_session, capsys):
    assert cli.main(["--json", "--budget", "10", str(tree)]) == 1
    out = json.loads(capsys.readouterr().out)
    assert out["schemaVersion"] == 1 and list(out["rollup"]) == ["fileCount", "residentTokens", "reachableTokens", "ambientTokens", "budget", "overBudget", "overagePct", "recoverableTokens"]
    assert out["rollup"]["budget"] == 10 and set(out["findings"][0]) == {"path", "detector", "confidence", "reason", "suggest"}
    assert cli.main(["--budget", "100000", str(tree)]) == 0
    text = capsys.readouterr().out
    places = [n for x in ("Resident context", "  IGNORE", "  SPLIT", "  DELETE", "  REVIEW") if (n := text.find(x)) >= 0]
    assert places[0] == 0 and len(places) > 2 and places == sorted(places)
    assert cli.main(["--json", "--emit-ignore", str(tree)]) == 2 and cli.main(["--nonsense"]) == 2 and cli.main(["--budget", "x"]) == 2
    assert cli.main(["--emit-ignore", str(tree)]) == 0
    assert "+package-lock.json" in capsys.readouterr().out


def test_a_settings_file_sets_the_budget(tmp_path, one_session, capsys):
    write(tmp_path, {"CLAUDE.md": "word " * 50, ".ctxcostrc": '{"budget": 5}'})
    assert cli.main([str(tmp_path)]) == 1
    write(tmp_path, {".ctxcostrc": "{}"})
    assert cli.main([str(tmp_path)]) == 0  # the default budget can't fail a run
    assert "resident files by token cost" in capsys.readouterr().out


def test_ignore_patches(spark):
    found = spark.createDataFrame([("b.js", "ignore"), ("a.js", "ignore"), ("a.js", "ignore"), ("r.md", "review")], "path string, suggest string")
    assert report.render_ignore_patch(None, found, ".x") == "--- /dev/null\n+++ b/.x\n@@ -0,0 +1,2 @@\n+a.js\n+b.js\n"
    assert report.render_ignore_patch("# c\na.js\n", found, ".x") == "--- a/.x\n+++ b/.x\n@@ -1,2 +1,3 @@\n # c\n a.js\n+b.js\n"
    assert report.render_ignore_patch("a.js\nb.js", found, ".x") == ""


def test_numbers():
    assert [report.format_tokens(n) for n in (0, 4812, 99_999, 312_400, 1_250_000)] == ["0", "4,812", "99,999", "312k", "1.2M"]
    assert [report.bar(r, 10) for r in (0, 5, 99)] == ["░" * 10, "█" * 5 + "░" * 5, "█" * 10] and report.bar(5, 0) == "░" * 10


def test_cells_round_halves_up():
    """Ties that a double holds exactly, and others; the SQL of report_cells has the same arithmetic."""
    assert [report.format_cell(n) for n in (4812, 312_400, 1_250_000, 752_250_000, 1_150_000, 1_249_999, 1_950_000, 999_999)] == ["4,812", "312k", "1.3M", "752.3M", "1.2M", "1.2M", "2.0M", "1000k"]


def test_module_entry(tree):
    assert subprocess.run(["python", "-m", "ctxcost", "--nonsense"], capture_output=True, timeout=120).returncode == 2
