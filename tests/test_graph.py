import random

import pytest
from pyspark.sql import types as T

from ctxcost.operators import modules, reach, tiers
from ctxcost.schema import MODULE
from ctxcost.sources import aliases, script

D = "__default__"


def m(imports=(), reexports=(), names=()):
    return {
        "imports": [{"source": s, "names": list(n), "namespace": w} for s, n, w in imports],
        "reexports": [{"source": s, "names": list(n), "star": w} for s, n, w in reexports],
        "exported_names": list(names),
    }


PARSES = [
    ("import { a, b as c } from './x';", m([("./x", ["a", "b"], False)])),
    ("import d from './x'", m([("./x", [D], False)])),
    ("import d, { e } from \"./x\"", m([("./x", [D, "e"], False)])),
    ("import * as ns from './x'", m([("./x", [], True)])),
    ("import './effects'", m()),
    ("import type { T } from './t'", m([("./t", ["T"], False)])),
    ("export { a, b as c } from './y'", m((), [("./y", ["a"], False), ("./y", ["b"], False)], ["a", "c"])),
    ("export * from './z'", m((), [("./z", [], True)])),
    ("export * as all from './z'", m((), [("./z", [], True)])),
    ("const a = 1; export { a, a as b };", m(names=["a", "b"])),
    ("export default function f() {}", m(names=[D])),
    ("export function f() {}\nexport class C {}\nexport const x = 1\nexport enum E { A }", m(names=["f", "C", "x", "E"])),
    ("import x from 'y'\nexport const a = () => { b, c }, d = [1, 2], e: number = 3", m([("y", [D], False)], names=["a", "d", "e"])),
    ("import q from 'q'; export interface I {}\nexport type T = string\nexport async function g() {}", m([("q", [D], False)], names=["g"])),
    ("const { a, b: c } = require('./x')", m([("./x", ["a", "b"], False)])),
    ("const x = require('./x')", m([("./x", [], True)])),
    ("require('./x')", m([("./x", [], True)])),
    ("foo(require(`./x`).bar)", m([("./x", [], True)])),
    ("const p = import('./lazy')", m([("./lazy", [D], False)])),
    ("module.exports = { a, b: 1, 'c': 2 }", m(names=["a", "b", "c"])),
    ("module.exports = function () {}", m(names=[D])),
    ("exports.a = 1; module.exports.b = 2", m(names=["a", "b"])),
    ("// import x from './no'\n/* require('./no') */ const s = \"import y from './no'\"; const r = /require('x')/; module.exports.k = `import('./no')`", m(names=["k"])),
    ("require(name); import(`./${x}`)", m()),
    ("", m()),
]


@pytest.mark.parametrize("text, want", PARSES, ids=[t[:40] for t, _ in PARSES])
def test_parse(text, want):
    assert script.parse(text, ".ts") == want


def test_parse_on_a_column(spark):
    df = spark.createDataFrame([(t,) for t, _ in PARSES] + [(None,)], "t string")
    got = {r.t: r.m for r in df.select("t", script.module(df.t).alias("m")).collect()}
    assert got.pop(None) is None and all(got[t].asDict(True) == w for t, w in PARSES)
    assert script.parse("export const a = 1", ".py") is None


def graph(spark, files, aliases_=None, declared=()):
    rows = [(i, p, 1, script.parse(t, "." + p.rsplit(".", 1)[1])) for i, (p, t) in enumerate(files.items())]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("module", MODULE)])
    df = spark.createDataFrame(rows, schema)
    specs = spark.createDataFrame([(d,) for d in declared], "spec string")
    table = aliases.table(spark, aliases_) if aliases_ else None
    return {r.path: (r.orphan_module, r.dead_export_symbols) for r in modules.signals(df, df.select("path", "module"), specs, table).collect()}


def test_four_files(spark):
    files = {"src/index.ts": "import { used } from './lib'", "src/lib.ts": "export const used = 1\nexport const deadFn = 2", "src/orphan.ts": "export const nothing = 1", "src/reexported.ts": "export { used as reused } from './lib'"}
    assert graph(spark, files) == {"src/index.ts": (False, None), "src/lib.ts": (False, ["deadFn"]), "src/orphan.ts": (True, ["nothing"]), "src/reexported.ts": (True, ["reused"])}


def test_extensions_twins_and_declared_entries(spark):
    files = {"src/index.ts": "import { thing } from './types.js'\nimport * as d from './dir'", "src/types.ts": "export const thing = 1", "src/dir/index.tsx": "export const a = 1, b = 2", "src/tool.mjs": "export const t = 1", "src/tool.ts": "export const u = 1", "run.js": "require('./lib')", "lib.js": "exports.x = 1"}
    got = graph(spark, files, declared=["dist/tool.js", "run.js"])
    assert got["src/types.ts"] == (False, None) and got["src/dir/index.tsx"] == (False, None) and got["lib.js"] == (False, None)
    assert got["src/tool.ts"] == (False, None) and got["src/tool.mjs"] == (True, ["t"])


def test_aliases(spark):
    files = {"src/index.ts": "import { h } from '@/lib/helper'\nimport x from 'exact'\nimport y from '@up/z'", "src/lib/helper.ts": "export const h = 1", "src/x.ts": "export default 1", "z.ts": "export default 2"}
    rules = [aliases.Aliases("", (aliases.Rule("@/*", ("src/*",)), aliases.Rule("exact", ("src/x.ts",)), aliases.Rule("@up/*", ("../*",))))]
    got = graph(spark, files, rules)
    assert got["src/lib/helper.ts"] == (False, None) and got["src/x.ts"] == (False, None) and got["z.ts"][0]
    assert aliases.apply("@/lib/helper", rules[0]) == "src/lib/helper" and aliases.apply("@up/z", rules[0]) is None and aliases.apply("./a", rules[0]) is None


def test_reachability_with_cycles(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(220)] + [(1, 2), (2, 3), (3, 1)]
    seen, todo = set(), [1, 77]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for a, b in edges if a == n]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    got = [r.node for r in reach.reachable(spark.createDataFrame([("1",), ("77",), ("1",)], "node string"), df).collect()]
    assert sorted(got) == sorted(map(str, seen))


def test_tiers(spark):
    texts = {"CLAUDE.md": "see @imports/style.md and @gone.md", "imports/style.md": "then @/deep/a.mdx", "deep/a.mdx": "back to @../CLAUDE.md", "vendor/sdk.js": "x", "src/index.ts": "y", "vendor/AGENTS.md": ""}
    kind = {"vendor/sdk.js": "vendored", "src/index.ts": "source", "vendor/AGENTS.md": "vendored"}
    files = spark.createDataFrame([(p, kind.get(p, "doc")) for p in texts], "path string, kind string")
    got = {r.path: r.tier for r in tiers.assign(files, spark.createDataFrame(list(texts.items()), "path string, text string")).collect()}
    assert got == {"CLAUDE.md": 0, "imports/style.md": 0, "deep/a.mdx": 0, "vendor/sdk.js": 2, "src/index.ts": 1, "vendor/AGENTS.md": 0}


def test_no_side_of_the_graph_is_broadcast(spark):
    """Sizes guessed from a scan's columns are far below what the texts and candidates of a large tree take in the driver."""
    rows = [(f"m{i}.ts", script.parse(f"import {{f}} from './m{i + 1}'\nexport * from './m{i + 2}'", ".ts")) for i in range(9)]
    mods = spark.createDataFrame(rows, T.StructType([T.StructField("path", T.StringType()), T.StructField("module", MODULE)]))
    files = mods.select("path")
    used = modules.uses(mods, files)
    for df in (modules.edges(used), modules.dead_exports(mods, used, files.limit(1).withColumnRenamed("path", "node"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.src, r.dst) for r in modules.edges(used).collect()} == {(f"m{i}.ts", f"m{j}.ts") for i in range(9) for j in (i + 1, i + 2) if j < 9}
