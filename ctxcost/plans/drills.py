"""Queries of what reads text: the parsers and readers, on texts that the driver's tables generate and whose SQL knows the generator."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import docs, kinds, tokens
from ..operators import detect, history, ignore_rules, modules
from ..schema import Context
from ..sources import aliases, config, manifest, script
from ..store import written
from . import corpus, report
from .registry import query

def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))


def _chosen(templates: list[str], column: str = "k", next_: str = "@") -> Column:
    """The template that a number chooses, with # as the number and ``next_`` as the one after."""
    k = F.col(column)
    out = F.lit(templates[0])
    for i, t in enumerate(templates[1:], 1):
        out = F.when(k % len(templates) == i, F.lit(t)).otherwise(out)
    return F.replace(F.replace(out, F.lit("#"), k.cast("string")), F.lit(next_), (k + 1).cast("string"))


def _cases(rows: list[tuple[int, ...]], columns: str, of: int) -> str:
    """SQL of the rows that each kind of part gives; # and @ as in the templates."""
    values = ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, bool)) else "'" + str(x) + "'" for x in r) + ")" for r in rows)
    return f"""SELECT p_partkey AS k, c.* EXCLUDE (kind) FROM part JOIN (VALUES {values}) c(kind, {columns}) ON p_partkey % {of} = c.kind"""


def _filled(x: str) -> str:
    return f"replace(replace({x}, '#', CAST(k AS VARCHAR)), '@', CAST(k + 1 AS VARCHAR))"


# Kinds and banners -----------------------------------------------------------


@query("SELECT doc_id AS seq, doc_id % 2 = 0 AS sniffed, CASE WHEN doc_id % 6 IN (0, 2) THEN 'binary' ELSE 'source' END AS kind FROM documents")
def kind_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bytes decide where a path doesn't: a zero byte, or many control bytes."""
    i = F.col("seq")
    rows = corpus.documents(spark, sf_dir).select("seq", F.concat(F.when(i % 2 == 0, "data/f").otherwise("lib/l"), i.cast("string"), F.when(i % 2 == 0, "").otherwise(".py")).alias("path"), "text")
    lead = F.when(i % 6 == 2, F.lit("\x01" * 300)).when(i % 6 == 4, F.lit("\t\n")).otherwise(F.lit("a\x00"))
    sniffed = kinds.needs_sniff(F.col("path"))
    sample = F.when(sniffed, F.substring(F.concat(lead, F.col("text")).cast("binary"), 1, kinds.SNIFF_BYTES))
    return rows.select("seq", sniffed.alias("sniffed"), kinds.classify(F.col("path"), sample).alias("kind"))


_BANNERS = ["// Code generated by a tool. DO NOT EDIT.\n", "/* @generated */\n", "# This file is automatically generated\n", "Auto-Generated by #\n", "// generated by hand, please edit\n"]


@query("""SELECT doc_id AS seq, 'generated' AS detector, CASE WHEN doc_id % 5 < 4 AND doc_id % 7 <> 0 THEN 0.97::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
'generated file — ' || CASE WHEN doc_id % 5 < 4 AND doc_id % 7 <> 0 THEN 'path pattern and a generated-file header banner' ELSE 'matches a known lockfile/build-output path pattern' END AS reason FROM documents""")
def generated_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banners count in the first four thousand characters; one in seven begins later."""
    i = F.col("seq")
    text = F.concat(F.when(i % 7 == 0, F.lit("x" * tokens.HEAD_CHARS)).otherwise(F.lit("")), _chosen(_BANNERS, "seq", "\x02"), F.regexp_replace("text", "(?i)generated|edit", ""))
    rows = corpus.documents(spark, sf_dir).select("seq", F.concat(F.lit("dist/g"), i.cast("string")).alias("path"), text.alias("text"))
    size, content = F.octet_length("text"), F.col("text").cast("binary")
    head = tokens.measure(F.col("path"), content, size, F.lit(2), F.lit("generated"))["head"]
    found = detect.generated(rows.select("seq", "path", kinds.classify(F.col("path")).alias("kind"), docs.looks_generated(head).alias("generated_header")), Context())
    return found.select("seq", "detector", "confidence", "reason")


@query("SELECT p_partkey AS k, p_partkey % 5 IN (0, 1, 2) AS pruned FROM part")
def baseline_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that no scan enters, at any depth, and others whose names only begin alike."""
    path = _chosen(["a/.git", "p#/node_modules", ".git", "node_modules#", "a/.github"])
    return _parts(spark, sf_dir).select("k", ignore_rules.is_ignored(path, ignore_rules.baseline(), is_dir=True).alias("pruned"))


@query(f"""SELECT path, CAST(t AS BIGINT) AS ts, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'a/f' ELSE 'b c/' END || user_id AS path, last_value(CASE WHEN event_type <> 'error' THEN floor(epoch(ts)) END IGNORE NULLS) OVER (ORDER BY event_id) AS t FROM events
) WHERE t IS NOT NULL GROUP BY ALL""")
def log_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of which each event is a commit of one path; errors have no line of their own and belong to the commit before."""
    e = corpus.table(spark, sf_dir, "events")
    ts = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").cast("string")
    path = F.concat(F.when(F.col("user_id") % 2 == 0, "a/f").otherwise("b c/"), F.col("user_id").cast("string"))
    mark = e.where("event_type <> 'error'").select((F.col("event_id") * 3).alias("n"), F.concat(F.lit(history.MARK), ts).alias("line"))
    lines = mark.unionByName(e.select((F.col("event_id") * 3 + 1).alias("n"), path.alias("line"))).unionByName(e.select((F.col("event_id") * 3 + 2).alias("n"), F.lit("").alias("line")))
    return history.parse_log(lines).groupBy("path", "ts").agg(F.count("*").alias("n"))


# Modules ---------------------------------------------------------------------

_MODULES = [
    "import {f@ as a, g#} from './m@.ts'\nexport const f# = a\nexport function g#() {}\n",
    "import d from './m@'\nimport * as ns from \"./n#\"\nexport default class {}\n",
    "const {f@, g#: x} = require('./m@')\nconst whole = require('./m#.js')\nmodule.exports = {f#, g#}\n",
    "export {f@ as h#, g#} from './m@'\nexport * from './n#'\n",
    "export const f# = 1;\nexport async function g#() {}\nexport class C# {}\n",
    "// import {x} from './no'\nconst s = \"import y from './no'\";\nconst r = /from '.\\/no'/;\nexport {s as f#, r};\n",
    "exports.f# = 1;\nexports.g# = function () {}\nconst lazy = () => import('./m@');\n",
    "const t = `import z from './no${1}'`;\nexport const f# = t\nimport {q} from './m@'\n",
]
_SURFACE = [
    (0, "import", "./m@.ts", "f@", False), (0, "import", "./m@.ts", "g#", False), (0, "export", "", "f#", False), (0, "export", "", "g#", False),
    (1, "import", "./m@", "__default__", False), (1, "import", "./n#", "", True), (1, "export", "", "__default__", False),
    (2, "import", "./m@", "f@", False), (2, "import", "./m@", "g#", False), (2, "import", "./m#.js", "", True), (2, "export", "", "f#", False), (2, "export", "", "g#", False),
    (3, "reexport", "./m@", "f@", False), (3, "reexport", "./m@", "g#", False), (3, "reexport", "./n#", "", True), (3, "export", "", "h#", False), (3, "export", "", "g#", False),
    (4, "export", "", "f#", False), (4, "export", "", "g#", False), (4, "export", "", "C#", False),
    (5, "export", "", "f#", False), (5, "export", "", "r", False),
    (6, "import", "./m@", "__default__", False), (6, "export", "", "f#", False), (6, "export", "", "g#", False),
    (7, "import", "./m@", "q", False), (7, "export", "", "f#", False),
]


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.spread(_parts(spark, sf_dir)).select("k", script.module(_chosen(_MODULES)).alias("module"))


@query(f"SELECT k, what, {_filled('source')} AS source, {_filled('name')} AS name, whole FROM ({_cases(_SURFACE, 'what, source, name, whole', len(_MODULES))})")
def module_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, re-exports and exports of eight kinds of module: named, default, namespace, require, star, only declarations, disguises and lazy imports."""
    rows = _parsed(spark, sf_dir)
    each = [rows.select("k", F.lit(what).alias("what"), F.explode(f"module.{field}").alias("u")).select("k", "what", "u.source", F.explode_outer("u.names").alias("name"), F.col(f"u.{whole}").alias("whole")) for what, field, whole in (("import", "imports", "namespace"), ("reexport", "reexports", "star"))]
    own = rows.select("k", F.lit("export").alias("what"), F.lit("").alias("source"), F.explode("module.exported_names").alias("name"), F.lit(False).alias("whole"))
    return each[0].unionByName(each[1]).unionByName(own).withColumn("name", F.coalesce("name", F.lit("")))


_EDGES = {(k, to) for k, what, source, *_ in _SURFACE if what != "export" and source[:3] == "./m" for to in source[3]}


@query(f"""WITH e AS (SELECT k, CASE up WHEN 1 THEN k + 1 ELSE k END AS dst FROM ({_cases([(k, int(to == "@")) for k, to in sorted(_EDGES)], "up", len(_MODULES))}))
SELECT DISTINCT 'src/m' || k || '.ts' AS src, 'src/m' || dst || '.ts' AS dst FROM e WHERE dst IN (SELECT p_partkey FROM part)""")
def parsed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module graph from texts: parsed once, resolved against the known files, and joined."""
    rows = written(_parsed(spark, sf_dir).select(F.concat(F.lit("src/m"), F.col("k").cast("string"), F.lit(".ts")).alias("path"), "module"), "modules")
    return modules.edges(modules.uses(rows.select("path", "module"), rows.select("path")))


# Manifests, aliases and settings ---------------------------------------------

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@F.udf(T.ArrayType(_S), useArrow=True)
def _declared(text: str) -> list[str]:
    return manifest.entrypoints(json.loads(text))


_PACKAGES = [
    '{"name": "p", "main": "./dist/m#.js", "bin": {"p": "bin/m#.js"}}',
    '{"exports": {".": {"import": "./dist/e#.mjs", "types": ["./t#.d.ts"]}, "./x": "./x#.js"}, "bin": "./t#.d.ts"}',
    '{"scripts": {"s": "node ./scripts/s#.js --watch src/w@.ts", "t": "echo no"}, "main": "https://x.y/z.js"}',
    '["main", "m#.js"]',
]
_SPECS = [
    (0, 0, "dist/m#.js"), (0, 1, "src/m#.js"), (0, 2, "src/m#.ts"), (0, 3, "src/m#.mjs"), (0, 4, "bin/m#.js"),
    (1, 0, "t#.d.ts"), (1, 1, "dist/e#.mjs"), (1, 2, "src/e#.mjs"), (1, 3, "src/e#.ts"), (1, 4, "x#.js"), (2, 0, "scripts/s#.js"), (2, 1, "src/w@.ts"),
]


@query(f"SELECT k, CAST(i AS INTEGER) AS i, {_filled('spec')} AS spec FROM ({_cases(_SPECS, 'i, spec', len(_PACKAGES))})")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packages declare, with the sources that built files come from."""
    return _parts(spark, sf_dir).select("k", F.posexplode(_declared(_chosen(_PACKAGES))).alias("i", "spec"))


_RULES = T.ArrayType(_struct(base=_S, pattern=_S, target=_S))


def _rows(found: aliases.Aliases | None) -> list[tuple[str, str, str]]:
    return [(found.base_url, r.pattern, r.targets[0]) for r in found.rules] if found else []


@F.udf(_RULES, useArrow=True)
def _compiler(text: str) -> list[tuple[str, str, str]]:
    return _rows(aliases.parse_compiler(json.loads(aliases.strip_jsonc(text)), "pkg/a"))


@F.udf(_RULES, useArrow=True)
def _bundler(text: str) -> list[tuple[str, str, str]]:
    return _rows(aliases.parse_bundler(text))


_COMPILERS = [
    '{ // a comment\n "compilerOptions": {"baseUrl": "./src", /* another */ "paths": {"@/*": ["app#/*", "lib/*"], "@/long/*": ["long//x/*"], "e": "e#.ts",},},}',
    '{"compilerOptions": {"paths": {"~/*": ["./u#/*"], "//no": [3], "": ["x"]}}}',
    '{"compilerOptions": {"baseUrl": "../..", "paths": {"@lib": ["lib\\\\l#"]}}}',
    '{"compilerOptions": {"baseUrl": "."}}',
]
_COMPILED = [(0, 0, "pkg/a/src", "@/long/*", "long//x/*"), (0, 1, "pkg/a/src", "@/*", "app#/*"), (0, 2, "pkg/a/src", "e", "e#.ts"), (1, 0, "pkg/a", "~/*", "./u#/*"), (2, 0, "", "@lib", "lib/l#")]


@query(f"SELECT k, CAST(i AS INTEGER) AS i, base, pattern, {_filled('target')} AS target FROM ({_cases(_COMPILED, 'i, base, pattern, target', len(_COMPILERS))})")
def compiler_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path rules of compiler settings with comments and trailing commas, longest pattern first."""
    return _parts(spark, sf_dir).select("k", F.posexplode(_compiler(_chosen(_COMPILERS, next_="\x02"))).alias("i", "r")).select("k", "i", "r.*")


_BUNDLERS = [
    "export default { resolve: { alias: { '@': path.resolve(__dirname, './src/a#'), \"~long\": './lib#/', 'x$': 'y#.js', 'up': '../no' } } }",
    "alias: [{ find: '*c', replacement: fileURLToPath(new URL('./c#', import.meta.url)) }, { find: 'dd', replacement: 'd#' }]",
    "alias: computed()",
]
_BUNDLED = [(0, 0, "~long/*", "lib#/*"), (0, 1, "@/*", "src/a#/*"), (0, 2, "x", "y#.js"), (1, 0, "*c/*", "c#/*"), (1, 1, "dd/*", "d#/*")]


@query(f"SELECT k, CAST(i AS INTEGER) AS i, pattern, {_filled('target')} AS target FROM ({_cases(_BUNDLED, 'i, pattern, target', len(_BUNDLERS))})")
def bundler_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal aliases of bundler settings, in the object and in the list form."""
    return _parts(spark, sf_dir).select("k", F.posexplode(_bundler(_chosen(_BUNDLERS, next_="\x02"))).alias("i", "r")).select("k", "i", "r.pattern", "r.target")


@F.udf(_struct(budget=T.DoubleType(), budget_explicit=T.BooleanType(), cadence=T.MapType(T.IntegerType(), T.DoubleType())), useArrow=True)
def _settings(text: str) -> dict:
    x = asdict(config.parse(json.loads(text)))
    return x | {"budget": float(x["budget"])}


_CONFIGS = ['{"budget": 1#, "cadence": {"0": 2, "1": 0.#}}', '{"budget": -#}', '{"cadence": {"2": "x", "7": 1, "1": 0}}', "[#]", '{"budget": true, "other": #}']


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN CAST('1' || p_partkey AS DOUBLE) ELSE 3000::DOUBLE END AS budget, p_partkey % 5 = 0 AS budget_explicit,
CASE WHEN p_partkey % 5 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w0, CASE p_partkey % 5 WHEN 0 THEN CAST('0.' || p_partkey AS DOUBLE) WHEN 2 THEN 0::DOUBLE ELSE 0.15::DOUBLE END AS w1, 0.05::DOUBLE AS w2 FROM part""")
def settings_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets and weights of settings files, the defaults for what doesn't fit."""
    rows = _parts(spark, sf_dir).select("k", _settings(_chosen(_CONFIGS)).alias("s"))
    return rows.select("k", "s.budget", "s.budget_explicit", *(F.col("s.cadence")[i].alias(f"w{i}") for i in range(3)))


# Reports ---------------------------------------------------------------------


@F.udf(_struct(n=_S, bar=_S, line=_S), useArrow=True)
def _cell(n: int, budget: int) -> tuple[str, str, str]:
    return report.format_cell(n), report.bar(n, budget), f"  {f'p{n}':<50}{report.format_cell(n)}"


_N = "CASE WHEN n >= 1000000 THEN CAST(n // 1000000 + CASE WHEN round_ = 10 THEN 1 ELSE 0 END AS VARCHAR) || '.' || round_ % 10 || 'M' WHEN n >= 100000 THEN CAST((n + 500) // 1000 AS VARCHAR) || 'k' ELSE format('{:,}', n) END"


@query(f"""WITH v AS (SELECT p_partkey AS k, p_partkey * p_partkey * 37 + 3 AS n, p_partkey * 500 AS budget FROM part), r AS (SELECT *, (n % 1000000 + 50000) // 100000 AS round_ FROM v),
f AS (SELECT k, n, {_N} AS cell, CASE WHEN budget > 0 THEN greatest(0, least(10, CAST(floor(n / budget::DOUBLE * 10 + 0.5) AS BIGINT))) ELSE 0 END AS full_ FROM r)
SELECT k, cell, repeat('█', CAST(full_ AS BIGINT)) || repeat('░', CAST(10 - full_ AS BIGINT)) AS bar, rpad('  p' || n, 52, ' ') || cell AS line FROM f""")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, bars and padded lines as the report prints them."""
    rows = _parts(spark, sf_dir).select("k", F.expr("k * k * 37 + 3").alias("n"), F.expr("k * 500").alias("budget"))
    return rows.select("k", _cell("n", "budget").alias("c")).select("k", F.col("c.n").alias("cell"), "c.bar", "c.line")


@query("""SELECT n_name AS name, row_number() OVER (ORDER BY n_name COLLATE de, n_name) AS place FROM (
  SELECT n_name FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT lower(n_name) || 'é' FROM nation WHERE n_nationkey % 2 = 0)""")
def unicode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order that a patch lists its paths in, over a table of fixed size."""
    n = corpus.table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    names = n.select(F.col("n_name").alias("name")).unionByName(n.select(F.lower("n_name").alias("name"))).unionByName(n.where("n_nationkey % 2 = 0").select(F.concat(F.lower("n_name"), F.lit("é")).alias("name")))
    return names.select("name", F.row_number().over(W.orderBy(F.collate("name", "UNICODE"), "name")).cast("long").alias("place"))
