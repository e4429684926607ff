"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import docs, kinds, paths, tokens
from ..operators import detect, history, ignore_rules, modules, reach, score, snapshot, tiers
from ..schema import Context
from ..store import written
from . import corpus
from .registry import QUERIES, SQL, Query, query

CTX = Context(now=corpus.COLD_NOW)

# Parts of the SQL ------------------------------------------------------------

_PATH = """CASE {i} % 12 WHEN 0 THEN 'pkg' || {i} // 12 || '/CLAUDE.md' WHEN 1 THEN 'vendor/v' || {i} || '.js' WHEN 2 THEN 'gen/out/g' || {i} || '.js'
  WHEN 3 THEN 'a' || {i} || '.min.css' WHEN 4 THEN 'test/fixtures/f' || {i} || '.json' WHEN 5 THEN 'img/i' || {i} || '.png'
  WHEN 6 THEN 'docs/d' || {i} || '.md' WHEN 7 THEN 'docs/d' || {i} || '.md' WHEN 8 THEN 'docs/d' || {i} || '.md' ELSE 'src/s' || {i} || '.ts' END"""
_KIND = """CASE {i} % 12 WHEN 1 THEN 'vendored' WHEN 2 THEN 'generated' WHEN 3 THEN 'generated' WHEN 4 THEN 'fixture' WHEN 5 THEN 'binary'
  WHEN 0 THEN 'doc' WHEN 6 THEN 'doc' WHEN 7 THEN 'doc' WHEN 8 THEN 'doc' ELSE 'source' END"""
_COUNT = r"CAST(len(regexp_extract_all({t}, '[A-Za-z0-9_]{{1,4}}')) + len(regexp_extract_all({t}, '[^\sA-Za-z0-9_]')) AS BIGINT)"
_FILES = f"""files AS (
  SELECT doc_id AS seq, {_PATH.format(i="doc_id")} AS path, CAST(strlen(text) AS BIGINT) AS bytes,
    CASE WHEN doc_id % 12 IN (3, 5) THEN 0 ELSE {_COUNT.format(t="text")} END AS tokens, doc_id % 12 IN (3, 5) AS estimated, {_KIND.format(i="doc_id")} AS kind,
    CASE WHEN doc_id % 12 = 0 THEN 0 WHEN doc_id % 12 IN (1, 2, 3) THEN 2 ELSE 1 END AS tier
  FROM documents
)"""


def _history(now: int) -> str:
    return f"""hist AS (
  SELECT {_PATH.format(i="user_id")} AS path, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_commit, nullif(count(*) FILTER (floor(epoch(ts)) >= {now - 90 * 86400}), 0) AS commits_90d
  FROM events WHERE event_type <> 'error' GROUP BY 1
)"""


_RECORDS = f"{_FILES}, {_history(corpus.COLD_NOW)}, rec AS (SELECT f.*, last_commit, commits_90d FROM files f LEFT JOIN hist USING (path))"


def _js_round(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def _clamp(x: str, low: float, high: float) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {x}))"


def _found(order: int, name: str, confidence: str, suggest: str, reason: str, source: str, emit: str = "0") -> str:
    return f"SELECT {order} AS det_ord, CAST(seq AS BIGINT) AS seq, CAST({emit} AS BIGINT) AS emit_ord, path, '{name}' AS detector, {confidence} AS confidence, {reason} AS reason, '{suggest}' AS suggest FROM {source}"


_GENERATED = _found(0, "generated", "0.75::DOUBLE", "ignore", "'generated file — matches a known lockfile/build-output path pattern'", "rec WHERE kind = 'generated'")
_VENDORED = _found(
    1, "vendored", "CASE WHEN coalesce(commits_90d, 0) > 0 THEN 0.45::DOUBLE WHEN last_commit IS NOT NULL THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END", "ignore",
    "'vendored path, ' || CASE WHEN coalesce(commits_90d, 0) > 0 THEN 'but recently modified — may be hand-patched rather than untouched' WHEN last_commit IS NOT NULL THEN 'no commits in the last 90 days' ELSE 'untracked by git' END",
    "rec WHERE kind = 'vendored'",
)
_OVERWEIGHT = _found(
    2, "t0-overweight", _clamp("0.5::DOUBLE + (tokens / 900.0::DOUBLE - 1) * 0.25::DOUBLE", 0.5, 0.95), "split",
    f"'resident file alone uses ~' || {_js_round('tokens / 3000.0::DOUBLE * 100')} || '% of the 3000-token resident budget'", "rec WHERE tier = 0 AND tokens > 900",
)
_SIZED = """sized AS (
  SELECT *, count(*) OVER (PARTITION BY kind) AS n, cume_dist() OVER (PARTITION BY kind ORDER BY tokens) AS rank FROM rec WHERE kind <> 'binary'
), ceil_ AS (
  SELECT kind, list_sort(list(tokens))[CAST(least(floor(count(*) * 0.99::DOUBLE), count(*) - 1) AS BIGINT) + 1] AS p99 FROM rec GROUP BY kind
)"""
_OUTLIER = _found(
    3, "bloat-outlier", _clamp("0.5::DOUBLE + (rank - 0.99::DOUBLE) * 40", 0.5, 0.9), "review",
    "tokens || ' tok is in the top 1% of ' || kind || ' files in this repo (~' || p99 || ' tok is typical for the ceiling)'", "sized JOIN ceil_ USING (kind) WHERE n >= 20 AND rank >= 0.99::DOUBLE",
)
_DAYS = f"(({corpus.COLD_NOW} - last_commit) // 86400)"
_COLD = _found(
    6, "cold-and-costly", _clamp(f"0.4::DOUBLE + (least(0.3::DOUBLE, ({_DAYS} - 180) / 365.0::DOUBLE * 0.3::DOUBLE) + least(0.15::DOUBLE, tokens / 10000.0::DOUBLE))", 0.4, 0.85), "review",
    f"tokens || ' tok, untouched for ~' || {_DAYS} || ' days, no known-entrypoint filename'", f"rec WHERE kind <> 'binary' AND tokens >= 1000 AND last_commit IS NOT NULL AND {_DAYS} >= 180 AND tier <> 0",
)
_FINDINGS = f"{_RECORDS}, {_SIZED}, found AS ({' UNION ALL '.join((_GENERATED, _VENDORED, _OVERWEIGHT, _OUTLIER, _COLD))})"
_WASTED = f"""{_FINDINGS}, wasted AS (
  SELECT rec.*, tokens * coalesce(c.confidence, 0::DOUBLE) * CASE tier WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END AS waste
  FROM rec LEFT JOIN (SELECT path, max(confidence) AS confidence FROM found GROUP BY path) c USING (path)
)"""
_PRINTS = """words AS (
  SELECT doc_id AS seq, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT seq, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT seq, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), fnv AS (
  SELECT seq, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM sh
), fp AS (
  SELECT seq, CAST(sum(CASE WHEN 2 * ones > n THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS fp FROM (
    SELECT seq, b, sum((h >> b) & 1) AS ones, count(*) AS n FROM fnv, (SELECT unnest(range(0, 32)) AS b) GROUP BY seq, b HAVING count(*) >= 8
  ) GROUP BY seq
), doc AS (SELECT seq, 'docs/d' || seq || '.md' AS path, fp FROM fp)"""
_PAIRS = f"{_PRINTS}, pair AS (SELECT b.seq, b.path, a.seq AS other_seq, a.path AS other, CAST(bit_count(xor(a.fp, b.fp)) AS BIGINT) AS d FROM doc a JOIN doc b ON a.seq < b.seq AND bit_count(xor(a.fp, b.fp)) <= 10)"
_DUP = _found(5, "dup-doc", _clamp("1 - d / 32.0::DOUBLE", 0.5, 0.95), "review", f"'~' || {_js_round('(1 - d / 32.0::DOUBLE) * 100')} || '% overlap with ' || other", "pair", "other_seq")
_LINKS = r"""pg AS (
  SELECT page_id AS seq, 'docs/p' || page_id || '.md' AS path, regexp_extract_all(regexp_replace(coalesce(html, ''), '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g'), '\]\(([^)]+)\)', 1) AS raw FROM pages
), tgt AS (
  SELECT seq, path, i, regexp_extract(trim(r, ' ' || chr(9) || chr(10) || chr(13)), '^\S*') AS t FROM (SELECT seq, path, unnest(raw) AS r, unnest(range(len(raw))) AS i FROM pg)
), loc AS (
  SELECT seq, path, i, split_part(t, '#', 1) AS t FROM tgt WHERE t <> '' AND t NOT LIKE '#%' AND NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') AND t NOT LIKE '//%' AND split_part(t, '#', 1) <> ''
), res AS (
  SELECT seq, path, i, array_to_string(list_filter(string_split(CASE WHEN t LIKE '/%' THEN t ELSE 'docs/' || t END, '/'), lambda x: x <> '' AND x <> '.'), '/') AS ref FROM loc WHERE t NOT LIKE '~%'
), lnk AS (SELECT * FROM res WHERE ref <> '')"""
_REFS = _LINKS + """, known AS (
  SELECT path AS ref FROM pg UNION SELECT ref FROM lnk GROUP BY ref HAVING count(DISTINCT seq) >= 5
), miss AS (
  SELECT seq, path, count(*) AS n, count(*) FILTER (known.ref IS NULL) AS gone FROM lnk LEFT JOIN known USING (ref) GROUP BY seq, path
)"""
_STALE = _found(4, "stale-doc", _clamp("0.4::DOUBLE + gone / n::DOUBLE * 0.55::DOUBLE", 0.4, 0.95), "review", "'references ' || gone || ' of ' || n || ' linked path(s) that no longer exist in this repo'", "miss WHERE gone > 0")
_GRAPH = """p AS (SELECT p_partkey AS k, (SELECT count(*) FROM part) AS n FROM part),
used AS (
  SELECT k AS src, (k * 7 + 1) % n AS dst, CASE k % 3 WHEN 0 THEN 'f' || (k * 7 + 1) % n WHEN 1 THEN 'g' || (k * 7 + 1) % n END AS name, k % 3 = 2 AS whole FROM p WHERE k % 4 <> 3
  UNION ALL SELECT k, (k * 3 + 2) % n, 'f' || (k * 3 + 2) % n, false FROM p WHERE k % 4 <> 3
), edge AS (SELECT DISTINCT src, dst FROM used WHERE dst IN (SELECT k FROM p))"""
_REACH = "RECURSIVE " + _GRAPH + ", r AS (SELECT k AS node FROM p WHERE k % 50 = 0 UNION SELECT dst FROM r JOIN edge ON edge.src = r.node)"
_DEAD = _GRAPH + """, ex AS (SELECT k, 0 AS i, 'f' || k AS name FROM p UNION ALL SELECT k, 1, 'g' || k FROM p),
dead AS (
  SELECT k, i, name FROM ex WHERE k % 50 <> 0 AND k NOT IN (SELECT dst FROM used WHERE whole)
  AND NOT EXISTS (SELECT 1 FROM used WHERE used.dst = ex.k AND used.name = ex.name)
)"""


# Every signal at once: banners, links, fingerprints of the prose, and what the graph says of modules.
_BANNER = _found(0, "generated", "CASE WHEN seq % 24 = 2 THEN 0.97::DOUBLE ELSE 0.75::DOUBLE END", "ignore", "'generated file — ' || CASE WHEN seq % 24 = 2 THEN 'path pattern and a generated-file header banner' ELSE 'matches a known lockfile/build-output path pattern' END", "rec WHERE kind = 'generated'")
_NINE = f"""WITH {_RECORDS}, {_SIZED}, {_PRINTS.replace("doc AS (SELECT seq, 'docs/d' || seq || '.md' AS path, fp FROM fp)", "doc AS (SELECT seq, path, fp FROM fp JOIN rec USING (seq) WHERE kind = 'doc')")},
pair AS (SELECT b.seq, b.path, a.seq AS other_seq, a.path AS other, CAST(bit_count(xor(a.fp, b.fp)) AS BIGINT) AS d FROM doc a JOIN doc b ON a.seq < b.seq AND bit_count(xor(a.fp, b.fp)) <= 10),
refs AS (SELECT seq, path, unnest(['docs/d' || (seq + 1) || '.md', 'gone/g' || seq || '.md', 'docs/d' || (seq + 12) || '.md']) AS ref FROM rec WHERE kind = 'doc'),
miss AS (SELECT seq, path, count(*) AS n, count(*) FILTER (ref NOT IN (SELECT path FROM rec)) AS gone FROM refs GROUP BY seq, path),
lone AS (SELECT seq, path FROM rec WHERE kind = 'source' AND seq % 5 = 0), dead AS (SELECT seq, path, seq % 7 AS n FROM rec WHERE kind = 'source' AND seq % 7 > 0)
{" UNION ALL ".join((_BANNER, _VENDORED, _OVERWEIGHT, _OUTLIER, _STALE, _DUP, _COLD + f" AND path NOT IN {corpus.ENTRYPOINTS}", _found(7, "orphan-module", "0.55::DOUBLE", "review", "'unreachable from any inferred entrypoint via module-graph edges'", "lone"),
_found(8, "dead-export", "least(0.8::DOUBLE, 0.5::DOUBLE + 0.08::DOUBLE * n)", "review", "n || ' exported symbol(s) have zero inbound module-graph references anywhere in this repo (v1)'", "dead")))}"""


# Projections and predicates --------------------------------------------------


@query(f"SELECT doc_id AS seq, {_PATH.format(i='doc_id')} AS path, {_KIND.format(i='doc_id')} AS kind, doc_id % 12 = 3 AS minified, doc_id % 12 IN (2, 3) AS generated_path, false AS sniff, doc_id % 12 IN (1, 2, 9, 10, 11) AS eligible FROM documents")
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return corpus.documents(spark, sf_dir).select("seq", "path", kinds.classify(p).alias("kind"), kinds.is_minified(p).alias("minified"), kinds.is_generated_path(p).alias("generated_path"), kinds.needs_sniff(p).alias("sniff"), kinds.is_graph_eligible(p).alias("eligible"))


@query(f"SELECT doc_id AS seq, {_COUNT.format(t='text')} AS tokens FROM documents")
def token_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).select("seq", tokens.count(F.col("text")).alias("tokens"))


def _decoded(h: str) -> str:
    """SQL of the text of a sample given in hexadecimal. Each byte of a character that its beginning cuts is a replacement mark, and what its end cuts is one."""
    head, tail = f"regexp_extract({h}, '^((?:[89AB].)*)', 1)", "regexp_extract({0}, '^(?:..)*?((?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].)?(?:[89AB].)?))$', 1)"
    rest = f"substr({h}, len({head}) + 1)"
    cut = tail.format(rest)
    return f"repeat('\ufffd', len({head}) // 2) || decode(unhex(left({rest}, len({rest}) - len({cut})))) || CASE WHEN {cut} <> '' THEN '\ufffd' ELSE '' END"


_SAMPLED = f"""{_FILES}, cut AS (
  SELECT seq, bytes, kind, tier, tokens, hex(encode(text)) AS h, greatest(8192, bytes // 2 - 4096) AS mid FROM files JOIN documents ON seq = doc_id
), two AS (
  SELECT *, substr(h, 1, 16384) AS one, substr(h, 2 * mid + 1, 16384) AS other FROM cut WHERE bytes > 16384 AND tier <> 0 AND kind <> 'binary' AND seq % 12 <> 3
), n AS (
  SELECT seq, bytes, {_decoded("one")} || {_decoded("other")} AS t FROM two
)"""


@query(f"""WITH {_SAMPLED} SELECT seq, bytes, CAST(floor(bytes / (strlen(t) / {_COUNT.format(t='t')}::DOUBLE) + 0.5) AS BIGINT) AS tokens, true AS estimated FROM n
UNION ALL SELECT seq, bytes, tokens, kind = 'binary' OR seq % 12 = 3 FROM cut WHERE seq NOT IN (SELECT seq FROM two)""")
def token_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files above sixteen kilobytes from two samples of their bytes."""
    rows = corpus.files(spark, sf_dir).drop("tokens", "estimated").join(corpus.documents(spark, sf_dir).select("seq", "text"), "seq")
    m = tokens.measure(F.col("path"), F.col("text").cast("binary"), F.col("bytes"), F.col("tier"), F.col("kind"))
    return rows.select("seq", "bytes", m.alias("m")).select("seq", "bytes", "m.tokens", "m.estimated")


@query(r"SELECT doc_id AS seq, doc_id % 12 = 0 AS entrypoint, strlen(text) <= 16384 AND doc_id % 12 NOT IN (3, 5) OR doc_id % 12 = 0 AS exact FROM documents")
def entrypoint_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir)
    return files.select("seq", kinds.is_entrypoint(F.col("path"), F.col("tier")).alias("entrypoint"), tokens.is_exact(F.col("path"), F.col("bytes"), F.col("tier"), F.col("kind")).alias("exact"))


@query(f"SELECT doc_id AS seq, {_PATH.format(i='doc_id')} AS path, doc_id % 12 IN (1, 3) OR doc_id % 12 IN (6, 7, 8) AND NOT starts_with(CAST(doc_id AS VARCHAR), '1') AS ignored FROM documents")
def ignore_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rule that matches decides."""
    rules = ignore_rules.parse("vendor/**\n*.min.css\n/docs/*.md\n!docs/d1*.md\n# no rule\n") + ignore_rules.parse("*.md\n", "elsewhere")
    return corpus.documents(spark, sf_dir).select("seq", "path", ignore_rules.is_ignored(F.col("path"), rules).alias("ignored"))


@query(_LINKS + " SELECT seq, i, t AS target FROM loc")
def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local targets of each page, without URLs, anchors and fragments."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), '<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    return corpus.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.posexplode(docs.link_targets(text)).alias("i", "target"))


@query(_LINKS + " SELECT seq, path, ref, CAST(count(*) AS BIGINT) AS n FROM lnk GROUP BY ALL")
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.linked(spark, sf_dir).select("seq", "path", F.explode("referenced_paths").alias("ref")).groupBy("seq", "path", "ref").agg(F.count("*").alias("n"))


# Fingerprints ----------------------------------------------------------------


@query(f"WITH {_PRINTS} SELECT seq, fp FROM fp")
def simhash_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fingerprints(spark, sf_dir).where("content_simhash IS NOT NULL").select("seq", F.col("content_simhash").alias("fp"))


@query(f"WITH {_PAIRS} SELECT seq, other_seq FROM pair WHERE d = 0")
def dup_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.near_docs(corpus.fingerprints(spark, sf_dir), 0).select("seq", "other_seq")


@query(f"WITH {_PAIRS} {_DUP}")
def dup_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.dup_doc(corpus.fingerprints(spark, sf_dir), CTX)


@query(f"WITH {_PAIRS} SELECT d, CAST(count(*) AS BIGINT) AS n FROM pair GROUP BY d")
def hamming_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.near_counts(corpus.fingerprints(spark, sf_dir))


# Records and their detectors -------------------------------------------------


@query(f"WITH {_FILES} SELECT kind, CAST(count(*) AS BIGINT) AS files, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(bytes) AS BIGINT) AS bytes FROM files GROUP BY kind")
def measure_totals_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))


@query(f"WITH {_history(corpus.CHURN_NOW)} SELECT * FROM hist")
def commit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history(corpus.commits(spark, sf_dir), corpus.CHURN_NOW)


@query(f"WITH {_RECORDS} SELECT seq, path, bytes, tokens, estimated, kind, tier, last_commit, commits_90d FROM rec")
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.records(spark, sf_dir).select("seq", "path", "bytes", "tokens", "estimated", "kind", "tier", "last_commit", "commits_90d")


def _detector(name: str) -> Query:
    return lambda spark, sf_dir: detect.DETECTORS[name](corpus.records(spark, sf_dir), CTX)


for _name, _sql in (("generated", _GENERATED), ("vendored", _VENDORED), ("t0-overweight", _OVERWEIGHT), ("bloat-outlier", f"{_OUTLIER}"), ("cold-and-costly", _COLD)):
    _f = _detector(_name)
    _f.__name__ = _name.replace("-", "_")
    query(f"WITH {_RECORDS}, {_SIZED} {_sql}")(_f)


@query(f"WITH {_REFS} {_STALE}")
def stale_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.stale_doc(corpus.linked_files(spark, sf_dir), CTX)


def _found_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records and findings. Nine detectors and the score read the records, so these are a table, without text."""
    records = written(corpus.records(spark, sf_dir), "records")
    return records, detect.run_all(records, CTX)


@query(f"WITH {_FINDINGS} SELECT * FROM found")
def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_in(spark, sf_dir)[1]


@query(_NINE)
def findings_nine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine detectors on records with every signal; three files are entrypoints of a package."""
    return detect.run_all(written(corpus.signalled(spark, sf_dir), "records"), Context(now=corpus.COLD_NOW, package_entrypoints=corpus.ENTRYPOINTS))


@query(f"WITH {_FINDINGS} SELECT path, max(confidence) AS confidence FROM found GROUP BY path")
def max_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.max_confidence(_found_in(spark, sf_dir)[1])


@query(f"WITH {_WASTED} SELECT seq, path, round(waste, 6) AS waste FROM wasted WHERE waste > 0")
def ranked_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.ranked(*_found_in(spark, sf_dir)).select("seq", "path", F.round("waste", 6).alias("waste"))


_ROLLUP = f"""WITH {_WASTED}, t AS (
  SELECT CAST(count(*) AS BIGINT) AS file_count, CAST(coalesce(sum(tokens) FILTER (tier = 0), 0) AS BIGINT) AS resident_tokens, CAST(coalesce(sum(tokens) FILTER (tier = 1), 0) AS BIGINT) AS reachable_tokens,
    CAST(coalesce(sum(tokens) FILTER (tier = 2), 0) AS BIGINT) AS ambient_tokens, {_js_round('round(sum(waste), 6)')} AS recoverable_tokens FROM wasted
)"""


@query(f"{_ROLLUP} SELECT *, 3000::DOUBLE AS budget, resident_tokens > 3000 AS over_budget, {_js_round('(resident_tokens - 3000::DOUBLE) / 3000::DOUBLE * 100')} AS overage_pct FROM t")
def tier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.rollup(*_found_in(spark, sf_dir), CTX)


@query(f"{_ROLLUP} SELECT b AS budget, explicit, explicit AND resident_tokens > b AS failed FROM t, (VALUES (10::DOUBLE, true), (10::DOUBLE, false), (1e12::DOUBLE, true)) v(b, explicit)")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code's condition: only an explicit budget can fail."""
    cases = spark.createDataFrame([(10.0, True), (10.0, False), (1e12, True)], "budget double, explicit boolean")
    total = score.rollup(*_found_in(spark, sf_dir), CTX).select("resident_tokens")
    return cases.crossJoin(F.broadcast(total)).select("budget", "explicit", (F.col("explicit") & (F.col("resident_tokens") > F.col("budget"))).alias("failed"))  # one row


@query(f"""{_ROLLUP} SELECT '{{"fileCount":' || file_count || ',"residentTokens":' || resident_tokens || ',"reachableTokens":' || reachable_tokens || ',"ambientTokens":' || ambient_tokens
  || ',"budget":3000,"overBudget":' || (resident_tokens > 3000) || ',"overagePct":' || {_js_round('(resident_tokens - 3000::DOUBLE) / 3000::DOUBLE * 100')} || ',"recoverableTokens":' || recoverable_tokens || '}}' AS rollup FROM t""")
def report_json_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = score.rollup(*_found_in(spark, sf_dir), CTX)
    return row.select(F.to_json(F.struct(
        F.col("file_count").alias("fileCount"), F.col("resident_tokens").alias("residentTokens"), F.col("reachable_tokens").alias("reachableTokens"), F.col("ambient_tokens").alias("ambientTokens"),
        F.col("budget").cast("long").alias("budget"), F.col("over_budget").alias("overBudget"), F.col("overage_pct").alias("overagePct"), F.col("recoverable_tokens").alias("recoverableTokens"),
    )).alias("rollup"))


@query(f"""WITH {_WASTED}, worst AS (SELECT path, waste, seq FROM wasted WHERE waste > 0 ORDER BY waste DESC, seq LIMIT 20),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, det_ord, emit_ord, seq) AS k FROM found) WHERE k = 1)
SELECT w.path, round(waste, 6) AS waste, detector, confidence, reason, suggest, w.seq, row_number() OVER (ORDER BY w.waste DESC, w.seq) AS place FROM worst w JOIN best USING (path)""")
def top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the twenty files that waste most, in order."""
    top = score.top(*_found_in(spark, sf_dir))
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("waste"), "seq")).cast("long")).withColumn("waste", F.round("waste", 6))


@query(f"WITH {_FINDINGS} SELECT suggest, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT path) AS BIGINT) AS files, CASE suggest WHEN 'ignore' THEN 0 WHEN 'split' THEN 1 WHEN 'delete' THEN 2 ELSE 3 END AS place FROM found GROUP BY suggest")
def findings_by_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.by_suggestion(_found_in(spark, sf_dir)[1])


@query(f"WITH {_FINDINGS} SELECT DISTINCT path FROM found WHERE suggest = 'ignore' AND path NOT IN (SELECT {_PATH.format(i='user_id')} FROM events)")
def ignore_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ignore file that lists every tracked path lacks."""
    known = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct().select(corpus.path_of(F.col("doc_id")).alias("line"))
    return score.ignore_additions(_found_in(spark, sf_dir)[1], known)


@query(f"WITH {_FILES} SELECT path, tokens, estimated, seq, row_number() OVER (ORDER BY tokens DESC, seq) AS place FROM files WHERE tier = 0 ORDER BY tokens DESC, seq LIMIT 20")
def resident_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the twenty largest resident files."""
    return score.resident_top(corpus.files(spark, sf_dir)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("tokens"), "seq")).cast("long"))


@query(f"WITH {_FILES} SELECT seq, path, kind, seq % 5 NOT IN (0, 1) AND seq % 7 <> 0 AS hit FROM files")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against a snapshot in which some have another size, some another time, and some are absent."""
    files = corpus.files(spark, sf_dir).withColumn("mtime_ms", F.col("seq").cast("double")).drop("tokens", "estimated")
    old = files.where("seq % 7 <> 0").withColumn("bytes", F.col("bytes") + (F.col("seq") % 5 == 0).cast("long")).withColumn("mtime_ms", F.col("mtime_ms") + (F.col("seq") % 5 == 1).cast("double"))
    null = F.lit(None)
    old = old.select("path", "mtime_ms", "bytes", "kind", "tier", F.lit(1).cast("long").alias("tokens"), F.lit(False).alias("estimated"), null.cast("boolean").alias("generated_header"), null.cast("array<string>").alias("referenced_paths"), null.cast("long").alias("content_simhash"), null.cast("string").alias("module"))
    hits, misses = snapshot.split(files, old)
    return hits.select("seq", "path", "kind", F.lit(True).alias("hit")).unionByName(misses.select("seq", "path", "kind", F.lit(False).alias("hit")))


# Graphs ----------------------------------------------------------------------


@query(f"WITH {_GRAPH} SELECT 'src/m' || src || '.ts' AS src, 'src/m' || dst || '.ts' AS dst FROM edge")
def edges_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, mods, _ = corpus.modules(spark, sf_dir)
    return modules.edges(modules.uses(mods, files))


@query(f"WITH {_GRAPH} SELECT DISTINCT 'src/m' || src || '.ts' AS src, 'src/m' || dst || '.ts' AS dst FROM used WHERE dst IN (SELECT k FROM p)")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges when half of the imports go through an alias."""
    files, mods, _ = corpus.modules(spark, sf_dir, prefix="@/")
    aliases = spark.createDataFrame([(0, 0, "", "@/deep/*", "src/deep/*"), (0, 1, "", "@/*", "src/*"), (1, 0, "lib", "@/*", "*")], "config_ord int, rule_ord int, base_url string, pattern string, target string")
    return modules.edges(modules.uses(mods, files, aliases))


@query(f"WITH {_REACH} SELECT 'src/m' || node || '.ts' AS node FROM r")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, mods, declared = corpus.modules(spark, sf_dir)
    return reach.reachable(modules.entrypoints(files, declared), modules.edges(modules.uses(mods, files)))


@query(f"WITH {_REACH} {_found(7, 'orphan-module', '0.55::DOUBLE', 'review', repr('unreachable from any inferred entrypoint via module-graph edges'), '(SELECT k AS seq, ' + repr('src/m') + ' || k || ' + repr('.ts') + ' AS path FROM p WHERE k NOT IN (SELECT node FROM r))')}")
def orphan_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, mods, declared = corpus.modules(spark, sf_dir)
    used = modules.uses(mods, files)
    return detect.orphan_module(files.join(modules.orphans(files, used, modules.entrypoints(files, declared)), "path"), CTX)


@query(f"WITH {_DEAD}, d AS (SELECT k AS seq, 'src/m' || k || '.ts' AS path, count(*) AS n FROM dead GROUP BY k) " + _found(8, "dead-export", "least(0.8::DOUBLE, 0.5::DOUBLE + 0.08::DOUBLE * n)", "review", "n || ' exported symbol(s) have zero inbound module-graph references anywhere in this repo (v1)'", "d"))
def dead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, mods, declared = corpus.modules(spark, sf_dir)
    used = modules.uses(mods, files)
    return detect.dead_export(files.join(modules.dead_exports(mods, used, modules.entrypoints(files, declared)), "path"), CTX)


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS k FROM orders), r AS (
  SELECT k FROM e WHERE k % 100 = 0 UNION SELECT e.k FROM r JOIN e ON e.k = r.k + 1 WHERE r.k % 10 <> 9
) SELECT CASE WHEN k % 100 = 0 THEN 'r' || k || '/AGENTS.md' ELSE 'r/n' || k || '.md' END AS path, CASE WHEN k IN (SELECT k FROM r) THEN 0 ELSE 1 END AS tier FROM e""")
def resident_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, texts = corpus.resident(spark, sf_dir)
    return tiers.assign(files, texts).select("path", "tier")


@query(f"SELECT doc_id AS seq, regexp_extract(p, '[^/]*$') AS base, regexp_replace(p, '/?[^/]*$', '') AS dir, regexp_extract(p, '\\.[^.]*$') AS ext, regexp_extract(p, '[^/]*$') AS up FROM (SELECT doc_id, {_PATH.format(i='doc_id')} AS p FROM documents)")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return corpus.documents(spark, sf_dir).select("seq", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.extension(p).alias("ext"), paths.resolve(F.concat(F.lit("../../x/.././../"), paths.basename(p)), p).alias("up"))


from . import drills  # noqa: E402, F401  (registers its queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
