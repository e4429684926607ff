"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_collisions, line_windows, lm_scoring, packing, quality_fm, secret_scan, simhash_forest, tiered_shards, warc_fixity
from ._store import fresh_dir
from ..runtime import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(_table(spark, sf_dir, "documents"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with its score."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model).where(f"score >= {model.threshold}")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixity drill: the archive of all pages against a replica with known faults."""
    pages = _table(spark, sf_dir, "pages")
    return warc_fixity.audit(warc_fixity.stored(pages), warc_fixity.damaged(pages))


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.cleaned(_table(spark, sf_dir, "documents"))


def op7_simhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_forest.duplicates(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op9_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as they read from the compacted table, whose manifest names nothing but settled shards, each of its size and all of its rows."""
    table = tiered_shards.ShardTable(spark, fresh_dir(spark, "shards"))
    first = table.append(_table(spark, sf_dir, "documents"))
    last = table.compact()
    whole = sum(s.rows for s in first.shards) == sum(s.rows for s in last.shards)
    table.vacuum()
    settled = whole and table.settled() and table.versions() == [last.version]
    return table.read().select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars", F.lit(settled).alias("settled"))


def op10_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_collisions.near_classes(_table(spark, sf_dir, "embeddings"))


def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over all vectors and a slightly altered copy of each, as small tables have no near vectors of their own."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    altered = F.transform("embedding", lambda x: (x.cast("double") * 1.5 + 0.001).cast("float"))
    return embedding_collisions.near_classes(vectors.unionByName(vectors.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), altered.alias("embedding"))))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        op1_lm_scoring, op2_quality_fm, op3_decontamination, op4_secret_scan, op5_warc_fixity,
        op6_line_windows, op7_simhash_forest, op8_packing, op9_tiered_shards, op10_embedding_collisions, embedding_copies,
    )
    return {q.__name__: _shipped(q) for q in all_}


#: Word shingles of lower-cased text, windows of the item's size, by brute force.
_OP3 = r"""
WITH w AS (
  SELECT doc_id, u.w, u.i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS a FROM documents) d,
    LATERAL (SELECT unnest(a) AS w, unnest(range(len(a))) AS i) u
), ds AS (
  SELECT doc_id, i AS pos, sh FROM (
    SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS sh, lead(w, 3) OVER o AS full4 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE full4 IS NOT NULL
), bw AS (
  SELECT item_id, u.w, u.i FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS a FROM benchmark) b,
    LATERAL (SELECT unnest(a) AS w, unnest(range(len(a))) AS i) u
), bs AS (
  SELECT item_id, sh FROM (
    SELECT item_id, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS sh, lead(w, 3) OVER o AS full4 FROM bw WINDOW o AS (PARTITION BY item_id ORDER BY i)
  ) WHERE full4 IS NOT NULL
), items AS (
  SELECT item_id, count(*) AS w, count(DISTINCT sh) AS s FROM bs GROUP BY item_id
), m AS (
  SELECT DISTINCT doc_id, item_id, pos, sh FROM ds JOIN bs USING (sh)
), n AS (
  SELECT a.doc_id, a.item_id, a.pos AS start, count(DISTINCT b.sh) AS shared
  FROM m a JOIN items i ON a.item_id = i.item_id JOIN m b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos >= a.pos AND b.pos < a.pos + i.w
  GROUP BY ALL
)
SELECT doc_id, item_id, max(shared::DOUBLE / s) AS containment, arg_min(start, (-(shared::DOUBLE / s), start)) AS start
FROM n JOIN items USING (item_id) WHERE shared >= ceil(0.7::DOUBLE * s - 1e-9) GROUP BY doc_id, item_id
"""

#: Lines end at newlines, at sentence ends before white space and, within a sentence, after the words whose mark is the least of some
#: twelve consecutive ones; U+0001 marks the first two. ``s`` numbers sentences, ``k`` the words of one, ``line`` the lines of one.
_OP6 = r"""
WITH sent AS (
  SELECT doc_id, u.l, u.s FROM (
    SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?])([\t\n\v\f\r ])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS a FROM documents WHERE text IS NOT NULL
  ) d, LATERAL (SELECT unnest(a) AS l, unnest(range(len(a))) AS s) u
), tok AS (
  SELECT doc_id, s, u.t, u.k, n, tail FROM (
    SELECT doc_id, s, a, len(a) AS n, regexp_extract(l, '[\t\n\v\f\r ]*$') AS tail FROM (SELECT *, regexp_extract_all(l, '[\t\n\v\f\r ]*[^\t\n\v\f\r ]+') AS a FROM sent)
  ) d, LATERAL (SELECT unnest(a) AS t, unnest(range(len(a))) AS k) u
), byte AS (
  SELECT DISTINCT t, hex(regexp_replace(t, '^[\t\n\v\f\r ]+', '')) AS x FROM tok
), mark AS (
  SELECT t, (list_sum(list_transform(range(1, len(x) // 2 + 1), lambda j: j * ((strpos('0123456789ABCDEF', x[2 * j - 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * j]) - 1))) * 40503) % 65536 AS m FROM byte
), least AS (
  SELECT doc_id, s, min(m * 1048576 - k) OVER o AS b, count(*) OVER o AS c
  FROM tok JOIN mark USING (t) WINDOW o AS (PARTITION BY doc_id, s ORDER BY k ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)
), cut AS (
  SELECT DISTINCT doc_id, s, CAST((1048576 - b % 1048576) % 1048576 AS BIGINT) AS k, true AS cut FROM least WHERE c = 12
), part AS (
  SELECT tok.*, coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM tok LEFT JOIN cut USING (doc_id, s, k)
), joined AS (
  SELECT doc_id, s, line, string_agg(t, '' ORDER BY k) || max(CASE WHEN k = n - 1 THEN tail ELSE '' END) AS l FROM part GROUP BY doc_id, s, line
  UNION ALL SELECT doc_id, s, 0, l FROM sent WHERE NOT regexp_matches(l, '[^\t\n\v\f\r ]')
), seg AS (
  SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY s, line) AS i, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM joined WHERE l <> ''
), w AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER o AS b, t || chr(1) || lead(t, 1) OVER o || chr(1) || lead(t, 2) OVER o AS x
  FROM seg WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, a) AS n FROM w WHERE b IS NOT NULL) WHERE n > 1
), gone AS (
  SELECT doc_id, i, l, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM seg s WHERE EXISTS (SELECT 1 FROM later r WHERE r.doc_id = s.doc_id AND s.i BETWEEN r.a AND r.b)
), out AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, sum(strlen(l)) OVER (PARTITION BY doc_id, island) AS size FROM gone) WHERE size >= 30
), kept AS (
  SELECT doc_id, string_agg(l, '' ORDER BY i) AS text FROM seg ANTI JOIN out USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.lang, d.source,
  CASE WHEN d.text IS NULL THEN d.n_chars ELSE length(coalesce(k.text, '')) END AS n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


_OP5 = """
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url,
    'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || e
    || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS bytes
  FROM pages, (SELECT chr(13) || chr(10) AS e)
), f AS (
  SELECT coalesce(page_id // 1024, -1) AS file, page_id, strlen(bytes) AS length, row_number() OVER (PARTITION BY page_id ORDER BY url, sha256(bytes)) AS n,
    substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS mark
  FROM r
), o AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM f
)
SELECT file, off AS offset, length, page_id, n, CASE mark WHEN 'a7' THEN 'corrupt' WHEN 'b3' THEN 'resized' ELSE 'missing' END AS status
FROM o WHERE mark IN ('a7', 'b3', 'c9')
"""

_OP9 = "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars, true AS settled FROM documents"

#: Classes and links by comparing all vectors.
_NEAR = """
near AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM vec UNION SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.node
)
SELECT c.node AS vec_id, c.root AS class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS links
FROM (SELECT node, min(root) AS root FROM reach GROUP BY node) c LEFT JOIN (SELECT a, count(*) AS n FROM near GROUP BY a) l ON l.a = c.node
"""
_OP10 = "WITH RECURSIVE vec AS (SELECT vec_id, embedding FROM embeddings), " + _NEAR
_COPIES = """WITH RECURSIVE vec AS (
  SELECT vec_id, embedding FROM embeddings UNION ALL
  SELECT vec_id + 1000000000, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * 1.5::DOUBLE + 0.001::DOUBLE AS FLOAT)) FROM embeddings
), """ + _NEAR


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": _OP3, "op5_warc_fixity": _OP5, "op6_line_windows": _OP6, "op9_tiered_shards": _OP9, "op10_embedding_collisions": _OP10, "embedding_copies": _COPIES}
