"""The driver's tables read as a repository, so that every operator has a query over them.

The same arithmetic on ids gives the same corpus in SQL; see ``catalogue``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import docs, kinds, paths, tokens
from ..operators import history, tiers

CHURN_NOW = 1_706_659_200  # 2024-01-31
COLD_NOW = 1_725_148_800  # 2024-09-01

_PATHS = {0: ("pkg", "/CLAUDE.md"), 1: ("vendor/v", ".js"), 2: ("gen/out/g", ".js"), 3: ("a", ".min.css"), 4: ("test/fixtures/f", ".json"), 5: ("img/i", ".png"), 6: ("docs/d", ".md"), 7: ("docs/d", ".md"), 8: ("docs/d", ".md")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(i: Column) -> Column:
    out = F.concat(F.lit("src/s"), i.cast("string"), F.lit(".ts"))
    for rest, (head, tail) in _PATHS.items():
        number = F.expr("doc_id div 12") if rest == 0 else i
        out = F.when(i % 12 == rest, F.concat(F.lit(head), number.cast("string"), F.lit(tail))).otherwise(out)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), path_of(F.col("doc_id")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path, bytes, tokens, estimated, kind, tier): documents as files that are measured whole."""
    kind = kinds.classify(F.col("path"))
    skipped = (F.col("kind") == "binary") | kinds.is_minified(F.col("path"))
    rows = documents(spark, sf_dir).withColumn("kind", kind)
    return rows.select(
        "seq", "path", F.octet_length("text").cast("long").alias("bytes"),
        F.when(skipped, F.lit(0)).otherwise(tokens.count(F.col("text"))).cast("long").alias("tokens"), skipped.alias("estimated"), "kind",
        tiers.tier_of(F.col("kind"), kinds.is_resident_name(F.col("path"))).alias("tier"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, ts): events as commits of the file that has the user's number; errors play the deletions that a log leaves out."""
    ts = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    events = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("doc_id"), ts.alias("ts"))
    return events.select(path_of(F.col("doc_id")).alias("path"), "ts")


def records(spark: SparkSession, sf_dir: str, now: int = COLD_NOW) -> DataFrame:
    """Files with their history; the signals that other tables give are null."""
    seen = history.history(commits(spark, sf_dir), now)
    null = F.lit(None)
    return files(spark, sf_dir).join(seen, "path", "left").select(
        "seq", "path", "bytes", "tokens", "estimated", "kind", "tier", "last_commit", "commits_90d",
        F.when(F.col("kind") == "generated", F.lit(False)).alias("generated_header"), null.cast("array<string>").alias("referenced_paths"),
        null.cast("long").alias("content_simhash"), null.cast("boolean").alias("orphan_module"), null.cast("array<string>").alias("dead_export_symbols"),
    )


#: Files that a package declares, for the detector that spares them.
ENTRYPOINTS = ("src/s9.ts", "src/s21.ts", "src/s33.ts", "src/s45.ts")


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with every signal: banners, three links a document, fingerprints of prose, orphans and dead exports by arithmetic."""
    seq, kind = F.col("seq"), F.col("kind")
    prints = documents(spark, sf_dir).select("seq", docs.simhash(F.col("text")).alias("__fp"))
    link = lambda head, n: F.concat(F.lit(head), n.cast("string"), F.lit(".md"))
    names = F.transform(F.sequence(F.lit(1).cast("long"), seq % 7), lambda i: F.concat(F.lit("f"), i.cast("string")))
    return records(spark, sf_dir).join(prints, "seq").withColumns({
        "generated_header": F.when(kind == "generated", seq % 24 == 2), "referenced_paths": F.when(kind == "doc", F.array(link("docs/d", seq + 1), link("gone/g", seq), link("docs/d", seq + 12))),
        "content_simhash": F.when(kind == "doc", F.col("__fp")), "orphan_module": F.when(kind == "source", seq % 5 == 0), "dead_export_symbols": F.when((kind == "source") & (seq % 7 > 0), names),
    }).drop("__fp")


def spread(rows: DataFrame) -> DataFrame:
    """A table that fewer tasks would read than can run, spread over these; larger ones stay where they are read."""
    spark = rows.sparkSession
    few = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < (16 << 20) * spark.sparkContext.defaultParallelism
    return rows.repartition(spark.sparkContext.defaultParallelism) if few else rows


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path, kind, content_simhash): every document as prose."""
    rows = spread(documents(spark, sf_dir))
    return rows.select("seq", F.concat(F.lit("docs/d"), F.col("seq").cast("string"), F.lit(".md")).alias("path"), F.lit("doc").alias("kind"), docs.simhash(F.col("text")).alias("content_simhash"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path, referenced_paths): pages as Markdown documents."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), '<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.concat(F.lit("docs/p"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    return rows.select("seq", "path", docs.resolved_links(F.col("text"), F.col("path")).alias("referenced_paths"))


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents, and a file for every target that at least five of them link to; rarer targets are missing."""
    own = linked(spark, sf_dir)
    there = own.select("path", F.explode(F.array_distinct("referenced_paths")).alias("to")).groupBy("to").agg(F.count("*").alias("n")).where("n >= 5")
    return own.unionByName(there.select(F.lit(-1).cast("long").alias("seq"), F.col("to").alias("path"), F.lit(None).cast("array<string>").alias("referenced_paths")))


def modules(spark: SparkSession, sf_dir: str, prefix: str = "./") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, modules, declared entrypoints) of a graph over parts: each imports two others, but one in four imports none."""
    part = table(spark, sf_dir, "part")
    parts = part.select("p_partkey").crossJoin(part.agg(F.count("*").alias("n")))  # one row
    p, n = F.col("p_partkey"), F.col("n")
    a, b = ((p * 7 + 1) % n).cast("string"), ((p * 3 + 2) % n).cast("string")
    path = F.concat(F.lit("src/m"), p.cast("string"), F.lit(".ts"))
    names = F.when(p % 3 == 0, F.array(F.concat(F.lit("f"), a))).when(p % 3 == 1, F.array(F.concat(F.lit("g"), a))).otherwise(F.array().cast("array<string>"))
    first = F.struct(F.concat(F.lit(f"{prefix}m"), a).alias("source"), names.alias("names"), (p % 3 == 2).alias("namespace"))
    second = F.struct(F.concat(F.lit("./m"), b, F.lit(".js")).alias("source"), F.array(F.concat(F.lit("f"), b)).alias("names"), F.lit(False).alias("namespace"))
    imports = F.when(p % 4 == 3, F.array().cast("array<struct<source:string,names:array<string>,namespace:boolean>>")).otherwise(F.array(first, second))
    reexports = F.array().cast("array<struct<source:string,names:array<string>,star:boolean>>")
    exported = F.array(F.concat(F.lit("f"), p.cast("string")), F.concat(F.lit("g"), p.cast("string")))
    rows = parts.select(p.alias("seq"), path.alias("path"), F.lit(1).alias("tier"), F.struct(imports.alias("imports"), reexports.alias("reexports"), exported.alias("exported_names")).alias("module"))
    declared = parts.where(p % 50 == 0).select(F.concat(F.lit("dist/m"), p.cast("string"), F.lit(".js")).alias("spec"))
    return rows.select("seq", "path", "tier"), rows.select("path", "module"), declared


def resident(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, texts) of documents that import the next one of their block of ten; every hundredth is resident."""
    key = F.col("o_orderkey")
    path = F.when(key % 100 == 0, F.concat(F.lit("r"), key.cast("string"), F.lit("/AGENTS.md"))).otherwise(F.concat(F.lit("r/n"), key.cast("string"), F.lit(".md")))
    text = F.when(key % 10 == 9, F.lit("the end")).otherwise(F.concat(F.lit("see @/r/n"), (key + 1).cast("string"), F.lit(".md and @missing.md")))
    rows = table(spark, sf_dir, "orders").select(path.alias("path"), text.alias("text"))
    return rows.select("path", kinds.classify(F.col("path")).alias("kind")), rows
