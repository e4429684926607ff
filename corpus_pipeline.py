"""From raw documents to packed training windows: five stages, each an operator of ctxcost.llm.

``run(spark, sf_dir)`` applies STAGES to the documents of ``sf_dir``. Each stage's result is written as
Parquet to the shared folder and read again as the next one's documents.

Defined cases, end to end: a null or blank text passes the classifier or not as it scores, and goes with the line stage; repeated rows (one id, one text) change and
stay alike, as one document; a null doc_id comes last among equal lines, has no near-duplicates and stays; of texts that are equal or near, the least id
stays; a text of any length is read whole; extra columns, whatever their names (but those that begin with ``__cc_``), pass all stages but the last unchanged, and n_chars follows the text;
empty tables give no rows. Without labels of both kinds the classifier keeps everything, unless all labels are bad.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxcost.llm import decontamination, line_windows, packing, quality_fm, simhash_forest
from ctxcost.llm._store import written
from ctxcost.runtime import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorisation machine, trained on the labels, takes for good."""
    ship(spark)
    return quality_fm.keep(docs, quality_fm.fit(docs, _table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the three-line windows that occurred before; those left with no text go. Near copies keep the lines of
    their originals, so that the next stage sees what they are."""
    ship(spark)
    return line_windows.cleaned(docs, drop_empty=True, twins=simhash_forest.twins)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash_forest.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontamination.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training windows."""
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the trained classifier nor the forest; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}-{name.split()[0]}")
    return docs
