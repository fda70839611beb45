"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimframe.llm.common import written
from dimframe.llm.decontamination import leaks
from dimframe.llm.line_dedup import line_dedup
from dimframe.llm.near_dups import near_duplicates
from dimframe.llm.packing import packed
from dimframe.llm.quality import fit_quality, selected

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the ratings of ``docs``, grades as good."""
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    return selected(docs.select(*COLUMNS), model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; one that loses all its lines goes."""
    out = line_dedup(docs.select(*COLUMNS)).where("n_removed = 0 or length(trim(text)) > 0")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id. Rows without an id stay."""
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs, percent=80).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    docs = docs.select(*COLUMNS)
    gone = leaks(docs, _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(written(gone, "leaks"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("near-dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder before the next."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
