"""The training-data operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import aligned
from .ann import nearest
from .byte_bpe import byte_bpe
from .clusters import delta_lloyd, lloyd_sql
from .decontamination import leaks
from .line_dedup import line_dedup_digest
from .near_dups import near_duplicates
from .packing import packed
from .pages import page_text
from .quality import fit_quality, graded
from .repeats import without_repeats
from .secrets import secret_scan
from .token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents selected, with their grades."""
    docs = table(spark, sf_dir, "documents")
    return graded(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).where("kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a document and a benchmark item that leaked into it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_token_counts, op2_near_duplicates, op3_nearest, op4_quality, op5_secret_scan, op6_page_text, op7_repeats, op8_line_dedup, op9_packing, op10_decontamination,
    op11_clusters, op12_alignment, op13_byte_bpe,
)
QUERIES = {f.__name__: f for f in OPERATORS}
OP7_SQL = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from d where len(w) >= 50)),
m as (select h, min(doc_id) as f from g group by h),
x as (select distinct doc_id, unnest(range(s, s + 50)) as k from g join m using (h) where f < doc_id),
k as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
r as (select doc_id, string_agg(word, ' ' order by k) as t, count(*) as n from k anti join x using (doc_id, k) group by doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(r.n, 0) as n_removed, sha256(coalesce(r.t, '')) as kept_sha256 from d left join r using (doc_id)"""
#: The other operators have no SQL: tokenisers, sketches, models, alignments and packing are tested against brute force.
ORACLES: dict[str, str] = {"op7_repeats": OP7_SQL, "op11_clusters": lloyd_sql()}
