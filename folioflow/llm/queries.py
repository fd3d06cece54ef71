"""Queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, html_text, line_dedup, mixing, near_dedup, secrets, suffix_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "item_id", "start", "n_words", "similarity")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(_table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("x"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.sha2(secrets.rendered(F.col("found"), base=True).cast("binary"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets.rendered(F.col("found")).alias("spans"))


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_calls(_table(spark, sf_dir, "conversations"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "words", *[f"post_{d}" for d in mixing.DOMAINS], "rate")


def queries() -> dict:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_decontamination": op3_decontamination,
        "op4_line_dedup": op4_line_dedup,
        "op5_top_k": op5_top_k,
        "op6_secret_scan": op6_secret_scan,
        "op7_tool_call_linking": op7_tool_call_linking,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_html_extraction": op9_html_extraction,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict:
    return {
        "op5_top_k": OP5_SQL,
        "op6_secret_scan": secrets.duckdb_sql(),
    }
