"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the next one's docs.  Every stage works on all that its predecessor kept, and its decisions take effect: toxic documents,
repeated lines, all but one document of each near-duplicate class, and contaminated documents go; the last stage adds
words, posteriors and the rate of each document that is left.  All stages but the last return the columns of documents.

All stages take nulls in any column, empty and very long texts, repeated rows and ids, empty tables and extra columns, whatever their names; what
each makes of them is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from folioflow.llm.common import scratch_scope, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is the threshold or more go.  A null or empty text has the score of a text of unknown words; each row is judged by its text
    alone, so repeated rows go or stay together; an empty table stays empty."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"), models=toxicity.word_model)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines of which an equal or similar one comes earlier, by id (null last) and line; their length is counted anew.

    A null text stays null and keeps its length, a text may become empty; no row goes.  Rows of one id count as one document.
    """
    out = line_dedup.deduplicate_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document of the least id stays.  Null and empty texts are copies of each other; rows with a null id stay; of
    several rows with one id that of the least text stays."""
    return near_dedup.drop_near_duplicates(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  Null and empty texts hold none; equal rows go together."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets words, posteriors and a rate; no row goes.  A null or empty text has no words, and the rate of its posteriors."""
    return mixing.mix(docs, _table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("mixing", stage_mixing),
]

#: Stages 1, 2, 3 and 5 learn models or compare by similarity classes that SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark) as made:  # what a stage writes for itself goes when its result is there
            docs = written(stage(spark, docs, sf_dir), name)
            made.pop()
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
