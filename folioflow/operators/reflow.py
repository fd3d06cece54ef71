"""Paragraph reflow, callouts and outlines over ordered lines or blocks of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.params import PARAMS


def islands(rows: DataFrame, start: Column, key: list[str], order: str, name: str = "block_no") -> DataFrame:
    """rows with the number of the island each is in; an island begins where start holds and at the first row."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn(name, F.sum(start.cast("int")).over(w) - F.first(start.cast("int")).over(w))


def reflow(lines: DataFrame, key: list[str] | None = None, handout: bool = False) -> DataFrame:
    """(key, block_no, n_lines, text): blank lines go, a block begins at a structural line, the others are joined to it.

    In handouts indented topics begin blocks too and keep two blanks before them.
    """
    key = key or ["doc_id"]
    solid = lines.where(F.trim("line") != "")
    topic = T.is_indented_topic("line") if handout else F.lit(False)
    marked = islands(solid.withColumn("topic", topic), T.is_block_start("line", handout) | F.col("topic"), key, "pos")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: T.strip(x["line"]))
    indent = F.when(F.min_by("topic", "pos"), "  ").otherwise("")
    return marked.groupBy(*key, "block_no").agg(F.count("*").alias("n_lines"), F.concat(indent, T.join_lines(parts)).alias("text"))


def law_quotes(blocks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Law quotes with the item, sub-item and paragraph blocks that follow them in one callout; other blocks as they are.

    blocks has key, block_no and text; returns key, block_no (of the first) and text.
    """
    key = key or ["doc_id"]
    opens = T.is_law_quote(F.col("text"))
    goes = T.goes_on_law("text") & ~F.col("text").rlike(r"^\s*(?:>|!\[)") & ~opens
    w = Window.partitionBy(*key).orderBy("block_no")
    # a block goes on a quote if none but such blocks stand between it and the quote
    rows = blocks.withColumns({"opens": opens, "goes": goes}).withColumn("run", F.sum((~F.col("goes")).cast("int")).over(w))
    rows = rows.withColumn("quote", F.first("opens").over(Window.partitionBy(*key, "run").orderBy("block_no")))
    rows = rows.withColumn("head", F.when(F.col("quote"), F.min("block_no").over(Window.partitionBy(*key, "run"))).otherwise(F.col("block_no")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: T.quoted(x["text"])), "\n>\n")
    out = rows.groupBy(*key, "head").agg(F.bool_or("quote").alias("quote"), body.alias("body"), F.min_by("text", "block_no").alias("text"))
    return out.select(*key, F.col("head").alias("block_no"), F.when(F.col("quote"), F.concat(F.lit("> [!quote] \n> LEI\n"), "body")).otherwise(F.col("text")).alias("text"))


def outline(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, n, topics): the first run of outline lines among the first lines; blank lines inside a run are passed over."""
    key = key or ["doc_id"]
    w = Window.partitionBy(*key).orderBy("pos")
    rows = lines.where(F.col("pos") < PARAMS.outline_scan).where(F.trim("line") != "").withColumn("is", F.trim("line").rlike(T.OUTLINE))
    rows = rows.withColumn("seen", F.max(F.col("is").cast("int")).over(w)).withColumn("breaks", F.sum(F.when((F.col("seen") == 1) & ~F.col("is"), 1).otherwise(0)).over(w))
    run = rows.where("is and breaks = 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= PARAMS.outline_lines)
    topics = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), "\n")
    return run.groupBy(*key).agg(F.count("*").alias("n"), topics.alias("topics"))


def renumber_notes(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, page_no, note_no, global_no): notes numbered through the document in page order."""
    key = key or ["doc_id"]
    return rows.withColumn("global_no", F.row_number().over(Window.partitionBy(*key).orderBy("page_no", "note_no")))


def note_text(blocks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, n_blocks, body): all blocks of a document, a blank line between each two."""
    key = key or ["doc_id"]
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n\n")
    return blocks.groupBy(*key).agg(F.count("*").alias("n_blocks"), body.alias("body"))
