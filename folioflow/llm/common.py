"""Scratch tables, size-checked broadcasts and distributed union-find, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (two or three numbers a row) that may be broadcast; beyond it a shuffle join is planned.
BROADCAST_ROWS = 500_000
#: Paths of the scratch tables of the open scopes, innermost last.
_open: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and any lost task rereads it from there.

    The result knows its number of rows, which is observed while writing.
    """
    path = f"{scratch_root(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.known_rows = int(seen.get["n"])
    return out


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the scratch tables that were written inside, at the end; yields their paths, of which the last can be taken out to be kept."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _open.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def rows_of(df: DataFrame) -> int | None:
    """The number of rows of a scratch table; None for others."""
    return getattr(df, "known_rows", None)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if df has at most so many rows; if that is not known, reads no more than that many and one."""
    known = rows_of(df)
    return known <= rows if known is not None else df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is small by count, else as it is (a shuffle join, which AQE can split)."""
    return F.broadcast(df) if small(df, rows) else df


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components by alternating large-star and small-star steps (distributed union-find).

    edges has columns a, b of one sortable type.  Returns (id, root) for each id that has an edge to another id, root being the
    least id of its component.  Every step is an aggregation (combined before the shuffle) and an equi-join, so a
    vertex with very many neighbours is split among tasks.  The rounds grow with the logarithm of the longest chain.  Self loops and
    nulls are ignored; repeated edges count once; no edges give an empty table.
    """

    def step(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        out = written(e.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("h")), name)
        return out, (seen.get["n"], seen.get["h"])

    def star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        return small_.where("u <> v").distinct()

    now, was = step(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if not was[0]:
            break
        now, at = step(star(now), "stars")
        if at == was:
            break
        was = at
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
