"""The job catalog: an append-only log of job events, its latest view, reuse by content hash, and the status machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.params import PARAMS

OPEN = ("pendente", "processando")
NEXT = {"pendente": ("processando", "cancelado", "concluido"), "processando": ("concluido", "erro", "cancelado", "pendente")}


def latest(log: DataFrame, at: str = "updated_at") -> DataFrame:
    """One row per (route, id): of each field the last value that is not null; deleted jobs are gone."""
    fields = [c for c in log.columns if c not in ("route", "id", at, "deleted")]
    agg = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in fields]
    gone = F.coalesce(F.max_by("deleted", at), F.lit(False)) if "deleted" in log.columns else F.lit(False)
    return log.groupBy("route", "id").agg(*agg, F.max(at).alias(at), gone.alias("deleted")).where(~F.col("deleted")).drop("deleted")


def newest(jobs: DataFrame, limit: int = PARAMS.job_limit) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def stuck(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*OPEN))


def done_by_hash(jobs: DataFrame) -> DataFrame:
    """The newest finished job of each (route, file_hash)."""
    rank = F.row_number().over(Window.partitionBy("route", "file_hash").orderBy(F.desc("created_at"), F.desc("id")))
    return jobs.where("status = 'concluido'").withColumn("rank", rank).where("rank = 1").drop("rank")


def reuse(uploads: DataFrame, jobs: DataFrame) -> DataFrame:
    """uploads with reused_id: the newest finished job of the same content that was made before, else null.

    Uploads and finished jobs of one content are one ordered list; a window carries the latest job on, so a content with very many of
    both is sorted, not multiplied.
    """
    done = jobs.where("status = 'concluido'").select("route", "file_hash", "created_at", F.col("id").alias("job"), F.lit(None).cast("string").alias("id"))
    asked = uploads.select("route", "file_hash", "created_at", F.lit(None).cast("string").alias("job"), "id")
    # of one time uploads come first, so jobs of the upload's own time don't count
    w = Window.partitionBy("route", "file_hash").orderBy("created_at", F.col("job").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("job").isNotNull(), F.struct("created_at", "job"))).over(w)
    return done.unionByName(asked).withColumn("last", last).where("id is not null").select("id", "route", F.col("last.job").alias("reused_id"))


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("route").agg(F.count_if(F.col("status") == "pendente").alias("pending"), F.count_if(F.col("status") == "processando").alias("running"))


def transitions(log: DataFrame, key: str, at: str = "created_at") -> DataFrame:
    """(prev, status, allowed, n): the steps between successive events of a key."""
    w = Window.partitionBy(key).orderBy(at, "id")
    rows = log.withColumn("prev", F.lag("status").over(w)).where("prev is not null")
    allowed = F.lit(False)
    for a, bs in NEXT.items():
        allowed = allowed | ((F.col("prev") == a) & F.col("status").isin(*bs))
    return rows.groupBy("prev", "status", allowed.alias("allowed")).agg(F.count("*").alias("n"))


def created(uploads: DataFrame) -> DataFrame:
    """Log rows of new jobs from uploads (route, id, ...): pending, made and changed at created_at; appending them to the log creates the jobs."""
    return uploads.withColumns({"status": F.lit("pendente"), "updated_at": F.col("created_at"), "deleted": F.lit(False)})


def job(jobs: DataFrame, route: str, job_id: str) -> DataFrame:
    """The row of one job, or none."""
    return jobs.where((F.col("route") == route) & (F.col("id") == job_id))


def fifo(jobs: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Pending jobs with place, their turn in the queue of their route; jobs that were cancelled (route, id) are passed over."""
    waiting = jobs.where("status = 'pendente'")
    if cancelled is not None:
        waiting = waiting.join(cancelled.select("route", "id").distinct(), ["route", "id"], "left_anti")
    return waiting.withColumn("place", F.row_number().over(Window.partitionBy("route").orderBy("created_at", "id")))


def cancel(jobs: DataFrame, asked: DataFrame, grace_seconds: int = 4) -> DataFrame:
    """(route, id, outcome, stop_after) of requests to cancel: pending jobs are cancelled at once, running ones stopped, killed after the grace; others refused."""
    met = asked.join(jobs.select("route", "id", "status"), ["route", "id"], "left")
    outcome = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "pendente", "cancelled").when(F.col("status") == "processando", "stopping").otherwise("refused")
    return met.select("route", "id", outcome.alias("outcome"), F.when(F.col("status") == "processando", F.lit(grace_seconds)).alias("stop_after"))


def deleted(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """(route, id, step, what) of requests to delete, in the order of steps: stop a running job, remove its folder, write its tombstone."""
    met = jobs.join(asked.select("route", "id").distinct(), ["route", "id"])
    steps = F.array(F.when(F.col("status").isin(*OPEN), F.struct(F.lit(0).alias("step"), F.lit("stop").alias("what"))), F.struct(F.lit(1).alias("step"), F.lit("remove files").alias("what")), F.struct(F.lit(2).alias("step"), F.lit("tombstone").alias("what")))
    return met.select("route", "id", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("s")).select("route", "id", "s.*")


def result_json(route, note_path, n: Column) -> Column:
    """What a worker reports: the note and its images, or its articles."""
    handout = F.to_json(F.struct(note_path.alias("md_path"), n.cast("int").alias("n_images")))
    return F.when(route == "legislacao", F.to_json(F.struct(note_path.alias("md_path"), n.cast("int").alias("n_artigos")))).otherwise(handout)


META = "original_filename string, display_name string, disciplina string, professora string, aula string, titulo string, tags array<string>"


def read_meta(raw) -> Column:
    """A job's description from its JSON; null for what is none."""
    return F.from_json(raw, META)


def archive_manifest(jobs: DataFrame, images: DataFrame) -> DataFrame:
    """(route, id, place, member, source, problem) of the archives of finished jobs: the note, images by name, the original under its own name.

    jobs: (route, id, status, md_path, original_filename, upload_path); images: (route, id, name, path).  A job that is not finished, or
    without a note, has one row that says so.
    """
    state = F.when(F.col("status") != "concluido", "not finished").when(F.col("md_path").isNull(), "no note")
    known = jobs.withColumn("problem", state)
    bad = known.where("problem is not null").select("route", "id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("source"), "problem")
    good = known.where("problem is null")
    base = F.element_at(F.split("md_path", "/"), -1)
    notes = good.select("route", "id", F.lit(0).alias("kind"), base.alias("member"), F.col("md_path").alias("source"))
    pictures = images.join(good.select("route", "id"), ["route", "id"]).select("route", "id", F.lit(1).alias("kind"), F.concat(F.lit("images/"), "name").alias("member"), F.col("path").alias("source"))
    originals = good.select("route", "id", F.lit(2).alias("kind"), F.col("original_filename").alias("member"), F.col("upload_path").alias("source"))
    listed = notes.unionByName(pictures).unionByName(originals)
    place = F.row_number().over(Window.partitionBy("route", "id").orderBy("kind", "member"))
    return listed.select("route", "id", place.alias("place"), "member", "source", F.lit(None).cast("string").alias("problem")).unionByName(bad)
