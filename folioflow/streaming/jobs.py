"""The job queue as a stream: uploads come in as files, contents already converted are reused, states are kept per job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow.operators.catalog import NEXT

EVENTS = "route string, id string, status string, created_at timestamp"
STATES = "route string, id string, status string, n_events long, n_refused long"


def read_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Job events (JSON lines) as a stream, so many files at a time."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(path)


def first_of_content(uploads: DataFrame, delay: str = "7 days") -> DataFrame:
    """Uploads (route, file_hash, created_at) without those of a content that came before, within the delay."""
    return uploads.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["route", "file_hash"])


class Status(StatefulProcessor):
    """Keeps a job's status; an event that the state machine doesn't allow is counted and otherwise ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string, n_events long, n_refused long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, n, refused = self.state.get() if self.state.exists() else (None, 0, 0)
        found = pd.concat(list(rows)).sort_values(["created_at", "status"], kind="stable")
        for wanted in found["status"]:
            n += 1
            if status is None or wanted in NEXT.get(status, ()):
                status = wanted
            elif wanted != status:
                refused += 1
        self.state.update((status, n, refused))
        yield pd.DataFrame({"route": [key[0]], "id": [key[1]], "status": [status], "n_events": [n], "n_refused": [refused]})

    def close(self) -> None:
        pass


def statuses(events: DataFrame) -> DataFrame:
    """The status of each job after each batch that touched it; needs the RocksDB state store."""
    return events.groupBy("route", "id").transformWithStateInPandas(Status(), STATES, "Update", "None")


def status_batch(events: DataFrame) -> DataFrame:
    """The batch twin: the last allowed status of each job, by the same rules in one fold over its events by time, then status.

    The stream sees the events of one batch in that order, and those of later batches after them.
    """
    item = F.struct("created_at", "status")
    state = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("refused"))

    def step(acc, x):
        allowed = acc["status"].isNull()
        for a, bs in NEXT.items():
            allowed = allowed | ((acc["status"] == a) & x["status"].isin(*bs))
        ok = F.coalesce(allowed, F.lit(False))
        return F.struct(F.when(ok, x["status"]).otherwise(acc["status"]).alias("status"), (acc["n"] + 1).alias("n"), (acc["refused"] + F.when(ok | (x["status"] == acc["status"]), 0).otherwise(1)).alias("refused"))

    folded = events.groupBy("route", "id").agg(F.sort_array(F.collect_list(item)).alias("e")).select("route", "id", F.aggregate("e", state, step).alias("s"))
    return folded.select("route", "id", "s.status", F.col("s.n").alias("n_events"), F.col("s.refused").alias("n_refused"))


def recover(events: DataFrame) -> DataFrame:
    """Jobs that were open when the service stopped, as new events that queue them again."""
    return status_batch(events).where("status in ('pendente', 'processando')").select("route", "id", F.lit("pendente").alias("status"))


def work(queue: DataFrame, convert, checkpoint: str):
    """Runs convert(jobs of a batch) over the pending jobs of a stream of log rows, first come first served; starts and returns the query."""

    def batch(rows: DataFrame, _) -> None:
        convert(rows.where("status = 'pendente'").orderBy("created_at", "id"))

    return queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_cancels(events: DataFrame, cancels: DataFrame) -> DataFrame:
    """Job events with requests to cancel (route, id, created_at) as events of their own; the state machine refuses those that come too late."""
    return events.unionByName(cancels.select("route", "id", F.lit("cancelado").alias("status"), "created_at"))
