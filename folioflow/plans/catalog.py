"""Queries over the job catalog and its log."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as X
from folioflow.operators import catalog as C
from folioflow.operators import quality as Q
from folioflow.params import PARAMS

JOBS = X.JOBS_SQL


def _log(spark, d):
    """Each hash is one job; its events set some fields."""
    j = X.jobs(spark, d)
    return j.select("route", F.col("file_hash").alias("id"), "status", "error_message", F.struct("created_at", F.col("id").alias("event")).alias("updated_at"), (F.hash("id") % 50 == 0).alias("x")).drop("x")


def jobs_latest(spark, d):
    return C.latest(_log(spark, d)).select("route", "id", "status", F.substring("error_message", 1, PARAMS.error_chars).alias("error_message"))


def jobs_topk(spark, d):
    return C.newest(X.jobs(spark, d)).select("id", "route", "status", "created_at")


def jobs_stuck(spark, d):
    return C.stuck(X.jobs(spark, d)).select("id", "route", "status")


def jobs_done(spark, d):
    return C.done_by_hash(X.jobs(spark, d)).select("route", "file_hash", "id")


def jobs_reuse(spark, d):
    return C.reuse(X.jobs(spark, d).where("status = 'pendente'"), X.jobs(spark, d))


def queue_depth(spark, d):
    return C.queue_depth(X.jobs(spark, d))


def status_steps(spark, d):
    return C.transitions(X.jobs(spark, d), "file_hash")


_ALLOWED = " or ".join(f"(prev = '{a}' and status in ({', '.join(repr(b) for b in bs)}))" for a, bs in C.NEXT.items())


def dq_page_sequence(spark, d):
    pages = X.parts(spark, d).select(F.col("order_id").alias("doc_id"), "page_index", (F.col("page_index") + F.when(F.col("qty") % 10 == 0, 1).otherwise(0)).alias("label"))
    return Q.page_sequence(pages)


QUERIES = {
    "jobs_latest": (
        jobs_latest,
        f"with {JOBS} select route, file_hash as id, arg_max(status, struct_pack(a := created_at, b := id)) as status, substr(arg_max(error_message, struct_pack(a := created_at, b := id)) filter (error_message is not null), 1, {PARAMS.error_chars}) as error_message from jobs group by route, file_hash",
    ),
    "jobs_topk": (jobs_topk, f"with {JOBS} select id, route, status, created_at from jobs order by created_at desc, id desc limit {PARAMS.job_limit}"),
    "jobs_stuck": (jobs_stuck, f"with {JOBS} select id, route, status from jobs where status in ('pendente', 'processando')"),
    "jobs_done_by_hash": (jobs_done, f"with {JOBS}, r as (select *, row_number() over (partition by route, file_hash order by created_at desc, id desc) as k from jobs where status = 'concluido') select route, file_hash, id from r where k = 1"),
    "jobs_reuse": (
        jobs_reuse,
        f"with {JOBS} select u.id, u.route, arg_max(j.id, struct_pack(a := j.created_at, b := j.id)) filter (j.id is not null) as reused_id from jobs u left join jobs j on j.status = 'concluido' and j.route = u.route and j.file_hash = u.file_hash and j.created_at < u.created_at where u.status = 'pendente' group by u.id, u.route",
    ),
    "queue_depth": (queue_depth, f"with {JOBS} select route, count(*) filter (status = 'pendente') as pending, count(*) filter (status = 'processando') as running from jobs group by route"),
    "status_steps": (status_steps, f"with {JOBS}, p as (select *, lag(status) over (partition by file_hash order by created_at, id) as prev from jobs) select prev, status, ({_ALLOWED}) as allowed, count(*) as n from p where prev is not null group by all"),
    "dq_page_sequence": (
        dq_page_sequence,
        f"with {X.PARTS_SQL}, p as (select order_id as doc_id, page_index, page_index + case when qty % 10 = 0 then 1 else 0 end as label from parts), b as (select *, coalesce(label - lag(label) over (partition by doc_id order by page_index) <> 1, false) as bad from p) select doc_id, count(*) as n_pages, count(*) filter (bad) as n_breaks from b group by doc_id",
    ),
}
