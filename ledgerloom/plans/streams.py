"""Queries that run as streams (every row that is there, then they end), with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain
from ..streaming import audit, jobs
from ..streaming.shared import rocksdb, shared_path
from . import tables as t
from .queries import query

CAPS = jobs.Caps(per_actor=1, per_org=2, seconds=600)
LATE = 600


def job_events(events):
    """org, actor, job_id, kind, at: even events submit a job, odd ones end the one before or the fourth before, some minutes later."""
    e = F.col("event_id")
    job = F.when(e % 2 == 0, e).when((e % 6 == 1) | (e < 9), e - 1).otherwise(e - 9)
    at = F.expr("date_trunc('SECOND', CAST(ts AS TIMESTAMP)) + make_interval(0, 0, 0, 0, 0, 2 * CAST(event_id % 5 AS INT))")
    return events.select((F.floor(job / 16) % 5).alias("org"), (F.floor(job / 4) % 4).alias("actor"), job.alias("job_id"), F.when(e % 2 == 0, "submit").otherwise("finish").alias("kind"), at.alias("at"))


def streamed(spark, path):
    """A stream of a Parquet table, its schema taken from the table. As a pattern, the path may be a single file too."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


@query(
    "r04_pending_jobs",
    """WITH RECURSIVE x AS (SELECT event_id AS e, date_trunc('second', ts) + to_minutes(2 * (event_id % 5)::INT) AS moment, CASE WHEN event_id % 2 = 0 THEN event_id WHEN event_id % 6 = 1 OR event_id < 9 THEN event_id - 1 ELSE event_id - 9 END AS job FROM events),
    r AS (SELECT job // 16 % 5 AS org, job // 4 % 4 AS actor, job, e % 2 AS finish, epoch_ms(moment) AS ms FROM x),
    w AS (SELECT max(ms) - 600000 AS wm FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY ms, finish DESC, job) AS k FROM r, w WHERE ms <= wm),
    s AS (
      SELECT org, 0::BIGINT AS k, 0::BIGINT AS job, 0::BIGINT AS ms, '' AS what, []::STRUCT(job BIGINT, actor BIGINT, ms BIGINT)[] AS p FROM (SELECT DISTINCT org FROM o)
      UNION ALL
      SELECT org, k, job, ms, what, CASE what WHEN 'accepted' THEN list_append(p, {'job': job, 'actor': actor, 'ms': ms}) WHEN 'released' THEN list_filter(p, lambda v: v.job <> job) ELSE p END FROM (
        SELECT *, CASE WHEN finish = 1 THEN CASE WHEN len(list_filter(p, lambda v: v.job = n.job)) > 0 THEN 'released' ELSE 'unknown' END
          WHEN len(list_filter(p, lambda v: v.actor = n.actor)) >= 1 THEN 'actor_pending' WHEN len(p) >= 2 THEN 'organization_pending' ELSE 'accepted' END AS what
        FROM (SELECT o.org, o.k, o.job, o.actor, o.ms, o.finish, list_filter(s.p, lambda v: o.ms - v.ms <= 600000) AS p FROM s JOIN o ON o.org = s.org AND o.k = s.k + 1) n)),
    d AS (SELECT org, job, ms, what FROM s WHERE k > 0)
    SELECT org, job AS job_id, ms AS "at", what FROM d
    UNION ALL SELECT a.org, a.job, a.ms + 600000, 'expired' FROM d a, w WHERE what = 'accepted' AND wm - a.ms > 600000 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.org = a.org AND b.job = a.job AND b.what = 'released')""",
)
def r04(spark, d):
    """Caps of one job an actor and two an organisation, release at the end, expiry after ten minutes; watermark of ten minutes."""
    path = shared_path(spark, "jobs")
    rows = job_events(streamed(spark, f"{d}/events.parquet"))
    with rocksdb(spark):
        out = jobs.job_stream(rows, CAPS, late=LATE).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
        out.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("org", "job_id", "at", "what")


@query(
    "r11_job_stage",
    """WITH p AS (SELECT page_id AS job_id, octet_length(encode(html)) + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS declared, octet_length(encode(html)) AS size, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'html' END AS kind, html,
      CASE page_id % 4 WHEN 0 THEN '0.00' WHEN 1 THEN NULL WHEN 2 THEN (page_id * 3) || '.5' ELSE '1,' || lpad((page_id % 1000)::VARCHAR, 3, '0') || '.25' END AS amount FROM pages WHERE html IS NOT NULL),
    o AS (SELECT *, CASE WHEN declared <> size THEN 'size_mismatch' WHEN kind = 'pdf' OR left(html, 9) <> '<!DOCTYPE' THEN 'type_mismatch' WHEN coalesce(try_cast(replace(amount, ',', '') AS DECIMAL(20, 2)), 0) = 0 THEN 'amount_denied' ELSE 'proposed' END AS outcome FROM p)
    SELECT job_id, outcome, CASE WHEN outcome = 'proposed' THEN CAST(replace(amount, ',', '') AS DECIMAL(20, 2)) END AS amount, CASE WHEN outcome = 'proposed' THEN DATE '2024-05-01' END AS transaction_date FROM o""",
)
def r11(spark, d):
    """Every page as an uploaded file: size as declared, beginning as its type's, an amount other than zero; dated by the day of processing."""
    path = shared_path(spark, "stage")
    k = F.col("page_id")
    body = F.encode("html", "UTF-8")
    amount = F.when(k % 4 == 0, "0.00").when(k % 4 == 2, F.concat((k * 3).cast("string"), F.lit(".5"))).when(k % 4 == 3, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".25")))
    rows = streamed(spark, f"{d}/pages.parquet").where("html IS NOT NULL").select(k.alias("job_id"), (F.octet_length("html") + F.when(k % 7 == 0, 1).otherwise(0)).alias("declared_size"), F.when(k % 5 == 0, "pdf").otherwise("html").alias("declared_type"), body.alias("body"), amount.alias("amount"))
    kinds = {"html": b"<!DOCTYPE".hex(), "pdf": b"%PDF-".hex()}
    jobs.stage_stream(rows, f"{path}/out", kinds, f"{path}/state", F.lit("2024-05-01").cast("date")).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("job_id", "outcome", "amount", "transaction_date")


PAYLOAD = ["event_type", "value", "props"]


@query(
    "r09_audit_stream",
    "SELECT user_id AS organization_id, count(*) AS n, true AS ok, NULL::BIGINT AS failed_at, NULL::VARCHAR AS code, true AS as_in_one_batch FROM events GROUP BY user_id",
)
def r09(spark, d):
    """Events in three deliveries, the last with a tenth of all once more: the chains verify, against their heads too, and end as those of one batch do."""
    path = shared_path(spark, "audit")
    events = t.table(spark, d, "events").withColumns({"organization_id": F.col("user_id"), "ts": F.col("ts").cast("timestamp")})
    most = events.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * 3 / (most + 1))
    for k in range(3):
        now = events.where(part == k)
        if k == 2:
            now = now.unionByName(events.where((part == 1) & (F.col("event_id") % 10 == 0)))
        now.write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        audit.audit_stream(source, f"{path}/out", "organization_id", "event_id", PAYLOAD, "event_id", "ts", f"{path}/state", late="1 day").awaitTermination()
    chained, heads = audit.read_chain(spark, f"{path}/out")
    whole = chain.heads_of(chain.append(events, "organization_id", "event_id", PAYLOAD), "organization_id").select("organization_id", F.col("event_hash").alias("_whole"))
    ends = heads.join(whole, "organization_id").select("organization_id", (F.col("event_hash") == F.col("_whole")).alias("as_in_one_batch"))
    return chain.verify(chained, "organization_id", PAYLOAD, heads).join(ends, "organization_id")
