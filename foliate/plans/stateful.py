"""Queries over settling files, runs of jobs and job tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.plans.datasets import derive, duck
from foliate.plans.queries import file_events, query
from foliate.plans.searches import _EV, ORACLES
from foliate.sources.tables import shared_dir
from foliate.streaming import stateful as U

c = F.col


def moment(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("T3_settled_files")
def _(spark, sf):
    """Each time that a file has settled, or was waited for long enough."""
    e = file_events(spark, sf).withColumn("ts", F.date_trunc("second", "ts"))
    told = U.settled_files(e, "30 minutes", "2 hours", order="event_id")
    return told.select("path", moment("started"), moment("last_ts"), moment("told_at"), "size", "n_events", "stable")


@query("T7_job_runs")
def _(spark, sf):
    """Runs of jobs: until success, the third failure, or a day without an event."""
    jobs = derive(spark, sf, "jobs").withColumn("ts", F.date_trunc("second", c("ts").cast("timestamp")))
    return U.job_runs(jobs).select("job_id", moment("started"), moment("last_ts"), "status", "n_events", "failures", "terminal")


@query("T6_job_ingest")
def _(spark, sf):
    """Jobs of three batches of events, the second of which runs twice."""
    size = c("size")
    e = file_events(spark, sf).select("event_id", "path", F.when(size % 5 == 0, "").otherwise((size % 5).cast("string")).alias("sha256"))
    jobs = U.JobTable(spark, shared_dir(spark))
    for k in (0, 1, 2, 1):
        jobs.ingest(e.where(c("event_id") % 3 == k), k)
    return jobs.rows().select("path", "sha256", "status", "batch")


ORACLES["T3_settled_files"] = f"""WITH RECURSIVE {_EV},
e AS (SELECT path, event_type, size, epoch_us(ts) AS t, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS i FROM ev),
r AS (
  SELECT path, i, CASE WHEN event_type <> 'deleted' THEN t END AS s, t AS l, size AS z, 1 AS n FROM e WHERE i = 1
  UNION ALL
  SELECT e.path, e.i, CASE WHEN event_type = 'deleted' THEN NULL WHEN s IS NULL OR least(l + 1800000000, s + 7200000000) <= t THEN t ELSE s END, t, size,
         CASE WHEN s IS NULL OR least(l + 1800000000, s + 7200000000) <= t THEN 1 ELSE n + 1 END
  FROM r JOIN e ON e.path = r.path AND e.i = r.i + 1),
o AS (SELECT r.*, least(l + 1800000000, s + 7200000000) AS a, e.t FROM r LEFT JOIN e ON e.path = r.path AND e.i = r.i + 1 WHERE s IS NOT NULL)
SELECT path, strftime(make_timestamp(s), '%Y-%m-%d %H:%M:%S') AS started, strftime(make_timestamp(l), '%Y-%m-%d %H:%M:%S') AS last_ts, strftime(make_timestamp(a), '%Y-%m-%d %H:%M:%S') AS told_at,
       z AS size, CAST(n AS BIGINT) AS n_events, l + 1800000000 <= a AS stable
FROM o WHERE t IS NULL OR a <= t"""
ORACLES["T7_job_runs"] = f"""WITH RECURSIVE {duck("jobs")},
e AS (SELECT job_id, status, epoch_us(date_trunc('second', ts)) AS t, row_number() OVER (PARTITION BY job_id ORDER BY date_trunc('second', ts), event_id) AS i FROM jobs),
r AS (
  SELECT job_id, i, 1 AS run, t AS s, t AS l, status, 1 AS n, CAST(status = 'FAILED' AS INT) AS f, status IN ('SUCCESS', 'COMPLETED') AS done FROM e WHERE i = 1
  UNION ALL
  SELECT job_id, i, run + CAST(new AS INT), CASE WHEN new THEN t ELSE s END, t, status, CASE WHEN new THEN 1 ELSE n + 1 END, CASE WHEN new THEN 0 ELSE f END + CAST(status = 'FAILED' AS INT),
         status IN ('SUCCESS', 'COMPLETED') OR CASE WHEN new THEN 0 ELSE f END + CAST(status = 'FAILED' AS INT) >= 3
  FROM (SELECT e.*, r.run, r.s, r.n, r.f, r.done OR e.t - r.l >= 86400000000 AS new FROM r JOIN e ON e.job_id = r.job_id AND e.i = r.i + 1))
SELECT job_id, strftime(make_timestamp(s), '%Y-%m-%d %H:%M:%S') AS started, strftime(make_timestamp(l), '%Y-%m-%d %H:%M:%S') AS last_ts, status, CAST(n AS BIGINT) AS n_events, CAST(f AS BIGINT) AS failures, done AS terminal
FROM r QUALIFY row_number() OVER (PARTITION BY job_id, run ORDER BY i DESC) = 1"""
ORACLES["T6_job_ingest"] = f"""WITH {_EV}, s AS (SELECT path, CASE WHEN size % 5 = 0 THEN '' ELSE CAST(size % 5 AS VARCHAR) END AS sha256, event_id % 3 AS batch FROM ev),
f AS (SELECT *, min(batch) OVER (PARTITION BY path) AS first_batch FROM s)
SELECT path, sha256, 'QUEUED' AS status, min(batch) AS batch FROM f WHERE sha256 <> '' OR batch = first_batch GROUP BY path, sha256"""
