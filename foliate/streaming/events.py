"""File and job events.  Every function takes a streaming or a batch frame alike.

Watermarks bound the state of streams; on batch frames they do nothing, so a batch run
over the same events is each stream's twin, but for sessions still open at its end and for
`new_jobs`, where a stream forgets a path and hash once the watermark has passed it.
Streams that act when time has passed, or compare with a job table, are in `stateful`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.operators.metrics import OUTCOMES, count_where


def only_archives(events: DataFrame, path: str = "path") -> DataFrame:
    return events.where(F.lower(path).rlike(r"\.cb[zr]$"))


def split_moves(events: DataFrame) -> DataFrame:
    """A move becomes a deletion of its source and a creation of its destination."""
    deleted = F.struct(F.col("path").alias("path"), F.lit("deleted").alias("event_type"))
    created = F.struct(F.col("dest_path").alias("path"), F.lit("created").alias("event_type"))
    same = F.struct(F.col("path").alias("path"), F.col("event_type").alias("event_type"))
    parts = F.when(F.col("event_type") == "moved", F.array(deleted, created)).otherwise(F.array(same))
    rest = [c for c in events.columns if c not in ("path", "event_type", "dest_path")]
    return events.select(*rest, F.inline(parts))


def debounce(events: DataFrame, delay: str = "5 minutes", late: str = "10 minutes", stamp: str = "ts", max_wait: str = "10 minutes") -> DataFrame:
    """One row per burst of events on a path: its start, last event, number of events and last sizes.

    stable tells whether the last two observations have equal sizes; bursts that never
    settle are emitted all the same; gave_up marks those that went on for max_wait or longer.
    An event that comes exactly `delay` after the one before begins a new burst; of events at
    the last time the greatest type is told.
    """
    seen = F.struct(F.col(stamp).alias("t"), "size")
    gap = f"{delay} -1 microseconds"  # Spark joins sessions that touch
    burst = events.withWatermark(stamp, late).groupBy("path", F.session_window(stamp, gap).alias("w")).agg(
        F.count("*").alias("n_events"), F.max_by("event_type", F.struct(stamp, "event_type")).alias("last_type"), F.max(stamp).alias("last_ts"), F.slice(F.sort_array(F.collect_list(seen), asc=False), 1, 2).alias("_last")
    )
    last, before = F.get("_last", F.lit(0))["size"], F.get("_last", F.lit(1))["size"]
    return burst.select(
        "path", F.col("w.start").alias("started"), "last_ts", "n_events", "last_type", last.alias("size"), F.coalesce(last == before, F.lit(False)).alias("stable")
    ).withColumn("gave_up", ~F.col("stable") & (F.col("last_ts") >= F.col("started") + F.expr(f"INTERVAL {max_wait}")))


def still_there(bursts: DataFrame) -> DataFrame:
    """Bursts that do not end in a deletion."""
    return bursts.where("last_type <> 'deleted'")


def without_known(events: DataFrame, known: DataFrame) -> DataFrame:
    """Events on files that are recorded with this path, size, mtime and hash are our own writes: dropped."""
    return events.join(known.select("path", "size", "mtime", "sha256").distinct(), ["path", "size", "mtime", "sha256"], "left_anti")


def new_jobs(events: DataFrame, late: str = "10 minutes", stamp: str = "ts") -> DataFrame:
    """One event per path and hash; a stream remembers them within the watermark, a batch for its whole length."""
    kept = events.withWatermark(stamp, late)
    return kept.dropDuplicatesWithinWatermark(["path", "sha256"]) if events.isStreaming else kept.dropDuplicates(["path", "sha256"])


def lifecycle(events: DataFrame, most_attempts: int = 3, stamp: str = "ts") -> DataFrame:
    """Per job: last status, attempts, whether it ended or failed for good."""
    status: Column = F.max_by("status", F.struct(stamp, "event_id"))
    failures = count_where(F.col("status") == "FAILED")
    out = events.groupBy("job_id").agg(status.alias("status"), F.count("*").alias("n_events"), failures.alias("failures"))
    return out.withColumn("terminal", (F.col("failures") >= most_attempts) | F.col("status").isin("SUCCESS", "COMPLETED"))


def windowed_outcomes(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", stamp: str = "ts") -> DataFrame:
    """Outcomes and average duration per window of time."""
    counts = [count_where(F.col("status").isin(v)).alias(k) for k, v in OUTCOMES.items()]
    g = events.withWatermark(stamp, late).groupBy(F.window(stamp, width).alias("w")).agg(F.count("*").alias("total"), *counts, F.round(F.avg("value"), 1).alias("avg_duration"))
    return g.select(F.col("w.start").alias("started"), "total", *OUTCOMES, "avg_duration")


def windowed_health(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes", stamp: str = "ts") -> DataFrame:
    """Calls, failures and average milliseconds per provider and window of time."""
    g = calls.withWatermark(stamp, late).groupBy("provider", F.window(stamp, width).alias("w"))
    told = g.agg(F.count("*").alias("calls"), count_where(F.col("http_status") >= 400).alias("failures"), F.round(F.avg("ms"), 1).alias("avg_ms"))
    return told.select("provider", F.col("w.start").alias("started"), "calls", "failures", "avg_ms")


def not_yet_done(events: DataFrame, done: DataFrame) -> DataFrame:
    """Events that no earlier run has handled (done: event_id), so that a restart without its checkpoint repeats nothing."""
    return events.join(done.select("event_id").distinct(), "event_id", "left_anti")
