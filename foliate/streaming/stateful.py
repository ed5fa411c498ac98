"""Streams that keep a state per key and act when time has passed: settling files, runs of jobs.

Each rule is a small machine (`step` for an event, `due` for the time that has come) that
sees a key's events in the order of their times.  A stream holds events back until the
watermark has passed them, so that late ones still come in order and results do not depend on
batches; the state of a key is its open entry and the events above the watermark.  Timers in
event time wake a key when its next event is settled or its entry is due, and a key without
an open entry or event leaves the state.

Batch twins take the same events and give the same rows, and those still open at the end.
Streams need the RocksDB state store: `use_state_store(spark)` before the query starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliate.operators.curate import ACTIVE

ENDED = ("SUCCESS", "COMPLETED")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Settling:
    """A path is told when it has been quiet for `quiet`, or after `max_wait` from its first event; a deletion cancels it.

    Events are (t, order, event_type, size), times in microseconds.  After max_wait the next
    event begins a new wait, so a path that stays busy is told again and again.
    """

    events = "t long, ord long, event_type string, size long"
    state = "started long, last long, size long, n long"
    told = "started long, last long, at long, size long, n_events long, stable boolean"

    def __init__(self, quiet: int, max_wait: int):
        self.quiet, self.max_wait = quiet, max_wait

    def deadline(self, s: tuple) -> int:
        return min(s[1] + self.quiet, s[0] + self.max_wait)

    def due(self, s: tuple | None, now: float) -> tuple[tuple | None, list[tuple]]:
        if s is None or self.deadline(s) > now:
            return s, []
        at = self.deadline(s)
        return None, [(s[0], s[1], at, s[2], s[3], s[1] + self.quiet <= at)]

    def step(self, s: tuple | None, e: tuple) -> tuple[tuple | None, list[tuple]]:
        s, out = self.due(s, e[0])
        if e[2] == "deleted":
            return None, out
        return (e[0] if s is None else s[0], e[0], e[3], 1 if s is None else s[3] + 1), out


class Runs:
    """A job's run ends with success, with its `most_attempts`-th failure, or unfinished after `idle` without an event.

    Events are (t, order, status).  What follows begins a new run.
    """

    events = "t long, ord long, status string"
    state = "started long, last long, status string, n long, failures long"
    told = "started long, last long, status string, n_events long, failures long, terminal boolean"

    def __init__(self, most_attempts: int, idle: int):
        self.most_attempts, self.idle = most_attempts, idle

    def deadline(self, s: tuple) -> int:
        return s[1] + self.idle

    def due(self, s: tuple | None, now: float) -> tuple[tuple | None, list[tuple]]:
        return (s, []) if s is None or self.deadline(s) > now else (None, [(*s, False)])

    def step(self, s: tuple | None, e: tuple) -> tuple[tuple | None, list[tuple]]:
        s, out = self.due(s, e[0])
        started, _, _, n, failures = s or (e[0], 0, "", 0, 0)
        s = (started, e[0], e[2], n + 1, failures + (e[2] == "FAILED"))
        if e[2] in ENDED or s[4] >= self.most_attempts:
            return None, [*out, (*s, True)]
        return s, out


class InOrder(StatefulProcessor):
    """Feeds a machine with each key's events in the order of their times."""

    def __init__(self, machine: Settling | Runs):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.machine.events)
        self.open = handle.getValueState("open", self.machine.state)

    def _wake(self, times: list[int]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))  # milliseconds, rounded up

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.machine.events.split(", ")]
        new = [tuple(r) for b in rows for r in b[names].astype(object).itertuples(index=False)]
        self.pending.appendList(new)
        state = self.open.get() if self.open.exists() else None
        self._wake([e[0] for e in self.pending.get()] + ([self.machine.deadline(state)] if state else []))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        waiting = sorted(self.pending.get()) if self.pending.exists() else []
        state = tuple(self.open.get()) if self.open.exists() else None
        rest = [e for e in waiting if e[0] > now]
        for e in waiting[: len(waiting) - len(rest)]:
            state, told = self.machine.step(state, tuple(e))
            out += told
        state, told = self.machine.due(state, now)
        out += told
        self.pending.put(rest) if rest else self.pending.clear()
        self.open.update(state) if state else self.open.clear()
        self._wake([e[0] for e in rest[:1]] + ([self.machine.deadline(state)] if state else []))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", *[c.split()[0] for c in self.machine.told.split(", ")]])

    def close(self) -> None:
        pass


def _micros(interval: str) -> int:
    """An interval such as "5 minutes" in microseconds."""
    return int(pd.Timedelta(interval).value // 1000)


def _fed(keyed: DataFrame, machine: Settling | Runs, kind: str) -> DataFrame:
    """keyed: column key, ts and the machine's events.  A stream needs its watermark on ts."""
    schema = f"key {kind}, {machine.told}"
    if keyed.isStreaming:
        return keyed.groupBy("key").transformWithStateInPandas(InOrder(machine), schema, outputMode="Append", timeMode="EventTime")
    names = [c.split()[0] for c in machine.events.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        columns = ["key", *[c.split()[0] for c in machine.told.split(", ")]]
        for b in batches:
            out = []
            for r in b[["key", *names]].astype(object).itertuples(index=False):
                if held is None or r[0] != held[0]:
                    out += [(held[0], *t) for t in machine.due(state, float("inf"))[1]] if held else []
                    held, state = (r[0],), None
                state, told = machine.step(state, tuple(r[1:]))
                out += [(r[0], *t) for t in told]
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(held[0], *t) for t in machine.due(state, float("inf"))[1]], columns=columns)

    # one pass over sorted rows: a key of any length costs a task its time, not its memory
    return keyed.repartition("key").sortWithinPartitions("key", "t", "ord").mapInPandas(run, schema)


def settled_files(events: DataFrame, quiet: str = "5 minutes", max_wait: str = "10 minutes", late: str = "10 minutes", stamp: str = "ts", order: str | None = None) -> DataFrame:
    """Columns path, started, last_ts, told_at, size, n_events, stable: one row each time a path is told.

    stable: it was quiet for `quiet`; else max_wait had passed and it is told all the same.
    Null paths or times are left out.  `order` is a column that orders events of equal times.
    """
    keyed = events.withWatermark(stamp, late).where(F.col("path").isNotNull() & F.col(stamp).isNotNull()).select(
        F.col("path").alias("key"), F.col(stamp).alias("ts"), F.unix_micros(stamp).alias("t"), (F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")).alias("ord"),
        F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"),
    )
    told = _fed(keyed, Settling(_micros(quiet), _micros(max_wait)), "string")
    return told.select(F.col("key").alias("path"), F.timestamp_micros("started").alias("started"), F.timestamp_micros("last").alias("last_ts"), F.timestamp_micros("at").alias("told_at"), "size", "n_events", "stable")


def job_runs(events: DataFrame, most_attempts: int = 3, idle: str = "1 day", late: str = "10 minutes", stamp: str = "ts") -> DataFrame:
    """Columns job_id, started, last_ts, status, n_events, failures, terminal: a row per run of a job.

    A stream gives a run once it has ended or was idle for `idle`, and forgets it; a batch
    frame gives all of them by windows alone.  Rows without a job or time are left out.
    """
    given = events.where(F.col("job_id").isNotNull() & F.col(stamp).isNotNull())
    if events.isStreaming:
        kind = dict(events.dtypes)["job_id"]
        keyed = given.withWatermark(stamp, late).select(F.col("job_id").alias("key"), F.col(stamp).alias("ts"), F.unix_micros(stamp).alias("t"), F.col("event_id").cast("bigint").alias("ord"), F.coalesce("status", F.lit("")).alias("status"))
        told = _fed(keyed, Runs(most_attempts, _micros(idle)), kind)
        return told.select(F.col("key").alias("job_id"), F.timestamp_micros("started").alias("started"), F.timestamp_micros("last").alias("last_ts"), "status", "n_events", "failures", "terminal")
    order = [F.col(stamp), F.col("event_id")]
    before = lambda *by: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    since = W.partitionBy("job_id").orderBy(*order)
    status = F.coalesce("status", F.lit(""))
    gap: Column = F.unix_micros(stamp) - F.lag(F.unix_micros(stamp)).over(since) >= _micros(idle)
    parted = given.withColumns({"status": status, "_gap": gap.cast("int")}).withColumn("_idle", F.coalesce(F.sum("_gap").over(since), F.lit(0)))
    done = F.col("status").isin(*ENDED).cast("int")
    parted = parted.withColumn("_done", F.coalesce(F.sum(done).over(before("job_id", "_idle")), F.lit(0)))
    failed = (F.col("status") == "FAILED").cast("int")
    parted = parted.withColumn("_third", F.floor(F.coalesce(F.sum(failed).over(before("job_id", "_idle", "_done")), F.lit(0)) / most_attempts))
    last = F.max_by("status", F.struct(F.col(stamp), F.col("event_id")))
    runs = parted.groupBy("job_id", "_idle", "_done", "_third").agg(F.min(stamp).alias("started"), F.max(stamp).alias("last_ts"), last.alias("status"), F.count("*").alias("n_events"), F.sum(failed.cast("bigint")).alias("failures"))
    return runs.drop("_idle", "_done", "_third").withColumn("terminal", F.col("status").isin(*ENDED) | (F.col("failures") >= most_attempts))


class JobTable:
    """Jobs in a folder that the cluster shares, one subfolder per batch of a stream.

    A batch is compared with active jobs of earlier batches alone and replaces its own
    subfolder, so a batch that runs again after a failure, in whole or in part, leaves the
    same rows.  `statuses` (job_id, status; the last known one) may tell that jobs have ended.
    """

    schema = "job_id string, path string, sha256 string, status string, batch long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        found = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true")
        try:
            return found.parquet(self.folder)
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def active(self, before: int | None = None, statuses: DataFrame | None = None) -> DataFrame:
        jobs = self.rows() if before is None else self.rows().where(F.col("batch") < before)
        if statuses is not None:
            jobs = jobs.join(statuses.select("job_id", F.col("status").alias("now")), "job_id", "left").withColumn("status", F.coalesce("now", "status")).drop("now")
        return jobs.where(F.col("status").isin(*ACTIVE))

    def ingest(self, batch: DataFrame, batch_id: int, statuses: DataFrame | None = None) -> None:
        """For foreachBatch: one job per path and hash of the batch that is not active already; a blank hash compares the path alone."""
        active = self.active(batch_id, statuses)
        seen = batch.select("path", F.coalesce("sha256", F.lit("")).alias("sha256")).where("path is not null")
        new = skip_active(seen, active)
        made = new.select(F.sha2(F.concat_ws("|", F.lit(str(batch_id)), "path", "sha256"), 256).alias("job_id"), "path", "sha256", F.lit("QUEUED").alias("status"), F.lit(batch_id).cast("bigint").alias("batch"))
        made.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id:012d}")


def skip_active(seen: DataFrame, active: DataFrame) -> DataFrame:
    """Distinct (path, sha256) without an active job: of the path if the hash is blank, else of both; a changed hash is a new job."""
    paths = active.select("path").distinct()
    both = active.select("path", "sha256").distinct()
    rows = seen.select("path", "sha256").distinct()
    blank = rows.where("sha256 = ''").join(paths, "path", "left_anti")
    return rows.where("sha256 <> ''").join(both, ["path", "sha256"], "left_anti").unionByName(blank)
