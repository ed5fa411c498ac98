"""Settling files, runs of jobs and job tables: streams against their batch twins, batches that run twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliate.streaming import stateful as U

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def streamed(spark, tmp_path, batches, schema, build, name):
    """The rows that a stream over the given batches, one file each, has told, and the rows left in its state."""
    U.use_state_store(spark)
    folder, left = tmp_path / "in", []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = build(spark.readStream.schema(schema).parquet(str(folder)))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}, left


FILES = "path string, ts timestamp, event_type string, size long, event_id long"


def files():
    busy = [("/busy", at(2 * i), "modified", i, i) for i in range(300)]  # ten hours without a quiet moment
    calm = [("/calm", at(0), "created", 1, 900), ("/calm", at(3), "modified", 7, 901), ("/calm", at(30), "modified", 8, 902)]
    gone = [("/gone", at(1), "created", 1, 910), ("/gone", at(4), "deleted", 1, 911), ("/late", at(200), "created", 5, 920)]
    odd = [(None, at(5), "created", 1, 930), ("/odd", None, "created", 1, 931), ("/odd", at(5), None, None, 932), ("/odd", at(5), "modified", 3, 933)]
    return busy, calm, gone, odd


def test_a_busy_path_is_told_at_max_wait_and_again(spark):
    rows = [r for part in files() for r in part]
    got = U.settled_files(spark.createDataFrame(rows, FILES), order="event_id").orderBy("path", "started").collect()
    busy = [r for r in got if r["path"] == "/busy"]
    assert all(r["told_at"] - r["started"] <= dt.timedelta(minutes=10) for r in got)
    assert len(busy) == 60 and not any(r["stable"] for r in busy[:-1])
    assert [(r["path"], r["size"], r["n_events"], r["stable"]) for r in got if r["path"] != "/busy"] == [("/calm", 7, 2, True), ("/calm", 8, 1, True), ("/late", 5, 1, True), ("/odd", 3, 2, True)]
    assert U.settled_files(spark.createDataFrame([], FILES)).count() == 0


def test_the_stream_tells_what_its_batch_twin_tells(spark, tmp_path):
    busy, calm, gone, odd = files()
    mixed = [busy[1], busy[0], *busy[2:100], *calm[:2], *gone[:2], *odd]  # busy[0] out of order within the watermark
    batches = [mixed, [*busy[100:250], calm[2], gone[2]], [*busy[250:], ("/end", at(5000), "created", 1, 990)]]
    build = lambda e: U.settled_files(e, order="event_id")
    got, left = streamed(spark, tmp_path, [batches[0], batches[1], batches[2]], spark.createDataFrame([], FILES).schema, build, "settled")
    kept = [r for b in batches for r in b if r not in (calm[2],)]  # behind the watermark of the first batch: dropped
    want = {tuple(r) for r in build(spark.createDataFrame(kept, FILES)).where("path <> '/end'").collect()}
    assert got == want
    assert max(left) <= 60  # open entries and the events of ten minutes, whatever has gone by


JOBS = "event_id long, job_id long, status string, ts timestamp"


@pytest.fixture
def jobs():
    one = [(1, 1, "FAILED", at(0)), (2, 1, "FAILED", at(1)), (3, 1, "FAILED", at(2)), (4, 1, "QUEUED", at(3)), (5, 1, "SUCCESS", at(4))]
    idle = [(6, 2, "FAILED", at(0)), (7, 2, "FAILED", at(2000)), (8, 2, "FAILED", at(2001)), (9, 2, "COMPLETED", at(2001))]
    return one + idle + [(10, 3, "QUEUED", at(0)), (11, None, "QUEUED", at(0)), (12, 4, None, at(1)), (13, 4, "SUCCESS", at(1))]


def test_runs_of_jobs(spark, jobs):
    got = sorted(tuple(r)[:1] + tuple(r)[3:] for r in U.job_runs(spark.createDataFrame(jobs, JOBS)).collect())
    assert got == [(1, "FAILED", 3, 3, True), (1, "SUCCESS", 2, 0, True), (2, "COMPLETED", 3, 2, True), (2, "FAILED", 1, 1, False), (3, "QUEUED", 1, 0, False), (4, "SUCCESS", 2, 0, True)]


def test_ended_jobs_leave_the_state(spark, jobs, tmp_path):
    many = [[(100 + 2 * (b * 1500 + i) + k, 1000 + b * 1500 + i, ["PROCESSING", "SUCCESS"][k], at(3000 + 60 * b + k)) for i in range(1500) for k in (0, 1)] for b in range(3)]
    batches = [jobs, *many, [(99_999, 77, "QUEUED", at(90_000))]]
    got, left = streamed(spark, tmp_path, batches, spark.createDataFrame([], JOBS).schema, U.job_runs, "runs")
    want = {tuple(r) for r in U.job_runs(spark.createDataFrame([r for b in batches for r in b], JOBS)).where("job_id <> 77").collect()}
    assert got == want and len(got) > 4500
    assert max(left) < 1500 * 4 and left[-1] < 10  # the last batch's jobs, not all that ever were


def test_a_batch_that_runs_twice_adds_nothing(spark, tmp_path):
    table = U.JobTable(spark, str(tmp_path / "jobs"))
    schema = "path string, sha256 string"
    first = spark.createDataFrame([("/a", "h1"), ("/a", "h1"), ("/b", ""), (None, "x"), ("/c", None)], schema)
    second = spark.createDataFrame([("/a", "h1"), ("/a", "h2"), ("/b", ""), ("/b", "h"), ("/d", "")], schema)
    table.ingest(first, 0)
    table.ingest(second, 1)
    want = sorted(tuple(r) for r in table.rows().collect())
    assert [(r[1], r[2], r[4]) for r in sorted(want, key=lambda r: (r[4], r[1], r[2]))] == [("/a", "h1", 0), ("/b", "", 0), ("/c", "", 0), ("/a", "h2", 1), ("/b", "h", 1), ("/d", "", 1)]
    table.ingest(second, 1)
    table.ingest(first, 0)  # an older batch once more, now behind a later one
    assert sorted(tuple(r) for r in table.rows().collect()) == want
    ended = spark.createDataFrame([(r[0], "COMPLETED") for r in want if r[1] == "/a" and r[2] == "h1"], "job_id string, status string")
    table.ingest(first, 2, ended)
    assert [(r["path"], r["sha256"]) for r in table.rows().where("batch = 2").collect()] == [("/a", "h1")]


def test_a_stream_feeds_the_job_table(spark, tmp_path):
    table = U.JobTable(spark, str(tmp_path / "jobs"))
    schema = "path string, sha256 string"
    for k in range(3):
        spark.createDataFrame([(f"/{i}", "h") for i in range(k, k + 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(lambda b, n: table.ingest(b, n)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["path"] for r in table.rows().collect()) == ["/0", "/1", "/2", "/3", "/4"]
    assert table.rows().groupBy("batch").count().count() == 3
    assert table.active().where(F.col("batch") == 2).first()["path"] == "/4"
