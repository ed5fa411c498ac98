import datetime as dt
import io
import subprocess
import sys
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from foliate.sources import archives as A
from foliate.sources import pages as G
from foliate.streaming import events as E

XML = "<ComicInfo><Title>T</Title><Series>S</Series><Number>01</Number><Year>2016</Year><Month>x</Month><Day>3</Day><Count>bad</Count><Writer>A; B;</Writer><StoryArc>One, Two</StoryArc><StoryArc>Three</StoryArc></ComicInfo>"


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, data in files.items():
            z.writestr(n.replace("_", "."), data)
    return out.getvalue()


def test_library(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.cbz").write_bytes(archive(ComicInfo_xml=XML, Page1_JPG="data"))
    (tmp_path / "sub" / "b.CBZ").write_bytes(b"no archive")
    (tmp_path / "c.txt").write_text("x")
    files = A.scan_library(spark, [str(tmp_path), str(tmp_path / "sub")])
    assert sorted(Path(r["path"]).name for r in files.select("path").collect()) == ["a.cbz", "b.CBZ"]
    assert {r["archive_type"] for r in A.fingerprint(files).collect()} == {"cbz"}
    entries = A.read_entries(files).collect()
    assert {r["entry"] for r in entries} == {"comicinfo.xml", "page1.jpg", None} and sum(r["error"] is not None for r in entries) == 1


def test_record(spark):
    rows = spark.createDataFrame([(1, XML), (2, "<ComicInfo><UnclosedTag>broken xml"), (3, None)], "id int, record string")
    got = {r["id"]: r for r in A.parse_record(rows).collect()}
    r = got[1]
    assert (r["title"], r["number"], r["year"], r["month"], r["day"], r["count"]) == ("T", "01", 2016, 0, 0, 1)
    assert r["writers"] == ["A", "B"] and r["story_arcs"] == ["One", "Two", "Three"]
    assert got[2]["malformed"] and not got[1]["malformed"] and not got[3]["malformed"]
    xml = A.write_record(A.parse_record(rows.where("id = 1")), "out").first()["out"]
    assert "<Writer>A; B</Writer>" in xml and "<StoryArc>One, Two, Three</StoryArc>" in xml and "<Month>" not in xml


def test_pages(spark):
    html = """<title>x</title><h1>Batman <a href="/s/4000-9/">#1</a></h1><ul class="wiki-details-object"><li>Creators</li><li>Writer: <a href="/p/1">Ann Lee</a></li><li>Cover artist: <a href="/p/2">B. Ek</a></li>
      <li>2016 (12 issues) <a href="/batman/4050-1/">Batman</a></li><li><a href="/e">edit</a></li></ul>"""
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    parts = G.page_parts(pages)
    assert G.page_titles(parts).first()["title"] == "Batman #1"
    found = G.links(parts)
    assert sorted((r["role"], r["name"]) for r in G.creators(G.issue_page_texts(pages)).collect()) == [("pencillers", "B. Ek"), ("writers", "Ann Lee")]
    r = G.search_results(found).where("kind = 'Volume'").first()
    assert (r["name"], r["year"], r["n_issues"]) == ("Batman", 2016, 12)


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    rows = [("/a.cbz", "", "created", at(0), 1), ("/a.cbz", "", "modified", at(2), 5), ("/a.cbz", "", "modified", at(4), 5), ("/a.cbz", "", "deleted", at(60), 0), ("/b.cbz", "/c.cbz", "moved", at(1), 3), ("/x.txt", "", "created", at(1), 3), ("/z.cbz", "", "created", at(400), 1)]
    return spark.createDataFrame(rows, "path string, dest_path string, event_type string, ts timestamp, size long")


def pipeline(e):
    return E.still_there(E.debounce(E.split_moves(E.only_archives(e))))


def test_stream_equals_its_batch_twin(spark, tmp_path):
    e = events(spark)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pipeline(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("bursts").collect()}
    want = {tuple(r) for r in pipeline(e).where("path <> '/z.cbz'").collect()}  # its session is still open
    assert got == want and {r[0] for r in got} == {"/a.cbz", "/c.cbz"}
    assert [r for r in got if r[0] == "/a.cbz"][0][6] is True


def test_an_event_after_the_whole_delay_begins_a_new_burst(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("/a.cbz", "created", t0 + dt.timedelta(minutes=m), s) for m, s in ((0, 1), (5, 2), (9, 2))]
    got = E.debounce(spark.createDataFrame(rows, "path string, event_type string, ts timestamp, size long"), "5 minutes").orderBy("started").collect()
    assert [(r["n_events"], r["stable"]) for r in got] == [(1, False), (2, True)]


def test_the_greatest_type_ends_a_burst_whose_last_events_are_at_once(spark):
    t0 = dt.datetime(2024, 1, 1)
    for types in (["created", "deleted"], ["deleted", "created"]):
        rows = [("/a.cbz", t, t0, 1) for t in types]
        e = spark.createDataFrame(rows, "path string, event_type string, ts timestamp, size long").coalesce(1)
        assert E.debounce(e).first()["last_type"] == "deleted"


def test_a_restart_repeats_nothing(spark, tmp_path):
    e = events(spark).withColumn("event_id", F.monotonically_increasing_id())
    schema = e.schema

    def run():
        stream = E.only_archives(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).select("event_id", "path")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema("event_id long, path string").parquet(str(tmp_path / "out"))

    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run().count() == 6
    e.limit(1).withColumn("event_id", F.lit(99).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = run()
    assert done.count() == 7 and done.distinct().count() == 7
    assert E.not_yet_done(e.union(e.limit(1).withColumn("event_id", F.lit(100).cast("long"))), done).count() == 2  # the text file's event and the new one


def test_known_files_and_lifecycle(spark):
    known = spark.createDataFrame([("/a", 1, 2, "h")], "path string, size long, mtime long, sha256 string")
    seen = spark.createDataFrame([("/a", 1, 2, "h"), ("/a", 1, 3, "h")], known.schema)
    assert E.without_known(seen, known).count() == 1
    jobs = spark.createDataFrame([(1, 1, "FAILED", 1), (2, 1, "FAILED", 2), (3, 1, "FAILED", 3), (4, 2, "SUCCESS", 1)], "event_id long, job_id long, status string, ts long")
    got = {r["job_id"]: (r["failures"], r["terminal"]) for r in E.lifecycle(jobs).collect()}
    assert got == {1: (3, True), 2: (0, True)}
    assert E.windowed_outcomes(jobs.withColumns({"ts": F.timestamp_seconds("ts"), "value": F.lit(1.0)})).first()["failed"] == 3


def test_entry_works_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for p in ("__spark_entry__.py", "foliate"):
        (tmp_path / p).symlink_to(root / p) if p.endswith(".py") else None
    (tmp_path / "foliate").mkdir()
    for p in (root / "foliate").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "foliate" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert e.__file__.startswith(%r); q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)" % str(tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
