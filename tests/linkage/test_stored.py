"""Catalog data source, file sink, stored versions, containment joins and pools."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliate.functions import names
from foliate.operators import curate as K
from foliate.operators import editions as E
from foliate.operators import pools as P
from foliate.operators import versions as V
from foliate.sources import connectors as C


@pytest.fixture
def vendor(spark, tmp_path):
    C.register(spark)
    rows = [{"label": f"Series {i % 7}", "no": str(i), "yr": [1990 + i % 30, "n/a", None, " 2001 "][i % 4], "code": "" if i % 5 == 0 else f"v{i}"} for i in range(400)]
    lines = [json.dumps(r) for r in rows] + ["not json", "[1]", "", json.dumps({"label": None}), json.dumps({"label": "Série Ω", "no": 7, "code": 9})]
    (tmp_path / "cat" / "sub").mkdir(parents=True)
    (tmp_path / "cat" / "a.json").write_text("\n".join(lines[:250]), encoding="utf-8")
    (tmp_path / "cat" / "sub" / "b.json").write_text("\n".join(lines[250:]) + "\n", encoding="utf-8")
    (tmp_path / "cat" / "_SUCCESS").write_text("")
    columns = {"series_name": "label", "issue_number": "no", "publication_year": "yr", "issue_id": "code"}
    return lambda split: spark.read.format("vendor_catalog").option("path", str(tmp_path / "cat")).option("provider", "Shop").option("columns", json.dumps(columns)).option("split_bytes", split).load()


def test_catalog_rows_whatever_the_ranges(vendor):
    want = sorted(tuple(r) for r in vendor(1 << 20).collect())
    assert len(want) == 402 and {r[0] for r in want} == {"Shop"}
    for split in (997, 1003, 5000):
        assert sorted(tuple(r) for r in vendor(split).collect()) == want
    assert vendor(1000).rdd.getNumPartitions() > 20
    by = {r["issue_number"]: (r["publication_year"], r["reason"]) for r in vendor(4000).collect()}
    assert by["0"] == (1990, "no id") and by["1"] == (0, "") and by["3"] == (2001, "") and by[""] == (0, "no identity")


def test_filters_reach_the_reader(vendor):
    shown = vendor(4000).where("series_name = 'Series 3' AND issue_number LIKE '1%'")
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # nothing is left to test above the scan
    assert {(r["series_name"], r["issue_number"][0]) for r in shown.collect()} == {("Series 3", "1")}
    kept = vendor(4000).where("series_name IN ('Series 1', 'Série Ω') AND publication_year > 1995")
    assert all(r["publication_year"] > 1995 for r in kept.collect()) and vendor(4000).where("series_name = 'Série Ω'").count() == 1


def test_reports_as_files(spark, tmp_path):
    C.register(spark)
    rows = [(1, "review_A.md", "one"), (2, "review_A.md", "two\nlines é"), (3, "review_B.md", ""), (4, "review_A_2.md", "own"), (5, "review_A.md", None), (6, "no end", "x")]
    unique = C.unique_names(spark.createDataFrame(rows, "file_id int, name string, report string"))
    C.write_reports(unique.repartition(3), str(tmp_path / "out"))
    got = {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "out").iterdir() if p.is_file()}
    assert got == {"review_A.md": "one", "review_A_2.md": "own", "review_A_2_2.md": "two\nlines é", "review_A_3.md": "", "review_B.md": "", "no end": "x"}
    assert [p for p in (tmp_path / "out").iterdir() if p.is_dir()] == []


def test_reports_are_read_in_few_tasks(spark, tmp_path):
    C.register(spark)
    made = spark.range(3000).select(F.concat(F.lit("é "), "id", F.lit(".md")).alias("name"), F.concat(F.lit("a\r\nb "), "id").alias("report"))
    C.write_reports(made, str(tmp_path))
    (tmp_path / ".staged").mkdir()
    back = C.read_reports(spark, str(tmp_path))
    assert sorted(back.collect()) == sorted(made.collect())
    assert back.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism  # not one for every few files


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    C.register(spark)

    def broken(batches):
        for b in batches:
            yield b
            if (b["file_id"] == 7).any():
                raise RuntimeError("lost")

    rows = [(i, f"{i}.md", "text") for i in range(8)]
    df = spark.createDataFrame(rows, "file_id int, name string, report string").repartition(4).mapInPandas(broken, "file_id int, name string, report string")
    with pytest.raises(Exception, match="lost"):
        C.write_reports(df, str(tmp_path / "out"))
    assert list((tmp_path / "out").rglob("*.md")) == []
    with pytest.raises(Exception, match="twice"):
        C.write_reports(spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "file_id int, name string, report string").repartition(2, "file_id"), str(tmp_path / "two"))
    assert not (tmp_path / "two").exists() or [p for p in (tmp_path / "two").rglob("*") if p.is_file()] == []


def test_log_lines(spark, tmp_path):
    C.register(spark)
    fields = "job_id string, archive string, sha256 string, provider string, provider_id string, confidence double, status string, duration_ms double, error_code string, error_message string"
    full = ("j1", "/a b.cbz", "0123456789abcdef", "CV", "4000-1", 82.5, "FAILED", 1499.5, "E", 'it\'s "x"\n\\')
    df = spark.createDataFrame([full, ("j2", None, "", None, None, 0.0, None, None, None, "it's")], fields)
    lines = [r[0] for r in df.select(C.event_line()).collect()]
    assert lines[0] == "job=j1 archive=/a b.cbz sha256=0123456789ab… provider=CV issue=4000-1 confidence=82 status=FAILED duration=1500ms error_code=E error='it\\'s \"x\"\\n\\\\'"
    assert lines[1] == 'job=j2 error="it\'s"'
    assert json.loads(df.select(C.event_json()).collect()[1][0]) == {"job_id": "j2", "archive": "", "sha256": "", "provider": "", "provider_id": "", "confidence": 0.0, "status": "", "duration_ms": 0.0, "error_code": "", "error_message": "it's"}
    for _ in range(2):  # logs of two jobs stand side by side
        C.write_log(df.select(C.event_line().alias("line")).repartition(2), str(tmp_path / "log"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "log")).collect()) == sorted(lines * 2)


def test_records_as_json(spark):
    given = [('{"title": "T", "count": 0, "year": null, "writers": [" A ", "", "B"], "characters": "x, ,y", "language": "fr", "provider": "CV"}',), ("{}",), ("no json",), (None,)]
    r = [x["r"] for x in spark.createDataFrame(given, "d string").select(C.record_from_json(F.col("d")).alias("r")).collect()]
    assert (r[0]["title"], r[0]["count"], r[0]["year"], r[0]["writers"], r[0]["characters"], r[0]["language"], r[0]["provider_name"]) == ("T", 1, 0, ["A", "B"], ["x", "y"], "fr", "CV")
    assert all((x["title"], x["count"], x["language"], x["format"], x["writers"], x["provider_name"]) == ("", 1, "en", "Comic", [], "") for x in r[1:])


def test_an_upsert_rewrites_its_buckets_alone(spark, tmp_path):
    table = V.Versions(str(tmp_path / "t"), ("k",), 16)
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.col("id").alias("at"))
    merge = V.newest(("k",), F.desc("at"))
    assert table.version(spark) == -1 and table.upsert(rows.limit(0), merge) == -1
    assert table.read(spark, rows.schema).count() == 0
    assert table.upsert(rows.union(rows.selectExpr("k", "'older' AS v", "at - 5 AS at")), merge) == 0
    before = set(table.read(spark, rows.schema).inputFiles())
    assert len(before) == 16
    new = spark.createDataFrame([(k, "new", 9) for k in (3, 4, 5000)], rows.schema)
    touched = {r["b"] for r in new.select(table.bucket().alias("b")).collect()}
    assert table.upsert(new, merge) == 1
    after = table.read(spark, rows.schema)
    changed = {int(f.split("_bucket=")[1].split("/")[0]) for f in set(after.inputFiles()) - before}
    assert changed == touched and len(before & set(after.inputFiles())) == 16 - len(touched)
    got = {r["k"]: r["v"] for r in after.collect()}
    assert len(got) == 2001 and {k for k, v in got.items() if v == "new"} == {3, 4, 5000} and "older" not in got.values()
    assert table.read(spark, rows.schema, version=0).count() == 2000  # readers of the version before
    assert table.upsert(new, lambda old, fresh: old.join(fresh.select("k"), "k", "left_anti").select("k", "v", "at")) == 2  # a merge may delete
    assert table.read(spark, rows.schema).count() == 1998
    assert [n.partition("-")[0] for n in table.vacuum(spark, keep=1)] == ["00000001"] and table.read(spark, rows.schema).count() == 1998


def test_a_table_may_become_empty(spark, tmp_path):
    table = V.Versions(str(tmp_path / "t"), ("k",), 4)
    row = spark.createDataFrame([(1, "a")], "k long, v string")
    table.upsert(row, V.newest(("k",)))
    assert table.upsert(row, lambda old, new: old.where("false")) == 1 and table.read(spark, row.schema).count() == 0
    assert table.upsert(row, V.newest(("k",))) == 2 and table.read(spark, row.schema).count() == 1


def test_two_writers_of_one_version(spark, tmp_path):
    table = V.Versions(str(tmp_path / "t"), ("k",), 4)
    row = spark.createDataFrame([(1, "a")], "k long, v string")
    table.upsert(row, V.newest(("k",)))

    def slow(old, new):
        table.upsert(row.withColumn("v", F.lit("first")), V.newest(("k",)))  # another writer is done first
        return V.newest(("k",))(old, new)

    with pytest.raises(Exception, match="(?i)already exists"):
        table.upsert(row, slow)
    assert table.version(spark) == 1 and [r["v"] for r in table.read(spark, row.schema).collect()] == ["first"]


def test_containment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + [None, "ünïcode é", "aaaa"] * 2
    queries = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 6))) for _ in range(150)] + [None, "é", "", "  ", "ïco", "zzz", "aaaaa"]
    t, q = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in queries], "query string")
    want = {(a, b) for a in texts for b in queries if a is not None and b is not None and b.strip(" ") and b in a}
    for part in (50_000, 3):
        monkeypatch.setattr(P, "PART", part)
        got = [tuple(r) for r in P.holding(t, q).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_searches_of_a_table(spark):
    issues = spark.createDataFrame([(1, "Dark Sky", "7"), (2, "", "17"), (3, None, None), (4, "Issue of #7", "3")], "issue_id int, title string, number string")
    got = {(r["query"], r["issue_id"], r["shown"]) for r in P.search_many(issues, spark.createDataFrame([(" #7 ",), ("ISSUE 1",), ("sky",), ("",)], "query string")).collect()}
    assert got == {("#7", 1, "Dark Sky"), ("#7", 4, "Issue of #7"), ("issue 1", 2, "Issue #17"), ("sky", 1, "Dark Sky")}


def test_pools_find_the_true_rows(spark):
    paths = [(i, f"/lib/Dark Sky {i % 9}/Dark Sky {i % 9} #{i:03d} ({1990 + i % 5}).cbz") for i in range(300)] + [(1000, "/lib/Moon (1999)/Moon.cbz"), (1001, "/lib/x/.cbz")]
    files = names.parse_filename(spark.createDataFrame(paths, "file_id int, path string"))
    rows = [(p, f"id{i}", "", f"The Dark Sky {i % 9}" + (" Beyond" if i % 10 == 0 else ""), str(i), 1990 + i % 5, "", "") for p in ("CV", "GCD") for i in range(300)]
    rows += [("CV", f"m{i}", "", "Moon", str(i + 1), 1990 + i % 20, "", "") for i in range(500)] + [("CV", "blank", "", "Dark Sky 1", "", 0, "", ""), ("CV", "none", "", "", "1", 0, "", "")]
    catalog = spark.createDataFrame(rows, "provider string, issue_id string, series_id string, series_name string, issue_number string, publication_year int, publisher string, volume string")
    got = P.pools(files, catalog, best=3).collect()
    held = {(r["file_id"], r["provider"], r["issue_id"]) for r in got}
    assert all((i, p, f"id{i}") in held for i in range(1, 300) for p in ("CV", "GCD"))
    assert [r["publication_year"] for r in sorted(got, key=lambda r: r["pool_pos"]) if r["file_id"] == 1000] == [1999] * 3
    assert max(sum(r["file_id"] == i for r in got) for i in range(300)) <= 6 and not any(r["file_id"] == 1001 for r in got)
    assert any(r["issue_id"] == "blank" for r in got if r["file_id"] == 10)


def test_modules_are_registered():
    from foliate.plans import registry

    assert {"T3_settled_files", "J1_catalog_pools", "M1_stored_cache", "P2_search_table"} <= set(registry.QUERIES) & set(registry.ORACLES)
    assert Path(C.local_path("file:/a%20b")) == Path("/a b")


def test_classes_of_editions_equal_pairs_of_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["", "", "Dark Sky", "Moon"]), rng.choice(["1", "1", "2", "1A", "Annual", ""]), rng.choice(["", "2"]), rng.choice([0, -1, 1999, 2000, 2001, 2005])) for i in range(160)] + [(500, "Moon", None, "", None)]
    df = K.canonical_key(spark.createDataFrame(rows, "id int, series_name string, issue_number string, volume string, publication_year int").withColumn("publisher", F.lit("")))
    a, b = df.where("id % 2 = 0"), df.where("id % 3 <> 0")
    pairs = E.match_classes(a, b)
    want = {tuple(r) for r in K.match_keys(a, b, "id", "id").collect()}
    got = [tuple(r) for r in E.expand(pairs, E.members(a, "id"), E.members(b, "id")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    counts = {r["row_id"]: r["n_matches"] for r in E.matches(pairs, E.members(a, "id")).collect()}
    assert counts == {i: sum(x == i for x, _ in want) for i in {x for x, _ in want}}


def test_rows_without_series_do_not_multiply(spark):
    rows = spark.range(30_000).selectExpr("id", "IF(id % 3 = 0, '', concat('S', id % 500)) AS series_name", "IF(id % 3 = 0, '1', string(id % 7)) AS issue_number", "'' AS volume", "int(1990 + id % 10) AS publication_year", "'' AS publisher")
    keyed = K.canonical_key(rows)
    pairs = E.match_classes(keyed, keyed)
    n = pairs.count()
    told = E.matches(pairs, E.members(keyed, "id")).agg(F.count("*"), F.sum("n_matches")).first()
    assert n < 200_000 and told[0] == 30_000 and told[1] > 20_000_000


def test_a_record_is_parsed_once_whatever_is_taken_out_of_it(spark):
    rows = spark.createDataFrame([('{"title": "A", "number": "1", "writers": "Ann, ,Bob"}',), ("no json",)], "data string")
    out = rows.select(C.record_from_json(F.col("data")).alias("r")).select("r.*")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField") == 1
    got = out.select("title", "number", "count", "language", "writers").collect()
    assert [tuple(r) for r in got] == [("A", "1", 1, "en", ["Ann", "Bob"]), ("", "", 1, "en", [])]


def test_a_file_meets_few_rows_of_a_title_with_many_years(spark):
    rng = random.Random(5)
    rows = [("CV", f"i{k:03}", "", "Dark Sky", rng.choice(["1", "", "2"]), rng.choice([0, *range(1940, 1990)]), "", "") for k in range(400)]
    rows += [("GCD", f"g{k:03}", "", rng.choice(["Dark Sky", "Dark Sky Omnibus"]), "1", rng.choice([0, 1950, 1951, 1980, 9999]), "", "") for k in range(12)]
    columns = ["provider", "issue_id", "series_id", "series_name", "issue_number", "publication_year", "publisher", "volume"]
    catalog = spark.createDataFrame(rows, ", ".join(f"{x} {'int' if x == 'publication_year' else 'string'}" for x in columns))
    asked = [(k, "Dark Sky", rng.choice(["1", "2", "3", ""]), year) for k, year in enumerate([0, 1930, 2030, *range(1940, 1990, 3)])]
    files = spark.createDataFrame(asked, "file_id long, series_name string, issue_number string, year int")
    want = set()
    for file_id, f, fn, fy in asked:
        place = 0
        for provider in ("CV", "GCD"):
            met = [r for r in rows if r[0] == provider and (fn == "" or r[4] in ("", fn))]
            met.sort(key=lambda r: (r[3] != f, r[4] != fn, abs(fy - r[5]) if fy > 0 and r[5] > 0 else 1000, r[1]))
            for r in met[:5]:
                place += 1
                want.add((file_id, place, r[1]))
    assert {tuple(r) for r in P.pools(files, catalog).select("file_id", "pool_pos", "issue_id").collect()} == want
    forms = catalog.where("provider = 'CV' AND issue_number = '1'").select("*", F.lower("series_name").alias("t"), F.col("issue_number").alias("tn"), F.lit("dark sky").alias("f"), F.lit("1").alias("fn"))
    inner = P._near(forms, ["issue_id"], 5).where("_above is not null AND _below is not null")
    assert inner.count() > 50 and inner.agg(F.max(F.col("_above") - F.col("_below"))).first()[0] < 20  # of 50 years
