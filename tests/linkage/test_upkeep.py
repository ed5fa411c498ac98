import math
from functools import reduce
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliate.functions import text as T
from foliate.operators import arcs as R
from foliate.operators import curate as K
from foliate.operators import metrics as X
from foliate.plans.datasets import derive
from foliate.sources import archives as A
from foliate.sources import catalogs as B
from foliate.sources.tables import discard, written

MEMBER = "collection_id long, pos int, series_name string, publisher string, issue_number string, title string, year int, month int, day int, web string, summary string, notes string, provider_id string, genre string, language string, " + ", ".join(f"{c} string" for c in K.LISTS)


def member(group, pos, number, **more):
    lists = [more.get(c, "") for c in K.LISTS]
    return (group, pos, "Tin Fox", "", number, more.get("title", ""), more.get("year", 0), more.get("month", 0), 0, "", more.get("summary", ""), "", "", "", more.get("language", ""), *lists)


def test_merges_unite_lists_and_leave_one_issue_as_it_is(spark):
    rows = [
        member(1, 1, "2", title="A", writers="Ann; ann;", teams="Six"), member(1, 2, "1", title="B", writers="Bo;Ann", summary="s"),
        member(2, 1, "7", title="Own", month=3, summary="as it was", writers="Ann;Ann"), member(3, 1, "x", language="fr"), member(3, 2, ""),
    ]
    got = {r["collection_id"]: r for r in K.merge_issues(spark.createDataFrame(rows, MEMBER)).collect()}
    assert (got[1]["writers"], got[1]["teams"], got[1]["number"], got[1]["title"], got[1]["format"]) == ("Ann; ann;Bo", "Six", "1-2", "Tin Fox #1-2", "Trade Paperback")
    assert (got[2]["title"], got[2]["number"], got[2]["month"], got[2]["summary"], got[2]["writers"], got[2]["format"]) == ("Own", "7", 3, "as it was", "Ann;Ann", "")
    loose = {r["collection_id"]: r for r in K.merge_issues(spark.createDataFrame(rows, MEMBER), policy=True).collect()}
    assert loose[1]["writers"] == "Ann;Bo" and loose[1]["language"] == "en" and loose[3]["language"] == "fr" and "writers=issue_union_dedup" in loose[2]["provenance"]


@pytest.mark.parametrize("path,reason", [("/lib/a.cbz", ""), ("/lib/a.CBR", ""), ("/lib", "extension"), ("/library/a.cbz", "outside roots"), ("/lib/../etc/a.cbz", "outside roots"), ("/etc/a.cbz", "system folder"), ("/etcetera/a.cbz", "outside roots"), (None, "empty")])
def test_quarantine(spark, path, reason):
    assert K.quarantine_paths(spark.createDataFrame([(path,)], "path string"), ["/lib"]).first()["reason"] == reason


def test_cache_keys_and_payloads(spark):
    rows = [("ComicVine", "issue", " Tin Fox", '[{"series_name": "T"}]', 1), ("Kapowarr", "issue", "tin fox", '[{"title": "no series"}]', 2), ("Kapowarr", "issue", "ash", "broken", 3)]
    cache = spark.createDataFrame(rows, "provider string, kind string, cache_key string, data_json string, updated_at long").withColumns({"expires_at": F.lit(9), "schema_version": F.lit("2")})
    asked = spark.createDataFrame([("issue", "TIN FOX "), ("issue", "ash")], "kind string, cache_key string")
    got = {r["cache_key"]: r["hit_provider"] for r in K.cache_lookup(asked, cache, 5, "2").collect()}
    assert got == {"TIN FOX ": "ComicVine", "ash": None}


def test_latest_does_not_depend_on_the_order_of_rows(spark):
    rows = [("/a", 5, x) for x in "qwertz"]
    df = spark.createDataFrame(rows, "path string, updated_at long, status string")
    assert len({K.latest(df.repartition(n, "status"), ["path"], "updated_at").first()["status"] for n in (1, 3, 5)}) == 1


def test_wide_ranges_and_reading_files(spark):
    lines = spark.createDataFrame([(1, "Tin Fox #1-25001"), (2, "The Of #3"), (3, "Tin Fox 2 #04A")], "line_id long, line string")
    got = R.expand_ranges(lines)
    assert got.where("line_id = 1").agg(F.count("*"), F.max("at"), F.min(F.col("number").cast("int")), F.max(F.col("number").cast("int"))).first()[:] == (25001, 25000, 1, 25001)
    entries = spark.createDataFrame([("Tin Fox", "7"), ("Tin Fox", "007"), ("Fox!", "1/2"), ("Tin Fox 2", "4A"), ("the of", "3"), ("Nowhere", "1")], "series string, number string")
    files = spark.createDataFrame([("/lib/Tin Fox (1987)/Tin Fox #07.cbz",), ("/lib/Tin Fox v2/Tin Fox v2 #4A.cbz",), ("/lib/a/Fox! ½.cbz",), ("/lib/Foxtin/x issue 7.cbr",)], "path string")
    hits = {(r["series"], r["number"]): r["path"] for r in R.reading_files(entries, files).collect()}
    want = {}
    pairs = entries.crossJoin(files).withColumns({"ef": R.path_form(F.col("series")), "pf": R.path_form(F.col("path"))})  # a few rows
    keys = F.arrays_overlap(R.number_keys(F.col("number")), R.name_keys(F.element_at(F.split("path", "/"), -1)))
    for r in pairs.where(R.series_in_path(F.col("ef"), F.col("pf")) & keys).collect():
        k = (r["series"], r["number"])
        want[k] = min(want.get(k, r["path"]), r["path"])
    assert hits == want and len(hits) >= 3


def test_extra_fields_survive_a_round_trip(spark):
    xml = "<ComicInfo><Title>A</Title><Score note='1'>5 &lt; 6 &amp;amp;</Score><Nested><X>1</X></Nested><Blank></Blank></ComicInfo>"
    rows = spark.createDataFrame([(1, xml), (2, None), (3, "<ComicInfo><Title>")], "id long, record string")
    once = A.parse_record(rows)
    again = {r["id"]: r for r in A.parse_record(A.write_record(once.drop("record", "malformed"))).collect()}
    assert again[1]["title"] == "A" and again[1]["extras"] == {"Score": "5 < 6 &amp;", "X": "1"} and again[2]["extras"] == {}
    assert {r["id"]: r["malformed"] for r in once.collect()} == {1: False, 2: False, 3: True}


def test_catalogs_and_searches(spark):
    rows = spark.createDataFrame([("a", "Tin Fox", "x"), ("", "Ash", "1999"), ("b", None, "2")], "code string, label string, yr string")
    catalog = B.as_catalog(rows, "Vendor", {"series_name": "label", "issue_id": "code", "publication_year": "yr"})
    got = {r["issue_id"]: (r["series_name"], r["publication_year"], r["reason"]) for r in catalog.collect()}
    assert got == {"a": ("Tin Fox", 0, ""), "": ("Ash", 1999, "no id"), "b": ("", 2, "no identity")}
    assert B.search(catalog, " FOX ").count() == 1 and B.search(catalog, "  ").count() == 0
    assert B.lookup(catalog, spark.createDataFrame([("a",), ("",)], "issue_id string")).count() == 1
    with pytest.raises(ValueError):
        B.federated_search({}, "cv_issue")


def test_discarded_tables_are_gone_and_others_stay(spark, tmp_path):
    df = spark.range(3)
    kept, gone = written(df, "kept"), written(df, "gone")
    own = tmp_path / "own"
    df.write.parquet(str(own))
    folder = Path(gone.inputFiles()[0].removeprefix("file:")).parent
    discard(gone, spark.read.parquet(str(own)))
    assert not folder.exists() and kept.count() == 3 and own.exists()


def test_hashes_ignore_the_order_of_columns(spark):
    df = spark.createDataFrame([("x", 1), ("y", 1), ("x", None)], "a string, b int")
    one = [r[0] for r in df.select(T.content_hash({"a": F.col("a"), "b": F.col("b")})).collect()]
    two = [r[0] for r in df.select(T.content_hash({"b": F.col("b"), "a": F.col("a")})).collect()]
    assert one == two and len(set(one)) == 3


def test_average_durations_round_halves_as_written(spark):
    rows = spark.createDataFrame([(1, "SUCCESS", v) for v in (16.66, 58.05, 30.27, 80.82)] + [(2, "FAILED", float("nan")), (3, "FAILED", None), (4, "FAILED", 1e300)], "job_id long, status string, value double").coalesce(1)
    got = {r["job_id"]: r["avg_duration"] for r in X.job_outcomes(rows, ["job_id"]).collect()}
    assert (got[1], got[3], got[4]) == (46.5, 0.0, 1e300) and got[2] != got[2]  # as doubles the first is 46.449999999999996


def test_average_durations_in_an_order_are_those_of_doubles(spark):
    """At halves doubles decide, and so does the order in which they are added."""
    values = [16.66, 58.05, 30.27, 80.82]
    orders = {i: list(o) for i, o in enumerate(permutations(values))}
    orders |= {None: [0.05, 0.05], 100: [1.0, None, 0.5], 101: [float("nan"), 1.0], 102: [None], 103: [1e300, 1e300], 104: [0.14999995, 0.15000004], 105: [-41.75, -41.75]}
    rows = [(100 * (g or 0) + i, g, "SUCCESS", v) for g, o in orders.items() for i, v in enumerate(o)]

    def rounded(o):
        told = [v for v in o if v is not None]
        x = (added := reduce(lambda a, v: a + v, told, 0.0)) / max(len(told), 1)
        return added if x != x else math.copysign(math.floor(abs(x) * 10 + 0.5) / 10, x)  # all are small or whole

    want = {g: rounded(o) for g, o in orders.items()}
    assert {want[i] for i in range(24)} == {46.4, 46.5}  # the exact average is 46.45
    for n in (1, 3):
        df = spark.createDataFrame(rows[::-1], "event_id long, job_id long, status string, value double").repartition(n, "value")
        got = {r["job_id"]: (r["avg_duration"], r["total"]) for r in X.job_outcomes(df, ["job_id"], order="event_id").collect()}
        assert got.pop(101)[0] != want[101] and {g: (x, len(orders[g])) for g, x in want.items() if g != 101} == got


def test_what_is_made_of_small_tables_is_spread(spark):
    pages = derive(spark, "/root/testdata/sf0.001", "order_pages")
    assert pages.groupBy(F.spark_partition_id()).count().count() > 4
    assert pages.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
