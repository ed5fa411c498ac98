"""Work that grew faster than the tables: what is tested is where a plan does it, and that rows stay the same."""

import random

from pyspark.sql import functions as F

from foliate.functions import names
from foliate.operators import arcs as R
from foliate.operators import curate as K
from foliate.plans import resolve as V
from foliate.plans.datasets import derive
from foliate.plans.queries import QUERIES
from foliate.sources import archives as A


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_derived_texts_stay_above_the_exchange(spark, tmp_path):
    part = spark.range(40).selectExpr("id AS p_partkey", "'Dark Sky' AS p_name", "'B' AS p_brand", "'T' AS p_type", "int(id % 9) AS p_size", "1.0D AS p_retailprice")
    part.write.parquet(str(tmp_path / "part.parquet"))
    read = derive(spark, str(tmp_path), "reading").where(F.lower("line").contains("special"))
    above, below = optimized(read).split("RepartitionByExpression")
    assert "Filter" in above and "Filter" not in below
    assert read.count() == sum(i % 6 == 5 for i in range(40))


def test_extra_tags_are_found_once_a_record(spark):
    x = "<ComicInfo><A>1</A><B n='2'>x &lt; y</B><Title>T</Title><A>3</A><C></C><A-1>4</A-1></ComicInfo>"
    df = A.parse_record(spark.createDataFrame([(1, x), (2, "<ComicInfo><A>1</A><Bad"), (3, None)], "id int, record string"))
    assert optimized(df.select("id", "extras")).count("regexp_extract_all") == 1
    got = {r["id"]: r["extras"] for r in df.collect()}
    assert got == {1: {"B": "x < y", "A": "3", "A-1": "4"}, 2: {}, 3: {}}


def test_years_are_keys_of_canonical_matches(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", "Dark Sky", "Moon", "Moon"]), rng.choice(["1", "2", "1A"]), rng.choice(["", "", "2"]), rng.choice([0, -5, 1, 2, 3, 1999, 2000, 2001, 2003])) for i in range(150)]
    df = K.canonical_key(spark.createDataFrame(rows, "id int, series_name string, issue_number string, volume string, publication_year int").withColumn("publisher", F.lit("")))
    df = df.withColumn("key_year", F.when(F.col("id") % 13 != 0, F.col("key_year")))  # a null year meets blank ones alone
    got = K.match_keys(df, df, "id", "id", 2)
    keys = df.select("id", "series_norm", "issue_numeric", "issue_suffix", "is_named", "volume_norm", "key_year").collect()

    def meets(a, b):
        years = (a[6] is not None and a[6] <= 0) or (b[6] is not None and b[6] <= 0) or (None not in (a[6], b[6]) and abs(a[6] - b[6]) <= 2)
        return a[2:5] == b[2:5] and (not a[1] or not b[1] or a[1] == b[1]) and (not a[5] or not b[5] or a[5] == b[5]) and years

    want = sorted((a[0], b[0]) for a in keys for b in keys if meets(a, b))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 500
    joins = [line for line in optimized(got).split("\n") if "Join Inner" in line]
    assert sum("_r_year" in line for line in joins) == 3 and len(joins) == 6


def test_entries_are_read_once(spark):
    entries = spark.createDataFrame([("Dark Sky", "1"), ("Moon", "2"), ("Moon", "2")], "series string, number string")
    files = spark.createDataFrame([("/lib/Dark Sky #001.cbz",), ("/lib/Moon #3.cbz",)], "path string")
    got = R.reading_files(entries, files)
    assert "versus" not in optimized(got)  # normal forms come from the written tables
    assert [tuple(r) for r in got.collect()] == [("Dark Sky", "1", "/lib/Dark Sky #001.cbz")]


def test_pools_are_shuffled_once_a_stage(spark, monkeypatch):
    plans, write = {}, V.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(V, "written", seen)
    files = names.parse_filename(spark.createDataFrame([(0, "/tmp/Batman #001 (2016).cbz"), (1, "/tmp/Saga #002 (2012).cbz")], "file_id int, path string"))
    pool = spark.createDataFrame(
        [(0, 1, "Kapowarr", "4000-1", "", "Batman", "", 2016, "", ""), (1, 2, "ComicVine", "4000-2", "", "Saga", "2", 2012, "", ""), (7, 1, "GCD", "", "", "Other", "1", 2000, "", "")],
        "file_id int, pool_pos int, provider string, issue_id string, series_id string, series_name string, issue_number string, publication_year int, publisher string, volume string",
    )
    existing = spark.createDataFrame([], "file_id int, series string, title string, number string, year int, publisher string, volume string, provider_id string, web string")
    got = {r["file_id"]: (r["source"], r["level"]) for r in V.resolve(files, pool, existing).collect()}
    assert got == {0: ("kapowarr", "AUTO_ACCEPT"), 1: ("comicvine_fallback", "AUTO_ACCEPT")}
    for name in ("kapowarr", "comicvine_fallback", "gcd_fallback"):
        assert plans[name].count("Exchange hashpartitioning") == 1 and "(?U)" not in plans[name]


def test_canonical_matches_are_not_broadcast(spark):
    rows = [(1, "Dark Sky", "1", "", 1999), (2, "", "1", "", 2000), (3, "Moon", "1", "", 0)]
    df = K.canonical_key(spark.createDataFrame(rows, "id int, series_name string, issue_number string, volume string, publication_year int").withColumn("publisher", F.lit("")))
    got = K.match_keys(df, df, "id", "id")
    assert {tuple(r) for r in got.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3)}
    plan = got._jdf.queryExecution().executedPlan().toString()  # as it ran: written tables are small by their files alone
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_collections_are_dealt_once_and_as_lines(spark):
    built = QUERIES["Q10_collection_build"](spark, "/root/testdata/sf0.001")
    rows = built.collect()
    plan = built._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]  # as it ran
    assert plan.count("Scan parquet [l_orderkey") == 1 and "ReusedExchange" in plan
    lines = built._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert len(lines) == 3 and "Series!" in lines[0] + lines[1] and "Writer" not in lines[2]  # texts are made above
    members = derive(spark, "/root/testdata/sf0.001", "members")
    bad = {r[0] for r in K.validate_collections(members).where("result = 'REJECT'").collect()}
    assert {r["collection_id"] for r in rows} == {r[0] for r in members.select("collection_id").distinct().collect()} - bad and bad


def test_collections_are_validated_in_one_grouping(spark):
    groups = {1: ["1", "2"], 2: ["1", "1", "2", "2"], 3: ["1", "1A", "1"], 4: ["1", "01", "2A", "2B"], 5: [None, None], 6: ["", None], 7: ["7"], 8: ["1", "1", "2", "02", "3"], 9: ["FCBD", "x"]}
    rows = [(g, i, "Dark Sky", "", n, "") for g, ns in groups.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "collection_id int, pos int, series_name string, publisher string, issue_number string, volume_id string")
    told = K.validate_collections(df)
    got = {r["collection_id"]: (r["result"], r["n_problems"], r["n_warnings"]) for r in told.collect()}
    accept = ("ACCEPT", 0, 0)
    assert got == {1: accept, 2: ("REJECT", 2, 0), 3: ("WARN", 0, 1), 4: ("WARN", 0, 2), 5: accept, 6: ("REJECT", 1, 0), 7: accept, 8: ("REJECT", 1, 1), 9: ("WARN", 0, 1)}
    assert "Join" not in optimized(told)
