import pytest
from pyspark.sql import functions as F

from foliate.functions import names
from foliate.operators import arcs as R
from foliate.operators import curate as K
from foliate.operators import decide as D
from foliate.plans import resolve as V

POOL = "file_id long, pool_pos int, provider string, issue_id string, series_id string, series_name string, issue_number string, publication_year int, publisher string, volume string"
EXISTING = "file_id long, series string, title string, number string, year int, publisher string, volume string, provider_id string, web string"


def cand(file_id, pos, provider, issue_id, series, number, year, **more):
    return (file_id, pos, provider, issue_id, more.get("series_id", ""), series, number, year, more.get("publisher", ""), more.get("volume", ""))


def parsed(spark, paths):
    return names.parse_filename(spark.createDataFrame(list(enumerate(paths)), "file_id long, path string"))


GOLDEN = [
    ("Batman (2016) #001.cbz", [("ComicVine", "4000-1", "Batman", "1", 2016)], 90.0, "AUTO_ACCEPT"),
    ("Batman #001.cbz", [("ComicVine", "4000-1", "Batman", "1", 2016)], 75.0, "ACCEPT_WITH_WARNING"),
    ("Batman #001 (2016).cbz", [("Kapowarr", "4000-1", "Batman", "1", 2016)], 100.0, "AUTO_ACCEPT"),
    ("Batman #001 (2016).cbz", [("Filename", "", "Batman", "1", 2016)], 70.0, "MANUAL_REVIEW"),
    ("Batman (2016) #001.cbz", [("ComicVine", "", "Batman", "1", 1940)], 5.0, "MANUAL_REVIEW"),
    ("Batman #001.cbz", [("ComicVine", "", "Superman", "1", 0)], 0.0, "UNRESOLVED"),
    ("Batman #001.cbz", [("ComicVine", "4000-1", "Batman", "1", 2016), ("ComicVine", "4000-2", "Batman", "1", 2011)], 75.0, "MANUAL_REVIEW"),
]


def test_golden_scores(spark):
    files = parsed(spark, ["/tmp/" + g[0] for g in GOLDEN])
    rows = [cand(i, k, *c) for i, g in enumerate(GOLDEN) for k, c in enumerate(g[1])]
    got = {r["file_id"]: r for r in D.decide(D.evaluate(D.pool_pairs(files, spark.createDataFrame(rows, POOL)))).collect()}
    assert [(got[i]["score"], got[i]["level"]) for i in range(len(GOLDEN))] == [g[2:] for g in GOLDEN]
    assert got[6]["ambiguous"] and got[6]["margin"] == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_order_of_rows_does_not_matter(spark, parts):
    files = parsed(spark, ["/tmp/Batman #001 (2016).cbz"])
    rows = [cand(0, 1, "Kapowarr", "4000-1", "Batman", "1", 2016), cand(0, 2, "ComicVine", "4000-1", "The Batman", "01", 2016), cand(0, 3, "GCD", "", "Superman", "1", 2016)]
    pool = spark.createDataFrame(rows, POOL).repartition(parts)
    r = D.decide(D.evaluate(D.pool_pairs(files, pool))).first()
    assert (r["provider"], r["n_agree"], r["level"], r["critical"]) == ("Kapowarr", 2, "MANUAL_REVIEW", True)


def test_waterfall(spark):
    files = parsed(spark, ["/tmp/Batman #001 (2016).cbz", "/tmp/Saga #002 (2012).cbz", "/tmp/Nothing #003.cbz", "/tmp/Own #004 (2001).cbz", "/tmp/X #5.cbz"])
    rows = [
        cand(0, 1, "Kapowarr", "4000-1", "Batman", "", 2016), cand(1, 2, "ComicVine", "4000-2", "Saga", "2", 2012), cand(2, 0, "Filename", "", "Nothing", "3", 0),
        cand(4, 4, "GCD", "", "Other", "5", 0),
    ]
    existing = spark.createDataFrame([(3, "Own", "", "4", 2001, "", "", "", "https://comicvine.gamespot.com/a/4000-77/")], EXISTING)
    got = {r["file_id"]: (r["source"], r["level"]) for r in V.resolve(files, spark.createDataFrame(rows, POOL), existing).collect()}
    assert got == {0: ("kapowarr", "AUTO_ACCEPT"), 1: ("comicvine_fallback", "AUTO_ACCEPT"), 2: ("", "UNRESOLVED"), 3: ("existing_comicinfo", "AUTO_ACCEPT"), 4: ("gcd_fallback", "UNRESOLVED")}


def test_collections(spark):
    rows = [
        (1, 1, "Batman", "", "", "3"), (1, 2, "Batman", "", "", "1"), (2, 1, "Batman", "", "", "1"), (2, 2, "Detective", "", "", "1"), (3, 1, "Batman", "", "", "1"), (3, 2, "Batman", "", "", "1A"),
        (4, 1, "A", "", "v1", "1"), (4, 2, "A", "", "v2", "2"), (5, 1, "A", "x", "", "1"), (5, 2, "A", "y", "", "2"),
    ]
    df = spark.createDataFrame(rows, "collection_id long, pos int, series_name string, publisher string, volume_id string, issue_number string")
    got = {r["collection_id"]: (r["result"], r["sorted_numbers"]) for r in K.validate_collections(df).collect()}
    assert got == {1: ("ACCEPT", "1,3"), 2: ("REJECT", "1,1"), 3: ("WARN", "1,1A"), 4: ("REJECT", "1,2"), 5: ("WARN", "1,2")}


def test_canonical_match(spark):
    rows = [(0, "The Batman", "1", "", 2016), (1, "Batman", "001", "1", 2017), (2, "", "1", "", 0), (3, "Batman", "1A", "", 2016), (4, "Batman", "1", "2", 2016), (5, "Batman", "1", "", 1940)]
    df = K.canonical_key(spark.createDataFrame(rows, "id long, series_name string, issue_number string, volume string, publication_year int").withColumn("publisher", F.lit("")))
    got = {(r["left_id"], r["right_id"]) for r in K.match_keys(df, df, "id", "id").collect()}
    assert {(0, 1), (0, 2), (2, 5), (0, 4), (3, 3)} <= got and not {(0, 3), (1, 4), (0, 5)} & got


def test_reading_order(spark):
    df = spark.createDataFrame([("Batman #1-3",), ("X issues 5 - 2",), ("Y 2 Special #1",), ("Plain",), ("Z #4A",), (" ",)], "line string")
    got = [(r["series"], r["number"]) for r in R.expand_ranges(df).collect()]
    assert got == [("Batman", "1"), ("Batman", "2"), ("Batman", "3"), ("X issues", "5"), ("Y", "2"), ("Plain", "1"), ("Z", "4A")]


def test_arc_tags(spark):
    df = spark.createDataFrame([('"Dark Age", dark (age), War', "4,,5")], "a string, n string")
    tags = R.tag_list(F.col("a"), F.col("n"))
    r = df.select(tags.alias("t"), R.upsert_arc(tags, F.lit("The War"), F.lit(9)).alias("u"), R.rename_arc(tags, F.lit("Dark"), F.lit("Light")).alias("r")).first()
    assert [tuple(x) for x in r["t"]] == [("Dark Age", "4"), ("War", "1")]
    assert [tuple(x) for x in r["u"]] == [("Dark Age", "4"), ("The War", "9")]
    assert [tuple(x) for x in r["r"]] == [("Light", "4"), ("War", "1")]


def test_ordered_unique(spark):
    df = spark.createDataFrame([(["B", " b", "", "a", "A "],)], "x array<string>")
    assert df.select(K.ordered_unique(F.col("x")), K.ordered_unique(F.col("x"), loose=False)).first()[:] == (["B", "a"], ["B", " b", "a", "A "])
