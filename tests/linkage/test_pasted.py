"""Pasted pages read in full; several urls, each from its own catalog."""

from foliate.plans.resolve import routed_records
from foliate.sources.pasted import pasted_records


def read(spark, *texts):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, title string")
    return [r.asDict() for r in sorted(pasted_records(rows, "id").collect(), key=lambda r: r["id"])]


def test_copied_text(spark):
    r = read(spark, "Dark Sky #4\nMoon Press, 1999 Series\nMarch 2001\nWriter: Ann\nPenciller: Bob\nScript: none", None, "", "https://a.example/1\n\t Lone [2nd] \r\n\nWinter 1990\nCharacters: A; Bo (x); bo; NONE; Bo\nGenre: a\nGenre:  b ", "x" * 100_000 + " " * 50_000 + "," + "((" * 500)
    assert (r[0]["title"], r[0]["series"], r[0]["number"], r[0]["publisher"], r[0]["year"], r[0]["month"], r[0]["writers"], r[0]["pencillers"]) == ("Dark Sky #4", "Dark Sky", "4", "Moon Press", 1999, 3, "Ann", "Bob")
    assert all(v in ("", 0) for x in r[1:3] for k, v in x.items() if k != "id")
    assert (r[3]["web"], r[3]["series"], r[3]["number"], r[3]["year"], r[3]["month"], r[3]["characters"], r[3]["genre"]) == ("https://a.example/1", "Lone", "[2nd]", 1990, 0, "Bo; bo", "b")
    assert len(r) == 5


def test_page_sources(spark):
    page = "<html><head><title>GCD :: Issue :: Dark Sky #4 &amp; 5</title><script>var x = 1;</script></head><body><h1>Other</h1><p>New Moon Press,<b>1999</b> Series</p></body></html>"
    r = read(spark, page, "<body><h1>Grand Comics Database Issue</h1>\nScript: Ann", "<TITLE>none</TITLE><h1> Only <i>heading</i></h1>", "<html>")
    assert (r[0]["title"], r[0]["series"], r[0]["number"], r[0]["publisher"], r[0]["year"]) == ("Dark Sky #4 & 5", "Dark Sky", "4 & 5", "Press", 1999)
    assert r[1]["writers"] == "Ann" and r[1]["title"].startswith("<body>")  # no issue: read as text
    assert (r[2]["series"], r[2]["title"], r[2]["number"]) == ("Only heading", "Only heading", "") and r[3]["title"] == "<html>"


def test_every_url_from_its_own_catalog(spark):
    asked = spark.createDataFrame([(1, "https://comicvine.gamespot.com/x/4000-7/ http://www.comics.org/issue/7/ http://kap.local/issue/3"), (2, None), (3, "http://www.comics.org/issue/8/")], "request_id int, urls string")
    cv, gcd = spark.createDataFrame([("4000-7", "cv")], "issue_id string, title string"), spark.createDataFrame([(7, "gcd", "P")], "issue_id long, title string, publisher string")
    got = [(r["request_id"], r["pos"], r["route"], r["state"], r["title"]) for r in routed_records(asked, {"ComicVine": cv, "GCP": gcd}, base="http://kap.local").orderBy("request_id", "pos").collect()]
    assert got == [(1, 0, "ComicVine", "FOUND", "cv"), (1, 1, "GCP", "FOUND", "gcd"), (1, 2, "Kapowarr", "NO_CATALOG", None), (3, 0, "GCP", "NOT_FOUND", None)]
