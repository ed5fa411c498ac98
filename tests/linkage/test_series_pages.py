"""Search and series pages of the second catalog, series indexes, arc searches."""

import json

from foliate.sources import series_pages as S


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_search_rows(spark):
    html = (
        "<table><tr><td>Outer <a href='/publisher/1/'>P</a><table><tr><td><a href='/series/5/'>Dark <b>Sky</b></a> 1999 (12 issues)</td></tr></table></td></tr>"
        "<tr><td><a href='/series/6/'></a><a href='/series/7/'>no: the first link of a row counts</a></td></tr><tr><td><a href='http://other/series/8/'>Moon</a>"
    )
    got = S.series_search(S.page_rows(pages(spark, html, None, "<tr>x</tr>")), "series").collect()
    assert sorted((r["page_id"], r["title"], r["url"], r["year"], r["count"]) for r in got) == [(0, "Dark Sky", "https://www.comics.org/series/5/", "1999", "12 issues"), (0, "Moon", "http://other/series/8/", "", "")]
    assert {r["description"] for r in got} == {"Outer P Dark Sky 1999 (12 issues)", "Moon"}


def test_series_issues_and_arcs(spark):
    html = "<h1>Dark <i>Sky</i></h1><h1>no</h1><a href='/issue/1/'>#<b>00</b>7</a><a href='/issue/2/'>7</a><a href='/issue/3/'>[nn]</a><a href='/issue/x/'>9</a><a href='/issue/4/'>000</a><a href='/a/4045-3/'>ab</a><a href='/a/4045-3/'>Dark Age</a><a href='http://v/4045-4/'>Dark  Age</a>"
    links = S.page_links(pages(spark, html, "<a href='/issue/9/'>1A</a>", None))
    got = sorted((r["series_id"], r["series"], r["number"], r["url"]) for r in S.series_issues(links).collect())
    assert got == [(0, "Dark Sky", "0", "https://www.comics.org/issue/4/"), (0, "Dark Sky", "7", "https://www.comics.org/issue/1/"), (1, "GCP Series #1", "1A", "https://www.comics.org/issue/9/")]
    assert [(r["arc_id"], r["name"], r["url"]) for r in S.arc_search(links).collect()] == [("4", "Dark Age", "http://v/4045-4/")]


def test_series_index(spark):
    def df(*rows):
        return spark.createDataFrame([(r if isinstance(r, (str, type(None))) else json.dumps(r),) for r in rows], "data string")

    series = df({"id": 1, "name": "Kap", "active_issues": ["http://c/issue/5/", "http://c/issue/6/", "http://c/other", "http://c/issue/7/", "http://c/issue/8/"]}, {"id": 2, "name": ""}, "broken", None)
    issues = df({"id": 5, "number": "#010"}, {"id": 6, "number": " 10"}, {"id": 7, "number": "2A"}, "broken")
    got = sorted((r["number"], r["issue_id"], r["sort_number"]) for r in S.series_index(series, issues).collect())
    assert got == [("0", "8", 0), ("10", "5", 10), ("2A", "7", 2)]


def test_both_kinds_are_found_in_one_pass(spark):
    pages = spark.createDataFrame([(1, '<tr><td><a href="/series/2/">A</a> 12 issues <a href="/issue/3/">#1</a></td></tr><tr><td><a href="/series/2/">again</a></td></tr>')], "page_id long, html string")
    found = S.series_search(S.page_rows(pages), "series", "issue")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {(r["title"], r["type"], r["count"]) for r in found.collect()} == {("A", "gcp_volume", "12 issues"), ("#1", "gcp_issue", "1 issue")}


def test_page_parsers_count_no_lines():
    from foliate.sources import pages as G

    for kind in (G._Links, G._IssuePage, S._Rows):
        p = kind()
        p.feed("<h1>a\n<b>b</b></h1>\n<a href='/x/'>c</a>\n")
        assert p.getpos() == (1, 0)  # the work of counting lines is not done
