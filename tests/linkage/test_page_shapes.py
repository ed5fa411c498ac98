import json

from foliate.operators.curate import slug_belongs
from foliate.sources import catalogs as B
from foliate.sources import pages as G
from pyspark.sql import functions as F


def test_volume_issues(spark):
    def li(text, href, label):
        return f"<li>{text} <a href='{href}'>{label}</a></li>"

    rows = [
        (1, 1, "red-sky", li("#1", "/red-sky-1/4000-1/", "a") + li("#1", "/red-sky-1/4000-2/", "b") + li("#2-5", "/red-sky-2/4000-3/", "c") + li("#3", "/blue/4000-4/", "d")),
        (1, 2, "red-sky", li("#1/2", "/red-sky-half/4000-5/", "no") + li("#4A", "/the-red-sky-4/4000-6/", "e") + li("none", "/red-sky/4000-7/", "g #0.5") + li("#9", "/red-sky-9-tpb/4000-8/", "h")),
        (1, 51, "red-sky", li("#51", "/red-sky-51/4000-9/", "late")),
        (2, 1, "", li("", "/any/4000-10/", "Issue 7")),
        (3, 1, "", None),
    ]
    got = G.volume_issues(spark.createDataFrame(rows, "volume_id long, page_no int, slug string, html string")).collect()
    assert sorted((r["volume_id"], r["number"], r["url"]) for r in got) == [(1, "0.5", "/red-sky/4000-7/"), (1, "1", "/red-sky-1/4000-1/"), (1, "4A", "/the-red-sky-4/4000-6/"), (2, "7", "/any/4000-10/")]


def test_the_whole_text_around_a_link_counts(spark):
    long = "word " * 60
    html = f"<li>{long}#12 <a href='/x/4000-1/'>a</a></li><li><a href='/x/4000-2/'>b</a> #13</li><li><a href='/x/4000-3/'>c #2</a> #2-5</li><li>#14 <a href='/x/4000-4/'>d</a>"
    got = G.volume_issues(spark.createDataFrame([(1, 1, "", html)], "volume_id long, page_no int, slug string, html string")).collect()
    assert sorted((r["number"], r["url"]) for r in got) == [("12", "/x/4000-1/"), ("13", "/x/4000-2/"), ("14", "/x/4000-4/")]
    html = f"<li><a href='/x/4050-1/'>Kap</a> {long}1999 (7 issues)</li>"
    found = G.links(G.page_parts(spark.createDataFrame([(1, html)], "page_id long, html string")))
    r = G.search_results(found).first()
    assert (r["year"], r["n_issues"], len(r["description"])) == (1999, 7, 160)


def test_reading_entries(spark):
    html = "<a href='/x/4000-1/'>Edit</a><a href='/x/4000-1/'>Kap #1</a><a href='/x/4000-2/'>Kap</a><a href='/y'>No #3</a><a href='/x/4000-1/'>Kap #9</a>"
    got = G.reading_entries(G.page_parts(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))).collect()
    assert [(r["page_id"], r["place"], r["series"], r["number"]) for r in sorted(got, key=lambda r: r["place"])] == [(1, 1, "Kap", "1"), (1, 2, "Kap", "")]


def test_slugs(spark):
    cases = [("red-sky-1", True), ("a-red-sky", True), ("red-sky-annual-2", True), ("red-sky-rises", False), ("red-skyline", False), ("red-sky-1-hc", False), ("blue", False)]
    got = spark.createDataFrame([(s,) for s, _ in cases], "s string").select("s", slug_belongs(F.col("s"), F.lit("the-red-sky")).alias("ok")).collect()
    assert [(r["s"], r["ok"]) for r in got] == cases


def test_related_records(spark):
    def df(*rows):
        return spark.createDataFrame([(r if isinstance(r, (str, type(None))) else json.dumps(r),) for r in rows], "data string")

    story = [{"writer": "Ann (plot), Bob?; Ann", "characters": "X, Y; Z"}, {"writer": None, "inker": "Bob"}]
    issues = df({"id": 1, "number": " #3 ", "series_id": 7, "publication_date": "May 1999", "story_set": story}, {"id": 2, "series_id": 8}, "broken", None)
    got = {r["issue_id"]: r for r in B.related_records(issues, df({"id": 7, "name": "Kap", "publisher_id": 5}), df({"id": 5, "name": "Pub"})).collect()}
    assert set(got) == {1, 2}
    assert tuple(got[1][k] for k in ("series", "number", "title", "publisher", "year", "writers", "inkers", "characters")) == ("Kap", "3", "Kap #3", "Pub", 1999, "Ann; Bob", "Bob", "X, Y; Z")
    assert (got[2]["series"], got[2]["title"], got[2]["year"], got[2]["writers"]) == ("", "", 0, "")


def texts(spark, *pages):
    return G.issue_page_texts(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_creators_take_the_parents_whole_text_in_their_block(spark):
    block = "<div class='wiki-details-object'><h3>Creators</h3>{}</div>"
    far = "<p>" + "x " * 200 + "<a>Bo Ek</a> inker</p>"
    inside = "<div><a href='/p/1/'>Ann Lee</a> <span>Writer, Cover</span></div>" + far + "<p><a>Ann Lee</a> writer, penciler</p><p><a>N</a> writer</p><p><a>Cy Dor</a> lettered nothing</p>"
    got = G.creators(texts(spark, block.format(inside), "<p><a>Out Side</a> writer</p>", None, "", "<div class='wiki-details-object'>Creators <a>Never Closed</a> colorist")).collect()
    assert sorted((r["page_id"], r["role"], r["name"]) for r in got) == [(0, "inkers", "Bo Ek"), (0, "pencillers", "Ann Lee"), (0, "writers", "Ann Lee"), (4, "colorists", "Never Closed")]


def test_issue_records_fall_back_step_by_step(spark):
    pages = [
        "<h1>Tin Fox <b>#7b</b> : Rust</h1><p class='wiki-descriptor'>released by Low Lamp.</p><meta name='description' content=' d '>",
        "<meta name='twitter:title' content='Tin Fox #2 - Ash (Issue)'><h1><a class='wiki-title'>Tin Fox</a> <a class='wiki-issue-number'># 2</a></h1><div class='content-body'>Long <i>ago</i><span class='wiki-item-edit'>Edit</span></div>Cover Date Sep 1987",
        "<h1>Tin Fox</h1><script>Cover Date May 1990</script>",
        None,
    ]
    got = {r["page_id"]: tuple(r)[1:] for r in G.issue_records(texts(spark, *pages)).collect()}
    assert got[0] == ("Tin Fox", "7b", "Rust", "Low Lamp", 0, 0, 0, "d")
    assert got[1] == ("Tin Fox", "2", "Ash", "", 1987, 9, 0, "Long ago")
    assert got[2] == ("", "", "", "", 0, 0, 0, "") and got[3] == got[2]


def test_page_names(spark):
    html = "<div class='wiki-details-object'>Teams <a>Add</a><a>The Six</a><a>The Six</a></div><div class='wiki-details-object'>Story Arc <a>'Dusk'</a></div><div>Characters <a>Nobody</a></div>"
    got = G.page_names(texts(spark, html)).collect()
    assert sorted((r["kind"], r["name"]) for r in got) == [("story_arcs", "Dusk"), ("teams", "The Six")]


def test_many_links_in_one_block(spark):
    def page(n):
        items = "".join(f"<li><a href='/c/{i}/'>Moss {i}</a> writer</li>" for i in range(n))
        loose = "".join(f"<a href='/t/{i}/'>Team {i}</a> of the page" for i in range(n))
        return f"<div class='wiki-details-object'>Creators é <ul>{items}</ul></div><div class='wiki-details-object'>Teams {loose}</div>"

    html = page(4000)
    row = texts(spark, html).selectExpr("length(to_json(struct(*))) AS size", "size(spans) AS spans").first()
    assert row["size"] < 10 * len(html) and row["spans"] == 4002
    assert G.creators(texts(spark, html)).where("role = 'writers'").count() == 4000
    assert G.page_names(texts(spark, html)).where("kind = 'teams'").count() == 4000
    small = G.creators(texts(spark, page(3))).orderBy("pos").collect()
    assert [(r["role"], r["name"], r["pos"]) for r in small] == [("writers", f"Moss {i}", i) for i in range(3)]
