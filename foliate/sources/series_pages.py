"""The second catalog's search and series pages, its series index in JSON, and searches for story arcs.

A null page counts as empty and gives no rows; of equal urls (or numbers) of a page the first
counts.  Urls without a host belong to the catalog's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import text
from foliate.operators.curate import first_by
from foliate.sources.pages import PageParser

#: The catalog's address, and labels of what a search finds.
HOST = "https://www.comics.org"
KINDS = {"series": ("gcp_volume", "GCP Series"), "issue": ("gcp_issue", "GCP Issue")}
NUMBER = r"#?([0-9]+[a-zA-Z]?|[0-9]+\.[0-9]+|[0-9]+)"


class _Rows(PageParser):
    """Table rows with the texts and links in them, the links of the page, and its first heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page: list[str] = []
        self.rows: list[list] = []  # begin, end, links
        self.links: list[tuple[str, int, int]] = []  # href, begin, end
        self.heading: tuple[int, int] | None = None
        self.open: list[tuple[str, int, str, list | None]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("tr", "a", "h1"):
            row = [len(self.page), -1, []] if tag == "tr" else None
            if row:
                self.rows.append(row)
            self.open.append((tag, len(self.page), dict(attrs).get("href") or "", row))

    def handle_data(self, data):
        if piece := data.strip():
            self.page.append(piece)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                _, begin, href, row = self.open.pop(k)
                end = len(self.page)
                if tag == "tr":
                    row[1] = end
                elif tag == "h1":
                    self.heading = self.heading or (begin, end)
                else:
                    self.links.append((href, begin, end))
                    for x in self.open:
                        if x[3] is not None:
                            x[3][2].append(len(self.links) - 1)
                return


LINK = "struct<href:string,name:string,joined:string>"


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, pos, words, links (href, name) of each table row of the pages (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, html in zip(b["page_id"], b["html"], strict=True):
                p = _Rows()
                p.feed(html or "")
                links = [{"href": h, "name": " ".join(p.page[i:j]), "joined": "".join(p.page[i:j])} for h, i, j in p.links]
                for pos, (begin, end, own) in enumerate(p.rows):
                    words = " ".join(" ".join(p.page[begin : len(p.page) if end < 0 else end]).split())
                    out.append((page, pos, words, [links[k] for k in own]))
            yield pd.DataFrame(out, columns=["page_id", "pos", "words", "links"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInPandas(run, f"page_id long, pos int, words string, links array<{LINK}>")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, heading, pos, href, name, joined (pieces without spaces between) of each link of the pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, html in zip(b["page_id"], b["html"], strict=True):
                p = _Rows()
                p.feed(html or "")
                heading = " ".join(p.page[slice(*p.heading)]) if p.heading else ""
                out += [(page, heading, pos, h, " ".join(" ".join(p.page[i:j]).split()), "".join(p.page[i:j])) for pos, (h, i, j) in enumerate(p.links)]
            yield pd.DataFrame(out, columns=["page_id", "heading", "pos", "href", "name", "joined"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInPandas(run, "page_id long, heading string, pos int, href string, name string, joined string")


def whole_url(href: Column, host: str = HOST) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(host), href))


def series_search(rows: DataFrame, *kinds: str) -> DataFrame:
    """What a search page lists (rows as page_rows gives them); kinds: "series", "issue" or both, in one pass over the pages.

    page_id, pos, title, url, type, type_label, year and count as text ("" if not told),
    description of 160 characters.  The first link of each kind in a row counts.
    """
    n = F.regexp_extract("words", r"(?i)([0-9]+)\s+issues", 1)

    def of(kind: str) -> Column:
        name, label = KINDS[kind]
        link = F.get(F.filter("links", lambda x: x["href"].rlike(f"/{kind}/[0-9]+/")), F.lit(0))
        count = F.lit("1 issue") if kind == "issue" else F.when(n != "", F.concat(n, F.lit(" issues"))).otherwise("")
        return F.struct(link.alias("_l"), F.lit(name).alias("type"), F.lit(label).alias("type_label"), count.alias("count"))

    found = rows.select("page_id", "pos", "words", F.inline(F.array(*[of(k) for k in kinds]))).where(F.col("_l.name") != "").select(
        "page_id", "pos", F.col("_l.name").alias("title"), whole_url(F.col("_l.href")).alias("url"), "type", "type_label",
        F.regexp_extract("words", r"\b((?:19|20)[0-9]{2})\b", 1).alias("year"), "count", F.substring("words", 1, 160).alias("description"),
    )
    return first_by(found, ["page_id", "type", "url"], ["pos"])


def _number(c: Column) -> Column:
    bare = F.ltrim(c, F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def series_issues(links: DataFrame) -> DataFrame:
    """series_id, series, number, label, url: issues on series pages (links as page_links gives them; page_id is the series).

    The first link of a number counts; a page without a heading is "GCP Series #id".
    """
    shown = links.where(F.col("href").rlike("/issue/[0-9]+/") & (F.regexp_extract("joined", NUMBER, 1) != ""))
    numbered = first_by(shown.withColumn("number", _number(F.regexp_extract("joined", NUMBER, 1))), ["page_id", "number"], ["pos"])
    series = F.when(F.col("heading") != "", F.col("heading")).otherwise(F.concat(F.lit("GCP Series #"), "page_id"))
    return numbered.select(F.col("page_id").alias("series_id"), series.alias("series"), "number", F.concat(F.lit("Issue #"), "number").alias("label"), whole_url(F.col("href")).alias("url"))


def series_index(series: DataFrame, issues: DataFrame, data: str = "data") -> DataFrame:
    """series_id, series, number, label, url, issue_id, sort_number: a series' issues out of its JSON and theirs.

    A series lists urls of its issues; one whose JSON is missing has number "0".  The first
    of a number counts, in the order of the list; sort_number are its digits, 0 without any.
    """
    s = series.select(F.from_json(data, "id long, name string, active_issues array<string>").alias("r")).where("r.id is not null AND r.name <> ''").select("r.*")
    listed = s.select(F.col("id").alias("series_id"), F.col("name").alias("series"), F.posexplode("active_issues").alias("pos", "api"))
    listed = listed.withColumn("issue_id", F.regexp_extract("api", "/issue/([0-9]+)", 1)).where("issue_id <> ''")
    i = issues.select(F.from_json(data, "id string, number string").alias("r")).where("r.id is not null").groupBy(F.col("r.id").alias("issue_id")).agg(F.min("r.number").alias("told"))
    number = _number(F.regexp_replace(F.trim(text(F.col("told"))), "^#+", ""))
    first = first_by(listed.join(i, "issue_id", "left").withColumn("number", number), ["series_id", "number"], ["pos"])
    digits = F.regexp_replace("number", "[^0-9]", "")
    url = F.concat(F.lit(f"{HOST}/issue/"), "issue_id", F.lit("/"))
    return first.select("series_id", "series", "number", F.concat(F.lit("Issue #"), "number").alias("label"), url.alias("url"), "issue_id", F.coalesce(digits.try_cast("bigint"), F.lit(0)).alias("sort_number"))


def arc_search(links: DataFrame, host: str = "https://comicvine.gamespot.com") -> DataFrame:
    """page_id, arc_id, name, deck, url: story arcs that search pages link; the first link of a url must have a name of three letters."""
    arcs = first_by(links.where(F.col("href").contains("/4045-")), ["page_id", "href"], ["pos"]).where(F.length("name") > 2)
    arc = F.regexp_extract("href", "4045-([0-9]+)", 1)
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(host), "href")).otherwise(F.col("href"))
    return arcs.select("page_id", arc.alias("arc_id"), "name", F.concat(F.lit("ComicVine Story Arc #"), arc).alias("deck"), url.alias("url"))
