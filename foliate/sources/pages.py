"""Records, links and search results out of HTML pages and labelled text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.text import date_parts
from foliate.operators.curate import first_by, slug_belongs

#: Keywords of a creator's role, tested in this order.
ROLES = [("writers", "writer"), ("pencillers", "penciler|penciller|artist"), ("inkers", "inker"), ("colorists", "colorist"), ("letterers", "letterer"), ("cover_artists", "cover")]


class PageParser(HTMLParser):
    """A parser of pages that does not count lines: nothing asks where in the source it is."""

    def updatepos(self, i: int, j: int) -> int:
        return j


class _Links(PageParser):
    """Text of the page's parts and its links with the text of the block around them."""

    BLOCKS = {"div", "p", "li", "td", "tr", "h1", "h2", "h3", "section", "article", "span"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple[str, str, str, list[str]]] = []  # tag, href, text, pieces of the block's text, to which later ones are added
        self.open: list[tuple[str, str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "h1", "title") or tag in self.BLOCKS:
            self.open.append((tag, dict(attrs).get("href") or "", []))

    def handle_data(self, data):
        for _, _, text in self.open:
            text.append(data)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                _, href, text = self.open.pop(k)
                if tag in ("a", "h1", "title"):
                    block = next((x for x in reversed(self.open[:k]) if x[0] in self.BLOCKS), None)
                    self.parts.append((tag, href, " ".join("".join(text).split()), block[2] if block else []))
                return


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag (a, h1 or title), href, text, around (the whole text of the block)."""

    names = ["page_id", "pos", "tag", "href", "text", "around"]

    def parts(b: pd.DataFrame) -> Iterator[tuple]:
        for page, html in zip(b["page_id"], b["html"], strict=True):
            p = _Links()
            p.feed(html or "")
            block, around = None, ""
            for i, (tag, href, text, pieces) in enumerate(p.parts):
                if pieces is not block:
                    block, around = pieces, " ".join("".join(pieces).split())
                yield page, i, tag, href, text, around

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames of many pages, cut at about a million characters: many links may stand in one long block."""
        for b in batches:
            rows, size = [], 0
            for r in parts(b):
                rows.append(r)
                size += len(r[-1])
                if size > 1 << 20:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, tag string, href string, text string, around string")


def page_titles(parts: DataFrame) -> DataFrame:
    """A page's title: its first h1, else its title tag."""
    ranked = parts.where("tag in ('h1', 'title') and text <> ''").withColumn("_r", F.when(F.col("tag") == "h1", 0).otherwise(1))
    return first_by(ranked, ["page_id"], ["_r", "pos"]).select("page_id", F.col("text").alias("title"))


def links(parts: DataFrame, drop: str = "^(?:none|edit|cover|view|add|this issue)$") -> DataFrame:
    """Links with a name, in order; each url once per page."""
    kept = parts.where((F.col("tag") == "a") & (F.length("text") > 1) & ~F.lower("text").rlike(drop))
    return first_by(kept, ["page_id", "href"], ["pos"]).select("page_id", "pos", "href", F.col("text").alias("name"), "around")


class _Element:
    """An open or closed element: the pieces of the page's text from `begin` to `end` stand in it."""

    __slots__ = ("tag", "classes", "hidden", "begin", "end")

    def __init__(self, tag: str, classes: set[str], hidden: bool, begin: int) -> None:
        self.tag, self.classes, self.hidden, self.begin, self.end = tag, classes, hidden, begin, -1


class _IssuePage(PageParser):
    """The text of an issue page in pieces, the elements that its record is read from, and the links of its detail blocks."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.page: list[str] = []
        self.found: dict[str, _Element] = {}  # the first element of each kind that matters
        self.links: list[tuple[_Element, _Element, _Element]] = []  # the link, its parent, the outermost detail block around
        self.open: list[_Element] = []

    def handle_starttag(self, tag, attrs):
        known = dict(attrs)
        if tag == "meta":
            name = known.get("property") or known.get("name") or ""
            self.meta.setdefault(name, known.get("content") or "")
        elif tag not in self.VOID:
            classes = set((known.get("class") or "").split())
            hidden = tag in ("script", "style") or "wiki-item-edit" in classes or bool(self.open and self.open[-1].hidden)
            own = _Element(tag, classes, hidden, len(self.page))
            if not hidden and (classes or tag in ("h1", "title")):  # most elements tell nothing
                for kind in {tag} & {"h1", "title"} | classes & {"wiki-descriptor", "js-toc-content", "content-body"}:
                    self.found.setdefault(kind, own)
                if tag == "a" and any(x.tag == "h1" for x in self.open):
                    for kind in classes & {"wiki-title", "wiki-issue-number"}:
                        self.found.setdefault(kind, own)
            self.open.append(own)

    def handle_data(self, data):
        text = data.strip()
        if text and not (self.open and self.open[-1].hidden):
            self.page.append(text)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                own = self.open[k]
                for x in self.open[k:]:
                    x.end = len(self.page)
                del self.open[k:]
                block = next((x for x in self.open if "wiki-details-object" in x.classes), None)
                if tag == "a" and block and not own.hidden:
                    self.links.append((own, self.open[-1], block))
                return

    def pieces(self, x: _Element | None) -> list[str]:
        return [] if x is None else self.page[x.begin : len(self.page) if x.end < 0 else x.end]


_PAGE_TEXTS = {"h1": "h1", "series_link": "wiki-title", "number_link": "wiki-issue-number", "descriptor": "wiki-descriptor", "toc": "js-toc-content", "body": "content-body"}
_METAS = {"og_title": ("og:title", "twitter:title"), "adtags": ("adtags",), "description": ("description", "og:description")}
#: A link tells its parent's text and its outermost detail block by their places in `spans`, each a part of page_text.
ISSUE_PAGE = "page_id long, page_text string, " + ", ".join(f"{c} string" for c in [*_PAGE_TEXTS, *_METAS]) + ", spans array<struct<begin:int,length:int>>, links array<struct<pos:int,name:string,around:int,block:int>>"


def issue_page_texts(pages: DataFrame) -> DataFrame:
    """Columns of ISSUE_PAGE per page (page_id, html): its texts, metas, and the links of its detail blocks.

    The text of a page stands once; links point into it, so that many links in one block
    cost no more than themselves.
    """
    names = [c.split()[0] for c in ISSUE_PAGE.split(", ") if " " in c]

    def flat(pieces: list[str], joint: str = " ") -> str:
        return " ".join(joint.join(pieces).split())

    def row(page: int, html: str | None) -> tuple:
        p = _IssuePage()
        p.feed(html or "")
        lengths = [len(" ".join(x.split())) for x in p.page]
        at = [0]
        for n in lengths:
            at.append(at[-1] + n + 1)
        spans: dict[tuple[int, int], int] = {}

        def place(x: _Element) -> int:
            end = len(p.page) if x.end < 0 else x.end
            key = (at[x.begin], at[end] - at[x.begin] - 1) if end > x.begin else (0, 0)
            return spans.setdefault(key, len(spans))

        links = [{"pos": i, "name": flat(p.pieces(own), ""), "around": place(parent), "block": place(block)} for i, (own, parent, block) in enumerate(p.links)]
        texts = [flat(p.pieces(p.found.get(v)), "" if v in ("wiki-title", "wiki-issue-number") else " ") for v in _PAGE_TEXTS.values()]
        metas = [next((p.meta[k].strip() for k in v if k in p.meta), "") for v in _METAS.values()]
        return (page, flat(p.page), *texts, *metas, [{"begin": b, "length": n} for b, n in spans], links)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([row(page, html) for page, html in zip(b["page_id"], b["html"], strict=True)], columns=names)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInPandas(run, ISSUE_PAGE)


#: The patterns that issue pages are read by.
HEADING = r"^(.+?)\s+#?([0-9]+[a-zA-Z]?|[0-9]+\.[0-9]+|[0-9]+)"
NAMED = r"Issue details\s+Name\s+(.+?)\s+Name\s+Name of this issue"
AFTER_NUMBER = r"#[0-9]+[a-zA-Z]?\s*[:-]\s*(.+?)(?:\s*\(Issue\)|$)"
AFTER_NUMBER_H1 = r"#[0-9]+[a-zA-Z]?\s*[:-]\s*(.+)"
RELEASED_BY = r"(?i)released by\s+(.+?)(?:\s+on|\.|$)"
DATES = [("page_text", r"(?i)In Store Date\s+([A-Za-z]+\s+[0-9]{1,2},?\s+[0-9]{4})"), ("page_text", r"(?i)Cover Date\s+([A-Za-z]+\s+(?:[0-9]{1,2},?\s+)?[0-9]{4})"), ("descriptor", r"(?i)released by\s+.*?\s+on\s+([A-Za-z]+\s+(?:[0-9]{1,2},?\s+)?[0-9]{4})")]
LAST_EDIT = r"^Part [0-9]+ last edited by \S+ on \S+ \S+ View full history"


def issue_records(texts: DataFrame) -> DataFrame:
    """page_id, series, number, title, publisher, year, month, day, summary of issue pages (columns of ISSUE_PAGE).

    Each field takes the first of its sources that says something; a page that says
    nothing of a field leaves it "" or 0.
    """

    def first(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options], F.lit(""))

    t = texts.withColumns(
        {
            "series": first(F.col("series_link"), F.regexp_extract("h1", HEADING, 1)),
            "number": first(F.ltrim(F.col("number_link"), F.lit("#")), F.regexp_extract("h1", HEADING, 2)),
        }
    )
    named = F.trim(F.regexp_extract("page_text", NAMED, 1))
    made = F.when(F.col("number") != "", F.concat("series", F.lit(" #"), "number")).otherwise(F.col("series"))
    title = first(
        F.when(F.lower(named).isin("none", "name"), "").otherwise(named), F.regexp_extract("og_title", AFTER_NUMBER, 1), F.regexp_extract("h1", AFTER_NUMBER_H1, 1), F.when(F.col("series") != "", made)
    )
    publisher = first(F.regexp_extract("descriptor", RELEASED_BY, 1), F.initcap(F.replace(F.regexp_extract("adtags", "publisher=([^&]+)", 1), F.lit("-"), F.lit(" "))))
    date = date_parts(first(*[F.regexp_extract(c, p, 1) for c, p in DATES]))
    content = first(F.col("toc"), F.col("body"))
    summary = F.when(content != "", F.trim(F.regexp_replace(content, LAST_EDIT, ""))).otherwise(F.col("description"))
    return t.select("page_id", "series", "number", title.alias("title"), publisher.alias("publisher"), *[date[k].alias(k) for k in ("year", "month", "day")], summary.alias("summary"))


def _of_block(texts: DataFrame, told: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """page_id, pos, name of the links in detail blocks, with what each function tells of a span's text: around_* and block_*.

    Every span is read once, whatever the number of its links.
    """
    read = F.transform("spans", lambda s: F.struct(*[f(F.substring(F.col("page_text"), s["begin"] + 1, s["length"])).alias(k) for k, f in told.items()]))
    rows = texts.select("page_id", read.alias("_told"), "links").select("page_id", "_told", F.inline("links")).where(F.length("name") > 1)
    both = rows.withColumns({"_a": F.get("_told", F.col("around")), "_b": F.get("_told", F.col("block"))})
    return both.select("page_id", "pos", "name", *[F.col(f"_a.{k}").alias(f"around_{k}") for k in told], *[F.col(f"_b.{k}").alias(f"block_{k}") for k in told])


def creators(texts: DataFrame) -> DataFrame:
    """page_id, role, pos, name of the people in a page's "Creators" blocks.

    The first keyword in the whole text of a link's parent decides the role, in the order
    of ROLES; a name that its role has already goes on to the next role that matches.
    """
    roles = lambda t: F.filter(F.array(*[F.when(F.lower(t).rlike(words), F.lit(role)) for role, words in ROLES]), lambda r: r.isNotNull())
    links_of = _of_block(texts, {"roles": roles, "ours": lambda t: t.rlike("Creators")}).where("block_ours").withColumnRenamed("around_roles", "roles")
    seen = links_of.groupBy("page_id", "name").agg(F.sort_array(F.collect_list(F.struct("pos", "roles"))).alias("seen"))  # one name's links on one page

    def take(got: Column, x: Column) -> Column:
        free = F.get(F.filter(x["roles"], lambda r: ~F.exists(got, lambda g: g["role"] == r)), F.lit(0))
        return F.when(free.isNull(), got).otherwise(F.concat(got, F.array(F.struct(free.alias("role"), x["pos"].alias("pos")))))

    got = F.aggregate("seen", F.array().cast("array<struct<role:string,pos:int>>"), take)
    return seen.select("page_id", "name", F.inline(got)).select("page_id", "role", "pos", "name")


#: Headings of the blocks of other names, and links that name nothing.
BLOCKS = {"characters": "Characters", "teams": "Teams", "story_arcs": "Story Arcs?"}
NO_NAME = ["none", "add", "this issue"]


def page_names(texts: DataFrame) -> DataFrame:
    """page_id, kind (characters, teams, story_arcs), pos, name: each name once per kind, at its first link."""
    kinds = lambda t: F.filter(F.array(*[F.when(t.rlike(pattern), F.lit(kind)) for kind, pattern in BLOCKS.items()]), lambda k: k.isNotNull())
    out = _of_block(texts, {"kinds": kinds}).select("page_id", "pos", "name", F.explode("block_kinds").alias("kind"))
    bare = F.when(F.col("kind") == "story_arcs", F.regexp_replace("name", "^[\"']+|[\"']+$", "")).otherwise(F.col("name"))
    kept = out.withColumn("name", bare).where(~F.lower("name").isin(NO_NAME) & (F.length("name") > 1))
    return kept.groupBy("page_id", "kind", "name").agg(F.min("pos").alias("pos"))


def search_results(page_links: DataFrame) -> DataFrame:
    """Volumes and issues among the links: kind from the url, first year and number of issues from the text around."""
    kind = F.when(F.col("href").contains("/4050-"), "Volume").when(F.col("href").contains("/4000-"), "Issue")
    year = F.coalesce(F.regexp_extract("around", r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int"), F.lit(0))
    count = F.coalesce(F.regexp_extract("around", r"\(([0-9]+) issues?\)", 1).try_cast("int"), F.lit(0))
    return page_links.select("page_id", "href", "name", kind.alias("kind"), year.alias("year"), count.alias("n_issues"), F.substring("around", 1, 160).alias("description")).where("kind is not null")


#: Spellings of an issue number, and the text of a range of issues.
NUMBER = r"[0-9]+½|[0-9]+/[0-9]+|[0-9]+\.[0-9]+|[0-9]+[a-zA-Z]?|½|0\.5"
RANGE = r"\(#?[0-9]+\s*[-–]\s*[0-9]+\)|#[0-9]+\s*[-–]\s*[0-9]+"
MOST_PAGES = 50


def volume_issues(pages: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """volume_id, number, url, label: the issues that a volume's pages (volume_id, page_no, slug, html) list.

    The number stands in the text around a link, else in its label; entries that name a
    range and issues of other series (by slug; a blank slug accepts all) are left out.  Of
    a number the first link counts, by page and place.  Pages after `most_pages` are not read.
    """
    wanted = pages.where(F.col("page_no").between(1, most_pages)).withColumn("page_id", F.xxhash64("volume_id", "page_no"))
    keys = wanted.select("page_id", "volume_id", "page_no", "slug").distinct()
    rows = page_parts(wanted).where((F.col("tag") == "a") & F.col("href").rlike("/4000-[0-9]+")).join(keys, "page_id")
    around = F.when(F.col("around") != "", F.col("around")).otherwise(F.col("text"))
    found = [F.regexp_extract(around, f"(?i)#(?:Issue\\s*)?({NUMBER})", 1), F.regexp_extract(around, f"(?i)Issue\\s*#?\\s*({NUMBER})", 1), F.regexp_extract("text", f"#({NUMBER})", 1)]
    number = F.coalesce(*[F.nullif(x, F.lit("")) for x in found])
    slug = F.regexp_extract("href", r"/([^/]+)/4000-", 1)
    own = (F.col("slug") == "") | (slug == "") | slug_belongs(slug, F.col("slug"))
    kept = rows.where(~around.rlike(RANGE) & own).withColumn("number", number).where("number is not null")
    return first_by(kept, ["volume_id", "number"], ["page_no", "pos"]).select("volume_id", "number", F.col("href").alias("url"), F.col("text").alias("label"))


def reading_entries(parts: DataFrame) -> DataFrame:
    """page_id, place (from 1), series, number, title, url: the issues of reading-order pages, in order.

    Links that edit, cover, view or add something are left out; a url counts once.
    """
    named = parts.where("tag = 'a' and text <> ''").withColumnRenamed("text", "name")
    kept = named.where(F.col("href").contains("/4000-") & ~F.lower("name").rlike("^(?:edit|cover|view|add)"))
    kept = first_by(kept, ["page_id", "href"], ["pos"])
    series = F.coalesce(F.nullif(F.trim(F.regexp_extract("name", r"^(.+?)\s+#", 1)), F.lit("")), F.col("name"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return kept.select("page_id", place.alias("place"), series.alias("series"), F.regexp_extract("name", r"#([0-9]+[a-zA-Z]?)", 1).alias("number"), F.col("name").alias("title"), F.col("href").alias("url"))
