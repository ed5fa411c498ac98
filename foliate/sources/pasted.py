"""Records out of catalog pages as people paste them: copied text, or the page's HTML.

Copied text: urls on lines of their own give web; of the other lines the first is the title,
which gives series and number; publisher and year stand before the word Series, a date names
a month or season; labelled lines give creators, genre and characters, all lines of a label
alike.  "None", blanks and repeats are dropped.  HTML gives series, number and title by its
title and heading, publisher and year by its text; a page without a series is read as text.

White space and digits are those of ASCII; a null text counts as empty and gives blanks.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import MONTHS

# Labels of lines by field, seasons, the title of a page without an issue, and what publishers look like.
LABELLED = {"writers": ["Script", "Writer"], "pencillers": ["Pencils", "Penciller"], "inkers": ["Inks", "Inker"], "colorists": ["Colors", "Colorist"], "letterers": ["Letters", "Letterer"]}
SEASONS = ["summer", "winter", "spring", "fall"]
EMPTY_PAGE = "Grand Comics Database Issue"
NUMBERED = r"^(.*?\S)\s++#?([0-9]+[a-zA-Z]?|[0-9]+\.[0-9]+|[0-9]+|\[[^\]]+\])"
PAGE_TITLE = r"(?i)GCD\s*::\s*Issue\s*::\s*(.+?)(?:\s*#\s*(.*))?$"

SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def name_form(c: Column) -> Column:
    """A creator's name without remarks in brackets, closed or not, and question marks around it."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?<!\s)\s*+\([^)]*\)", ""), r"(?<!\s)\s*+\([^)]*$", "")
    return strip(F.btrim(strip(bare), F.lit("?")))


class _Texts(HTMLParser):
    """Stripped pieces of a page's text, of its first heading and of its title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page: list[str] = []
        self.own: dict[str, list[str]] = {}
        self.open: dict[str, bool] = {}
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "template"):
            self.silent += 1
        if tag in ("h1", "title") and tag not in self.own:
            self.own[tag], self.open[tag] = [], True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template"):
            self.silent = max(0, self.silent - 1)
        self.open[tag] = False

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if piece and not self.silent:
            self.page.append(piece)
            for tag, pieces in self.own.items():
                if self.open.get(tag):
                    pieces.append(piece)


def _page_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for html in b["_text"]:
            p = _Texts()
            p.feed(html)
            p.close()
            out.append((" ".join(p.own.get("h1", [])), " ".join(p.own.get("title", [])), " ".join(p.page)))
        yield pd.concat([b.reset_index(drop=True), pd.DataFrame(out, columns=["_h1", "_head", "_page"])], axis=1)


def _publisher(page: Column, gap: str) -> tuple[Column, Column]:
    """What stands before ", 1999 Series", and the year (null without)."""
    # matches begin where a run of letters, digits and spaces does, so long runs are read once
    pattern = rf"(?<![A-Za-z0-9\s])([A-Za-z0-9\s]++),{gap}([0-9]{{4}})\s+Series"
    return strip(F.regexp_extract(page, pattern, 1)), F.regexp_extract(page, pattern, 2).try_cast("int")


def _from_text(rows: DataFrame, key: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("_text", "\n"), strip), lambda x: x != "")
    url = lambda x: x.startswith("http://") | x.startswith("https://")
    r = rows.withColumn("_lines", lines)
    r = r.withColumns({"_urls": F.filter("_lines", url), "_clean": F.filter("_lines", lambda x: ~url(x))})
    r = r.withColumns({"_title": F.coalesce(F.get("_clean", F.lit(0)), F.lit("")), "_page": F.array_join("_clean", "\n")})
    named, year = _publisher(F.col("_page"), r"\s+")
    dated = rf"(?i)\b({'|'.join([*MONTHS, *SEASONS])})\s+([0-9]{{4}})\b"
    month = F.lower(F.regexp_extract("_page", dated, 1))
    series = strip(F.regexp_extract("_title", NUMBERED, 1))

    def after(label: str) -> Column:
        """What follows a label on each of its lines."""
        return F.transform(F.filter("_clean", lambda x: x.startswith(f"{label}:")), lambda x: F.substring(x, len(label) + 2, 1 << 30))

    def listed(labels: list[str], cut: str, least: int = 1) -> Column:
        """Lines of several labels keep the order in which they stand."""
        hit = lambda x: F.coalesce(*[F.when(x.startswith(f"{v}:"), F.substring(x, len(v) + 2, 1 << 30)) for v in labels])
        told = F.filter(F.transform("_clean", hit), lambda x: x.isNotNull())
        items = F.transform(F.flatten(F.transform(told, lambda x: F.split(x, cut))), name_form)
        kept = F.filter(items, lambda x: (F.length(x) >= least) & (F.lower(x) != "none"))
        return F.array_join(F.array_distinct(kept), "; ")

    return r.select(
        key,
        F.col("_title").alias("title"),
        F.when(series != "", series).otherwise(F.col("_title")).alias("series"),
        strip(F.regexp_extract("_title", NUMBERED, 2)).alias("number"),
        strip(F.element_at(F.split(named, "\n"), -1)).alias("publisher"),
        F.coalesce(F.nullif(year, F.lit(0)), F.regexp_extract("_page", dated, 2).try_cast("int"), F.lit(0)).alias("year"),
        F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month), F.lit(0)), F.lit(0)).cast("int").alias("month"),
        F.coalesce(F.get("_urls", F.lit(0)), F.lit("")).alias("web"),
        strip(F.coalesce(F.get(F.slice(after("Genre"), -1, 1), F.lit(0)), F.lit(""))).alias("genre"),
        *[listed(v, "[,;]+").alias(k) for k, v in LABELLED.items()],
        listed(["Characters"], "[;\n]+", 2).alias("characters"),
    )


def pasted_records(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, title, series, number, publisher, year, month, web, genre, five lists of creators and characters ("; " between items).

    Of a page of text the last label Genre counts; years and months that are not told are 0.
    """
    given = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    low = F.lower("_text")
    html = low.contains("<html") | low.contains("<body") | low.contains("<title>")
    kind = dict(rows.dtypes)[key]
    pages = given.where(html).mapInPandas(_page_texts, f"`{key}` {kind}, _text string, _h1 string, _head string, _page string")
    titled = strip(F.regexp_extract("_head", PAGE_TITLE, 1))
    has = F.regexp_extract("_head", PAGE_TITLE, 0) != ""
    pages = pages.withColumns({"series": F.when(has, titled).otherwise(F.col("_h1")), "number": F.when(has, strip(F.regexp_extract("_head", PAGE_TITLE, 2))).otherwise("")})
    pages = pages.withColumn("_own", (F.col("series") != "") & (F.col("series") != EMPTY_PAGE))
    named, year = _publisher(F.col("_page"), r"\s*")
    title = F.when(F.col("number") != "", F.concat("series", F.lit(" #"), "number")).otherwise(F.col("series"))
    own = pages.where("_own").select(
        key, title.alias("title"), "series", "number", F.regexp_extract(named, r"(\S+)$", 1).alias("publisher"), F.coalesce(year, F.lit(0)).alias("year"), F.lit(0).alias("month"), F.lit("").alias("web"), F.lit("").alias("genre"),
        *[F.lit("").alias(k) for k in (*LABELLED, "characters")],
    )
    as_text = given.where(~html).unionByName(pages.where("not _own").select(key, "_text"))
    return _from_text(as_text, key).unionByName(own)
