"""Archive files and their embedded XML records."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = "Title string, Series string, Number string, Volume string, Summary string, Notes string, Publisher string, Genre string, Web string, LanguageISO string, Format string, Count string, Year string, Month string, Day string, Writer string, Penciller string, Inker string, Colorist string, Letterer string, CoverArtist string, Characters string, Teams string, StoryArc array<string>, Storyarc2 array<string>, StoryArcNumber array<string>, _corrupt_record string"
LISTS = {"writers": "Writer", "pencillers": "Penciller", "inkers": "Inker", "colorists": "Colorist", "letterers": "Letterer", "cover_artists": "CoverArtist", "characters": "Characters", "teams": "Teams"}
TEXTS = {"title": "Title", "series": "Series", "number": "Number", "volume": "Volume", "summary": "Summary", "notes": "Notes", "publisher": "Publisher", "genre": "Genre", "web": "Web", "language": "LanguageISO", "format": "Format"}


def scan_library(spark: SparkSession, roots: list[str], recursive: bool = True, content: bool = True) -> DataFrame:
    """Archives under the roots: path, size, modified, content.  Overlapping roots give each path once."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    found = reader.load(roots).where(F.lower("path").rlike(r"\.cb[zr]$"))
    out = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.dropDuplicates(["path"])


def fingerprint(files: DataFrame) -> DataFrame:
    """path, size, mtime (seconds), sha256 and type; the content goes no further."""
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return files.select("path", "size", F.unix_timestamp("modified").alias("mtime"), F.sha2("content", 256).alias("sha256"), kind.alias("archive_type"))


def read_entries(files: DataFrame) -> DataFrame:
    """A row per archive entry: path, entry (lower case), crc, size, sha256, record (text of ComicInfo.xml), error.

    An unreadable archive gives one row with its error.
    """
    names = ["path", "entry", "crc", "size", "sha256", "record", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told, size = [], 0  # of many archives, cut at about a million characters of records or 10,000 entries
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                data = z.read(i)
                                own = i.filename.lower() == "comicinfo.xml"
                                rows.append((path, i.filename.lower(), i.CRC, i.file_size, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace") if own else None, None))
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as e:
                    rows = [(path, None, None, None, None, None, str(e) or type(e).__name__)]
                told += rows
                size += sum(len(r[5] or "") for r in rows)
                if size > 1 << 20 or len(told) >= 10_000:
                    yield pd.DataFrame(told, columns=names)
                    told, size = [], 0
            if told:
                yield pd.DataFrame(told, columns=names)

    return files.select("path", "content").mapInPandas(run, "path string, entry string, crc long, size long, sha256 string, record string, error string")


#: A simple element: its tag and its text.
EXTRA = r"<([A-Za-z_][A-Za-z0-9_.-]*)(?:\s[^<>]*)?>([^<>]*)</\1>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]
KNOWN_TAGS = [*TEXTS.values(), "LanguageISOCode", "Count", "Year", "Month", "Day", *LISTS.values(), "StoryArc", "Storyarc", "StoryArcNumber"]


def _unescaped(c: Column) -> Column:
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.trim(c)


def _escaped(c: Column) -> Column:
    for entity, plain in reversed(ENTITIES[:2] + ENTITIES[4:]):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def _list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def parse_record(rows: DataFrame, xml: str = "record") -> DataFrame:
    """Columns of the embedded record; malformed is true where the XML cannot be read.

    Year, month and day are read in turn: the first bad one stops the rest.  extras maps
    the tags of simple elements that no column stands for to their text.
    """
    x = F.from_xml(F.col(xml), RECORD_SCHEMA, {"rowTag": "ComicInfo", "columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    out = rows.withColumn("_x", x)
    texts = {k: F.coalesce(F.col(f"_x.{v}"), F.lit("")) for k, v in TEXTS.items()}
    lists = {k: _list(F.col(f"_x.{v}")) for k, v in LISTS.items()}
    y, m, d = [F.col(f"_x.{c}").try_cast("int") for c in ("Year", "Month", "Day")]
    bad = lambda c, v: F.col(f"_x.{c}").isNotNull() & v.isNull()
    dates = {
        "year": F.coalesce(y, F.lit(0)),
        "month": F.when(bad("Year", y), 0).otherwise(F.coalesce(m, F.lit(0))),
        "day": F.when(bad("Year", y) | bad("Month", m), 0).otherwise(F.coalesce(d, F.lit(0))),
        "count": F.when(F.col("_x.Count").isNull(), None).otherwise(F.coalesce(F.col("_x.Count").try_cast("int"), F.lit(1))),
    }
    arcs = lambda c: F.filter(F.flatten(F.transform(F.coalesce(F.col(f"_x.{c}"), F.array().cast("array<string>")), lambda t: F.transform(F.split(t, ","), lambda p: F.trim(p)))), lambda p: p != "")
    # columns of their own, so that no element reads the whole text again
    out = out.withColumn("_simple", F.regexp_extract_all(F.col(xml), F.lit(EXTRA), F.lit(0)))
    tag = lambda e: F.regexp_extract(e, "^<([A-Za-z_][A-Za-z0-9_.-]*)", 1)
    own = lambda e: _unescaped(F.substring_index(F.substring_index(e, "</", 1), ">", -1))
    out = out.withColumn("_tags", F.transform(F.filter("_simple", lambda e: ~tag(e).isin(KNOWN_TAGS)), lambda e: F.struct(tag(e).alias("k"), own(e).alias("v"))))
    out = out.withColumn("_tags", F.filter("_tags", lambda e: e["v"] != ""))
    out = out.withColumn("_last_first", F.reverse(F.transform("_tags", lambda e: e["k"])))
    last = F.filter("_tags", lambda e, i: F.array_position("_last_first", e["k"]) == F.size("_tags") - i)
    readable = F.col("_x._corrupt_record").isNull() & F.col(xml).isNotNull()
    made = {"extras": F.map_from_entries(F.when(readable, last).otherwise(F.array().cast("array<struct<k:string,v:string>>")))}
    made |= {"story_arcs": arcs("StoryArc"), "story_arc_numbers": arcs("StoryArcNumber"), "malformed": F.col(xml).isNotNull() & F.col("_x._corrupt_record").isNotNull()}
    return out.withColumns(texts | lists | dates | made).drop("_x", "_simple", "_tags", "_last_first")


def write_record(rows: DataFrame, to: str = "record") -> DataFrame:
    """Add the record's XML: tags in fixed order, empty ones left out, roles joined by "; ", other lists by ", "."""

    def filled(c: str, joint: str | None = None) -> Column:
        v = F.col(c) if joint is None else F.array_join(c, joint)
        return F.nullif(v.cast("string"), F.lit(""))

    fields = [filled(k).alias(v) for k, v in TEXTS.items()]
    fields += [F.nullif(F.col(c), F.lit(0)).cast("string").alias(c.title()) for c in ("count", "year", "month", "day")]
    fields += [filled(k, ", " if k in ("characters", "teams") else "; ").alias(v) for k, v in LISTS.items()]
    fields += [filled("story_arcs", ", ").alias("StoryArc"), filled("story_arc_numbers", ", ").alias("StoryArcNumber")]
    xml = F.to_xml(F.struct(*fields), {"rowTag": "ComicInfo"})
    if "extras" in rows.columns:  # simple elements that no column stands for
        kept = F.filter(F.sort_array(F.map_entries("extras")), lambda e: (e["value"] != "") & ~e["key"].isin(KNOWN_TAGS))
        lines = F.transform(kept, lambda e: F.concat(F.lit("    <"), e["key"], F.lit(">"), _escaped(e["value"]), F.lit("</"), e["key"], F.lit(">\n")))
        xml = F.when(F.size(kept) == 0, xml).otherwise(F.concat(F.regexp_replace(xml, "</ComicInfo>\\s*$", ""), F.array_join(lines, ""), F.lit("</ComicInfo>")))
    return rows.withColumn(to, xml)


def pack_archives(entries: DataFrame) -> DataFrame:
    """Archives (path, content) out of rows (path, entry, data): a zip of each path's entries, in the order of their names.

    An archive's entries fit one task, as the archive itself does.
    """

    def packed(entries: list) -> bytes:
        to = io.BytesIO()
        with zipfile.ZipFile(to, "w") as z:
            for e in sorted(entries, key=lambda e: e["entry"]):
                z.writestr(zipfile.ZipInfo(e["entry"], (2000, 1, 1, 0, 0, 0)), e["data"])
        return to.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths, contents, size = [], [], 0
            for path, entries in zip(b["path"], b["entries"], strict=True):
                paths.append(path)
                contents.append(packed(entries))
                size += len(contents[-1])
                if size > 1 << 26:
                    yield pd.DataFrame({"path": paths, "content": contents})
                    paths, contents, size = [], [], 0
            if paths:
                yield pd.DataFrame({"path": paths, "content": contents})

    gathered = entries.groupBy("path").agg(F.collect_list(F.struct("entry", "data")).alias("entries"))
    return gathered.mapInPandas(run, "path string, content binary")
