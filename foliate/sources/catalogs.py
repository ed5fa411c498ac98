"""Catalog tables out of JSON payloads, and report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.text import creator_form, text

VOLUME = "id long, title string, name string, year string, publisher string, issues array<struct<id:long,issue_number:string,number:string,title:string,date:string>>"


def _either(a: Column, b: Column) -> Column:
    """The first that is not blank."""
    return F.when(text(a) != "", a).otherwise(text(b))


def volumes(rows: DataFrame, data: str = "data") -> DataFrame:
    """A row per issue of each volume: volume and issue ids, names, year (only if all digits), number without "#".

    A payload that cannot be read gives no rows.
    """
    v = rows.withColumn("_v", F.from_json(F.col(data), VOLUME)).where(F.col("_v.id").isNotNull())
    v = v.withColumn("_i", F.explode_outer("_v.issues"))
    number = F.regexp_replace(_either(F.col("_i.issue_number"), F.col("_i.number")), "#", "")
    year = F.when(F.col("_v.year").rlike("^[0-9]+$"), F.col("_v.year").try_cast("int")).otherwise(0)
    return v.select(
        *[c for c in rows.columns if c != data],
        F.col("_v.id").alias("volume_id"),
        _either(F.col("_v.title"), F.col("_v.name")).alias("series"),
        F.coalesce(year, F.lit(0)).alias("year"),
        F.col("_i.id").alias("issue_id"),
        F.trim(number).alias("number"),
        text(F.col("_i.title")).alias("title"),
        text(F.col("_i.date")).alias("date"),
    )


def issue_index(issues: DataFrame, order: str) -> DataFrame:
    """One row per issue id; the last volume that holds it wins."""
    last = F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc(order)))
    return issues.where("issue_id is not null").withColumn("_rn", last).where("_rn = 1").drop("_rn")


def issue_record(issues: DataFrame) -> DataFrame:
    """A metadata record per issue: title (or series and number), year from its date or its volume, a note of its id."""
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat("series", F.lit(" #"), "number"))
    dated = F.regexp_extract("date", r"((?:19|20)[0-9]{2})", 1).try_cast("int")
    return issues.select("issue_id", "series", "number", title.alias("title"), F.coalesce(dated, "year").alias("year"), F.concat(F.lit("ComicVine ID: "), "issue_id").alias("notes"))


def review_reports(decisions: DataFrame) -> DataFrame:
    """name and markdown text of a report per file; write with .write.text or as a table."""
    lines = [
        F.concat(F.lit("# Review of "), F.element_at(F.split("path", "/"), -1)),
        F.concat(F.lit("- Best: "), F.coalesce("series_name", F.lit("none")), F.lit(" #"), F.coalesce("issue_number", F.lit(""))),
        F.format_string("- Score: %.1f (%s)", F.coalesce("score", F.lit(0.0)), F.col("level")),
    ]
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return decisions.select("file_id", F.concat(F.lit("review_"), stem, F.lit(".md")).alias("name"), F.concat_ws("\n", *lines).alias("report"))


RELATED = {
    "issue": "id long, number string, title string, publication_date string, notes string, series_id long, story_set array<struct<writer:string,penciler:string,inker:string,colorist:string,characters:string>>",
    "series": "id long, name string, publisher_id long",
    "publisher": "id long, name string",
}


def related_records(issues: DataFrame, series: DataFrame, publishers: DataFrame, data: str = "data") -> DataFrame:
    """A record per issue of a relational catalog: issue, its series, the series' publisher, its stories' people.

    Each table holds JSON in `data`.  People are split on commas and semicolons, characters
    on semicolons; each list keeps its order and drops repeats.  Payloads without an id give
    no row; missing series and publishers leave blanks; of a repeated id one row counts.
    """

    def read(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(F.from_json(F.col(data), RELATED[kind]).alias("r")).where("r.id is not null").select("r.*")

    s = read(series, "series").groupBy(F.col("id").alias("series_id")).agg(F.min(F.struct("name", "publisher_id")).alias("s"))
    p = read(publishers, "publisher").groupBy(F.col("id").alias("publisher_id")).agg(F.min("name").alias("publisher"))
    known = s.select("series_id", F.col("s.name").alias("series"), F.col("s.publisher_id").alias("publisher_id")).join(p, "publisher_id", "left")
    i = read(issues, "issue").join(known, "series_id", "left")
    number = F.regexp_replace(F.trim(text(F.col("number"))), "^#+", "")
    series_name = text(F.col("series"))
    named = F.when(number != "", F.concat(series_name, F.lit(" #"), number)).otherwise(series_name)

    def people(field: str, cut: str) -> Column:
        told = F.transform(F.coalesce(F.col("story_set"), F.array()), lambda x: F.coalesce(x[field], F.lit("")))
        names = F.transform(F.flatten(F.transform(told, lambda x: F.split(x, cut))), lambda x: creator_form(x))
        return F.array_join(F.array_distinct(F.filter(names, lambda x: x != "")), "; ")

    return i.select(
        F.col("id").alias("issue_id"),
        series_name.alias("series"),
        number.alias("number"),
        F.when(text(F.col("title")) != "", F.col("title")).otherwise(named).alias("title"),
        text(F.col("publisher")).alias("publisher"),
        F.coalesce(F.regexp_extract(text(F.col("publication_date")), r"\b(19[0-9]{2}|20[0-9]{2})\b", 1).try_cast("int"), F.lit(0)).alias("year"),
        text(F.col("notes")).alias("summary"),
        people("writer", "[,;]+").alias("writers"),
        people("penciler", "[,;]+").alias("pencillers"),
        people("inker", "[,;]+").alias("inkers"),
        people("colorist", "[,;]+").alias("colorists"),
        people("characters", ";+").alias("characters"),
    )


#: Columns of any catalog that pools take candidates from.
CANDIDATE = {"issue_id": "string", "series_id": "string", "series_name": "string", "issue_number": "string", "publication_year": "int", "publisher": "string", "volume": "string"}


def as_catalog(rows: DataFrame, provider: str, columns: dict[str, str]) -> DataFrame:
    """Any table as a catalog: the columns of CANDIDATE under the provider's name, and reason.

    `columns` names the table's column for each of them; others are blank.  Values that do
    not cast are missing.  reason tells why a row cannot be a candidate ("" if it can).
    """

    def value(c: str, kind: str) -> Column:
        own = F.col(columns[c]).try_cast(kind) if c in columns else F.lit(None).cast(kind)
        return F.coalesce(own, F.lit(0)) if kind == "int" else text(own)

    out = rows.select(F.lit(provider).alias("provider"), *[value(c, k).alias(c) for c, k in CANDIDATE.items()])
    reason = F.when((F.col("series_name") == "") & (F.col("issue_number") == ""), "no identity").when((F.col("issue_id") == "") & (F.col("series_id") == ""), "no id").otherwise("")
    return out.withColumn("reason", reason)


def lookup(catalog: DataFrame, asked: DataFrame, key: str = "issue_id") -> DataFrame:
    """The catalog's rows of the ids that are asked for."""
    return catalog.where(F.col(key) != "").join(asked.select(key).distinct(), key, "left_semi")


def search(catalog: DataFrame, query: str) -> DataFrame:
    """The catalog's rows whose series holds the query; a blank query finds nothing."""
    q = query.strip().lower()
    return catalog.where(F.lower("series_name").contains(q) if q else F.lit(False))


def search_issues(issues: DataFrame, query: str) -> DataFrame:
    """Issues whose title, "issue n" or "#n" holds the query; untitled ones are shown as "Issue #n"."""
    q = query.strip().lower()
    n = F.lower(text(F.col("number")))
    hit = F.lower("title").contains(q) | F.concat(F.lit("issue "), n).contains(q) | F.concat(F.lit("#"), n).contains(q)
    shown = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("Issue #"), "number"))
    return issues.where(hit if q else F.lit(False)).withColumn("shown", shown)


#: The parts of a federated search (provider, type, label) and the search types that ask each.
PARTS = {
    "kapowarr_volume": ("Kapowarr", "kapowarr_volume", "Kapowarr Volume", ["all", "kapowarr", "kapowarr_volume"]),
    "kapowarr_issue": ("Kapowarr", "kapowarr_issue", "Kapowarr Issue", ["all", "kapowarr", "kapowarr_issue"]),
    "cv_volume": ("CV", "cv_volume", "CV Series", ["all", "scrapers", "cv_volume"]),
    "cv_issue": ("CV", "cv_issue", "CV Issue", ["all", "scrapers", "cv_issue"]),
    "gcp": ("GCP", "gcp_issue", "GCP Issue", ["all", "scrapers", "gcp_volume", "gcp_issue"]),
}


def federated_search(found: dict[str, DataFrame], kind: str = "all") -> DataFrame:
    """Results (title, url) of the catalogs that a search of this kind asks, with provider, type, type_label and place of the catalog."""
    out = None
    for place, (part, (provider, name, label, kinds)) in enumerate(PARTS.items()):
        if kind in kinds and part in found:
            rows = found[part].select("title", "url", F.lit(provider).alias("provider"), F.lit(name).alias("type"), F.lit(label).alias("type_label"), F.lit(place).alias("place"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no catalog answers a search of type {kind!r}")
    return out
