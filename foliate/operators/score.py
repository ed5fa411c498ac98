"""Weighted evidence and typed conflicts between a candidate and a parsed file name.

A row is a pair: the candidate's columns (provider, issue_id, series_id, series_name,
issue_number, publication_year, publisher, volume) and the file's, prefixed by f_.
Normal forms are computed once as columns, so scoring is plain arithmetic on them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.numbers import unpadded
from foliate.functions.text import text, title_form

COLLECTED_TITLES = ["tpb", "trade paperback", "omnibus", "compendium", "masterworks", "collection", "deluxe edition", "graphic novel"]


@dataclass(frozen=True)
class Weights:
    existing: float = 100.0
    kapowarr: float = 90.0
    issue_id: float = 20.0
    series_id: float = 15.0
    agreement: float = 15.0
    number: float = 30.0
    other_number: float = -60.0
    other_format: float = -50.0
    series: float = 25.0
    series_prefix: float = 15.0
    other_series: float = -50.0
    year: float = 15.0
    next_year: float = 5.0
    other_year: float = -50.0
    publisher: float = 15.0
    other_publisher: float = -25.0


def pair_forms(pairs: DataFrame) -> DataFrame:
    """Add the normal forms that scoring compares: _t, _ft, _n, _fn, _p, _fp, and _xt, _xn of the embedded record."""
    return pairs.withColumns(
        {
            "_xt": title_form(_existing_series("x_")),
            "_xn": unpadded(F.col("x_number")),
            "_t": title_form(F.col("series_name")),
            "_ft": title_form(F.col("f_series_name")),
            "_n": unpadded(F.col("issue_number")),
            "_fn": unpadded(F.col("f_issue_number")),
            "_p": title_form(F.col("publisher")),
            "_fp": title_form(F.col("f_publisher")),
        }
    )


def _both(a: str, b: str) -> Column:
    return (text(F.col(a)) != "") & (text(F.col(b)) != "")


def _prefix() -> Column:
    return F.col("_t").startswith(F.col("_ft")) | F.col("_ft").startswith(F.col("_t"))


def terms(w: Weights = Weights(), agreement: Column | None = None) -> dict[str, Column]:
    """Score of each kind of evidence, 0 where it says nothing.  agreement: number of agreeing providers."""
    zero = F.lit(0.0)
    low = F.lower(text(F.col("series_name")))
    collected = reduce(lambda a, k: a | low.contains(k), COLLECTED_TITLES, F.lit(False))
    gap = F.abs(F.col("publication_year") - F.col("f_year"))
    has_id = (text(F.col("issue_id")) != "") | (text(F.col("series_id")) != "")
    return {
        "source": F.when(F.col("provider") == "ExistingXML", w.existing)
        .when((F.col("provider") == "Kapowarr") & has_id, w.kapowarr)
        .when(text(F.col("issue_id")) != "", w.issue_id)
        .when(text(F.col("series_id")) != "", w.series_id)
        .otherwise(zero),
        "agreement": zero if agreement is None else F.when(agreement >= 2, w.agreement).otherwise(zero),
        "issue_number": F.when(_both("issue_number", "f_issue_number"), F.when(F.col("_n") == F.col("_fn"), w.number).otherwise(w.other_number)).otherwise(zero),
        "format": F.when(F.col("f_is_tpb") & ~collected & (text(F.col("issue_number")) != ""), w.other_format)
        .when(~F.col("f_is_tpb") & collected, w.other_format)
        .otherwise(zero),
        "series_name": F.when(
            (F.col("_t") != "") & (F.col("_ft") != ""),
            F.when(F.col("_t") == F.col("_ft"), w.series).when(_prefix(), w.series_prefix).otherwise(w.other_series),
        ).otherwise(zero),
        "year": F.when(
            (F.col("publication_year") > 0) & (F.col("f_year") > 0), F.when(gap == 0, w.year).when(gap == 1, w.next_year).otherwise(w.other_year)
        ).otherwise(zero),
        "publisher": F.when(_both("publisher", "f_publisher"), F.when(F.col("_p") == F.col("_fp"), w.publisher).otherwise(w.other_publisher)).otherwise(zero),
    }


def score(parts: dict[str, Column]) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), reduce(lambda a, b: a + b, parts.values())))


def positive(parts: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.greatest(p, F.lit(0.0)) for p in parts.values()])


def evidence(parts: dict[str, Column]) -> Column:
    """array<struct<field, score>> of the evidence that says something."""
    told = [F.when(p != 0, F.struct(F.lit(k).alias("field"), p.cast("double").alias("score"))) for k, p in parts.items()]
    return F.filter(F.array(*told), lambda x: x.isNotNull())


def conflict(kind: str, severity: str | Column, when: Column, a: Column, b: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(
        when, F.struct(F.lit(kind).alias("type"), level.alias("severity"), a.cast("string").alias("source_a"), b.cast("string").alias("source_b"))
    )


def present(*conflicts: Column) -> Column:
    return F.filter(F.array(*conflicts), lambda x: x.isNotNull())


def conflicts() -> Column:
    """Typed conflicts between candidate and file."""
    n, fn = F.ltrim(F.trim(text(F.col("issue_number"))), F.lit("0")), F.ltrim(F.trim(text(F.col("f_issue_number"))), F.lit("0"))
    variant = F.regexp_replace(n, "[A-Z]+$", "") == F.regexp_replace(fn, "[A-Z]+$", "")
    numbers = _both("issue_number", "f_issue_number") & (n != fn)
    gap = F.abs(F.col("publication_year") - F.col("f_year"))
    years = (F.col("publication_year") > 0) & (F.col("f_year") > 0) & (gap > 1)
    volume, f_volume = F.trim(F.lower(text(F.col("volume")))), F.trim(F.lower(text(F.col("f_volume"))))
    return present(
        conflict(
            "series_conflict",
            F.when(_prefix(), "ERROR").otherwise("FATAL"),
            (F.col("_t") != "") & (F.col("_ft") != "") & (F.col("_t") != F.col("_ft")),
            F.col("f_series_name"),
            F.col("series_name"),
        ),
        conflict("year_conflict", F.when(gap >= 5, "FATAL").otherwise("ERROR"), years, F.col("f_year"), F.col("publication_year")),
        conflict("variant_conflict", "WARNING", numbers & variant, F.col("f_issue_number"), F.col("issue_number")),
        conflict("issue_number_conflict", "FATAL", numbers & ~variant, F.col("f_issue_number"), F.col("issue_number")),
        conflict("volume_conflict", "ERROR", _both("volume", "f_volume") & (volume != f_volume), F.col("f_volume"), F.col("volume")),
        conflict("publisher_conflict", "WARNING", _both("publisher", "f_publisher") & (F.col("_p") != F.col("_fp")), F.col("f_publisher"), F.col("publisher")),
    )


def existing_conflicts(ex: str = "x_") -> Column:
    """Conflicts between an embedded record (columns prefixed by `ex`) and the file name."""
    t = F.col("_xt")
    number, year = F.col(f"{ex}number"), F.coalesce(F.col(f"{ex}year"), F.lit(0))
    return present(
        conflict("xml_filename_conflict", "ERROR", _both(f"{ex}number", "f_issue_number") & (F.col("_xn") != F.col("_fn")), F.col("f_issue_number"), number),
        conflict("xml_filename_conflict", "ERROR", (t != "") & (F.col("_ft") != "") & (t != F.col("_ft")), F.col("f_series_name"), _existing_series(ex)),
        conflict("xml_filename_conflict", "ERROR", (year > 0) & (F.col("f_year") > 0) & (F.abs(year - F.col("f_year")) >= 2), F.col("f_year"), year),
    )


def existing_candidate_conflicts(ex: str = "x_") -> Column:
    """Conflicts between an embedded record and a candidate of another provider."""
    t = F.col("_xt")
    number, year, known = F.col(f"{ex}number"), F.coalesce(F.col(f"{ex}year"), F.lit(0)), F.trim(text(F.col(f"{ex}provider_id")))
    other = F.col("provider") != "ExistingXML"
    issue_id = F.trim(text(F.col("issue_id")))
    ids = (known != "") & (issue_id != "") & (known != issue_id) & known.contains("4000-") & issue_id.contains("4000-")
    year_gap = (year > 0) & (F.col("publication_year") > 0) & (F.abs(year - F.col("publication_year")) >= 2)
    return present(
        conflict("xml_provider_id_conflict", "FATAL", other & ids, known, issue_id),
        conflict("xml_provider_conflict", "ERROR", other & _both(f"{ex}number", "issue_number") & (F.col("_xn") != F.col("_n")), number, F.col("issue_number")),
        conflict("xml_provider_conflict", "ERROR", other & (t != "") & (F.col("_t") != "") & (t != F.col("_t")), _existing_series(ex), F.col("series_name")),
        conflict("xml_provider_conflict", "ERROR", other & year_gap, year, F.col("publication_year")),
    )


def _existing_series(ex: str) -> Column:
    s = text(F.col(f"{ex}series"))
    return F.when(s != "", s).otherwise(text(F.col(f"{ex}title")))


def critical(c: Column) -> Column:
    return F.exists(c, lambda x: x["severity"].isin("FATAL", "ERROR"))


def level(points: Column, gained: Column, found: Column) -> Column:
    """Tier of a candidate from its score, positive evidence and conflicts."""
    bad = critical(found)
    other_series = F.exists(found, lambda x: (x["type"] == "series_conflict") & (x["severity"] == "FATAL"))
    return (
        F.when((points >= 90) & ~bad, "AUTO_ACCEPT")
        .when((points >= 75) & ~bad, "ACCEPT_WITH_WARNING")
        .when(~other_series & ((points >= 50) | (bad & (gained >= 50))), "MANUAL_REVIEW")
        .otherwise("UNRESOLVED")
    )


def action(tier: Column) -> Column:
    return F.when(tier.isin("AUTO_ACCEPT", "ACCEPT_WITH_WARNING"), "UPDATE").when(tier == "MANUAL_REVIEW", "REVIEW").otherwise("SKIP")


def explanations(parts: dict[str, Column]) -> Column:
    """array<string>: a line for each kind of evidence that says something, with its signed score."""
    shown = {
        "source": F.concat_ws(" ", "provider", F.nullif(text(F.col("issue_id")), F.lit(""))),
        "agreement": F.lit("providers agree"),
        "issue_number": F.concat(F.lit("#"), "issue_number", F.lit(" against #"), "f_issue_number"),
        "format": F.lit("collected edition against single issue"),
        "series_name": F.concat("series_name", F.lit(" against "), "f_series_name"),
        "year": F.concat(F.col("publication_year").cast("string"), F.lit(" against "), F.col("f_year").cast("string")),
        "publisher": F.concat("publisher", F.lit(" against "), "f_publisher"),
    }
    lines = [F.when(p != 0, F.format_string("%s: %s (%+.0f)", F.lit(k), shown[k], p.cast("double"))) for k, p in parts.items()]
    return present(*lines)
