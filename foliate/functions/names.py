"""Identity signals of a file name, as column expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import text

#: Words that mark collected editions and specials, and folders that name no series.
COLLECTED = [
    "tpb", "trade paperback", "hc", "hardcover", "gn", "graphic novel", "omnibus", "compendium", "masterworks", "collection",
    "deluxe", "deluxe edition", "collected edition", "complete edition", "vol 0", "vol.0", "volume 0", "vol 1 tpb", "vol.1 tpb",
    "vol 1 hc", "volume 1 tpb",
]
SPECIAL = ["special", "giant", "fcbd", "free comic book day", "preview", "one-shot", "oneshot"]
PLAIN_FOLDERS = ["comics", "downloads", "tmp", "temp"]

#: The patterns that file names are read by.
YEAR = r"[(\[]((?:19|20)[0-9]{2})[)\]]"
VOLUME = r"(?i)\b(?:v|vol|volume)\.?\s*([0-9]+)\b"
NUMBER = r"([0-9]+½|[0-9]+/[0-9]+|[0-9]+\.[0-9]+|[0-9]+[a-zA-Z]?|½)"
#: Fixed values: (pattern, fixed number or None for the matched one) in order of precedence.
CASCADE = [
    (r"(?i)\bannual\s*#?\s*([0-9]+)\b", None),
    (r"(?i)\bannual\b", "Annual"),
    (r"(?i)\b(?:fcbd|free comic book day)\b", "FCBD"),
    (r"(?i)\b(?:one-shot|oneshot)\b", "One-Shot"),
    (r"(?i)\bpreview\b", "Preview"),
    (r"(?i)\bspecial\s*#?\s*([0-9]+)\b", None),
    (r"(?i)\bspecial\b", "Special"),
    (r"#\s*" + NUMBER, None),
    (r"(?i)\bissue\s*#?\s*" + NUMBER, None),
    (r"(?:^|[\s_\-#])([0-9]{1,4}[a-zA-Z]?)\b[^0-9]*$", None),
]
_TRAIL = r"[_\-.()\[\]]+"


def base_name(path: Column) -> Column:
    return F.when(_whole(path), path).otherwise(F.element_at(F.split(path, "/"), -1))


def parent_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(_whole(path) | (F.size(parts) < 2), "").otherwise(F.element_at(parts, -2))


def _whole(path: Column) -> Column:
    """Relative names with a fraction such as "#1/2" hold no folder."""
    return path.rlike(r"#\s*[0-9]+/[0-9]+") & ~path.startswith("/")


def stem(base: Column) -> Column:
    return F.when(base.rlike(r"^\.+[^.]*$"), base).otherwise(F.regexp_replace(base, r"\.[^.]*$", ""))


def is_collected(name: Column) -> Column:
    return F.lower(name).rlike(r"\b(?:" + "|".join(k.replace(".", r"\.") for k in COLLECTED) + r")\b")


def year(name: Column, parent: Column) -> Column:
    own, above = F.regexp_extract(name, YEAR, 1), F.regexp_extract(parent, YEAR, 1)
    return F.coalesce(F.when(own != "", own).otherwise(above).try_cast("int"), F.lit(0))


def volume(name: Column) -> Column:
    digits = F.regexp_extract(name, VOLUME, 1)
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(digits == "", "").when(bare == "", "1").otherwise(bare)


def number_form(raw: Column) -> Column:
    """Half numbers end in ".5", all-digit ones lose their zeros, others stay."""
    half = raw.isin("½", "1/2", "0.5")
    ends_half = raw.endswith("½") | raw.endswith("1/2")
    return (
        F.when(half, "0.5")
        .when(ends_half, F.concat(F.trim(F.regexp_replace(raw, "[½|1/2]", "")), F.lit(".5")))
        .when(raw.rlike("^[0-9]+$"), F.regexp_replace(raw, "^0+(?=[0-9])", ""))
        .otherwise(raw)
    )


def number(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, fixed in CASCADE:
        value = F.lit(fixed) if fixed else number_form(F.trim(F.regexp_extract(name, pattern, 1)))
        out = out.when(name.rlike(pattern), value)
    return out.otherwise("")


def _before_number(name: Column) -> Column:
    """The name up to its number; fixed names and those that begin with the number are not cut."""
    out = F.when(F.lit(False), "")
    for pattern, fixed in CASCADE:
        before = name if fixed else F.get(F.split(name, pattern, 2), F.lit(0))
        out = out.when(name.rlike(pattern), F.when(before == "", name).otherwise(before))
    return out.otherwise(name)


def _drop(c: Column, *patterns: str) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _TRAIL, " "))


def _marked(clean: Column, low: Column) -> Column:
    """The title with Annual or Special at its end where the name says so and the title does not."""

    def lacks(word: str) -> Column:
        return low.contains(word) & ~F.lower(clean).endswith(word)

    return (
        F.when(lacks("annual"), F.trim(F.concat(clean, F.lit(" Annual"))))
        .when(lacks("special"), F.trim(F.concat(clean, F.lit(" Special"))))
        .otherwise(clean)
    )


def parse_filename(files: DataFrame, path: str = "path") -> DataFrame:
    """Add series_name, volume, issue_number, year, publisher, is_tpb, is_annual, is_special.

    Each step is a column of its own, so that later steps refer to it instead of repeating it.
    An input column named like an output is not allowed.
    """
    p = text(F.col(path))
    name, parent, low = F.col("_name"), F.col("_parent"), F.col("_low")
    title, folder = F.col("_title"), F.col("_folder")
    step = files.withColumns({"_name": stem(base_name(p)), "_parent": parent_name(p)})
    step = step.withColumns({"_low": F.lower(name), "_cut": _before_number(name), "_folder": _spaced(_drop(parent, YEAR))})
    step = step.withColumn("_title", _spaced(_drop(F.col("_cut"), YEAR, VOLUME, r"#\s*" + NUMBER, r"(?i)\bissue\s*#?\s*" + NUMBER)))
    step = step.withColumn("_title", _marked(title, low))
    usable = (parent != "") & ~F.lower(parent).isin(PLAIN_FOLDERS) & (folder != "")
    step = step.withColumn("_title", F.when(usable & ((title == "") | (F.lower(title) == F.lower(folder))), folder).otherwise(title))
    signals = F.struct(
        F.when(title != "", title).when(parent != "", parent).otherwise(name).alias("series_name"),
        volume(name).alias("volume"),
        number(name).alias("issue_number"),
        year(name, parent).alias("year"),
        F.lit("").alias("publisher"),
        is_collected(name).alias("is_tpb"),
        low.contains("annual").alias("is_annual"),
        reduce(lambda a, k: a | low.contains(k), SPECIAL, F.lit(False)).alias("is_special"),
    )
    # inline keeps filters on the signals above it; pushed down, they would repeat all of the steps
    return step.select(*files.columns, F.inline(F.array(signals)))
