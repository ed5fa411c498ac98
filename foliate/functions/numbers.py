"""Issue numbers: normal form, equality, and order.  They stay strings; "1A" is not 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions.text import text

#: Names that sort after all numbers, in this order.
NAMED_ORDER = {"annual": 10000.0, "special": 10001.0, "tpb": 10002.0, "hc": 10003.0, "omnibus": 10004.0}
NO_NUMBER, NOT_NUMERIC = 99999.0, 99998.0
#: Words of special issues, and the pattern of a plain number.
SPECIALS = "special|giant|one-shot|oneshot|preview|fcbd"
_NUMBER = r"^([0-9]+(?:\.[0-9]+)?)([a-zA-Z]*)$"


def unpadded(c: Column) -> Column:
    return F.ltrim(text(c), F.lit("0"))


def issue_order(c: Column) -> Column:
    """struct(numeric, suffix, is_named): sort by numeric, then suffix."""
    t = F.trim(text(c))
    low = F.lower(t)
    named = F.lit(None).cast("double")
    for name, order in reversed(NAMED_ORDER.items()):
        named = F.when(low.startswith(name), F.lit(order)).otherwise(named)
    plain = F.regexp_extract(t, _NUMBER, 1)
    lead = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)", 1)
    numeric = (
        F.when(text(c) == "", NO_NUMBER)
        .when(named.isNotNull(), named)
        .when(lead != "", lead.try_cast("double"))
        .otherwise(NOT_NUMERIC)
    )
    return F.struct(
        numeric.alias("numeric"),
        F.when(named.isNull() & (plain != ""), F.upper(F.regexp_extract(t, _NUMBER, 2))).otherwise("").alias("suffix"),
        named.isNotNull().alias("is_named"),
    )


def issue_number(c: Column) -> Column:
    """struct(raw, clean, number, suffix, is_annual, is_special)."""
    t = F.trim(text(c))
    low = F.lower(t)
    annual = low.contains("annual")
    special = ~annual & low.rlike(SPECIALS)
    first = F.coalesce(F.regexp_extract(t, "([0-9]+)", 1).try_cast("double"), F.lit(1.0))
    half = t.isin("½", "1/2")
    digits, letters = F.regexp_extract(t, _NUMBER, 1), F.regexp_extract(t, _NUMBER, 2)
    plain = ~annual & ~special & (digits != "")
    bare = F.ltrim(digits, F.lit("0"))
    clean = (
        F.when(annual, F.concat(F.lit("Annual #"), first.cast("bigint")))
        .when(special, "Special")
        .when(half, "0.5")
        .when(plain, F.concat(F.when(bare == "", "0").otherwise(bare), letters))
        .otherwise(t)
    )
    number = F.when(annual, first).when(special, 0.0).when(half, 0.5).when(plain, digits.try_cast("double")).otherwise(0.0)
    return F.struct(
        t.alias("raw"), clean.alias("clean"), number.alias("number"), F.when(plain, letters).otherwise("").alias("suffix"), annual.alias("is_annual"), special.alias("is_special")
    )


def same_issue(a: Column, b: Column) -> Column:
    """Whether two issue_number structs name one issue; blanks never do."""
    return (
        F.when((a["raw"] == "") | (b["raw"] == ""), False)
        .when(a["is_annual"] & b["is_annual"], a["number"] == b["number"])
        .when(a["is_special"] & b["is_special"], True)
        .otherwise((F.lower(a["clean"]) == F.lower(b["clean"])) | ((a["number"] == b["number"]) & (F.lower(a["suffix"]) == F.lower(b["suffix"]))))
    )


def digits_order(c: Column) -> Column:
    """Digits alone as a number; none is 0."""
    return F.coalesce(F.regexp_replace(text(c), "[^0-9]", "").try_cast("bigint"), F.lit(0))


def batch_number(name: Column) -> Column:
    """Issue number of a file name as batch matching takes it; "#1.5" gives "1"."""
    t = F.regexp_replace(text(name), r"(?i)\.(cbz|cbr|zip|rar)$", "")
    number = "0*([0-9]+[a-zA-Z]?)"
    issue, hashed = F.regexp_extract(t, r"(?i)\bissue\s*#?\s*" + number, 1), F.regexp_extract(t, r"#\s*" + number, 1)
    rest = F.regexp_replace(t, r"(?i)\bv[0-9]+\b", "")
    rest = F.regexp_replace(rest, r"\b(?:19|20)[0-9]{2}\b", "")
    return (
        F.when(t.rlike(r"(?i)(?:issue\s*#?|#|\b)0*(?:½|1/2|0\.5)\b") | t.rlike("½|1/2"), "0.5")
        .when(t.rlike(r"(?i)\bissue\s*#?\s*0+(?:[^0-9]|$)") | t.rlike(r"#\s*0+(?:[^0-9]|$)"), "0")
        .when(issue != "", issue)
        .when(hashed != "", hashed)
        .when(rest.rlike(r"\b0+(?:[^0-9]|$)"), "0")
        .otherwise(F.regexp_extract(rest, r"0*([0-9]+)\b", 1))
    )


def reading_number(name: Column) -> Column:
    """Issue number of a file name as reading orders take it; one-shots and collections count as 1."""
    t = F.regexp_replace(F.regexp_replace(text(name), r"\(.*?\)", ""), r"(?i)vol(?:ume)?\s*[0-9]+", "")

    def bare(x: Column) -> Column:
        cut = F.ltrim(x, F.lit("0"))
        return F.when(cut == "", "0").otherwise(cut)

    issue = F.regexp_extract(t, r"(?i)(?:issue|#)\s*([0-9]+[a-zA-Z]?)", 1)
    last = F.regexp_extract(t, r"(?i)[-_\s]([0-9]+)\.(?:cbz|cbr)$", 1)
    some = F.regexp_extract(t, r"([0-9]+)", 1)
    return (
        F.when(t.rlike(r"½|1/2|0\.5"), "0.5")
        .when(t.rlike(r"(?i)(?:#|\b)(?:000|00|0)(?:\b|\.cbz|\.cbr)"), "0")
        .when(t.rlike(r"(?i)\b(?:tpb|os|one[\s-]*shot|gn|graphic novel|special)\b"), "1")
        .when(issue != "", bare(issue))
        .when(last != "", bare(last))
        .when(some != "", bare(some))
        .otherwise("")
    )
