"""Normal forms of titles, publishers, arcs and urls, as column expressions.

Missing text is the empty string throughout; null counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Provider aliases.
PROVIDER_ALIASES = {
    "kapowarr": ["kapowarr", "kap"],
    "comicvine": ["comicvine", "comic_vine", "cv"],
    "gcd": ["gcd", "gcp", "grandcomics", "grand_comics"],
}
#: Query parameters that hold secrets.
SECRET_PARAMETERS = ["api_key", "apikey", "key", "token", "password", "secret", "auth"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_form(c: Column) -> Column:
    """Lower case, leading "the", "a", "an" dropped one after the other, punctuation to spaces."""
    t = F.regexp_replace(F.trim(F.lower(text(c))), "^(?:the )?(?:a )?(?:an )?", "")
    return squeeze(F.regexp_replace(t, r"(?U)[^\w\s]", " "))


def key_form(c: Column) -> Column:
    """Lower case, one leading article dropped, punctuation and underscores to spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.trim(F.lower(text(c))), r"^(the|a|an)\s+", ""), r"(?U)[\W_]+", " "))


def collection_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9 ]", ""))


def publisher_form(c: Column) -> Column:
    return F.trim(F.lower(text(c)))


def arc_form(c: Column) -> Column:
    return squeeze(F.lower(F.regexp_replace(text(c), "[\"'():]", " ")))


def arc_display(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text(c)), '^"+|"+$', ""), "^'+|'+$", "")


def creator_form(c: Column) -> Column:
    """Parenthesised remarks dropped, also unclosed ones; question marks stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text(c), r"\([^)]*\)", ""), r"\(.*$", ""), r"\?", ""))


def provider_name(c: Column) -> Column:
    lowered = F.regexp_replace(F.trim(F.lower(text(c))), "[ -]", "_")
    out = lowered
    for name, aliases in PROVIDER_ALIASES.items():
        out = F.when(lowered.isin(aliases), F.lit(name)).otherwise(out)
    return out


def route(c: Column, base: str = "") -> Column:
    """Which source a url or pasted text belongs to."""
    t = text(c)
    pasted = reduce(lambda a, m: a | t.contains(m), PASTED, F.lit(False))
    out = F.when(F.lower(t).contains("comics.org") | pasted, "GCP").otherwise("ComicVine")
    return F.when(t.startswith(base), "Kapowarr").otherwise(out) if base else out


def provider_id(url: Column) -> Column:
    """4000-n, 4050-n and 4045-n ids, or the number after /issue/ or /series/."""
    t = text(url)
    direct = F.regexp_extract(t, r"(40(?:00|50|45)-[0-9]+)", 1)
    return F.when(direct != "", direct).otherwise(F.regexp_extract(t, "/(?:issue|series)/([0-9]+)", 1))


def volume_slug(url: Column) -> Column:
    slug = F.regexp_extract(text(url), r"/([^/]+)/4050-[0-9]+", 1)
    return F.when(slug == "volume", "").otherwise(slug)


def date_parts(c: Column) -> Column:
    """struct(year, month, day) of ISO dates, "Month D, YYYY", "Month YYYY" and "YYYY"; unknown parts are 0."""
    t = F.trim(text(c))
    iso = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
    full = r"^([A-Za-z]+)\s+([0-9]{1,2}),?\s+([0-9]{4})"
    month_year = r"^([A-Za-z]+),?\s+([0-9]{4})"

    def number(x: Column) -> Column:
        return F.coalesce(x.try_cast("int"), F.lit(0))

    def month(name: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in ((m, i + 1) for i, m in enumerate(MONTHS)) for x in pair])
        short = F.create_map(*[F.lit(x) for pair in ((m[:3], i + 1) for i, m in enumerate(MONTHS)) for x in pair])
        low = F.lower(name)
        return F.coalesce(F.try_element_at(known, low), F.try_element_at(short, low), F.lit(0))

    def parts(y: Column, m: Column, d: Column) -> Column:
        return F.struct(y.alias("year"), m.alias("month"), d.alias("day"))

    zero = F.lit(0)
    return (
        F.when(t.rlike(iso), parts(*[number(F.regexp_extract(t, iso, i)) for i in (1, 2, 3)]))
        .when(t.rlike(full), parts(number(F.regexp_extract(t, full, 3)), month(F.regexp_extract(t, full, 1)), number(F.regexp_extract(t, full, 2))))
        .when(t.rlike(month_year), parts(number(F.regexp_extract(t, month_year, 2)), month(F.regexp_extract(t, month_year, 1)), zero))
        .otherwise(parts(number(F.regexp_extract(t, r"((?:19|20)[0-9]{2})", 1)), zero, zero))
    )


def mask(c: Column, shown: int = 4) -> Column:
    t = text(c)
    return (
        F.when(t == "", "<not set>")
        .when(F.length(t) <= 2 * shown, "********")
        .otherwise(F.concat(F.substring(t, 1, shown), F.lit("..."), F.substring(t, -shown, shown)))
    )


def redact(c: Column) -> Column:
    """Values of secret parameters in urls and key=value texts."""
    return F.regexp_replace(text(c), r"(?i)\b(" + "|".join(SECRET_PARAMETERS) + r")=[^&\s]+", "$1=REDACTED")


def url_list(c: Column) -> Column:
    """Urls of a JSON list, or of text separated by white space or commas."""
    t = F.trim(text(c))
    listed = F.from_json(t, "array<string>")
    parts = F.when(t.startswith("[") & listed.isNotNull(), listed).otherwise(F.split(t, r"[\s,]+"))
    return F.filter(parts, lambda x: F.trim(x).startswith("http"))


def split_list(c: Column) -> Column:
    """Parts between commas or semicolons, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text(c), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def http_state(status: Column) -> Column:
    """struct(state, retryable) of an HTTP status."""
    state = (
        F.when(status == 429, "RATE_LIMITED")
        .when(status.isin(500, 502, 503, 504), "SERVER_ERROR")
        .when(status == 404, "NOT_FOUND")
        .when(status.isin(401, 403), "AUTH_ERROR")
        .when(status.isin(400, 422), "BAD_REQUEST")
        .when(status.between(200, 299), "OK")
        .otherwise("UNKNOWN_ERROR")
    )
    return F.struct(state.alias("state"), status.isin(429, 500, 502, 503, 504).alias("retryable"))


def content_hash(columns: dict[str, Column]) -> Column:
    """First 16 hex digits of the SHA-256 of the columns as JSON, keys in order; equal content gives an equal hash."""
    parts = []
    for k in sorted(columns):
        one = F.to_json(F.array(columns[k]))
        parts.append(F.concat(F.lit(f'"{k}": '), F.substring(one, F.lit(2), F.length(one) - 2)))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16)


def folder_title(rel_path: Column) -> Column:
    """Series title of a folder below the library's root: "a", "a - b" where b is a volume, else "a (b)"."""
    parts = F.split(text(rel_path), "/")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(b.isNull(), a).when(F.lower(b).contains("volume"), F.concat(a, F.lit(" - "), b)).otherwise(F.concat(a, F.lit(" ("), b, F.lit(")")))


#: Markers of pasted catalog text.
PASTED = ["Grand Comics Database", "Indexer notes", "Pencils:", "Script:"]


def is_pasted(c: Column) -> Column:
    """Whether a value is pasted page text rather than a url: a marker, or a catalog url with more than two lines."""
    t = text(c)
    marked = reduce(lambda a, m: a | t.contains(m), PASTED, F.lit(False))
    return marked | (t.contains("comics.org") & (F.size(F.split(t, "\n")) > 2))
