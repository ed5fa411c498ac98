"""Reading orders and arc tags: expansion, list editing, matching against files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import numbers
from foliate.functions.text import arc_display, arc_form, squeeze, text
from foliate.sources.tables import written

RANGE = r"(?i)(.+?)\s*(?: issues?|,)?\s*#?([0-9]+)\s*[-–—]\s*([0-9]+)"
SINGLE = r"(?i)(.+?)\s*(?: issue|,)?\s*#?([0-9]+[a-zA-Z]?|[0-9]+\.[0-9]+|½|1/2|0\.5)"
STOP_WORDS = ["the", "a", "an", "of", "and"]
#: Numbers of a range that one row holds at a time.
BLOCK = 10_000


def expand_ranges(lines: DataFrame, line: str = "line") -> DataFrame:
    """A row per issue that a line names: at (from 0), series, number, title.

    "Series #a-b" gives all numbers from a to b; descending ranges and lines with one
    number give one row; lines without a number are number 1 of themselves.
    """
    t = F.trim(text(F.col(line)))
    low, high = F.regexp_extract(t, RANGE, 2).try_cast("int"), F.regexp_extract(t, RANGE, 3).try_cast("int")
    is_range = t.rlike(RANGE) & F.coalesce(low <= high, F.lit(False))
    single = t.rlike(SINGLE)
    series = F.when(is_range, F.regexp_extract(t, RANGE, 1)).when(single, F.regexp_extract(t, SINGLE, 1)).otherwise(t)
    one = F.array(F.when(single, F.regexp_extract(t, SINGLE, 2)).otherwise("1"))
    rows = lines.where(t != "").withColumns({"series": F.trim(series), "_one": one, "_low": F.when(is_range, low), "_high": F.when(is_range, high), "_plain": ~is_range & ~single})
    # wide ranges go block by block, so that no row ever holds all their numbers
    blocks = F.when(F.col("_low").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_high") - F.col("_low"), F.lit(BLOCK)))
    rows = rows.withColumn("_from", F.explode(blocks))
    start = F.col("_low") + F.col("_from")
    stop = start + F.least(F.lit(BLOCK - 1), F.col("_high") - start)
    many = F.transform(F.sequence(start, stop), lambda n: n.cast("string"))
    out = rows.withColumn("_numbers", F.when(F.col("_low").isNull(), F.col("_one")).otherwise(many)).select("*", F.posexplode("_numbers").alias("_at", "number"))
    title = F.when(F.col("_plain"), F.col("series")).otherwise(F.concat("series", F.lit(" #"), "number"))
    return out.withColumns({"at": F.col("_from") + F.col("_at"), "title": title}).drop("_numbers", "_plain", "_one", "_low", "_high", "_from", "_at")


def tag_list(arcs: Column, nums: Column, blank: Column | str = "1") -> Column:
    """array<struct<arc, num>>: tags beside their numbers, blanks and repeats dropped, the first spelling kept."""

    def parts(c: Column) -> Column:
        return F.filter(F.transform(F.split(text(c), ","), lambda x: F.trim(x)), lambda x: x != "")

    fill = F.lit(blank) if isinstance(blank, str) else blank
    pairs = F.filter(F.arrays_zip(parts(arcs).alias("arc"), parts(nums).alias("num")), lambda p: F.coalesce(p["arc"], F.lit("")) != "")
    forms = F.transform(pairs, lambda p: arc_form(p["arc"]))
    first = F.filter(pairs, lambda p, i: (arc_form(p["arc"]) != "") & (F.array_position(forms, arc_form(p["arc"])) == i + 1))
    return F.transform(
        first, lambda p: F.struct(arc_display(p["arc"]).alias("arc"), F.when(text(F.trim(p["num"])) == "", fill).otherwise(F.trim(p["num"])).alias("num"))
    )


def arcs_match(expected: Column, actual: Column) -> Column:
    """Whether a tag means an arc: either form holds the other, or a longer word of the expected one occurs in it."""
    e, a = arc_form(expected), arc_form(actual)
    longer = F.filter(F.split(e, " "), lambda w: F.length(w) > 3)
    return (
        F.when(text(actual) == "", False)
        .when(text(expected) == "", True)
        .when((e == "") | (a == ""), False)
        .otherwise(F.contains(a, e) | F.contains(e, a) | F.exists(longer, lambda w: F.contains(a, w)))
    )


def first_match(tags: Column, arc: Column) -> Column:
    """Index (from 0) of the first tag that means the arc, or null."""
    at = F.filter(F.transform(tags, lambda t, i: F.when(arcs_match(arc, t["arc"]), i)), lambda i: i.isNotNull())
    return F.get(at, F.lit(0))


def upsert_arc(tags: Column, arc: Column, num: Column) -> Column:
    """The first matching tag becomes (arc, num); without one it is appended."""
    new = F.struct(arc.alias("arc"), num.cast("string").alias("num"))
    at = first_match(tags, arc)
    return F.when(at.isNull(), F.concat(tags, F.array(new))).otherwise(F.transform(tags, lambda t, i: F.when(i == at, new).otherwise(t)))


def rename_arc(tags: Column, old: Column, new: Column) -> Column:
    """The first tag that means `old` takes the new name and keeps its number; others stay."""
    at = first_match(tags, old)
    return F.transform(tags, lambda t, i: F.when(i == at, F.struct(new.alias("arc"), t["num"].alias("num"))).otherwise(t))


def path_form(c: Column) -> Column:
    t = F.regexp_replace(F.lower(text(c)), "[-:/.]", " ")
    return squeeze(F.regexp_replace(t, r"\b(?:vs|versus)\b", " "))


def _content_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def series_in_path(series: Column, path: Column) -> Column:
    """Whether a path (in path_form) is of a series (in path_form): all words occur; a last number must stand alone."""
    digit = F.regexp_extract(series, "([0-9]+)$", 1)
    base = F.trim(F.regexp_replace(series, "[0-9]+$", ""))
    forms = [(" ", " "), (" 0", " "), ("volume 0", ""), ("volume ", ""), ("v0", ""), ("v", "")]
    shown = reduce(lambda a, f: a | F.contains(path, F.concat(F.lit(f[0]), digit, F.lit(f[1]))), forms, F.lit(False))
    shown = shown | F.contains(path, F.concat(base, F.lit(" "), digit)) | F.contains(path, F.concat(base, F.lit(" 0"), digit))
    words = F.size(_content_words(series)) > 0
    return words & F.when(digit != "", F.forall(_content_words(base), lambda w: F.contains(path, w)) & shown).otherwise(
        F.forall(_content_words(series), lambda w: F.contains(path, w))
    )


def number_keys(number: Column) -> Column:
    """array<string>: an issue number as it is compared with the number read from a name ("="), and its digits ("n")."""
    n = F.regexp_replace(F.regexp_extract(number, "([0-9]+)", 1), "^0+(?=[0-9])", "")
    whole = F.when(text(number) != "", F.concat(F.lit("="), numbers.unpadded(number)))
    return F.filter(F.array(whole, F.when(n != "", F.concat(F.lit("n"), n))), lambda x: x.isNotNull())


#: Five spellings of an issue number in a file name, the digits last.
SPELLINGS = [r"(?i)issue\s*([0-9]+)\b", r"#\s*([0-9]+)\b", r"(?i)\b([0-9]+)\.(?:cbz|cbr)$", r"(?i)vol(?:ume)?\s*[0-9]+\s+issue\s+([0-9]+)\b", r"(?i)v[0-9]+\s+([0-9]+)\b"]


def name_keys(name: Column) -> Column:
    """array<string>: the keys of all issue numbers that a file name carries; it holds a number if they share a key."""
    found = numbers.reading_number(name)
    whole = F.when(found != "", F.concat(F.lit("="), numbers.unpadded(found)))
    spelled = F.flatten(F.array(*[F.regexp_extract_all(name, F.lit(p), F.lit(1)) for p in SPELLINGS]))
    digits = F.transform(spelled, lambda d: F.concat(F.lit("n"), F.regexp_replace(d, "^0+(?=[0-9])", "")))
    return F.array_distinct(F.filter(F.concat(F.array(whole), digits), lambda x: x.isNotNull()))


def _pieces(words: Column, size: int) -> Column:
    """All pieces of `size` letters of the words that have as many."""
    long = F.filter(words, lambda w: F.length(w) >= size)
    return F.array_distinct(F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substring(w, i, F.lit(size))))))


def _longest_pieces(words: Column) -> Column:
    """The pieces of the greatest size, of four letters at most, that any word has."""
    return F.coalesce(*[F.when(F.size(_pieces(words, k)) > 0, _pieces(words, k)) for k in (4, 3, 2, 1)])


def piece_index(files: DataFrame, sizes: list[int], known: DataFrame) -> DataFrame:
    """path, _pf (its form), _keys (of its name's numbers), _piece: which of the known pieces (column _piece) of these sizes each path holds."""
    f = files.select("path").distinct().select("path", path_form(F.col("path")).alias("_pf"), name_keys(F.element_at(F.split("path", "/"), -1)).alias("_keys"))
    at = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_pf") - k + 1, F.lit(1))), lambda i: F.substring(F.col("_pf"), i, F.lit(k)))
    cut = F.array_distinct(F.flatten(F.array(*[at(k) for k in sizes])))
    return f.select("path", "_pf", "_keys", F.explode(cut).alias("_piece")).join(known, "_piece", "left_semi")


def reading_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """For distinct (series, number) the first file by path that holds it: series, number, path.

    A path that passes contains every word of the series, so it contains each piece of them.
    Distinct entries are written, as each step reads them.
    Paths are posted once by the pieces that some series has, and the index is written, as it
    is counted and then joined.  Entries meet paths by the piece of their series that the
    fewest paths hold together with the key of a number, so that a piece that very many paths
    hold is parted by numbers; no hit is lost.
    """
    e = written(entries.select("series", "number").distinct().withColumn("_ef", path_form(F.col("series"))), "entries")
    base = _content_words(F.regexp_replace(F.col("_ef"), "[0-9]+$", ""))
    wanted = F.when(F.size(base) > 0, base).otherwise(_content_words(F.col("_ef")))
    names = e.select("_ef").distinct().withColumn("_piece", F.explode(_longest_pieces(wanted)))
    known = names.select("_piece").distinct()
    sizes = [r["k"] for r in known.select(F.length("_piece").alias("k")).distinct().collect()]  # four at most
    if not sizes:
        return e.select("series", "number", F.lit(None).cast("string").alias("path")).where("false")
    held = written(piece_index(files, sizes, known), "pieces")
    often = held.groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = names.join(often, "_piece").groupBy("_ef").agg(F.min(F.struct("_n", "_piece")).alias("m")).select("_ef", F.col("m._piece").alias("_piece"))
    asked = e.join(rarest, "_ef").withColumn("_key", F.explode(number_keys(F.col("number"))))
    used = held.join(rarest.select("_piece").distinct(), "_piece", "left_semi")
    keyed = used.withColumn("_key", F.explode("_keys")).drop("_keys")
    hits = asked.join(keyed, ["_piece", "_key"]).where(series_in_path(F.col("_ef"), F.col("_pf")))
    return hits.groupBy("series", "number").agg(F.min("path").alias("path"))
