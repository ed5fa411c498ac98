"""Who holds what: containment joins of texts, and candidate pools out of catalogs.

A text that holds a query holds each of its three-letter pieces.  Pieces of all texts are
posted with their number of texts; a query is looked up by the piece that the fewest texts
hold, and what it meets is verified.  Queries below three letters are looked up whole.  Long
postings are dealt into salted parts by their length, so no piece gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions.numbers import unpadded
from foliate.functions.text import text, title_form
from foliate.sources.tables import spread

#: Texts of one piece that meet in one task.
PART = 50_000


def pieces(c: Column, length: int) -> Column:
    """The distinct pieces of this many letters."""
    n = F.length(c)
    return F.when(n >= length, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (length - 1)), lambda i: F.substring(c, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def holding(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs (text, query) of distinct texts and queries of which the first holds the second.

    texts: column text; queries: column query.  Blank queries, nulls and texts shorter than
    the query meet nothing.  Compare forms, such as lower-case ones, by passing them.
    """
    t = texts.select("text").where("text is not null").distinct()
    q = queries.select("query").where("trim(query) <> ''").distinct()
    asked = q.withColumn("_piece", F.explode(F.when(F.length("query") < 3, F.array("query")).otherwise(pieces(F.col("query"), 3))))
    wanted = asked.select(F.col("_piece").alias("w")).distinct()
    posted = t.select("text", F.explode(F.array_union(F.array_union(pieces(F.col("text"), 3), pieces(F.col("text"), 2)), pieces(F.col("text"), 1))).alias("w"))
    posted = posted.join(wanted, "w", "left_semi")  # only pieces that a query has
    size = posted.groupBy("w").agg(F.count("*").alias("n"))
    ranked = asked.join(size, F.col("_piece") == F.col("w"), "left").drop("w").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("_piece").alias("w"))).alias("best"))
    sought = ranked.where("best.n > 0").select("query", "best.w", F.ceil(F.col("best.n") / PART).cast("int").alias("parts"))
    used = sought.groupBy("w").agg(F.first("parts").alias("parts"))
    dealt = posted.join(used, "w").withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")).drop("parts")
    parted = sought.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(parted, ["w", "part"]).where(F.contains("text", F.col("query"))).select("text", "query")


def search_many(issues: DataFrame, queries: DataFrame) -> DataFrame:
    """Issues found by each query of a table: title, "issue n" or "#n" holds it, without regard to case.

    issues: title and number, other columns are kept; queries: column query, trimmed and
    lower-cased; adds query and shown.
    """
    n = F.lower(text(F.col("number")))
    title = F.lower(text(F.col("title")))
    forms = F.array_distinct(F.array(title, F.concat(F.lit("issue "), n), F.concat(F.lit("#"), n)))
    q = queries.select(F.trim(F.lower("query")).alias("query"))
    rows = issues.withColumns({"_forms": forms})
    found = holding(rows.select(F.explode("_forms").alias("text")), q)
    hits = rows.withColumn("text", F.explode("_forms")).join(found, "text").drop("text", "_forms")
    shown = F.when(text(F.col("title")) != "", F.col("title")).otherwise(F.concat(F.lit("Issue #"), "number"))
    return hits.withColumn("shown", shown).distinct()


def search_series(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """Catalog rows whose series holds a query of a table, without regard to case; adds query."""
    q = queries.select(F.trim(F.lower("query")).alias("query"))
    rows = catalog.withColumn("text", F.lower(text(F.col("series_name"))))
    return rows.join(holding(rows, q), "text").drop("text")


def pools(files: DataFrame, catalog: DataFrame, best: int = 5) -> DataFrame:
    """Candidates of each parsed file: up to `best` rows of each provider of the catalog.

    files: as parse_filename gives them.  catalog: provider and the columns of CANDIDATE.
    A row is a candidate when the normal form of its series holds the file's, or the file's
    holds it and begins with it, and its number is the file's (zeros before it aside), or one
    of the two is blank.  They are ordered by equal series, equal number, distance of years,
    then ids; pool_pos counts from 1 over providers in the order of their names.
    """
    own = files.select("file_id", title_form(F.col("series_name")).alias("f"), unpadded(F.col("issue_number")).alias("fn"), F.coalesce(F.col("year"), F.lit(0)).alias("fy")).where("f <> ''")
    asked = own.select("f", "fn", "fy").distinct()  # files that ask alike ask once
    named = asked.select("f", "fn").distinct()
    rows = catalog.withColumns({"t": title_form(F.col("series_name")), "tn": unpadded(F.col("issue_number"))}).where("t <> ''")
    down = holding(rows.select(F.col("t").alias("text")), named.select(F.col("f").alias("query"))).select(F.col("text").alias("t"), F.col("query").alias("f"))
    up = holding(named.select(F.col("f").alias("text")), rows.select(F.col("t").alias("query"))).where(F.startswith("text", F.col("query"))).select(F.col("query").alias("t"), F.col("text").alias("f"))
    pairs = down.union(up).distinct()
    ids = [c for c in ("issue_id", "series_id", "series_name", "issue_number", "publication_year", "publisher", "volume") if c in catalog.columns]

    def ahead(*by: str | Column) -> DataFrame:
        """The first rows of each group whose rows only their ids tell apart: no other can be among the best."""
        return rows.withColumn("_k", F.row_number().over(W.partitionBy("provider", "t", "publication_year", *by).orderBy(*ids))).where(F.col("_k") <= best).drop("_k")

    met = named.join(pairs, "f")
    numbered = met.where("fn <> ''").withColumn("tn", F.explode(F.array("fn", F.lit("")))).join(ahead("tn"), ["t", "tn"])
    anyway = met.where("fn = ''").join(ahead(F.col("tn") == ""), "t")
    near = _near(spread(numbered.unionByName(anyway), "f", "fn"), ids, best)  # few bytes, but many pairs come of them
    fy, y = F.col("fy"), F.col("_y")
    between = (F.col("_above").isNull() | (fy < F.col("_above"))) & (F.col("_below").isNull() | (fy > F.col("_below")))
    meets = F.when(fy <= 0, F.col("_first")).when(y <= 0, F.col("_first_of_year")).otherwise(between)
    met_years = spread(asked, "f", "fn").join(near, ["f", "fn"]).where(meets)
    gap = F.when((fy > 0) & (y > 0), F.abs(fy - y)).otherwise(1000)
    kept = met_years.withColumn("_k", F.row_number().over(W.partitionBy("f", "fn", "fy", "provider").orderBy("_class", gap, *ids))).where(F.col("_k") <= best)
    place = F.row_number().over(W.partitionBy("f", "fn", "fy").orderBy("provider", "_k")).cast("int")
    placed = kept.withColumn("pool_pos", place)
    return own.join(placed, ["f", "fn", "fy"]).select("file_id", "pool_pos", *catalog.columns)


def _near(met: DataFrame, ids: list[str], best: int) -> DataFrame:
    """Rows met by (f, fn) that can be among the `best` of some year asked, with the years for which they can.

    Titles and numbers come first, so rows behind `best` of a better _class go.  A row of
    year _y can serve a year asked only while fewer than `best` rows of its class lie nearer:
    between the best-th row of an earlier year (_below) and that of a later one (_above),
    both null where there is none.  _first are those that serve a file without a year;
    _first_of_year, of rows without one, those that serve a file with a year.  So what a file
    meets is bounded by `best`, not by how many years its title has.
    """
    group = ["f", "fn", "provider", "_class"]
    year = F.greatest(F.coalesce(F.col("publication_year"), F.lit(0)), F.lit(0))
    kind = F.when(F.col("t") == F.col("f"), 0).otherwise(2) + F.when(F.col("tn") == F.col("fn"), 0).otherwise(1)
    rows = met.withColumns({"_class": kind, "_y": year})
    alike = F.row_number().over(W.partitionBy(*group, "_y").orderBy(*ids))
    rows = rows.withColumn("_of_year", alike).where(F.col("_of_year") <= best)
    better = F.count("*").over(W.partitionBy("f", "fn", "provider").orderBy("_class").rangeBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_better", better).where(F.col("_better") < best).drop("_better")
    ordered = W.partitionBy(*group).orderBy("_y", "_of_year")
    reach = 2 * best - 1  # at most `best` rows share a year
    after = F.filter(F.collect_list("_y").over(ordered.rowsBetween(1, reach)), lambda x: x > F.col("_y"))
    before = F.filter(F.collect_list("_y").over(ordered.rowsBetween(-reach, -1)), lambda x: (x < F.col("_y")) & (x > 0))
    rows = rows.withColumns({"_above": F.get(after, F.lit(best - 1)), "_below": F.get(F.reverse(before), F.lit(best - 1))})
    first = F.row_number().over(W.partitionBy(*group).orderBy(*ids)) <= best
    return rows.withColumns({"_first": first, "_first_of_year": F.col("_of_year") <= best}).drop("_of_year")
