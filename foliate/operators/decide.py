"""From scored candidate pools to one decision per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.numbers import unpadded
from foliate.functions.text import text, title_form
from foliate.operators import score as S
from foliate.operators.curate import first_by

EXTERNAL = ["Kapowarr", "ComicVine", "GCD", "GCP"]
FILE_COLUMNS = ["series_name", "issue_number", "year", "volume", "publisher", "is_tpb"]


def pool_pairs(parsed: DataFrame, candidates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Candidates beside their file's signals (f_*) and embedded record (x_*), with normal forms."""
    files = parsed.select("file_id", *[F.col(c).alias(f"f_{c}") for c in FILE_COLUMNS])
    pairs = candidates.join(files, "file_id")
    columns = ["series", "title", "number", "year", "provider_id"]
    if existing is None:
        pairs = pairs.withColumns({f"x_{c}": F.lit(None).cast("int" if c == "year" else "string") for c in columns})
    else:
        pairs = pairs.join(existing.select("file_id", *[F.col(c).alias(f"x_{c}") for c in columns]), "file_id", "left")
    return S.pair_forms(pairs)


def agreement(pairs: DataFrame) -> DataFrame:
    """Add n_agree: providers that agree on title, number, volume and year, or the first such group of title and number."""
    counts = F.col("provider").isin(EXTERNAL) & (text(F.col("series_name")) != "") & (text(F.col("issue_number")) != "")
    volume, year = F.trim(F.lower(text(F.col("volume")))), F.greatest(F.coalesce(F.col("publication_year"), F.lit(0)), F.lit(0))
    loose = Window.partitionBy("file_id", "_t", "_n")
    tight = Window.partitionBy("file_id", "_t", "_n", "_vol", "_year")
    staged = pairs.withColumns({"_vol": volume, "_year": year, "_ext": counts})
    staged = staged.withColumns(
        {
            "_own": F.size(F.collect_set(F.when(F.col("_ext"), F.col("provider"))).over(tight)),
            "_first": F.min(F.when(F.col("_ext"), F.col("pool_pos"))).over(tight),
        }
    )
    group = F.min(F.when(F.col("_ext") & (F.col("_own") >= 2), F.struct("_first", "_own"))).over(loose)
    staged = staged.withColumn("_group", group)
    n = F.when(~F.col("_ext"), 0).when(F.col("_own") >= 2, F.col("_own")).otherwise(F.coalesce(F.col("_group._own"), F.lit(0)))
    return staged.withColumn("n_agree", n).drop("_vol", "_year", "_ext", "_own", "_first", "_group")


def _pool_conflicts(c: Column) -> Column:
    """Conflicts between the candidates of an array, each with all after it."""

    def pair(a: Column, b: Column) -> Column:
        def of(when: Column, field: str) -> Column:
            return S.conflict("provider_disagreement", "ERROR", when, F.concat_ws(":", a["provider"], a[field].cast("string")), F.concat_ws(":", b["provider"], b[field].cast("string")))

        gap = (a["publication_year"] > 0) & (b["publication_year"] > 0) & (F.abs(a["publication_year"] - b["publication_year"]) >= 2)
        numbers = (a["issue_number"] != "") & (b["issue_number"] != "") & (a["_n"] != b["_n"])
        titles = (a["_t"] != "") & (b["_t"] != "") & (a["_t"] != b["_t"])
        return S.present(of(numbers, "issue_number"), of(titles, "series_name"), of(gap, "publication_year"))

    return F.flatten(F.transform(c, lambda a, i: F.flatten(F.transform(F.slice(c, i + 2, F.size(c)), lambda b: pair(a, b)))))


def with_disagreements(pairs: DataFrame) -> DataFrame:
    """Add disagreements: conflicts between the first candidates of the pool's providers (five at most).

    Windows over file_id alone, so they need no shuffle beyond the one that brought the pool together.
    """
    counts = F.col("provider").isin([*EXTERNAL, "ExistingXML"]) & ((text(F.col("series_name")) != "") | (text(F.col("issue_number")) != ""))
    first = F.row_number().over(Window.partitionBy("file_id", "provider").orderBy(F.when(counts, 0).otherwise(1), "pool_pos")) == 1
    item = F.when(counts & F.col("_first"), F.struct("pool_pos", "provider", "_t", "_n", "issue_number", "series_name", "publication_year"))
    listed = pairs.withColumn("_first", first).withColumn("_listed", F.sort_array(F.collect_list(item).over(Window.partitionBy("file_id"))))
    return listed.withColumn("disagreements", _pool_conflicts(F.col("_listed"))).drop("_first", "_listed")


def disagreements(pairs: DataFrame) -> DataFrame:
    """A row per file whose providers disagree: file_id and the array of conflicts."""
    return first_by(with_disagreements(pairs), ["file_id"], ["pool_pos"]).select("file_id", "disagreements").where(F.size("disagreements") > 0)


def evaluate(pairs: DataFrame, weights: S.Weights = S.Weights()) -> DataFrame:
    """Add n_agree, score, conflicts, critical, level and action to every candidate of every pool."""
    agreed = with_disagreements(agreement(pairs))
    told = {k: p.cast("double") for k, p in S.terms(weights, F.col("n_agree")).items()}
    parts = {k: F.col(f"_terms.{k}") for k in told}  # each term is computed once
    scored = agreed.withColumns({"_terms": F.struct(*[p.alias(k) for k, p in told.items()]), "_own": S.conflicts()})
    scored = scored.withColumns({"score": S.score(parts), "_positive": S.positive(parts)})
    outside = F.concat(
        F.col("disagreements"),
        S.existing_conflicts(),
        S.existing_candidate_conflicts(),
    )
    scored = scored.withColumns({"_outside": outside, "_tier": S.level(F.col("score"), F.col("_positive"), F.col("_own"))})
    accepted = F.col("_tier").isin("AUTO_ACCEPT", "ACCEPT_WITH_WARNING")
    tier = F.when(accepted & (F.size("_outside") > 0), "MANUAL_REVIEW").otherwise(F.col("_tier"))
    out = scored.withColumns(
        {"conflicts": F.concat("_own", "_outside"), "critical": S.critical(F.col("_own")) | (F.size("_outside") > 0), "level": tier}
    )
    return out.withColumn("action", S.action(F.col("level"))).drop("_own", "_outside", "_tier", "_positive", "_terms", "disagreements")


def rank(evaluated: DataFrame) -> DataFrame:
    """Add rank: without critical conflicts first, then by score, then by place in the pool."""
    order = Window.partitionBy("file_id").orderBy("critical", F.desc("score"), "pool_pos")
    return evaluated.withColumn("rank", F.row_number().over(order))


def decide(evaluated: DataFrame, least_margin: float = 10.0) -> DataFrame:
    """The best candidate of each file, held back when a distinct runner-up is too close."""
    order = Window.partitionBy("file_id").orderBy("critical", F.desc("score"), "pool_pos")
    ranked = evaluated.withColumns(
        {"rank": F.row_number().over(order), "_bt": F.first("_t").over(order), "_bn": F.first("_n").over(order), "_by": F.first("publication_year").over(order)}
    )
    gap = (F.col("publication_year") != 0) & (F.col("_by") != 0) & (F.abs(F.col("publication_year") - F.col("_by")) > 1)
    distinct = (F.col("rank") > 1) & ((F.col("_t") != F.col("_bt")) | (F.col("_n") != F.col("_bn")) | F.coalesce(gap, F.lit(False)))
    kept = ["provider", "issue_id", "series_id", "series_name", "issue_number", "publication_year", "score", "level", "critical", "n_agree"]
    best = ranked.groupBy("file_id").agg(
        F.min_by(F.struct(*kept), "rank").alias("b"), F.min(F.when(distinct, F.struct("rank", "score"))).alias("s"), F.count("*").cast("bigint").alias("n_candidates")
    )
    out = best.select("file_id", "b.*", F.col("s.score").alias("second_best"), "n_candidates")
    out = out.withColumn("margin", F.col("score") - F.col("second_best"))
    close = F.coalesce(F.col("margin") <= least_margin, F.lit(False)) & F.col("level").isin("AUTO_ACCEPT", "ACCEPT_WITH_WARNING")
    out = out.withColumn("ambiguous", close).withColumn("level", F.when(F.col("ambiguous"), "MANUAL_REVIEW").otherwise(F.col("level")))
    return out.withColumn("action", S.action(F.col("level")))


def title_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l, r) of distinct normal titles that are equal or one a prefix of the other.

    Each title is exploded into its character prefixes and equi-joined, so no cross join.
    """
    a, b = left.select(title_form(F.col("series_name")).alias("l")).distinct(), right.select(title_form(F.col("series_name")).alias("r")).distinct()

    def prefixes(df: DataFrame, c: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))
        return df.where(F.length(c) > 0).withColumn("_p", F.explode(cut))

    down = prefixes(a, "l").join(b, F.col("_p") == F.col("r")).select("l", "r")
    up = prefixes(b, "r").join(a, F.col("_p") == F.col("l")).select("l", "r")
    return down.union(up).distinct()
