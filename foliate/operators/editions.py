"""Editions matched by classes: rows with equal canonical keys are compared once.

A row without a series matches every series of its number, so pairs of rows grow with the
square of such rows.  Pairs of classes do not: a class is one combination of the six keys, and
rows are told by their class.  `expand` gives pairs of rows where they are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["series_norm", "issue_numeric", "issue_suffix", "is_named", "volume_norm", "key_year"]
NUMBER = ["issue_numeric", "issue_suffix", "is_named"]


def class_id() -> Column:
    return F.md5(F.to_json(F.struct(*KEYS), {"ignoreNullFields": "false"}))


def members(rows: DataFrame, row_id: str) -> DataFrame:
    """class_id and row_id of every row with canonical keys (see `canonical_key`)."""
    return rows.select(class_id().alias("class_id"), F.col(row_id).alias("row_id"))


def classes(rows: DataFrame) -> DataFrame:
    """class_id, its keys and its number of rows."""
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n_rows")).withColumn("class_id", class_id())


def match_classes(left: DataFrame, right: DataFrame, year_tolerance: int = 1) -> DataFrame:
    """left_class, right_class and their numbers of rows: classes whose keys name one edition.

    Numbers (numeric, suffix, named) are equal; series and volumes are equal or one is blank;
    years differ by no more than year_tolerance or one is 0 or less.  A null number matches
    nothing.  Classes with a series meet by it; the others by number and year, so that a
    number that very many rows carry is parted by its years.
    """
    keep = ["class_id", "n_rows", *KEYS]
    a = classes(left).select(*[F.col(k).alias(f"l_{k}") for k in keep])
    b = classes(right).select(*[F.col(k).alias(f"r_{k}") for k in keep])
    year = lambda side: F.when(F.col(f"{side}_key_year") > 0, F.col(f"{side}_key_year")).otherwise(0)
    a, b = a.withColumn("l_y", year("l")), b.withColumn("r_y", year("r"))
    number = F.lit(True)
    for k in NUMBER:
        number = number & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    volume = (F.col("l_volume_norm") == "") | (F.col("r_volume_norm") == "") | (F.col("l_volume_norm") == F.col("r_volume_norm"))
    years = (F.col("l_y") == 0) | (F.col("r_y") == 0) | (F.abs(F.col("l_y") - F.col("r_y")) <= year_tolerance)
    full = a.where("l_series_norm <> ''").join(b.where("r_series_norm <> ''"), (F.col("l_series_norm") == F.col("r_series_norm")) & number & years)
    near = F.array_distinct(F.concat(F.sequence(F.col("l_y") - year_tolerance, F.col("l_y") + year_tolerance), F.array(F.lit(0))))
    dated = a.where("l_y > 0").withColumn("at", F.explode(near))

    def anyhow(which_a: str, which_b: str) -> DataFrame:
        """Pairs of which one side has no series."""
        met = dated.where(which_a).join(b.where(which_b), number & (F.col("at") == F.col("r_y"))).drop("at")
        return met.unionByName(a.where("l_y = 0").where(which_a).join(b.where(which_b), number))

    pairs = full.unionByName(anyhow("true", "r_series_norm = ''")).unionByName(anyhow("l_series_norm = ''", "r_series_norm <> ''")).where(volume)
    return pairs.select(F.col("l_class_id").alias("left_class"), F.col("r_class_id").alias("right_class"), F.col("l_n_rows").alias("n_left"), F.col("r_n_rows").alias("n_right"))


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id of all pairs of rows; left and right as `members` gives them."""
    a = left.select(F.col("class_id").alias("left_class"), F.col("row_id").alias("left_id"))
    b = right.select(F.col("class_id").alias("right_class"), F.col("row_id").alias("right_id"))
    return pairs.select("left_class", "right_class").join(a, "left_class").join(b, "right_class").select("left_id", "right_id")


def matches(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """row_id and n_matches of the left rows that match any: counted by class, never by pair."""
    per = pairs.groupBy("left_class").agg(F.sum("n_right").alias("n_matches"))
    return left.join(per, F.col("class_id") == F.col("left_class")).select("row_id", "n_matches")
