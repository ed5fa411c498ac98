"""Counts and rates over jobs, providers, caches and libraries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = {"resolved": ["SUCCESS", "COMPLETED"], "skipped": ["SKIPPED"], "unresolved": ["UNRESOLVED"], "failed": ["FAILED"], "review": ["REVIEW"]}


def count_where(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")


def average(c: str) -> Column:
    """The average to one digit, halves away from zero.

    Summed as decimals of six digits, so that neither the order of the rows nor doubles decide
    at halves; values that no such decimal holds (beyond 10^22, not finite) are summed as doubles.
    """
    exact = F.col(c).try_cast("decimal(28,6)")
    lost = F.count_if(F.col(c).isNotNull() & exact.isNull()) > 0
    return F.when(lost, F.round(F.avg(c), 1)).otherwise(F.round(F.avg(exact), 1).cast("double"))


def job_outcomes(jobs: DataFrame, by: list[str] = [], status: str = "status", duration: str = "value", order: str | None = None) -> DataFrame:  # noqa: B006
    """total, a count per outcome and the average duration (0 when none), rounded to one digit.

    With order, averages are those of doubles added in this order, as a query over the table in
    its order has them.  They can differ from averages of decimals only at halves, so only the
    groups there are added up anew.
    """
    counts = [count_where(F.col(status).isin(v)).alias(k) for k, v in OUTCOMES.items()]
    told = [F.count("*").alias("total"), *counts, F.coalesce(average(duration), F.lit(0.0)).alias("avg_duration")]
    if order is None:
        return jobs.groupBy(*by).agg(*told)
    out = jobs.groupBy(*by).agg(*told, at_half(duration).alias("_at_half"))
    groups = out.where("_at_half").select(*[F.col(k).alias(f"_{k}") for k in by])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.lit(True))
    anew = added_in_order(jobs.where(F.col(duration).isNotNull()).join(groups, same, "left_semi"), by, duration, order)
    anew = anew.select(*[F.col(k).alias(f"_{k}") for k in by], "_avg")
    # ten times the average is rounded, as the average itself may be told as a half that it is not
    tenths = F.round(F.col("_avg") * 10) / 10
    rounded = F.when(F.abs(tenths) < float("inf"), tenths).otherwise(F.col("_avg"))
    return out.join(anew, same, "left").select(*by, "total", *OUTCOMES, F.coalesce(rounded, "avg_duration").alias("avg_duration"))


def at_half(c: str) -> Column:
    """Whether the average is so near to a half of the first digit that errors of doubles, or of values beyond six digits, decide."""
    exact = F.col(c).try_cast("decimal(28,6)")
    lost = F.count_if(F.col(c).isNotNull() & exact.isNull()) > 0
    tenths = F.abs(F.avg(exact).cast("double")) * 10
    # doubles err by no more than 2^-53 of the absolute values' sum an addition
    return F.coalesce(lost | (F.abs(tenths - F.floor(tenths) - 0.5) <= 1e-5 + 4e-15 * F.sum(F.abs(c))), F.lit(False))


def added_in_order(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The groups' averages (_avg) of doubles, added one by one in the order; of equal places by value."""
    w = Window.partitionBy(*by).orderBy(order, value)
    added = F.sum(F.col(value).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.select(*by, added.alias("_sum"), F.row_number().over(w).alias("_n"))
    return placed.groupBy(*by).agg((F.max_by("_sum", "_n") / F.max("_n")).alias("_avg"))


def provider_health(calls: DataFrame, by: str = "provider") -> DataFrame:
    """calls, failures, average milliseconds and cache-hit rate in percent (0 without look-ups)."""
    lookups, hits = count_where(F.col("cache_lookup")), count_where(F.col("cache_lookup") & F.col("cache_hit"))
    return calls.groupBy(by).agg(
        F.count("*").alias("calls"),
        count_where(F.col("http_status") >= 400).alias("failures"),
        F.coalesce(average("ms"), F.lit(0.0)).alias("avg_ms"),
        F.round(F.when(lookups > 0, 100.0 * hits / lookups).otherwise(0.0), 1).alias("hit_rate"),
    )


def cache_stats(cache: DataFrame, now: int) -> DataFrame:
    return cache.groupBy("kind").agg(F.count("*").alias("rows"), count_where((F.col("expires_at") > 0) & (F.col("expires_at") < now)).alias("expired"))


def library_status(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per folder: total, tagged, missing, has_missing, is_complete, label; folders without files take issue_count as missing."""
    tagged = F.lower("path").endswith(".cbz") & F.col("has_metadata")
    per = files.groupBy("folder").agg(F.count("*").alias("total"), count_where(tagged).alias("tagged"))
    out = per.join(volumes, "folder", "full")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("tagged", F.lit(0))
    missing = F.when(F.col("total").isNull(), F.coalesce("issue_count", F.lit(0))).otherwise(total - done)
    return out.select(
        "folder", total.alias("total"), done.alias("tagged"), missing.cast("bigint").alias("missing"), (missing > 0).alias("has_missing"), ((total > 0) & (missing == 0)).alias("is_complete"),
        F.col("issue_count").isNotNull().alias("in_catalog"), F.format_string("%d/%d Tagged (%d Missing)", done, total, missing).alias("label"),
    )


def coverage(entries: DataFrame) -> DataFrame:
    """total, found, tagged, arc_tagged and missing of reading-order entries."""
    counts = {k: count_where(F.col(f"is_{k}")).alias(k) for k in ("found", "tagged", "arc_tagged")}
    return entries.agg(F.count("*").alias("total"), *counts.values(), count_where(~F.col("is_found")).alias("missing"))


def arc_rewrites(rows: DataFrame, before: str = "before", after: str = "after", error: str = "error") -> DataFrame:
    """Per action: files updated (their tags changed), skipped (no tag to change) and errors."""
    failed = F.col(error).isNotNull()
    changed = ~failed & ~F.col(before).eqNullSafe(F.col(after))
    return rows.groupBy("action").agg(count_where(changed).alias("updated"), count_where(~failed & ~changed).alias("skipped"), count_where(failed).alias("errors"))


def resolution_rates(decisions: DataFrame, seconds: float = 0.0) -> DataFrame:
    """Shares of tiers, of wrong ones among the accepted, against is_right, and items per second (0 if no time is given)."""
    accepted = F.col("level").isin("AUTO_ACCEPT", "ACCEPT_WITH_WARNING")
    n = F.count("*")
    share = lambda c: F.round(100.0 * count_where(c) / n, 2)
    return decisions.agg(
        n.alias("items"), share(F.col("level") == "AUTO_ACCEPT").alias("auto_accept"), share(F.col("level") == "MANUAL_REVIEW").alias("review"),
        share(F.col("level") == "UNRESOLVED").alias("unresolved"), share(accepted & ~F.col("is_right")).alias("false_positive"),
        F.round(n / F.lit(seconds), 1).alias("items_per_second") if seconds > 0 else F.lit(0.0).alias("items_per_second"),
    )
