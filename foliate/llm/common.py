"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.sources.tables import discard, shared_dir

__all__ = ["discard", "find_spans", "let", "materialize", "running_sums", "shared_dir", "table", "up_to", "whole_text", "words"]

#: White space that separates words: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    Inside a lambda a plain column expression is evaluated for every element; a
    lambda variable is not.  Wrapping the value in a one-element array gives it a
    variable.
    """
    return F.transform(F.array(value), body)[0]


def whole_text(text: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def up_to(n: Column) -> Column:
    """0 .. n-1, and an empty array for n <= 0 (sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def running_sums(a: Column) -> Column:
    """Inclusive running sums of an array of longs.

    Appending to an array copies it, so one fold over k elements costs k*k.  Folds
    over blocks of 256, then over the blocks' totals, keep long arrays affordable.
    """
    block = 256

    def fold(xs: Column) -> Column:
        return F.aggregate(
            xs,
            F.array().cast("array<bigint>"),
            lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("bigint")) + x)),
        )

    def shifted(parts: Column) -> Column:
        return let(
            fold(F.transform(parts, lambda p: F.element_at(p, -1))),
            lambda ends: F.flatten(
                F.transform(
                    parts,
                    lambda p, i: F.transform(p, lambda x: x + F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint"))),
                )
            ),
        )

    n_blocks = F.floor((F.size(a) + (block - 1)) / block)
    return let(F.transform(up_to(n_blocks), lambda b: fold(F.slice(a, b * block + 1, block))), shifted)


def find_spans(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, end, match>>.

    Positions count code points, end exclusive.  `split` by the same pattern gives
    the gaps between the matches, so positions are running sums of lengths.  The
    pattern must not match the empty string.  `hint` is a cheap necessary condition.
    """
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(m: Column) -> Column:
        steps = F.transform(
            F.arrays_zip(F.split(text, pattern, -1).alias("gap"), m.alias("hit")),
            lambda z: (F.length(z["gap"]) + F.coalesce(F.length(z["hit"]), F.lit(0))).cast("bigint"),
        )
        return let(
            running_sums(steps),
            lambda ends: F.transform(
                m,
                lambda x, i: F.struct(
                    (F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("match")
                ),
            ),
        )

    out = let(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(located(m)))
    return out if hint is None else F.when(hint, out).otherwise(empty)


def materialize(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back.

    This cuts the lineage: a lost executor costs no recomputation of what stands above.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
