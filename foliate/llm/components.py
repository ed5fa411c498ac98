"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Columns (node, component) for every node of `edges` (columns src, dst, both long).

    component is the smallest node that links reach.  Alternating large-star and
    small-star steps hang every node ever nearer to its component's smallest node; the
    number of rounds grows with the logarithm of the longest path.  Each round is a few
    aggregations and equi-joins, whose hot keys adaptive execution splits; its edges
    are written to the shared folder, and those of the round before deleted.  It ends when
    a round changes nothing, by the count and two 64-bit digests of the edges.  An empty
    graph gives no rows.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialize(e, "edges")
    before = None
    for _ in range(most_rounds):
        stamp = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first())
        if stamp == before or not stamp[0]:
            break
        before = stamp
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(least).distinct()
        old, e = e, materialize(small, "edges")
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
