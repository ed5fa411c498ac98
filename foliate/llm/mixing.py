"""Mixing sources to target weights by temperature.

Token shares p are raised to an exponent and normalised.  The exponent is the smallest
in steps of 1/4096, found by repeated section, whose mix is no more even than the target
entropy and repeats no source more often than the limit.  Weights and the token budget
give each source its tokens: whole epochs, then a part of one more.

The part is taken from a permutation: a source's documents fall into blocks of about
`block_tokens` tokens by a hash of their id; blocks are ordered by a hash of epoch and
block, documents in a block by one of epoch and id.  Blocks are taken in order; in the
one where the budget ends, documents while they fit.  So a decision needs a row's own
hashes and a few numbers of its source, and no group is ever gathered or sorted whole.

Defined results: a null source is a source of its own; a null text has no tokens; a
source without tokens is kept once; repeated rows are taken together; an empty table
gives no rows; input columns named like an added one are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.common import discard, materialize, whole_text, words

STEPS = 4096
SALTS = 64


@dataclass(frozen=True)
class Mix:
    """budget: tokens, "total" (as many as there are) or "cover" (as many as give each source an epoch)."""

    budget: int | str = "total"
    entropy_share: float = 0.95  # of the entropy of equal weights
    most_repeats: float = 2.0
    block_tokens: int = 1 << 20
    seed: int = 17


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def exponent(stats: DataFrame, mix: Mix) -> float:
    """The smallest exponent that meets entropy target and repetition limit, 1 if none does.

    `stats` has a row per source: tokens.  Each round evaluates 16 exponents in one
    aggregation over the sources; both criteria fall as the exponent grows.
    """
    share = stats.where("tokens > 0").crossJoin(F.broadcast(stats.agg(F.sum("tokens").alias("total"), F.count(F.when(F.col("tokens") > 0, 1)).alias("n"))))
    share = share.select((F.col("tokens") / F.col("total")).alias("p"), "n", "total")
    low, width = 0, STEPS  # the answer lies in (low, low + width], or is 0
    n = 16

    def meets(ks: list[int]) -> list[bool]:
        columns = []
        for i, k in enumerate(ks):
            a = k / STEPS
            columns += [
                F.sum(F.pow("p", F.lit(a))).alias(f"z{i}"),
                F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"s{i}"),
                F.max(F.pow("p", F.lit(a - 1))).alias(f"high{i}"),
                F.min(F.pow("p", F.lit(a - 1))).alias(f"low{i}"),
            ]
        r = share.agg(F.max("n").alias("n"), F.max("total").alias("total"), *columns).first()
        if not r["n"]:
            return [True] * len(ks)
        out = []
        for i, k in enumerate(ks):
            z = r[f"z{i}"]
            entropy = math.log(z) - k / STEPS * r[f"s{i}"] / z
            if mix.budget == "cover":
                repeats = r[f"high{i}"] / r[f"low{i}"]
            else:
                epochs = 1.0 if mix.budget == "total" else mix.budget / r["total"]
                repeats = r[f"high{i}"] / z * epochs
            out.append(entropy <= mix.entropy_share * math.log(r["n"]) + 1e-9 and repeats <= mix.most_repeats + 1e-9)
        return out

    if meets([0])[0]:
        return 0.0
    while width > 1:
        step = max(1, width // n)
        ks = [min(low + step * (i + 1), low + width) for i in range((width + step - 1) // step)]
        good = meets(ks)
        first = next((k for k, ok in zip(ks, good, strict=True) if ok), None)
        if first is None:
            return 1.0
        low, width = first - step, step
    return (low + width) / STEPS


def plan(docs: DataFrame, mix: Mix, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """A row per source: share, weight, target tokens, epochs, and where its part epoch ends."""
    rows = materialize(
        docs.select(
            F.col(id_col).cast("string").alias("id"), F.col(source).alias("source"), F.size(words(whole_text(text))).cast("bigint").alias("tokens")
        ),
        "tokens",
    )
    stats = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    a = exponent(stats, mix)
    whole = stats.agg(F.sum("tokens").cast("bigint").alias("total"))
    p = F.col("tokens") / F.col("total")
    shares = stats.crossJoin(F.broadcast(whole)).withColumn("raw", F.when(F.col("tokens") > 0, F.pow(p, F.lit(a))).otherwise(0.0))
    norm = shares.agg(F.sum("raw").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("raw"))).alias("cover"))
    budget = {"total": F.col("total").cast("double"), "cover": F.col("cover") * F.col("z")}.get(mix.budget, F.lit(mix.budget).cast("double"))
    target = F.floor(F.col("raw") / F.col("z") * budget + 1e-6)
    if mix.budget == "cover":
        target = F.greatest(target, F.col("tokens"))
    sources = (
        shares.crossJoin(F.broadcast(norm))
        .withColumn("target", F.when(F.col("tokens") > 0, target).otherwise(0))
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(1))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("target") - F.col("epochs") * F.col("tokens")).otherwise(0))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / mix.block_tokens)))
        .select("source", "tokens", (F.col("raw") / F.col("z")).alias("weight"), "target", "epochs", "rest", "n_blocks")
    )
    sources = materialize(sources, "plan")
    s = sources.where("rest > 0").select(F.col("source").alias("of"), "epochs", "rest", "n_blocks")
    placed = _by_source(rows, s, "source", "id", "of")
    placed = placed.withColumns(_places(mix, "id"))
    blocks = placed.groupBy("of", "block_key").agg(F.sum("tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    # first the range of keys (4096 a source) in which the part epoch ends, then the block in that range
    blocks = blocks.withColumn("range", F.substring("block_key", 1, 3))
    ranges = blocks.groupBy("of", "range").agg(F.sum("block_tokens").alias("range_tokens"), F.first("rest").alias("rest"))
    running = F.sum("range_tokens").over(Window.partitionBy("of").orderBy("range")) - F.col("range_tokens")
    hit = ranges.withColumn("before", running).where("before < rest and before + range_tokens >= rest").groupBy("of").agg(F.min(F.struct("range", (F.col("rest") - F.col("before")).alias("left"))).alias("h"))
    hit = hit.select(F.col("of").alias("hit_of"), F.col("h.range").alias("hit_range"), F.col("h.left").alias("left"))
    near = blocks.join(hit, F.col("of").eqNullSafe(F.col("hit_of")) & (F.col("range") == F.col("hit_range")))
    ends = (
        near.withColumn("before", F.sum("block_tokens").over(Window.partitionBy("of").orderBy("block_key")) - F.col("block_tokens"))
        .where("before < left and before + block_tokens >= left")
        .groupBy("of")
        .agg(F.min(F.struct("block_key", (F.col("left") - F.col("before")).alias("room"))).alias("e"))
        .select(F.col("of").alias("end_of"), F.col("e.block_key").alias("end_block"), F.col("e.room").alias("room"))
    )
    in_last = placed.join(ends, F.col("of").eqNullSafe(F.col("end_of")) & (F.col("block_key") == F.col("end_block")))
    within = Window.partitionBy("end_of").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        in_last.withColumn("filled", F.sum("tokens").over(within))
        .groupBy("end_of", "end_block")
        .agg(F.max(F.when(F.col("filled") <= F.col("room"), F.col("doc_key"))).alias("last_doc"))
    )
    ended = sources.join(last, F.col("source").eqNullSafe(F.col("end_of")), "left").drop("end_of")
    ended = materialize(ended, "ended")
    discard(rows, stats, sources)
    return ended


def _by_source(rows: DataFrame, per_source: DataFrame, source: str, id_col: str, of: str) -> DataFrame:
    """Rows beside their source's numbers.

    Where the plan is small enough to broadcast, Spark does so by its measured size;
    else both sides are dealt by source and one of 64 salts, so a source that holds a
    third of all rows is spread over 64 tasks.
    """
    salted = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = rows.withColumn("_mine", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    return mine.join(salted, F.col(source).eqNullSafe(F.col(of)) & (F.col("_mine") == F.col("_salt"))).drop("_mine", "_salt")


def _places(mix: Mix, id_col: str) -> dict[str, Column]:
    """block and doc keys of a row in the part epoch, from n_blocks, epochs, its source and id."""
    block = F.pmod(_number(_hash(str(mix.seed), F.col(id_col))), F.col("n_blocks"))
    seed = str(mix.seed)
    return {"block_key": _hash(seed, "block", F.col("epochs"), block), "doc_key": _hash(seed, "doc", F.col("epochs"), F.col(id_col))}


def mix_sources(docs: DataFrame, mix: Mix = Mix(), text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows repeated as the mix says, with epoch (from 0), block and order_key.

    Sorting an epoch by order_key gives its block permutation.  The plan has a row per
    source; whether it is broadcast is left to its measured size.
    """
    p = plan(docs, mix, text, id_col, source).select(
        F.col("source").alias("_of"), F.col("epochs").alias("_epochs"), F.col("n_blocks").alias("_n_blocks"), F.col("end_block").alias("_end"), F.col("last_doc").alias("_last")
    )
    seed = str(mix.seed)
    joined = _by_source(docs, p, source, id_col, "_of")
    block = F.pmod(_number(_hash(seed, F.col(id_col))), F.col("_n_blocks"))
    block_key = _hash(seed, "block", F.col("_epochs"), block)
    doc_key = _hash(seed, "doc", F.col("_epochs"), F.col(id_col))
    taken = (block_key < F.col("_end")) | ((block_key == F.col("_end")) & (doc_key <= F.col("_last")))
    copies = F.col("_epochs") + F.when(F.coalesce(taken, F.lit(False)), 1).otherwise(0)
    out = joined.withColumn("block", block).withColumn("_copies", copies.cast("int")).where("_copies > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    order = F.concat_ws("-", F.substring(_hash(seed, "block", F.col("epoch"), F.col("block")), 1, 12), F.substring(_hash(seed, "doc", F.col("epoch"), F.col(id_col)), 1, 12))
    return out.withColumn("order_key", order).drop("_of", "_epochs", "_n_blocks", "_end", "_last", "_copies")
