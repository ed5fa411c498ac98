"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings.

Scores are integer inner products of vectors whose components are floored multiples.  With
one more component, sqrt(M*M - |x|*|x|) for rows and 0 for queries, a higher score is a
smaller distance, and a window of scores is an annulus of distances around the query.

The tree's root lies across the cluster: split points, fitted on a bounded sample, deal rows
into cells by the nearest one, and each split point knows the range of distances to every
cell.  Large cells are dealt on into shards.  In a shard the tree goes on: each node has a
few split points, each child the rows nearest to one of them, and every split point stores
its range of distances to each sibling.  A query drops a sibling whose range does not meet
its window's annulus, and by the hyperplane between split points; the outer radius shrinks
to the best rows found so far.  Leaves are exact: all their rows are scored.  Equal scores
are never dropped by a bound, so ties are exact as well.

Anchors ask in blocks of queries: a block goes to the cells that one of its queries cannot
rule out, each task takes one block and one shard, and returns the first few rows per query.
Bounds start from the sample's own rows.

Of equal rows (label and vector) only the smallest ids can be among an anchor's first few, so
one more than that many stand for the group in the tree, and equal anchors ask once.  Nothing
else is left out: all rows that could be returned are in a leaf.

Defined results: a row with a null id, label or vector, or a null or non-finite component
takes no part.  Components are held within a bound at which scores stay exact (2**21 for 64
components).  Vectors of different lengths do not meet; empty ones score 0 with each other.
Repeated rows count each: an anchor's positives leave out that row alone, equal ids follow in
any order of their equal rows.  A window below a negative positive score is empty.  Other
columns, whatever their names, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.llm.common import discard, materialize


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    #: The window's lower end in hundredths of the positive's score.
    least_percent: int = 80
    scale: int = 256
    shard_rows: int = 2048
    block_rows: int = 2048
    most_cells: int = 512
    fit_rows: int = 4096
    fit_bytes: int = 32 << 20
    branches: int = 12
    leaf: int = 96
    salts: int = 16

    @property
    def near(self) -> int:
        return max(self.positives + 1, self.negatives)


NONE = -(1 << 62)
#: Room for a row's rank within its shard beside its score in one number.
RANKS = 1 << 13


@dataclass(frozen=True)
class Node:
    """A node's slice of the shard.  Inner ones: centers (k x d+1), low and high: range of distances from center i to child j, whose own center is own[j]."""

    rows: tuple[int, int]
    marks: int
    label: int | None
    centers: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    own: np.ndarray | None = None
    children: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Shard:
    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    keys: np.ndarray
    rank: np.ndarray
    longest: float
    root: Node


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the component that makes all of them as long as the longest one."""
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, for rounding, of the distances between the rows of a and b."""
    d = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)
    slack = 1e-9 * (longest + (a * a).sum(axis=1)[:, None])
    return np.sqrt(np.maximum(d - slack, 0)), np.sqrt(d + slack)


def far_apart(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of 3k drawn ones, each the farthest from those before it."""
    drawn = x[rng.permutation(len(x))[: 3 * k]]
    picked = [0]
    gap = ((drawn - drawn[0]) ** 2).sum(axis=1)
    while len(picked) < min(k, len(drawn)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((drawn - drawn[picked[-1]]) ** 2).sum(axis=1))
    return drawn[picked]


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // max(1, len(centers)))
    of = (centers * centers).sum(axis=1)
    return np.concatenate([(of - 2 * (x[i : i + step] @ centers.T)).argmin(axis=1) for i in range(0, len(x), step)])


def ranges(centers: np.ndarray, x: np.ndarray, cell: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of every center to the rows of each cell; an empty cell has an empty range."""
    k = len(centers)
    low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for j in np.unique(cell):
        a, b = distances(x[cell == j], centers, longest)
        low[:, j], high[:, j] = a.min(axis=0), b.max(axis=0)
    return low, high


def grow(x: np.ndarray, labels: np.ndarray, longest: float, g: Mining) -> tuple[np.ndarray, Node]:
    """Order of the rows, and the tree over them in that order."""
    order, rng, full = np.arange(len(x)), np.random.default_rng(3), lifted(x, longest)

    def node(a: int, b: int) -> Node:
        own = order[a:b]
        marks = int(np.bitwise_or.reduce(np.uint64(1) << (labels[own] % 64).astype(np.uint64)))
        one = int(labels[own[0]]) if (labels[own] == labels[own[0]]).all() else None
        if b - a > g.leaf:
            centers = far_apart(full[own], g.branches, rng)
            cell = nearest(full[own], centers)
            if len(np.unique(cell)) > 1:
                low, high = ranges(centers, full[own], cell, longest)
                order[a:b] = own[np.argsort(cell, kind="stable")]
                ends = a + np.cumsum(np.bincount(cell, minlength=len(centers)))
                kept = np.unique(cell)
                children = tuple(node(int(ends[j - 1]) if j else a, int(ends[j])) for j in kept)
                return Node((a, b), marks, one, centers, low[:, kept], high[:, kept], kept, children)
        return Node((a, b), marks, one)

    return order, node(0, len(x))


@dataclass
class Queries:
    """lo and hi: the window of scores; floor: a score that `k` rows are known to reach."""

    x: np.ndarray
    labels: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    floor: np.ndarray
    k1: np.ndarray
    k2: np.ndarray


def reach(squares: np.ndarray, hi: np.ndarray, floor: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner and outer radius of the annulus in which scores of floor to hi lie."""
    both = squares + longest
    slack = 1e-9 * both
    inner = np.where(hi >= -NONE, 0, np.sqrt(np.maximum(both - 2.0 * hi - slack, 0)))
    return inner, np.where(floor <= NONE, np.inf, np.sqrt(np.maximum(both - 2.0 * np.maximum(floor, NONE), 0) + slack))


def bounds(dl: np.ndarray, dh: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from each query to the rows of each child, whose split point is own[child]."""
    least, most = np.full((len(dl), low.shape[1]), 0.0), np.full((len(dl), low.shape[1]), np.inf)
    for i in range(low.shape[0]):
        least = np.maximum(least, np.maximum(dl[:, i, None] - high[i], low[i] - dh[:, i, None]))
        most = np.minimum(most, dh[:, i, None] + high[i])
    return np.maximum(least, (dl[:, own] - dh.min(axis=1)[:, None]) / 2), most


def search(shard: Shard, q: Queries, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's first k rows with its label, or with another, in its window."""
    best = np.full((len(q.x), k), NONE, np.int64)
    floor = np.maximum(q.lo, q.floor)
    full, squares = np.concatenate([q.x, np.zeros((len(q.x), 1))], axis=1), (q.x * q.x).sum(axis=1)
    marks = np.uint64(1) << (q.labels % 64).astype(np.uint64)

    def visit(node: Node, asking: np.ndarray) -> None:
        if same:
            asking = asking[(marks[asking] & np.uint64(node.marks)) != 0]
        elif node.label is not None:
            asking = asking[q.labels[asking] != node.label]
        if not len(asking):
            return
        if not node.children:
            a, b = node.rows
            s = (q.x[asking] @ shard.x[a:b].T).astype(np.int64)
            alike = q.labels[asking, None] == shard.labels[a:b]
            fit = (alike == same) & (s >= floor[asking, None]) & (s <= q.hi[asking, None])
            key = np.where(fit, s * RANKS + (RANKS - 1 - shard.rank[a:b]), NONE)
            key = np.concatenate([best[asking], key], axis=1)
            best[asking] = -np.sort(-np.partition(key, key.shape[1] - k, axis=1)[:, -k:], axis=1)
            last = best[asking, -1]
            floor[asking] = np.where(last > NONE, np.maximum(floor[asking], last // RANKS), floor[asking])
            return
        dl, dh = distances(full[asking], node.centers, shard.longest)
        least, most = bounds(dl, dh, node.low, node.high, node.own)
        for j in np.argsort(least.sum(axis=0), kind="stable"):
            inner, outer = reach(squares[asking], q.hi[asking], floor[asking], shard.longest)
            visit(node.children[j], asking[(least[:, j] <= outer) & (most[:, j] >= inner)])

    visit(shard.root, np.arange(len(q.x)))
    query, at = np.nonzero(best > NONE)
    key = best[query, at]
    by_rank = np.argsort(shard.rank)
    return query, by_rank[RANKS - 1 - key % RANKS], key // RANKS


def _vectors(rows: DataFrame, id_col: str, vector: str, label: Column, g: Mining) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = F.floor(F.sqrt(F.lit(2.0**48) / F.greatest(F.size(v), F.lit(1))))
    y = F.transform(v, lambda c: F.greatest(-most, F.least(most, F.floor(c * g.scale))))
    picked = rows.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), F.when(good, y).alias("y"))
    picked = picked.where("id is not null and label is not null and y is not null")
    return picked.withColumns({"k1": F.xxhash64("label", "y", F.lit(1)), "k2": F.xxhash64("label", "y", F.lit(2))})


@dataclass(frozen=True)
class Root:
    """The tree's root for vectors of one length: split points, and after the shards are built their ranges to the cells."""

    centers: np.ndarray
    longest: float
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _sample(rows: DataFrame, g: Mining) -> tuple[pd.DataFrame, int]:
    """A bounded sample of the rows, in the order of a hash, and the number of all rows."""
    n, widest = rows.agg(F.count("*"), F.max(F.size("y"))).first()
    most = max(1, min(g.fit_rows, g.fit_bytes // (8 * max(1, widest or 0))))
    return rows.orderBy(F.xxhash64("id", F.lit(5)), "k1").limit(most).select("label", "y").toPandas(), n


def _matrix(y: pd.Series, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in y], np.float64).reshape(len(y), dim)


def _roots(sample: pd.DataFrame, n: int, rows: DataFrame, g: Mining) -> dict[int, Root]:
    squares = F.aggregate("y", F.lit(0.0), lambda a, c: a + c * c)
    length = sample["y"].map(len)
    known = [int(d) for d in length.unique()]
    longest = {r["dim"]: r["m"] for r in rows.groupBy(F.size("y").alias("dim")).agg(F.max(squares).alias("m")).where(F.col("dim").isin(known)).collect()}
    out = {}
    for dim in known:
        x = _matrix(sample["y"][length == dim], dim)
        k = int(min(max(1, np.ceil(n * len(x) / len(sample) / g.shard_rows)), g.most_cells))
        out[dim] = Root(far_apart(lifted(x, longest[dim]), k, np.random.default_rng(2)), longest[dim])
    return out


def _deal(rows: DataFrame, roots: dict[int, Root], g: Mining) -> DataFrame:
    """Rows with dim, cell (0 where the sample has no such length) and a part of the cell of about `shard_rows` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["dim"], b["cell"] = b["y"].map(len).astype("int32"), np.int32(0)
            for dim, of in b.groupby("dim"):
                if dim in roots:
                    b.loc[of.index, "cell"] = nearest(lifted(_matrix(of["y"], dim), roots[dim].longest), roots[dim].centers).astype("int32")
            yield b

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    dealt = materialize(rows.mapInPandas(run, f"{kinds}, dim int, cell int"), "dealt")
    known = F.col("dim").isin(list(roots)) if roots else F.lit(False)
    counts = dealt.groupBy(F.when(known, F.col("dim")).alias("dim"), F.when(known, F.col("cell")).alias("cell")).count().collect()
    rest = next((r["count"] for r in counts if r["dim"] is None), 0)  # of lengths that the sample lacks
    parts = [(r["dim"], r["cell"], -(-r["count"] // g.shard_rows)) for r in counts if r["dim"] is not None]  # no more than the sample has rows
    many = F.broadcast(rows.sparkSession.createDataFrame(parts, "dim int, cell int, parts int"))
    part = F.pmod(F.xxhash64("id", "k1", F.lit(4)), F.coalesce("parts", F.lit(-(-rest // g.shard_rows)), F.lit(1))).cast("int")
    return dealt.join(many, ["dim", "cell"], "left").withColumn("part", part).drop("parts")


def _shards(dealt: DataFrame, roots: dict[int, Root], g: Mining) -> DataFrame:
    """One row per shard: its tree, and its distances to the root's split points."""

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        dim, cell, part = (int(k) for k in key)
        out = []
        # hashes deal unevenly: a little more than shard_rows is usual, far more (as of a length the sample lacks) is cut
        for at in range(0, len(p), RANKS):
            own = p.iloc[at : at + RANKS]
            x, labels, ids = _matrix(own["y"], dim), own["label"].to_numpy(), own["id"].to_numpy()
            longest = float((x * x).sum(axis=1).max())
            order, root = grow(x, labels, longest, g)
            x, ids, labels, keys = x[order], ids[order], labels[order], own["k1"].to_numpy()[order]
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            low = high = None
            if dim in roots:
                a, b = distances(lifted(x, roots[dim].longest), roots[dim].centers, roots[dim].longest)
                low, high = a.min(axis=0), b.max(axis=0)
            small = x.astype(np.int32) if np.abs(x).max(initial=0) < 2**31 else x
            out.append((dim, cell, part, at // RANKS, pickle.dumps((low, high)), pickle.dumps(Shard(small, ids, labels, keys, rank, longest, root))))
        return pd.DataFrame(out, columns=["dim", "cell", "part", "piece", "reach", "shard"])

    made = dealt.groupBy("dim", "cell", "part").applyInPandas(build, "dim int, cell int, part int, piece int, reach binary, shard binary")
    return materialize(made, "shards")


def _with_ranges(roots: dict[int, Root], shards: DataFrame) -> dict[int, Root]:
    """Ranges from split points to cells: two numbers for each pair, collected for each cell."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        both = [pickle.loads(r) for r in p["reach"]]
        low, high = np.min([b[0] for b in both], axis=0), np.max([b[1] for b in both], axis=0)
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "low": [low], "high": [high]})

    if not roots:
        return roots
    told = shards.where(F.col("dim").isin(list(roots))).select("dim", "cell", "reach").groupBy("dim", "cell").applyInPandas(run, "dim int, cell int, low array<double>, high array<double>")
    out = {}
    rows = told.collect()  # most_cells rows for each of the sample's lengths at most
    for dim, root in roots.items():
        k = len(root.centers)
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for r in rows:
            if r["dim"] == dim:
                low[:, r["cell"]], high[:, r["cell"]] = r["low"], r["high"]
        out[dim] = Root(root.centers, root.longest, low, high)
    return out


def _blocks(asked: DataFrame, n: int, roots: dict[int, Root], sample: pd.DataFrame, k: int, same: bool, g: Mining) -> DataFrame:
    """Queries (k1, k2, label, y, dim, cell, lo, hi) in blocks of neighbours, with the cells that each block must ask."""
    lengths = sample["y"].map(len)
    seeds = {int(d): (_matrix(sample["y"][lengths == d], int(d)), sample["label"][lengths == d].to_numpy()) for d in lengths.unique()}

    def floors(q: Queries, dim: int) -> np.ndarray:
        """The k-th best score within the sample."""
        x, labels = seeds[dim]
        out = np.full(len(q.x), NONE, np.int64)
        if len(x) >= k:
            for i in range(0, len(q.x), 256):
                s = (q.x[i : i + 256] @ x.T).astype(np.int64)
                fit = ((q.labels[i : i + 256, None] == labels) == same) & (s <= q.hi[i : i + 256, None]) & (s >= q.lo[i : i + 256, None])
                out[i : i + 256] = np.partition(np.where(fit, s, NONE), len(x) - k, axis=1)[:, len(x) - k]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for dim, of in b.groupby("dim"):
                dim = int(dim)
                for at in range(0, len(of), g.block_rows):
                    p = of.iloc[at : at + g.block_rows]
                    q = Queries(_matrix(p["y"], dim), *[p[c].to_numpy() for c in ("label", "lo", "hi")], np.full(len(p), NONE, np.int64), p["k1"].to_numpy(), p["k2"].to_numpy())
                    cells = np.array([0])
                    if dim in roots:
                        root = roots[dim]
                        q.floor = floors(q, dim)
                        dl, dh = distances(np.concatenate([q.x, np.zeros((len(p), 1))], axis=1), root.centers, root.longest)
                        least, most = bounds(dl, dh, root.low, root.high, np.arange(len(root.centers)))
                        inner, outer = reach((q.x * q.x).sum(axis=1), q.hi, np.maximum(q.lo, q.floor), root.longest)
                        cells = np.flatnonzero(((least <= outer[:, None]) & (most >= inner[:, None])).any(axis=0) & (root.high[0] >= 0))
                    q.x = q.x.astype(np.int32) if np.abs(q.x).max(initial=0) < 2**31 else q.x
                    yield pd.DataFrame({"dim": [dim], "block": [f"{part}-{number}"], "cells": [cells.astype(np.int32)], "queries": [pickle.dumps(q)]})
                    number += 1

    dealt = asked.repartitionByRange(max(1, -(-n // g.block_rows)), "dim", "cell", "k1", "hi")
    return materialize(dealt.mapInPandas(run, "dim int, block string, cells array<int>, queries binary"), "blocks")


def _ask(blocks: DataFrame, shards: DataFrame, k: int, same: bool) -> DataFrame:
    """Each block asks the shards of its cells: columns k1, k2, hi, id, row_key, score; the first k rows of every shard."""
    pairs = blocks.select("dim", "block", F.explode("cells").alias("cell")).join(shards.select("dim", "cell", "part", "piece"), ["dim", "cell"])
    left = blocks.select("dim", "block", "queries").join(pairs, ["dim", "block"])
    right = shards.select("dim", "cell", "part", "piece", "shard").join(pairs, ["dim", "cell", "part", "piece"])
    by = ["dim", "cell", "part", "piece", "block"]
    right = right.select("shard", *[F.col(c).alias(c) for c in by])  # columns of its own, not those of `left`

    def run(key: tuple, asks: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        q, shard = pickle.loads(asks["queries"].iloc[0]), pickle.loads(given["shard"].iloc[0])
        q.x = q.x.astype(np.float64)
        whole = Shard(shard.x.astype(np.float64), shard.ids, shard.labels, shard.keys, shard.rank, shard.longest, shard.root)
        query, row, score = search(whole, q, k, same)
        return pd.DataFrame({"k1": q.k1[query], "k2": q.k2[query], "hi": q.hi[query], "id": shard.ids[row], "row_key": shard.keys[row], "score": score})

    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, "k1 long, k2 long, hi long, id long, row_key long, score long")
    first = F.row_number().over(W.partitionBy("k1", "k2", "hi").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", first).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | None = None, g: Mining = Mining()) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: a condition on the column id.  label: an integer column of `rows`, by default
    `label`.
    """
    spark = rows.sparkSession
    given = F.col("label") if label is None else label
    every = materialize(_vectors(rows, id_col, vector, given.cast("bigint"), g).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    by_id = W.partitionBy("k1", "k2").orderBy("id", "uid")
    ahead = every.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= g.near)
    anchors = every.where(F.coalesce(anchor, F.lit(False))).select(F.col("id").alias("anchor_id"), "uid", "k1", "k2")
    sample, n = _sample(every, g)
    roots = _roots(sample, n, every, g)
    dealt = _deal(ahead.select("id", "label", "y", "k1", "k2", "place"), roots, g)
    shards = _shards(dealt, roots, g)
    roots = _with_ranges(roots, shards)
    asking = dealt.where("place = 1").join(anchors.select("k1", "k2").distinct(), ["k1", "k2"]).select("k1", "k2", "label", "y", "dim", "cell")
    asking = materialize(asking, "asking")
    nothing = F.lit(NONE)
    blocks = _blocks(asking.withColumns({"lo": nothing, "hi": -nothing}), asking.count(), roots, sample, g.near, True, g)
    near = materialize(_ask(blocks, shards, g.near, True).drop("hi", "rank"), "near")

    # equal anchors may be many: what they share is joined in salted copies
    salts = F.explode(F.sequence(F.lit(0), F.lit(g.salts - 1)))
    salt = F.pmod(F.xxhash64("uid"), F.lit(g.salts)).cast("int")
    theirs = anchors.withColumn("salt", salt).join(near.withColumn("salt", salts), ["k1", "k2", "salt"])
    itself = (F.col("id") == F.col("anchor_id")) & (F.col("row_key") == F.col("k1"))
    own = F.row_number().over(W.partitionBy("uid", itself).orderBy("id"))
    others = theirs.withColumn("own", F.when(itself, own)).where("own is null or own > 1")
    place = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "id"))
    positives = others.withColumn("place", place).where(F.col("place") <= g.positives)
    positives = materialize(positives.select("anchor_id", "uid", "salt", "k1", "k2", F.col("id").alias("positive_id"), "place", F.col("score").alias("hi")), "positives")

    windows = positives.where("hi >= 0").select("k1", "k2", "hi").distinct().join(asking, ["k1", "k2"])
    windows = materialize(windows.withColumn("lo", F.expr(f"({g.least_percent} * hi + 99) div 100")), "windows")
    blocks_b = _blocks(windows, windows.count(), roots, sample, g.negatives, False, g)
    hard = materialize(_ask(blocks_b, shards, g.negatives, False), "hard")
    discard(blocks, blocks_b, shards, dealt, asking, near, windows)
    hard = hard.select("k1", "k2", "hi", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), salts.alias("salt"))
    return positives.join(hard, ["k1", "k2", "hi", "salt"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("hi").alias("positive_score"), "negative_score")
