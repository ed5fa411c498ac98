"""Codes for vectors: each of 16 equal parts is named by its nearest codebook entry.

Dual-tree Lloyd.  Rows are dealt into blocks.  For each part position a block has a tree
over its parts: a node holds its box, its count and the sum of its parts.  The codebook of
the position has such a tree as well.  Both are walked together, level by level: bounds of
the distance between the boxes of a pair of nodes prune entries that cannot be nearest to
anything in the node.  A node for which one entry is left takes it as a whole, by its sum
and count; leaves where several are left compare distances point by point.  All of it is
integer arithmetic, so sums do not depend on how rows are dealt out.

Trees are built once and written; each round is one pass over them that returns a count and
a sum per entry and task.  Codebooks (entries x dimension integers) are all that the driver
holds.

Defined results: a component x counts as floor(scale * x), held within a bound at which the
errors of a row fit a long (2**27 for 64 components).  Rows whose vector is null, or holds
null or non-finite components, are dropped, and so are vectors whose length is not that of
the smallest kept id's or no multiple of `parts`.  Equal ids are ordered by their vectors;
null ids come last, and such rows are coded too.  With fewer kept rows than entries the
codebooks have as many entries as rows; without any there are no rows.  Repeated rows have
equal codes and count each.  Null labels form one group.  Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.llm.common import discard, materialize


@dataclass(frozen=True)
class Codes:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    block_rows: int = 8192
    leaf: int = 16
    salts: int = 16


@dataclass(frozen=True)
class Level:
    """Nodes of one depth: node i holds points order[begins[i]:begins[i + 1]], its children are first[i]:first[i + 1] of the next level."""

    begins: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    total: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.begins)


@dataclass(frozen=True)
class Tree:
    order: np.ndarray
    levels: list[Level]


def grow(points: np.ndarray, leaf: int) -> Tree:
    """A tree over integer points; nodes above `leaf` points are halved along their widest side, copies of one point stay together."""
    order, begins, levels = np.arange(len(points)), np.array([0, len(points)]), []
    while True:
        own, at = points[order], begins[:-1]
        lo, hi, total = (f.reduceat(own, at, axis=0) for f in (np.minimum, np.maximum, np.add))
        size = np.diff(begins)
        wide = (size > leaf) & (hi > lo).any(axis=1)
        levels.append(Level(begins, lo, hi, total, np.concatenate(([0], np.cumsum(1 + wide)))))
        if not wide.any():
            return Tree(order, levels)
        node = np.repeat(np.arange(len(size)), size)
        order = order[np.lexsort((own[np.arange(len(own)), (hi - lo).argmax(axis=1)[node]], node))]
        begins = np.sort(np.concatenate([begins, (at + size // 2)[wide]]))


def _children(nodes: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """(index into nodes, child) of all children."""
    n = level.first[nodes + 1] - level.first[nodes]
    owner = np.repeat(np.arange(len(nodes)), n)
    return owner, level.first[nodes][owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and each key's run."""
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


def _prune(p: np.ndarray, e: np.ndarray, a: Level, b: Level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node of a, node of b), sorted by the first, without those whose nearest points are farther apart than another pair's farthest."""
    near = np.maximum(np.maximum(b.lo[e] - a.hi[p], a.lo[p] - b.hi[e]), 0)
    far = np.maximum(a.hi[p] - b.lo[e], b.hi[e] - a.lo[p])
    starts, run = _groups(p)
    keep = (near * near).sum(axis=1) <= np.minimum.reduceat((far * far).sum(axis=1), starts)[run]
    return p[keep], e[keep]


@dataclass(frozen=True)
class Assigned:
    """Whole nodes (depth, nodes, entries), and single points with their entries."""

    whole: list[tuple[int, np.ndarray, np.ndarray]]
    points: np.ndarray
    entries: np.ndarray


def assign(points: np.ndarray, tree: Tree, book: np.ndarray, book_tree: Tree) -> Assigned:
    """The nearest entry of every point, the lower index on ties."""
    p, e, whole, depth, book_depth = np.zeros(1, np.int64), np.zeros(1, np.int64), [], 0, 0
    last, book_last = len(tree.levels) - 1, len(book_tree.levels) - 1
    ends = book_tree.levels[-1]
    named = np.minimum.reduceat(book_tree.order, ends.begins[:-1])  # equal entries share a node: the first one counts
    while True:
        for _ in range(2 if depth < last else book_last):
            if book_depth < book_last:
                owner, e = _children(e, book_tree.levels[book_depth])
                p, book_depth = p[owner], book_depth + 1
                p, e = _prune(p, e, tree.levels[depth], book_tree.levels[book_depth])
        if book_depth == book_last and len(p):
            starts, run = _groups(p)
            alone = np.bincount(run)[run] == 1
            whole.append((depth, p[alone], named[e[alone]]))
            p, e = p[~alone], e[~alone]
        if depth == last or not len(p):
            break
        owner, p = _children(p, tree.levels[depth])
        e, depth = e[owner], depth + 1
        order = np.argsort(p, kind="stable")
        p, e = _prune(p[order], e[order], tree.levels[depth], book_tree.levels[book_depth])
    if not len(p):
        return Assigned(whole, np.empty(0, np.int64), np.empty(0, np.int64))
    entry = named[e]
    order = np.lexsort((entry, p))
    p, entry = p[order], entry[order]
    starts, run = _groups(p)
    n_entries, nodes, level = np.bincount(run), p[starts], tree.levels[depth]
    size = level.count[nodes]
    leaf = np.repeat(np.arange(len(nodes)), size)
    mine = tree.order[level.begins[nodes][leaf] + np.arange(len(leaf)) - (np.cumsum(size) - size)[leaf]]
    n = n_entries[leaf]
    owner, begins = np.repeat(np.arange(len(mine)), n), np.cumsum(n) - n
    asked = entry[starts[leaf][owner] + np.arange(len(owner)) - begins[owner]]
    gap = points[mine[owner]] - book[asked]
    d = (gap * gap).sum(axis=1)
    hits = np.flatnonzero(d == np.minimum.reduceat(d, begins)[owner])
    return Assigned(whole, mine, asked[hits[np.unique(owner[hits], return_index=True)[1]]])


def sums(points: np.ndarray, tree: Tree, found: Assigned, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of each entry's points."""
    count, total = np.zeros(n, np.int64), np.zeros((n, points.shape[1]), np.int64)
    for depth, nodes, entries in found.whole:
        np.add.at(count, entries, tree.levels[depth].count[nodes])
        np.add.at(total, entries, tree.levels[depth].total[nodes])
    np.add.at(count, found.entries, 1)
    np.add.at(total, found.entries, points[found.points])
    return count, total


def codes(tree: Tree, found: Assigned) -> np.ndarray:
    out = np.empty(len(tree.order), np.int64)
    for depth, nodes, entries in found.whole:
        level = tree.levels[depth]
        size = level.count[nodes]
        run = np.repeat(np.arange(len(nodes)), size)
        out[tree.order[level.begins[nodes][run] + np.arange(len(run)) - (np.cumsum(size) - size)[run]]] = entries[run]
    out[found.points] = found.entries
    return out


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * component) as longs; null unless every component is finite.

    They are held within a bound at which squared distances of a row, and products of two
    rows, fit a long.
    """
    v = vector.cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(F.size(v), F.lit(1))))
    return F.when(good, F.transform(v, lambda c: F.greatest(-most, F.least(most, F.floor(c * scale)))))


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _blocks(dim: int, g: Codes):
    """Blocks of rows with their trees, one row each."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        t = table.combine_chunks()
        columns = [t.column(c).combine_chunks() for c in ("id", "label", "y")]
        ids, labels, y = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns)
        x = _matrix(y, dim)
        trees = [grow(np.ascontiguousarray(part), g.leaf) for part in np.split(x, g.parts, axis=1)]
        small = x.astype(np.int32) if np.abs(x).max() < 2**31 else x
        ends = pa.array([0, len(x)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), pa.array([pickle.dumps((small, trees))], pa.binary())], ["ids", "labels", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= g.block_rows:
                t = pa.Table.from_batches(held)
                for at in range(0, n - g.block_rows + 1, g.block_rows):
                    yield emit(t.slice(at, g.block_rows))
                rest = t.slice(n - n % g.block_rows)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield emit(pa.Table.from_batches(held))

    return run


def _parts(blocks: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, int, list]]:
    """(batch, row, [(points, tree, what was assigned)] by position) of each block."""
    book_trees = [grow(b, 1) for b in books]
    for batch in blocks:
        for i, packed in enumerate(batch.column("block")):
            x, trees = pickle.loads(packed.as_py())
            split = [np.ascontiguousarray(s) for s in np.split(x.astype(np.int64), len(books), axis=1)]
            yield batch, i, [(s, t, assign(s, t, b, bt)) for s, t, b, bt in zip(split, trees, books, book_trees, strict=True)]


def _improve(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of its parts; entries without parts stay."""
    n_parts, n, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((n_parts, n), np.int64), np.zeros((n_parts, n, width), np.int64)
        for _, _, parts in _parts(batches, books):
            for k, (points, tree, found) in enumerate(parts):
                c, t = sums(points, tree, found, n)
                count[k] += c
                total[k] += t
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "total"],
        )

    told = blocks.select("block").mapInArrow(run, "part int, entry int, n long, total array<long>")
    found = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(width)]).alias("total"))
    new = books.copy()
    for r in found.collect():  # parts x entries rows at most
        new[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return new


def _coded(blocks: DataFrame, books: np.ndarray, id_type: str, label_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, parts in _parts(batches, books):
            own = np.stack([codes(tree, found) for _, tree, found in parts], axis=1)
            gaps = [points - books[k][own[:, k]] for k, (points, _, _) in enumerate(parts)]
            error = sum((gap * gap).sum(axis=1) for gap in gaps)
            text = [bytes(r).hex() for r in own.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {id_type}, label {label_type}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def learn(kept: DataFrame, g: Codes) -> tuple[np.ndarray, DataFrame] | None:
    """Codebooks (parts x entries x width) after the rounds, and the blocks that were read; None without rows.

    kept: columns id, label, y (of equal length).
    """
    first = kept.orderBy(F.col("id").asc_nulls_last(), "y").limit(g.entries).collect()
    if not first:
        return None
    x = np.array([r["y"] for r in first], np.int64)
    books = np.stack(np.split(x, g.parts, axis=1))
    types = dict(kept.dtypes)
    blocks = kept.mapInArrow(_blocks(x.shape[1], g), f"ids array<{types['id']}>, labels array<{types['label']}>, block binary")
    blocks = materialize(blocks, "blocks")
    for _ in range(g.rounds):
        books = _improve(blocks, books)
    return books, blocks


def compress(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", g: Codes = Codes()) -> DataFrame:
    """Columns id_col, code, error, label_error, codebooks_sha256: one row per kept row."""
    if g.entries > 256:
        raise ValueError("a code has one byte a part: at most 256 entries")
    spark, types = rows.sparkSession, dict(rows.dtypes)
    y = whole_numbers(F.col(vector), g.scale)
    kept = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), y.alias("y")).where("y is not null")
    smallest = kept.orderBy(F.col("id").asc_nulls_last(), "y").select(F.size("y").alias("n")).first()
    dim = smallest["n"] if smallest else 0
    found = learn(kept.where(F.size("y") == dim), g) if dim and dim % g.parts == 0 else None
    if found is None:
        schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType)])
        for name, kind in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType())):
            schema = schema.add(name, kind)
        return spark.createDataFrame([], schema)
    books, blocks = found
    coded = materialize(_coded(blocks, books, types[id_col], types[label]), "coded")
    discard(blocks)
    # a label may hold a third of all rows: its sum is joined in salted copies
    salt = F.pmod(F.xxhash64("code", "id"), F.lit(g.salts)).cast("int")
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(g.salts - 1))).alias("at"))
    joined = coded.withColumn("salt", salt).join(total, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
