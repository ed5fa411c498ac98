"""Embedding near duplicates through a robust-pruned flat graph.

Rows with equal label and vector form one class, so copies cost nothing.  Classes go to
cluster shards: centroids per label, fitted on a bounded sample, take about `shard_rows`
classes each, and every class goes to its `overlap` nearest ones.  In each shard a flat
graph is built: every node's nearest candidates are robust-pruned (a candidate is dropped
when a kept one is nearer to it by the factor `alpha`), and links run both ways.  The
adjacency lists of all shards are united per node.  Each class then searches its shards
greedily from the shard's medoid and its own node with a beam, and the range expands
from every node in range over the united lists until nothing new is in range.  Links are
verified by cosine in double precision; a pair that meets in several shards counts in one.

An audit compares a bounded set of classes, by brute force in blocks, with all classes.
It draws more of them until `audit_links` true links are met or `most_audit` classes are
asked; each class counts alike, however many copies it or its neighbours have.  Below
`target_recall` the search is repeated with more overlap and a wider beam.  Where so few
links are met that nothing is proven, the audit asks classes that signs of random projections
see linked.  What then stays below 0.9, or cannot be measured at all, is searched exactly:
every part of a label's vectors meets every other in a block product.

Shards above `most_rows` are cut into parts: each part builds its own graph, and each
part's classes search every part's graph in a task of their own.  So no task holds more
than two parts, even when one cluster holds a third of all.
Tasks return counts and one link per member of a group, never all pairs.

Defined results: a vector that is null, zero, or holds null or non-finite components
links with nothing, nor does one with a null label; each is its own component.  Vectors of
different lengths do not link.  Components may be as large or small as doubles go: vectors
are scaled by their largest one before anything is squared.  Other columns, whatever their
names, are not read.  Repeated rows link with each other.  A null id has
no links, no component, and is not kept.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import materialize
from foliate.llm.components import connected_components


@dataclass(frozen=True)
class Graph:
    cosine: float = 0.98
    shard_rows: int = 1000
    most_rows: int = 20_000
    overlap: int = 2
    candidates: int = 40
    degree: int = 14
    alpha: float = 1.2
    beam: int = 20
    fit_rows: int = 20_000
    most_centroids: int = 4096
    audit_rows: int = 500
    most_audit: int = 8000
    audit_links: int = 100
    target_recall: float = 0.97
    fit_bytes: int = 64 << 20
    hash_tables: int = 6
    exact: bool = False


def unit(raw: pd.Series) -> np.ndarray:
    """Rows of packed doubles, scaled to length one."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@dataclass(frozen=True)
class Lists:
    """Adjacency lists, one behind the other, and where each begins; a hub takes no more than its own links."""

    begins: np.ndarray
    nodes: np.ndarray

    @staticmethod
    def of(src: np.ndarray, dst: np.ndarray, n: int) -> Lists:
        """src is sorted."""
        return Lists(np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n)))), dst)

    def near(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `nodes`, neighbour) of all their neighbours."""
        count = self.begins[nodes + 1] - self.begins[nodes]
        owner = np.repeat(np.arange(len(nodes)), count)
        shift = self.begins[nodes] - (np.cumsum(count) - count)
        return owner, self.nodes[np.arange(len(owner)) + shift[owner]]


def build(x: np.ndarray, g: Graph, seed: int = 1) -> Lists:
    """Neighbours of each node: robust-pruned candidates, both ways."""
    n = len(x)
    if n == 1:
        return Lists(np.zeros(2, np.int64), np.empty(0, np.int64))
    x = x.astype(np.float32)
    k = min(g.candidates, n - 1)
    far = np.random.default_rng(seed).integers(0, n, (n, 4))  # a few long links
    picked = np.full((n, g.degree), -1, np.int32)
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        cand = np.concatenate([near, far[rows]], axis=1)
        d = 2 - 2 * np.take_along_axis(s, cand, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
        alive = cand != rows[:, None]
        vectors = x[cand]
        i = np.arange(len(rows))
        for r in range(g.degree):
            first = alive.argmax(axis=1)
            some = alive[i, first]
            if not some.any():
                break
            chosen = cand[i, first]
            picked[rows[some], r] = chosen[some]
            between = 2 - 2 * np.einsum("nkd,nd->nk", vectors, x[chosen])
            drop = g.alpha * between <= d
            drop[i, first] = True
            alive &= ~(drop & some[:, None])
    src = np.repeat(np.arange(n), g.degree)
    dst = picked.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    pairs = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    return Lists.of(pairs // n, pairs % n, n)


#: Components of vectors multiplied at once.
AT_ONCE = 1 << 22


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scalar products of the rows a[i] and b[j]."""
    step = max(1, AT_ONCE // a.shape[1])
    parts = [np.einsum("nd,nd->n", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0, a.dtype)


def search(x: np.ndarray, links: Lists, queries: np.ndarray, own: np.ndarray, g: Graph) -> np.ndarray:
    """Boolean matrix (queries x nodes) of nodes found in range.  own: a query's node, or -1."""
    n, m = len(x), len(queries)
    medoid = int((x @ x.mean(axis=0)).argmax())
    xf, qf = x.astype(np.float32), queries.astype(np.float32)
    seen = np.zeros((m, n), bool)
    ids = np.zeros((m, g.beam), np.int64)
    sims = np.full((m, g.beam), -9.0, np.float32)
    done = np.ones((m, g.beam), bool)
    for col, start in ((0, np.full(m, medoid)), (1, own)):
        q = np.flatnonzero(start >= 0)
        q = q[~seen[q, start[q]]]
        ids[q, col], sims[q, col], done[q, col] = start[q], _dots(qf, q, xf, start[q]), False
        seen[q, start[q]] = True
    for _ in range(4 * g.beam):
        waiting = np.where(done, -9.0, sims)
        best = waiting.argmax(axis=1)
        active = np.flatnonzero(waiting[np.arange(m), best] > -9)
        if not len(active):
            break
        done[active, best[active]] = True
        k, near = links.near(ids[active, best[active]])
        fresh = ~seen[active[k], near]
        k, near = k[fresh], near[fresh]
        seen[active[k], near] = True
        s = _dots(qf, active[k], xf, near)
        order = np.lexsort((-s, k))
        k, near, s = k[order], near[order], s[order]
        rank = np.arange(len(k)) - np.searchsorted(k, k)
        top = rank < g.beam  # no more can enter a beam
        new_ids, new_sims = np.zeros((len(active), g.beam), np.int64), np.full((len(active), g.beam), -9.0, np.float32)
        new_ids[k[top], rank[top]], new_sims[k[top], rank[top]] = near[top], s[top]
        all_ids, all_sims = np.concatenate([ids[active], new_ids], axis=1), np.concatenate([sims[active], new_sims], axis=1)
        all_done = np.concatenate([done[active], new_sims == -9], axis=1)
        best = np.argpartition(-all_sims, g.beam - 1, axis=1)[:, : g.beam]
        ids[active], sims[active] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_sims, best, axis=1)
        done[active] = np.take_along_axis(all_done, best, axis=1)
    found, met = np.zeros((m, n), bool), np.zeros((m, n), bool)
    q, at = np.nonzero(sims >= g.cosine - 1e-3)
    waiting = [q * n + ids[q, at]]
    met.ravel()[waiting[0]] = True
    while waiting:  # a stack of bounded pieces: what is in range leads on to its neighbours
        q, node = np.divmod(waiting.pop(), n)
        inside = _dots(queries, q, x, node) >= g.cosine
        q, node = q[inside], node[inside]
        found[q, node] = True
        for a in range(0, len(q), 1 << 14):
            k, near = links.near(node[a : a + (1 << 14)])
            key = q[a : a + (1 << 14)][k] * n + near
            key = np.unique(key[~met.ravel()[key]])
            met.ravel()[key] = True
            if len(key):
                waiting.append(key)
    has = own >= 0
    found[np.flatnonzero(has), own[has]] = False
    return found


def _classes(rows: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the two hashes of their label and vector; valid classes with their smallest id, size and packed vector."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fit = F.col(label).isNotNull() & F.col(id_col).isNotNull() & finite & F.exists(v, lambda c: c != 0)
    picked = rows.select(
        F.col(id_col).alias("id"),
        F.col(label).cast("string").alias("label"),
        F.coalesce(fit, F.lit(False)).alias("fit"),
        v.alias("v"),
    ).withColumns({"k1": F.xxhash64("label", "v", F.lit(1)), "k2": F.xxhash64("label", "v", F.lit(2))})
    kept = materialize(picked, "vectors")
    classes = kept.where("fit").groupBy("k1", "k2").agg(F.min("id").cast("bigint").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["k1", "k2", "rep", "copies", "label"]].assign(v=[np.array(x, np.float64).tobytes() for x in b["v"]])

    packed = classes.mapInPandas(pack, "k1 long, k2 long, rep long, copies long, label string, v binary")
    return kept.drop("v"), materialize(packed, "classes")


def _centroids(classes: DataFrame, g: Graph) -> dict[tuple[str, int], np.ndarray]:
    """Unit centroids of the labels (and vector lengths) that need more than one shard, from a bounded sample."""
    kind = ["label", F.octet_length("v").alias("bytes")]
    big = classes.groupBy(*kind).count().where(F.col("count") > 2 * g.shard_rows)
    wanted = {(r["label"], r["bytes"]): r["count"] for r in big.orderBy(F.desc("count"), "label").limit(g.most_centroids // 2).collect()}
    if not wanted:
        return {}
    total = sum(wanted.values())
    rows = min(g.fit_rows, g.fit_bytes // max(size for _, size in wanted))  # what reaches the driver is bounded
    kinds = classes.sparkSession.createDataFrame([(k, n) for k, n in wanted], "label string, bytes int")  # most_centroids / 2 at most
    sample = (
        classes.withColumn("bytes", F.octet_length("v"))
        .join(F.broadcast(kinds), ["label", "bytes"], "left_semi")
        .where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / total)))
        .select("rep", "label", "v")
        .limit(rows)
        .toPandas()
        .sort_values("rep")
    )
    out = {}
    scale = min(1.0, g.most_centroids * g.shard_rows / total)
    for (label, size), n in wanted.items():
        mine = sample[(sample["label"] == label) & (sample["v"].map(len) == size)]
        k = min(max(2, int(scale * n / g.shard_rows)), len(mine))
        if k < 2:
            continue
        x = unit(mine["v"])
        c = x[np.random.default_rng(9).permutation(len(x))[:k]]
        for _ in range(6):
            nearest = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, nearest, x)
            norm = np.linalg.norm(sums, axis=1)
            c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], c)
        out[label, size] = c
    return out


def _shards(classes: DataFrame, centroids: dict[tuple[str, int], np.ndarray], g: Graph) -> DataFrame:
    """Columns rep, copies, v, shards: numbers of the nearest centroids, sorted, and shard: label, length and number as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, size), part in b.groupby(["label", b["v"].map(len)]):
                c = centroids.get((label, size))
                if c is None:
                    near = np.zeros((len(part), 1), np.int64)
                else:
                    s = unit(part["v"]) @ c.T
                    k = min(g.overlap, len(c))
                    near = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
                yield pd.DataFrame({"rep": part["rep"], "copies": part["copies"], "v": part["v"], "kind": f"{size}/{label}", "shards": list(near)})

    dealt = classes.select("rep", "copies", "label", "v").mapInPandas(run, "rep long, copies long, v binary, kind string, shards array<long>")
    return dealt.withColumn("number", F.explode("shards"))


def _parts(dealt: DataFrame, g: Graph) -> DataFrame:
    """Add part and n_parts: shards above the limit are cut by a hash of rep."""
    sizes = dealt.groupBy("kind", "number").count().withColumn("n_parts", F.ceil(F.col("count") / g.most_rows).cast("int")).drop("count")
    return dealt.join(sizes, ["kind", "number"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("n_parts")).cast("int"))


def _met_before(a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
    """For rows of shard numbers (padded by -1): which pairs share a shard smaller than `number`."""
    out = np.zeros((len(a), len(b)), bool)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out |= np.where((a[:, i] >= 0) & (a[:, i] < number), a[:, i], -2)[:, None] == b[:, j][None, :]
    return out


def _adjacency(g: Graph):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rep, links = rows["rep"].to_numpy(), build(unit(rows["v"]), g)
        return pd.DataFrame({"rep": rep, "near": np.split(rep[links.nodes], links.begins[1:-1])})

    return run


def _meet(g: Graph):
    """Search of one part's rows in the graph of a part, the same or another."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        number, rep, copies = int(rows["number"].iloc[0]), rows["rep"].to_numpy(), rows["copies"].to_numpy()
        at = np.flatnonzero((rows["part"] == rows["graph"]).to_numpy())  # the graph's nodes among the rows
        node_of = np.full(len(rows), -1)
        node_of[at] = np.arange(len(at))
        ask = np.flatnonzero((rows["part"] == rows["asker"]).to_numpy())
        if not len(at) or not len(ask):
            return pd.DataFrame({"rep": [], "n": [], "to": []}).astype("int64")
        x = unit(rows["v"])
        width = max(map(len, rows["shards"]))
        shards = np.array([np.pad(s, (0, width - len(s)), constant_values=-1) for s in rows["shards"]])
        near = rows["near"].iloc[at]
        owner = np.repeat(np.arange(len(at)), near.map(len))
        other = np.concatenate([*near.to_numpy(), np.empty(0, np.int64)]).astype(np.int64)
        place = np.minimum(np.searchsorted(rep, other), len(rep) - 1)
        real = (rep[place] == other) & (node_of[place] >= 0)
        links = Lists.of(owner[real], node_of[place[real]], len(at))
        step = 256
        bits = []  # what each block of askers found, a bit for each pair
        label = np.arange(len(rows))
        for start in range(0, len(ask), step):
            some = ask[start : start + step]
            if g.exact:
                found = x[some] @ x[at].T >= g.cosine
                found[np.flatnonzero(node_of[some] >= 0), node_of[some][node_of[some] >= 0]] = False
            else:
                found = search(x[at], links, x[some], node_of[some], g)
            bits.append(np.packbits(found, axis=1))
            for row in np.flatnonzero(found.any(axis=1)):
                joined = np.unique(np.append(label[at[found[row]]], label[some[row]]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        n = np.zeros(len(rows), np.int64)
        weight = copies[at].astype(np.float64)
        for start, mine in zip(range(0, len(ask), step), bits, strict=True):
            some = ask[start : start + step]
            found = np.unpackbits(mine, axis=1, count=len(at)).astype(bool)
            if len(ask) == len(at) == len(rows):  # askers are the nodes: what is found one way holds both ways
                found |= np.concatenate([np.unpackbits(b[:, start // 8 : (start + step) // 8], axis=1)[:, : len(some)] for b in bits]).T.astype(bool)
            n[some] = (found & ~_met_before(shards[some], shards[at], number)) @ weight
        root = rep[label]
        told = (n > 0) | (root != rep)
        return pd.DataFrame({"rep": rep[told], "n": n[told], "to": root[told]})

    return run


def find_links(classes: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    """(counts: rep, n_links to other classes' rows; links: src, dst that connect as all links do)."""
    dealt = materialize(_parts(_shards(classes, {} if g.exact else _centroids(classes, g), g), g), "shards")
    if g.exact:  # one shard a label and no graph
        united = dealt.select("rep", F.array().cast("array<bigint>").alias("near"))
    else:
        lists = dealt.groupBy("kind", "number", "part").applyInPandas(_adjacency(g), "rep long, near array<long>")
        united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    # a row is a node of its own part's graph for every asking part, and asks every other part's graph
    every = F.sequence(F.lit(0), F.col("n_parts") - 1)
    as_node = F.transform(every, lambda p: F.struct(F.col("part").alias("graph"), p.alias("asker")))
    as_asker = F.transform(F.filter(every, lambda p: p != F.col("part")), lambda p: F.struct(p.alias("graph"), F.col("part").alias("asker")))
    asks = dealt.join(united, "rep").withColumn("meeting", F.explode(F.concat(as_node, as_asker))).select("*", "meeting.*").drop("meeting")
    met = materialize(asks.groupBy("kind", "number", "graph", "asker").applyInPandas(_meet(g), "rep long, n long, to long"), "met")
    return met.groupBy("rep").agg(F.sum("n").alias("n_links")), met.select(F.col("rep").alias("src"), F.col("to").alias("dst"))


def _shares(classes: DataFrame, counts: DataFrame, asked: pd.DataFrame, g: Graph) -> tuple[int, float | None]:
    """True links of the asked classes, by brute force in blocks, and the mean share of them that `counts` holds."""
    groups = {k: (p["rep"].to_numpy(), unit(p["v"])) for k, p in asked.groupby([asked["label"], asked["v"].map(len)])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby([b["label"], b["v"].map(len)]):
                if key in groups:
                    rep, q = groups[key]
                    hit = unit(part["v"]) @ q.T >= g.cosine
                    hit &= part["rep"].to_numpy()[:, None] != rep[None, :]
                    yield pd.DataFrame({"rep": rep, "classes": hit.sum(axis=0), "truth": part["copies"].to_numpy() @ hit})

    true = classes.select("rep", "label", "copies", "v").mapInPandas(run, "rep long, classes long, truth long")
    true = true.groupBy("rep").agg(F.sum("classes").alias("classes"), F.sum("truth").alias("truth")).where("truth > 0")
    share = F.least(F.lit(1.0), F.coalesce("n_links", F.lit(0)) / F.col("truth"))
    links, recall = true.join(counts, "rep", "left").agg(F.sum("classes"), F.avg(share)).first()
    return links or 0, recall


def audit(classes: DataFrame, counts: DataFrame, g: Graph) -> float | None:
    """Mean share of a class's true links that `counts` holds; None if too few were met.

    More classes are drawn until those asked have `audit_links` true links, or all or
    `most_audit` of them are asked.
    """
    total, asked_rows = classes.count(), g.audit_rows
    while True:
        asked = classes.orderBy(F.xxhash64("rep", F.lit(8)), "rep").limit(asked_rows).select("rep", "label", "v").toPandas()
        if asked.empty:
            return 1.0
        links, recall = _shares(classes, counts, asked, g)
        if links >= g.audit_links or asked_rows >= total:
            return recall if links else 1.0
        if asked_rows >= g.most_audit:
            return None
        asked_rows *= 4


def linked_by_hash(classes: DataFrame, g: Graph) -> DataFrame:
    """rep of classes that have a link, as far as signs of random projections see it: independent of clusters and graphs.

    A class's signs are its key in `hash_tables` tables; in each bucket the smallest and the
    largest class are compared, so no bucket is gathered.  Keys have a few bits more than it
    takes to number the classes, so most buckets hold one class or hold links.
    """
    bits = min(40, max(8, int(np.ceil(np.log2(max(2, classes.count())))) + 6))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, part in b.groupby(b["v"].map(len)):
                x = unit(part["v"])
                planes = np.random.default_rng(9).normal(size=(x.shape[1], g.hash_tables * bits))
                keys = ((x @ planes > 0).reshape(len(x), g.hash_tables, bits) * (1 << np.arange(bits))).sum(axis=2)
                for t in range(g.hash_tables):
                    yield pd.DataFrame({"label": part["label"].to_numpy(), "size": size, "t": t, "key": keys[:, t], "rep": part["rep"].to_numpy()})

    keyed = classes.select("rep", "label", "v").mapInPandas(run, "label string, size long, t int, key long, rep long")
    ends = keyed.groupBy("label", "size", "t", "key").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b").distinct()
    both = ends.join(classes.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a").join(classes.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for _, part in p.groupby(p["va"].map(len)):
                hit = (unit(part["va"]) * unit(part["vb"])).sum(axis=1) >= g.cosine
                yield pd.DataFrame({"rep": np.concatenate([part["a"].to_numpy()[hit], part["b"].to_numpy()[hit]])})

    return both.mapInPandas(linked, "rep long").distinct()


def audit_linked(classes: DataFrame, counts: DataFrame, g: Graph) -> float | None:
    """As `audit`, asking classes that random projections see linked; None if they see none."""
    drawn = classes.join(linked_by_hash(classes, g), "rep", "left_semi")
    asked = drawn.orderBy(F.xxhash64("rep", F.lit(8)), "rep").limit(g.most_audit).select("rep", "label", "v").toPandas()
    return None if asked.empty else _shares(classes, counts, asked, g)[1]


def proven_links(classes: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame, float]:
    """What `find_links` gives once its recall is measured to be 0.9 or more, and that recall; else exact links.

    Where a uniform draw meets too few links, classes that are known to have some are asked.
    """
    for _ in range(3):
        counts, links = find_links(classes, g)
        recall = audit(classes, counts, g)
        if recall is None:
            recall = audit_linked(classes, counts, g)
        if recall is None or recall >= g.target_recall:
            break
        g = replace(g, overlap=g.overlap + 1, beam=2 * g.beam, candidates=2 * g.candidates)
    if recall is None or recall < 0.9:
        return *find_links(classes, replace(g, exact=True)), 1.0
    return counts, links, recall


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", g: Graph = Graph()) -> DataFrame:
    """Columns id_col, n_links, component_id, kept: one row per input row."""
    kind = dict(rows.dtypes)[id_col]
    all_rows, classes = _classes(rows, id_col, vector, label)
    counts, links, _ = proven_links(classes, g)
    found = connected_components(links)
    named = (
        classes.select("k1", "k2", "rep", "copies")
        .join(counts, "rep", "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    own = F.col("id").cast("bigint")
    fit = all_rows.where("fit").select("id", "k1", "k2").join(named, ["k1", "k2"])
    apart = all_rows.where(~F.col("fit")).select("id", F.lit(0).cast("bigint").alias("n"), own.alias("component"))
    out = fit.select("id", "n", "component").union(apart)
    return out.select(
        F.col("id").cast(kind).alias(id_col),
        F.col("n").cast("bigint").alias("n_links"),
        F.col("component").cast(kind).alias("component_id"),
        F.coalesce(own == F.col("component"), F.lit(False)).alias("kept"),
    )
