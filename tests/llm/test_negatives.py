"""Hard negatives against brute force: copies, ties, odd rows, several lengths, small trees."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.llm import negatives as N


def table(clustered):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(6, 12))
    x = [(middles[rng.integers(6)] * clustered + rng.normal(size=12) * 0.3).tolist() for _ in range(330)]
    rows = [(i, v, int(rng.integers(4))) for i, v in enumerate(x)]
    rows += [(1000 + i, x[3], 1) for i in range(70)]  # a group of copies, anchors among them
    rows += [(1200 + i, x[3], 2) for i in range(9)]  # with another label
    rows += [(1300 + i, [1.0, 0.0], i % 3) for i in range(12)] + [(1400 + i, [], i % 2) for i in range(5)]
    rows += [(40, x[40], 2), (40, x[40], rows[40][2]), (1500, x[7], rows[7][2]), (1510, [-c for c in x[7]], rows[7][2])]
    odd = [None, [math.nan] * 12, [math.inf] + [0.0] * 11, [None] + [1.0] * 11]
    rows += [(1600 + 10 * i, v, 1) for i, v in enumerate(odd)] + [(1700, x[0], None), (None, x[0], 1), (1710, [1e30] * 12, 1), (1720, [0.0] * 12, 3)]
    return rows


def truth(rows, every, g=N.Mining()):
    good = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]

    def scaled(v):
        most = math.floor(math.sqrt(2.0**48 / max(1, len(v))))
        return [max(-most, min(most, math.floor(c * 256))) for c in v]

    good = [(i, scaled(v), lab) for i, v, lab in good]
    out = []
    for a, (i, v, lab) in enumerate(good):
        if i % every:
            continue
        scores = [(-sum(p * q for p, q in zip(v, w, strict=True)), j, b, m) for b, (j, w, m) in enumerate(good) if b != a and len(w) == len(v)]
        for s, j, _, _ in sorted((x for x in scores if x[3] == lab), key=lambda x: x[:2])[: g.positives]:
            fit = sorted((t, n) for t, n, _, m in scores if m != lab and -80 * s <= -100 * t <= -100 * s)[: g.negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("clustered", [0.0, 1.0, 6.0])
@pytest.mark.parametrize("g", [N.Mining(), N.Mining(shard_rows=40, block_rows=7, branches=3, leaf=5, fit_rows=60), N.Mining(shard_rows=40, fit_rows=1, leaf=10)])
def test_against_brute_force(spark, g, clustered):
    rows = table(clustered)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, rank int")
    got = Counter(tuple(r) for r in N.mine(df, F.col("id") % 10 == 0, g=g).collect())
    want = truth(rows, 10)
    assert sum(want.values()) > 1000
    assert got == want


def test_a_search_leaves_out_most_of_a_clustered_shard():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 16)) * 300
    x = np.floor(middles[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)) * 5)
    labels, g = rng.integers(3, size=4000), N.Mining()
    order, root = N.grow(x, labels, float((x * x).sum(axis=1).max()), g)
    scored = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(super().__getitem__(at))
            scored.append(len(out))
            return out

    shard = N.Shard(x[order].view(Counted), order, labels[order], order, np.argsort(np.argsort(order)), float((x * x).sum(axis=1).max()), root)
    q = N.Queries(x[:1], labels[:1], np.array([N.NONE]), np.array([-N.NONE]), np.array([N.NONE]), None, None)
    query, row, score = N.search(shard, q, 6, True)
    brute = sorted((-int(x[0] @ x[i]), i) for i in range(4000) if labels[i] == labels[0])[:6]
    assert [(-int(s), int(order[r])) for r, s in zip(row, score, strict=True)] == brute
    assert sum(scored) < 2000


def test_no_rows_no_anchors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert N.mine(spark.createDataFrame([], schema), F.col("id") % 100 == 0).count() == 0
    assert N.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], schema), F.col("id") % 100 == 0).count() == 0
