"""Codes against plain Lloyd rounds: small blocks, copies, ties, odd rows."""

import math
from collections import defaultdict

import numpy as np
import pytest

from foliate.llm import quantizer as Z


def table():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 32)) * 0.2
    x[:90] = x[7]  # a group of copies
    x[90:200] = np.round(x[90:200] * 4) / 4  # ties
    rows = [(i * 3 % 997, v.tolist(), [None, 0, 1, 1][i % 4]) for i, v in enumerate(x)]
    odd = [None, [math.nan] * 32, [math.inf] + [0.0] * 31, [None] + [0.0] * 31, [], [0.5] * 16, [0.5] * 31]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(3, x[1].tolist(), 0), (3, x[1].tolist(), 0), (None, x[2].tolist(), 0), (2100, [1e200] * 32, 5), (2101, [-1e9] * 32, 5)]
    return rows


def plain(rows, g):
    most = math.floor(math.sqrt(2.0**60 / 32))
    kept = [(i, lab, [max(-most, min(most, math.floor(c * 256))) for c in v]) for i, v, lab in rows if v is not None and len(v) == 32 and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = 32 // g.parts
    parts = np.array([r[2] for r in kept], object).reshape(len(kept), g.parts, width)
    books = parts[: g.entries].transpose(1, 0, 2).copy()

    def nearest(k):
        d = ((parts[:, k, None, :] - books[k][None]) ** 2).sum(axis=2)
        best = [min(range(len(r)), key=lambda j: (r[j], j)) for r in d]
        return best, [d[i][b] for i, b in enumerate(best)]

    for _ in range(g.rounds):
        new = books.copy()
        for k in range(g.parts):
            best, _ = nearest(k)
            groups = defaultdict(list)
            for i, b in enumerate(best):
                groups[b].append(parts[i, k])
            for b, own in groups.items():
                new[k, b] = sum(own) // len(own)
        books = new
    named = [nearest(k) for k in range(g.parts)]
    codes = ["".join(f"{named[k][0][i]:02x}" for k in range(g.parts)) for i in range(len(kept))]
    errors = [sum(named[k][1][i] for k in range(g.parts)) for i in range(len(kept))]
    by = defaultdict(int)
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by[lab] += e
    sha = Z.digest(books)
    return sorted(((i, c, e, by[lab], sha) for (i, lab, _), c, e in zip(kept, codes, errors, strict=True)), key=str)


@pytest.mark.parametrize("g", [Z.Codes(), Z.Codes(parts=4, entries=9, rounds=3, block_rows=37, leaf=2), Z.Codes(parts=2, entries=256)])
def test_against_plain_rounds(spark, g):
    rows = table()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, id int").repartition(3)
    got = sorted((tuple(r) for r in Z.compress(df, g=g).collect()), key=str)
    assert got == plain(rows, g)


def test_few_rows_or_none(spark):
    schema = "vec_id int, embedding array<float>, label string"
    assert Z.compress(spark.createDataFrame([], schema)).count() == 0
    assert Z.compress(spark.createDataFrame([(1, None, "a"), (2, [], "a"), (3, [1.0] * 15, "b")], schema)).count() == 0
    out = Z.compress(spark.createDataFrame([(9, [0.1] * 16, "a"), (8, [0.3] * 16, None)], schema))
    assert out.schema["vec_id"].dataType.simpleString() == "int"
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in out.collect()) == [(8, "00" * 16, 0), (9, "01" * 16, 0)]


def test_whole_nodes_are_assigned_by_their_sums():
    rng = np.random.default_rng(1)
    middles = rng.integers(-9000, 9000, (20, 4))
    x = middles[rng.integers(20, size=6000)] + rng.integers(-40, 40, (6000, 4))
    tree = Z.grow(x, 16)
    found = Z.assign(x, tree, middles, Z.grow(middles, 1))
    assert len(found.points) < 300
    want = ((x[:, None] - middles) ** 2).sum(axis=2).argmin(axis=1)
    assert (Z.codes(tree, found) == want).all()
    count, total = Z.sums(x, tree, found, 20)
    assert (count == np.bincount(want, minlength=20)).all()
    assert all((total[k] == x[want == k].sum(axis=0)).all() for k in range(20))
