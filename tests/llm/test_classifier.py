import random
import zlib

import numpy as np

from foliate.llm import classifier as C


def words(rng, n):
    return [rng.choice(["stone", "river", "light", "over", "the", "and", "quiet", "house", "market", "walks"]) + rng.choice(["", "s", "ed"]) for _ in range(n)]


def corpus(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randint(20, 120))
        good = rng.random() < 0.7
        text = " ".join(w) if good else rng.choice([" ".join(x + "%%%" for x in w), "!! ".join(w).upper(), (w[0] + " ") * 80])
        rows.append((i, text, "xx"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_scores(spark):
    rows, labels = corpus(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    net = C.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = {r["doc_id"]: r for r in C.score(docs.withColumn("out", C.held_out()), net).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in out.items() if r["out"]} == set(held)
    right = sum(out[i]["predicted"] == truth[i] for i in held) / len(held)
    assert right > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "word " * 100_000)], "doc_id long, text string")
    none = C.learn(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert none is None
    assert [r["score"] for r in C.score(docs, none).collect()] == [0.5] * 4
    rows, labels = corpus(60)
    net = C.learn(spark.createDataFrame(rows, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    a, b, c, _ = [r["score"] for r in C.score(docs, net).collect()]
    assert a == b == c
    assert C.score(docs.limit(0), net).count() == 0


def test_risk_and_gradient_against_plain_loops():
    rng = np.random.default_rng(1)
    for prior, shift in ((0.3, 0.0), (0.9, 3.0)):
        xp, xu = rng.normal(size=(7, 5)) + shift, rng.normal(size=(9, 5)) - shift
        params = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
        if shift and C.risk(params, xp, xu, prior)[1] > 0:
            xp, xu = xu, xp  # now the negatives' part is less than zero

        def loss(x, sign):
            total = 0.0
            for row in x:
                f = params[3][0]
                for k in range(4):
                    h = params[1][k] + sum(row[j] * params[0][j, k] for j in range(5))
                    f += max(0.0, h) * params[2][k]
                total += 1 / (1 + np.exp(sign * f))
            return total / len(x)

        positives, negatives = C.risk(params, xp, xu, prior)
        assert np.isclose(positives, prior * loss(xp, 1)) and np.isclose(negatives, loss(xu, -1) - prior * loss(xp, -1))
        got = C.gradients(params, xp, xu, prior)
        for k, p in enumerate(params):
            for at in np.ndindex(p.shape):
                keep, step = p[at], 1e-6
                ends = []
                for e in (step, -step):
                    p[at] = keep + e
                    a, b = C.risk(params, xp, xu, prior)
                    ends.append(a + b if negatives >= 0 else -b)
                p[at] = keep
                assert np.isclose(got[k][at], (ends[0] - ends[1]) / (2 * step), atol=1e-6)
    assert negatives < 0


def test_prior_needs_no_negative_labels():
    rng = np.random.default_rng(2)
    for share in (0.25, 0.6, 0.85):
        kind = rng.random(3000) < share
        unlabelled = rng.normal(size=(3000, 10)) + np.where(kind, 2.0, -2.0)[:, None]
        assert abs(C.class_prior(rng.normal(size=(1500, 10)) + 2.0, unlabelled) - share) < 0.05


def test_columns_named_like_outputs_are_replaced(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame([(*r[:2], "a", "b", "c") for r in rows], "doc_id long, text string, score string, predicted string, held_out string")
    out = C.score(docs, C.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int")))
    assert dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["predicted"] == "int" and out.count() == 60
