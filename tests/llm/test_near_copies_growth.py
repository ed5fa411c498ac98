"""What the near-copy stage moves and joins does not outgrow its input."""

import random

import numpy as np

from foliate.llm import simhash as H


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_texts_that_are_not_wanted_are_not_shuffled(spark):
    """Larger tables are joined without broadcasts; texts used to be shuffled four times then."""
    rng = random.Random(21)
    texts = [" ".join("%x" % rng.getrandbits(32) for _ in range(1500)) for _ in range(600)]
    texts += [f"{t} more" for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = shuffled(spark)
        out = H.keep_one(docs)
        out.write.format("noop").mode("overwrite").save()
        moved = shuffled(spark) - start
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept == set(range(600))
    assert moved < 0.5 * sum(map(len, texts))


def test_pairs_of_a_family_are_ruled_out_before_they_are_joined(spark, monkeypatch):
    """A family whose pairs are mostly alike by less than 0.8, and links among them, against all pairs."""
    rng = random.Random(22)
    base = [str(rng.random()) for _ in range(200)]

    def changed(w, n):
        w = list(w)
        for k in rng.sample(range(len(w)), n):
            w[k] = str(rng.random())
        return w

    members = [changed(base, 4) for _ in range(350)]
    members += [changed(m, 1) for m in members[:50]]
    counts = []
    plain = H.materialize

    def counted(df, name, *rest):
        out = plain(df, name, *rest)
        if name in ("scanned", "candidates"):
            counts.append((name, out.count()))
        return out

    monkeypatch.setattr(H, "materialize", counted)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(members)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in H.near_groups(docs).collect()}
    assert sum(n for name, n in counts if name == "candidates") < 12 * len(members), counts

    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in members]
    want = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) >= 50
    for _ in range(len(sets)):
        last = list(want)
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
        if last == want:
            break
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(want)
    assert len(set(got.values())) >= len(set(want))  # nothing links below 0.8


def test_map_of_ids_loses_none(spark):
    ids = [*range(0, 3000, 7), -1, 2**62, -(2**63), None]
    rows = [(k, "a", "b") for k in [*range(3000), -1, -2, 2**62, -(2**63), None]]
    docs = spark.createDataFrame(rows, "doc_id long, maybe string, Maybe_bits string")
    wanted = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    out, maybe = H._maybe(docs, wanted, "doc_id")
    assert out.columns[:3] == docs.columns and out.count() == len(rows)
    assert out.where(maybe.isNull()).isEmpty()
    through = {r["doc_id"] for r in out.where(maybe).select("doc_id").collect()}
    assert set(ids) <= through and len(through) < len(set(ids)) + 20
    none, maybe = H._maybe(docs, wanted.where("false"), "doc_id")
    assert none.where(maybe).isEmpty() and none.where(~maybe).count() == len(rows)


def test_parities_of_members_rule_out_no_link():
    rng = random.Random(23)
    for n in (1, 5, 40, 300, 4000):
        x = np.unique(np.array([rng.getrandbits(63) for _ in range(n)], np.uint64))
        for part in (0.5, 0.8, 0.9, 1.0):
            keep = x[: max(1, round(len(x) * part))]
            marks = np.frombuffer(H._odd(x, H.PLACES) + H._odd(keep, H.PLACES), np.uint64).reshape(2, -1)
            fps = np.zeros((2, 4), np.uint64)
            rows = H._Rows(np.zeros(2, np.int64), np.arange(2), fps, None, marks, np.array([len(x), len(keep)]))
            d = rows.distances(np.array([0]), np.array([1]), False)[0]
            assert d == 0 if H._alike(len(keep), len(x), len(keep)) else d in (0, -1)
            if n >= 40 and part == 0.5:
                assert d == -1
