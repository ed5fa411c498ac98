import random

import numpy as np
import pytest

import corpus_pipeline as P
from foliate.llm import simhash as H


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def alike(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def near_copies(seed=1, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(80, 300))) for _ in range(n)]
    out = []
    for t in texts:
        out.append(t)
        for _ in range(rng.randint(0, 3)):
            w = t.split()
            for _ in range(max(1, len(w) // 90)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return texts, out


def test_near_copies_are_found_and_others_stay(spark):
    _, texts = near_copies()
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in H.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8]
    assert len(close) > 30
    assert sum(got[i] == got[j] for i, j in close) >= 0.95 * len(close)
    apart = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) < 0.3]
    assert not any(got[i] == got[j] for i, j in apart)


def test_keep_one(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(7, base, "a"), (3, base, "b"), (3, base, "c"), (None, base, "d"), (9, None, "e"), (8, "", "f"), (5, "something else altogether here", "g")]
    out = H.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 3, 5, 8]
    assert H.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parities_never_rule_out_a_shared_shingle():
    rng = np.random.default_rng(1)
    for n, other in ((0, 0), (0, 40), (1, 1), (50, 50), (3000, 3000), (3000, 200), (700, 90)):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: min(n, other) // 2], rng.integers(0, 2**63, other, dtype=np.uint64)]))
        apart = len(np.setxor1d(x, y))
        assert H._differ_at_least(H._odd(x), H._odd(y)) <= apart
        assert H._differ_at_least(H._odd(x), H._odd(x)) == 0
        if n == other and n >= 50:  # the bound is close to what it bounds
            assert H._differ_at_least(H._odd(x), H._odd(y)) >= 0.5 * apart


def test_lists_of_one_byte_and_of_two_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(17)
    _, texts = near_copies(17, 60)
    for _ in range(80):  # a family with long lists
        w = texts[0].split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = str(rng.random())
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {tuple(r) for r in H.near_groups(df).collect()}
    monkeypatch.setattr(H, "ONE_BYTE", 0)
    assert one == {tuple(r) for r in H.near_groups(df).collect()}


def test_family_of_near_copies_against_all_pairs(spark):
    """Long dense lists: groups are those of all pairs from 0.8 on, though few pairs are verified."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(150)) for _ in range(2)]
    for _ in range(300):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    got = {r[0]: r[1] for r in H.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in range(len(texts))}
    assert len(set(want.values())) > 5
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert len(set(got.values())) >= len(set(want.values()))  # nothing links below 0.8


def blends(sizes, rng):
    """Pairs of texts whose similarity lies between about 0.6 and 0.9: the second text has another ending."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 9)))
    for n in sizes:
        w = [word() for _ in range(n)]
        keep = round(n * rng.uniform(0.8, 0.95))
        yield " ".join(w), " ".join(w[:keep] + [word() for _ in range(n - keep)])


def test_pairs_link_from_a_similarity_of_08_on(spark):
    rng = random.Random(11)
    pairs = list(blends([rng.choice([12, 30, 60, 90, 200, 400]) for _ in range(1200)], rng))
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r["doc_id"]: r["component_id"] for r in H.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [i for i, p in enumerate(pairs) if alike(*p) >= 0.8]
    edge = [i for i in close if alike(*pairs[i]) < 0.83]
    assert len(edge) > 80 and len(pairs) - len(close) > 300
    linked = {i for i in range(len(pairs)) if got[2 * i] == got[2 * i + 1]}
    print(f"recall {len(linked & set(close))} of {len(close)}, below 0.83 {len(linked & set(edge))} of {len(edge)}")
    assert not linked - set(close)
    assert len(linked & set(close)) >= 0.98 * len(close) and len(linked & set(edge)) >= 0.96 * len(edge)


def test_a_repeated_shingle_does_not_link(spark):
    rng = random.Random(12)
    texts = ["la la la la la " * 200 + " ".join(str(rng.random()) for _ in range(60)) for _ in range(3)]
    got = H.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r["component_id"] for r in got}) == 3


@pytest.mark.parametrize("part", [0.93, 0.86])
def test_template_family_links_as_brute_force(spark, part):
    rng = random.Random(13)
    base = [str(rng.random()) for _ in range(300)]
    texts = [" ".join(base[: round(300 * part)] + [str(rng.random()) for _ in range(round(300 * (1 - part)))]) for _ in range(60)]
    texts += [" ".join(t.split()[:-20] + ["x"] * k) for k, t in enumerate(texts[:30], 1)]
    want = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8]
    for _ in range(20):
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    got = {r["doc_id"]: r["component_id"] for r in H.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(2)
    _, texts = near_copies(3, 60)
    rows, labels = [], []
    for i, t in enumerate(texts):
        good = rng.random() < 0.8
        rows.append((i, t + " mail me a.b@c.de" if good else " ".join(w + "%%%" for w in t.upper().split()), "en", rng.choice("xyz"), 0))
        labels.append((i, int(good), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), dict((r[0], r) for r in rows), dict((x[0], x[1]) for x in labels)


def test_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, block string, email_spans string"
    labels = "doc_id long, quality int, toxic int"
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None, "a", "b", "c"), (1, None, None, "x", 0, "d", "e", "f"), (1, None, None, "x", 0, "d", "e", "f"), (2, "", "en", None, 0, "g", "h", "i"), (3, "mail a.b@c.de now", "en", "x", 17, "j", "k", "l")])):
        d = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in P.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, str(d)).collect(), docs.schema)
        kept = {(r["doc_id"], r["score"], r["block"], r["email_spans"]) for r in docs.collect()}
        assert kept == ({(None, "a", "b", "c"), (1, "d", "e", "f"), (3, "j", "k", "l")} if rows else set())  # 1 and 2 are equal texts
        assert {r["doc_id"] for r in P.run(spark, str(d)).collect()} == {k[0] for k in kept}


def test_pipeline(spark, small):
    d, rows, labels = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs.collect())
    good = {i for i, q in labels.items() if q}
    kept = {r["doc_id"] for r in seen[0]}
    assert len(kept & good) >= 0.97 * len(good) and len(kept - good) <= 0.1 * len(rows)
    after = {r["doc_id"] for r in seen[1]}
    assert after < kept and len(seen[1]) == len(after)
    assert all("a.b@c.de" not in r["text"] and "[EMAIL]" in r["text"] for r in seen[2] if r["doc_id"] in good)
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2])
    assert {r["doc_id"] for r in seen[3]} == after
    packed = P.STAGES[-1][1](spark, docs, d).collect()
    assert {r["doc_id"] for r in packed} == after
    assert P.run(spark, d).count() > 0
