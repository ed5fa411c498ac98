import math
import random

from foliate.llm import mixing as M


def docs_of(spark, n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        source = rng.choices(["a", "b", "c", None, ""], [60, 20, 10, 6, 4])[0]
        rows.append((i, "w " * rng.randint(0, 40), source, "clash"))
    rows += [(n, None, "nothing", "clash"), (n + 1, "", "nothing", "clash"), (3, rows[3][1], rows[3][2], "clash"), (None, "x y", "a", "clash")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")


def test_mix_meets_its_targets(spark):
    rows, docs = docs_of(spark)
    mix = M.Mix(block_tokens=300, most_repeats=3.0)
    total = sum(len((r[1] or "").split()) for r in rows)
    plan = {r["source"]: r for r in M.plan(docs, mix).collect()}
    weights = [r["weight"] for r in plan.values() if r["weight"]]
    assert abs(sum(weights) - 1) < 1e-9
    entropy = -sum(w * math.log(w) for w in weights)
    assert entropy <= 0.95 * math.log(len(weights)) + 1e-6
    assert all(r["target"] <= 3.0 * r["tokens"] + 1 for r in plan.values())
    out = M.mix_sources(docs, mix).collect()
    tokens = {}
    for r in out:
        tokens[r["source"]] = tokens.get(r["source"], 0) + len((r["text"] or "").split())
    for s, p in plan.items():
        if p["tokens"]:
            assert p["target"] - 81 <= tokens.get(s, 0) <= p["target"]  # short by less than a document and its copy
    assert abs(sum(tokens.values()) - total) < 81 * 5
    copies = {}
    for r in out:
        copies.setdefault((r["doc_id"], r["source"]), []).append(r["epoch"])
    for epochs in copies.values():
        assert max(epochs) <= 3
    assert sum(r["source"] == "nothing" for r in out) == 2
    assert len(copies[(3, rows[3][2])]) % 2 == 0  # the repeated row goes with its twin


def test_cover_keeps_every_row(spark):
    rows, docs = docs_of(spark, 200)
    out = M.mix_sources(docs, M.Mix(budget="cover", entropy_share=1.0, most_repeats=1.5, block_tokens=100)).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    assert len(out) > len(rows)


def test_exponent_against_plain_search(spark):
    stats = spark.createDataFrame([("a", 900), ("b", 80), ("c", 20), ("z", 0)], "source string, tokens long")
    p = [0.9, 0.08, 0.02]
    for share, most in ((0.5, 50.0), (0.9, 3.0), (1.0, 100.0), (0.01, 2.0)):
        def ok(a):
            z = sum(x**a for x in p)
            h = -sum(x**a / z * math.log(x**a / z) for x in p)
            return h <= share * math.log(3) + 1e-9 and max(x ** (a - 1) for x in p) / z <= most + 1e-9
        want = next((k / 4096 for k in range(4097) if ok(k / 4096)), 1.0)
        assert M.exponent(stats, M.Mix(entropy_share=share, most_repeats=most)) == want


def test_empty(spark):
    assert M.mix_sources(docs_of(spark, 5)[1].limit(0)).count() == 0
