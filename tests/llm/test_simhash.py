import random

import numpy as np
import pytest
import xxhash

from foliate.llm import simhash as H


def by_hand(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = t.encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def reach(values):
    """Smallest value that each of the distinct values reaches over links of three bits at most."""
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One two", "One two three", "a b c a b c a b c", "É x\ty\x0bz Z", "w " * 200_000])
def test_fingerprint(text):
    assert H.fingerprint(text) & (2**64 - 1) == by_hand(text)


def test_every_pair_within_three_bits_shares_a_triple():
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 3):
            b ^= 1 << k
        x, y = a.to_bytes(8, "little"), b.to_bytes(8, "little")
        assert any(all(x[k] == y[k] for k in t) for t in H.TRIPLES)


@pytest.mark.parametrize("direct", [2, 2048])
def test_lists_connect_as_brute_force_does(direct, monkeypatch):
    monkeypatch.setattr(H, "DIRECT", direct)
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = set(seeds)
    for s in seeds:
        for _ in range(30):
            v = s
            for k in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << k
            values.add(v)
    fps = np.array(sorted(values), np.uint64)
    found = {}
    label = {v: v for v in values}
    for part in H._stars(fps):
        for a, b in part.T.tolist():
            assert a in values and b in values
            found.setdefault(a, set()).add(b)
            found.setdefault(b, set()).add(a)
    for v in sorted(values):  # breadth first from the smallest
        todo = [v]
        while todo:
            x = todo.pop()
            for y in found.get(x, ()):
                if label[y] > label[v]:
                    label[y] = label[v]
                    todo.append(y)
    assert label == reach(sorted(values))


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(300)) for _ in range(8)]
    texts = [None, "", "x", "x"]
    for t in base:
        w = t.split()
        texts += [t, t, " ".join(w[:-1] + ["zz"]), " ".join(w[:100] + ["q"] + w[101:])]
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)] + [(None, base[0], "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r["doc_id"], r["fp"] & (2**64 - 1)): r["component_id"] for r in H.near_duplicates(docs).collect()}
    prints = {i: by_hand(t) for i, t, _ in rows}
    label = reach(sorted(set(prints.values())))
    first = {}
    for i, f in prints.items():
        if i is not None:
            first[label[f]] = min(first.get(label[f], i), i)
    assert got == {(i, f): first[label[f]] for i, f in prints.items()}


def test_empty_table(spark):
    assert H.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
