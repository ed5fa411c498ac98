import hashlib
import random
import re
from collections import Counter

import pytest

from foliate.llm import repeats as R

SMALL = R.Repeats(length=40, gram=8)


def by_hand(texts, length, passage=204, words=50):
    raws = [(t or "").encode() for t in texts]

    def marked(size):
        seen = Counter(raw[p : p + size] for raw in raws for p in range(len(raw) - size + 1))
        for raw in raws:
            gone = bytearray(len(raw))
            for p in range(len(raw) - size + 1):
                if seen[raw[p : p + size]] > 1:
                    gone[p : p + size] = b"\1" * size
            yield gone

    def passages(raw, gone):
        inside = [bytes(gone[m.start() : m.end()]) == b"\1" * len(m[0]) and m for m in re.finditer(rb"\S+", raw)]
        runs = Counter(next(s for s in range(m.start(), -1, -1) if s == 0 or not gone[s - 1]) for m in inside if m)
        return sum(n > words for n in runs.values())

    out = []
    for raw, gone, told in zip(raws, marked(length), marked(min(length, passage)), strict=True):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), passages(raw, told)))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9)))
    body = lambda n: " ".join(word() for _ in range(n))
    shared = [body(12), body(9), body(30)]
    out = [None, "", "x", "ab" * 300, "abc" * 200, "a" * 500, "a" * 39, "a" * 40, body(8)]
    for _ in range(40):
        parts = [body(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s) + 1), 2))
            parts += [s[a:b] if rng.random() < 0.5 else s, body(rng.randint(0, 10))]
        out.append(" ".join(parts))
    return out + [out[12], out[12], out[13], out[13] + "!", "q" + out[14]]


@pytest.mark.parametrize("seed,most", [(1, 100_000), (2, 3), (3, 100_000)])
def test_against_brute_force(spark, seed, most):
    rows = [(i if i != 4 else None, t, "clash") for i, t in enumerate(texts(seed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    small = R.Repeats(length=40, gram=8, passage_bytes=25, passage_words=4, most_group=most)
    got = R.remove_repeats(docs, r=small, with_text=True).collect()
    want = by_hand([t for _, t, _ in rows], 40, 25, 4)
    assert sum(w[4] for w in want) > 9
    assert sorted(((r[0], *r[1:5], r["n_passages"]) for r in got), key=str) == sorted(((i, *w) for (i, _, _), w in zip(rows, want, strict=True)), key=str)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("n", [2, 9, 150])
def test_interval_tree_against_all_pairs(n):
    rng = random.Random(n)
    text = lambda k: "".join(rng.choice("ab") for _ in range(k)).encode()
    members = [(text(o) + text(rng.randint(1, 14)), o) for o in (rng.randint(0, 12) for _ in range(n))]
    got = R.covered(members, 6)
    for k, (f, o) in enumerate(members):
        pairs = [(R.common(f[:o][::-1], g[:q][::-1]), R.common(f[o:], g[q:])) for j, (g, q) in enumerate(members) if j != k]
        want = {(o - w, o + v) for w, v in pairs if w + v >= 6}
        told = set(got.get(k, []))
        assert told <= want and all(any(a <= s and e <= b for a, b in told) for s, e in want)


def test_all_occurrences_not_just_neighbours():
    # the second and fourth share left and right together, but do not stand side by side
    members = [(b"LLLL" + b"aaaa", 4), (b"MMMM" + b"aaab", 4), (b"LLLL" + b"aaac", 4)]
    assert set(R.covered(members, 7)) == {0, 2}


def test_common():
    assert R.common(b"abcd", b"abxd") == 2 and R.common(b"", b"a") == 0 and R.common(b"ab", b"abc") == 2 and R.common(b"x", b"y") == 0


def test_empty_and_production_length(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(9)
    body = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    p = body(450)
    all_texts = [body(700) + p + body(20), body(5) + p + body(600), body(100) + p[:399] + body(400), "word " * 30_000]
    rows = list(enumerate(all_texts))
    got = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *w) for i, w in enumerate(by_hand(all_texts, 400)))


def test_one_gram_in_very_many_texts(spark):
    """One group of 4,000 occurrences, in one task and counted by windows."""
    rng = random.Random(4)
    body = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = body(30)
    all_texts = [body(5) + shared + body(5) for _ in range(4_000)]
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    want = sorted((i, *w) for i, w in enumerate(by_hand(all_texts, 31)))
    for most in (100_000, 500):
        got = R.remove_repeats(docs, r=R.Repeats(length=31, gram=8, most_group=most)).collect()
        assert sorted(tuple(r) for r in got) == want
