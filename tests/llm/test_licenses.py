"""Licence notices: planted, cut, parted by other text, beside a plain restatement over words."""

import re
from collections import Counter

from foliate.llm import licenses as L


def notice(k):
    return L.TEMPLATES[k][1]


def plain(texts, scan=L.Scan()):
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in lower]
    frequency = Counter(w for ws in words for w in set(ws))

    def places(ws, phrase):
        p = phrase.split()
        return [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]

    out = []
    for ws in words:
        if len(ws) > 20_000:  # too long for this loop
            out.append(None)
            continue
        base = [(label, i) for phrase, label in scan.base for i in places(ws, phrase)]
        labels = {label: 0.5 for label, _ in base}
        for label, text, keys in scan.templates:
            t = text.split()
            rare = set(sorted(set(t) & set(ws), key=lambda w: (frequency[w], w))[: scan.rarest])
            for s in range(-len(t), len(ws)):
                inside = [i for i in range(len(t)) if 0 <= s + i < len(ws) and ws[s + i] == t[i]]
                if sum(t[i] in rare for i in inside) < scan.agree or len(inside) / len(t) < scan.least_share:
                    continue
                if all(any(s - 3 <= p and p + len(k.split()) <= s + len(t) + 3 for p in places(ws, k)) for k in keys.split("|")):
                    labels[label] = max(labels.get(label, 0), len(inside) / len(t))
        starts = [i for _, i in base]
        out.append((len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for b, _ in base})), ",".join(sorted(labels)), max(labels.values(), default=0.0)))
    return out


def test_against_plain_words(spark):
    filler = "the of and to in version 2 0 license software is this that public "
    texts = [None, "", " \n\t", "CC-BY cc\nby ccby cc, by. CC BY NC 4.0", "All rights\nreserved; ALL RIGHTS RESERVED", "É all rights reserved ünd cc by", "GENERAL public-license", "Kelvin K cc by"]
    texts += [notice(k) for k in range(len(L.TEMPLATES))]
    texts += [filler * 5 + notice(k).upper() + " " + filler * 3 for k in range(len(L.TEMPLATES))]
    texts += [" ".join(notice(k).split()[:-4]) for k in range(len(L.TEMPLATES))]
    texts += [notice(k).replace(" license", " x license", 1) for k in range(len(L.TEMPLATES))]
    texts += [notice(1) + " " + notice(5), "apache license " + filler * 10 + "licensed under the version 2 0", "the " * 30_000 + notice(26) + " the" * 30_000, "x" * 200_000, filler]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, labels string, id int").repartition(5)
    got = [tuple(r)[1:] for r in sorted(L.scan_licenses(df).collect())]
    short = [i for i, t in enumerate(texts) if len(t or "") < 100_000]
    want = plain(texts)
    assert [got[i] for i in short] == [want[i] for i in short]
    for i in range(len(L.TEMPLATES)):  # every notice is found, alone and within a text
        assert L.TEMPLATES[i][0] in got[8 + i][5].split(",") and L.TEMPLATES[i][0] in got[8 + len(L.TEMPLATES) + i][5].split(",")
    long = next(i for i, t in enumerate(texts) if t and t.startswith("the the"))
    assert got[long][5] == "mit" and got[long][6] == 1.0


def test_rows_of_any_kind(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    out = L.scan_licenses(spark.createDataFrame([(None, "cc by"), (1, "cc by"), (1, "cc by")], "doc_id int, text string"))
    assert out.dtypes[0] == ("doc_id", "int")
    assert Counter(tuple(r) for r in out.collect()) == {(None, 2, 1, 0, 0, "cc-by", "cc-by", 0.5): 1, (1, 2, 1, 0, 0, "cc-by", "cc-by", 0.5): 2}
