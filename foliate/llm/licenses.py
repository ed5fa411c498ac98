"""Licence notices by a positional index of rare words.

Document frequencies of all words of the licence templates are counted over the whole
corpus: its size is that of the vocabulary, whatever the corpus holds.  For each file and
template the file's rarest words of that template are looked up: each of their places in
the file and in the template give a relative position, and a template stands where at least
`agree` places give the same one.  It is reported when its mandatory key phrases stand near
that position and at least `least_share` of its words are at their places.

Words are runs of letters and digits of ASCII (A-Z lower-cased) and of everything beyond it.
In UTF-8 these are runs of bytes, so whole texts are scanned as bytes; work and memory grow
with a text's length and a text never leaves its task.

Defined results: a null text counts as empty; empty texts have no words, no labels, score 0.
Base phrases are counted at every place where their words stand consecutively, also across
lines and punctuation.  Templates that tie are all reported; score is the greatest share of a
template's words in place, at least 0.5 where only a base phrase was found.  Repeated rows
and null ids are scanned like any other; other columns, whatever their names, are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Fixed values: (label, words of a notice, mandatory key phrases parted by "|").
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license|2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses"),
    ("artistic-2.0", "licensed under the artistic license version 2 0", "artistic license"),
    ("bsd-2-clause", "released under the bsd 2 clause license", "bsd 2 clause"),
    ("bsd-3-clause", "released under the bsd 3 clause license", "bsd 3 clause"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name|endorse or promote"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use|binary forms"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "extent possible under law|waived all copyright"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license|either version 2"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license|version 2"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license|either version 3"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license|version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy|fee is hereby granted"),
    ("isc", "released under the isc license", "isc license"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted|free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered|public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "express or implied warranty|in no event will the authors"),
)

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]


@dataclass(frozen=True)
class Scan:
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES
    base: tuple[tuple[str, str], ...] = BASE
    #: Places that must give one relative position, of up to `rarest` words of a template.
    agree: int = 2
    rarest: int = 6
    least_share: float = 0.6
    #: Words by which a key phrase may lie outside of its template's place.
    slack: int = 3
    base_score: float = 0.5


def _words(phrase: str) -> tuple[bytes, ...]:
    return tuple(w.encode() for w in phrase.split())


@dataclass(frozen=True)
class Index:
    """Templates with their words' places; `rank` orders the vocabulary from the rarest word on."""

    scan: Scan
    templates: tuple[Template, ...]
    base: tuple[tuple[tuple[bytes, ...], str], ...]
    vocabulary: frozenset[bytes]
    places: tuple[dict[bytes, list[int]], ...]
    rank: dict[bytes, int] = field(default_factory=dict)

    @staticmethod
    def of(scan: Scan) -> Index:
        made = tuple(Template(label, _words(words), tuple(map(_words, keys.split("|")))) for label, words, keys in scan.templates)
        base = tuple((_words(p), label) for p, label in scan.base)
        places = []
        for t in made:
            at: dict[bytes, list[int]] = {}
            for i, w in enumerate(t.words):
                at.setdefault(w, []).append(i)
            places.append(at)
        words = {w for t in made for p in (t.words, *t.keys) for w in p} | {w for p, _ in base for w in p}
        return Index(scan, made, base, frozenset(words), tuple(places))

    def ranked(self, frequency: dict[bytes, int]) -> Index:
        order = sorted(self.vocabulary, key=lambda w: (frequency.get(w, 0), w))
        return Index(self.scan, self.templates, self.base, self.vocabulary, self.places, {w: i for i, w in enumerate(order)})

    def phrase(self, hits: dict[bytes, list[int]], at: dict[int, bytes], words: tuple[bytes, ...]) -> list[int]:
        """Places where the words stand consecutively, found from the one with the fewest places."""
        if not all(w in hits for w in words):
            return []
        k = min(range(len(words)), key=lambda i: len(hits[words[i]]))
        return [p - k for p in hits[words[k]] if all(at.get(p - k + i) == w for i, w in enumerate(words))]

    def found(self, hits: dict[bytes, list[int]], at: dict[int, bytes]) -> dict[str, float]:
        """Labels of the templates that stand in a file, with the greatest share of words in place."""
        out: dict[str, float] = {}
        for t, places in zip(self.templates, self.places, strict=True):
            keys = [self.phrase(hits, at, k) for k in t.keys]
            if not all(keys):
                continue
            rare = sorted((w for w in places if w in hits), key=self.rank.__getitem__)[: self.scan.rarest]
            offsets = Counter(p - i for w in rare for p in hits[w] for i in places[w])
            for offset, n in offsets.items():
                if n >= self.scan.agree:
                    share = sum(at.get(offset + i) == w for i, w in enumerate(t.words)) / len(t.words)
                    first, last = offset - self.scan.slack, offset + len(t.words) + self.scan.slack
                    near = all(any(first <= p and p + len(k) <= last for p in ps) for k, ps in zip(t.keys, keys, strict=True))
                    if near and share >= max(self.scan.least_share, out.get(t.label, 0)):
                        out[t.label] = share
        return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    """Lower-cased UTF-8 bytes of each text; null as empty."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for v in binary:
        yield (v.as_py() or b"").lower()  # bytes.lower changes A-Z alone


def frequencies(docs: DataFrame, text: str, scan: Scan) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands."""
    index = Index.of(scan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in _texts(b.column(0)):
                n.update(index.vocabulary.intersection(WORD.findall(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    told = docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in told.collect()}  # one row a word of the vocabulary at most


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scan: Scan = Scan()) -> DataFrame:
    """Columns id_col, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document."""
    index = Index.of(scan).ranked(frequencies(docs, text, scan))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t in _texts(b.column(1)):
                words = WORD.findall(t)
                at = {i: w for i, w in enumerate(words) if w in index.vocabulary}
                hits: dict[bytes, list[int]] = {}
                for i, w in at.items():
                    hits.setdefault(w, []).append(i)
                base = {label: found for p, label in index.base if (found := index.phrase(hits, at, p))}
                labels, starts = index.found(hits, at), [p for found in base.values() for p in found]
                score = max([0.0, *labels.values(), *[scan.base_score] * bool(base)])
                out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *labels})), score))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
