import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliate.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n ", "Hello, world's end!", "naïve Ångström é ́x y", "a\x1cb \x85 c d", "don't we'll 12345 <|endoftext|> x",
    "ΣΑΣ ΟΔΟΣ Σ", "word " * 9000, "longrun" * 3000, "ﬁ ½ ² 中文 字 🙂🙂 x", "same text here", "same text here",
]


def test_words_are_encoded_as_whole_texts_are():
    enc, plain = K.Encoder(PATH), Tokenizer.from_file(PATH)
    for t in TEXTS:
        want = plain.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() == want


def test_common_characters_one_by_one():
    enc, plain = K.Encoder(PATH), Tokenizer.from_file(PATH)
    assert enc.plain
    for code in [*range(1, 0x180), *range(0x2010, 0x2030), 0x130, 0x3A3, 0x301]:
        for t in (chr(code), f"Ab{chr(code)}C1 's{chr(code)}", f"{chr(code)}{chr(code)} x"):
            want = plain.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() == want, (hex(code), t)


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
    key = K.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_cuts():
    assert K.cuts(0, 8) == [] and K.cuts(8, 8) == [8] and K.cuts(21, 8) == [8, 8, 4, 1]


def test_pieces(spark):
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(TEXTS)] + [(11, TEXTS[11], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [r.asDict() for r in K.pack(docs, PATH, capacity=64).collect()]
    plain = Tokenizer.from_file(PATH)
    want = sorted((i is None, i or 0, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, _ in rows)
    by_doc = {}
    for p in sorted(got, key=lambda p: p["start"]):
        by_doc.setdefault(p["doc_id"], []).append(p)
    for gone, i, ids in want:
        pieces = [p for p in by_doc[None if gone else i]]
        copies = sum(w == (gone, i, ids) for w in want)
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p["doc_tokens"] == len(ids)
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
    by_sequence = {}
    for p in got:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at & (at - 1) == 0 and at <= 64
    assert K.pack(docs.limit(0), PATH).count() == 0
