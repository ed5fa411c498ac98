"""Packing along a space-filling curve.

Every text is tokenised once.  Its token counts, hashed to signs, give a vector of four
dimensions; its Hilbert key orders the documents so that neighbours are similar.  Rows
are range-sorted by (key, hash of id, id), which splits any run of equal keys, and each
range is packed as one stream of tokens cut every `capacity` tokens.  What remains at a
range's end is cut into power-of-two sequences, so no sequence needs padding.

Words are encoded when first met and remembered in a bounded cache.

Defined results: a null or empty text is the end token alone; repeated rows are packed
one by one; an empty table gives no rows; the id may be null; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import materialize

DIMENSIONS, BITS, END = 4, 8, 1
#: Words remembered by a Python worker.
CACHE = 400_000
_SPLIT = re.compile("[ \t\n\r]+")
#: Characters that lower-case and normalise one by one (no dotted capital I),
#: the pre-tokenizer's pieces of them, and the names that byte-level models give to bytes.
_COMMON = re.compile("[\t\n\r -~¡«»¿À-ÖØ-öø-įı-ž–—‘’“”…]*")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^ \t\n\ra-zß-öø-ž0-9]+")
_UNPRINTED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_NAMES = {b: 256 + n for n, b in enumerate(_UNPRINTED)}


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points (n x d, integers below 2**bits).

    Undoes the curve's rotations bit plane by bit plane, from the highest, then reads
    the planes as a Gray code.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for k in range(d):
            inverted = (x[k] & plane) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[k] ^= swap
        plane >>= 1
    for k in range(1, d):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        flip ^= np.where(x[d - 1] & plane, plane - 1, 0)
        plane >>= 1
    x ^= flip
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for k in range(d):
            key = key << 1 | (x[k] >> b & 1)
    return key


class _Words(dict):
    """Ids of lower-cased words, worked out from the tokenizer's model when they are first met."""

    def __init__(self, model, code: str):
        self.model, self.code = model, code

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        pieces = _PIECE.findall(word)
        if len(pieces) > 1:
            ids = b"".join([self[p] for p in pieces])
        elif pieces:
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_NAMES)
            ids = array(self.code, [t.id for t in self.model.tokenize(raw)]).tobytes()
        else:
            ids = b""
        self[word] = ids
        return ids


class Encoder:
    """Token ids of texts, as bytes of unsigned 16- or 32-bit ids.

    Texts of common Latin characters are lower-cased and cut as the tokenizer's own
    normalizer and pre-tokenizer would, and their words remembered.  All others are cut
    at white space, which no token crosses, and each new word goes through the tokenizer.
    A tokenizer with other rules takes the second way alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.words: dict[str, bytes] = {}
        self.common = _Words(self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I")
        probe = "It's Über 12, «x» – don't!"
        self.plain = self._plain(probe) == self._slow([probe])[0]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.common.__getitem__, text.lower().split()))

    def _slow(self, texts: list[str]) -> list[bytes]:
        split = [_SPLIT.split(t) for t in texts]
        if len(self.words) > CACHE:
            self.words.clear()
        new = list({w for words in split for w in words}.difference(self.words))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.words[w] = np.array(e.ids, self.dtype).tobytes()
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        rest = []
        for k, t in enumerate(texts):
            if t and self.plain and _COMMON.fullmatch(t) and "<|" not in t:
                out[k] = self._plain(t)
            elif t:
                rest.append(k)
        for k, ids in zip(rest, self._slow([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out


_encoders: dict[str, Encoder] = {}


def _signs(vocabulary: int) -> np.ndarray:
    """Four pseudo-random signs for each token id, the same everywhere."""
    return np.random.default_rng(20).choice([-1.0, 1.0], (vocabulary, DIMENSIONS)).astype(np.float32)


def tokenised(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Columns (id, key, n, ids): id as text, Hilbert key, number of tokens, their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = Encoder(tokenizer_path)
        enc = _encoders[tokenizer_path]
        signs = _signs(enc.tokenizer.get_vocab_size())
        end = np.array([END], enc.dtype).tobytes()
        for b in batches:
            for at in range(0, len(b), 256):
                part = b[at : at + 256]
                ids = [x + end for x in enc.encode(part["text"].tolist())]
                n = np.array([len(x) // enc.dtype.itemsize for x in ids])
                flat = np.frombuffer(b"".join(ids), enc.dtype)
                sums = np.add.reduceat(signs[flat], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0)
                cube = np.floor((np.tanh(sums / np.sqrt(n)[:, None]) + 1) / 2 * (1 << BITS)).clip(0, (1 << BITS) - 1)
                yield pd.DataFrame({"id": part["id"], "key": hilbert_key(cube), "n": n, "ids": ids})

    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return picked.mapInPandas(run, "id string, key long, n long, ids binary")


def cuts(n_tokens: int, capacity: int) -> list[int]:
    """Lengths of the sequences of a stream: full ones, then powers of two."""
    full, rest = divmod(n_tokens, capacity)
    out = [capacity] * full
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", capacity: int = 2048) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = materialize(tokenised(docs, tokenizer_path, text, id_col), "tokens")
    salt = F.xxhash64("id")
    dealt = rows.repartitionByRange("key", salt, "id").sortWithinPartitions("key", salt, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 40
        dtype = np.dtype("<u2")
        out: list[tuple] = []
        held: list[list] = []  # pieces of the sequence that is being filled
        filled = 0

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return frame

        def piece(doc, n, start, ids, at):
            return (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, at)

        for b in batches:
            for doc, n, raw in zip(b["id"], b["n"], b["ids"], strict=True):
                ids = np.frombuffer(raw, dtype if len(raw) == 2 * n else "<u4")
                start = 0
                while start < n:
                    take = min(n - start, capacity - filled)
                    held.append([doc, n, start, ids[start : start + take], filled])
                    filled += take
                    start += take
                    if filled == capacity:
                        out += [piece(*p) for p in held]
                        sequence, filled = sequence + 1, 0
                        held = []
                if len(out) >= 20_000:
                    yield flush()
        at = 0
        for size in cuts(filled, capacity):  # the rest of this range
            stop = at + size
            for doc, n, start, ids, begins in held:
                a, z = max(at, begins), min(stop, begins + len(ids))
                if a < z:
                    out.append(piece(doc, n, start + a - begins, ids[a - begins : z - begins], a - at))
            at, sequence = stop, sequence + 1
        if out:
            yield flush()

    packed = dealt.mapInPandas(
        run, "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    kind = dict(docs.dtypes)[id_col]
    return packed.select(F.col("id").cast(kind).alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
