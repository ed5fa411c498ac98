"""SimHash near duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes.  Two fingerprints that differ in at most three bits
share at least five bytes at their positions.  Of five positions, at least three lie in
the same half, so one of eight position triples (the three-subsets of each half) agrees:
a posting list per triple and its bytes holds every such pair.  In a list, shared
positional bytes are tallied for each pair, pairs with at least five are retained, and
their bits compared.  Lists are of distinct fingerprints, so copies cost nothing.

A list that near copies make long is split further: its pairs must share two more of
the five other bytes, and fingerprints that share five bytes differ only in the 24 bits
of three bytes, at most 2^24 of them.  Where such a list is still long, the 2,324
neighbours within three bits of each member are looked up instead of comparing pairs.
Tasks return one link per member to the group it meets, never all pairs.

`near_groups` takes five-word shingles, each counted once, and a similarity of 0.8 or
more, for which 64 bits are too few.  Its fingerprints have 32 bytes; sets with that
similarity differ in about 15 percent of the bits.  Candidates differ in at most 56 of 256
bits and share at least four bytes: of four positions two lie in the same third, so lists
of the 155 byte pairs within thirds hold every such pair.  Fingerprints of few shingles
stray further, so sets of up to 80 shingles are listed by their smallest hashes as well, of
which similar sets always share one, and differ in at most 72 bits.  Each candidate is
verified by the exact Jaccard similarity of its shingle sets before it links.

A list of two bytes lies within the list of the first of them.  Up to `ONE_BYTE`
fingerprints, rows therefore travel to the 29 lists of one byte that others follow in its
third, and tasks part these by each second byte; beyond, to the 155 lists themselves, which
are shorter.  Both ways give the same candidates.

In a family of near copies most pairs are candidates, so they are not all told.  First
every member tells its nearest candidate of each list, of which its three nearest are
verified; then its nearest candidate in another component; at last all candidates that
still lie in different components.  No link between components is lost, and the pairs
that a family needs grow with its members.  In the last two rounds the members' sizes and
parities of places go to the lists with them, and tasks tell no pair that these rule out.

Texts are long beside all else, so they travel only where they may be needed: a bitmap of
fixed size tells rows whose id cannot be among those wanted, and only the others are joined.

Defined results: a null or wordless text has fingerprint zero and links like any other;
repeated rows share a component; an empty table gives no rows; a row with a null id is
fingerprinted and takes the smallest other id of its component, if there is one.  Other
columns, whatever their names, are not read; `keep_one` carries them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import discard, materialize
from foliate.llm.components import connected_components

MOST_BITS, LEAST_SHARED = 3, 5
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: Longest list compared pair by pair.
DIRECT = 2048


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over word shingles, as a signed integer."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    n = max(1, len(w) - words + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, dtype="<u8")
    for at in range(0, n, 65536):
        part = h[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """Columns (id_col, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": [fingerprint(t, words) for t in b["text"]]})

    ids = dict(docs.dtypes)[id_col]
    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    out = picked.mapInPandas(run, "id string, fp long")
    return out.select(F.col("id").cast(ids).alias(id_col), "fp")


def _labels(close: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a symmetric boolean matrix reaches."""
    label = np.arange(len(close))
    while True:
        near = np.where(close, label[None, :], len(close)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close(fps: np.ndarray) -> np.ndarray:
    """Pairs that share enough bytes by position and, verified, differ in few bits."""
    b = fps.view(np.uint8).reshape(-1, 8)
    shared = np.zeros((len(fps), len(fps)), np.uint8)
    for k in range(8):
        shared += b[:, k][:, None] == b[:, k][None, :]
    i, j = np.nonzero(shared >= LEAST_SHARED)
    close = np.zeros(shared.shape, bool)
    ok = np.bitwise_count(fps[i] ^ fps[j]) <= MOST_BITS
    close[i[ok], j[ok]] = True
    return close


def _stars(fps: np.ndarray) -> list[np.ndarray]:
    """Links (2 x n arrays) that connect the members of one list as its close pairs do."""
    n = len(fps)
    if n < 2:
        return []
    if n <= DIRECT:
        label = _labels(_close(fps))
        moved = label != np.arange(n)
        return [np.stack([fps[moved], fps[label[moved]]])]
    b = fps.view(np.uint8).reshape(-1, 8)
    varied = [k for k in range(8) if (b[:, k] != b[0, k]).any()]
    if len(varied) <= 8 - LEAST_SHARED:
        bits = [8 * k + i for k in varied for i in range(8)]
        out = []
        ordered = np.sort(fps)
        for r in range(1, MOST_BITS + 1):
            for c in combinations(bits, r):
                flipped = ordered ^ np.uint64(sum(1 << x for x in c))
                at = np.minimum(np.searchsorted(ordered, flipped), n - 1)
                hit = (ordered[at] == flipped) & (flipped < ordered)
                if hit.any():
                    out.append(np.stack([ordered[hit], flipped[hit]]))
        return [_spanning(np.concatenate(out, axis=1))] if out else []
    out = []
    need = LEAST_SHARED - (8 - len(varied))
    for pick in combinations(varied, max(need, 1)):
        key = np.zeros(n, np.uint64)
        for k in pick:
            key = key * np.uint64(256) + b[:, k]
        order = np.argsort(key, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                out += _stars(fps[part])
    return [_spanning(np.concatenate(out, axis=1))] if out else []


def _spanning(links: np.ndarray) -> np.ndarray:
    """As few links as connect the same members."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in zip(*links.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent if root(x) != x]
    return np.array(pairs, np.uint64).reshape(-1, 2).T


def _list_links(key: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
    """Links of whole posting lists, rows sorted by key.  Short lists go together, one offset at a time."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
    sizes = np.diff(starts)
    short = np.repeat(sizes <= 16, sizes) & np.repeat(sizes > 1, sizes)
    k, f = key[short], fps[short]
    b = f.view(np.uint8).reshape(-1, 8)
    for d in range(1, 16):
        at = np.flatnonzero(k[:-d] == k[d:])
        if not len(at):
            break
        tally = (b[at] == b[at + d]).sum(axis=1)
        at = at[tally >= LEAST_SHARED]
        at = at[np.bitwise_count(f[at] ^ f[at + d]) <= MOST_BITS]
        yield np.stack([f[at], f[at + d]])
    for g in np.flatnonzero(sizes > 16):
        yield from _stars(fps[starts[g] : starts[g + 1]])


def _scan_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept_key, kept_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def told(key: np.ndarray, fps: np.ndarray) -> Iterator[pd.DataFrame]:
        for a, b in _list_links(key, fps):
            if len(a):
                yield pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    waiting = []
    for batch in batches:
        key = batch["key"].to_numpy()
        fps = batch["fp"].to_numpy().view(np.uint64)
        if not len(key):
            continue
        if waiting and key[-1] == waiting[0][0][0] and key[0] == key[-1]:
            waiting.append((key, fps))  # one list runs on
            continue
        kept_key = np.concatenate([w[0] for w in waiting] + [key])
        kept_fp = np.concatenate([w[1] for w in waiting] + [fps])
        cut = np.searchsorted(kept_key, kept_key[-1])
        if cut:
            yield from told(kept_key[:cut], np.ascontiguousarray(kept_fp[:cut]))
        waiting = [(kept_key[cut:], kept_fp[cut:])]
    if waiting:
        yield from told(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))


def links(distinct: DataFrame) -> DataFrame:
    """Columns (src, dst): links that connect the distinct fingerprints `fp` as all close pairs do."""

    def byte(k: int):
        return F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))

    keys = []
    for n, t in enumerate(TRIPLES):
        key = F.lit(n).cast("bigint")
        for k in t:
            key = key * 256 + byte(k)
        keys.append(key)
    listed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    dealt = listed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInPandas(_scan_lists, "src long, dst long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """Columns (id_col, fp, component_id): the smallest id that links reach."""
    prints = materialize(fingerprints(docs, text, id_col, words), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    found = connected_components(links(classes.select("fp")))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


WIDE_WORDS, WIDE_BITS, WIDE_SHARED = 5, 56, 4
#: Similarity in percent that links two sets of shingles.
ALIKE = 80
THIRDS = (range(11), range(11, 22), range(22, 32))
PAIRS = [p for third in THIRDS for p in combinations(third, 2)]
#: Each byte with those that follow it in its third.
FOLLOWING = {p: [q for a, q in PAIRS if a == p] for p in sorted({a for a, _ in PAIRS})}
#: Number of fingerprints up to which rows travel to lists of one byte; such a list holds a 256th of them or, if it is hot, all.
ONE_BYTE = 1 << 24
#: Sets up to this size are listed by their smallest hashes too, and may differ in more bits.
SHORT, SHORT_BITS = 80, 72
#: Candidates for each member of a list, from which on only members that stand side by side are compared in the first rounds.
DENSE = 8
#: Places in the order of fingerprints that such members look ahead, and nearest candidates that are verified.
AHEAD, NEAREST = 24, 3
#: Places whose parities go to the lists with a member.
PLACES = 1024
#: Bits of the map of wanted ids: 2 MB, whatever the input.
MAP_BITS = 1 << 24
_STEPS = np.array([0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F], np.uint64)


def shingle_set(text: str | None, words: int = WIDE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """32-byte SimHash of a shingle set; each hash is mixed into four words of 64 bits."""
    n = len(h)
    counts = np.zeros(256, np.int64)
    for at in range(0, n, 16384):
        x = h[at : at + 16384, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8).reshape(-1, 32), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > n).tobytes()


def _set_key(h: np.ndarray) -> int:
    """A shingle set's digest as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64))


def _head(h: np.ndarray) -> np.ndarray:
    """The smallest hashes of a short set; sets of similarity 0.8 share one of theirs."""
    n = len(h)
    return h[: n - (n * ALIKE + 99) // 100 + 1] if 0 < n <= SHORT else h[:0]


class _Rows(NamedTuple):
    """Rows of posting lists, sorted by key and fingerprint; `group`, their components so far, `marks` and `sizes` may be missing."""

    key: np.ndarray
    nodes: np.ndarray
    fps: np.ndarray
    group: np.ndarray | None = None
    marks: np.ndarray | None = None
    sizes: np.ndarray | None = None

    def take(self, at) -> _Rows:
        return _Rows(*[None if x is None else x[at] for x in self])

    def distances(self, i: np.ndarray, j: np.ndarray, short: bool) -> np.ndarray:
        """Differing bits of the pairs (i, j), -1 where the limit of bits or, outside lists of short sets, the minimum of shared bytes fails, or where parities and sizes rule out a link."""
        bits = np.bitwise_count(self.fps[i] ^ self.fps[j]).sum(axis=1, dtype=np.int32)
        at = np.flatnonzero(bits <= (SHORT_BITS if short else WIDE_BITS))
        if not short:
            b = self.fps.view(np.uint8).reshape(-1, 32)
            at = at[(b[i[at]] == b[j[at]]).sum(axis=1) >= WIDE_SHARED]
        if self.marks is not None:
            x, y = i[at], j[at]
            n, m = self.sizes[x], self.sizes[y]
            differ = np.maximum(np.bitwise_count(self.marks[x] ^ self.marks[y]).sum(axis=1, dtype=np.int64), abs(n - m))
            at = at[_alike((n + m - differ) // 2, n, m)]
        out = np.full(len(bits), -1, np.int32)
        out[at] = bits[at]
        return out


def _list_pairs(rows: _Rows, some: np.ndarray, short: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (i, j, bits) of the members `some` with all later members, or with all others outside `some`, in bounded pieces.

    With groups, only pairs of different ones.
    """
    n = len(rows.key)
    place = np.full(n, -1)
    place[some] = some
    every = np.arange(n)
    step = max(1, (1 << 18) // n)
    for a in range(0, len(some), step):
        of = some[a : a + step]
        i, j = np.repeat(of, n), np.tile(every, len(of))
        keep = (place[j] < 0) | (j > i)
        if rows.group is not None:
            keep &= rows.group[i] != rows.group[j]
        i, j = i[keep], j[keep]
        d = rows.distances(i, j, short)
        ok = d >= 0
        yield i[ok], j[ok], d[ok]


def _ahead(rows: _Rows, short: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (i, j, bits) of members of one list that stand at most AHEAD places apart."""
    key, group = rows.key, rows.group
    for d in range(1, min(AHEAD + 1, len(key))):
        at = np.flatnonzero(key[:-d] == key[d:])
        if not len(at):
            return
        if group is not None:
            at = at[group[at] != group[at + d]]
        for a in range(0, len(at), 1 << 18):
            part = at[a : a + (1 << 18)]
            bits = rows.distances(part, part + d, short)
            ok = bits >= 0
            yield part[ok], part[ok] + d, bits[ok]


def _nearest(n: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, its nearest candidate, bits) of the members 0 .. n-1 that have one."""
    if not found:
        return (np.empty(0, np.int64),) * 3
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    src, dst, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
    order = np.lexsort((dst, d, src))
    first = order[np.flatnonzero(np.diff(src[order], prepend=-1))]
    return src[first], dst[first], d[first]


def _told(rows: _Rows, every: bool) -> Iterator[pd.DataFrame]:
    """Candidates (src, dst, bits) of whole lists, rows sorted by key and fingerprint.

    Each member's nearest candidate of its list; with groups, the members' components so
    far, the nearest one of another component, and with `every` all of those.  In a dense
    list the nearest are sought among neighbours; members without one tell themselves, so
    that the rounds that follow know all members that may have candidates.
    """

    def frame(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"src": a, "dst": b, "bits": bits.astype(np.int32)})

    key = rows.key
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
    sizes = np.diff(starts)
    few = np.repeat((sizes > 1) & (sizes <= AHEAD + 1), sizes)
    for short in (False, True):
        mine = few & ((key < 0) == short)
        part = rows.take(mine)
        c = part.nodes
        found = list(_ahead(part, short))
        if every:
            for i, j, d in found:
                yield frame(c[i], c[j], d)
        else:
            i, j, d = _nearest(len(c), found)
            yield frame(c[i], c[j], d)
    for g in np.flatnonzero(sizes > AHEAD + 1):
        a, z = starts[g], starts[g + 1]
        part, short = rows.take(slice(a, z)), bool(key[a] < 0)
        c, some = part.nodes, np.arange(z - a)
        if part.group is not None:
            names, size = np.unique(part.group, return_counts=True)
            if len(names) == 1:
                continue
            some = np.flatnonzero(part.group != names[size.argmax()])
        found, total = [], 0
        for i, j, d in _list_pairs(part, some, short):
            if every:
                yield frame(c[i], c[j], d)
                continue
            found.append((i, j, d))
            total += len(i)
            if total > DENSE * (z - a):
                break
        if every:
            continue
        if total > DENSE * (z - a):
            found += list(_ahead(part, short))
            i, j, d = _nearest(z - a, found)
            lone = np.setdiff1d(np.arange(z - a), i)
            yield frame(c[lone], c[lone], np.full(len(lone), 256))
        else:
            i, j, d = _nearest(z - a, found)
        yield frame(c[i], c[j], d)


def _few_nearest(told: pd.DataFrame) -> pd.DataFrame:
    """Each member's nearest candidates among `told`; a member that tells itself does so only where it has no other."""
    told = told.drop_duplicates()
    lone = told["src"] == told["dst"]
    told = told[~(lone & told["src"].isin(told["src"][~lone]))].sort_values(["src", "bits", "dst"])
    return told[told.groupby("src").cumcount() < NEAREST]


def _parted(rows: _Rows, every: bool) -> Iterator[pd.DataFrame]:
    """Candidates of whole lists of one byte, by the lists of two bytes in them; none is told twice where memory allows."""
    key = rows.key
    raw = rows.fps.view(np.uint8).reshape(-1, 32)
    for p in np.unique(key >> 8).tolist():
        a, z = np.searchsorted(key, [p << 8, (p + 1) << 8])
        frames, size = [], 0
        for q in FOLLOWING[p]:
            two = (key[a:z] & 255) << 8 | raw[a:z, q]
            order = a + np.argsort(two, kind="stable")  # by fingerprint within a list, as the rows came
            for f in _told(rows.take(order)._replace(key=two[order - a]), every):
                frames.append(f)
                size += len(f)
                if size > 1 << 20:
                    told = pd.concat(frames).drop_duplicates()
                    frames, size = ([told], len(told)) if len(told) < size // 2 else ([], 0)
                    if not frames:
                        yield told
        if frames:
            told = pd.concat(frames)
            yield told.drop_duplicates() if every else _few_nearest(told)


def _scan_wide(every: bool, one_byte: bool):
    """Candidates within posting lists, rows sorted by key and fingerprint; a list may run over several batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[_Rows] = []

        def told(cut: int | None) -> Iterator[pd.DataFrame]:
            """The candidates of the rows up to `cut`; the others go on waiting."""
            rows = _Rows(*[None if x[0] is None else np.concatenate(x) for x in zip(*waiting, strict=True)])
            key = rows.key
            cut = len(key) if cut is None else int(np.searchsorted(key, key[-1]))
            heads = min(cut, int(np.searchsorted(key, 0))) if one_byte else cut
            for scan, a, z in ((_told, 0, heads), (_parted, heads, cut)):
                if a < z:
                    yield from scan(rows.take(slice(a, z)), every)
            waiting[:] = [rows.take(slice(cut, None))]

        for b in batches:
            if not len(b):
                continue
            key = b["key"].to_numpy()
            runs_on = waiting and len(waiting[0].key) and key[0] == key[-1] == waiting[0].key[0]
            words = lambda c: np.frombuffer(b"".join(b[c]), np.uint64).reshape(len(b), -1)  # noqa: B023, E731
            more = (b["component"].to_numpy(), words("mark"), b["size"].to_numpy()) if "component" in b else ()
            waiting.append(_Rows(key, b["node"].to_numpy(), words("fp"), *more))
            if not runs_on:
                yield from told(0)
        if waiting:
            yield from told(None)

    return run


def _list_rows(one_byte: bool):
    """A row for each list of a class: its bytes or byte pairs (keys from 0 up) and its smallest hashes (negative keys)."""
    left, right = np.array(PAIRS).T
    first = np.array(list(FOLLOWING))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b[at : at + 1000].reset_index(drop=True)
                x = np.frombuffer(b"".join(part["fp"]), np.uint8).reshape(-1, 32).astype(np.int64)
                keys = first << 8 | x[:, first] if one_byte else np.arange(len(PAIRS)) << 16 | x[:, left] << 8 | x[:, right]
                heads = np.fromiter((x for h in part["head"] for x in memoryview(h).cast("q")), np.int64) | np.int64(-(2**63))
                of = np.concatenate([np.repeat(np.arange(len(part)), keys.shape[1]), np.repeat(np.arange(len(part)), [len(h) // 8 for h in part["head"]])])
                out = part.drop(columns="head").take(of).reset_index(drop=True)
                out["key"] = np.concatenate([keys.ravel(), heads])
                yield out

    return run


def _odd(h: np.ndarray, places: int | None = None) -> bytes:
    """For each of some places, at least 2n (a power of two) if not given, whether an odd number of a set's n hashes falls there."""
    places = places or max(256, 1 << max(2 * len(h) - 1, 0).bit_length())
    return np.packbits(np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).tobytes()


def _differ_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of the hashes that only one of two sets holds: each changes one place's parity.

    The longer one is folded, which keeps parities, until both are of one length.
    """
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _alike(both: int, n: int, m: int) -> bool:
    """Whether sets of n and m members that share `both` have a similarity of 0.8 or more."""
    return 100 * both >= ALIKE * (n + m - both)


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that parities and sizes of their sets do not rule out."""
    for b in batches:
        ok = np.zeros(len(b), bool)
        for k, (x, y) in enumerate(zip(b["a"], b["b"], strict=True)):
            n, m = x["size"], y["size"]
            ok[k] = _alike((n + m - max(_differ_at_least(x["odd"], y["odd"]), abs(n - m))) // 2, n, m)
        yield b.loc[ok, ["src", "dst"]]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose texts' shingle sets are alike; rows of one second text stand together, so its set is made once."""
    last: tuple = (None, None)
    for b in batches:
        ok = np.zeros(len(b), bool)
        for k, (dst, x, y) in enumerate(zip(b["dst"], b["a"], b["b"], strict=True)):
            if last[0] != dst:
                last = (dst, shingle_set(y))
            h = shingle_set(x)
            ok[k] = _alike(len(np.intersect1d(h, last[1], assume_unique=True)), len(h), len(last[1]))
        yield b.loc[ok, ["src", "dst"]]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose shingle sets have a similarity of 0.8 or more, by sets (node, odd, size, text).

    Parities of places, some three bits a shingle, show for most other pairs that they
    cannot reach it; only what is left meets with whole texts, which compress where hashes
    do not.
    """

    def met(rows: DataFrame, value, check) -> DataFrame:
        def end(name: str, to: str) -> DataFrame:
            mine = sets.join(rows.select(F.col(name).alias("node")).distinct(), "node", "left_semi")
            return mine.select(F.col("node").alias(name), value.alias(to))

        # by src first, so that only one value travels with a pair
        two = rows.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
        return two.select("src", "dst", "a", "b").mapInPandas(check, "src long, dst long")

    possible = materialize(met(pairs, F.struct("odd", "size"), _possible), "possible")
    links = materialize(met(possible, F.col("text"), _linked), "verified")
    discard(possible)
    return links


def _maybe(rows: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """The rows with a column more, and the condition on it that holds for all whose id is among `ids` (of the same type), and for few others.

    `ids` become a map of MAP_BITS bits, which alone is broadcast, so that rows which cannot be wanted
    need not be shuffled.  The more ids, the more others pass; a join must follow.
    """
    name = "maybe"
    while any(c.lower().startswith(name) for c in rows.columns):
        name += "_"
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(MAP_BITS))
    bucket, bits = f"{name}_bucket", f"{name}_bits"
    maps = ids.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias(bits))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    tested = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col(bucket), "left").withColumn(name, hit)
    return tested.select(*rows.columns, name), F.col(name)


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Columns (id_col, component_id) for rows with an id, by five-word shingles and similarity 0.8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "node": [_set_key(h) for h in sets], "fp": [wide_fingerprint(h) for h in sets], "head": [_head(h).tobytes() for h in sets]})

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t) for t in b["text"]]
            yield pd.DataFrame({"node": [_set_key(h) for h in sets], "odd": [_odd(h) for h in sets], "size": [len(h) for h in sets], "mark": [_odd(h, PLACES) for h in sets], "text": b["text"]})

    kind = dict(docs.dtypes)[id_col]
    picked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    prints = materialize(picked.mapInPandas(run, "id long, node long, fp binary, head binary"), "fingerprints")
    one_byte = prints.count() <= ONE_BYTE
    # rows of one node have equal sets of shingles
    classes = prints.groupBy("node").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("head").alias("head"))

    def scanned(members: DataFrame, every: bool = False) -> DataFrame:
        columns = "key long, node long, fp binary" + (", component long, mark binary, size long" if "component" in members.columns else "")
        lists = members.mapInPandas(_list_rows(one_byte), columns)
        return materialize(lists.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_scan_wide(every, one_byte), "src long, dst long, bits int"), "scanned")

    def nearest(rows: DataFrame) -> DataFrame:
        """Each member's three nearest candidates; a member tells one for each of its lists at most."""
        few = F.slice(F.array_sort(F.collect_set(F.struct("bits", "dst"))), 1, NEAREST)
        return rows.where("src <> dst").groupBy("src").agg(few.alias("few")).select("src", F.explode("few.dst").alias("dst"))

    def verified(rows: DataFrame) -> DataFrame:
        pairs = rows.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        pairs = materialize(pairs, "candidates")
        links = _verified(pairs, sets)
        discard(pairs)
        return links

    def grouped(members: DataFrame, found: DataFrame) -> DataFrame:
        """The classes of `members` (node) with their components so far."""
        some = classes.join(members, "node", "left_semi").join(sets.select("node", "mark", "size"), "node").join(found, "node", "left")
        return some.select("node", "fp", "head", F.coalesce("component", "node").alias("component"), "mark", "size")

    def joined(found: DataFrame, links: DataFrame) -> DataFrame:
        """Components after more links; each node's link to its component stands for those before."""
        stars = found.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        return connected_components(stars.union(links))

    def told(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("src").alias("node")).union(rows.select(F.col("dst").alias("node"))).distinct()

    first = scanned(classes.select("node", "fp", "head"))
    members = materialize(told(first), "members")
    rows, maybe = _maybe(picked, classes.join(members, "node", "left_semi").select("id"), "id")
    # later rounds have no other members, so texts travel once, and only those of members
    sets = rows.where(maybe).select("id", "text").mapInPandas(described, "node long, odd binary, size long, mark binary, text string")
    sets = materialize(sets.join(members, "node", "left_semi").dropDuplicates(["node"]), "sets")
    found = connected_components(verified(nearest(first)))
    second = scanned(grouped(members, found))
    if not second.isEmpty():
        found = joined(found, verified(nearest(second)))
        last = scanned(grouped(told(second), found), every=True)
        if not last.isEmpty():
            found = joined(found, verified(last))
        discard(last)
    discard(first, second, members, sets)
    rooted = classes.join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    least = rooted.groupBy("component").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "component").select("node", "component_id")
    return prints.join(named, "node").select(F.col("id").cast(kind).alias(id_col), F.col("component_id").cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows without the near copies: of each group the row with the smallest id stays.

    Repeated rows of one id count as copies; rows without an id stay.
    """
    groups = near_groups(docs, text, id_col)
    gone = materialize(groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    rows, maybe = _maybe(docs, gone, id_col)
    kept = rows.where(~maybe).select(*docs.columns).union(rows.where(maybe).join(gone, id_col, "left_anti").select(*docs.columns))
    again = materialize(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(again, id_col, "left_anti").select(*docs.columns).union(once.select(*docs.columns))
