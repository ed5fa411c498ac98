"""Removal of every byte that a repeated string of `length` bytes covers, across a corpus.

Each window of `least` bytes picks an anchor: the leftmost position in it whose 64-byte
gram has the smallest hash.  Equal windows pick the same gram at the same offset, so two
occurrences of a repeat always meet in the group of one gram.  Only grams that occur at
least twice go on, with the bytes around them that a repeat of `length` bytes may span.

In a group the right contexts are sorted, which is an enhanced suffix array of the
anchored positions, and a stack scan of its common-prefix values walks the interval tree
from its leaves.  Each interval keeps its members in the order of their left contexts,
read from the anchor outwards; where two intervals meet, the smaller one's members are
put into the larger one's order, and new neighbours are tested for how far they extend to
the left.  A member whose left and right extensions reach `least` is an occurrence of a
maximal repeat, wherever it stands in the array.

Repeats of `length` bytes are removed.  Runs covered by repeats of `least` bytes that hold
more than `passage_words` whole words are counted as passages and stay.  `least` is
`passage_bytes` (four bytes a word), or `length` if that is smaller.

A gram with more than `most_group` occurrences does not fit one task: its windows'
SHA-256 digests are counted instead, by an aggregation that combines before it shuffles,
with the same result.  Texts that are equal as a whole, by SHA-256, form one class, of
which one text is searched.

Defined results: a null text has no bytes; texts shorter than `length` keep all; repeated
rows repeat each other; an empty table gives no rows; null ids are carried along; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import discard, materialize, whole_text


@dataclass(frozen=True)
class Repeats:
    length: int = 400
    gram: int = 64  # a power of two
    passage_words: int = 50
    passage_bytes: int = 204
    most_group: int = 100_000

    @property
    def least(self) -> int:
        return min(self.length, self.passage_bytes)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes of all grams by doubling, then mixed."""
    h = raw.astype(np.uint64) + np.uint64(1)
    size, base = 1, np.uint64(0x9E3779B97F4A7C15)
    while size < gram:
        h = h[:-size] * base + h[size:]
        base = base * base
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes, r: Repeats) -> list[tuple[int, int, int, int]]:
    """(gram hash, anchor, first window, last window) for each run of windows with one anchor."""
    n = len(raw) - r.least + 1
    if n <= 0:
        return []
    with np.errstate(over="ignore"):
        h = gram_hashes(np.frombuffer(raw, np.uint8), r.gram)
    # the hash's upper half, then the position: the least value is the leftmost of the least hashes
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, size = r.least - r.gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    stops = np.concatenate((starts[1:], [n])) - 1
    a = at[starts]
    return list(zip(h[a].view(np.int64).tolist(), a.tolist(), starts.tolist(), stops.tolist(), strict=True))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # the first difference lies in [low, n)
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


class _Least:
    """Least value of a range of a list; a table of powers of two serves long lists."""

    def __init__(self, values: list[int]) -> None:
        self.levels = [values]
        if len(values) > 64:
            a = np.array(values)
            while 2 << len(self.levels) - 1 <= len(values):
                half = 1 << len(self.levels) - 1
                a = np.minimum(a[:-half], a[half:])
                self.levels.append(a.tolist())

    def __call__(self, i: int, j: int) -> int:
        """Of values[i:j], i < j."""
        if j - i == 1 or len(self.levels) == 1:
            return min(self.levels[0][i:j])
        k = (j - i).bit_length() - 1
        return min(self.levels[k][i], self.levels[k][j - (1 << k)])


def covered(members: list[tuple[bytes, int]], least: int) -> dict[int, list[tuple[int, int]]]:
    """For each member (fragment, offset of its anchor) the ranges of the fragment that occur in another member too.

    Ranges of `least` bytes or more, none inside another of the same anchor.
    """
    right = [f[o:] for f, o in members]
    left = [f[:o][::-1] for f, o in members]
    array = sorted(range(len(members)), key=right.__getitem__)
    by_left = sorted(range(len(members)), key=left.__getitem__)
    place = {k: i for i, k in enumerate(by_left)}
    side = _Least([common(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False)])
    most = max(o for _, o in members)
    best = [-1] * len(members)
    out = defaultdict(list)

    def meet(x: int, y: int, value: int) -> None:
        """Neighbours x < y in left order share `value` bytes to the right."""
        wide = side(x, y)
        for k in (by_left[x], by_left[y]):
            if wide + value >= least and wide > best[k]:
                best[k] = wide
                out[k].append((members[k][1] - wide, members[k][1] + value))

    stack: list[tuple[int, list[int]]] = []  # common prefix with what follows, members in left order
    for i, k in enumerate(array):
        group = [place[k]]
        value = common(right[k], right[array[i + 1]]) if i + 1 < len(array) else -1
        while stack and stack[-1][0] >= value:
            shared, held = stack.pop()
            if shared + most < least:
                group = []  # nothing further up is long enough
                continue
            few, group = sorted((held, group), key=len)
            for x in few:
                at = bisect(group, x)
                if at:
                    meet(group[at - 1], x, shared)
                if at < len(group):
                    meet(x, group[at], shared)
                group.insert(at, x)
        stack.append((value, group))
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def outermost(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges that lie in no other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(ranges), key=lambda x: (x[0], -x[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _digest(text: Column) -> Column:
    """First half of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


_FOUND = "h binary, key long, a int, lo int, hi int, start int, stop int"


def _anchor_rows(r: Repeats):
    """Anchors of each text, or ranges that repeats within the text alone already cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        for b in batches:
            out = []
            for h, text in zip(b["h"], b["text"], strict=True):
                raw = text.encode()
                seen: dict[tuple, int] = {}
                own = []
                for key, a, lo, hi in anchors(raw, r):
                    end = min(len(raw), hi + r.length)
                    same = (key, a - lo, raw[lo:end])
                    if same in seen:
                        own += [(lo, end), (seen[same], seen[same] + end - lo)]
                    else:
                        seen[same] = lo
                        out.append((h, key, a, lo, hi, -1, -1))
                out += [(h, 0, -1, -1, -1, s, e) for s, e in outermost(own)]
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return run


def _fragments(r: Repeats):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            size = 0
            for h, text, found in zip(b["h"], b["text"], b["found"], strict=True):
                raw = text.encode()
                for f in found:
                    out.append((h, f["key"], f["lo"], f["a"] - f["lo"], raw[f["lo"] : f["hi"] + r.length], f["hi"] - f["lo"] + 1))
                    size += len(out[-1][4])
                if size > 16 << 20:
                    yield pd.DataFrame(out, columns=["h", "key", "lo", "off", "fragment", "windows"])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["h", "key", "lo", "off", "fragment", "windows"])

    return run


def _groups(r: Repeats):
    """Covered ranges from fragments sorted by key; a group may run over several batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        waiting: list[tuple] = []
        now = None

        def close() -> None:
            if len(waiting) > 1:
                for k, ranges in covered([(w[2], w[3]) for w in waiting], r.least).items():
                    h, lo = waiting[k][0], waiting[k][1]
                    out.extend((h, lo + s, lo + e) for s, e in ranges)
            waiting.clear()

        for b in batches:
            for key, h, lo, off, fragment in zip(b["key"], b["h"], b["lo"], b["off"], b["fragment"], strict=True):
                if key != now:
                    close()
                    now = key
                waiting.append((h, lo, fragment, off))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["h", "start", "stop"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["h", "start", "stop"])

    return run


def _windows(r: Repeats):
    """Digest of every window of `least` and of `length` bytes in a fragment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, lo, f, n in zip(b["h"], b["lo"], b["fragment"], b["windows"], strict=True):
                for size in {r.least, r.length}:
                    out += [(h, lo + i, lo + i + size, hashlib.sha256(f[i : i + size]).digest()) for i in range(min(n, len(f) - size + 1))]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["h", "start", "stop", "w"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["h", "start", "stop", "w"])

    return run


def _passages(raw: bytes, ranges: list[tuple[int, int]], r: Repeats) -> int:
    """Runs of repeats that hold more than `passage_words` whole words."""
    n = 0
    for s, e in merged(ranges):
        words = len(raw[s:e].split())
        words -= s > 0 and not raw[s - 1 : s].isspace() and not raw[s : s + 1].isspace()
        words -= e < len(raw) and not raw[e - 1 : e].isspace() and not raw[e : e + 1].isspace()
        n += words > r.passage_words
    return n


def _removed(r: Repeats):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, text, found in zip(b["h"], b["text"], b["ranges"], strict=True):
                raw, at, kept = text.encode(), 0, []
                ranges = [(f["start"], f["stop"]) for f in found]
                runs = merged([x for x in ranges if x[1] - x[0] >= r.length])
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((h, len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left, _passages(raw, ranges, r)))
            yield pd.DataFrame(out, columns=["h", "n_removed", "n_spans", "kept_sha256", "kept", "n_passages"])

    return run


def repeated_ranges(texts: DataFrame, r: Repeats) -> tuple[DataFrame, DataFrame]:
    """For rows (h, text), h the text's digest: (ranges: h, start, stop; candidates: h, text)."""
    long = texts.where(F.octet_length("text") >= r.least)
    found = materialize(long.mapInPandas(_anchor_rows(r), _FOUND).distinct(), "anchors")
    marks = found.where("start < 0").select("h", "key", "a", "lo", "hi")
    own = materialize(found.where("start >= 0").select("h", "start", "stop"), "own")
    often = marks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(marks.join(often, "key"), "shared")
    discard(found)
    wanted = shared.select("h").union(own.select("h")).distinct()
    candidates = materialize(long.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")), "candidates")
    listed = shared.groupBy("h").agg(F.collect_list(F.struct("key", "a", "lo", "hi", "n")).alias("all"))  # of one text

    def cut(rare: bool) -> DataFrame:
        mine = F.filter("all", lambda f: (f["n"] <= r.most_group) if rare else (f["n"] > r.most_group))
        some = listed.select("h", mine.alias("found")).where(F.size("found") > 0)
        return candidates.join(some, "h").mapInPandas(_fragments(r), "h binary, key long, lo int, off int, fragment binary, windows int")

    grouped = cut(True).repartition("key").sortWithinPartitions("key").mapInPandas(_groups(r), "h binary, start int, stop int")
    ranges = own.union(grouped)
    if shared.where(F.col("n") > r.most_group).limit(1).count():
        windows = materialize(cut(False).mapInPandas(_windows(r), "h binary, start int, stop int, w binary"), "windows")
        twice = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
        ranges = ranges.union(windows.join(twice, "w").select("h", "start", "stop"))
    return ranges, candidates


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", r: Repeats = Repeats(), with_text: bool = False) -> DataFrame:
    """Columns id_col, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes), n_passages."""
    t = whole_text(text)
    hashed = docs.select(F.col(id_col).alias("id"), t.alias("text"), _digest(t).alias("h"))
    space, other = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    wordy = (F.octet_length("text") >= r.least) & F.col("text").rlike(f"^{space}*+(?:{other}++{space}++){{{r.passage_words}}}{other}")
    rows = hashed.select("id", "h", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"), wordy.alias("wordy"))
    rows = materialize(rows, "rows")
    ranges, candidates = repeated_ranges(hashed.select("h", "text"), r)
    listed = ranges.groupBy("h").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))  # of one text
    cut = candidates.join(listed, "h").mapInPandas(_removed(r), "h binary, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passages long")
    if not with_text:
        cut = cut.drop("kept")
    copied = rows.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1").select("h", F.lit(True).alias("copied"))
    twin = F.coalesce("copied", F.lit(False))
    gone = twin & (F.col("n_bytes") >= r.length)
    verdict = rows.join(copied, "h", "left").join(cut, "h", "left")
    out = [
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    if with_text:
        whole = hashed.groupBy("h").agg(F.first("text").alias("text"))
        verdict = verdict.join(whole, "h")
        out.append(F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept"))
    passages = F.when(twin & (F.col("n_bytes") >= r.least), F.col("wordy").cast("bigint")).otherwise(F.coalesce("n_passages", F.lit(0)))
    return verdict.select(*out, passages.cast("bigint").alias("n_passages"))
