"""Secrets in texts: fixed patterns, and high entropy in sliding windows.

In DataFrame functions only.  Patterns find assignments, access keys and long hex
strings; besides, every run of 24 or more key characters is a candidate.  A window of
24 characters slides over it; the window's character counts are updated by the
character that enters and the one that leaves, and with them the Shannon entropy.  A
candidate whose highest window reaches the threshold of its character class is a
secret, unless the allow-list knows it or a pattern's span covers part of it.

Defined results: a null text is empty and has no spans; repeated rows are scanned one
by one; an empty table gives no rows; other columns are carried through, but those named
like a kind's spans are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import find_spans, let, up_to, whole_text

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")
WINDOW = 24

#: Patterns, alphabets, entropy thresholds in bits, allow-list.
PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "entropy": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+",
}
ALPHABETS = {
    "hex": "0123456789abcdef",
    "key": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
THRESHOLDS = {"hex": 3.2, "key": 4.0}
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # identifiers
    r"(?i)example|sample|placeholder|dummy|changeme|xxxxx|abcdefgh|01234567",
    r"^[^0-9]*$",  # words and paths without a digit
    r"^[^A-Za-z]*$",  # numbers
)


def _f(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(0.0)


def highest_entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window of the string.

    H = log2(W) - sum(c * log2 c) / W over the counts c.  The sum is kept up to date by
    the entering and the leaving character alone.
    """
    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(-1.0).alias("best"),
    )

    def scan(chars: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters = F.get(chars, i)
            leaves = F.when(i >= window, F.get(chars, i - window)).otherwise(F.lit(-1))
            c_out = F.coalesce(F.get(acc["counts"], leaves), F.lit(0))
            less = F.when(leaves >= 0, _f(c_out - 1) - _f(c_out)).otherwise(0.0)
            c_in = F.get(acc["counts"], enters) - F.when(leaves == enters, 1).otherwise(0)
            total = acc["sum"] + less + _f(c_in + 1) - _f(c_in)
            counts = F.transform(
                acc["counts"],
                lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0),
            )
            best = F.when(i >= window - 1, F.greatest(acc["best"], F.log2(F.lit(float(window))) - total / window)).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

        return F.aggregate(up_to(F.size(chars)), zero, step, lambda acc: acc["best"])

    index = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return let(index, scan)


def _entropy_spans(text: Column) -> Column:
    def high(s: Column) -> Column:
        m = s["match"]
        hexlike = m.rlike("^[0-9a-f]+$")
        return F.when(hexlike, highest_entropy(m, ALPHABETS["hex"]) >= THRESHOLDS["hex"]).otherwise(
            highest_entropy(m, ALPHABETS["key"]) >= THRESHOLDS["key"]
        )

    def allowed(s: Column) -> Column:
        out = F.lit(False)
        for pattern in ALLOWED:
            out = out | s["match"].rlike(pattern)
        return out

    return F.filter(find_spans(text, PATTERNS["entropy"]), lambda s: F.when(allowed(s), False).otherwise(high(s)))


def _base_spans(text: Column, kind: str) -> Column:
    spans = find_spans(text, PATTERNS[kind])
    if kind == "assign":
        value = r"^[A-Za-z_]+[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]{8,}$"
        return F.filter(spans, lambda s: s["match"].rlike(value))
    return spans


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add one array<struct<start,end,match>> per kind: assign_spans, access_spans, hex_spans, entropy_spans."""
    t = whole_text(text)
    out = docs.withColumns({f"{k}_spans": _base_spans(t, k) for k in BASE_KINDS} | {"entropy_spans": _entropy_spans(t)})
    known = F.concat(*[F.col(f"{k}_spans") for k in BASE_KINDS])
    apart = F.filter(
        F.col("entropy_spans"),
        lambda s: ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return out.withColumn("entropy_spans", F.when(F.size("entropy_spans") > 0, apart).otherwise(F.col("entropy_spans")))


def span_list(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the kinds' spans by start, then kind as listed; comma-joined."""
    def keyed(n: int, kind: str) -> Column:
        return F.transform(
            F.col(f"{kind}_spans"),
            lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind")),
        )

    ordered = F.array_sort(F.concat(*[keyed(n, k) for n, k in enumerate(kinds)]))
    return F.array_join(F.transform(ordered, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
