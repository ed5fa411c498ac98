"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

In DataFrame functions only.  A span's score is its kind's, in hundredths, raised by the
kind's context words and lowered by words that speak against personal data, in the 40
characters before or after it.  Kinds email, ip, card and phone are always reported where
their pattern and check hold.  Kinds iban (mod-97) and ssn are added where their score
reaches the threshold: an iban unless words speak against it, an ssn where words speak for
it.

Patterns are written with possessive repeats and begin only where a run of their
characters begins or the last match ended, which finds the same leftmost matches
in linear time however long a run is.

Defined results: a null text is empty and has no spans; repeated rows are scanned one
by one; an empty table gives no rows; other columns are carried through, but those named
like a kind's spans are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import find_spans, let, whole_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

#: The patterns, base scores and context words of each kind.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
SCORES = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 60, "ssn": 30}
CONTEXT = {
    "email": r"mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|payment",
    "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|account|bank",
    "ssn": r"ssn|social security|tax id",
}
AGAINST = r"example|sample|dummy|version|serial number|part number|order number"
CONTEXT_BONUS, CONTEXT_CHARS, THRESHOLD = 30, 40, 60


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """True where the string of digits passes the Luhn check."""
    doubled = let(
        F.split(F.reverse(digits), ""),
        lambda d: F.aggregate(
            F.transform(
                F.filter(d, lambda c: c != ""),
                lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                    F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))
                ),
            ),
            F.lit(0),
            lambda acc, x: acc + x,
        ),
    )
    return doubled % 10 == 0


def mod97(iban: Column) -> Column:
    """True where the account number (no spaces) leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    """The check of a proposed match."""
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return let(F.replace(match, F.lit(" ")), lambda x: F.when(F.length(x).between(15, 34), mod97(x)).otherwise(False))
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind with their score, as array<struct<start,end,match,score>>."""
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind)
    spans = F.filter(find_spans(text, PATTERNS[kind], hint), lambda s: confirmed(kind, s["match"]))

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0).cast("bigint"))
        before, after = F.substr(text, begin + 1, s["start"] - begin), F.substr(text, s["end"] + 1, F.lit(CONTEXT_CHARS))
        near = F.lower(F.concat(before, F.lit("\n"), after))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0) - F.when(near.rlike(AGAINST), CONTEXT_BONUS).otherwise(0)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), score.alias("score"))

    out = F.transform(spans, scored)
    return out if kind in BASE_KINDS else F.filter(out, lambda s: s["score"] >= THRESHOLD)


def pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add one array of spans per kind: email_spans, ip_spans, ..."""
    t = whole_text(text)
    return docs.withColumns({f"{k}_spans": kind_spans(t, k) for k in KINDS})


def span_list(spans: Column, kind: str) -> Column:
    """kind:start:end, comma-joined; null when there are none."""
    told = F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"]))
    return F.when(F.size(spans) > 0, F.array_join(told, ","))


def score_list(spans: Column, kind: str) -> Column:
    """kind:start:score, comma-joined; null when there are none."""
    told = F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["score"]))
    return F.when(F.size(spans) > 0, F.array_join(told, ","))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets and drop the span columns.

    Overlapping spans become one, named after the one that starts first.
    """
    cols = [f"{k}_spans" for k in KINDS]

    def named(kind: str) -> Column:
        return F.transform(
            F.col(f"{kind}_spans"),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")),
        )

    one = F.concat(*[named(k) for k in KINDS])

    def cut(spans: Column) -> Column:
        state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substr(F.col(text), acc["at"] + 1, (s["start"] - acc["at"]))
            fresh = s["start"] >= acc["at"]
            return F.struct(
                F.when(fresh, F.concat(acc["out"], gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
                .otherwise(acc["out"])
                .alias("out"),
                F.greatest(acc["at"], s["end"]).alias("at"),
            )

        return F.aggregate(
            spans, state, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, F.lit(2**31 - 1)))
        )

    cleaned = let(F.array_sort(one), lambda s: F.when(F.size(s) == 0, F.col(text)).otherwise(cut(s)))
    return found.withColumn(text, cleaned).drop(*cols)
