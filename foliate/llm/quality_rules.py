"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column that is true where it rejects.  A bounded fraction of
the rows is used to estimate, per rule, how often it rejects and what it costs: the time
of a pass over the sample once its code is compiled, less that of a pass that only counts.
Rules then run in descending order of rejections per second inside one CASE, which stops
at the first rule that rejects.  The order changes the time, never the verdict.  Words and
lines are split once and handed from the base counts to the rules.

Defined results: a null text counts as empty (no words, base_failed).  Repeated rows
are judged one by one.  An empty table gives no rows.  Columns of the input with other
names are carried through `apply`; those named like an output are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import let, up_to, whole_text, words

WINDOW = 5


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """Words inside n-word windows that occur at least twice in the array `w`.

    Windows are compared by a 64-bit hash.  Most texts repeat none, which the number
    of distinct hashes shows; only the others pay for sorting and counting.
    """

    def counted(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda p, j: F.coalesce(p["h"] == F.get(pairs, j - 1)["h"], F.lit(False))
            | F.coalesce(p["h"] == F.get(pairs, j + 1)["h"], F.lit(False)),
        )
        return let(
            F.array_sort(F.transform(twice, lambda p: p["i"])),
            lambda q: F.aggregate(
                F.transform(q, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(q, k + 1), x + n) - x)),
                F.lit(0).cast("bigint"),
                lambda acc, x: acc + x,
            ),
        )

    hashes = F.transform(up_to(F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), counted)
        ),
    )


def base_counts(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; with `keep` also _words and _lines."""
    t = whole_text(text)
    told = F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(  # a lambda variable is never computed again, whatever projections are merged
        F.col("_words"),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    out = docs.withColumns({"_words": words(t), "_lines": F.split(t, "\n", -1)}).withColumn("_counts", counts).withColumns(
        {
            "n_words": F.col("_counts.n_words"),
            "word_chars": F.col("_counts.word_chars"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint"),
            "n_dup_lines": F.when(F.size("_lines") < 2, F.lit(0)).otherwise(let(told, lambda x: F.size(x) - F.size(F.array_distinct(x)))).cast("bigint"),
            "n_repeat_words": F.col("_counts.n_repeat_words"),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).drop("_counts")
    return out if keep else out.drop("_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """`rejects` is a boolean column over the text and the columns of base_counts, _words and _lines among them."""

    name: str
    rejects: Column


def default_rules(text: str = "text") -> list[Rule]:
    t = whole_text(text)
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 8 * F.col("word_chars")),
        Rule("word_length", (F.col("word_chars") > 25 * F.col("n_words")) | (2 * F.col("word_chars") < 3 * F.col("n_words"))),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 3 * F.size("_lines")),
        Rule("shouting", 2 * F.length(F.regexp_replace(t, r"\P{Lu}+", "")) > letters),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
        Rule(
            "stutter",
            let(F.col("_words"), lambda w: 5 * F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))) > F.size(w)),
        ),
    ]


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    rejection: float
    seconds: float

    @property
    def worth(self) -> float:
        return self.rejection / max(self.seconds, 1e-9)


def _split(counted: DataFrame, text: str) -> DataFrame:
    """With the words and lines that rules read, where base_counts has not kept them."""
    if "_words" in counted.columns and "_lines" in counted.columns:
        return counted
    return counted.withColumns({"_words": words(whole_text(text)), "_lines": F.split(whole_text(text), "\n", -1)})


class QualityCascade:
    def __init__(self, rules: Sequence[Rule] | None = None, text: str = "text"):
        self.rules = list(default_rules(text) if rules is None else rules)
        self.text = text

    def estimate(self, counted: DataFrame, fraction: float = 0.01, seed: int = 7) -> list[RuleEstimate]:
        """Rejection rate and cost of each rule on a sampled `fraction` of the rows.

        The sample only orders the rules.  Without sampled rows all worths are zero
        and the given order stays.
        """
        sample = _split(counted, self.text).where(~F.col("base_failed")).sample(fraction=fraction, seed=seed)
        columns = [self.text, "_words", "_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        sample = sample.select(*dict.fromkeys(columns)).persist()

        def timed(c: Column) -> tuple[int, float]:
            """Rows where c holds, and the least time of three passes, the first of which compiles."""
            hits, seconds = 0, []
            for _ in range(3):
                began = time.perf_counter()
                hits = sample.agg(F.count(F.when(c, 1))).first()[0]
                seconds.append(time.perf_counter() - began)
            return hits, min(seconds)

        try:
            n, idle = timed(F.col("n_words") >= 0)
            told = [(rule, *timed(rule.rejects)) for rule in self.rules]
            return [RuleEstimate(rule.name, hits / n if n else 0.0, max(seconds - idle, 1e-4)) for rule, hits, seconds in told]
        finally:
            sample.unpersist()

    def ordered(self, estimates: Sequence[RuleEstimate]) -> list[Rule]:
        worth = {e.name: e.worth for e in estimates}
        return sorted(self.rules, key=lambda r: -worth.get(r.name, 0.0))

    def apply(self, counted: DataFrame, order: Sequence[Rule] | None = None) -> DataFrame:
        """Add rejected_by (null: kept) and kept.  CASE evaluates no rule after the first that rejects."""
        first = F.when(F.col("base_failed"), F.lit("base"))
        for rule in self.rules if order is None else order:
            first = first.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
        out = _split(counted, self.text).withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())
        return out.drop("_words", "_lines")


def quality_rules(docs: DataFrame, text: str = "text", fraction: float = 0.01) -> DataFrame:
    """Base counts, then the cascade in its estimated order."""
    cascade = QualityCascade(text=text)
    counted = base_counts(docs, text, keep=True)
    sampled = base_counts(docs.sample(fraction=fraction, seed=7), text, keep=True)
    return cascade.apply(counted, cascade.ordered(cascade.estimate(sampled, fraction=1.0)))
