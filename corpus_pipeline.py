"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.

Defined results: a null text counts as an empty one and stays null until it is packed; of
repeated rows one stays; rows without an id are judged, never dropped as copies, and packed;
without positive labels every document is kept; empty tables give no rows; other columns are
carried through to the last stage, also those named like a stage's own.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import classifier, mixing, packing, pii, simhash
from foliate.llm.common import discard, materialize, table
from foliate.llm.queries import tokenizer_path


#: Columns that stages add on their way.
TAKEN = {"score", "predicted", "epoch", "block", "order_key", *[f"{k}_spans" for k in pii.KINDS]}


def keeps_columns(stage):
    """The stage with the documents' own columns of such names put aside meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_own_{c}" for c in docs.columns if c in TAKEN}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in aside.items()})

    return run


@keeps_columns
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    net = classifier.learn(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, net).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_one(docs)


@keeps_columns
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets."""
    masked = pii.redact(pii.pii(docs))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


@keeps_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to 1.5 times more often than large ones; every document is kept."""
    mix = mixing.Mix(budget="cover", entropy_share=1.0, most_repeats=1.5)
    return mixing.mix_sources(docs, mix).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, neighbours along a Hilbert curve side by side."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokens and fingerprints have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    given = docs
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if before is not given:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
