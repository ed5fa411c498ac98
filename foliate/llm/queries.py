"""One query per operator over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import classifier as C
from foliate.llm import licenses as L
from foliate.llm import mixing as M
from foliate.llm import negatives as N
from foliate.llm import packing as K
from foliate.llm import pii as P
from foliate.llm import quality_rules as Q
from foliate.llm import quantizer as Z
from foliate.llm import repeats as R
from foliate.llm import secrets as S
from foliate.llm import simhash as H
from foliate.llm import vectors as V
from foliate.llm import warc as A
from foliate.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Q.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return M.mix_sources(docs).select("doc_id", "source", "epoch", "block", "order_key")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    listed = {k: P.span_list(F.col(f"{k}_spans"), k) for k in P.KINDS}
    return found.select(
        "doc_id",
        *[F.size(f"{k}_spans").cast("bigint").alias(f"n_{k}") for k in P.BASE_KINDS],
        F.sha2(F.concat_ws(",", *[listed[k] for k in P.BASE_KINDS]), 256).alias("base_sha256"),
        F.concat_ws(",", *[listed[k] for k in P.KINDS]).alias("spans"),
        F.concat_ws(",", *[P.score_list(F.col(f"{k}_spans"), k) for k in P.KINDS]).alias("scores"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = C.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return C.score(docs, net).select("doc_id", C.held_out().alias("held_out"), "score", "predicted")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        *[F.size(f"{k}_spans").cast("bigint").alias(f"n_{k}") for k in S.BASE_KINDS],
        F.sha2(S.span_list(S.BASE_KINDS), 256).alias("base_sha256"),
        S.span_list(S.KINDS).alias("spans"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path() -> str:
    """The public word tokenizer's file, which every node has installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return N.mine(rows, F.col("id") % 100 == 0, label=moved)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_vectors": op4_vectors,
    "op5_pii": op5_pii,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secrets": op7_secrets,
    "op8_repeats": op8_repeats,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_negatives": op11_negatives,
    "op12_licenses": op12_licenses,
    "op13_codes": op13_codes,
}
