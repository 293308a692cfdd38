"""The registered queries of the operators: whole tables in, the contracts'
columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, fim, langid, lexicon, line_dedup, multiset_hash, packing, prefix_trie, quality, secret_scan,
               simhash, token_store, topk)
from ..sources.tables import read_table
from .common import documents

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets of every document."""
    df = secret_scan.scan(documents(spark, sf_dir))
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return df.select("doc_id", *[count(k).alias(f"n_{k}") for k in base],
                     F.sha2(secret_scan.joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256)
                     .alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


@register("op2_exact_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, size and verdict of every document."""
    return exact_dedup.classes(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with sequence and offset."""
    return packing.pack_documents(documents(spark, sf_dir))


@register("op4_token_store")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the files."""
    return token_store.stored_documents(documents(spark, sf_dir))


@register("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, sf_dir)
    forest = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, forest).select(
        "doc_id", langid.held_out("doc_id").alias("held_out"), "score", "predicted")


@register("op6_exact_top_k")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


@register("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of lines and the lines that go of every document."""
    return line_dedup.line_report(documents(spark, sf_dir))


@register("op8_lexicon_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and checksums of every document's ids and decoded text."""
    docs = documents(spark, sf_dir)
    return lexicon.encode(docs, lexicon.build_lexicon(docs))


@register("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@register("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs)).select(
        "doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@register("op11_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.build(read_table(spark, sf_dir, "conversations"))


@register("op12_fill_in_middle")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and checksums of every document's transformation."""
    out = fim.transform(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register("op13_document_fingerprints")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with likenesses."""
    return multiset_hash.fingerprints(documents(spark, sf_dir))
