"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; ``run`` writes what a stage returns as Parquet in the shared
checkpoint folder and reads it again for the next one.

Cases: a null or empty text, and one without a letter, has no language and goes
in the first stage; handed to a later stage it counts as an empty text.  Texts
of any length are read whole.  A null doc_id is the smallest: of equal or near
texts its row stays, and it comes back as null.  Rows that repeat a doc_id with
other texts are documents of their own; equal rows are copies, of which one
stays.  Ties are settled by the texts' hashes.  All columns pass through the
stages before the last as a struct, so other columns and their names do not
matter.  An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threatlens.llm import exact_dedup, langid, packing, secret_scan, simhash
from threatlens.llm.common import documents, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those rejected go."""
    return langid.keep_recognised(docs, langid.train(documents(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("secret_scan", mask_secrets), ("best_fit_packing", pack)]

#: The first and last stages have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
