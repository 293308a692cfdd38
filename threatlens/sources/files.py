"""Request sources.

S1: a text file of URLs -- strip each line, keep non-empty lines starting
with ``http`` (case-sensitive), no normalisation.  S2: JSON documents with a
``urls`` array, normalised by the scoring plan.  Both are plain DataFrame
readers, so any number of files is read in parallel.  The service's limits per
upload (lines of a file, URLs of a document) are options: what is beyond a
limit is not lost but comes back with ``over_limit`` set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import py_strip


def url_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """S1 on a DataFrame of text lines."""
    s = lines.select(*[c for c in lines.columns if c != line_col], py_strip(F.col(line_col)).alias("url"))
    return s.where((F.col("url") != "") & F.col("url").startswith("http"))


def read_url_file(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``spark.read.text`` (undecodable bytes are replaced, not fatal).
    With ``limit``, ``over_limit`` marks the accepted lines of a file beyond
    its first ``limit`` ones, in file order."""
    lines = spark.read.text(path)
    if limit is None:
        return url_lines(lines)
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.file_block_start").alias("_block"),
                          F.monotonically_increasing_id().alias("_n"))
    order = Window.partitionBy("file").orderBy("_block", "_n")
    return (url_lines(placed).withColumn("over_limit", F.row_number().over(order) > limit)
            .select("url", "file", "over_limit"))


def batch_requests(docs: DataFrame, per_batch: int | None = None, batch_id: str | None = None) -> DataFrame:
    """One request row per URL of each document's ``urls`` array, with the
    batch, the position and, with ``per_batch``, ``over_limit`` from that
    position on.  The batch id is a column of the documents or else the hash of
    the URLs, so it is the same whenever the plan runs again."""
    batch = F.col(batch_id) if batch_id else F.xxhash64(F.to_json(F.struct("urls")))
    d = docs.select(batch.alias("batch_id"), F.posexplode("urls").alias("pos", "url"))
    return d if per_batch is None else d.withColumn("over_limit", F.col("pos") >= per_batch)


def read_batch_requests(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """S2 from JSON files (one document per line)."""
    return batch_requests(spark.read.schema("urls array<string>").json(path), per_batch)
