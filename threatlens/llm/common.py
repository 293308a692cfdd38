"""Helpers shared by the operators: Arrow text buffers, bounded slices,
staged tables in the shared checkpoint folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import read_table

#: Bytes of text that a Python worker handles at a time (one longer text is
#: handled alone, whole).
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once in the shared checkpoint folder and read it back."""
    return materialize(df, f"llm-{name}")


def text_or_empty(df: DataFrame, col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def doc_key(df: DataFrame, col: str = "doc_id"):
    """The identifier as a long; null counts as the smallest long."""
    return F.coalesce(F.col(col).cast("long"), F.lit(-(1 << 63)))


def wrapped(docs: DataFrame) -> DataFrame:
    """``id``, ``text`` (null: empty) and ``row``, the whole row as a struct, so
    that no other column's name can clash with an operator's own."""
    return docs.select(doc_key(docs).alias("id"), text_or_empty(docs).alias("text"), F.struct("*").alias("row"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string array; null: empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    if data is None or not len(off) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def row_slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... (count of them) for each pair, joined."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
