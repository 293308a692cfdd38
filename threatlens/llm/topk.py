"""Exact top-k inner products by norm order, rotation and residual bounds.

Vectors become integers floor(256 x).  They are range-partitioned by descending
length, so a partition holds vectors of like length and is read longest first.
A rotation by the eigenvectors of the second-moment matrix (the right singular
vectors of the table, summed over all rows) moves most of a vector's length
into its first coordinates.  For a block of queries a task multiplies those
coordinates alone; by Cauchy-Schwarz the rest adds at most the product of the
residual lengths.  A batch whose longest vector cannot reach a query's k-th best
score is skipped for that query, and only pairs whose bound reaches it are
multiplied out, in integers.  The k-th best scores start from the longest
vectors of the table and rise as the task goes on.

Queries are handled in blocks of about ``BLOCK_QUERIES``, one after the other,
each shipped to all tasks and dropped when its hits are written; what a task
returns is k rows a query at most, and only those that reach the starting bound.

Cases: vectors that are null or hold null or non-finite components take no
part.  Every other row is a candidate, rows that repeat a vec_id and rows
without one too; a query leaves out its own row alone, and rows that repeat a
query's vec_id are queries of their own.  Vectors shorter than the longest are
filled up with zeros.  Ties go to the smaller vec_id, null before all; a query
with fewer than k others gets all of them.  Components are exact up to 2**26
after scaling.  An empty table gives no rows.  Only ``vec_id`` and the vectors
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, staged

SCALE = 256
#: Queries of a block, on average.
BLOCK_QUERIES = 4096
#: Longest vectors that give the first bounds.
SEED_VECTORS = 2048
#: Vectors multiplied at a time.
BATCH_VECTORS = 1024
#: What a null vec_id is ordered as.
LEAST = -(1 << 63)
#: Relative slack of the bounds, far above the rounding of sums of doubles.
SLACK = 1e-9


def integer_vectors(df: DataFrame, col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """rid, vec_id, v (array of long), norm2 (double) of the vectors that take
    part.  ``rid`` numbers the rows, below zero where vec_id is null; write the
    table before use, the numbers differ from run to run."""
    x = F.col(col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    vec, n = F.col("vec_id").cast("long"), F.monotonically_increasing_id()
    rows = df.where(F.col(col).isNotNull() & ~bad).select(
        F.when(vec.isNull(), -n - 1).otherwise(n).alias("rid"), F.coalesce(vec, F.lit(LEAST)).alias("vec_id"), v.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.withColumn("norm2", norm2)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as integers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal matrix whose rows are the principal directions, first first.
    Tasks send their dim x dim sums, which Spark adds up."""
    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            v = _matrix(batch.column(0), dim).astype(np.float64)
            total += v.T @ v
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())],
                                         ["i", "j", "x"])

    sums = vectors.select("v").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    matrix = np.zeros((dim, dim))
    for r in sums.collect():  # dim x dim numbers, whatever the table
        matrix[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh(matrix)[1][:, ::-1].T


class Best:
    """The k best (score, then null, then smaller vec_id) of each query of a
    block; ``ids`` are the queries' row numbers."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray):
        self.ids, self.k, self.least = ids, k, least.astype(np.float64)
        self.query, self.vec, self.row, self.score = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, vec: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        ok = (score >= self.least[query]) & (row != self.ids[query])
        if not ok.any():
            return
        q = np.concatenate([self.query, query[ok]])
        v = np.concatenate([self.vec, vec[ok]])
        r = np.concatenate([self.row, row[ok]])
        s = np.concatenate([self.score, score[ok]])
        order = np.lexsort((r, v, r >= 0, -s, q))
        q, v, r, s = q[order], v[order], r[order], s[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        self.query, self.vec, self.row, self.score = q[keep], v[keep], r[keep], s[keep]
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def search_batch(best: Best, q: np.ndarray, qr: np.ndarray, head: int, v: np.ndarray, vec: np.ndarray,
                 row: np.ndarray, turn: np.ndarray) -> None:
    """Offer a batch of vectors to a block of queries (``qr``: rotated)."""
    vr = v.astype(np.float64) @ turn.T
    q_len, v_len = np.linalg.norm(qr, axis=1), np.linalg.norm(vr, axis=1)
    longest = v_len.max(initial=0.0)
    live = np.flatnonzero(q_len * longest * (1 + SLACK) >= best.least)
    if not len(live):
        return
    q_rest, v_rest = np.linalg.norm(qr[live, head:], axis=1), np.linalg.norm(vr[:, head:], axis=1)
    bound = qr[live, :head] @ vr[:, :head].T
    bound += q_rest[:, None] * v_rest
    bound += SLACK * q_len[live][:, None] * v_len
    i, j = np.nonzero(bound >= best.least[live][:, None])
    for lo in range(0, len(i), 1 << 16):
        a, b = live[i[lo:lo + (1 << 16)]], j[lo:lo + (1 << 16)]
        best.add(a, vec[b], row[b], np.einsum("ij,ij->i", q[a], v[b]))


def top_k(df: DataFrame, k: int = 5, query_every: int = 50, col: str = "embedding", scale: int = SCALE,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose
    vec_id is divisible by ``query_every``."""
    spark = df.sparkSession
    parts = parallelism(spark)
    vectors = staged(integer_vectors(df, col, scale)
                     .repartitionByRange(parts, F.desc("norm2"), F.col("vec_id"), F.col("rid"))
                     .sortWithinPartitions(F.desc("norm2"), "vec_id", "rid"), "vectors")
    asks = (F.col("vec_id") % query_every == 0) & (F.col("rid") >= 0)
    facts = vectors.agg(F.max(F.size("v")).alias("d"), F.count(F.when(asks, 1)).alias("n")).first()
    dim, n = facts["d"] or 0, facts["n"]
    if not n or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(vectors, dim)
    head = max(1, dim // 4)
    seeds = vectors.orderBy(F.desc("norm2"), "vec_id", "rid").limit(SEED_VECTORS).select("rid", "vec_id", "v").toArrow()
    seed_v = _matrix(seeds.column("v").combine_chunks(), dim)
    seed_row, seed_id = seeds.column("rid").to_numpy(), seeds.column("vec_id").to_numpy()
    blocks = max(1, -(-n // block_queries))
    queries = vectors.where(asks).withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    schema = "query_row long, query_id long, rid long, vec_id long, score long"

    def block_hits(b: int) -> DataFrame | None:
        """The written hits of a block; its queries are then dropped everywhere."""
        rows = queries.where(F.col("_b") == b).select("rid", "vec_id", "v").toArrow()  # one block
        if not rows.num_rows:
            return None
        ids, names = rows.column("rid").to_numpy(), rows.column("vec_id").to_numpy()
        q = _matrix(rows.column("v").combine_chunks(), dim)
        first = Best(ids, k, np.full(len(ids), -np.inf))
        for lo in range(0, len(seed_id), BATCH_VECTORS):
            part = slice(lo, lo + BATCH_VECTORS)
            search_batch(first, q, q @ turn.T, head, seed_v[part], seed_id[part], seed_row[part], turn)
        shared = spark.sparkContext.broadcast((ids, names, q, first.least, turn))  # a block: bounded

        def run(batches):
            ids, names, q, least, turn = shared.value
            best = Best(ids, k, least.copy())
            qr = q @ turn.T
            for batch in batches:
                row, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for lo in range(0, batch.num_rows, BATCH_VECTORS):
                    v = _matrix(batch.column(2).slice(lo, BATCH_VECTORS), dim)
                    search_batch(best, q, qr, head, v, vec[lo:lo + BATCH_VECTORS], row[lo:lo + BATCH_VECTORS], turn)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (best.ids[best.query], names[best.query], best.row, best.vec, best.score)],
                [c.split()[0] for c in schema.split(", ")])

        hits = staged(vectors.select("rid", "vec_id", "v").mapInArrow(run, schema), "hits")
        shared.unpersist()
        return hits

    parts = [hits for hits in map(block_hits, range(blocks)) if hits is not None]
    found = spark.read.schema(schema).parquet(*[f for hits in parts for f in hits.inputFiles()])
    real = F.col("rid") >= 0
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), real, "vec_id", "rid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(real, F.col("vec_id")).alias("vec_id"), "score")
