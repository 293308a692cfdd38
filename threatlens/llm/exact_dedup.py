"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition sorts the digests of its texts into runs in which each
digest stands once, with the row that would stay and the count.  The runs are
then exchanged in binomial rounds: partitions have numbers, and in a round the
partitions whose numbers differ in one base-``2**RADIX_BITS`` digit exchange the parts
of their runs so that each keeps the digests with its own value of that digit
(``RADIX_BITS`` binary exchanges at once).  The receiver merges the sorted parts
it gets and again keeps one entry a digest.  After the last round all entries
of a digest have met, and a digest that a third of all rows share was never
more than one entry a run.  Entries merge by the first 64 bits of the SHA-256
and only after the whole SHA-256 has been compared; the smallest identifier is
kept at each level among the longest originals.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``.
Cases: a null text counts as empty, and empty texts equal each other.  Of equal
texts the one with the most code points stays, then the smallest ``doc_id``.
Rows that repeat a ``doc_id`` and text are copies like any others; exactly one
row of a class is ``kept``, and the filter keeps one.  A null doc_id is smaller
than any other and comes back as null (in ``keep_id`` too).  An empty table
gives no rows.  Only ``doc_id`` and ``text``
are read; the filter passes every other column on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, parallelism, staged, text_or_empty, wrapped

RADIX_BITS = 4
#: Rows of a run that a worker sorts at a time.
RUN_ROWS = 1 << 18
_RUN = "digest long, sha binary, n_cp long, doc_id long, rid long, real boolean, copies long, n long"
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text):
    """The text without the six white-space characters."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame) -> DataFrame:
    """doc_id (null: the smallest long), real (it is not null), rid (a number of
    the row), sha (32 bytes) of the normalised text, n_cp (code points of the
    original).  Write them before use: the numbers differ from run to run."""
    text = text_or_empty(docs)
    return docs.select(doc_key(docs).alias("doc_id"), F.col("doc_id").cast("long").isNotNull().alias("real"),
                       F.monotonically_increasing_id().alias("rid"),
                       F.unhex(F.sha2(normalised(text), 256)).alias("sha"),
                       F.char_length(text).cast("long").alias("n_cp"))


def _merged(t: pa.Table) -> pa.Table:
    """One entry a digest (and slot) of a table sorted by them, -n_cp, real,
    doc_id, rid."""
    n = len(t)
    if n < 2:
        return t
    d, c, i, real = (t.column(k).to_numpy() for k in ("digest", "n_cp", "doc_id", "real"))
    sha = np.frombuffer(b"".join(t.column("sha").to_pylist()), ">i8").reshape(-1, 4)
    same = (d[1:] == d[:-1]) & (sha[1:] == sha[:-1]).all(axis=1)
    if "slot" in t.column_names:
        slot = t.column("slot").to_numpy()
        same &= slot[1:] == slot[:-1]
    head = np.flatnonzero(np.r_[True, ~same])
    first = np.repeat(head, np.diff(head, append=n))
    alike = (c == c[first]) & (i == i[first]) & (real == real[first])
    sums = {"copies": np.add.reduceat(np.where(alike, t.column("copies").to_numpy(), 0), head),
            "n": np.add.reduceat(t.column("n").to_numpy(), head)}
    t = t.take(pa.array(head))
    for name, col in sums.items():
        t = t.set_column(t.schema.get_field_index(name), name, pa.array(col))
    return t


def _sorted(t: pa.Table) -> pa.Table:
    return t.sort_by([("digest", "ascending"), ("sha", "ascending"), ("n_cp", "descending"),
                      ("real", "ascending"), ("doc_id", "ascending"), ("rid", "ascending")])


def _make_runs(batches):
    """Level 0: sorted runs of a partition's own rows."""
    kept, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sha = batch.column("sha")
        whole = np.frombuffer(b"".join(sha.to_pylist()), ">i8").reshape(-1, 4)
        one = pa.array(np.ones(batch.num_rows, np.int64))
        kept.append(pa.RecordBatch.from_arrays(
            [pa.array(whole[:, 0].astype(np.int64)), sha.cast(pa.binary()),
             *(batch.column(k) for k in ("n_cp", "doc_id", "rid", "real")), one, one],
            ["digest", "sha", "n_cp", "doc_id", "rid", "real", "copies", "n"]))
        rows += batch.num_rows
        if rows >= RUN_ROWS:
            yield from _merged(_sorted(pa.Table.from_batches(kept))).to_batches()
            kept, rows = [], 0
    if kept:
        yield from _merged(_sorted(pa.Table.from_batches(kept))).to_batches()


def _merge_runs(batches):
    """Merge the sorted entries that the exchange hands over; the last digest
    of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = _merged(pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
        rest = t.slice(len(t) - 1)
        yield from t.slice(0, len(t) - 1).to_batches()
    if rest is not None:
        yield from rest.combine_chunks().to_batches()


def merge_tree(rows: DataFrame, radix_bits: int = RADIX_BITS) -> DataFrame:
    """One row per distinct text from ``digests`` rows: sha, n_cp, doc_id, real
    and rid of the row that stays, copies (rows that repeat both), n (rows in all)."""
    parts = parallelism(rows.sparkSession)
    radix, rounds = 1 << radix_bits, 1
    while radix ** rounds < parts:
        rounds += 1
    number = F.pmod(F.spark_partition_id(), F.lit(radix ** rounds)).cast("long")
    runs = rows.select("doc_id", "sha", "n_cp", "rid", "real").mapInArrow(_make_runs, _RUN).withColumn("slot", number)
    for r in range(rounds):
        unit = radix ** r
        own = F.floor(F.col("slot") / unit) % radix
        wanted = F.pmod(F.shiftright("digest", radix_bits * r), F.lit(radix))
        runs = (runs.withColumn("slot", (F.col("slot") + (wanted - own) * unit).cast("long"))
                .repartition(parts, "slot")
                .sortWithinPartitions("slot", "digest", "sha", F.desc("n_cp"), "real", "doc_id", "rid")
                .mapInArrow(_merge_runs, _RUN + ", slot long"))
    return runs.drop("slot", "digest")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size,
    kept, text_sha256, n_cp, copies (rows that repeat the one that stays)."""
    rows = staged(digests(docs), "digests")
    best = staged(merge_tree(rows), "digest-classes")
    best = best.select("sha", F.when(F.col("real"), F.col("doc_id")).alias("keep_id"), F.col("rid").alias("_rid"),
                       F.col("n").alias("group_size"), "copies")
    return rows.join(best, "sha").select(
        F.when(F.col("real"), F.col("doc_id")).alias("doc_id"), "keep_id", "group_size",
        (F.col("rid") == F.col("_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_cp", "copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, all their columns."""
    key = ["id", "sha", "cp"]
    kept = classes(docs).where("kept").select(
        doc_key(docs, "doc_id").alias("id"), F.col("text_sha256").alias("sha"), F.col("n_cp").alias("cp")).distinct()
    rows = wrapped(docs).select("id", F.sha2(normalised(F.col("text")), 256).alias("sha"),
                                F.char_length("text").cast("long").alias("cp"), "row")
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")
