"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints link at up to three differing bits.  Every distinct
fingerprint emits the variants at half that distance: all with up to one bit
flipped (links of up to two bits meet there), and, because the parities of two
fingerprints three bits apart differ, the even ones also emit the variants with
two bits flipped, where they meet the one-bit variants of odd ones.  Variants
are shuffled by their leading ``p`` bits: a row (bucket, fingerprint) stands
for all variants of the fingerprint with that prefix, and the receiving task
spells them out and finds equal ones.  A fingerprint goes to 1 + p + p(p-1)/2
buckets at most, instead of 2081 rows.  Colliding fingerprints are linked to
one of them after their distance has been checked, so a variant that many
share costs a link each, never all pairs; tasks reduce their links to a
forest.  Buckets hold one row a distinct fingerprint, so copies weigh nothing.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``words`` words joined by a space, repeats included (fewer words: the whole
sequence; none: zero).  A bit is 1 if set in over half of the shingles' XXH64
values (seed 42).

Cases: null and empty texts have fingerprint zero and link like any other.  The
graph's nodes are fingerprints, so rows are linked by their texts alone: a null
doc_id, which comes back as null, or a repeated one merges and drops nothing.
``component_id`` is the smallest doc_id of a component, nulls left out (null if
all are); components whose smallest is repeated elsewhere share it, and
``component``, their least fingerprint, tells them apart.  The filter keeps one
row of each component; there a null doc_id is the smallest.  An empty table
gives no rows.
Only ``doc_id`` and ``text`` are read; the filter passes the others on.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, staged, text_buffer, text_or_empty, wrapped
from .graph import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Distinct fingerprints for each value of the prefix, about.
BUCKET_PRINTS = 2048
#: Shingles whose bits are spread out at a time.
_BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of UTF-8 text as a signed 64-bit number."""
    import xxhash

    parts = text.lower().split()  # of bytes: ASCII alone, and these six white-space bytes
    n = len(parts) - words + 1
    if not parts:
        return 0
    joined = b" ".join(parts)
    if n <= 1:
        return int(np.frombuffer(xxhash.xxh64_digest(joined, SEED), ">i8")[0])
    ends = np.cumsum([len(w) + 1 for w in parts])
    a = np.r_[0, ends[:n - 1]].tolist()
    b = (ends[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, _BLOCK):
        raw = b"".join([digest(joined[i:j], SEED) for i, j in zip(a[lo:lo + _BLOCK], b[lo:lo + _BLOCK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.frombuffer(np.packbits(counts * 2 > n).tobytes(), ">i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), fp (signed long)."""
    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(3))
            raw = memoryview(data)
            fp = [fingerprint(bytes(raw[i:j]), words) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp, pa.int64())], ["doc_id", "h1", "h2", "fp"])

    text = text_or_empty(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"),
                       text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 int, fp long")


def _flips(bits: int, n: int) -> np.ndarray:
    """All masks of the low ``bits`` bits with ``n`` set."""
    return np.array([sum(1 << k for k in c) for c in combinations(range(bits), n)], np.uint64)


def _collisions(prefix: int, fp: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of row numbers whose variants with the given prefix are equal:
    each a link, enough of them to connect all that collide."""
    low = 64 - bits
    top = (fp >> np.uint64(low)) ^ np.uint64(prefix)
    away = np.bitwise_count(top)
    base = fp ^ (top << np.uint64(low))
    even = np.bitwise_count(fp) % 2 == 0
    one, two = _flips(low, 1), _flips(low, 2)
    at0, at1 = np.flatnonzero(away == 0), np.flatnonzero(away <= 1)
    value = np.concatenate([base[at1], (base[at0, None] ^ one).ravel()])
    owner = np.concatenate([at1, np.repeat(at0, len(one))])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    if not len(value):
        return np.zeros((0, 2), np.int64)
    head = np.r_[True, value[1:] != value[:-1]]
    hub = owner[head][np.cumsum(head) - 1]
    pairs = [np.stack([hub, owner], 1)[~head]]
    value, hub = value[head], owner[head]

    def meet(who, variants):
        k = np.minimum(np.searchsorted(value, variants), len(value) - 1)
        hit = value[k] == variants
        if hit.any():
            pairs.append(np.stack([hub[k[hit]], np.broadcast_to(who, variants.shape)[hit]], 1))

    at2 = np.flatnonzero(even & (away == 2))
    meet(at2, base[at2])
    at1 = np.flatnonzero(even & (away == 1))
    for m in one:
        meet(at1, base[at1] ^ m)
    at0 = np.flatnonzero(even & (away == 0))
    step = max(1, (1 << 20) // max(1, len(at0)))
    for k in range(0, len(two), step):
        block = base[at0][:, None] ^ two[None, k:k + step]
        meet(at0[:, None], block)
    pairs = np.concatenate(pairs)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _forest(n: int, pairs: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n nodes the node of least rank that its pairs lead to."""
    root = np.arange(n)
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = place[pairs[:, 0]], place[pairs[:, 1]]
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        while (jump := least[least] != least).any():
            least[jump] = least[least[jump]]
        new = least[root]
        if (new == root).all():
            return order[new[place]]
        root = new


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_prints: int = BUCKET_PRINTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (``fp``) that connect all of
    them that are linked."""
    if max_bits != 3:
        raise ValueError("the variants are laid out for links of up to three bits")
    n, p = prints.count(), 2
    while p < 24 and (n >> p) > bucket_prints:
        p += 1
    near = [0, *_flips(p, 1).tolist()]
    far = near + _flips(p, 2).tolist()
    masks = F.when(F.bit_count("fp") % 2 == 0, F.array(*map(F.lit, far))).otherwise(F.array(*map(F.lit, near)))
    prefix = F.shiftrightunsigned("fp", 64 - p)
    routed = (prints.withColumn("_m", F.explode(masks))
              .select(prefix.bitwiseXOR(F.col("_m").cast("long")).alias("bucket"), "fp"))

    def join(key, pdf):
        own_fp = pdf["fp"].to_numpy()
        fp = own_fp.view(np.uint64)
        pairs = _collisions(int(key[0]), fp, p)
        pairs = pairs[np.bitwise_count(fp[pairs[:, 0]] ^ fp[pairs[:, 1]]) <= max_bits]
        if not len(pairs):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        root = _forest(len(fp), pairs, own_fp)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": own_fp[own], "b": own_fp[root[own]]})

    return routed.groupBy("bucket").applyInPandas(join, "a long, b long")


def _labelled(docs: DataFrame, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``fingerprints``, and fp, component (its least fingerprint) of
    the distinct ones."""
    rows = staged(fingerprints(docs, words), "fingerprints")
    prints = staged(rows.select("fp").distinct(), "prints")
    found = components(links(prints, max_bits))
    return rows, prints.join(found, prints.fp == found.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id (the
    smallest doc_id that links lead to, itself included) and component."""
    rows, label = _labelled(docs, words, max_bits)
    label = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(label, "fp"), "components")
    best = label.groupBy("component").agg(F.min("least").alias("component_id"))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(label.join(best, "component").select("fp", "component", "component_id"), "fp").select(
        "doc_id", hexed("fp").alias("fingerprint"), "component_id", hexed("component").alias("component"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, all columns: that with the smallest doc_id,
    of several texts under it the one with the smallest hashes."""
    rows, label = _labelled(docs, words, max_bits)
    least = rows.groupBy("fp").agg(F.min(F.struct(doc_key(rows).alias("doc_id"), "h1", "h2")).alias("k"))
    kept = least.join(label, "fp").groupBy("component").agg(F.min("k").alias("k")).select(
        F.col("k.doc_id").alias("id"), "k.h1", "k.h2")
    keyed = wrapped(docs).select("id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), "row")
    return keyed.join(kept, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"]).select("row.*")
