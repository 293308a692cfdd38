"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (what stands between newlines; an
empty text has none).  Every paragraph is hashed to a wide vector, and the
fingerprint is the sum of the vectors, lane by lane, modulo powers of two:

* ``DENSE`` lanes modulo 2**32, from one BLAKE2b digest of the paragraph: two
  texts have equal lanes when they hold the same paragraphs as often, in any
  order, and only then up to the chance of a 512-bit sum;
* ``LANES`` lanes modulo 2**16, one signed count a shingle of ``WORDS`` words
  of the paragraph (fewer words: all of them), in a lane and with a sign that
  the shingle's hash chooses.  Squared distances between these lanes estimate
  how many shingles differ, which gives the likeness.

Sums need no order, so paragraphs are inserted or deleted by adding or
subtracting their vectors: the fingerprint of the edited text is that of the
text, less the paragraphs from the cut on, plus the new ones.

``likeness`` of two fingerprints: 1 - |a - b|^2 / (|a|^2 + |b|^2) over the
signed lanes, at least 0; equal fingerprints have 1, and where no lane is set
it is 0.

The edit needs each document's successor by doc_id.  Documents are
range-partitioned and sorted once; a task reads its range in order and holds
one document back until the next arrives.  The first and last document of each
partition are handed over in a table of two rows a partition, where the last
meets the first of the next partition.

Cases: a null text counts as empty; an empty text is not edited, and its
fingerprint is the zero vector.  Null doc_ids come first and come back as null;
rows that share a doc_id follow one another by a hash of their text, so equal
rows give equal results in any run.  A document alone in the table is followed
by itself.  Texts are read whole.  An empty table gives no rows.  Only
``doc_id`` and ``text`` are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, parallelism, staged, text_or_empty

DENSE = 16
LANES = 256
WORDS = 3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # odd numbers


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a number spread over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all paragraphs, with their paragraph's number."""
    data = np.frombuffer(b"\n".join(paragraphs) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.r_[True, space].astype(np.int8))
    start = np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = np.flatnonzero(edge == 1)
    size = stop - start
    bounds = np.cumsum([len(p) + 1 for p in paragraphs])
    owner = np.searchsorted(bounds, start, side="right")
    # a word is a polynomial in its bytes
    power = np.ones(int(size.max()), np.uint64)
    power[1:] = np.uint64(0x100000001B3)
    power = np.multiply.accumulate(power)
    inside = np.flatnonzero(~space)
    at = inside - np.repeat(start, size)
    word = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * power[at], np.cumsum(size) - size)
    word = _mixed(word ^ size.astype(np.uint64))
    count = np.bincount(owner, minlength=len(paragraphs))
    left = np.repeat(np.cumsum(count), count) - np.arange(len(word))  # words of the paragraph from here on
    first = np.r_[True, owner[1:] != owner[:-1]]
    whole = np.where(first, np.minimum(left, WORDS), WORDS)  # a short paragraph is one shingle
    total = np.zeros(len(word), np.uint64)
    for k in range(WORDS):
        shifted = np.zeros(len(word), np.uint64)
        shifted[:len(word) - k] = word[k:]
        total += np.where(k < whole, shifted * _SEEDS[k], np.uint64(0))
    keep = first | (left >= WORDS)
    return _mixed(total[keep]), owner[keep]


def vectors(paragraphs: list[bytes], doc: np.ndarray, sign: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over each document's paragraphs, added or (sign -1) subtracted:
    dense lanes (docs x DENSE, uint32) and signed lanes (docs x LANES, int16)."""
    dense = np.zeros((docs, DENSE), np.uint32)
    lanes = np.zeros(docs * LANES)
    if paragraphs:
        digest = hashlib.blake2b
        rows = np.frombuffer(b"".join([digest(p, digest_size=4 * DENSE).digest() for p in paragraphs]), "<u4")
        np.add.at(dense, doc, rows.reshape(-1, DENSE) * sign.astype(np.int64).astype(np.uint32)[:, None])
        h, owner = shingle_hashes(paragraphs)
        key = doc[owner] * LANES + (h >> np.uint64(8)).astype(np.int64) % LANES
        lanes = np.bincount(key, np.where(h & np.uint64(1), 1.0, -1.0) * sign[owner], minlength=docs * LANES)
    return dense, lanes.astype(np.int64).astype(np.int16).reshape(docs, LANES)


def paragraphs_of(text: str) -> list[bytes]:
    return text.encode().split(b"\n") if text else []


def fingerprint(text: str) -> str:
    """The fingerprint of one text, as lowercase hex."""
    return _bytes(*_own([text]))[0].hex()


def updated(print_: str, removed: list[str] = (), added: list[str] = ()) -> str:
    """A fingerprint after paragraphs were deleted and inserted."""
    raw = bytes.fromhex(print_)
    dense = np.frombuffer(raw[:4 * DENSE], "<u4")[None]
    lanes = np.frombuffer(raw[4 * DENSE:], "<i2")[None]
    parts = [p.encode() for p in [*removed, *added]]
    sign = np.r_[-np.ones(len(removed), np.int64), np.ones(len(added), np.int64)]
    d, w = vectors(parts, np.zeros(len(parts), np.int64), sign, 1)
    return _bytes(dense + d, lanes + w)[0].hex()


def _own(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [paragraphs_of(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    return vectors([x for p in parts for x in p], doc, np.ones(len(doc), np.int64), len(texts))


def _bytes(dense: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    return [a.astype("<u4").tobytes() + b.astype("<i2").tobytes() for a, b in zip(dense, lanes)]


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows of signed lanes; 1 for equal fingerprints."""
    gap = (a - b).astype(np.float64)  # wraps as the lanes do
    x, y = a.astype(np.float64), b.astype(np.float64)
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    out = 1 - (gap * gap).sum(axis=1) / np.where(both > 0, both, 1)
    return np.where(same, 1.0, np.where(both > 0, np.clip(out, 0, 1), 0.0))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the next text's first
    as many."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


_RESULT = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double")


def described(ids: list, texts: list[str], following: list[str], last_next: tuple) -> pa.RecordBatch:
    """Result rows of documents in order, each with the text that follows it
    (the next row's); ``last_next``: the dense and signed lanes of the one that
    follows the last."""
    dense, lanes = _own(texts)
    changed, doc, sign, digests = [], [], [], []
    for k, (text, after) in enumerate(zip(texts, following)):
        new = edited(text, after)
        digests.append(hashlib.sha256(new.encode()).digest())
        cut = text[:len(text) - len(text) // 4]
        kept = cut.count("\n")  # paragraphs that end before the cut
        for s, parts in ((-1, paragraphs_of(text)[kept:]), (1, paragraphs_of(new)[kept:])):
            changed += parts
            doc += [k] * len(parts)
            sign += [s] * len(parts)
    d, w = vectors(changed, np.array(doc, np.int64), np.array(sign, np.int64), len(texts))
    d, w = dense + d, lanes + w
    nd, nw = np.concatenate([dense[1:], last_next[0]]), np.concatenate([lanes[1:], last_next[1]])
    pairs = [likeness(lanes, y, (dense == x).all(axis=1) & (lanes == y).all(axis=1)) for x, y in ((d, w), (nd, nw))]
    columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests),
               pa.array(_bytes(dense, lanes)), pa.array(_bytes(d, w)), *map(pa.array, pairs)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])


def _blocks(batches, id_at: int, text_at: int):
    """(ids, texts) of about SLICE_BYTES of text, in order."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(id_at).to_pylist(), batch.column(text_at)):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _edge(part: int, leads: bool, i, text: str) -> pa.RecordBatch:
    columns = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(),
                                        pa.float64())]
    columns[0] = pa.array([i], pa.int64())
    columns += [pa.array([part], pa.int32()), pa.array([leads]), pa.array([text], pa.string())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in (_RESULT + _EDGE).split(", ")])


_EDGE = ", part int, leads boolean, text string"


def _in_order(batches):
    """Results of a sorted partition's rows but the last, and its two edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = None
    for ids, texts in _blocks(batches, 0, 1):
        if held is None:
            yield _edge(part, True, ids[0], texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids[-1], texts[-1]
        if len(ids) > 1:
            out = described(ids[:-1], texts[:-1], texts[1:], _own(texts[-1:]))
            n = out.num_rows
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())],
                [*out.schema.names, "part", "leads", "text"])
    if held is not None:
        yield _edge(part, False, *held)


def _pairs(batches):
    """Results of (doc_id, text, following) rows."""
    for batch in batches:
        for i, t, after in zip(*(batch.column(k).to_pylist() for k in range(3))):
            yield described([i], [t], [after], _own([after]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    text = text_or_empty(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"),
                       F.monotonically_increasing_id().alias("k"))  # splits many equal rows between tasks
    order = [F.asc_nulls_first("doc_id"), F.col("h"), F.col("k")]
    ordered = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    out = staged(ordered.mapInArrow(_in_order, _RESULT + _EDGE), "fingerprints")
    names = [c.split()[0] for c in _RESULT.split(", ")]
    parts = [r["part"] for r in out.where("leads").select("part").orderBy("part").collect()]  # a number a partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    ends = out.where(~F.col("leads")).select("part", "doc_id", "text").join(after, "part")
    starts = out.where("leads").select(F.col("part").alias("next"), F.col("text").alias("following"))
    seams = ends.join(starts, "next").select("doc_id", "text", "following").mapInArrow(_pairs, _RESULT)
    hexed = lambda c: F.lower(F.hex(c)).alias(c) if c in ("edited_sha256", "fingerprint", "edited_fingerprint") else c
    return out.where("part is null").select(*names).unionByName(seams).select(*map(hexed, names))
