"""Quality classifier: histogram gradient-boosted trees over document
statistics.

A document becomes a row of statistics of its whole text (shares of kinds of
characters, lengths of words and lines, repetition).  Features are cut into
quantile bins; each tree grows level by level from per-bin sums of gradients
and Hessians of the logistic loss.  The trees are flattened into arrays of
complete binary trees, and scoring walks all trees for all rows of a batch at
once.  Labels come from a bounded sample (``TRAIN_ROWS`` labelled rows with the
smallest hashes of their ids); every row is scored.

Cases: a null text counts as empty; an empty text has all-zero statistics and
a score like any other.  Rows that repeat a doc_id are scored each on its own.
A doc_id with conflicting labels teaches nothing.  With no label to learn from,
every score is 0.5.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import mixed, word_keys
from .common import row_slices, text_buffer, text_or_empty
from .langid import held_out

#: Bound of the training sample, in labelled documents.
TRAIN_ROWS = 20_000
TREES = 120
DEPTH = 5
BINS = 64
RATE = 0.1
LEAST_HESSIAN = 2.0
SHRINK = 1.0

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
          "space": b" \t\r\x0b\x0c", "newline": b"\n", "stop": b".", "comma": b",;:", "shout": b"!", "ask": b"?",
          "quote": b"\"'`", "bracket": b"()[]{}<>", "symbol": b"#$%&*+/=@\\^_|~", "dash": b"-"}
FEATURES = (["log_bytes", "log_words", "word_len", "word_len_sd", "word_len_max", "short_words", "capital_words",
             "odd_word_ends", "wordless", "distinct_words", "distinct_pairs", "log_lines", "line_len", "distinct_lines",
             "byte_entropy", "upper_of_letters"] + [f"share_{k}" for k in [*_KINDS, "other"]])


def _class_table() -> np.ndarray:
    table = np.full(256, len(_KINDS), np.uint8)
    for k, chars in enumerate(_KINDS.values()):
        table[list(chars)] = k
    return table


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h in each row."""
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])] if len(r) else np.zeros(0, bool)
    return np.bincount(r[new], minlength=n)


def _prefix_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, from running polynomial sums."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(len(data) + 1, odd, np.uint64))
    back = pow(int(odd), -1, 1 << 64)
    inverse = np.cumprod(np.full(len(data) + 1, back, np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    return (total[ends] - total[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of ``FEATURES`` for whole texts in a row."""
    n, kinds = len(off) - 1, len(_KINDS) + 1
    size = np.diff(off)
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    per = np.maximum(size, 1)
    cls = _class_table()[data]
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * kinds + cls, minlength=n * kinds).reshape(n, kinds)
    hist = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256) / per[:, None]
    blank = (cls == 3) | (cls == 4)
    edge = np.zeros(len(data) + 1, bool)
    edge[off[:-1][size > 0]] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.r_[True, blank[:-1]]))
    edge[:] = False
    edge[off[1:]] = True
    ends = np.flatnonzero(~blank & (edge[1:] | np.r_[blank[1:], True])) + 1
    wrow = row[starts]
    words = np.bincount(wrow, minlength=n)
    w = np.maximum(words, 1)
    length = (ends - starts).astype(np.float64)
    padded = np.zeros(len(data) + 32, np.uint8)
    padded[:len(data)] = data
    whole = np.minimum(ends - starts, 23)
    h = mixed(word_keys(padded, starts, whole)) ^ (ends - starts).astype(np.uint64)
    tail = cls[ends - 1]
    letters = np.concatenate([[0], np.cumsum((cls <= 1) | (data >= 0x80))])
    wordless = letters[ends] == letters[starts]
    pair = wrow[1:] == wrow[:-1]
    both = (h[:-1] * np.uint64(3) ^ h[1:])[pair]
    mean = np.bincount(wrow, length, n) / w
    longest = np.zeros(n)
    np.maximum.at(longest, wrow, length)
    line_start = np.unique(np.concatenate([off[:-1][size > 0], np.flatnonzero(data == 10) + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    lrow = row[line_start]
    lines = np.bincount(lrow, minlength=n)
    lh = _prefix_hash(data, line_start, line_end - (data[line_end - 1] == 10))
    cols = [np.log1p(size), np.log1p(words), mean,
            np.sqrt(np.maximum(np.bincount(wrow, length ** 2, n) / w - mean ** 2, 0)), longest,
            np.bincount(wrow, length <= 3, n) / w, np.bincount(wrow, cls[starts] == 0, n) / w,
            np.bincount(wrow, (tail >= 7) & (tail != len(_KINDS)) & (tail != 8), n) / w,
            np.bincount(wrow, wordless, n) / w, _distinct(wrow, h, n) / w,
            _distinct(wrow[1:][pair], both, n) / np.maximum(words - 1, 1), np.log1p(lines),
            size / np.maximum(lines, 1), _distinct(lrow, lh, n) / np.maximum(lines, 1),
            -(hist * np.log2(np.where(hist > 0, hist, 1))).sum(axis=1),
            counts[:, 0] / np.maximum(counts[:, 0] + counts[:, 1], 1)]
    return np.column_stack([*cols, counts / per[:, None]])


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in arrays: node k has children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees, inner = self.feature.shape
        out = np.full(len(x), self.base)
        which = np.arange(trees)
        for lo in range(0, len(x), 2048):
            part = x[lo:lo + 2048]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                right = part[rows, self.feature[which, node]] > self.cut[which, node]
                node = 2 * node + 1 + right
            out[lo:lo + 2048] += self.leaf[which, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for labels 0 and 1."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    n, d = x.shape
    if not n or y.min() == y.max():
        return Forest(feature, cut, leaf, 0.0 if not n else (3.0 if y[0] else -3.0))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(d)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    z = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-z))
        g, hess = y - prob, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best = np.zeros(width)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = node * BINS + binned[:, j]
                sg = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                sh = np.bincount(key, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                rg, rh = sg[:, -1:] - sg, sh[:, -1:] - sh
                gain = sg ** 2 / (sh + SHRINK) + rg ** 2 / (rh + SHRINK) - sg[:, -1:] ** 2 / (sh[:, -1:] + SHRINK)
                gain = np.where((sh >= LEAST_HESSIAN) & (rh >= LEAST_HESSIAN), gain, 0)[:, :len(edges[j])]
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = np.flatnonzero(top > best + 1e-9)
                best[better] = top[better]
                feature[t, first + better], cut[t, first + better] = j, edges[j][k[better]]
            at = first + node
            node = 2 * node + (x[np.arange(n), feature[t, at]] > cut[t, at])
        leaf[t] = RATE * np.bincount(node, g, leaves) / (np.bincount(node, hess, leaves) + SHRINK)
        z += leaf[t, node]
    return Forest(feature, cut, leaf, base)


def _described(rows: DataFrame, schema: str, make) -> DataFrame:
    """``make(features, batch)`` for every batch; the text is column 0."""
    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(0))
            parts = [statistics(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]) for lo, hi in row_slices(off)]
            yield make(np.concatenate(parts) if parts else np.zeros((0, len(FEATURES))), batch)

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> Forest:
    """Fit on a bounded sample of the labelled rows that aren't held out."""
    marks = (labels.where(~held_out("doc_id") & F.col(label).isin(0, 1))
             .groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_top")).where("y = _top")
             .orderBy(F.xxhash64("id"), "id").limit(limit).select("id", "y"))
    rows = docs.select(text_or_empty(docs).alias("text"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.join(F.broadcast(marks), "id").select("text", "id", "y")

    def make(x, batch):
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))],
                                          ["id", "y", "x"])

    sample = (_described(rows, "id long, y int, x array<double>", make)
              .orderBy("id", "x").limit(limit).select("y", "x").toPandas())
    x = np.array(sample["x"].tolist(), np.float64).reshape(len(sample), len(FEATURES))
    return fit(x, sample["y"].to_numpy(np.float64))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((forest.feature, forest.cut, forest.leaf, forest.base))

    def make(x, batch):
        s = Forest(*shared.value).score(x)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                          ["doc_id", "score", "predicted"])

    rows = docs.select(text_or_empty(docs).alias("text"), F.col("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _described(rows, f"doc_id {kind}, score double, predicted int", make)
