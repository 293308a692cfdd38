"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy.

A text's words (runs of letters, lower-cased) contribute their character
n-grams with word ends marked; each n-gram hashes to a row of an embedding
matrix, a text is the average of its rows, and a linear layer with softmax
gives the languages.  Since the average is linear, prediction folds the layer
into the embeddings: a worker keeps the summed scores of the words it has seen
(exact bytes as keys, bounded) and adds them up over whole texts.

Calibration on a part of the training sample that the gradient never saw: a
temperature for the probabilities and, from the probabilities of its correctly
recognised texts, the rejection thresholds: one for each power of two of words,
from stretches of these texts, as short texts score less.  With under
``FEW_TEXTS`` labelled texts each is scored by a model of the other folds.  A
text is rejected below the threshold of its length, or if it has no letter.

The training rows are a bounded sample (``TRAIN_DOCS`` documents with the
smallest hashes of their ids); everything else covers all data.

Cases: null texts and texts without a letter are ``und`` with score 0 and
rejected.  Repeated rows are predicted alike.  With no labelled row every text
is ``und``.  Only ``doc_id``, ``text`` and, to train, ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import WordTable, mixed, word_keys
from .common import concat_ranges, row_slices, text_buffer, text_or_empty

#: Bound of the training sample, in documents.
TRAIN_DOCS = 3000
#: Words that a training text contributes at most to one step of the descent
#: (a contiguous stretch at a random place; its other words serve other steps).
STEP_WORDS = 64
BUCKETS = 1 << 16
DIM = 16
NGRAMS = (1, 2, 3, 4)
#: Stretches of text that the descent sees in all, in whole rounds over the sample.
DRAWS = 9000
BATCH = 16
RATE = 0.5
#: Share of correctly recognised texts that the threshold may reject.
REJECT_SHARE = 0.001
#: Under so many labelled texts, folds calibrate instead of every fifth text.
FEW_TEXTS = 20
FOLDS = 5
#: Powers of two of words with a threshold of their own; longer texts have the last.
LENGTHS = 10
#: Rounding between the sums of the calibration and those of the workers.
ROUNDING = 1e-5
#: What a worker keeps of summed word scores.
TABLE_WORDS = 300_000


def held_out(doc_id):
    """crc32(doc_id as text) mod 3 is 1; rows without a doc_id are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def letters_table() -> np.ndarray:
    """For each code point of the basic plane: its lower-case form if it is a
    letter (itself if that is no single character), else 0.  Characters beyond
    count as letters if Unicode says so; they are asked for one by one."""
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS: list[np.ndarray] = []


def split_words(data: np.ndarray, off: np.ndarray):
    """Lower-cased letters of all texts with a zero after each word, the words'
    starts and lengths in it and the row of each word."""
    if not _LETTERS:
        _LETTERS.append(letters_table())
    table = _LETTERS[0]
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    rows = lead[off]  # of code points
    low = table[np.minimum(cp, 0xFFFF)]
    for k in np.flatnonzero(cp > 0xFFFF):
        c = chr(cp[k])
        low[k] = ord(c.lower()[0]) if c.isalpha() else 0
    low[cp == 0xFFFF] = 0
    is_letter = low > 0
    prev = np.concatenate([[False], is_letter[:-1]]) if len(low) else is_letter
    first = rows[:-1][rows[:-1] < len(low)]
    prev[first] = False
    starts = np.flatnonzero(is_letter & ~prev)
    stop = is_letter.copy()
    nxt = np.concatenate([is_letter[1:], [False]]) if len(low) else is_letter
    last = rows[1:] - 1
    nxt[last[last >= 0]] = False
    ends = np.flatnonzero(stop & ~nxt) + 1
    row = np.searchsorted(rows, starts, side="right") - 1
    return low, starts, ends - starts, row


def _split_in_slices(data: np.ndarray, off: np.ndarray):
    """``split_words`` of many texts, a bounded slice at a time."""
    parts, begin = [], 0
    for lo, hi in row_slices(off):
        low, starts, lens, row = split_words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        parts.append((low, starts + begin, lens, row + lo))
        begin += len(low)
    if not parts:
        return split_words(data, off)
    return tuple(np.concatenate(x) for x in zip(*parts))


def word_grams(low: np.ndarray, starts: np.ndarray, lens: np.ndarray, buckets: int = BUCKETS):
    """Buckets of the n-grams of ``<word>`` and how many each word has."""
    size = lens + 2
    total = int(size.sum())
    at = np.cumsum(size) - size
    text = np.full(total + max(NGRAMS), ord(">"), np.uint64)
    if len(lens):
        inner = np.repeat(starts - at - 1, size) + np.arange(total)
        text[:total] = low[np.clip(inner, 0, len(low) - 1)]
        text[at] = ord("<")
        text[at + size - 1] = ord(">")
    room = np.repeat(at + size, size) - np.arange(total)  # characters from here to the word's end
    out = np.full((total, len(NGRAMS)), -1, np.int64)
    h = np.full(total, 0x811C9DC5, np.uint64)
    col = 0
    for n in range(1, max(NGRAMS) + 1):
        h = (h ^ text[n - 1:n - 1 + total]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        if n in NGRAMS:
            ok = room >= n
            out[ok, col] = ((h[ok] * np.uint64(n * 2 + 1)) >> np.uint64(40)).astype(np.int64) % buckets
            col += 1
    ok = out >= 0
    per_word = np.add.reduceat(ok.sum(axis=1), at) if len(lens) else np.zeros(0, np.int64)
    return out[ok], per_word


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages: embedding times layer
    bias: np.ndarray
    temperature: float
    threshold: np.ndarray  # by the binary logarithm of the number of words


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Model from labelled texts; every fifth text calibrates, or each in folds."""
    languages = tuple(sorted(set(langs)))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, np.ones(1))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in langs])
    low, starts, lens, row = _split_in_slices(*text_buffer(pa.array(texts, pa.string())))
    words = np.searchsorted(row, np.arange(len(texts) + 1))
    some, fold = np.diff(words) > 0, np.arange(len(texts)) % FOLDS
    parsed = (low, starts, lens, words)
    if len(texts) >= FEW_TEXTS:
        model = _descended(languages, parsed, y, np.flatnonzero((fold != 4) & some), rng)
        judged = [(model, np.flatnonzero((fold == 4) & some))]
    else:
        model = _descended(languages, parsed, y, np.flatnonzero(some), rng)
        judged = [(_descended(languages, parsed, y, np.flatnonzero((fold != f) & some), rng),
                   np.flatnonzero((fold == f) & some)) for f in range(FOLDS) if ((fold == f) & some).any()]
    held = np.concatenate([k for _, k in judged]) if judged else np.zeros(0, np.int64)
    if not len(held):
        return model
    true = y[held]

    def scores(most: int) -> np.ndarray:
        """Of a stretch of at most so many words of each held text."""
        return np.concatenate([_stretch_logits(m, parsed, k, most, rng) for m, k in judged])

    z = scores(int(np.diff(words).max()))
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(z / t)[np.arange(len(held)), true] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    chance = 1 / len(languages)

    def right(z):
        p = softmax(z / t)
        return p.max(axis=1)[p.argmax(axis=1) == true]

    # A text of 2^k words or more is held against stretches of 2^k to 2^(k+1).
    of_length = [right(scores(1 << k)) for k in range(LENGTHS)] + [right(z)]
    pools = [np.concatenate(of_length[k:k + 2]) for k in range(LENGTHS)]
    limits = [float(np.quantile(p, REJECT_SHARE, method="lower")) if len(p) else chance for p in pools]
    return Model(languages, model.table, model.bias, t, np.maximum(np.array(limits) - ROUNDING, chance - ROUNDING))


def _stretch_logits(model: Model, parsed, docs: np.ndarray, most: int, rng) -> np.ndarray:
    low, starts, lens, words = parsed
    n = words[docs + 1] - words[docs]
    take = np.minimum(n, most)
    first = words[docs] + (rng.random(len(docs)) * (n - take + 1)).astype(np.int64)
    chosen = concat_ranges(first, take)
    return _logits(model, low, starts[chosen], lens[chosen], np.repeat(np.arange(len(docs)), take), len(docs))


def _descended(languages: tuple[str, ...], parsed, y: np.ndarray, use: np.ndarray, rng) -> Model:
    """Model that the descent over the texts ``use`` gives, not calibrated."""
    low, starts, lens, words = parsed
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    epochs = -(-DRAWS // max(1, len(use)))
    steps = max(1, epochs * -(-len(use) // BATCH))
    step = 0
    for _ in range(epochs if len(use) else 0):
        order = rng.permutation(use)
        for lo in range(0, len(order), BATCH):
            docs = order[lo:lo + BATCH]
            n = words[docs + 1] - words[docs]
            take = np.minimum(n, STEP_WORDS)
            first = words[docs] + (rng.random(len(docs)) * (n - take + 1)).astype(np.int64)
            chosen = np.repeat(first - (np.cumsum(take) - take), take) + np.arange(take.sum())
            grams, per = word_grams(low, starts[chosen], lens[chosen])
            doc = np.repeat(np.repeat(np.arange(len(docs)), take), per)
            count = np.bincount(doc, minlength=len(docs)).astype(np.float32)
            mean = np.zeros((len(docs), DIM), np.float32)
            np.add.at(mean, doc, emb[grams])
            mean /= count[:, None]
            p = softmax(mean @ layer + bias)
            p[np.arange(len(docs)), y[docs]] -= 1
            rate = RATE * (1 - step / steps)
            back = (p @ layer.T) / count[:, None]
            layer -= rate * mean.T @ p / len(docs) * 8
            bias -= rate * p.mean(axis=0)
            np.add.at(emb, grams, -rate * back[doc] * 8)
            step += 1
    return Model(languages, (emb @ layer).astype(np.float32), bias, 1.0, np.zeros(1))


def _word_scores(model: Model, low, starts, lens) -> tuple[np.ndarray, np.ndarray]:
    grams, per = word_grams(low, starts, lens)
    out = np.zeros((len(starts), len(model.languages)))
    if len(starts):
        out[:] = np.add.reduceat(model.table[grams].astype(np.float64), np.cumsum(per) - per, axis=0)
    return out, per


def _logits(model: Model, low, starts, lens, row, n_rows: int) -> np.ndarray:
    out, grams = np.zeros((n_rows, len(model.languages))), np.zeros(n_rows)
    for lo in range(0, len(starts), 1 << 17):
        part = slice(lo, lo + (1 << 17))
        s, per = _word_scores(model, low, starts[part], lens[part])
        np.add.at(out, row[part], s)
        grams += np.bincount(row[part], weights=per, minlength=n_rows)
    return out / np.maximum(grams, 1)[:, None] + model.bias


class Predictor:
    """A worker's model with the summed scores of the words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.words = WordTable(TABLE_WORDS)
        self.score = np.zeros((TABLE_WORDS, len(model.languages)), np.float32)
        self.grams = np.zeros(TABLE_WORDS, np.int32)

    def logits(self, data: np.ndarray, off: np.ndarray):
        """Scores of each row and whether it has a letter; ``n_words``: of each row."""
        n = len(off) - 1
        low, starts, lens, row = split_words(data, off)
        out = np.zeros((n, len(self.model.languages)))
        grams = np.zeros(n)
        # Words of up to five letters below U+10000 or eleven below U+0100 are looked up.
        wide = low.astype("<u2")
        raw = np.zeros(2 * len(low) + 64, np.uint8)
        raw[:2 * len(low)] = wide.view(np.uint8)
        high = np.concatenate([[0], np.cumsum(low > 0xFFFF)])
        short = (lens <= 11) & (high[starts + lens] == high[starts])
        at = np.flatnonzero(short)
        keys = word_keys(raw, 2 * starts[at], 2 * lens[at])
        h = mixed(keys)
        word = self.words.find(keys, h)
        miss = np.flatnonzero(word < 0)
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[first]
            size, room = self.words.size, self.words.limit - self.words.size
            new, kept = new[:room], min(room, len(new))
            s, per = self._scores(low, starts[at[new]], lens[at[new]])
            self.words.add(keys[new], h[new])
            self.score[size:size + kept], self.grams[size:size + kept] = s, per
            word[miss] = self.words.find(keys[miss], h[miss])
        known = word >= 0
        if known.any():
            k = at[known]
            edges = np.searchsorted(row[k], np.arange(n + 1))
            some = np.flatnonzero(np.diff(edges))
            out[some] += np.add.reduceat(self.score[word[known]].astype(np.float64), edges[some], axis=0)
            grams[some] += np.add.reduceat(self.grams[word[known]].astype(np.float64), edges[some])
        rest = np.concatenate([at[~known], np.flatnonzero(~short)])
        for lo in range(0, len(rest), 1 << 17):
            k = rest[lo:lo + (1 << 17)]
            s, per = self._scores(low, starts[k], lens[k])
            np.add.at(out, row[k], s)
            grams += np.bincount(row[k], weights=per, minlength=n)
        self.n_words = np.bincount(row, minlength=n)
        has = self.n_words > 0
        return out / np.maximum(grams, 1)[:, None] + self.model.bias, has

    def _scores(self, low, starts, lens):
        parts = [_word_scores(self.model, low, starts[lo:lo + (1 << 17)], lens[lo:lo + (1 << 17)])
                 for lo in range(0, len(starts), 1 << 17)]
        if not parts:
            return np.zeros((0, len(self.model.languages))), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """Fit on a bounded sample of the rows with a language that aren't held out."""
    rows = (docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
            .select("doc_id", "text", F.col("lang").cast("string").alias("lang")))
    ids = (rows.select("doc_id").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    sample = (rows.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text", "lang").limit(limit))
    sample = sample.select("text", "lang").toPandas()
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def _predictions(model: Model, spark):
    """A function from a string array to lang_pred, score and rejected arrays,
    to be called in Python workers."""
    # A few MB, whatever the data; plain arrays, so that workers need no copy of this package to read it.
    shared = spark.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature, model.threshold))

    def of_worker():
        own = Predictor(Model(*shared.value))
        m = own.model

        def run(texts: pa.Array):
            data, off = text_buffer(texts)
            lang, score, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
            for lo, hi in row_slices(off):
                o = off[lo:hi + 1]
                z, has = own.logits(data[o[0]:o[-1]], o - o[0])
                if not m.languages:
                    best, p, has = np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                else:
                    q = softmax(z / m.temperature)
                    best, p = q.argmax(axis=1), q.max(axis=1)
                lang += [m.languages[b] if x else "und" for b, x in zip(best.tolist(), has.tolist())]
                p = np.where(has, p, 0.0)
                score.append(p)
                k = np.frexp(np.maximum(own.n_words, 1))[1] - 1  # the binary logarithm, rounded down
                rejected.append(~has | (p < m.threshold[np.minimum(k, len(m.threshold) - 1)]))
            return pa.array(lang, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rejected))

        return run

    return of_worker


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""
    of_worker = _predictions(model, docs.sparkSession)

    def run(batches):
        predictions = of_worker()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *predictions(batch.column(1))],
                                             ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty(docs).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't rejected, all their columns.  Only the texts
    go to the Python workers, and a boolean comes back."""
    of_worker = _predictions(model, docs.sparkSession)

    def rejected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictions = of_worker()
        for texts in batches:
            yield predictions(texts)[2]

    return docs.where(~F.arrow_udf(rejected, "boolean")(text_or_empty(docs)))
