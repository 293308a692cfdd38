"""Token-id files compressed by a Re-Pair grammar, with random access.

Documents are put in ascending doc_id order by a range exchange, encoded, and
gathered into shards of about ``SHARD_TOKENS`` ids in that order (one longer
document is a shard of its own).  Within a shard, frequent pairs of neighbouring
symbols are replaced by nonterminals, round after round; a round replaces many
pairs at once, the more frequent first where two overlap, and no pair spans two
documents.  Rules refer to earlier symbols only and carry the length of their
expansion, so a document, or the id at any place, is decoded from its own
symbols without the rest of the shard.

File image of a shard (little-endian), held in the binary column ``image`` of a
Parquet table, one row a shard: the header ``HEADER`` (magic, symbol width in
bytes, documents, rules, symbols, first nonterminal, ids, documents without a
doc_id, which come first); doc_ids (int64);
symbols before each document and in all (uint64); ids before each document and
in all (uint64); the rules' pairs (2 x uint32); their expansion lengths
(uint32); the symbols (uint16 or uint32).

Cases: a null or empty text is its end id alone.  Rows that repeat a doc_id
follow each other, ordered by a hash of their text.  An empty table gives no
shard.  Only ``doc_id`` and ``text`` are read.  Null doc_ids come first and come
back as null.

A shard's grammar is finished when no pair occurs ``LEAST_COUNT`` times, when the
rules are used up, after ``ROUNDS`` rounds, or after a round that saves less than
a hundredth; that bounds the work, and costs compression only.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .bytebpe import vocabulary, worker_encoder
from .common import concat_ranges, parallelism, row_slices, text_buffer, text_or_empty

SHARD_TOKENS = 1 << 20
#: A pair is replaced if it occurs this often in the shard.
LEAST_COUNT = 8
#: Pairs replaced in a round, and rounds at most; a round that saves less than
#: a hundredth of the symbols is the last.
ROUND_PAIRS = 4096
ROUNDS = 8
HEADER = "<4sIQQQQQQ"
MAGIC = b"RPG2"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Slots by which a round finds its pairs, and the factor that deals them.
_SLOT_BITS, _MIX = 18, np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """Symbols of a shard and the rules that expand them."""

    def __init__(self, seq: np.ndarray, doc: np.ndarray, first: int, pairs: np.ndarray, lengths: np.ndarray):
        self.seq, self.doc, self.first, self.pairs, self.lengths = seq, doc, first, pairs, lengths

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions in a row, and where each begins: rules of ids
        alone first, then those whose symbols are spelt out by then."""
        begin = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        out = np.zeros(int(begin[-1]), np.uint32)
        sides = self.pairs.astype(np.int64)
        rule = sides >= self.first
        of = np.where(rule, sides - self.first, 0)
        size = np.where(rule, self.lengths[of], 1).astype(np.int64)
        to = np.stack([begin[:-1], begin[:-1] + size[:, 0]], 1)
        out[to[~rule]] = sides[~rule]
        done = ~rule.any(axis=1)
        left = np.flatnonzero(~done)
        while len(left):
            k = left[(done[of[left]] | ~rule[left]).all(axis=1)]
            r = rule[k]
            out[concat_ranges(to[k][r], size[k][r])] = out[concat_ranges(begin[of[k][r]], size[k][r])]
            done[k] = True
            left = left[~done[left]]
        return out, begin

    def expand(self, seq: np.ndarray, pool=None) -> np.ndarray:
        """Ids of some of its symbols."""
        flat, begin = pool or self.expansions()
        seq = seq.astype(np.int64)
        rule = seq >= self.first
        k = np.where(rule, seq - self.first, 0)
        count = np.where(rule, self.lengths[k] if len(self.lengths) else 1, 1)
        # Ids that stand for themselves are read behind the expansions.
        source = np.concatenate([flat, seq[~rule].astype(np.uint32)])
        start = np.where(rule, begin[k], 0)
        start[~rule] = len(flat) + np.arange(int((~rule).sum()))
        return source[concat_ranges(start, count)]


def _ranks(key: np.ndarray, chosen: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rank of each key among ``chosen`` (in order), 0 if it isn't there: a
    look at its slot, and a search where the slot holds another key's."""
    slot, shift = np.zeros(1 << _SLOT_BITS, np.int32), np.uint64(64 - _SLOT_BITS)
    slot[(chosen * _MIX >> shift).view(np.int64)] = rank
    value = np.empty(len(chosen) + 1, np.uint64)
    value[rank] = chosen
    at = key * _MIX
    at >>= shift
    out = slot[at.view(np.int64)]
    some = np.flatnonzero(out)
    other = some[value[out[some]] != key[some]]
    at = np.minimum(np.searchsorted(chosen, key[other]), len(chosen) - 1)
    out[other] = np.where(chosen[at] == key[other], rank[at], 0)
    return out


def replace_pairs(ids: np.ndarray, doc: np.ndarray, first: int, most_rules: int) -> Grammar:
    """Re-Pair over ids whose documents begin at ``doc`` (and end at its last)."""
    seq, doc = ids.astype(np.uint64), doc.astype(np.int64)
    pairs, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    shift, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    for _ in range(ROUNDS):
        room = most_rules - len(pairs)
        if len(seq) < 2 or not room:
            break
        key = seq[:-1] << shift | seq[1:]
        last = doc[1:] - 1
        key[last[(last >= 0) & (last < len(key))]] = _NONE
        order = np.sort(key)
        head = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
        count = np.diff(head, append=len(order))
        value = order[head]
        good = np.flatnonzero((count >= LEAST_COUNT) & (value != _NONE))
        if not len(good):
            break
        good = good[np.argsort(-count[good], kind="stable")[:min(room, ROUND_PAIRS)]]
        good = good[np.argsort(value[good])]
        chosen = value[good]
        rank = np.empty(len(good), np.int32)
        rank[np.argsort(count[good], kind="stable")] = np.arange(1, len(good) + 1)
        place = np.zeros(len(seq) + 1, np.int32)  # rank of the pair that begins here, from 1 on
        place[1:-1] = _ranks(key, chosen, rank)
        here, before, after = place[1:], place[:-1], np.append(place[2:], 0)
        take = np.flatnonzero((here > 0) & (here >= before) & (here >= after))
        # In a run of one symbol its pairs overlap: every other one is taken.
        begins = np.r_[True, (take[1:] != take[:-1] + 1) | (here[take[1:]] != here[take[:-1]])] if len(take) else take
        first_of = np.maximum.accumulate(np.where(begins, np.arange(len(take)), 0)) if len(take) else take
        take = take[(np.arange(len(take)) - first_of) % 2 == 0]
        number = np.empty(len(good) + 1, np.int64)
        number[rank] = np.arange(len(good))
        which = number[here[take]]
        uses = np.bincount(which, minlength=len(good))
        worth = uses >= LEAST_COUNT // 2
        if not worth.any():
            break
        new = np.cumsum(worth) - 1 + first + len(pairs)
        keep_take = worth[which]
        take, which = take[keep_take], which[keep_take]
        a, b = (chosen[worth] >> shift).astype(np.int64), (chosen[worth] & low).astype(np.int64)
        length = np.concatenate([np.ones(1, np.int64), lengths])
        long = length[np.maximum(a - first + 1, 0)] + length[np.maximum(b - first + 1, 0)]
        pairs = np.concatenate([pairs, np.stack([a, b], 1).astype(np.uint32)])
        lengths = np.concatenate([lengths, long])
        size = len(seq)
        seq[take] = new[which].astype(np.uint64)
        keep = np.ones(size, bool)
        keep[take + 1] = False
        seq = seq[keep]
        doc = np.concatenate([[0], np.cumsum(keep)])[doc]
        if size - len(seq) < size // 100:
            break
    return Grammar(seq, doc, first, pairs, lengths.astype(np.uint32))


def pack_shard(doc_ids: np.ndarray, ids: np.ndarray, tok: np.ndarray, vocab_size: int, nameless: int = 0) -> bytes:
    """File image of a shard, whose first ``nameless`` documents have no doc_id."""
    narrow = vocab_size < 1 << 16
    g = replace_pairs(ids, tok, vocab_size, (1 << 16) - vocab_size if narrow else 1 << 20)
    width = 2 if narrow else 4
    return b"".join([
        struct.pack(HEADER, MAGIC, width, len(doc_ids), len(g.pairs), len(g.seq), vocab_size, len(ids),
                    nameless), doc_ids.astype("<i8").tobytes(), g.doc.astype("<u8").tobytes(), tok.astype("<u8").tobytes(),
        g.pairs.astype("<u4").tobytes(), g.lengths.astype("<u4").tobytes(), g.seq.astype(f"<u{width}").tobytes()])


class Shard:
    """Reader of a file image."""

    def __init__(self, image):
        magic, width, docs, rules, symbols, first, self.n_ids, self.nameless = struct.unpack_from(HEADER, image)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(HEADER)

        def part(kind, n):
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids = part("<i8", docs)
        doc, self.tok = part("<u8", docs + 1).astype(np.int64), part("<u8", docs + 1).astype(np.int64)
        pairs, lengths = part("<u4", 2 * rules).reshape(-1, 2), part("<u4", rules)
        self.grammar = Grammar(part(f"<u{width}", symbols), doc, first, pairs, lengths.astype(np.int64))
        self._pool = None

    def _expansions(self):
        if self._pool is None:
            self._pool = self.grammar.expansions()
        return self._pool

    def document(self, k: int) -> np.ndarray:
        """Ids of its k-th document, from that document's symbols."""
        g = self.grammar
        return g.expand(g.seq[g.doc[k]:g.doc[k + 1]], self._expansions())

    def id_at(self, k: int, place: int) -> int:
        """The id at a place in the k-th document: the expansion lengths say
        which symbol holds it, and the rules are followed down to it."""
        g = self.grammar
        seq = g.seq[g.doc[k]:g.doc[k + 1]].astype(np.int64)
        size = lambda s: int(g.lengths[s - g.first]) if s >= g.first else 1
        ends = np.cumsum(np.where(seq >= g.first, g.lengths[np.maximum(seq - g.first, 0)], 1)
                         if len(g.lengths) else np.ones(len(seq), np.int64))
        j = int(np.searchsorted(ends, place, side="right"))
        s, place = int(seq[j]), place - (int(ends[j - 1]) if j else 0)
        while s >= g.first:
            a, b = (int(x) for x in g.pairs[s - g.first])
            s, place = (a, place) if place < size(a) else (b, place - size(a))
        return s

    def ids(self) -> np.ndarray:
        return self.grammar.expand(self.grammar.seq, self._expansions())


def write_shards(docs: DataFrame, path: str, vocab: str = "byte_bpe_50k.json", vocab_size: int = 50_257,
                 end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all documents and write their shards to ``path``, with columns
    part and seq (the shards' order), n_tokens and image."""
    parts = parallelism(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc = worker_encoder(vocab if "/" in vocab else vocabulary(vocab))
        held, size = [], 0

        def close():
            doc_ids = np.concatenate([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            tok = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
            image = pack_shard(doc_ids, ids, tok, vocab_size, sum(h[3] for h in held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([image], pa.binary())], ["part", "seq", "n_tokens", "image"])

        for batch in batches:
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            data, off = text_buffer(batch.column(1))
            for lo, hi in row_slices(off):
                o = off[lo:hi + 1]
                ids, tok = enc.encode(data[o[0]:o[-1]], o - o[0], end_id)
                while lo < hi:  # documents that still fit, one at least
                    fit = int(np.searchsorted(tok, tok[0] + shard_tokens - size, side="right")) - 1
                    fit = min(max(fit, 0 if held else 1), hi - lo)
                    if fit:
                        held.append((doc_ids[lo:lo + fit], ids[tok[0]:tok[fit]], tok[:fit + 1] - tok[0],
                                     int((~named[lo:lo + fit]).sum())))
                        size += int(tok[fit] - tok[0])
                        lo, tok = lo + fit, tok[fit:]
                    if lo < hi:
                        yield close()
                        held, size, seq = [], 0, seq + 1
        if held:
            yield close()

    text = text_or_empty(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    order = [F.asc_nulls_first("doc_id"), F.col("h")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    (rows.mapInArrow(run, "part int, seq int, n_tokens long, image binary")
     .write.mode("errorifexists").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false")
     .parquet(path))


def read_shards(spark, path: str) -> DataFrame:
    """Rows of the written shards."""
    return spark.read.parquet(path)


def documents_of(shards: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and
    ids, little-endian, if ``keep_ids``) of every document, from the images."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(2)[row].as_buffer())
                raw = memoryview(shard.ids().astype("<u4", copy=False)).cast("B")
                tok = shard.tok.tolist()
                chunks = [raw[4 * i:4 * j] for i, j in zip(tok[:-1], tok[1:])]
                n = len(chunks)
                cols = [pa.array(np.full(n, batch.column(k)[row].as_py(), np.int32)) for k in range(2)]
                cols += [pa.array(shard.doc_ids.astype(np.int64), mask=np.arange(n) < shard.nameless), pa.array(shard.tok[:-1]),
                         pa.array(np.diff(shard.tok)), pa.array([zlib.crc32(c) for c in chunks], pa.int64())]
                if keep_ids:
                    cols.append(pa.array([bytes(c) for c in chunks], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    schema = "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    rows = shards.select("part", "seq", "image").mapInArrow(run, schema)
    # One row a partition of the write, then one a shard within its partition.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        F.col("part"), (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_part_start"))
    begins = (shards.select("part", "seq", "n_tokens").withColumn(
        "_seq_start", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
        .join(parts, "part").select("part", "seq", (F.col("_part_start") + F.col("_seq_start")).alias("_start")))
    return rows.join(begins, ["part", "seq"]).select(
        "doc_id", (F.col("_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if keep_ids else []))


def stored_documents(docs: DataFrame, **kw) -> DataFrame:
    """Write all documents' ids under the shared checkpoint folder and return
    what is read back from the files."""
    import uuid

    path = scratch_path(docs.sparkSession, f"llm-token-shards-{uuid.uuid4().hex[:12]}")
    write_shards(docs, path, **kw)
    return documents_of(read_shards(docs.sparkSession, path))
