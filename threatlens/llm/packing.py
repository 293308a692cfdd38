"""Best-fit packing of token documents into fixed-length sequences.

Documents become pieces of at most ``capacity`` tokens (only longer documents
are cut; their first piece may be shorter, all others are full).  Pieces are
dealt at random to shards of bounded size.  Within a shard, best-fit
decreasing gives a first packing and a swap-based local search empties
underfull bins: pieces of the emptiest bin move into, or are exchanged
one-for-one or two-for-one with pieces of, fuller bins, and where that fails
other bins exchange pieces, each step raising the sum of squared fills, until
the bin is empty.  Bins that stay underfull are
opened again and their pieces dealt to as many shards as their number asks for,
never more than before.  That ends with a round of one shard, or with the first
that leaves as many bins as it opened (pieces over half the capacity, say),
whose pieces stay as the round before packed them.  So no shard outgrows its
bound, however many bins stay open.

Cases: a null or empty text is a document of its end id alone.  Repeated rows
are packed each on their own.  An empty table gives no rows.  Only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import vocabulary, worker_encoder
from .common import row_slices, staged, text_buffer, text_or_empty

CAPACITY = 2048
#: Pieces that a shard holds on average.
SHARD_PIECES = 16_384
#: A round opens the bins filled less than this.
OPEN_BELOW = 0.97
#: Bins that the search fails to empty, one after the other, before it ends.
PATIENCE = 64
#: Exchanges between other bins that are tried to make room for one bin.
EXCHANGES = 16
#: Open bins that a shard gets at least, if there are as many.
FAN_IN = 32
#: Rounds that a ``sequence_id`` has room for.
ROUNDS = 127

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, vocab: str = "byte_bpe_50k.json", capacity: int = CAPACITY,
                     end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Rows of ``PIECES``, with ``ids`` (binary, little-endian unsigned 32-bit)
    if ``keep_ids``.  ``vocab`` is the name of a public vocabulary file or a
    path that holds on every executor."""
    schema = PIECES + (", ids binary" if keep_ids else "")

    def cut(batches):
        enc = worker_encoder(vocab if "/" in vocab else vocabulary(vocab))
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            doc_ids = batch.column(0)
            for lo, hi in row_slices(off):
                o = off[lo:hi + 1]
                ids, tok = enc.encode(data[o[0]:o[-1]], o - o[0], end_id)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                n = np.diff(tok)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (n - 1) % capacity + 1
                start = np.where(k == 0, 0, first[doc] + (k - 1) * capacity)
                length = np.where(k == 0, first[doc], capacity)
                a = (tok[doc] + start) * 4
                b = a + length * 4
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(a.tolist(), b.tolist())]
                cols = [doc_ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(k, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array([bytes(raw[i:j]) for i, j in zip(a.tolist(), b.tolist())], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return rows.mapInArrow(cut, schema)


class Bins:
    """Bins of one shard: the lengths of their items and what is left of each."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.length, self.capacity = lengths, capacity
        self.bin = np.full(len(lengths), -1, np.int64)
        self.left: list[int] = []

    def best_fit_decreasing(self) -> None:
        """Longest first, each into the fullest bin that has room for it."""
        open_bins: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0  # bit r: a bin with r left is open
        for i in np.argsort(-self.length, kind="stable").tolist():
            n = int(self.length[i])
            fits = mask >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                b = open_bins[r].pop()
                if not open_bins[r]:
                    mask ^= 1 << r
            else:
                r, b = self.capacity, len(self.left)
                self.left.append(0)
            self.bin[i] = b
            self.left[b] = r = r - n
            if r:
                open_bins[r].append(b)
                mask |= 1 << r

    def local_search(self) -> None:
        """Empty the underfull bins, the emptiest first, as long as others have
        room for what it holds.  ``PATIENCE`` bins in a row that could not be
        emptied end the search; what they hold stays packed."""
        left = np.array(self.left, np.int64)
        items = np.flatnonzero(left[self.bin] > 0)
        tried = np.zeros(len(left), bool)
        failed = 0
        while failed < PATIENCE:
            fill = np.where(left > 0, self.capacity - left, 0)
            under = np.flatnonzero((fill > 0) & ~tried)
            if not len(under):
                break
            donor = under[np.argmin(fill[under])]
            tried[donor] = True
            if left[left < self.capacity].sum() - left[donor] < fill[donor]:
                break  # no room for its tokens, however they are exchanged
            emptied = self._drain(donor, left, items)
            for _ in range(EXCHANGES):
                if emptied or not self._exchange(donor, left, items):
                    break
                emptied = self._drain(donor, left, items)
            failed = 0 if emptied else failed + 1
            items = items[left[self.bin[items]] > 0]
        self.left = left.tolist()

    def _exchange(self, donor: int, left: np.ndarray, items: np.ndarray) -> bool:
        """Exchange one item for one between two other bins, the exchange that
        moves most tokens into a bin that is then the fuller one."""
        others = items[(self.bin[items] != donor) & (left[self.bin[items]] > 0)]
        if len(others) < 2:
            return False
        others = others[np.argsort(self.length[others], kind="stable")]
        size, bin_ = self.length[others], self.bin[others]
        room = left[bin_]
        k = np.searchsorted(size, size + room, side="right") - 1  # the longest that fits in an item's place
        gain = size[k] - size
        fill = self.capacity - room
        gain = np.where((bin_[k] != bin_) & (fill + gain > fill[k]), gain, 0)
        a = int(np.argmax(gain))
        if not gain[a]:
            return False
        b = int(k[a])
        left[bin_[a]] -= gain[a]
        left[bin_[b]] += gain[a]
        self.bin[others[a]], self.bin[others[b]] = bin_[b], bin_[a]
        return True

    def _drain(self, donor: int, left: np.ndarray, items: np.ndarray) -> bool:
        """Move or exchange items of the donor until it is empty.  Every step
        takes tokens from the emptiest bin to a fuller one, so the sum of
        squared fills rises and the loop ends."""
        others = items[self.bin[items] != donor]
        while True:
            mine = items[self.bin[items] == donor]
            if not len(mine):
                left[donor] = self.capacity
                return True
            if not len(others):
                return False
            other_bin, other_len = self.bin[others], self.length[others]
            room = left[other_bin]
            best = (0, None)  # tokens that leave the donor, how
            for i in mine[np.argsort(-self.length[mine])].tolist():
                n = int(self.length[i])
                k = int(np.argmin(np.where(room >= n, room, self.capacity + 1)))
                if room[k] >= n and n > best[0]:  # move into the best fit
                    best = (n, ("move", i, other_bin[k]))
                gain = np.where((other_len < n) & (n - other_len <= room), n - other_len, 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:  # one for one
                    best = (int(gain[k]), ("swap", i, others[k]))
            if 1 < len(mine) <= 12:  # two of the donor's for one; a bin of many short items drains by moves
                i, j = np.triu_indices(len(mine), 1)
                for a, b in zip(mine[i].tolist(), mine[j].tolist()):
                    n = int(self.length[a] + self.length[b])
                    gain = np.where((other_len < n) & (n - other_len <= room), n - other_len, 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (int(gain[k]), ("two", (a, b), others[k]))
            gain, step = best
            if step is None:
                return False
            kind, i, to = step
            if kind == "move":
                target, moved = int(to), [i]
            else:
                target, moved = int(self.bin[to]), [i] if kind == "swap" else list(i)
                self.bin[to] = donor
            self.bin[moved] = target
            left[target] -= gain
            left[donor] += gain
            if kind != "move":
                others = items[self.bin[items] != donor]
            else:
                others = np.append(others, i)
            others = others[left[self.bin[others]] > 0]


def pack_shard(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, and the fill of its bin."""
    bins = Bins(np.asarray(lengths, np.int64), capacity)
    bins.best_fit_decreasing()
    bins.local_search()
    order = np.argsort(bins.bin, kind="stable")
    b, n = bins.bin[order], bins.length[order]
    ends = np.cumsum(n)
    head = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
    base = (ends - n)[head]
    place = np.empty(len(b), np.int64)
    place[order] = ends - n - base[np.cumsum(head) - 1] if len(b) else 0
    fill = np.bincount(bins.bin, weights=bins.length).astype(np.int64) if len(b) else np.zeros(0, np.int64)
    return bins.bin, place, fill[bins.bin]


def packed(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (with ``length``) plus ``sequence_id`` and ``offset``."""
    names = pieces.columns
    todo = staged(pieces, "pieces")
    shards = max(1, -(-todo.count() // shard_pieces))
    if shards == 1:
        return _packed_round(todo, names, capacity, 1, 0).select(*names, "sequence_id", "offset")
    done, opened = None, None
    for level in range(ROUNDS):
        out = staged(_packed_round(todo.select(*names), names, capacity, shards, level), f"packed-{level}")
        if opened is not None and _sizes(out)[1] >= opened:
            break  # todo stays as it was packed
        under = F.col("_fill") < int(OPEN_BELOW * capacity)
        closed, todo = out.where(~under), out.where(under)
        done = closed if done is None else done.unionByName(closed)
        left, opened = _sizes(todo)
        if shards == 1 or not left:
            break
        shards = min(shards, -(-left // shard_pieces), -(-opened // FAN_IN))
    return done.unionByName(todo).select(*names, "sequence_id", "offset")


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Number of pieces and of bins."""
    bins = rows.groupBy("sequence_id").count().agg(F.sum("count"), F.count("*")).first()
    return bins[0] or 0, bins[1]


def _packed_round(todo: DataFrame, names: list[str], capacity: int, shards: int, level: int) -> DataFrame:
    def pack(key, pdf):
        bin_, place, fill = pack_shard(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = (level << 56) + (int(key[0]) << 28) + bin_
        pdf["offset"], pdf["_fill"] = place, fill
        return pdf.drop(columns="_shard")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.select(*names).schema.fields)
    # A row's place in the written table deals it out, whatever it holds.
    dealt = todo.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("_shard"))
    return dealt.groupBy("_shard").applyInPandas(pack, schema + ", sequence_id long, offset long, _fill long")


def pack_documents(docs: DataFrame, vocab: str = "byte_bpe_50k.json", capacity: int = CAPACITY,
                   end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return packed(tokenized_pieces(docs, vocab, capacity, end_id, keep_ids), capacity)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence from packed pieces with ids: ``sequence_id``,
    ``length`` and ``ids`` (the pieces' ids in their order)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (pieces.groupBy("sequence_id")
            .agg(F.sum("length").alias("length"), ordered.alias("_p"))
            .select("sequence_id", "length",
                    F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids")))
