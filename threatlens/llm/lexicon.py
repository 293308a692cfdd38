"""BPE with word ends through a minimal acyclic transducer lexicon.

Encoding: normalise, cut into words by the vocabulary's pattern, merge each
word's byte symbols by rank.  The words that the corpus holds most often are
counted over all documents, merged once and compiled into a minimal acyclic
automaton: words share their prefixes and suffixes, and numbers on the arcs add
up to a word's place in the list of id sequences.  The automaton is laid out in
flat arrays (a table of arcs by state and character), written as one file to
the shared folder, fetched once by every executor and memory-mapped by its
workers.  A task walks it for all words of a slice at once, a character a step.
Words that it does not hold are merged exactly, many at a time, by the
vocabulary's ranks (a bounded table keeps the recent ones).

The vectorised path covers characters below U+0180.  Stretches between spaces
with others, and texts with a special token, go to the ``tokenizers`` library,
whose ids they get.

Decoding joins the ids' tokens by spaces, as the library does for a vocabulary
without a decoder.

Cases: null and empty texts have no ids and decode to the empty text.  Repeated
rows are encoded alike.  An empty table gives no rows and an empty lexicon.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .bytebpe import WordTable, byte_alphabet, mixed, vocabulary, word_keys
from .common import concat_ranges, row_slices, staged, text_buffer, text_or_empty

#: Words of the lexicon.
LEXICON_WORDS = 65_536
#: Words that a worker keeps besides.
TABLE_WORDS = 300_000
#: Characters that the vectorised path covers.
PLAIN = 0x180
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: The endings that the pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower-case form of each character below ``PLAIN``."""
    kind, low = np.full(PLAIN + 1, ODD, np.uint8), np.arange(PLAIN + 1, dtype=np.uint32)
    for c in range(PLAIN):
        major = unicodedata.category(chr(c))[0]
        kind[c] = {"L": LETTER, "N": NUMBER}.get(major, OTHER)
        lower = chr(c).lower()
        if len(lower) != 1 or ord(lower) >= PLAIN:
            kind[c] = ODD
        else:
            low[c] = ord(lower)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[[28, 29, 30, 31, 0x85, 0xA0]] = ODD
    return kind, low


def cut_words(cp: np.ndarray, rows: np.ndarray, tables) -> tuple[np.ndarray, ...]:
    """Words of texts given as code points: the lower-cased characters, starts
    and lengths of the plain words, and the stretches left to the library."""
    kind_of, low_of = tables
    n = len(cp)
    small = np.minimum(cp, PLAIN)
    kind, low = kind_of[small], low_of[small]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    # Stretches without white space; those with an odd character are set apart.
    solid = kind != SPACE
    first = np.flatnonzero(solid & (edge[:-1] | np.r_[True, ~solid[:-1]]))
    stop = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    odd_before = np.concatenate([[0], np.cumsum(kind == ODD)])
    odd = odd_before[stop] > odd_before[first]
    apart = np.zeros(n + 1, np.int8)
    apart[first[odd]] += 1
    apart[stop[odd]] -= 1
    plain = solid & (np.cumsum(apart[:-1]) == 0)
    fresh = edge[:-1] | np.r_[True, kind[1:] != kind[:-1]] | (kind == NUMBER)
    start = plain & fresh
    quote = np.flatnonzero(plain & (low == 39) & (edge[:-1] | np.r_[True, kind[:-1] != OTHER]))
    if len(quote):
        tail = np.concatenate([low, np.zeros(4, np.uint32)])
        end_of = np.searchsorted(stop, quote, side="right")
        room = stop[end_of] - quote - 1
        done = np.zeros(len(quote), bool)
        for ending in ENDINGS:
            ok = ~done & (room >= len(ending))
            for k, c in enumerate(ending):
                ok &= tail[quote + 1 + k] == ord(c)
            done |= ok
            at = quote[ok]
            for k in range(len(ending)):
                start[at + 1 + k] = False
            after = at + 1 + len(ending)
            inside = after[room[ok] > len(ending)]
            start[inside] = True
    begin = np.flatnonzero(start)
    border = np.flatnonzero(start | ~plain | edge[:-1])
    nxt = np.append(border, n)[np.searchsorted(border, begin, side="right")]
    return low, begin, nxt - begin, first[odd], stop[odd]


class Merger:
    """Exact merging of byte symbols by rank, for many words at a time."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        alphabet = {b: c for c, b in byte_alphabet().items()}
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[alphabet[b] + "</w>"] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pair = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order
        self.result = np.array([vocab[a + b] for a, b in merges], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.rank[at], 1 << 30)

    def merge(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes, in a row, and how many each has."""
        count = np.zeros(len(starts), np.int64)
        chunks: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(lens, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(lens[order]) > 0])
        for lo, hi in zip(edges, np.append(edges[1:], len(order))):
            size = int(lens[order[lo]])
            for a in range(lo, hi, max(1, (1 << 20) // size)):
                who = order[a:min(hi, a + max(1, (1 << 20) // size))]
                ids, n = self._merge_equal(data[starts[who][:, None] + np.arange(size)])
                count[who] = n
                chunks.append((who, ids))
        out = np.zeros(int(count.sum()), np.uint32)
        place = np.cumsum(count) - count
        for who, ids in chunks:
            out[concat_ranges(place[who], count[who])] = ids
        return out, count

    def _merge_equal(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of equal length, a row each: the pair of least rank, the
        leftmost of equals, is merged until none is left."""
        n, size = chars.shape
        sym = self.inner[chars]
        sym[:, -1] = self.final[chars[:, -1]]
        left = np.full(n, size)
        alive = np.arange(n)
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        done = np.full((n, size), -1, np.int64)
        while len(alive):
            if rank.shape[1] == 0:
                done[alive, :sym.shape[1]] = sym
                break
            at = rank.argmin(axis=1)
            rows = np.arange(len(alive))
            best = rank[rows, at]
            over = best >= 1 << 30
            if over.any():
                done[alive[over], :sym.shape[1]] = sym[over]
                left[alive[over]] = (sym[over] >= 0).sum(axis=1)
                alive, sym, rank, at, best = (x[~over] for x in (alive, sym, rank, at, best))
                rows = np.arange(len(alive))
                if not len(alive):
                    break
            cols = np.arange(sym.shape[1] - 1)
            sym[rows, at] = self.result[best]
            sym = sym[rows[:, None], cols + (cols > at[:, None])]
            cols = cols[:-1]
            rank = rank[rows[:, None], cols + (cols >= at[:, None])]
            if rank.shape[1]:
                for shift in (-1, 0):
                    k = at + shift
                    ok = (k >= 0) & (k < rank.shape[1])
                    rank[rows[ok], k[ok]] = self.ranks(sym[rows[ok], k[ok]], sym[rows[ok], k[ok] + 1])
            left[alive] = sym.shape[1]
        keep = np.arange(size) < left[:, None]
        return done[keep].astype(np.uint32), left


# ---- the automaton ------------------------------------------------------------

def compile_automaton(words: list[str]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words in flat arrays.

    ``key``, ``next``, ``add``, ``final``: an open-addressing table of the
    arcs, with the state and character, the target, the number that the arc
    adds, and whether the target ends a word.  The numbers summed along a word
    give its place in ``words``.
    """
    # States are built for a word's suffix when the next word has left it;
    # equal ones are found by (final, arcs).
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []
    finals: list[bool] = []
    reach: list[int] = []

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            finals.append(key[0])
            reach.append(int(key[0]) + sum(reach[t] for _, t in key[1]))
        return register[key]

    path: list[list] = [[False, []]]  # nodes along the last word: final, arcs
    last = ""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((ord(last[len(path) - 1]), freeze(node)))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((ord(last[len(path) - 1]), freeze(node)))
    root = freeze(path[0])
    rows = []
    for s, own in enumerate(arcs):
        total = int(finals[s])
        for c, t in own:
            rows.append((s * PLAIN + c, t, total, finals[t]))
            total += reach[t]
    key, target, add, final = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
    bits = max(4, int(4 * len(key)).bit_length())
    out = {"key": np.full(1 << bits, -1, np.int64), "next": np.zeros(1 << bits, np.int32),
           "add": np.zeros(1 << bits, np.int32), "final": np.zeros(1 << bits, np.uint8),
           "root": np.array([root, int(finals[root])], np.int32)}
    slot, left = arc_slot(key, bits), np.arange(len(key))
    while len(left):
        at = slot[left]
        free = out["key"][at] < 0
        out["key"][at[free]] = key[left[free]]
        own = out["key"][at] == key[left]
        out["next"][at[own]], out["add"][at[own]] = target[left[own]], add[left[own]]
        out["final"][at[own]] = final[left[own]]
        left = left[~own]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return out


def arc_slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


_ARRAYS = ("root", "key", "next", "add", "final", "offset", "ids")


def pack_file(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a JSON line with names, kinds and sizes, then the arrays."""
    head = json.dumps([[k, arrays[k].dtype.str, len(arrays[k])] for k in _ARRAYS]).encode()
    head += b" " * (-(len(head) + 1) % 16) + b"\n"
    body = b"".join(arrays[k].tobytes() + b"\0" * (-arrays[k].nbytes % 16) for k in _ARRAYS)
    return head + body


def map_file(path: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    with open(path, "rb") as f:
        head = f.readline()
    at, out = len(head), {}
    for name, kind, n in json.loads(head):
        size = n * np.dtype(kind).itemsize
        out[name] = raw[at:at + size].view(kind)
        at += size + -size % 16
    return out


def walk(auto: dict[str, np.ndarray], low: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Place of each word in the lexicon, or -1."""
    out = np.full(len(starts), -1, np.int64)
    if len(auto["offset"]) < 2:
        return out
    order = np.argsort(-lens, kind="stable").astype(np.int32)  # the words still running stay in front
    starts, lens = starts[order], lens[order]
    state = np.full(len(starts), auto["root"][0], np.int64)
    place, end = np.zeros(len(starts), np.int32), np.zeros(len(starts), bool)
    live = np.arange(len(starts), dtype=np.int32)
    bits, keys, step = len(auto["key"]).bit_length() - 1, auto["key"], 0
    while len(live):
        key = state[live] * PLAIN + low[starts[live] + step]
        slot = arc_slot(key, bits)
        found = keys[slot]
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):  # a few arcs do not lie in their first slot
            slot[again] = (slot[again] + 1) & ((1 << bits) - 1)
            found[again] = keys[slot[again]]
            again = again[(found[again] != key[again]) & (found[again] >= 0)]
        ok = found == key
        live, slot = live[ok], slot[ok]
        place[live] += auto["add"][slot]
        state[live] = auto["next"][slot]
        step += 1
        over = lens[live] == step
        here = live[over]
        end[here] = auto["final"][slot[over]] > 0
        live = live[~over]
    out[order] = np.where(end, place, -1)
    return out


class LexiconBpe:
    """A worker's encoder: mapped lexicon, merger and the recent other words."""

    def __init__(self, vocab_path: str, lexicon_path: str | None):
        from tokenizers import Tokenizer

        with open(vocab_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(vocab_path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.merger = Merger(spec)
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token = [""] * size
        for t, k in spec["model"]["vocab"].items():
            self.token[k] = t
        for t in spec["added_tokens"]:
            self.token[t["id"]] = t["content"]
        self.token = [t.encode("utf-8") for t in self.token]
        self.tables = character_tables()
        utf8 = [chr(c).encode("utf-8") for c in range(PLAIN)]
        self.lead = np.array([b[0] for b in utf8], np.uint8)
        self.trail = np.array([b[1] if len(b) > 1 else 0 for b in utf8], np.uint8)
        self.auto = map_file(lexicon_path) if lexicon_path else None
        self.table = WordTable(TABLE_WORDS)
        self.pool, self.used, self.kept = np.zeros(1 << 18, np.uint32), 0, 0
        self.at, self.count = np.zeros(TABLE_WORDS + 1, np.int64), np.zeros(TABLE_WORDS + 1, np.int64)

    def cut(self, data: np.ndarray, off: np.ndarray):
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        return cp, rows, cut_words(cp, rows, self.tables)

    def word_bytes(self, low, starts, lens):
        """UTF-8 of plain words in a row, with each word's start and length."""
        flat = low[concat_ranges(starts, lens)]
        wide = flat >= 0x80
        size = 1 + wide
        to = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint8)
        out[to] = self.lead[flat]
        out[to[wide] + 1] = self.trail[flat[wide]]
        ends = np.append(to, len(out))
        first = np.cumsum(lens) - lens
        begin = ends[first]
        return out, begin, ends[first + lens] - begin

    def _store(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _merge(self, low, starts, lens):
        """Places and counts in the pool of words merged now."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, count = self.merger.merge(*self.word_bytes(low, starts, lens))
        return self._store(ids) + np.cumsum(count) - count, count

    def _unseen(self, low, starts, lens):
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        raw = np.zeros(2 * len(low) + 64, np.uint8)
        raw[:2 * len(low)] = low.astype("<u2").view(np.uint8)
        short = np.flatnonzero(lens <= 11)
        keys = word_keys(raw, 2 * starts[short], 2 * lens[short])
        h = mixed(keys)
        word = self.table.find(keys, h)
        known = word >= 0
        at[short[known]], count[short[known]] = self.at[word[known]], self.count[word[known]]
        miss = np.flatnonzero(~known)
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            same = (keys[miss] == keys[miss[first]][inverse]).all(axis=1)
            new = short[miss[first]]
            a, c = self._merge(low, starts[new], lens[new])
            at[short[miss]], count[short[miss]] = a[inverse], c[inverse]
            size = self.table.size
            n = self.table.add(keys[miss[first]], h[miss[first]])
            self.at[size:size + n], self.count[size:size + n] = a[:n], c[:n]
            if n:
                self.kept = self.used
            other = short[miss[~same]]
            at[other], count[other] = self._merge(low, starts[other], lens[other])
        long = np.flatnonzero(lens > 11)
        at[long], count[long] = self._merge(low, starts[long], lens[long])
        return at, count

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offsets of each text's ids."""
        docs = len(off) - 1
        raw = data.tobytes()
        whole = [k for k in range(docs) if any(s in raw[off[k]:off[k + 1]] for s in self.special)] \
            if any(s in raw for s in self.special) else []
        cp, rows, (low, starts, lens, odd_from, odd_to) = self.cut(data, off)
        self.used = self.kept
        n = len(starts)
        at, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = walk(self.auto, low, starts, lens) if self.auto is not None else np.full(n, -1)
        hit = place >= 0
        rest = np.flatnonzero(~hit)
        at[rest], count[rest] = self._unseen(low, starts[rest], lens[rest])
        odd_at, odd_count = np.zeros(len(odd_from), np.int64), np.zeros(len(odd_from), np.int64)
        for k, (a, b) in enumerate(zip(odd_from.tolist(), odd_to.tolist())):
            ids = self.library.encode(cp[a:b].tobytes().decode("utf-32-le"), add_special_tokens=False).ids
            odd_at[k], odd_count[k] = self._store(np.array(ids, np.uint32)), len(ids)
        source = self.pool
        if hit.any():  # the lexicon's ids are read behind the pool
            begin = self.auto["offset"][place[hit]].astype(np.int64)
            at[hit], count[hit] = begin + len(self.pool), self.auto["offset"][place[hit] + 1] - begin
            source = np.concatenate([self.pool, self.auto["ids"]])
        if len(odd_from):
            starts = np.concatenate([starts, odd_from])
            at, count = np.concatenate([at, odd_at]), np.concatenate([count, odd_count])
            order = np.argsort(starts, kind="stable")
            starts, at, count = starts[order], at[order], count[order]
        ids = source[concat_ranges(at, count)].astype(np.uint32, copy=False)
        tok = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, rows)]
        if whole:
            parts = [ids[tok[k]:tok[k + 1]] for k in range(docs)]
            for k in whole:
                parts[k] = np.array(self.library.encode(raw[off[k]:off[k + 1]].decode("utf-8"),
                                                        add_special_tokens=False).ids, np.uint32)
            ids, tok = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, tok

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text."""
        token = self.token
        return b" ".join([token[i] for i in ids.tolist()])


# ---- on Spark -------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents, of the plain words of up to eleven
    characters (longer ones are merged anew); a task sums its own before the
    exchange."""
    def run(batches):
        tables = character_tables()
        held, size = [], 0

        def flush():
            words = pa.concat_arrays([w for w, _ in held])
            t = pa.table({"word": words, "n": pa.array(np.concatenate([c for _, c in held]))})
            t = t.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            return t

        for batch in batches:
            data, off = text_buffer(batch.column(0))
            for lo, hi in row_slices(off):
                o = off[lo:hi + 1] - off[lo]
                part = data[off[lo]:off[hi]]
                cp = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
                rows = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[o]
                low, starts, lens, _, _ = cut_words(cp, rows, tables)
                short = np.flatnonzero(lens <= 11)
                raw = np.zeros(2 * len(low) + 64, np.uint8)
                raw[:2 * len(low)] = low.astype("<u2").view(np.uint8)
                h = mixed(word_keys(raw, 2 * starts[short], 2 * lens[short]))
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                at, size_ = starts[short[first]], lens[short[first]]
                text = low[concat_ranges(at, size_)].astype("<u4").tobytes().decode("utf-32-le")
                ends = np.cumsum(size_).tolist()
                words = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
                held.append((pa.array(words, pa.string()), n.astype(np.int64)))
                size += len(words)
                if size > 1 << 20:
                    t = flush()
                    held, size = [(t["word"].combine_chunks(), t["n"].to_numpy())], len(t)
                    if size > 1 << 19:
                        yield from t.combine_chunks().to_batches(max_chunksize=1 << 16)
                        held, size = [], 0
        if held:
            yield from flush().combine_chunks().to_batches(max_chunksize=1 << 16)

    return docs.select(text_or_empty(docs).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocab: str = "word_bpe_49k.json", size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words (up to eleven characters) of all
    documents; returns the file's place in the shared checkpoint folder."""
    spark = docs.sparkSession
    counts = staged(word_counts(docs), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Frequent: a share that at most 64 x size words can have, so few rows are sorted however large the table.
    frequent = counts.where(F.col("n") >= total / (64 * size))
    top = frequent.orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    words = sorted(top.column("word").to_pylist())
    coder = LexiconBpe(vocab if "/" in vocab else vocabulary(vocab), None)
    cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lens = np.array([len(w) for w in words], np.int64)
    arrays = compile_automaton(words)
    ids, count = coder.merger.merge(*coder.word_bytes(cps, np.cumsum(lens) - lens, lens)) if words else \
        (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    arrays |= {"ids": ids.astype(np.uint32), "offset": np.concatenate([[0], np.cumsum(count)]).astype(np.int64)}
    path = scratch_path(spark, f"llm-lexicon-{uuid.uuid4().hex[:12]}.bin")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(pack_file(arrays)))
    out.close()
    return path


def encode(docs: DataFrame, lexicon: str, vocab: str = "word_bpe_49k.json", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document (with
    ``keep`` also ids, little-endian unsigned 32-bit, and decoded)."""
    name = lexicon.rsplit("/", 1)[1]
    docs.sparkSession.sparkContext.addFile(lexicon)

    def run(batches):
        import sys

        from pyspark import SparkFiles

        kept = sys.__dict__.setdefault("_kept_lexicons", {})
        if name not in kept:
            kept.clear()
            kept[name] = LexiconBpe(vocab if "/" in vocab else vocabulary(vocab), SparkFiles.get(name))
        coder = kept[name]
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for lo, hi in row_slices(off):
                ids, tok = coder.encode(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                parts = [ids[a:b] for a, b in zip(tok[:-1].tolist(), tok[1:].tolist())]
                raw = [p.astype("<u4", copy=False).tobytes() for p in parts]
                text = [coder.decode(p) for p in parts]
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(tok)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in text], pa.string())]
                if keep:
                    cols += [pa.array(raw, pa.binary()), pa.array([x.decode("utf-8") for x in text], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_or_empty(docs).alias("text")).mapInArrow(
        run, schema + ", ids binary, decoded string" * keep)
