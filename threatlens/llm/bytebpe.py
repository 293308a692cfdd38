"""Byte-level BPE ids of whole texts, computed a word at a time.

A text is cut before every space that a character other than white space
follows; the vocabulary's pre-tokenizer always breaks there, so the ids of a
text are the ids of its pieces in a row.  Pieces of up to 23 bytes are looked
up by their exact bytes (three machine words) in a table held by the Python
worker; the others are encoded by the tokenizer library in one call per slice.
The table is bounded; beyond its bound pieces are encoded anew, with the same
result.  Texts with the vocabulary's special token, and pieces with characters
from U+0300 on, go to the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json

import numpy as np

from .common import concat_ranges

#: Entries of the worker's table.
TABLE_WORDS = 400_000
_BITS = 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def word_keys(padded: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Three words per piece that spell its bytes and length; only for pieces
    of up to 23 bytes.  ``padded`` has 24 bytes more than the pieces."""
    view = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    ones = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    out = np.empty((len(starts), 3), np.uint64)
    for k in range(3):
        out[:, k] = view[starts + 8 * k] & ones[np.clip(lens - 8 * k, 0, 8)]
    out[:, 2] |= lens.astype(np.uint64) << np.uint64(56)
    return out


def mixed(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * _MIX[0]
    h = (h ^ (h >> np.uint64(29)) ^ keys[:, 1]) * _MIX[1]
    h = (h ^ (h >> np.uint64(31)) ^ keys[:, 2]) * _MIX[2]
    return h ^ (h >> np.uint64(32))


class WordTable:
    """Open-addressing table from exact keys to numbers 0, 1, ...  The keys lie
    in the order of their numbers, so those of frequent words, which come
    first, lie side by side."""

    def __init__(self, limit: int = TABLE_WORDS):
        self.limit, self.size = limit, 0
        self.keys = np.zeros((3, limit + 1), np.uint64)
        self.word = np.full((1 << _BITS) + 1, -1, np.int32)

    def _equal(self, word: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether each key is that of its word; word -1 has no key."""
        same = self.keys[2][word] == keys[:, 2]  # holds the length, so it is never that of word -1
        for k in range(2):
            same &= self.keys[k][word] == keys[:, k]
        return same

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Number of each key, or -1."""
        slot = (h >> np.uint64(64 - _BITS)).view(np.int64)
        found = self.word[slot]
        left = np.flatnonzero(~self._equal(found, keys))
        left = left[found[left] >= 0]
        found = found.astype(np.int64)
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << _BITS) - 1)
            found[left] = word = self.word[slot[left]]
            left = left[(word >= 0) & ~self._equal(word, keys[left])]
        return found

    def add(self, keys: np.ndarray, h: np.ndarray) -> int:
        """Number the distinct new keys from the present size on; returns how
        many had room."""
        n = min(len(keys), self.limit - self.size)
        self.keys[:, self.size:self.size + n] = keys[:n].T
        slot = (h[:n] >> np.uint64(64 - _BITS)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            at = slot[left]
            free = self.word[at] < 0
            self.word[at[free]] = self.size + left[free]
            left = left[self.word[at] != self.size + left]
            slot[left] = (slot[left] + 1) & ((1 << _BITS) - 1)
        self.size += n
        return n


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in tok): k for tok, k in spec["model"]["vocab"].items()
                 if all(c in alphabet for c in tok)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = [t.encode() for t in special]
        for t in special.values():
            ranks = {b: k for b, k in ranks.items() if k != t}
        # Fixed value: the pre-tokenizer's pattern.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 2, np.int64)
        for b, k in ranks.items():
            self.bytes_of[k] = len(b)
        # A space is a cut if the byte after it begins a character other than white space.
        self.opens = np.ones(256, bool)
        self.opens[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = False
        self.table = WordTable()
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.kept = 0  # of the pool, what the table refers to
        self.at = np.zeros(TABLE_WORDS + 1, np.int64)
        self.count = np.zeros(TABLE_WORDS + 1, np.int64)

    def _store(self, ids: np.ndarray) -> int:
        """Append ids to the pool; returns their place."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _encode_pieces(self, raw: bytes, starts: np.ndarray, lens: np.ndarray):
        """Places and counts in the pool of the ids of the given pieces."""
        data = np.frombuffer(raw, np.uint8)
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        high = np.flatnonzero(data >= 0xCC)
        odd = np.searchsorted(high, starts + lens) > np.searchsorted(high, starts)
        apart = odd | (data[starts] != 32) | (lens < 2) | ~self.opens[data[np.minimum(starts + 1, len(data) - 1)]]
        for k in np.flatnonzero(apart):
            piece = raw[starts[k]:starts[k] + lens[k]].decode("utf-8")
            ids = (self.library.encode(piece, add_special_tokens=False).ids if odd[k]
                   else self.bpe.encode_ordinary(piece))
            at[k], count[k] = self._store(np.array(ids, np.uint32)), len(ids)
        joint = np.flatnonzero(~apart)
        if len(joint):
            text = data[concat_ranges(starts[joint], lens[joint])].tobytes().decode("utf-8")
            ids = np.array(self.bpe.encode_ordinary(text), np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(lens[joint]), side="left") + 1
            count[joint] = np.diff(ends, prepend=0)
            at[joint] = self._store(ids) + ends - count[joint]
        return at, count

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None):
        """Ids of all texts in a row and the offsets of each text's ids.  With
        ``end_id`` that id follows every text."""
        n, docs = int(off[-1]), len(off) - 1
        raw = data.tobytes()
        whole = [k for k in range(docs) if any(s in raw[off[k]:off[k + 1]] for s in self.special)] \
            if any(s in raw for s in self.special) else []
        if n:
            padded = np.zeros(n + 32, np.uint8)
            padded[:n] = data
            cut = np.zeros(n + 1, bool)
            cut[:n] = (padded[:n] == 32) & self.opens[padded[1:n + 1]]
            cut[off[1:][off[1:] > 0] - 1] = False
            cut[off[:-1]] = True
            starts = np.flatnonzero(cut[:n])
            lens = np.diff(starts, append=n)
            at, count = self._pieces(raw, padded, starts, lens)
        else:
            starts, at, count = (np.zeros(0, np.int64) for _ in range(3))
        before = np.concatenate([[0], np.cumsum(count)])
        tok = before[np.searchsorted(starts, off)]
        extra = 0 if end_id is None else 1
        out = np.full(int(tok[-1]) + extra * docs, end_id or 0, np.uint32)
        doc = np.searchsorted(off, starts, side="right") - 1
        to = concat_ranges(before[:-1] + extra * doc, count)
        out[to] = self.pool[concat_ranges(at, count)]
        tok = tok + extra * np.arange(docs + 1)
        if whole:
            parts = [out[tok[k]:tok[k + 1]] for k in range(docs)]
            for k in whole:
                ids = self.library.encode(raw[off[k]:off[k + 1]].decode("utf-8"), add_special_tokens=False).ids
                parts[k] = np.array(ids + [end_id] * extra, np.uint32)
            out, tok = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, tok

    def _pieces(self, raw, padded, starts, lens):
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(lens <= 23)
        keys = word_keys(padded, starts[short], lens[short])
        h = mixed(keys)
        word = self.table.find(keys, h)
        known = word >= 0
        at[short[known]], count[short[known]] = self.at[word[known]], self.count[word[known]]
        miss = np.flatnonzero(~known)
        self.used = self.kept
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            same = (keys[miss] == keys[miss[first]][inverse]).all(axis=1)
            new = short[miss[first]]
            new_at, new_count = self._encode_pieces(raw, starts[new], lens[new])
            at[short[miss]], count[short[miss]] = new_at[inverse], new_count[inverse]
            size = self.table.size
            n = self.table.add(keys[miss[first]], h[miss[first]])
            self.at[size:size + n], self.count[size:size + n] = new_at[:n], new_count[:n]
            if n:
                self.kept = self.used
            odd = short[miss[~same]]
            if len(odd):
                at[odd], count[odd] = self._encode_pieces(raw, starts[odd], lens[odd])
        long = np.flatnonzero(lens > 23)
        if len(long):
            at[long], count[long] = self._encode_pieces(raw, starts[long], lens[long])
        return at, count


def worker_encoder(path: str) -> ByteBpe:
    """The worker's encoder for a vocabulary file, kept between its tasks."""
    import sys

    kept = sys.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = ByteBpe(path)
    return kept[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
