import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from threatlens.llm import lexicon, packing, token_store
from threatlens.llm.bytebpe import vocabulary, worker_encoder
from threatlens.llm.common import text_buffer

from .conftest import EDGE, prose

PIECES = ["a", "B", "'s", "'ll", "'RE", " ", "  ", "\n", "\t", "é", "É", "<|endoftext|>", "1", "23", "中", " ",
          "İ", "!", "''", "\x1c", "x'", "́", "😀", " ", "’", "the", "ß", "ſ", "K", "²", "_", "\x85", "\x00", "'d"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "a" * 3000]


def test_byte_bpe_equals_library():
    enc = worker_encoder(vocabulary("byte_bpe_50k.json"))
    texts = odd_texts(3000, 1) + [prose(500, k) for k in range(5)]
    for _ in range(2):  # the second time from the table
        ids, tok = enc.encode(*text_buffer(pa.array(texts)))
        for k, t in enumerate(texts):
            assert ids[tok[k]:tok[k + 1]].tolist() == enc.library.encode(t, add_special_tokens=False).ids


def test_full_table_changes_nothing():
    from threatlens.llm.bytebpe import ByteBpe

    enc = ByteBpe(vocabulary("byte_bpe_50k.json"))
    enc.table.limit = 3
    texts = odd_texts(300, 5)
    for _ in range(2):
        ids, tok = enc.encode(*text_buffer(pa.array(texts)))
        for k, t in enumerate(texts):
            assert ids[tok[k]:tok[k + 1]].tolist() == enc.library.encode(t, add_special_tokens=False).ids


def plain_ids(pairs):
    enc = worker_encoder(vocabulary("byte_bpe_50k.json")).library
    return [enc.encode(t or "", add_special_tokens=False).ids + [0] for _, t in pairs]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_covers_every_piece(table):
    pairs = EDGE + [(1000 + k, prose(20 + k % 90, k)) for k in range(200)]
    rows = packing.pack_documents(table(pairs)).collect()
    want = []
    for (i, _), ids in zip(pairs, plain_ids(pairs)):
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:])) and p[0][0] == 0 and sum(p[-1]) <= 2048
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 2048) + 1


def test_packing_of_empty_table(table):
    assert packing.pack_documents(table([])).count() == 0


def test_packing_rounds_and_sequences(table, monkeypatch):
    pairs = [(k, prose(30 + k % 60, k)) for k in range(300)]
    pieces = packing.tokenized_pieces(table(pairs), keep_ids=True)
    out = packing.packed(pieces, shard_pieces=10)
    fills = [r.length for r in packing.sequences(out).collect()]
    assert max(fills) <= 2048 and len(fills) <= -(-sum(fills) // 2048) + 1
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out.collect()}
    assert got == {i: ids for (i, _), ids in zip(pairs, plain_ids(pairs))}


@pytest.mark.parametrize("short", [0, 40])
def test_packing_bounds_shards_of_pieces_that_never_pair(spark, monkeypatch, short):
    lengths = [1025 + k * 7 % 900 for k in range(400)] + [50 + k * 11 % 700 for k in range(short)]
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    rounds, plain = [], packing._packed_round

    def seen(todo, names, capacity, shards, level):
        rounds.append(todo.count() / shards)
        return plain(todo, names, capacity, shards, level)

    monkeypatch.setattr(packing, "_packed_round", seen)
    rows = packing.packed(pieces, shard_pieces=20).collect()
    assert 1 < len(rounds) < 20 and max(rounds) <= 2 * packing.FAN_IN
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(fill) == 400  # the short ones fit in beside the long ones
    for f in fill.values():
        f.sort()
        assert f[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(f, f[1:])) and sum(f[-1]) <= 2048


@pytest.mark.parametrize("lengths, most", [([700] * 9, 5), ([2048] * 3, 3), ([], 0), ([1], 1),
                                           ([1000, 900, 148, 1100, 800, 148], 2), ([1024] * 7, 4)])
def test_pack_shard(lengths, most):
    b, place, fill = packing.pack_shard(np.array(lengths, np.int64))
    assert len(set(b.tolist())) <= most and (len(fill) == 0 or fill.max() <= 2048)


def test_local_search_empties_a_bin():
    bins = packing.Bins(np.array([6, 3, 5, 4, 2]), 10)
    bins.bin, bins.left = np.array([0, 0, 1, 1, 2]), [1, 1, 8]
    bins.local_search()
    fill = np.bincount(bins.bin, weights=bins.length)
    assert sorted(x for x in fill if x) == [10, 10] and max(fill) <= 10


def test_token_store_round_trip(table):
    pairs = [p for p in EDGE if p[0] is not None] + [(1000 + k, prose(20 + k % 90, k)) for k in range(100)]
    pairs.sort(key=lambda p: p[0])
    rows = token_store.stored_documents(table(pairs), shard_tokens=700)
    ids = plain_ids(pairs)
    starts = np.cumsum([0] + [len(x) for x in ids])
    want = sorted((i, int(s), len(x), crc(x)) for (i, _), s, x in zip(pairs, starts, ids))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows.collect()) == want


def test_token_store_edges(table):
    assert token_store.stored_documents(table([])).count() == 0
    rows = token_store.stored_documents(table([(None, None), (None, "a"), (-(1 << 63), "b c"), (3, "d")])).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("-9223372036854775808", 3), ("3", 2), ("None", 1), ("None", 2)]
    assert {r.doc_id: r.start for r in rows if r.doc_id is not None} == {-(1 << 63): 3, 3: 6}  # null ids come first


def test_pairs_are_found_by_slot(monkeypatch):
    """Only keys that share the slot of another are searched for."""
    rng = np.random.default_rng(5)
    ids, tok = (rng.zipf(1.3, 60_000) % 5000).astype(np.uint32), np.array([0, 60_000])
    searched, plain = [], np.searchsorted

    def counted(a, v, *args, **kw):
        searched.append(np.size(v))
        return plain(a, v, *args, **kw)

    monkeypatch.setattr(np, "searchsorted", counted)
    grammar = token_store.replace_pairs(ids, tok, 50257, 15_000)
    assert len(grammar.pairs) > 500 and sum(searched) < 3000
    monkeypatch.setattr(token_store, "_SLOT_BITS", 3)  # most slots hold several pairs
    crowded = token_store.replace_pairs(ids, tok, 50257, 15_000)
    assert sum(searched) > 30_000
    assert (crowded.seq == grammar.seq).all() and (crowded.pairs == grammar.pairs).all()
    grammar.lengths = grammar.lengths.astype(np.int64)  # as a reader has them
    assert (grammar.expand(grammar.seq) == ids).all()


def test_expansions_of_deep_rules():
    first, pairs = 10, [(1, 2), (10, 3), (11, 10), (4, 12), (13, 13), (5, 5)]
    plain = lambda s: [s] if s < first else plain(pairs[s - first][0]) + plain(pairs[s - first][1])
    spelt = [plain(first + k) for k in range(len(pairs))]
    lengths = np.array([len(x) for x in spelt])
    flat, begin = token_store.Grammar(np.zeros(0), np.zeros(1), first, np.array(pairs, np.uint32), lengths).expansions()
    assert [flat[begin[k]:begin[k + 1]].tolist() for k in range(len(pairs))] == spelt
    none = token_store.Grammar(np.zeros(0), np.zeros(1), first, np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32))
    assert none.expansions()[0].tolist() == [] and none.expand(np.array([3, 4])).tolist() == [3, 4]


def test_word_table_with_shared_slots():
    from threatlens.llm.bytebpe import WordTable

    keys = np.array([[k % 3, k // 3, 1 << 56 | k % 2] for k in range(40)], np.uint64)
    h = np.full(40, np.uint64(0xFFFFFFFFFFFFFFFF))  # one slot, the last
    table = WordTable(30)
    assert (table.find(keys, h) == -1).all()
    assert table.add(keys[:25], h[:25]) == 25 and table.add(keys[25:], h[25:]) == 5
    assert table.find(keys, h).tolist() == [*range(30), *[-1] * 10]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 6, n) for n in (0, 1, 2, 900, 50, 0, 4000)] + [np.zeros(700, np.int64)]
    tok = np.cumsum([0] + [len(p) for p in parts])
    image = token_store.pack_shard(np.arange(len(parts)) - 3, np.concatenate(parts).astype(np.uint32), tok, 50257)
    shard = token_store.Shard(image)
    assert shard.doc_ids.tolist() == list(range(-3, 5)) and len(shard.grammar.pairs)
    assert len(shard.grammar.seq) < 0.55 * tok[-1] and len(shard.document(7)) == 700
    assert shard.grammar.doc[8] - shard.grammar.doc[7] < 40  # a run of one id
    assert (shard.ids() == np.concatenate(parts)).all()
    for k, p in enumerate(parts):
        assert (shard.document(k) == p).all()
        for place in range(0, len(p), 37):
            assert shard.id_at(k, place) == p[place]


def test_lexicon_bpe_equals_library(table, tmp_path):
    texts = odd_texts(2000, 2) + [prose(300, k) for k in range(4)]
    bare = lexicon.LexiconBpe(vocabulary("word_bpe_49k.json"), None)
    words = sorted({w.lower() for t in texts for w in t.split() if w.isascii() and w.isalpha() and len(w) < 12})
    arrays = lexicon.compile_automaton(words)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lens = np.array([len(w) for w in words])
    ids, count = bare.merger.merge(*bare.word_bytes(chars, np.cumsum(lens) - lens, lens))
    arrays |= {"ids": ids, "offset": np.concatenate([[0], np.cumsum(count)])}
    (tmp_path / "lexicon").write_bytes(lexicon.pack_file(arrays))
    full = lexicon.LexiconBpe(vocabulary("word_bpe_49k.json"), str(tmp_path / "lexicon"))
    assert (lexicon.walk(full.auto, chars, np.cumsum(lens) - lens, lens) == np.arange(len(words))).all()
    for coder in (bare, full, full):
        ids, tok = coder.encode(*text_buffer(pa.array(texts)))
        for k, t in enumerate(texts):
            own = ids[tok[k]:tok[k + 1]]
            assert own.tolist() == coder.library.encode(t, add_special_tokens=False).ids
            assert coder.decode(own).decode() == coder.library.decode(own.tolist(), skip_special_tokens=False)


def test_automaton_shares_suffixes():
    words = sorted(a + b for a in ("walk", "talk", "jump", "sing") for b in ("", "ed", "ing", "s"))
    auto = lexicon.compile_automaton(words)
    assert (auto["key"] >= 0).sum() < 30 < sum(map(len, words))


def test_lexicon_query_on_edges(table):
    df = table(EDGE)
    out = {r.doc_id: r for r in lexicon.encode(df, lexicon.build_lexicon(df), keep=True).collect()}
    library = lexicon.LexiconBpe(vocabulary("word_bpe_49k.json"), None).library
    for i, t in EDGE:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded == library.decode(ids, skip_special_tokens=False)
    empty = table([])
    assert lexicon.encode(empty, lexicon.build_lexicon(empty)).count() == 0
