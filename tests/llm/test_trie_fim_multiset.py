import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlens.llm import fim, multiset_hash, prefix_trie
from threatlens.llm.oracles import ORACLES
from threatlens.llm.scan import running

from .conftest import CLASHES, EDGE, prose

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      *(T.StructField(c, T.StringType()) for c in ("depth", "n", "k", "gid", "conv", "pos", *CLASHES))])


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- running sums ---------------------------------------------------------------

def test_running_sums_over_split_groups(spark):
    rows = [(7 if k % 3 else k, k, (k * 37) % 11 - 5, 1 << 62) for k in range(400)]
    df = spark.createDataFrame(rows, "g long, o long, v long, big long").repartition(5)
    got = {(r.g, r.o): (r.before_v, r.before_big) for r in running(df, "g", [F.col("o")], ["v", "big"], "t").collect()}
    sums = {}
    for g, o, v, big in sorted(rows):
        s, b = sums.get(g, (0, 0))
        assert got[g, o] == (s, (b + (1 << 63)) % (1 << 64) - (1 << 63))  # sums wrap
        sums[g] = s + v, b + big
    assert running(df.where("false"), "g", [F.col("o")], ["v"], "t").count() == 0


# ---- prefix trie ----------------------------------------------------------------

def plain_trie(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tid = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, tid, text))
    convs = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in convs.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        src = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = convs.get(src, [])[:h] + own[h:]
    members = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], set()).add(key)
    out = {}
    for key in sorted(members, key=len, reverse=True):
        m = sorted(members[key])
        below = [out[k] for k in kids.get(key, ())]
        saved = (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0)
        ends = ",".join(str(c) for c in m if len(full[c]) == len(key))
        out[key] = (min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(below),
                    sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), sha(ends))
    return sorted(out.values(), key=str)


def conversations(seed, n, longest, texts):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 200), n):
        for turn in range(r.randrange(1, longest)):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(texts)))
    return rows


TEXTS = ["a b", "a b", "", None, "c\td  e", "x" * 3000]
CASES = {
    "small": conversations(1, 60, 9, TEXTS),
    "long": conversations(2, 40, 60, ["same", "same", "same", "same", "same", "other"]),
    "one hot": [(0, k, "user", "w w") for k in range(300)] + [(k, j, "user", "w w") for k in range(1, 25) for j in range(40)],
    "edge": [(None, 1, "user", "lost"), (5, None, "user", "first"), (5, 1, "user", "b"), (5, 1, "user", "b"), (5, 1, "a", "z"),
             (5, -3, None, None), (1 << 40, 0, "user", "far"), (-21, 0, "user", "below"), (-20, 0, "user", "base")],
    "empty": [],
}


@pytest.mark.parametrize("case,size,limit", [("small", 3, 2), ("long", 16, 512), ("long", 4, 3), ("one hot", 16, 8),
                                             ("edge", 16, 512), ("edge", 1, 1), ("empty", 16, 512)])
def test_trie_matches_plain(spark, case, size, limit):
    rows = [(*r, *["x"] * (len(TURNS) - 4)) for r in CASES[case]]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    got = sorted((tuple(r) for r in prefix_trie.build(df, size, limit).collect()), key=str)
    assert got == plain_trie(CASES[case])


def test_trie_of_copies_ends_once(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 100_000, 20) for t in range(2)]
    out = prefix_trie.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 16, 8)
    got = {r.depth: r for r in out.collect()}
    assert len(got) == 3 and got[2].n_convs == 5000 and got[0].n_leaves == 1 and got[1].saved_tokens == 2 * 4999
    assert got[2].ends_sha256 == sha(",".join(str(c) for c in range(0, 100_000, 20)))


def test_trie_sql_agrees_on_edge_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in CASES["small"] if r[0] >= 0])
    want = sorted((tuple(r) for r in con.execute(ORACLES["op11_prefix_trie"]).fetchall()), key=str)
    assert want == plain_trie([r for r in CASES["small"] if r[0] >= 0])


# ---- fill-in-middle ---------------------------------------------------------------

def plain_fim(i, text, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = sha(f"7:{'' if i is None else i}")
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:lo], lines[lo:hi], lines[hi:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [(20, "a<P>b\n"), (21, "<M>"), (22, "\n"), (23, "\n\n\n"), (24, "no newline"), (25, "<\n<S\n>M>\n<"), (26, "é\n😀\nx\r\n"),
       (27, "line of words\n" * 60_000), (28, "tail\n<"), (29, "P>\nS>\nM>\n"), (-5, "one\ntwo")]


@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (40, 50), (100, 0), (100, 100), (0, 50)])
def test_fim_matches_plain_and_restores(table, rate, spm_rate):
    pairs = [*EDGE, *ODD, *((100 + k, "\n".join(prose(k % 9, j) for j in range(k % 13))) for k in range(150))]
    out = fim.transform(table(pairs), 7, rate, spm_rate).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=str)
    assert got == sorted((plain_fim(i, t, rate, spm_rate) for i, t in pairs), key=str)
    assert sorted((str(r.doc_id), r.back) for r in out) == sorted((str(i), t or "") for i, t in pairs)


def test_fim_of_an_empty_table(table):
    assert fim.transform(table([])).collect() == []


# ---- multiset hash ------------------------------------------------------------------

def plain_shingles(text):
    out = []
    for p in text.encode().split(b"\n") if text else []:
        w = p.split()
        out += [tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    return out


def test_shingles_are_those_of_each_paragraph():
    ps = [b"a b c d", b"", b"a b", b"  x\t", b"b c d", b"a b c", b"b a", "é ü".encode()]
    h, owner = multiset_hash.shingle_hashes(ps)
    want = [(k, s) for k, p in enumerate(ps) for s in plain_shingles(p.decode())]
    assert owner.tolist() == [k for k, _ in want]
    seen = {}
    for x, (_, s) in zip(h.tolist(), want):
        assert seen.setdefault(s, x) == x
    assert len(set(seen.values())) == len(seen)


def test_fingerprint_is_a_homomorphism_of_multisets():
    f = multiset_hash.fingerprint
    assert f("one\ntwo\nthree") == f("three\none\ntwo") != f("one\ntwo\ntwo\nthree")
    assert f("") == "0" * len(f("")) and f("a") != f("a\n") != f("a\n\n")
    assert multiset_hash.updated(f("one\ntwo"), ["one"], ["x y z w", "one"]) == f("two\none\nx y z w")
    assert multiset_hash.updated(f("one\ntwo"), ["one", "two"]) == f("")
    many = "same line of text\n" * 70_000  # lanes wrap
    assert multiset_hash.updated(f(many), ["same line of text"]) == f(many[len("same line of text\n"):])


def plain_edit(pairs):
    import xxhash

    s64 = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest()  # noqa: E731  Spark's hash of a string, as a signed long
    key = lambda p: (p[0] is not None, p[0] or 0, (s64(p[1]) + (1 << 63)) % (1 << 64))
    rows = sorted(((i, t or "") for i, t in pairs), key=key)
    f = multiset_hash.fingerprint
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        new = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        out.append((i, len(t), sha(new), f(t), f(new), f(after)))
    return out


@pytest.mark.parametrize("pairs", [EDGE, [], [(1, "alone and edited by itself")], [(None, None)], [(k % 50, prose(k, k)) for k in range(200)]])
@pytest.mark.parametrize("parts", [1, 8])
def test_fingerprints_match_plain(spark, table, pairs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = multiset_hash.fingerprints(table(pairs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_edit(pairs)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows), key=str) == \
        sorted((w[:5] for w in want), key=str)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
    assert sorted((str(r.doc_id), r.near_next == 1) for r in rows) == sorted((str(w[0]), w[3] == w[5]) for w in want)


def test_likeness_follows_the_share_of_shingles(table):
    rng = random.Random(4)
    text = lambda: "\n".join(" ".join(str(rng.randrange(5000)) for _ in range(40)) for _ in range(20))
    rows = multiset_hash.fingerprints(table([(k, text()) for k in range(60)])).collect()
    near, far = np.array([r.near_edited for r in rows]), np.array([r.near_next for r in rows])
    assert near.min() > 0.5 and abs(near.mean() - 0.75) < 0.05 and far.max() < 0.3 and far.mean() < 0.06
