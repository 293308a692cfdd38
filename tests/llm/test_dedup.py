import hashlib
import random
import re

import numpy as np
import pytest

from threatlens.llm import exact_dedup, graph, line_dedup, simhash

from .conftest import EDGE, prose


def plain_exact(pairs):
    groups = {}
    for i, t in pairs:
        t = t or ""
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()
        groups.setdefault(sha, []).append((-len(t), -(1 << 63) if i is None else i))
    return {sha: (min(g)[1], len(g)) for sha, g in groups.items()}


@pytest.mark.parametrize("pairs", [EDGE, [], [(k, f"text {k % 7}") for k in range(300)]])
def test_exact_matches_plain(table, pairs):
    best = plain_exact(pairs)
    rows = exact_dedup.classes(table(pairs)).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert (-(1 << 63) if r.keep_id is None else r.keep_id, r.group_size) == best[r.text_sha256]
    assert sum(r.kept for r in rows) == len(best)  # one row a class, also where the staying row is repeated
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in pairs)
    df = table(pairs)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id) for r in kept.collect()) == \
        sorted(k for k, _ in best.values())


def test_exact_sql_agrees_on_repeats_and_nulls(table):
    import duckdb

    from threatlens.llm.oracles import ORACLES

    pairs = [(5, "ab"), (5, "ab"), (7, "ab"), (None, "ab"), (None, "x"), (None, "x"), (1, "x y"), (1, "x y"), (-(1 << 63), "z"), (None, "z")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", pairs)
    cur = con.execute(ORACLES["op2_exact_dedup"])
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = exact_dedup.classes(table(pairs)).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_exact_keeps_longest_original(table):
    rows = {r.doc_id: r for r in exact_dedup.classes(table([(1, "ab"), (2, "a b"), (3, "a\tb")])).collect()}
    assert [rows[k].keep_id for k in (1, 2, 3)] == [2, 2, 2]
    assert [rows[k].kept for k in (1, 2, 3)] == [False, True, False]


def plain_fingerprint(text, words=3):
    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64(" ".join(ws[k:k + words]).encode(), seed=42).intdigest()
         for k in range(max(1, len(ws) - words + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(n, pairs):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_simhash_matches_brute_force(table):
    base = prose(400, 2).split()
    near = [(100 + k, " ".join(base[:k * 9] + ["other"] + base[k * 9:])) for k in range(40)]
    pairs = sorted([p for p in EDGE if p[0] is not None] + near + [(400 + k, t) for k, (_, t) in enumerate(near[:5])])
    prints = np.array([plain_fingerprint(t) for _, t in pairs], np.uint64)
    close = [(a, b) for a in range(len(pairs)) for b in range(a)
             if int(prints[a] ^ prints[b]).bit_count() <= 3]
    root = roots(len(pairs), close)
    want = {(i, f"{int(p):016x}", pairs[r][0]) for (i, _), p, r in zip(pairs, prints, root)}
    df = table(pairs)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_simhash_nulls_and_empty_table(table):
    assert simhash.near_duplicates(table([])).count() == 0
    assert simhash.near_duplicates(table(EDGE)).count() == len(EDGE)


def test_simhash_ids_never_link_texts(table):
    texts = [prose(60, k) for k in range(1, 9)]
    assert len({plain_fingerprint(t) for t in texts}) == 8
    # Null ids with texts of their own, one id with two texts, and real ids equal to null rows' texts.
    pairs = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[1]), (2, texts[2]),
             (5, texts[3]), (5, texts[4]), (6, texts[4]), (7, texts[5]), (7, texts[5])]
    prints = [plain_fingerprint(t) for _, t in pairs]
    root = roots(len(pairs), [(a, b) for a in range(len(pairs)) for b in range(a)
                              if (prints[a] ^ prints[b]).bit_count() <= 3])
    df = table(pairs)
    assert sorted(r.text for r in simhash.keep_one(df).collect()) == sorted(texts[:6])
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(pairs) and len({r.component for r in got}) == len(set(root)) == 6
    assert {r.component_id for r in got} == {None, 1, 2, 5, 7}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in pairs)


@pytest.mark.parametrize("bits", [2, 5, 9])
def test_collisions_connect_all_close_prints(bits):
    rng = np.random.default_rng(bits)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre] + [centre ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64))
                                              ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64))
                                              for _ in range(6)]))
    close = [(a, b) for a in range(len(fp)) for b in range(a) if np.bitwise_count(fp[a] ^ fp[b]) <= 3]
    found = []
    for prefix in range(1 << bits):
        top = np.bitwise_count((fp >> np.uint64(64 - bits)) ^ np.uint64(prefix))
        near = np.flatnonzero((top <= 1) | ((top == 2) & (np.bitwise_count(fp) % 2 == 0)))
        if len(near):
            p = near[simhash._collisions(prefix, fp[near], bits)]
            assert (np.bitwise_count(fp[p[:, 0]] ^ fp[p[:, 1]]) <= 3).all()
            found += p.tolist()
    assert roots(len(fp), found) == roots(len(fp), close)


def test_components_of_chain_star_and_ring(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 240)] + \
        [(300 + k, 300 + (k + 1) % 9) for k in range(9)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 5 for k in range(200, 240))
    assert all(got[300 + k] == 300 for k in range(9)) and 7 not in got


def test_edit_distance_matches_plain():
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(500):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain(a, b)


def test_edit_similarity_side_by_side_matches_one_by_one():
    import random

    rng = random.Random(8)
    x, y = [], []
    for k in range(900):
        a = [rng.choice("abcdé漢😀 "[:4 if k % 3 else 8]) for _ in range(rng.choice([0, 1, 2, 5, 9, 20, 60, 150]))]
        b = list(a)
        for _ in range(rng.randint(0, 1 + len(a) // 3)):
            at, kind = rng.randint(0, len(b)), rng.randint(0, 2)
            b[at:at + (kind > 0)] = "#" if kind < 2 else ""
        x.append("".join(a))
        y.append("".join(b))
    long = prose(1200, 2)  # beyond the lines that go side by side
    x += [long] * 4
    y += [long[9:], long[len(long) // 3:] + "q" * (len(long) // 3), "z" * len(long), "zz" + long[2::2] + long[1::2]]
    got = line_dedup.all_similar(x, y)
    assert got.tolist() == [line_dedup.similar(a, b) for a, b in zip(x, y)]
    assert [line_dedup.edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in zip(x, y)] == got.tolist()
    assert got[900] and not got[901] and not got[902] and 100 < got.sum() < 850
    assert line_dedup.all_similar([], []).tolist() == []


def test_signature_of_a_line_is_the_same_in_any_company():
    lines = [b"", b"a", b"ab", b"abc", prose(40).encode(), prose(9000).encode(), "naïve 漢字".encode()]
    together = line_dedup.signatures(lines)
    assert (together >> np.uint64(line_dedup.FIELD * line_dedup.ROWS) == 0).all()
    assert (line_dedup._unpacked(line_dedup._packed(together)) == together).all()
    for k, line in enumerate(lines):
        assert (line_dedup.signatures([line]) == together[k]).all()
    halves = line_dedup._halves(together)
    every = line_dedup.BANDS * line_dedup.ROWS
    assert (line_dedup._equal_halves(halves, halves, every) == every).all()
    plain = [[int(v) >> line_dedup.FIELD * j & 15 for v in row for j in range(line_dedup.ROWS)] for row in together]
    assert line_dedup._equal_halves(halves[:1], halves[4:5], every)[0] == sum(
        p == q for p, q in zip(plain[0], plain[4]))


def test_verified_pairs_connect_what_all_similar_pairs_do(spark):
    import random

    rng, texts = random.Random(3), []
    for g in range(12):
        base = prose(9, g)
        for _ in range(g + 1):  # each a step from the one before, so ends of a group are unlike
            base = base[:(k := rng.randrange(len(base)))] + rng.choice("#%&") * 3 + base[k + 3:]
            texts.append(base)
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if rng.random() < 0.4]
    close = [p for p in pairs if line_dedup.similar(texts[p[0]], texts[p[1]])]
    given = [(len(texts) - 1, 0)]  # a link found elsewhere
    edges = line_dedup.verified(spark.createDataFrame(pairs, "a long, b long"),
                                spark.createDataFrame(given, "a long, b long"),
                                spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    got = [(r.a, r.b) for r in edges.collect()]
    assert roots(len(texts), got) == roots(len(texts), close + given)
    assert 1 < len(set(roots(len(texts), close + given))) < len(texts)


def plain_lines(pairs):
    at = {}
    for i, t in pairs:
        for j, line in enumerate((t or "").encode().split(b"\n")):
            if line.split():
                at.setdefault(b" ".join(line.lower().split()), []).append((-(1 << 63) if i is None else i, j))
    lines = sorted(at)
    fp = line_dedup.line_prints(lines).view(np.uint64)
    close = [(a, b) for a in range(len(lines)) for b in range(a) if np.bitwise_count(fp[a] ^ fp[b]) <= 3
             and line_dedup.similar(lines[a].decode(), lines[b].decode())]
    groups = {}
    for k, r in enumerate(roots(len(lines), close)):
        groups.setdefault(r, []).extend(at[lines[k]])
    gone = {}
    for g in groups.values():
        for i, j in sorted(set(g))[1:]:
            gone.setdefault(i, []).append(j)
    return gone, len(close)


def test_lines_match_brute_force(table):
    long = prose(120, 1)
    pairs = EDGE + [(20 + k, f"Only here {k * 977}\n{long[:-k] if k else long}\nShared Line of all\n\nshared  line of ALL")
                    for k in range(6)] + [(60, "x"), (61, "x"), (62, "tail\n")]
    gone, links = plain_lines(pairs)
    assert links
    df = table(pairs)
    rows = line_dedup.line_report(df).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        want = sorted(gone.get(-(1 << 63) if r.doc_id is None else r.doc_id, []))
        assert r.dropped == ",".join(map(str, want)) and r.n_dropped == len(want)
    out = line_dedup.deduped(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[62] == "tail\n" and texts[61] == "" and texts[1] is None


def test_lines_recall_against_edit_similarity_alone(table):
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    pairs, lines = [], {}
    for size in (40, 80, 200):
        for share in (0, 0.05, 0.1, 0.2):  # 0: one changed letter
            for _ in range(25):
                a = "".join(rng.choice(letters[:-1]) if k % 6 else " " for k in range(1, size + 1)).strip()
                b = list(a)
                for k in rng.sample(range(len(b)), int(share * len(b)) or 1):
                    b[k] = "#"
                i = 2 * len(lines)
                lines[i] = (a, "".join(b), size, share)
                pairs += [(i, a), (i + 1, "".join(b))]
    gone = {r.doc_id for r in line_dedup.line_report(table(pairs)).collect() if r.n_dropped}
    assert all(i % 2 for i in gone)  # the copy, and none by an unrelated line
    found = {}
    for i, (a, b, size, share) in lines.items():
        assert line_dedup.similar(a, b)
        found.setdefault((size, share), []).append(i + 1 in gone)
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    assert all(x >= (0.5 if share == 0.2 else 0.95) for (_, share), x in recall.items()), recall
    assert sum(map(sum, found.values())) >= 0.9 * len(lines), recall


def test_lines_of_empty_table(table):
    assert line_dedup.line_report(table([])).count() == 0


def test_block_masks_cover_any_three_bits():
    from itertools import combinations

    for n in (10, 1 << 23, 1 << 30):
        masks = line_dedup.block_masks(n)
        for flips in list(combinations(range(64), 3))[::97]:
            x = sum(1 << b for b in flips)
            assert any(x & m == 0 for m in masks)


def test_edit_distances_leave_out_diagonals_beyond_the_bounds(monkeypatch):
    rng = random.Random(12)
    rows, plain = [], np.full

    def seen(shape, *args, **kw):
        if args == (1 << 14, np.int16) and isinstance(shape, tuple):
            rows.append(shape[0])
        return plain(shape, *args, **kw)

    monkeypatch.setattr(np, "full", seen)
    for difference in (0, 15, 40):
        x = ["".join(rng.choice("ab") for _ in range(200)) for _ in range(60)]
        y = ["".join(c if rng.random() < 0.9 else rng.choice("abc") for c in t[difference:]) for t in x]
        bound = np.array([rng.randint(difference, 40) for _ in x])
        true = np.array([line_dedup.edit_distance(a, b) for a, b in zip(x, y)])
        for one, other in ((x, y), (y, x)):
            rows.clear()
            got = line_dedup._distances(one, other, bound)
            assert ((got == true) | ((got > bound) & (true > bound))).all()
            # (40 + difference) / 2 diagonals on one side, (40 - difference) / 2 on the other
            assert rows and max(rows) <= 40 // 2 + 4
    for _ in range(50):
        x, y = (["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(20)] for _ in range(2))
        bound = np.array([rng.randint(0, 30) for _ in x])
        true = np.array([line_dedup.edit_distance(a, b) for a, b in zip(x, y)])
        got = line_dedup._distances(x, y, bound)
        assert ((got == true) | ((got > bound) & (true > bound))).all()


def test_simhash_is_the_majority_of_the_runs_bits():
    rng = random.Random(13)
    lines = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (1, 4, 5, 6, 40, 259, 260, 700, 70_000)]

    def plain(line):
        votes, g = np.zeros(64, np.int64), max(len(line) - line_dedup.GRAM + 1, 1)
        for k in range(g):
            run = line[k:k + line_dedup.GRAM]
            h = int.from_bytes(run, "little") + 8 * len(run)
            for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                h = (h ^ h >> 31) * factor % (1 << 64)
            h ^= h >> 29
            votes += np.unpackbits(np.frombuffer(h.to_bytes(8, "little"), np.uint8))
        return int.from_bytes(np.packbits(votes * 2 > g).tobytes(), "big", signed=True)

    assert line_dedup.line_prints(lines).tolist() == [plain(x) for x in lines]


def test_unlike_long_lines_are_refuted_by_pieces_and_like_ones_never(monkeypatch):
    rng = random.Random(14)

    def text(n):
        return "".join(rng.choice("etaoin shrdlué日😀") for _ in range(n))

    def changed(t, part):
        out = []
        for c in t:
            if rng.random() >= part:
                out.append(c)
            elif rng.random() < 0.5:
                out.append(rng.choice("xyz") + rng.choice(["", c]))
        return "".join(out)

    x = [text(rng.randint(400, 1500)) for _ in range(40)]
    y = [changed(t, part) for t, part in zip(x, [0, 0.05, 0.15, 0.18, 0.2, 0.22, 0.25, 0.3] * 5)]
    y[7], y[15] = x[7][120:], "ab" * 30 + x[15]  # one side far longer
    unlike = [text(len(t)) for t in x]
    size = np.array([(len(a), len(b)) for a, b in zip(x, y)])
    bound = np.array([line_dedup.edit_distance(a, b) for a, b in zip(x, y)])
    for one, other, s in ((x, y, size), (y, x, size[:, ::-1])):
        far = np.abs(s[:, 0] - s[:, 1]) <= bound
        assert (line_dedup._piecewise(one, other, s, bound)[far] <= bound[far]).all()
    true = [line_dedup.similar(a, b) for a, b in zip(x, y)]
    assert 0 < sum(true) < len(true)

    passed, whole = [], line_dedup._distances
    monkeypatch.setattr(line_dedup, "_distances", lambda a, b, bound: passed.extend(a) or whole(a, b, bound))
    assert line_dedup.all_similar(x + unlike, y + x).tolist() == true + [False] * len(x)
    assert not set(passed) & set(unlike)


def test_lines_that_meet_are_paired_if_their_sizes_allow():
    rng = np.random.default_rng(15)
    n = 300
    sig = rng.integers(0, 1 << 39, (n, line_dedup.BANDS), dtype=np.uint64)
    sig[50:100, :30] = sig[50, :30]  # surely alike
    sig[100:200, :20] = sig[100, :20]  # alike
    halves, key = line_dedup._halves(sig), np.arange(n, dtype=np.uint64) // np.uint64(50)
    key[100:200] = 2
    size = rng.integers(1, 300, n)
    size[250], size[251] = line_dedup._MOST, line_dedup._MOST  # as all longer ones
    halves[251] = halves[250]
    rows = np.column_stack([key << np.uint64(line_dedup._SIZE_BITS) | size.astype(np.uint64),
                            np.arange(n, dtype=np.uint64), halves])[rng.permutation(n)]
    got = [tuple(sorted(p)) for p in np.concatenate(line_dedup._meeting([rows[:99], rows[99:]])).tolist()]
    agree = {(a, b): int(line_dedup._equal_halves(halves[a:a + 1], halves[b:b + 1], line_dedup.BANDS * line_dedup.ROWS)[0])
             for a in range(n) for b in range(a + 1, n)
             if key[a] == key[b] and min(size[a], size[b]) >= line_dedup.SIMILARITY * max(size[a], size[b])}
    want = [p for p, v in agree.items() if v >= line_dedup.AGREE]
    sure = [p for p in want if agree[p] >= line_dedup.SURE]
    root = roots(n, sure)
    assert len(got) == len(set(got)) and set(got) <= set(want) and len(got) < len(want)
    assert {p for p in want if root[p[0]] != root[p[1]]} <= set(got)
    assert roots(n, [p for p in got if p in sure]) == root and (250, 251) in got
    assert line_dedup._meeting([rows[:0]]) == []
    assert line_dedup._sizes(["aé日😀".encode(), b"x"]).tolist() == [4, 1] and not len(line_dedup._sizes([]))


def test_distinct_lines_are_blocks_with_first_occurrence_and_signature(table):
    pairs = EDGE + [(100 + k, f"shared line\n  Shared   LINE \nonly {k * 7919} here\n\nx") for k in range(700)] + [(100, "x\nmore")]
    blocks = line_dedup.distinct_lines(table(pairs, parts=5))
    heads = line_dedup.line_heads(blocks).collect()
    plain = {}
    for i, t in pairs:
        for j, line in enumerate((t or "").encode().split(b"\n")):
            if line.split():
                plain.setdefault(b" ".join(line.lower().split()), []).append((-(1 << 63) if i is None else i, j))
    want = {tuple(np.frombuffer(line_dedup._digest(k), ">i8").tolist()): (len(v), *min(v), k) for k, v in plain.items()}
    assert len(heads) == len(want) == len({r.id for r in heads})
    assert {(r.h1, r.h2): (r.n, r.doc_id, r.line) for r in heads} == {k: v[:3] for k, v in want.items()}
    rows = blocks.collect()
    assert len(rows) < len(want)  # not a row a line
    got = {}
    for r in rows:
        half = np.frombuffer(r.half, np.uint64).reshape(-1, line_dedup._WORDS)
        size = np.frombuffer(r.size, np.uint32).tolist()
        values = []
        for k in range(line_dedup.BANDS):
            each = np.frombuffer(r[f"rest{k // line_dedup.BANDS_AT_ONCE}"], np.uint32).reshape(-1, line_dedup.BANDS_AT_ONCE)
            values.append(line_dedup._values(half, each[:, k % line_dedup.BANDS_AT_ONCE], k).tolist())
        got |= {r.id + i: (half[i].tolist(), size[i], [v[i] for v in values]) for i in range(len(half))}
    at = {(r.h1, r.h2): r.id for r in heads}
    lines = [v[3] for v in want.values()]
    rows = line_dedup.signatures(lines)
    halves, bands = line_dedup._halves(rows).tolist(), [set() for _ in range(line_dedup.BANDS)]
    for h, row, line, (fp, key) in zip(halves, rows.tolist(), lines, zip(line_dedup.line_prints(lines).tolist(), want)):
        half, size, values = got[at[key]]
        assert half == h and size == len(line.decode())
        for k, v in enumerate(values):  # equal values of a band stay equal, others apart
            bands[k].add((v, row[k]))
        assert next(r.fp for r in heads if r.id == at[key]) == fp
    assert all(len({v for v, _ in b}) == len({w for _, w in b}) == len(b) for b in bands)


def test_similar_lines_are_confirmed_near_the_diagonal_with_few_pieces(monkeypatch):
    rng = random.Random(16)

    def changed(t, part):
        return "".join(rng.choice(["", c, "#", c + "#"]) if rng.random() < part else c for c in t)

    x = ["".join(rng.choice("etaoin shrdlu\u00e9\u65e5") for _ in range(rng.choice([256, 257, 319, 320, 450, 700])))
         for _ in range(400)]
    y = [changed(t, rng.choice([0, 0.02, 0.1, 0.2, 0.4])) for t in x]
    y[:40] = [t[20:] + t[:20] for t in x[:40]]  # its way leaves the band's middle
    y[40:60] = ["".join(rng.sample(t, len(t))) for t in x[40:60]]
    x, y = zip(*((a, b) if k % 2 else (b, a) for k, (a, b) in enumerate(zip(x, y))))
    order = sorted(range(len(x)), key=lambda k: -len(x[k]) - len(y[k]))
    x, y = [x[k] for k in order], [y[k] for k in order]
    true = np.array([line_dedup.edit_distance(a, b) for a, b in zip(x, y)])
    size = np.array([(len(a), len(b)) for a, b in zip(x, y)])
    close = np.abs(size[:, 0] - size[:, 1]) < line_dedup._BAND // 2
    ways = line_dedup._in_band(*([t for t, c in zip(z, close) if c] for z in (x, y)))
    assert (ways >= true[close]).all() and (ways == true[close]).mean() > 0.9
    similar = true <= 0.2 * size.max(axis=1) + 1e-9
    assert 100 < similar.sum() < 350

    whole, nearest, passed, pieces = line_dedup._distances, line_dedup._nearest, [], []
    monkeypatch.setattr(line_dedup, "_distances", lambda a, b, bound: passed.extend(zip(a, b)) or whole(a, b, bound))
    monkeypatch.setattr(line_dedup, "_nearest", lambda x, start, *a: pieces.append(len(start)) or nearest(x, start, *a))
    monkeypatch.setattr(line_dedup, "_BAND_LETTERS", 0)
    assert line_dedup.all_similar(x, y).tolist() == similar.tolist()
    alike = {(a, b) for a, b, s in zip(x, y, similar) if s and max(len(a), len(b)) >= line_dedup._BANDED}
    assert len(alike & set(passed)) < 0.2 * len(alike)
    pieces.clear()
    k = [k for k in np.flatnonzero(true < 0.1 * size.max(axis=1)) if size[k].max() >= line_dedup._PIECEWISE]
    assert line_dedup.all_similar([x[i] for i in k], [y[i] for i in k]).all()
    assert 0 < sum(pieces) <= 3 * len(k)
