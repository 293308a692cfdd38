import re

import pytest

import corpus_pipeline
from threatlens.llm import exact_dedup, secret_scan, simhash
from threatlens.llm.oracles import ORACLES
from threatlens.llm.queries import QUERIES
from threatlens.llm.secret_scan import RULES, trigram_query

from .conftest import EDGE, prose


def plain_spans(text):
    out = []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace(r"(?i:password|passwd|secret|token|api_?key)",
                                    "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                                                     for w in ("password", "passwd", "secret", "token", "api_?key")) + ")")
        for m in re.finditer(pattern, text or ""):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), k, m.end()))
    return [(a, RULES[k].kind, b) for a, k, b in sorted(out)]


HEX = "0123456789abcdef" * 2
CASES = EDGE + [(20, f"😀 x API_KEY='{HEX}' y"), (21, "secret:token:abcdefgh"), (22, "Token = abc passwd=abcdef"),
                (23, "AKIA" + "Q" * 15), (24, "AKIA" + "Q" * 16 + " AKIA" + "9" * 30), (25, HEX[:23] + "g" + HEX[:24]),
                (26, "ghp_" + "a" * 36 + " xoxb-" + "1" * 10 + " -----BEGIN RSA PRIVATE KEY-----"),
                (27, "paſſword=abcdefg Key toKen=abcdefg"), (28, "password=abcdef " * 700),
                (29, "eyJabcdefghij.eyJabcdefghij.abcdefghij"), (30, f"{HEX}token={HEX}"),
                (31, prose(900, 4) + " password\n=abcdef pass word=abcdef")]


def test_scan_matches_plain(table):
    rows = secret_scan.scan(table(CASES)).collect()
    assert len(rows) == len(CASES)
    want = {}
    for i, t in CASES:
        want.setdefault(i, plain_spans(t))
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in r.spans] == want[r.doc_id]
    assert secret_scan.scan(table([])).count() == 0


def test_every_plain_match_is_a_candidate():
    queries = {r.kind: trigram_query(r.pattern) for r in RULES}
    for _, text in CASES:
        for a, kind, b in plain_spans(text):
            found = text[a:b].lower()
            assert not queries[kind] or any(all(g in found for g in way) for way in queries[kind])


def test_rules_without_trigrams_scan_fully():
    assert trigram_query(r"[0-9a-f]{24,}") == [] and trigram_query(r"ab.c|x") == []
    assert set(trigram_query(r"key_?id")) == {frozenset({"key", "ey_", "y_i", "_id"}), frozenset({"key", "eyi", "yid"})}


def test_redact_masks_all_spans_and_nothing_else(table):
    df = table(CASES)
    out = secret_scan.redact(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r for r in out.collect()}
    for i, t in CASES:
        merged, want, at = [], "", 0
        for a, _, b in plain_spans(t):
            if merged and a < merged[-1][1] or merged and a == merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            want, at = want + t[at:a] + secret_scan.MASK, b
        want = None if t is None else want + t[at:]
        assert texts[i].text == want
        assert texts[i].n_chars == (None if t is None else len(want))


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert len(QUERIES) == 13 and set(ORACLES) <= set(QUERIES)
    assert [s for s, _ in corpus_pipeline.STAGES] == [
        "language", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == sorted(map(str, want.fetchall()))


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "exact_dedup":
            strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
            groups = {}
            for i, t in before.items():
                groups.setdefault(strip(t), []).append((-len(t), i))
            assert set(after) == {min(g)[1] for g in groups.values()}
        elif name == "simhash_near_dedup":
            assert set(after) <= set(before)
        elif name == "secret_scan":
            assert set(after) == set(before)
            assert all(after[i] == t for i, t in before.items() if not plain_spans(t))
            assert not any(plain_spans(t) for t in after.values())
        else:
            assert len(after) >= 0.98 * len(before)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(after) <= set(kept)


def test_pipeline_on_edge_rows(spark, table, sf_dir):
    """Null ids and texts, blanks, repeated rows, a very long text, clashing columns."""
    docs = table(EDGE + [(None, "no id"), (12, None)])
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        kept.append((name, docs.collect()))
    rows = dict(kept)
    assert all(r.text and any(c.isalpha() for c in r.text) for r in rows["language"])
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    assert sorted(strip(r.text) for r in rows["exact_dedup"]) == sorted({strip(r.text) for r in rows["language"]})
    assert len(rows["secret_scan"]) == len(rows["simhash_near_dedup"]) <= len(rows["exact_dedup"])
    assert not any(plain_spans(r.text) for r in rows["secret_scan"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in rows["secret_scan"]}


def test_pipeline_on_an_empty_table(spark, table, sf_dir):
    docs = table([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_filters_agree_with_their_reports(spark, table):
    df = table(CASES)
    reps = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == reps
    assert exact_dedup.keep_one(df).count() == exact_dedup.classes(df).select("text_sha256").distinct().count()
