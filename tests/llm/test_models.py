import zlib
from dataclasses import replace

import numpy as np
import pytest

from threatlens.llm import langid, quality, topk
from threatlens.sources.tables import read_table

from .conftest import EDGE


def test_language_id_on_held_out_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    out = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert out.score.between(0, 1).all() and out.rejected.mean() < 0.02


def test_language_id_edges(table):
    model = langid.fit(["der hund und die katze"] * 20 + ["the dog and the cat"] * 20, ["de"] * 20 + ["en"] * 20)
    rows = langid.predict(table(EDGE + [(70, "1234 !?")]), model).collect()
    assert len(rows) == len(EDGE) + 1
    for r in rows:
        if r.doc_id in (1, 2, 3, -4, 70):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("de", "en")
    df = table([(1, "the dog and the cat"), (2, None)])
    kept = langid.keep_recognised(df, model)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]


def test_language_id_rejects_below_the_calibrated_score_of_two_languages(table):
    words = {"de": "der hund und die katze sitzt auf dem haus mit einem ball".split(),
             "en": "the dog and the cat sits on the house with a ball".split()}
    text = lambda x, k: " ".join(words[x][(k * j + k + j) % len(words[x])] for j in range(12))
    for n in (200, 8):  # a calibration part, and folds
        langs = ["de", "en"] * (n // 2)
        model = langid.fit([text(x, k) for k, x in enumerate(langs)], langs)
        assert model.threshold.min() >= 0.5 - 1e-4 and model.threshold[3] > 0.6
        blank = replace(model, table=model.table * 0, bias=model.bias * 0)  # one half for each language
        assert langid.keep_recognised(table([(1, text("en", 1))]), blank).count() == 0
        clean = table([(k, text("de" if k % 2 else "en", 1 + k)) for k in range(40)])
        assert langid.keep_recognised(clean, model).count() >= (39 if n == 200 else 20)


def test_language_id_without_labels(table):
    df = table([(1, "some text"), (2, "more")])
    model = langid.train(df)
    assert {r.lang_pred for r in langid.predict(df, model).collect()} == {"und"}
    assert langid.predict(table([]), model).count() == 0


def test_word_table_and_direct_scores_agree():
    import pyarrow as pa

    from threatlens.llm.common import text_buffer

    texts = ["the Cat sat", "un café très long mots extraordinairement", "漢字 😀 mixed Ünïcode", "", "12"]
    model = langid.fit(["the cat"] * 20 + ["le café"] * 20, ["en"] * 20 + ["fr"] * 20)
    data, off = text_buffer(pa.array(texts))
    own = langid.Predictor(model)
    first, _ = own.logits(data, off)
    again, _ = own.logits(data, off)
    low, starts, lens, row = langid.split_words(data, off)
    direct = langid._logits(model, low, starts, lens, row, len(texts))
    assert np.allclose(first, again) and np.allclose(first, direct, atol=1e-4)


def test_quality_on_held_out_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels")
    out = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]]
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_edges(spark, table):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    forest = quality.train(table(EDGE), labels)
    rows = quality.score(table(EDGE), forest).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.score(table([]), forest).count() == 0


def test_statistics_of_plain_text():
    text = b"Aa b1.\nAa b1.\n\nc!"
    x = dict(zip(quality.FEATURES, quality.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]))
    assert np.isclose(x["log_words"], np.log1p(5)) and np.isclose(x["log_lines"], np.log1p(4))
    assert np.isclose(x["distinct_words"], 3 / 5) and np.isclose(x["share_digit"], 2 / len(text))
    assert np.isclose(x["distinct_lines"], 3 / 4) and np.isclose(x["word_len"], 12 / 5)


def test_forest_walk_equals_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)
    s = forest.score(x)
    assert ((s >= 0.5) == y).mean() > 0.95
    for k in range(0, 400, 57):
        z = forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[k, f[node]] > c[node])
            z += leaf[node - len(f)]
        assert np.isclose(s[k], 1 / (1 + np.exp(-z)))


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k_matches_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=6).round(1).tolist()) for k in range(0, 400)]
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (700, [0.5, 0.25])]
    rows += [(750 + k, [2.0] * 6) for k in range(60)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    good = {i: np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v)))).astype(int)
            for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in good:
        if q % 50 == 0:
            s = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
            want |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    got = topk.top_k(df, block_queries=block).collect()
    assert len(got) == len(want) and {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want


def test_top_k_with_null_and_repeated_ids_matches_plain_and_sql(spark):
    import duckdb

    from threatlens.llm.oracles import ORACLES

    rng = np.random.default_rng(8)
    rows = [(int(i) if i >= 0 else None, rng.normal(size=4).round(1).tolist()) for i in rng.integers(-8, 60, 150)]
    rows += [(1, [0.5] * 4), (1, [0.9] * 4), (None, [2.0] * 4), (None, [2.0] * 4), (50, [1.0] * 4), (50, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, rid int").repartition(4)
    v = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    want = []
    for a, (q, _) in enumerate(rows):
        if q is not None and q % 50 == 0:
            best = sorted((-int(v[a] @ v[b]), i is not None, i or 0, b) for b, (i, _) in enumerate(rows) if b != a)[:5]
            want += [(q, r + 1, rows[b][0], -x) for r, (x, _, _, b) in enumerate(best)]
    got = [tuple(r) for r in topk.top_k(df, block_queries=2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(map(str, con.execute(ORACLES["op6_exact_top_k"]).fetchall())) == sorted(map(str, want))


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [0.5])], schema)
    assert [(r["rank"], r.vec_id) for r in topk.top_k(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
