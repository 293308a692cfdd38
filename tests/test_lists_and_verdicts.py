"""Feeds, list matching, routing precedence, consensus and ensemble edges."""
from pyspark.sql import functions as F

from threatlens.operators import consensus as cs
from threatlens.operators import matching as mt
from threatlens.operators import verdict as vd
from threatlens.operators.featurize import featurize
from threatlens.plans import scoring as sc
from threatlens.sources import feeds as fd


def _feed(spark, rows):
    return fd.parse_feed_lines(spark.createDataFrame(rows, "source string, format string, line string"))


def test_feed_formats(spark):
    rows = [
        ("a", "url_per_line", "# http://x.test/"),          # no http prefix: dropped
        ("a", "url_per_line", "  http://Bad.Test:81/p.  "),   # stripped, trailing dot cut
        ("b", "hosts_file", "127.0.0.1 localhost"),            # needs a dot: dropped
        ("b", "hosts_file", "0.0.0.0 EVIL.test"),
        ("b", "hosts_file", "# 0.0.0.0 c.test"),
        ("c", "domain_per_line_skip_hash", "*.wild.test."),
        ("c", "domain_per_line_skip_hash", "www.google.com"),
        ("c", "domain_per_line_skip_hash", "nodot"),
        ("e", "url_per_line_skip_hash", "# only a comment"),
        ("f", "some_new_format", "http://new.test/x"),      # unknown formats are read as URLs
    ]
    p = _feed(spark, rows)
    got = sorted((r.source, r.kind, r.value) for r in p.collect())
    assert got == [("a", "domain", "bad.test"), ("a", "url", "http://Bad.Test:81/p"),
                   ("b", "domain", "evil.test"), ("c", "domain", "wild.test"), ("c", "domain", "www.google.com"),
                   ("f", "domain", "new.test"), ("f", "url", "http://new.test/x")]
    urls, domains = fd.feed_sets(p)
    assert sorted(r.domain for r in domains.collect()) == ["bad.test", "evil.test", "new.test", "wild.test"]  # brand guard
    lines = spark.createDataFrame(rows, "source string, format string, line string")
    stats = {r.source: (r["count"], r.status) for r in fd.feed_stats(lines, p, spark.createDataFrame(
        [("a", "url_per_line"), ("b", "hosts_file"), ("c", "domain_per_line_skip_hash"), ("d", "url_per_line"),
         ("e", "url_per_line_skip_hash")], "source string, format string")).collect()}
    assert stats == {"a": (1, "OK"), "b": (1, "OK"), "c": (2, "OK"), "d": (0, "HTTP ERR"), "e": (0, "OK")}


def test_feed_folders_with_spaces_and_unknown_sources(spark, tmp_path):
    for name, line in (("Abuse Feed (x.ch)", "http://a.test/x"), ("plus+100%", "http://b.test/"), ("nobody knows", "?")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "lines.txt").write_text(line + "\n")
    cat = spark.createDataFrame([("Abuse Feed (x.ch)", "url_per_line"), ("plus+100%", "url_per_line")],
                                "source string, format string")
    lines = fd.read_feed_folders(spark, str(tmp_path), cat)
    urls = {(r.source, r.value) for r in fd.parse_feed_lines(lines).where("kind = 'url'").collect()}
    assert urls == {("Abuse Feed (x.ch)", "http://a.test/x"), ("plus+100%", "http://b.test/")}
    assert [tuple(r) for r in fd.unknown_sources(lines).collect()] == [("nobody knows", 1)]


def test_allow_and_block_matching(spark):
    hosts = spark.createDataFrame([("x.github.io",), ("x.ok.test",), ("ok.test",), ("www.google.com",), ("test",),
                                   ("a.b.evil.test",), ("google.com",)], "host string")
    allow = mt.list_df(spark, ["github.io", "google.com"], "domain")
    s = {r.host for r in mt.static_allowlist_hits(hosts, allow).collect()}
    assert s == {"x.github.io", "www.google.com", "google.com"}
    dyn = mt.list_df(spark, ["ok.test"], "domain")
    d = {r.host for r in mt.dynamic_allowlist_hits(hosts, dyn).collect()}
    assert d == {"ok.test"}  # exact only, no parent walk
    feed_domains = mt.list_df(spark, ["evil.test", "test", "google.com"], "domain")
    b = {r.feed_host for r in mt.feed_domain_hits(hosts.withColumnRenamed("host", "feed_host"), feed_domains).collect()}
    assert b == {"a.b.evil.test"}  # single label never matched; brand guard
    feed_urls = mt.list_df(spark, ["https://google.com/evil", "http://x.test/a"], "url")
    u = spark.createDataFrame([("https://google.com/evil",), ("http://x.test/a//",), ("http://x.test/a/b",)], "url string")
    assert {r.url for r in mt.feed_url_hits(u, feed_urls).collect()} == {"https://google.com/evil", "http://x.test/a//"}


def test_routing_precedence(spark):
    req = spark.createDataFrame([(1, "https://ok.test/x"), (2, "https://bad.test/x"), (3, "http://localhost:5000/"),
                                 (4, ""), (5, "https://plain.example/")], "id long, url string")
    li = sc.ListInputs(static_allowlist=mt.list_df(spark, ["ok.test"], "domain"),
                       dynamic_allowlist=mt.list_df(spark, ["nothing.test"], "domain"),
                       feed_urls=mt.list_df(spark, ["https://nope.test/"], "url"),
                       feed_domains=mt.list_df(spark, ["ok.test", "bad.test"], "domain"))
    v = sc.score_requests(req, sc.ScoringInputs(lists=li))
    got = {r.id: (r.route, r.final_result, r.final_confidence) for r in v.collect()}
    assert got[1] == ("allowlist", "SAFE", 100)       # allow-list beats blocklist
    assert got[2] == ("blocklist", "PHISHING", 99)
    assert got[3] == ("skipped", "SAFE", 100)
    assert got[4][0:2] == ("error", "ERROR")
    assert got[5][0] == "scored"


def test_consensus_conflict_and_upsert(spark):
    rows = [(i, "u1", "safe", 0) for i in range(3)] + [(10 + i, "u1", "phishing", 0) for i in range(2)] \
        + [(20 + i, "u2", "phishing", 0) for i in range(2)] + [(30 + i, "u3", "safe", 0) for i in range(3)]
    rep = spark.createDataFrame(rows, "id long, url string, label string, used_in_verify int")
    c = {r.url: r.decision for r in cs.report_consensus(rep).collect()}
    assert c == {"u1": "conflict", "u2": "phishing", "u3": "safe"}
    marked = {(r.url, r.label): r.used_in_verify for r in cs.mark_reports_verified(rep, cs.report_consensus(rep)).collect()}
    assert marked[("u1", "safe")] == 0 and marked[("u1", "phishing")] == 0  # conflict stays unprocessed
    assert marked[("u2", "phishing")] == 1
    current = spark.createDataFrame([("u2", "phishing", 2, None, 1), ("u9", "safe", 3, None, 1)],
                                    "url string, label string, report_count int, verified_at timestamp, used_in_train int")
    up = {r.url: r.used_in_train for r in cs.upsert_verified(
        current, cs.newly_verified(cs.report_consensus(rep), "2024-02-01 00:00:00")).collect()}
    assert up == {"u2": 0, "u3": 0, "u9": 1}  # replace resets used_in_train


def test_votes_override_score(spark):
    df = spark.createDataFrame([("https://xn--a.paypa1.tk/",)], "url string")
    f = vd.with_rule_verdict(featurize(df, "url"))
    f = f.withColumn("rf_prob", F.lit(None).cast("double")).withColumn("nn_prob", F.lit(None).cast("double"))
    f = f.withColumn("vt_result", F.lit("UNAVAILABLE")).withColumn("vt_positives", F.lit(0)).withColumn("vt_prob", F.lit(0.0))
    r = vd.with_ensemble(vd.with_model_inputs(f)).first()
    assert (r.rule_score, r.rule_result, r.votes, r.result, r.risk.level) == (3, "SAFE", 5, "PHISHING", "MEDIUM")
    assert abs(r.weighted_score_raw - 0.0941) < 1e-3


def test_request_sources(spark, tmp_path):
    from threatlens.sources import files as fl
    p = tmp_path / "urls.txt"
    p.write_text("  http://a.test/x \n\n# http://b.test\nftp://c\nhttps://d.test\n")
    assert [r.url for r in fl.read_url_file(spark, str(p)).collect()] == ["http://a.test/x", "https://d.test"]
    j = tmp_path / "batch.json"
    j.write_text('{"urls": ["u%d"]}\n' % 0 + '{"urls": [%s]}\n' % ",".join(f'"v{i}"' for i in range(60)))
    assert fl.read_batch_requests(spark, str(j)).count() == 1 + 60
    b = fl.read_batch_requests(spark, str(j), per_batch=50)
    assert (b.count(), b.where("over_limit").count()) == (61, 10)
    assert {r.batch_id for r in b.collect()} == {r.batch_id for r in b.collect()}
    (tmp_path / "more.txt").write_text("http://x/\nhttp://y/\n")
    cut = fl.read_url_file(spark, str(tmp_path / "*.txt"), limit=1)
    assert sorted((r.url, r.over_limit) for r in cut.collect()) == [
        ("http://a.test/x", False), ("http://x/", False), ("http://y/", True), ("https://d.test", True)]


def test_neural_net_and_cross_validation(spark, sf_dir):
    """ML5/ML6 (standardise + 43-64-128-64-32-2 net) and ML8 (hash folds)."""
    from threatlens.operators import ml
    from threatlens.plans import queries as Q
    base = ml.encode_labels(Q._labelled_corpus(spark, sf_dir), "label", positive_label="phishing")
    vec = ml.feature_vectors(base, "url").select("url", "y", "features")
    model = ml.neural_classifier().fit(vec)
    pred = ml.with_probability(model.transform(vec))
    m = ml.evaluation(pred).first()
    assert m["tp"] + m["fp"] + m["tn"] + m["fn"] == vec.count()
    assert m["accuracy"] >= 0.9  # the variants are separable by the URL features
    from pyspark.ml.classification import RandomForestClassifier
    folds = ml.cross_validate(vec, RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=20, seed=42), 5)
    assert len(folds) == 5 and all(0.0 <= a <= 1.0 for a in folds)


def test_verdict_document(spark):
    """V11 messages (numbers filled in) and the V15 nested document."""
    import json
    req = spark.createDataFrame([(1, "http://a.b.c.d.e.f.paypal-login.tk/x"), (2, "https://ok.test/")], "id long, url string")
    li = sc.ListInputs(static_allowlist=mt.list_df(spark, ["ok.test"], "domain"))
    li.feed_domains = mt.list_df(spark, ["evil.test"], "domain")
    req = req.unionByName(spark.createDataFrame([(3, "https://a.evil.test/"), (4, "http://localhost:5000/"), (5, "")], "id long, url string"))
    v = sc.score_requests(req, sc.ScoringInputs(lists=li))
    docs = {r.id: json.loads(r.verdict_json) for r in sc.verdict_document(v, gsb_known=True).collect()}
    d1 = docs[1]
    assert d1["result"] == "PHISHING" and d1["risk"]["level"] in ("MEDIUM", "HIGH", "CRITICAL")
    assert "Unusually high subdomain depth (6 levels)" in d1["reasons"]
    assert "Domain uses a high-risk TLD" in d1["reasons"]
    assert set(d1["models"]) == {"random_forest", "lstm", "virustotal", "google_safebrowsing"}
    assert d1["models"]["google_safebrowsing"] == "SAFE" and len(d1["features"]) == 43
    assert docs[2]["whitelisted"] is True and docs[2]["whitelist_source"] == "static_whitelist"
    assert set(docs[2]["models"].values()) == {"SAFE"} and docs[2]["reasons"] == []
    assert docs[2]["risk"]["level"] == "SAFE" and docs[2]["virustotal"]["vt_ratio"] == "0/0"
    assert set(docs[3]["models"].values()) == {"PHISHING"} and docs[3]["risk"]["level"] == "CRITICAL"
    assert docs[3]["reasons"] == ["Found in threat intelligence blocklist"] and docs[3]["source"] == "Threat feed blocklist"
    assert docs[4]["skipped"] is True and docs[4]["risk"]["level"] == "SAFE" and "models" not in docs[4]
    assert docs[5]["error"] == "Empty url" and docs[5]["result"] == "ERROR"


def test_engine_total_counts_every_entry(spark):
    from threatlens.operators import enrich as en
    stats = spark.createDataFrame([("http://a.test/", {"malicious": 1, "harmless": 60, "undetected": 8, "timeout": 1}),
                                   ("http://b.test/", {})], "url string, stats map<string,int>")
    f = featurize(spark.createDataFrame([("http://a.test/",), ("http://b.test/",)], "url string"), "url",
                  en.Enrichment(reputation=stats))
    got = {r.url: (r.vt_result, r.vt_ratio) for r in f.collect()}
    assert got == {"http://a.test/": ("PHISHING", "1/70"), "http://b.test/": ("SAFE", "0/1")}
