"""Kept state: facts, consensus counts, the scan log, feed versions and the
commit log that publishes them."""

import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threatlens.operators import consensus as cs
from threatlens.operators import enrich as en
from threatlens.operators import matching as mt
from threatlens.operators import ml
from threatlens.operators import reduction as rd
from threatlens.operators import reporting as rp
from threatlens.sources import feeds as fd
from threatlens.sources import publish as pb
from threatlens.sources import scan_log as sl
from threatlens.sources.facts import FactStore
from threatlens.streaming import jobs as sj
from threatlens.streaming.consensus_state import ConsensusState


# ---- commit log -----------------------------------------------------------------

def test_one_of_two_writers_wins_and_no_update_is_lost(spark, tmp_path):
    root = str(tmp_path / "log")
    first = pb.publish(spark, root, "a", {"sum": 0}, after=None)
    pb.publish(spark, root, "b", {"sum": 1}, after=first)
    with pytest.raises(pb.Conflict):
        pb.publish(spark, root, "c", {"sum": 5}, after=first)
    with pytest.raises(pb.Conflict):
        pb.publish(spark, root, "d", after=None)
    assert pb.latest(spark, root) == pb.Commit(2, "b", {"sum": 1})

    def add(name):
        def change():
            last = pb.latest(spark, root)
            pb.publish(spark, root, name, {"sum": last.data["sum"] + 1}, after=last)
        pb.retried(change, attempts=200)

    threads = [threading.Thread(target=lambda k=k: [add(f"w{k}-{j}") for j in range(5)]) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert pb.latest(spark, root).data == {"sum": 21} and pb.numbers(spark, root) == list(range(1, 23))
    assert pb.is_committed(spark, root, "w3-4") and not pb.is_committed(spark, root, "c")


def test_trim_keeps_what_newer_commits_name(spark, tmp_path):
    root = str(tmp_path / "log")
    for k, folders in enumerate((["x", "y"], ["y"], ["y", "z"])):
        for f in folders:
            (tmp_path / "log" / f).mkdir(parents=True, exist_ok=True)
        pb.publish(spark, root, f"v{k}", {"f": folders})
    assert pb.trim(spark, root, 2, lambda c: c.data["f"]) == ["x"]
    assert not (tmp_path / "log" / "x").exists() and (tmp_path / "log" / "y").exists()
    assert pb.numbers(spark, root) == [2, 3] and pb.trim(spark, root, 2, lambda c: c.data["f"]) == []


# ---- semi-join reduction ------------------------------------------------------------

def test_bloom_filter_passes_all_asked_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    f = rd.bloom(keys, 5000)
    rows = spark.range(0, 105_000).select(F.concat(F.lit("k"), "id").alias("u"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "u string, id long"))
    out = f.passing(rows, F.col("u"))
    assert out.columns == ["u", "id"] and "Exchange hashpartitioning" not in _plan(out)
    got = out.agg(F.count_if(F.col("id").between(0, 4999)).alias("a"), F.count("*").alias("n")).first()
    assert got["a"] == 5000 and got["n"] - 5000 < 0.02 * 100_000
    assert rd.bloom(keys, 5000, max_bytes=1000) is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df):
    import contextlib
    import io
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def _pages(spark, n):
    return spark.range(n).select(F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".test/"), "id").alias("url"),
                                 F.lit("<title>paypal</title>").alias("html"))


@pytest.mark.parametrize("limit", [rd.BROADCAST_BYTES, 0])
def test_one_request_reads_its_own_pages_only(spark, monkeypatch, limit):
    """The HTML of the asked page alone is parsed, with keys and with a filter."""
    monkeypatch.setattr(rd, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame([("http://h7.test/7", "h7.test"), ("http://none.test/", "none.test")], "url string, host string")
    keys = en.asked_of(df)
    assert keys["urls"].n == 2 and keys["urls"].small == (limit > 0)
    cut = en.reduce_enrichment(en.Enrichment(pages=_pages(spark, 2000)), **keys)
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(html):
        parsed.add(1)
        return html
    facts = en.url_facts(en.Enrichment(pages=cut.pages.withColumn("html", seen(F.col("html")))))
    rows = facts.where("url = 'http://h7.test/7'").collect()
    assert len(rows) == 1 and rows[0].title_brand_mismatch and parsed.value <= 40
    assert limit == 0 or parsed.value == 1
    out = en.enrich_features(df, en.Enrichment(pages=_pages(spark, 2000)), "url").collect()
    assert sorted((r.url, r.title_brand_mismatch) for r in out) == [("http://h7.test/7", True), ("http://none.test/", False)]


# ---- kept facts ------------------------------------------------------------------------

def _sources(spark, state):
    """Enrichment tables from {table: rows}."""
    kinds = {"whois": "domain string, created_at date", "pages": "url string, html string",
             "redirects": "url string, hop_no int, target string", "resolutions": "domain string, ip string",
             "ip_geo": "ip string, cc string, proxy boolean, hosting boolean", "ct_entries": "root string, entry_id string"}
    return en.Enrichment(**{k: spark.createDataFrame(sorted(state.get(k, ())), s) for k, s in kinds.items()})


def test_updated_facts_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    day = datetime(2024, 1, 1).date()

    def rows(k):
        return {"whois": (f"d{k}.test", day - timedelta(rng.randrange(90))), "pages": (f"http://d{k}.test/", rng.choice(["", "<title>paypal</title>"])),
                "redirects": (f"http://d{k}.test/", rng.randrange(1, 4), f"http://x{rng.randrange(3)}.test/"),
                "resolutions": (f"d{k}.test", f"1.2.3.{k % 5}"), "ip_geo": (f"1.2.3.{k % 5}", rng.choice(["RU", "US"]), False, False),
                "ct_entries": (f"d{k}.test", f"e{rng.randrange(9)}")}
    state = {t: set() for t in rows(0)}
    for k in range(30):
        for t, r in rows(k).items():
            state[t].add(r)
    store = FactStore(spark, str(tmp_path / "facts"), buckets=3)
    store.build(_sources(spark, state))
    asked_for = spark.createDataFrame([(f"http://d{k}.test/", f"d{k}.test") for k in range(40)], "url string, host string")
    for step in range(3):
        changed = {t: set() for t in state}
        for k in rng.sample(range(40), [2, 25, 3][step]):
            for t, r in rows(k).items():
                old = rng.choice(sorted(state[t])) if state[t] and rng.random() < 0.4 else None
                if old:
                    state[t].discard(old)
                    changed[t].add(old)
                state[t].add(r)
                changed[t].add(r)
        now = _sources(spark, state)
        store.update(now, _sources(spark, changed))
        cut = [c for c in en.enrich_features(asked_for, now).columns]
        want = sorted(map(str, en.enrich_features(asked_for, now).select(cut).collect()))
        got = sorted(map(str, en.enrich_features(asked_for, None, store=store).select(cut).collect()))
        assert got == want
        big = rd.asked(asked_for, k=F.col("url"))["k"]
        big.n = 10**9  # by a join instead of literals
        assert sorted(map(str, store.lookup("url", big).collect())) == sorted(map(str, store.lookup("url", rd.asked(asked_for, k=F.col("url"))["k"]).collect()))
    entry = store.current().data["url"]
    other = FactStore(spark, str(tmp_path / "facts"), buckets=3)
    spark.sql(f"DROP TABLE {entry['base']['name']}")  # as in a session that did not write it
    assert other.lookup("url", rd.asked(asked_for, k=F.col("url"))["k"]).count() > 20


def test_facts_are_not_shuffled(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"), buckets=4)
    store.build(en.Enrichment(pages=_pages(spark, 3000)))
    keys = rd.asked(_pages(spark, 2000).select("url"), k=F.col("url"))["k"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _formatted(store.lookup("url", keys))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SelectedBucketsCount: 4 out of 4" in plan
    lines = plan[:plan.index("\n\n\n")].split("\n")  # the tree, then each operator's details
    at = next(k for k, x in enumerate(lines) if "facts_url_" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    above, level = [], depth(lines[at])
    for x in reversed(lines[:at]):  # the operators from the scan up to the root
        if depth(x) < level:
            above.append(x)
            level = depth(x)
    join = next(k for k, x in enumerate(above) if "Join" in x)
    assert not any("Exchange" in x for x in above[:join]) and any("Exchange" in x for x in lines)
    few = rd.asked(_pages(spark, 1).select("url"), k=F.col("url"))["k"]
    assert "EqualTo(url,http://h0.test/0)" in _formatted(store.lookup("url", few))  # selects buckets and row groups


# ---- kept consensus ------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_ticks_of_new_reports_equal_ticks_over_all(spark, tmp_path, seed):
    rng = random.Random(seed)
    at = datetime(2024, 1, 1)
    rows = [(k, f"http://u{rng.randrange(25)}.test/", rng.choice(["safe", "safe", "phishing"]), "", int(rng.random() < 0.1), at)
            for k in range(200)]
    ticks = [rng.randrange(4) for _ in rows]
    schema = "id long, url string, label string, note string, used_in_verify int, timestamp timestamp"
    root, state = str(tmp_path / "full"), ConsensusState(spark, str(tmp_path / "kept"), buckets=5)
    for k in range(4):
        new = spark.createDataFrame([r for r, t in zip(rows, ticks) if t == k], schema)
        seen = spark.createDataFrame([r for r, t in zip(rows, ticks) if t <= k], schema)
        when = f"2024-02-0{k + 1} 00:00:00"
        assert sj.watcher_tick(spark, seen, root, f"v{k}", when) == state.tick(new, f"v{k}", when, k)
        state.tick(new, f"v{k}", when, k)  # a tick that runs again changes nothing
        if k == 1:
            trained = state.verified().limit(3)
            some = spark.createDataFrame(trained.collect(), trained.schema)
            sj.mark_trained(spark, root, some, "t")
            state.mark_trained(some, "t")
    verified, used = sj.watcher_state(spark, root)
    cols = ["url", "label", "report_count", "verified_at", "used_in_train"]
    assert sorted(map(tuple, state.verified().select(cols).collect())) == sorted(map(tuple, verified.select(cols).collect()))
    log = spark.createDataFrame([(*r, t) for r, t in zip(rows, ticks)], schema + ", tick long")
    assert {r.id for r in state.used(log, "tick").where("used_in_verify = 1").collect()} == {r.id for r in used.collect()}
    assert state.totals()["used"] == used.count() and state.totals()["verified"] == verified.count()


def test_a_tick_reads_and_writes_touched_buckets_only(spark, tmp_path):
    state = ConsensusState(spark, str(tmp_path / "s"), buckets=16)
    schema = "url string, label string, used_in_verify int"
    state.tick(spark.createDataFrame([(f"http://u{k}/", "safe", 0) for k in range(200)] + [(None, "safe", 0)], schema), "v0")
    before = state._entries()[1]
    state.tick(spark.createDataFrame([("http://u3/", " SAFE ", 0)] * 2, schema), "v1", "2024-01-01")
    after = state._entries()[1]
    assert sum(before[b] != after[b] for b in after) == 1 and len(after) == 16
    assert [r.url for r in state.verified().collect()] == ["http://u3/"] and state.totals()["rows"] == 200
    state.tick(spark.createDataFrame([], schema), "v2")
    assert len(state.trim(1)) > 0 and state.counts().count() == 200


def test_watcher_stream_keeps_counts(spark, tmp_path):
    schema = "id long, url string, label string, note string, used_in_verify int, timestamp timestamp"
    src, root, called = str(tmp_path / "reports"), str(tmp_path / "state"), []
    rows = [(k, f"http://u{k % 6}.test/", "phishing", "", 0, datetime(2024, 1, 1)) for k in range(12)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    q = sj.start_report_watcher(spark, src, spark.createDataFrame([], schema).schema, root, str(tmp_path / "c"),
                                on_trigger=lambda s, r, v: called.append(v))
    q.awaitTermination(200)
    assert called == ["v0-trained"] and sj.verified_urls(spark, root).count() == 6


# ---- scan log ------------------------------------------------------------------------------

def _scans(spark, n, start=0):
    day = datetime(2024, 1, 1)
    rows = [(k, f"https://h{k % 7}.test/{k}" if k % 11 else "about:blank", ["SAFE", "PHISHING", "SUSPICIOUS"][k % 3], "a", "b", "c", k % 100, "N/A",
             day + timedelta(hours=k * 5 % 400) if k % 13 else None) for k in range(start, start + n)]
    return spark.createDataFrame(rows, sl.ROW)


def test_scan_log_appends_once_compacts_and_reads_newest_first(spark, tmp_path):
    log = sl.ScanLog(spark, str(tmp_path / "log"), max_folders=3)
    assert log.read().count() == 0 and log.recent().collect() == [] and sl.totals(log.partials()).first()["total"] == 0
    assert log.refresh() == [] and log.compact() == []
    for k in range(5):
        log.append(_scans(spark, 60, 60 * k), f"b{k}")
        log.append(_scans(spark, 60, 60 * k), f"b{k}")
    whole = _scans(spark, 300)
    kept = log.read().drop("date")
    from threatlens.sources.sinks import scan_log_filter
    want = scan_log_filter(whole)
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
    assert max(len(e["folders"]) for e in log.dates().values()) == 5
    assert log.compact() and max(len(e["folders"]) for e in log.dates().values()) <= 3 and log.compact() == []
    assert sorted(map(str, log.read().drop("date").collect())) == sorted(map(str, want.collect()))
    for k in (1, 20, 1000):
        assert log.recent(k).collect() == rp.recent_scans(want, k).collect()
        assert log.history(k).collect() == rp.history(want, k).collect()
    assert len(log.newest_dates(20)) <= 3 < len(log.dates())
    assert log.newest_dates(10**9)[-1] == sl.NULL_DATE


def test_kept_reports_are_refreshed_by_date(spark, tmp_path):
    log = sl.ScanLog(spark, str(tmp_path / "log"))
    log.append(_scans(spark, 200), "b0")
    assert set(log.refresh()) == set(log.dates()) and log.refresh() == []
    late = _scans(spark, 5, 500).withColumn("timestamp", F.lit(datetime(2024, 1, 3, 7)))
    log.append(late, "b1")
    assert log.refresh() == ["2024-01-03"]
    all_ = log.read()
    p = log.partials()
    assert sl.totals(p).collect() == rp.scan_totals(all_).collect()
    assert sl.kpis(p).collect() == rp.dashboard_kpis(all_).collect()
    dated = all_.where("date is not null")
    assert [tuple(r) for r in sl.daily(p, 30).where("day is not null").collect()] == [tuple(r) for r in rp.daily_activity(dated, 30).collect()]
    assert sl.top_domains(p).collect() == rp.top_phishing_domains(all_).collect()
    assert sorted(map(tuple, sl.windows(p).collect())) == sorted(map(tuple, sj.windowed_activity(dated).collect()))
    assert log.trim(1) and sl.totals(log.partials()).collect() == rp.scan_totals(all_).collect()


def test_scoring_stream_writes_the_log_and_keeps_each_requests_time(spark, tmp_path):
    from threatlens.plans import scoring as sc
    at = datetime(2024, 3, 1)
    rows = [(1, "http://10.0.0.1/login", at), (1, "http://10.0.0.1/login", at + timedelta(1)), (None, "http://b.test/", at + timedelta(2)),
            (None, "http://c.test/", at + timedelta(3)), (2, None, at)]
    req = spark.createDataFrame(rows, "id long, url string, timestamp timestamp")
    req.write.parquet(str(tmp_path / "req"))
    log = sl.ScanLog(spark, str(tmp_path / "log"))
    q = sj.start_scoring_stream(spark, str(tmp_path / "req"), req.schema, sc.ScoringInputs(), str(tmp_path / "v"), "", str(tmp_path / "c"), log=log)
    q.awaitTermination(200)
    got = spark.read.parquet(str(tmp_path / "v")).select("id", "url", "timestamp").collect()
    assert sorted((str(r.id), str(r.url), r.timestamp) for r in got) == sorted((str(i), str(u), t) for i, u, t in rows)
    assert log.read().count() == 4 and len(log.dates()) == 4


# ---- feeds ----------------------------------------------------------------------------------

def test_feed_changes_and_filter_rate(spark, tmp_path):
    root = str(tmp_path / "feeds")
    line = lambda ks: spark.createDataFrame([("s", "hosts_file", f"0.0.0.0 bad{k}.test") for k in ks], "source string, format string, line string")
    cat = spark.createDataFrame([("s", "hosts_file")], "source string, format string")
    sj.refresh_feeds(line(range(0, 300)), cat, root, "v0")
    hosts = spark.range(20_000).select(F.concat(F.lit("http://a.bad"), "id", F.lit(".test/")).alias("url"),
                                       F.concat(F.lit("a.bad"), "id", F.lit(".test")).alias("feed_host"))
    old = mt.feed_flags(hosts, *sj.current_feeds(spark, root))
    sj.refresh_feeds(line(range(100, 400)), cat, root, "v1")
    change = {r.domain: r.change for r in sj.feed_changes(spark, root)[1].collect()}
    assert change == {**{f"bad{k}.test": "removed" for k in range(100)}, **{f"bad{k}.test": "added" for k in range(300, 400)}}
    now = mt.reflagged(old, *sj.feed_changes(spark, root), *sj.current_feeds(spark, root))
    want = {f"a.bad{k}.test" for k in range(100, 400)}
    assert {r.feed_host for r in now.where("in_feed_domain").collect()} == want and now.count() == 20_000
    urls_, domains = sj.feed_filters(spark, root)
    filtered = mt.feed_flags(hosts, *sj.current_feeds(spark, root), urls_, domains)
    assert {r.feed_host for r in filtered.where("in_feed_domain").collect()} == want
    cand = hosts.select(F.explode(mt.feed_domain_candidates(F.col("feed_host"))).alias("domain"))
    passed = domains.passing(cand, F.col("domain")).count()
    assert cand.count() == 40_000 and 300 <= passed <= 300 + 0.02 * 40_000
    assert sj.feed_filters(spark, str(tmp_path / "none")) == (None, None)


# ---- splits and models ------------------------------------------------------------------------

def test_stratified_parts_are_exact(spark):
    rows = [(f"http://u{k}/", int(k % 10 == 0)) for k in range(333)] + [(f"http://u{k}/", 1) for k in range(5)] * 3 + [(None, 1)] * 2
    df = spark.createDataFrame(rows, "url string, y int")
    out = ml.stratified_folds(ml.stratified_split(df), 7).collect()
    assert len(out) == len(rows)
    first = {}
    for r in out:
        assert first.setdefault(r.url, (r.split, r.fold)) == (r.split, r.fold)  # copies stay together
    pos = {u for u, y in rows if y == 1 and u}
    for urls in (pos, {u for u, _ in rows if u} - pos):
        n = len(urls)
        assert sum(first[u][0] == "train" for u in urls) == int(n * 0.8 + 0.5)
        sizes = [sum(first[u][1] == k for u in urls) for k in range(7)]
        assert max(sizes) - min(sizes) <= 1
    assert ml.stratified_split(df.limit(0)).collect() == []


def test_models_inside_scoring(spark, monkeypatch):
    """A small boosted fit, a neural model and no model at all in the plan."""
    from threatlens.plans import scoring as sc
    base = spark.createDataFrame([(f"https://site{k}.example/a", 0) for k in range(30)] +
                                 [(f"http://10.0.0.{k}/login/verify", 1) for k in range(30)], "url string, y int")
    v = ml.feature_vectors(base, "url")
    tree = ml.tree_classifier("boosted").setMaxIter(5).setMaxDepth(3).fit(v)
    net = ml.neural_classifier().fit(v)
    req = spark.createDataFrame([(1, "http://10.0.0.9/login/verify"), (2, "https://site5.example/a"), (3, "  ")], "id long, url string")
    both = {r.id: r for r in sc.score_requests(req, sc.ScoringInputs(tree_model=tree, neural_model=net)).collect()}
    assert both[1].rf_result == "PHISHING" and both[2].rf_result == "SAFE" and both[1].rf_prob > 0.5 > both[2].rf_prob
    assert both[1].nn_result in ("PHISHING", "SAFE") and both[1].nn_prob is not None and both[3].final_result == "ERROR"
    own = ml.with_model_probability(ml.fz.featurize(req.where("id < 3"), "url"), net, "p").select("id", "p").collect()
    assert all(abs(both[r.id].nn_prob - r.p) < 1e-9 for r in own)
    none = {r.id: r for r in sc.score_requests(req, sc.ScoringInputs()).collect()}
    assert none[1].rf_result == none[1].rule_result and none[1].nn_result is None
    real = ml.tree_classifier
    monkeypatch.setattr(ml, "tree_classifier", lambda kind="forest", seed=42: real(kind, seed).setMaxIter(3).setMaxDepth(2))
    r = ml.retrain(base, spark.createDataFrame([("http://bad.test/login", "phishing")], "url string, label string"), kind="boosted")
    assert r.status == "done" and r.n_train + r.n_test == 65


def test_model_registry_survives_a_run_that_died(spark, tmp_path, monkeypatch):
    """A run that saved its model and died before publishing runs again."""
    base = spark.createDataFrame([(f"https://site{k}.example/a", 0) for k in range(20)] +
                                 [(f"http://10.0.0.{k}/login/verify", 1) for k in range(20)], "url string, y int")
    verified = spark.createDataFrame([("http://bad.test/login", "phishing")], "url string, label string")
    real = ml.tree_classifier
    monkeypatch.setattr(ml, "tree_classifier", lambda kind="forest", seed=42: real(kind, seed).setNumTrees(3).setMaxDepth(3))
    reg, log = str(tmp_path / "m"), str(tmp_path / "log")
    publish = ml.publish
    monkeypatch.setattr(ml, "publish", lambda *a, **k: 1 / 0)
    assert ml.run_retrain(spark, base, reg, log, "r1", verified=verified, min_accuracy=0.0).status == "failed"
    monkeypatch.setattr(ml, "publish", publish)
    assert ml.load_model(spark, reg) is None
    assert ml.run_retrain(spark, base, reg, log, "r1", verified=verified, min_accuracy=0.0).status == "done"
    assert ml.load_model(spark, reg).numFeatures == 43
