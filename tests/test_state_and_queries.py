"""Stateful operators against brute force, stream = batch, driver contract."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threatlens.streaming import jobs as sj
from threatlens.streaming import state as st


def _brute_throttle(rows, limit, window):
    logs, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        log = [x for x in logs.get(k, []) if (t - x).total_seconds() < window]
        limited = len(log) >= limit
        if not limited:
            log.append(t)
        logs[k] = log
        out[i] = limited
    return out


def _brute_ttl(rows, ttl):
    anchor, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        a = anchor.get(k)
        hit = a is not None and (t - a).total_seconds() < ttl
        if not hit:
            anchor[k] = t
        out[i] = hit
    return out


def _random_calls(n=3000, keys=7, hot=0.34, seed=3):
    rnd = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < hot else rnd.randrange(1, keys)   # one hot key holds a third of the rows
        rows.append((i, k, t0 + timedelta(seconds=rnd.randrange(0, 4 * 3600))))
    return rows


def test_throttle_matches_brute_force(spark):
    rows = _random_calls()
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp")
    got = {r.id: r.limited for r in st.throttle(df, "k", "ts", limit=30, window_s=60, num_partitions=4).collect()}
    assert got == _brute_throttle(rows, 30, 60)


def test_ttl_reuse_matches_brute_force(spark):
    rows = _random_calls(seed=5)
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp")
    got = {r.id: r.cache_hit for r in st.ttl_reuse(df, "k", "ts", ttl_s=300, num_partitions=3).collect()}
    assert got == _brute_ttl(rows, 300)


def test_windowed_stream_equals_batch(spark, sf_dir, tmp_path):
    from threatlens.sources.fixtures import fixture
    scans = fixture(spark, sf_dir, "scans").select("id", "url", "result", F.col("timestamp").cast("timestamp").alias("timestamp"))
    src = str(tmp_path / "scans")
    scans.write.parquet(src)
    batch = sorted(tuple(r) for r in sj.windowed_activity(scans).collect())
    out = str(tmp_path / "out")

    def sink(df, epoch_id):
        df.write.mode("append").parquet(out)

    q = sj.start_windowed_activity(spark, src, scans.schema, str(tmp_path / "ckpt"), sink, watermark="0 seconds")
    q.awaitTermination(180)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(
        "window_start", "window_end", "scans", "phishing").collect())
    # append mode emits a window once the watermark passes it: all but the last
    assert set(got) <= set(batch) and len(got) >= len(batch) - 1


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 1
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def _run_stream(spark, tmp_path, rows, build, kind="long"):
    """Rows in several files out of time order, then one far-off row that
    moves the watermark past all of them."""
    schema = f"id long, k {kind}, ts timestamp"
    src, out = str(tmp_path / "calls"), str(tmp_path / "out")
    random.Random(1).shuffle(rows)
    step = -(-len(rows) // 3)
    last = (-1, rows[0][1], max(r[2] for r in rows) + timedelta(days=2))
    for part in (rows[:step], rows[step:2 * step], rows[2 * step:], [last]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)

    def sink(b, epoch_id):
        b.write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # state store partitions of this small stream
    q = (build(stream).writeStream.outputMode("append").foreachBatch(sink)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(400)
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", prev)
    return spark.read.parquet(out).where("id >= 0")


def test_throttle_stream_equals_batch_out_of_order(spark, tmp_path):
    rows = [(i, k, t) for i, k, t in _random_calls(n=14000, keys=3, hot=0.9, seed=9)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp")
    got = _run_stream(spark, tmp_path, list(rows),
                      lambda s: st.throttle_stream(s, "k", "ts", "id", limit=30, window_s=60, delay="1 day"))
    got = sorted((r.id, r.limited) for r in got.collect())
    want = sorted((r.id, r.limited) for r in st.throttle(df, "k", "ts", limit=30, window_s=60, tie="id").collect())
    assert got == want and len(got) == 14000


def test_ttl_stream_equals_batch_with_text_keys(spark, tmp_path):
    rows = [(i, f"http://h{k}.test/", t) for i, k, t in _random_calls(n=900, keys=5, seed=12)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = _run_stream(spark, tmp_path, list(rows),
                      lambda s: st.ttl_reuse_stream(s, "k", "ts", "id", ttl_s=300, delay="1 day"), "string")
    got = sorted((r.id, r.cache_hit) for r in got.collect())
    assert got == sorted((r.id, r.cache_hit) for r in st.ttl_reuse(df, "k", "ts", ttl_s=300, tie="id").collect())


def test_watcher_ticks_and_retrain_log(spark, sf_dir, tmp_path):
    """A trained URL stays trained when an unrelated report comes in; a
    rejected or failed run leaves the published model alone."""
    from threatlens.operators import ml
    from threatlens.sources import sinks as sk
    root, reg, log = (str(tmp_path / n) for n in ("state", "models", "log"))
    t0 = datetime(2024, 1, 1)
    schema = "id long, url string, label string, note string, used_in_verify int, timestamp timestamp"
    rows = [(10 * u + k, f"http://u{u}.test/", "phishing", "", 0, t0) for u in range(5) for k in range(2)]
    reports = spark.createDataFrame(rows, schema)
    assert sj.watcher_tick(spark, reports, root, "v0") is True
    base = spark.createDataFrame([(f"https://site{k}.example/a", 0) for k in range(40)] +
                                 [(f"http://10.0.0.{k}/login/verify", 1) for k in range(40)], "url string, y int")
    real = ml.tree_classifier
    ml.tree_classifier = lambda kind="forest", seed=42: real(kind, seed).setNumTrees(10).setMaxDepth(4)
    try:
        assert ml.run_retrain(spark, base, reg, log, "r1", watcher=root).status == "done"
        assert ml.load_model(spark, reg).numFeatures == 43
        later = reports.unionByName(spark.createDataFrame([(99, "http://other.test/", "safe", "", 0, t0)], schema))
        assert sj.watcher_tick(spark, later, root, "v1") is False
        verified, used = sj.watcher_state(spark, root)
        assert {r.used_in_train for r in verified.collect()} == {1} and used.count() == len(rows)
        assert sj.watcher_tick(spark, later, root, "v1") is False  # a tick that runs again changes nothing
        assert ml.run_retrain(spark, base, reg, log, "r2", watcher=root, min_accuracy=1.1).status == "rejected_low_accuracy"
        assert ml.run_retrain(spark, base.select("y"), reg, log, "r3", watcher=root).status == "failed"
    finally:
        ml.tree_classifier = real
    assert sk.current_version(spark, reg) == "r1"
    events = {(r.run_id, r.seq): r.status for r in spark.read.parquet(log).collect()}
    assert events == {("r1", 0): "running", ("r1", 1): "done", ("r2", 0): "running", ("r2", 1): "rejected_low_accuracy",
                      ("r3", 0): "running", ("r3", 1): "failed"}


def test_scoring_stream_and_jobs(spark, sf_dir, tmp_path):
    """T1 stream = batch on the same requests; T2 writes a versioned feed
    snapshot; T3 one watcher tick matches the batch consensus."""
    from threatlens.plans import queries as Q
    from threatlens.plans import scoring as sc
    from threatlens.sources.fixtures import fixture
    from threatlens.sources import feeds as fd
    req = fixture(spark, sf_dir, "url_corpus").select(F.col("page_id").alias("id"), "url")
    src = str(tmp_path / "req")
    req.write.parquet(src)
    inputs = Q.scoring_inputs(spark, sf_dir)
    q = sj.start_scoring_stream(spark, src, req.schema, inputs, str(tmp_path / "verdicts"), str(tmp_path / "scans"),
                                str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    logged = spark.read.parquet(str(tmp_path / "scans"))
    assert {"timestamp", "date", "epoch"} <= set(logged.columns) and logged.count() > 0
    got = sorted((r.id, r.final_result) for r in spark.read.parquet(str(tmp_path / "verdicts")).collect())
    want = sorted((r.id, r.final_result) for r in sc.score_requests(req, inputs).collect())
    assert got == want and len(got) == req.count()

    lines = fixture(spark, sf_dir, "feed_lines")
    cat = lines.select("source", "format").distinct()
    paths = sj.refresh_feeds(lines, cat, str(tmp_path / "feeds"), "v1")
    u, d = fd.feed_sets(fd.parse_feed_lines(lines))
    assert spark.read.parquet(paths["feed_urls"]).count() == u.count()
    assert spark.read.parquet(paths["feed_domains"]).count() == d.count()
    root = str(tmp_path / "feeds")
    sj.refresh_feeds(lines.where("source = 'hosts'"), cat, root, "v2")
    assert sj.current_feeds(spark, root)[0].count() == 0 and sj.current_feeds(spark, str(tmp_path / "none")) is None

    reports = fixture(spark, sf_dir, "reports")
    empty = spark.createDataFrame([], "url string, label string, report_count int, verified_at timestamp, used_in_train int")
    verified, new_reports, trig = sj.watch_reports(reports, empty, "2024-02-01 00:00:00")
    from threatlens.operators import consensus as cs
    c = cs.report_consensus(reports)
    assert verified.count() == c.where(F.col("decision").isin("safe", "phishing")).count()
    assert trig.first()["pending"] == verified.count()
