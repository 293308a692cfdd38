"""Structured Streaming jobs.

Each job reuses the batch operators unchanged: a micro-batch is a DataFrame,
so ``foreachBatch`` applies the same plan; windowed counts use event-time
windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consensus as cs
from ..operators.reduction import Bloom, bloom
from ..plans import scoring as sc
from ..sources import feeds as fd
from ..sources import sinks as sk
from ..sources.publish import latest, publish
from .consensus_state import ConsensusState


def windowed_activity(scans: DataFrame, ts: str = "timestamp", window: str = "1 day") -> DataFrame:
    """T6 (batch or stream): scans and phishing per event-time window,
    internal pages excluded as in the daily report."""
    from ..functions import urls as U
    s = scans.where(U.not_ilike_any(F.col("url"), ["http://localhost%", "chrome://%"]))
    g = s.groupBy(F.window(F.col(ts), window).alias("w")).agg(
        F.count(F.lit(1)).alias("scans"),
        F.sum(F.when(F.col("result") == "PHISHING", 1).otherwise(0)).alias("phishing"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "scans", "phishing")


def start_windowed_activity(spark: SparkSession, scans_dir: str, schema, checkpoint: str, sink,
                            watermark: str = "1 day", available_now: bool = True):
    """T6 stream: parquet scan-log folder -> watermark -> daily counts,
    appended once a window closes.  ``sink`` is a format name or a
    ``foreachBatch`` function."""
    stream = spark.readStream.schema(schema).parquet(scans_dir)
    stream = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    out = windowed_activity(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    out = out.foreachBatch(sink) if callable(sink) else out.format(sink)
    out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime="1 minute")
    return out.start()


def start_scoring_stream(spark: SparkSession, requests_dir: str, schema, inputs, verdicts_out: str, scans_out: str,
                         checkpoint: str, available_now: bool = True, log=None):
    """Request files -> full verdict per row (same plan as batch) ->
    verdict table, and the scan log from that table, one micro-batch at a time.

    ``inputs`` is a :class:`ScoringInputs` or a function of the session that
    builds one; the function runs for every batch, so a batch sees the lists
    that were current when it began.  A batch owns the folder ``epoch=<id>``
    of each table: one that is run again replaces what it wrote.  Requests
    without a ``timestamp`` get the batch's.  With ``log`` (a
    :class:`threatlens.sources.scan_log.ScanLog`) the scans go there instead.
    """
    def batch(df: DataFrame, epoch_id: int):
        session = df.sparkSession
        given = inputs(session) if callable(inputs) else inputs
        if "timestamp" not in df.columns:
            df = df.withColumn("timestamp", F.current_timestamp())
        df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        v = sc.score_requests(df, given, keep=("timestamp",))
        v.select(*VERDICT_COLUMNS).write.mode("overwrite").parquet(f"{verdicts_out}/epoch={epoch_id}")
        written = session.read.parquet(f"{verdicts_out}/epoch={epoch_id}")
        if log is not None:
            log.append(sc.scan_log_rows(written), f"epoch-{epoch_id}")
        else:
            sk.append_scans(sc.scan_log_rows(written), f"{scans_out}/epoch={epoch_id}", mode="overwrite")

    w = spark.readStream.schema(schema).parquet(requests_dir).writeStream.foreachBatch(batch) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


VERDICT_COLUMNS = ["id", "url", "timestamp", "route", "final_result", "final_confidence", "risk_level", "reasons",
                   "rf_result", "nn_result", "vt_result", "vt_ratio"]


def refresh_feeds(lines: DataFrame, catalog: DataFrame, out_root: str, version: str) -> dict[str, str]:
    """Build the feed sets and stats from the latest lines, write them
    under a new version and publish it (whole-set swap, never a partial
    update).  With each set go what was added and removed since the version
    before (``feed_urls_changes``, ``feed_domains_changes``) and a membership
    filter, as far as one fits (:class:`threatlens.operators.reduction.Bloom`).
    """
    spark = lines.sparkSession
    parsed = fd.parse_feed_lines(lines)
    sets = dict(zip(("feed_urls", "feed_domains"), fd.feed_sets(parsed)))
    before = current_feeds(spark, out_root)
    paths = {k: f"{out_root}/{k}/version={version}" for k in (*sets, "feed_stats")}
    data = {}
    for at, (k, entries) in enumerate(sets.items()):
        entries.write.mode("overwrite").parquet(paths[k])
        now = spark.read.parquet(paths[k])
        key = now.columns[0]
        old = before[at] if before else now.limit(0)
        fd.changes(old, now, key).write.mode("overwrite").parquet(f"{out_root}/{k}_changes/version={version}")
        n = now.count()
        filter_ = bloom(now.select(F.col(key).alias("key")), n)
        if filter_ is not None:
            filter_.table.write.mode("overwrite").parquet(f"{out_root}/{k}_filter/version={version}")
        data[k] = {"entries": n, "blocks": filter_.blocks if filter_ else None}
    fd.feed_stats(lines, parsed, catalog).write.mode("overwrite").parquet(paths["feed_stats"])
    publish(spark, out_root, version, data)
    return paths


def feed_filters(spark: SparkSession, out_root: str) -> tuple[Bloom | None, Bloom | None]:
    """The published feed's membership filters (URLs, domains)."""
    now = latest(spark, out_root)
    out = []
    for k in ("feed_urls", "feed_domains"):
        blocks = now.data.get(k, {}).get("blocks") if now else None
        out.append(Bloom(spark.read.parquet(f"{out_root}/{k}_filter/version={now.version}"), blocks) if blocks else None)
    return tuple(out)


def feed_changes(spark: SparkSession, out_root: str) -> tuple[DataFrame, DataFrame]:
    """What the published version added to and removed from the one before."""
    version = sk.current_version(spark, out_root)
    return tuple(spark.read.parquet(f"{out_root}/{k}_changes/version={version}") for k in ("feed_urls", "feed_domains"))


def current_feeds(spark: SparkSession, out_root: str) -> tuple[DataFrame, DataFrame] | None:
    """The published feed URLs and domains, or None before the first refresh."""
    version = sk.current_version(spark, out_root)
    if version is None:
        return None
    return tuple(spark.read.parquet(f"{out_root}/{k}/version={version}") for k in ("feed_urls", "feed_domains"))


def watch_reports(reports: DataFrame, verified: DataFrame, verified_at):
    """T3 (one watcher tick): consensus -> verified upsert -> report flags ->
    trigger check.  Returns (new verified table, new reports table, trigger row)."""
    c = cs.report_consensus(reports)
    new_verified = cs.upsert_verified(verified, cs.newly_verified(c, verified_at))
    new_reports = cs.mark_reports_verified(reports, c)
    return new_verified, new_reports, cs.retrain_trigger(new_verified)


VERIFIED = "url string, label string, report_count int, verified_at timestamp, used_in_train int"


def watcher_state(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The published verified URLs and the ids of the reports used for them."""
    version = sk.current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], VERIFIED), spark.createDataFrame([], "id long")
    return spark.read.parquet(f"{root}/{version}/verified"), spark.read.parquet(f"{root}/{version}/used_reports")


def _publish(verified: DataFrame, used: DataFrame, root: str, version: str) -> None:
    sk.write_snapshot(verified, f"{root}/{version}/verified")
    sk.write_snapshot(used, f"{root}/{version}/used_reports")
    sk.commit_version(verified.sparkSession, root, version)


def watcher_tick(spark: SparkSession, reports: DataFrame, root: str, version: str, verified_at=None) -> bool:
    """One tick over the whole report table and the published state; the
    new verified URLs and the report flags are published together under
    ``version`` (nothing happens if it is published already).  Returns the
    trigger."""
    if not sk.is_committed(spark, root, version):
        verified, used = watcher_state(spark, root)
        flagged = reports.join(used.select(F.col("id").alias("_used")), F.col("id") == F.col("_used"), "left")
        flagged = flagged.withColumn("used_in_verify", F.when(F.col("_used").isNotNull(), F.lit(1))
                                     .otherwise(F.col("used_in_verify"))).drop("_used")
        new_verified, new_reports, _ = watch_reports(flagged, verified, verified_at or F.current_timestamp())
        _publish(new_verified, new_reports.where(F.col("used_in_verify") == 1).select(F.col("id").cast("long")),
                 root, version)
    return bool(cs.retrain_trigger(watcher_state(spark, root)[0]).first()["trigger"])


def verified_urls(spark: SparkSession, root: str) -> DataFrame:
    """The verified URLs of a watcher, of kept counts or of whole tables."""
    return ConsensusState(spark, root).verified() if _keeps_counts(spark, root) else watcher_state(spark, root)[0]


def _keeps_counts(spark: SparkSession, root: str) -> bool:
    last = latest(spark, root)
    return last is not None and "buckets" in last.data


def mark_trained(spark: SparkSession, root: str, trained: DataFrame, version: str) -> None:
    """A12 after a retrain: publish the state with the trained URLs marked."""
    if _keeps_counts(spark, root):
        ConsensusState(spark, root).mark_trained(trained, version)
        return
    verified, used = watcher_state(spark, root)
    _publish(cs.mark_trained(verified, trained), used, root, version)


def start_report_watcher(spark: SparkSession, reports_dir: str, schema, root: str, checkpoint: str,
                         on_trigger=None, interval: str = "30 minutes", available_now: bool = True):
    """T3 stream: every tick counts the new reports and decides the URLs that they
    name (:class:`ConsensusState`); when enough verified URLs wait,
    ``on_trigger(session, root, version)`` starts the retrain (see
    :func:`threatlens.operators.ml.run_retrain`)."""
    def tick(new_reports: DataFrame, epoch_id: int):
        session = new_reports.sparkSession
        due = ConsensusState(session, root).tick(new_reports, f"v{epoch_id}", ordinal=epoch_id)
        if due and on_trigger is not None:
            on_trigger(session, root, f"v{epoch_id}-trained")

    w = spark.readStream.schema(schema).parquet(reports_dir).writeStream.foreachBatch(tick) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
