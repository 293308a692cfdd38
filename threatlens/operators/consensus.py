"""Report consensus and the verified-label tables (A8-A13, J8, S15, S16, SET3).

The reference runs one SQL query per (url, label) group plus two correlated
counts per group.  Here consensus is a single ``groupBy(url)`` with four
conditional counts (pending and all-time per label); the decisions of both
labels are mutually exclusive, so no second pass is needed.  Updates become
"read -> transform -> write a new snapshot".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import urls as U


def report_consensus(reports: DataFrame, safe_threshold: int = lists.SAFE_REPORT_THRESHOLD,
                     phishing_threshold: int = lists.PHISHING_REPORT_THRESHOLD) -> DataFrame:
    """A9 + J8: one row per URL with the four counts and the decision
    ('safe', 'phishing', 'conflict' = reached a threshold but contradicted,
    'pending' = below both thresholds).  Conflicting groups stay unprocessed."""
    lab = U.py_strip(F.lower(F.col("label")))
    pend = F.col("used_in_verify") == 0
    g = reports.groupBy("url").agg(
        F.count_if(pend & (lab == "safe")).alias("pending_safe"),
        F.count_if(pend & (lab == "phishing")).alias("pending_phishing"),
        F.count_if(F.col("label") == "safe").alias("all_safe"),
        F.count_if(F.col("label") == "phishing").alias("all_phishing"))
    return decided(g, safe_threshold, phishing_threshold)


def decided(counts: DataFrame, safe_threshold: int = lists.SAFE_REPORT_THRESHOLD,
            phishing_threshold: int = lists.PHISHING_REPORT_THRESHOLD) -> DataFrame:
    """``decision`` and ``report_count`` from the four counts of a URL."""
    safe_hit = F.col("pending_safe") >= safe_threshold
    phish_hit = F.col("pending_phishing") >= phishing_threshold
    safe_ok = safe_hit & (F.col("all_phishing") < phishing_threshold)
    phish_ok = phish_hit & (F.col("all_safe") < safe_threshold)
    decision = (F.when(safe_ok, F.lit("safe")).when(phish_ok, F.lit("phishing"))
                 .when(safe_hit | phish_hit, F.lit("conflict")).otherwise(F.lit("pending")))
    count = F.when(safe_ok, F.col("pending_safe")).when(phish_ok, F.col("pending_phishing"))
    return counts.withColumn("decision", decision).withColumn("report_count", count)


def newly_verified(consensus: DataFrame, verified_at) -> DataFrame:
    """Rows for ``verified_urls`` from a consensus result."""
    ts = verified_at if isinstance(verified_at, Column) else F.lit(verified_at).cast("timestamp")
    return (consensus.where(F.col("decision").isin("safe", "phishing"))
            .select("url", F.col("decision").alias("label"), F.col("report_count").cast("int").alias("report_count"),
                    ts.alias("verified_at"), F.lit(0).alias("used_in_train")))


def mark_reports_verified(reports: DataFrame, consensus: DataFrame) -> DataFrame:
    """A9 rewrite: every report of a verified (url, label) gets used_in_verify=1."""
    v = consensus.where(F.col("decision").isin("safe", "phishing")).select(
        F.col("url").alias("_vu"), F.col("decision").alias("_vl"))
    j = reports.join(v, (reports["url"] == F.col("_vu")) & (reports["label"] == F.col("_vl")), "left")
    return j.withColumn("used_in_verify", F.when(F.col("_vu").isNotNull(), F.lit(1))
                        .otherwise(F.col("used_in_verify"))).drop("_vu", "_vl")


def upsert_verified(current: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Insert-or-replace by url -- a replaced row is fully new
    (fresh verified_at, used_in_train back to 0)."""
    keep = current.join(new_rows.select("url"), "url", "left_anti")
    return keep.unionByName(new_rows.select(*current.columns))


def pending_training_rows(verified: DataFrame) -> DataFrame:
    """Verified URLs not yet used for training."""
    return verified.where(F.col("used_in_train") == 0).select("url", "label")


def mark_trained(verified: DataFrame, trained_urls: DataFrame) -> DataFrame:
    """A12 update: used_in_train=1 for the trained URLs."""
    t = trained_urls.select(F.col("url").alias("_tu")).distinct()
    j = verified.join(t, verified["url"] == F.col("_tu"), "left")
    return j.withColumn("used_in_train", F.when(F.col("_tu").isNotNull(), F.lit(1))
                        .otherwise(F.col("used_in_train"))).drop("_tu")


def verified_safe_domains(verified: DataFrame) -> DataFrame:
    """U3(c) hosts of verified, trained, safe URLs."""
    d = U.dynamic_host_of_netloc(U.netloc_of(F.col("url")))
    return (verified.where((F.col("label") == "safe") & (F.col("used_in_train") == 1))
            .select(d.alias("domain")).where(F.col("domain") != "").distinct())


def consensus_safe_domains(consensus: DataFrame) -> DataFrame:
    """Hosts added to the runtime allow-list right after a consensus run."""
    d = U.dynamic_host_of_netloc(U.netloc_of(F.col("url")))
    return consensus.where(F.col("decision") == "safe").select(d.alias("domain")).where(F.col("domain") != "")


def retrain_trigger(verified: DataFrame, min_new: int = lists.MIN_NEW_REPORTS_TO_RETRAIN) -> DataFrame:
    """One row -- pending count, how many more are needed, trigger flag."""
    n = pending_training_rows(verified).agg(F.count(F.lit(1)).alias("pending"))
    return n.select("pending", F.greatest(F.lit(0), F.lit(min_new) - F.col("pending")).alias("remaining"),
                    (F.col("pending") >= min_new).alias("trigger"))


def latest_log_row(log: DataFrame) -> DataFrame:
    """S16 read side: the newest retrain log row (by id)."""
    return log.agg(F.max_by(F.struct("triggered_at", "accuracy", "status"), F.col("id")).alias("last"))


def retrain_status(reports: DataFrame, verified: DataFrame, log: DataFrame) -> DataFrame:
    """A10: one row of watcher status counts (distinct URLs pending per label,
    verified per label, latest log entry, thresholds)."""
    r = reports.agg(
        F.count_distinct(F.when((F.col("label") == "safe") & (F.col("used_in_verify") == 0), F.col("url"))).alias("pending_safe_reports"),
        F.count_distinct(F.when((F.col("label") == "phishing") & (F.col("used_in_verify") == 0), F.col("url"))).alias("pending_phishing_reports"))
    v = verified.agg(F.count_if(F.col("label") == "safe").alias("verified_safe_urls"),
                     F.count_if(F.col("label") == "phishing").alias("verified_phishing_urls"))
    last = latest_log_row(log)
    # three one-row aggregates: combine by position (each has exactly one row)
    rk = r.withColumn("_k", F.lit(1))
    vk = v.withColumn("_k", F.lit(1))
    lk = last.withColumn("_k", F.lit(1))
    out = rk.join(vk, "_k").join(lk, "_k").drop("_k")
    return out.select(
        "pending_safe_reports", "pending_phishing_reports", "verified_safe_urls", "verified_phishing_urls",
        F.col("last.triggered_at").alias("last_triggered_at"), F.col("last.accuracy").alias("last_accuracy"),
        F.col("last.status").alias("last_status"),
        F.lit(lists.SAFE_REPORT_THRESHOLD).alias("safe_reports_needed"),
        F.lit(lists.PHISHING_REPORT_THRESHOLD).alias("phishing_reports_needed"),
        F.lit(lists.MIN_NEW_REPORTS_TO_RETRAIN).alias("min_to_trigger_retrain"),
        F.lit(lists.MIN_ACCURACY_TO_REPLACE).alias("min_accuracy_to_replace"))


def report_tally(reports: DataFrame, limit: int = 100) -> DataFrame:
    """Per (url, label) count, last report, processed flag, progress to
    the threshold; top ``limit`` by count then recency (url, label tie-break)."""
    g = reports.groupBy("url", "label").agg(
        F.count(F.lit(1)).alias("cnt"), F.max("timestamp").alias("last_report"),
        F.min("used_in_verify").alias("processed"))
    need = F.when(F.col("label") == "safe", F.lit(lists.SAFE_REPORT_THRESHOLD)).otherwise(F.lit(lists.PHISHING_REPORT_THRESHOLD))
    out = g.select("url", "label", "cnt", need.alias("needed"),
                   F.greatest(F.lit(0), need - F.col("cnt")).alias("remaining"),
                   (F.col("cnt") >= need).alias("verified"), (F.col("processed") == 1).alias("processed"),
                   "last_report")
    return out.orderBy(F.desc("cnt"), F.desc("last_report"), "url", "label").limit(limit)


def dynamic_allowlist(user_domains: DataFrame, consensus: DataFrame | None = None,
                      configured: DataFrame | None = None) -> DataFrame:
    """SET3: user-added hosts, report-verified safe hosts, configured hosts."""
    parts = [user_domains.select("domain")]
    if consensus is not None:
        parts.append(consensus_safe_domains(consensus))
    if configured is not None:
        parts.append(configured.select("domain"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.distinct()
