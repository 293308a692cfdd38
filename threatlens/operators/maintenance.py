"""Scan-log maintenance (M1-M3): purge jobs that produce a new snapshot and a
per-rule report.  Each row is tagged with the first rule that removes it, in
one projection, so the purge and its report come from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import urls as U


def purge_rule(scans: DataFrame) -> DataFrame:
    """Adds ``purge_rule``: 'allowed_domain' (M1) or the matching LIKE
    pattern (M2, case-insensitive like SQLite), NULL when the row stays."""
    host = U.host_of_netloc(U.netloc_of(F.col("url")))
    m1 = (F.col("result") == "PHISHING") & (host.isin(lists.PURGE_ALLOWED_DOMAINS)
                                           | U.strip_www(host).isin(lists.PURGE_ALLOWED_DOMAINS))
    rule = F.when(m1, F.lit("allowed_domain"))
    for p in lists.PURGE_INTERNAL_PATTERNS:
        rule = rule.when(F.col("url").ilike(p), F.lit(p))
    return scans.withColumn("purge_rule", rule)


def purge(scans: DataFrame) -> DataFrame:
    """M1 + M2: the scan log without purged rows."""
    return purge_rule(scans).where(F.col("purge_rule").isNull()).drop("purge_rule")


def purge_report(scans: DataFrame) -> DataFrame:
    """M3: rows removed per rule."""
    t = purge_rule(scans).where(F.col("purge_rule").isNotNull())
    return t.groupBy("purge_rule").agg(F.count(F.lit(1)).alias("removed"))
