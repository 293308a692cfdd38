"""Scan-log reporting.

All aggregates are single-pass conditional aggregations (partial + final
HashAggregate); top-k reports use ``orderBy(...).limit(k)``, which plans as
TakeOrderedAndProject (a per-partition top-k, then a merge of k rows each) --
no global sort.  Ties get a deterministic tie-break column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

_LOCAL = ["http://localhost%"]
_BROWSER = ["chrome://%", "about:%"]


def scan_totals(scans: DataFrame) -> DataFrame:
    """A1: total, phishing, suspicious, safe = rest, rate in percent (1 dp)."""
    t = scans.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col("result") == "PHISHING").alias("phishing"),
                  F.count_if(F.col("result") == "SUSPICIOUS").alias("suspicious"))
    return with_rate(t)


def with_rate(t: DataFrame) -> DataFrame:
    """A1 from its three counts."""
    return t.select("total", "phishing", "suspicious",
                    (F.col("total") - F.col("phishing") - F.col("suspicious")).alias("safe"),
                    F.when(F.col("total") > 0,
                           # 1 place, half up on the binary value: same formula in every engine
                           F.floor(F.col("phishing") / F.col("total") * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(10.0))
                     .otherwise(F.lit(0.0)).alias("phishing_rate"))


def dashboard_kpis(scans: DataFrame) -> DataFrame:
    """A2: counts over non-internal scans; SAFE counted directly."""
    s = scans.where(U.not_ilike_any(F.col("url"), _LOCAL + _BROWSER))
    r = F.col("result")
    return s.agg(F.count(F.lit(1)).alias("total"),
                 F.coalesce(F.sum(F.when(r == "PHISHING", 1).otherwise(0)), F.lit(0)).alias("phishing"),
                 F.coalesce(F.sum(F.when(r == "SAFE", 1).otherwise(0)), F.lit(0)).alias("safe"),
                 F.coalesce(F.sum(F.when(r == "SUSPICIOUS", 1).otherwise(0)), F.lit(0)).alias("suspicious"))


def daily_activity(scans: DataFrame, days: int = 7) -> DataFrame:
    """A3: per calendar day, scans and phishing; the latest ``days`` days."""
    s = scans.where(U.not_ilike_any(F.col("url"), _LOCAL + ["chrome://%"]))
    g = s.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("scans"),
        F.sum(F.when(F.col("result") == "PHISHING", 1).otherwise(0)).alias("phishing"))
    return g.orderBy(F.desc("day")).limit(days)


_COLS = ["id", "url", "result", "ml_result", "lstm_result", "vt_result", "confidence", "vt_ratio", "timestamp"]


def recent_scans(scans: DataFrame, limit: int = 50) -> DataFrame:
    """A4: newest scans excluding browser pages (id breaks timestamp ties)."""
    s = scans.where(U.not_ilike_any(F.col("url"), _BROWSER))
    return s.select(*_COLS).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def history(scans: DataFrame, limit: int = 50) -> DataFrame:
    """A5: newest ``min(limit, 1000)`` scans."""
    n = min(int(limit), 1000)
    return scans.select(*_COLS).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def top_phishing_domains(scans: DataFrame, k: int = 8) -> DataFrame:
    """PHISHING scans by the reporting host (U3(e)); top k, domain breaks ties."""
    s = scans.where((F.col("result") == "PHISHING") & U.not_ilike_any(F.col("url"), _LOCAL))
    g = s.groupBy(U.sql_substring_host(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("cnt"))
    return g.orderBy(F.desc("cnt"), "domain").limit(k)


def class_distribution(labelled: DataFrame, label_col: str = "label") -> DataFrame:
    """Label histogram."""
    return labelled.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
