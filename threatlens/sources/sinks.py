"""Sinks and table updates.

Every write is a snapshot or an append of Parquet under a folder the caller
names (on a cluster: the shared warehouse / checkpoint folder).  Validation
splits inputs into accepted rows and a quarantine with the error text, so no
row is silently dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import urls as U
from .publish import commit_version, current_version, is_committed  # noqa: F401  the commit log of versions


def validate_reports(requests: DataFrame) -> DataFrame:
    """lower/strip the label, accept safe/phishing only, cut the url to
    2048 and the note to 500 characters.  Adds ``error`` (NULL = accepted)."""
    lab = U.py_strip(F.lower(F.col("label")))
    err = (F.when(F.col("url").isNull() | F.col("label").isNull(), F.lit("Missing url or label"))
            .when(~lab.isin("safe", "phishing"), F.lit("Label must be 'safe' or 'phishing'")))
    return requests.select(
        "id", F.substring("url", 1, lists.MAX_URL_LENGTH).alias("url"), lab.alias("label"),
        F.substring(F.coalesce(F.col("note"), F.lit("")), 1, lists.MAX_NOTE_LENGTH).alias("note"),
        F.lit(0).alias("used_in_verify"), "timestamp", err.alias("error"))


def feedback_reports(requests: DataFrame) -> DataFrame:
    """Feedback becomes a report whose note records the earlier verdict."""
    lab = U.py_strip(F.lower(F.col("correct_label")))
    err = (F.when(F.col("url").isNull() | F.col("correct_label").isNull() | F.col("reported_label").isNull(),
                  F.lit("Missing fields"))
            .when(~lab.isin("safe", "phishing"), F.lit("correct_label must be 'safe' or 'phishing'")))
    note = F.concat(F.lit("[feedback] was "), F.col("reported_label"), F.lit(", correct="), lab, F.lit(". "),
                    F.coalesce(F.col("note"), F.lit("")))
    return requests.select(
        "id", F.substring("url", 1, lists.MAX_URL_LENGTH).alias("url"), lab.alias("label"),
        F.substring(note, 1, lists.MAX_NOTE_LENGTH).alias("note"), F.lit(0).alias("used_in_verify"),
        "timestamp", err.alias("error"))


def clean_allowlist_domain(raw) -> F.Column:
    """S14 cleaning: lower, strip, first 253 chars, drop scheme text, cut at '/'."""
    d = F.substring(U.py_strip(F.lower(raw)), 1, lists.MAX_DOMAIN_LENGTH)
    d = F.replace(F.replace(d, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.substring_index(d, "/", 1)


def allowlist_additions(requests: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Valid cleaned hosts not yet listed (insert-or-ignore), one per host."""
    c = requests.select(clean_allowlist_domain(F.col("domain")).alias("domain"))
    c = c.where((F.col("domain") != "") & F.col("domain").contains(".")).distinct()
    if current is not None:
        c = c.join(current.select("domain"), "domain", "left_anti")
    return c


def scan_log_filter(rows: DataFrame) -> DataFrame:
    """Rows whose URL is a browser or file page are not logged."""
    return rows.where(~U.starts_with_any(F.col("url"), lists.NO_LOG_PREFIXES))


def append_scans(rows: DataFrame, path: str, mode: str = "append") -> None:
    """S11 sink: append to a date-partitioned Parquet scan log (a streaming
    batch replaces its own folder, so that running it again adds nothing)."""
    (scan_log_filter(rows).withColumn("date", F.to_date("timestamp"))
     .write.mode(mode).partitionBy("date").parquet(path))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace a table by a new snapshot (S15, S16, M1/M2, A12 updates)."""
    df.write.mode("overwrite").parquet(path)


def _is_missing(error: Exception) -> bool:
    """The path does not exist (any other read error is one)."""
    get = getattr(error, "getCondition", None) or getattr(error, "getErrorClass", lambda: "")
    return "PATH_NOT_FOUND" in str(get() or "")


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if _is_missing(e):
            return None
        raise


RETRAIN_EVENT = ("run_id string, seq int, triggered_at timestamp, new_safe long, new_phishing long, "
                 "accuracy double, status string")


def append_retrain_event(spark: SparkSession, path: str, run_id: str, seq: int, status: str, new_safe: int = 0,
                         new_phishing: int = 0, accuracy: float = 0.0) -> None:
    """S16 write side: one status event of a retrain run (running, then done,
    rejected_low_accuracy or failed)."""
    row = (spark.createDataFrame([(run_id, seq, new_safe, new_phishing, accuracy, status)],
                                 "run_id string, seq int, new_safe long, new_phishing long, accuracy double, status string")
           .withColumn("triggered_at", F.current_timestamp()))
    row.select(*[c.strip().split()[0] for c in RETRAIN_EVENT.split(",")]).coalesce(1).write.mode("append").parquet(path)


def retrain_log_latest(events: DataFrame) -> DataFrame:
    """The log is append-only status events; the current state of each
    run is its newest event."""
    return events.groupBy("run_id").agg(
        F.max_by(F.struct("id", "triggered_at", "new_safe", "new_phishing", "accuracy", "status"),
                 F.col("id")).alias("e")).select("run_id", "e.*")
