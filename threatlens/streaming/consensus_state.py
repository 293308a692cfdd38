"""Report consensus kept as counts per URL.

A tick adds the new reports' counts to the kept ones and decides the URLs that
they name; no other URL's counts have changed, so no other decision can.  The
table is cut into buckets by the URL's hash, each in a folder of its own; a tick
reads and writes only the buckets of the URLs it touches.  One commit lists the
current folder of each bucket with its totals, from which the trigger is read
without opening a bucket.

Labels are taken lower-cased and stripped, as S12 stores them; reports without
a URL take no part.  A report counts as used from the tick that decided its URL
for its label: the row keeps the ordinal of that tick (``safe_until``,
``phishing_until``), and :meth:`ConsensusState.used` compares it with the one
that a report came in by, so the report log is never rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import urls as U
from ..operators import consensus as cs
from ..session import materialize
from ..sources import publish as pb

ROW = ("url string, pending_safe long, pending_phishing long, all_safe long, all_phishing long, label string, "
       "report_count int, verified_at timestamp, used_in_train int, safe_until long, phishing_until long")
COUNTS = ["pending_safe", "pending_phishing", "all_safe", "all_phishing"]


class ConsensusState:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        last = pb.latest(spark, self.root)
        self.buckets = last.data["n"] if last else buckets

    def _bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def _read(self, entries: dict, numbers=None) -> DataFrame:
        paths = [f"{self.root}/{e['folder']}" for b, e in sorted(entries.items()) if numbers is None or int(b) in numbers]
        if not paths:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*paths)

    def _entries(self) -> tuple[pb.Commit | None, dict]:
        last = pb.latest(self.spark, self.root)
        return last, dict(last.data["buckets"]) if last else {}

    def _replace(self, rows: DataFrame, entries: dict, touched: list[int], version: str, after) -> None:
        """Write the touched buckets anew and publish them."""
        folder = f"data/{uuid.uuid4().hex}"
        (rows.withColumn("bucket", self._bucket(F.col("url"))).repartition(max(1, len(touched)), "bucket")
         .write.partitionBy("bucket").parquet(f"{self.root}/{folder}"))
        verified = F.col("label").isNotNull()
        stats = self.spark.read.schema(ROW + ", bucket int").parquet(f"{self.root}/{folder}").groupBy("bucket").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(verified).alias("verified"),
            F.count_if(verified & (F.col("used_in_train") == 0)).alias("pending"),
            F.sum(F.col("all_safe") + F.col("all_phishing") - F.col("pending_safe") - F.col("pending_phishing")).alias("used"))
        for r in stats.collect():  # a row a bucket
            entries[str(r["bucket"])] = {"folder": f"{folder}/bucket={r['bucket']}", "rows": r["rows"],
                                         "verified": r["verified"], "pending": r["pending"], "used": r["used"]}
        pb.publish(self.spark, self.root, version, {"n": self.buckets, "buckets": entries}, after=after)

    # ---- ticks -------------------------------------------------------------------

    def tick(self, new_reports: DataFrame, version: str, verified_at=None, ordinal: int = 0) -> bool:
        """Count and decide the new reports (url, label, used_in_verify); nothing
        happens if ``version`` is published already.  Returns the trigger."""
        lab, used = U.py_strip(F.lower(F.col("label"))), F.coalesce(F.col("used_in_verify"), F.lit(0))
        count = lambda keep: F.count_if(keep)
        delta = new_reports.where("url is not null").groupBy("url").agg(
            count((used == 0) & (lab == "safe")).alias("d_pending_safe"),
            count((used == 0) & (lab == "phishing")).alias("d_pending_phishing"),
            count(lab == "safe").alias("d_all_safe"), count(lab == "phishing").alias("d_all_phishing"))
        delta = materialize(delta, "report-counts")
        touched = [r["b"] for r in delta.select(self._bucket(F.col("url")).alias("b")).distinct().collect()]  # at most the buckets
        at = verified_at if isinstance(verified_at, Column) else F.lit(verified_at).cast("timestamp") if verified_at else F.current_timestamp()

        def change():
            last, entries = self._entries()
            if not pb.is_committed(self.spark, self.root, version):
                self._replace(self._decided(self._read(entries, touched), delta, at, ordinal), entries, touched, version, last)
        pb.retried(change)
        return self.due()

    def _decided(self, state: DataFrame, delta: DataFrame, at: Column, ordinal: int) -> DataFrame:
        both = state.join(delta.withColumn("_new", F.lit(True)), "url", "full_outer")
        both = both.withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0)) for c in COUNTS})
        both = cs.decided(both.withColumnRenamed("report_count", "_count"))
        new = F.coalesce("_new", F.lit(False))
        is_ = lambda x: new & (F.col("decision") == x)
        won = is_("safe") | is_("phishing")
        return both.select(
            "url", F.when(is_("safe"), F.lit(0)).otherwise(F.col("pending_safe")).cast("long").alias("pending_safe"),
            F.when(is_("phishing"), F.lit(0)).otherwise(F.col("pending_phishing")).cast("long").alias("pending_phishing"),
            "all_safe", "all_phishing", F.when(won, F.col("decision")).otherwise(F.col("label")).alias("label"),
            F.when(won, F.col("report_count").cast("int")).otherwise(F.col("_count")).alias("report_count"),
            F.when(won, at).otherwise(F.col("verified_at")).alias("verified_at"),
            F.when(won, F.lit(0)).otherwise(F.col("used_in_train")).alias("used_in_train"),
            F.when(is_("safe"), F.lit(ordinal)).otherwise(F.col("safe_until")).cast("long").alias("safe_until"),
            F.when(is_("phishing"), F.lit(ordinal)).otherwise(F.col("phishing_until")).cast("long").alias("phishing_until"))

    def mark_trained(self, trained: DataFrame, version: str) -> None:
        """The URLs that a retrain used, in their buckets alone."""
        urls = materialize(trained.select(F.col("url")).distinct(), "trained-urls")
        touched = [r["b"] for r in urls.select(self._bucket(F.col("url")).alias("b")).distinct().collect()]

        def change():
            last, entries = self._entries()
            if pb.is_committed(self.spark, self.root, version):
                return
            state = self._read(entries, touched).join(urls.withColumn("_t", F.lit(True)), "url", "left")
            done = F.col("_t").isNotNull() & F.col("label").isNotNull()
            state = state.withColumn("used_in_train", F.when(done, F.lit(1)).otherwise(F.col("used_in_train"))).drop("_t")
            self._replace(state, entries, touched, version, last)
        pb.retried(change)

    # ---- what is known --------------------------------------------------------------

    def totals(self) -> dict:
        """Sums over all buckets, from the commit alone: rows, verified,
        pending (not yet trained), used (reports)."""
        entries = self._entries()[1].values()
        return {k: sum(e[k] for e in entries) for k in ("rows", "verified", "pending", "used")}

    def due(self, min_new: int = lists.MIN_NEW_REPORTS_TO_RETRAIN) -> bool:
        """A13."""
        return self.totals()["pending"] >= min_new

    def counts(self) -> DataFrame:
        """The kept rows of all URLs."""
        return self._read(self._entries()[1])

    def verified(self) -> DataFrame:
        return self.counts().where("label is not null").select("url", "label", "report_count", "verified_at", "used_in_train")

    def used(self, reports: DataFrame, arrived: str) -> DataFrame:
        """``reports`` with ``used_in_verify`` as it is now; ``arrived`` names the
        column with the ordinal of the tick that a report came in by."""
        state = self.counts().select(F.col("url").alias("_u"), "safe_until", "phishing_until")
        lab = U.py_strip(F.lower(F.col("label")))
        until = F.when(lab == "safe", F.col("safe_until")).when(lab == "phishing", F.col("phishing_until"))
        out = reports.join(state, F.col("url") == F.col("_u"), "left")
        return out.withColumn("used_in_verify", F.when(F.col(arrived) <= until, F.lit(1)).otherwise(F.col("used_in_verify"))).drop(
            "_u", "safe_until", "phishing_until")

    def trim(self, keep: int = pb.KEEP) -> list[str]:
        return pb.trim(self.spark, self.root, keep, lambda c: [e["folder"] for e in c.data["buckets"].values()])
