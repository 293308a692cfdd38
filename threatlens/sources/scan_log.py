"""The scan log as a published table of dates.

Every append writes a folder for each date and publishes it; the commit lists
the folders of each date with their number of rows.  On this listing rest

* compaction: dates of more than ``MAX_FOLDERS`` folders are written anew into one,
  so the number of files stays bounded by the dates and their size;
* newest-first reads: the row counts tell how many dates, from the latest on,
  hold the wanted number of scans, and only those are opened;
* kept reports: partial sums by date and reported host, made again only for
  dates whose folders have changed since, and merged by the reports.

A batch that runs again is not appended twice.  Writers publish one after the
other (:mod:`threatlens.sources.publish`); one that lost starts from the new
listing, its written folders stay as they are.  Scans without a time form the
date ``null``, which comes last.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import reporting as rp
from . import publish as pb
from .sinks import scan_log_filter

ROW = ("id long, url string, result string, ml_result string, lstm_result string, vt_result string, confidence int, "
       "vt_ratio string, timestamp timestamp")
MAX_FOLDERS = 8
#: Batch ids that a commit remembers.
BATCHES = 1000
NULL_DATE = "__HIVE_DEFAULT_PARTITION__"
PARTIAL = ("domain string, total long, phishing long, suspicious long, k_total long, k_phishing long, k_safe long, "
           "k_suspicious long, d_total long, d_phishing long, top long")
_SUMS = [c.split()[0] for c in PARTIAL.split(", ")][1:]


class ScanLog:
    def __init__(self, spark: SparkSession, root: str, max_folders: int = MAX_FOLDERS):
        self.spark, self.root, self.max_folders = spark, root.rstrip("/"), max_folders

    def _state(self) -> tuple[pb.Commit | None, dict]:
        last = pb.latest(self.spark, self.root)
        return last, last.data if last else {"dates": {}, "reports": {}, "batches": []}

    # ---- writes ----------------------------------------------------------------------

    def _written(self, rows: DataFrame) -> dict:
        """A folder for each date of the rows, with what it holds."""
        folder = f"data/part={uuid.uuid4().hex}"
        rows.hint("rebalance", "date").write.partitionBy("date").parquet(f"{self.root}/{folder}")
        listed = U.not_ilike_any(F.col("url"), rp._BROWSER)
        name = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(NULL_DATE))
        stats = rows.groupBy(name("date").alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(listed).alias("listed"))
        return {r["d"]: {"folder": f"{folder}/date={r['d']}", "rows": r["rows"], "listed": r["listed"]}
                for r in stats.collect()}  # a row a date

    def append(self, rows: DataFrame, batch: str) -> None:
        """Scans that are logged, once per ``batch``."""
        from ..session import materialize

        names = [f.split()[0] for f in ROW.split(", ")]
        kept = scan_log_filter(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp")).select(*names)
        kept = materialize(kept.withColumn("date", F.to_date("timestamp")), "scan-batch")
        if batch in self._state()[1]["batches"]:
            return
        new = self._written(kept)

        def change():
            last, state = self._state()
            if batch in state["batches"]:
                return
            dates = dict(state["dates"])
            for d, e in new.items():
                old = dates.get(d, {"folders": [], "rows": 0, "listed": 0})
                dates[d] = {"folders": [*old["folders"], e["folder"]], "rows": old["rows"] + e["rows"],
                            "listed": old["listed"] + e["listed"]}
            pb.publish(self.spark, self.root, batch, state | {"dates": dates, "batches": [*state["batches"], batch][-BATCHES:]},
                       after=last)
        pb.retried(change)

    def compact(self) -> list[str]:
        """Dates of too many folders, written into one each; returns them."""
        def change():
            last, state = self._state()
            many = [d for d, e in state["dates"].items() if len(e["folders"]) > self.max_folders]
            if not many:
                return []
            new = self._written(self._dated(many, state))
            dates = dict(state["dates"])
            for d in many:
                dates[d] = {"folders": [new[d]["folder"]], "rows": new[d]["rows"], "listed": new[d]["listed"]}
            pb.publish(self.spark, self.root, f"compact-{uuid.uuid4().hex}", state | {"dates": dates}, after=last)
            return many
        return pb.retried(change)

    # ---- reads -------------------------------------------------------------------------

    def _dated(self, dates: list[str], state: dict) -> DataFrame:
        paths = [f"{self.root}/{f}" for d in dates for f in state["dates"][d]["folders"]]
        if not paths:
            return self.spark.createDataFrame([], ROW + ", date date")
        return self.spark.read.schema(ROW + ", date date").option("basePath", f"{self.root}/data").parquet(*paths).drop("part")

    def dates(self) -> dict:
        """Folders and row counts of each date."""
        return self._state()[1]["dates"]

    def read(self, dates: list[str] | None = None) -> DataFrame:
        """The scans of the given dates, or of all."""
        state = self._state()[1]
        return self._dated(sorted(state["dates"]) if dates is None else dates, state)

    def newest_dates(self, k: int, count: str = "rows") -> list[str]:
        """The fewest dates, from the latest on, that hold ``k`` scans."""
        out, have, dates = [], 0, self.dates()
        for d in sorted(dates, key=lambda d: (d != NULL_DATE, d), reverse=True):
            if have >= k:
                break
            out.append(d)
            have += dates[d][count]
        return out

    def recent(self, limit: int = 50) -> DataFrame:
        """A4 over the newest dates that hold ``limit`` listed scans."""
        return rp.recent_scans(self.read(self.newest_dates(limit, "listed")), limit)

    def history(self, limit: int = 50) -> DataFrame:
        """A5 over the newest dates that hold ``limit`` scans."""
        return rp.history(self.read(self.newest_dates(min(int(limit), 1000))), limit)

    # ---- kept reports --------------------------------------------------------------------

    def refresh(self) -> list[str]:
        """Partial sums of the dates that changed since the last refresh;
        returns those dates."""
        def change():
            last, state = self._state()
            of = {d: hashlib.sha256("|".join(e["folders"]).encode()).hexdigest() for d, e in state["dates"].items()}
            stale = [d for d in of if state["reports"].get(d, {}).get("of") != of[d]]
            if not stale:
                return []
            folder = f"reports/part={uuid.uuid4().hex}"
            partial_sums(self._dated(stale, state)).hint("rebalance", "date").write.partitionBy("date").parquet(f"{self.root}/{folder}")
            reports = {**state["reports"], **{d: {"folder": f"{folder}/date={d}", "of": of[d]} for d in stale}}
            pb.publish(self.spark, self.root, f"reports-{uuid.uuid4().hex}", state | {"reports": reports}, after=last)
            return stale
        return pb.retried(change)

    def partials(self) -> DataFrame:
        paths = [f"{self.root}/{e['folder']}" for e in self._state()[1]["reports"].values()]
        if not paths:
            return self.spark.createDataFrame([], PARTIAL + ", date date")
        return self.spark.read.schema(PARTIAL + ", date date").option("basePath", f"{self.root}/reports").parquet(*paths).drop("part")

    def trim(self, keep: int = pb.KEEP) -> list[str]:
        """Old commits and the folders that only they name."""
        return pb.trim(self.spark, self.root, keep, lambda c: [
            *(f for e in c.data["dates"].values() for f in e["folders"]), *(e["folder"] for e in c.data["reports"].values())])


def partial_sums(scans: DataFrame) -> DataFrame:
    """Sums by date and reported host (null: not a phishing scan that the host
    report counts), which add up to every report."""
    r, one = F.col("result"), F.lit(True)
    local, browser = (U.not_ilike_any(F.col("url"), x) for x in (rp._LOCAL, rp._BROWSER))
    daily = U.not_ilike_any(F.col("url"), rp._LOCAL + ["chrome://%"])
    counted = (r == "PHISHING") & local
    n = lambda *keep: F.count_if(_all(keep))
    kpi = local & browser
    return scans.groupBy("date", F.when(counted, U.sql_substring_host(F.col("url"))).alias("domain")).agg(
        n(one).alias("total"), n(r == "PHISHING").alias("phishing"), n(r == "SUSPICIOUS").alias("suspicious"),
        n(kpi).alias("k_total"), n(kpi, r == "PHISHING").alias("k_phishing"), n(kpi, r == "SAFE").alias("k_safe"),
        n(kpi, r == "SUSPICIOUS").alias("k_suspicious"), n(daily).alias("d_total"),
        n(daily, r == "PHISHING").alias("d_phishing"), n(counted).alias("top"))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _sum(c: str):
    return F.coalesce(F.sum(c), F.lit(0))


def totals(partials: DataFrame) -> DataFrame:
    """A1."""
    t = partials.agg(*[_sum(c).alias(c) for c in ("total", "phishing", "suspicious")])
    return rp.with_rate(t)


def kpis(partials: DataFrame) -> DataFrame:
    """A2."""
    return partials.agg(*[_sum(f"k_{c}").alias(c) for c in ("total", "phishing", "safe", "suspicious")])


def daily(partials: DataFrame, days: int = 7) -> DataFrame:
    """A3."""
    g = partials.groupBy(F.col("date").alias("day")).agg(_sum("d_total").alias("scans"), _sum("d_phishing").alias("phishing"))
    return g.where("scans > 0").orderBy(F.desc("day")).limit(days)


def windows(partials: DataFrame) -> DataFrame:
    """Scans and phishing of each day."""
    start = F.col("date").cast("timestamp")
    g = partials.where("date is not null").groupBy("date").agg(_sum("d_total").alias("scans"), _sum("d_phishing").alias("phishing"))
    return g.where("scans > 0").select(start.alias("window_start"), (start + F.expr("INTERVAL 1 DAY")).alias("window_end"),
                                       "scans", "phishing")


def top_domains(partials: DataFrame, k: int = 8) -> DataFrame:
    """A7."""
    g = partials.where("domain is not null").groupBy("domain").agg(_sum("top").alias("cnt"))
    return g.orderBy(F.desc("cnt"), "domain").limit(k)
