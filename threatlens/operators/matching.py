"""Allow-list and blocklist membership.

All lookups are joins.  Parent-domain walks explode the suffixes of each
*distinct* host (2-6 rows per host), join them to the list, and keep only the
hosts that hit.  The hit tables are what later joins back to the URL rows; they
are usually far smaller than the URL table, so AQE turns that join into a
broadcast when the measured size allows, and otherwise shuffles with
skew-splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.features import labels
from .reduction import Bloom


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def list_df(spark: SparkSession, values, name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def static_allow_candidates(host) -> Column:
    """J1 candidate names: the host, the host minus a leading 'www.', and
    every parent suffix down to two labels."""
    h = _c(host)
    parts = labels(h)
    n = F.size(parts)
    parents = F.when(n >= 3, F.transform(F.sequence(F.lit(2), n - 1),
                                         lambda i: F.array_join(F.slice(parts, i, n), ".")))
    parents = parents.otherwise(F.array().cast("array<string>"))
    www = F.when(h.startswith("www."), F.array(h.substr(F.lit(5), F.length(h)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(h), www, parents))


def feed_domain_candidates(host) -> Column:
    """J4 candidate names: every suffix with at least two labels (the host
    itself included); single-label names are never matched."""
    h = _c(host)
    parts = labels(h)
    n = F.size(parts)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1),
                                      lambda i: F.array_join(F.slice(parts, i, n), "."))
                  ).otherwise(F.array().cast("array<string>"))


def static_allowlist_hits(hosts: DataFrame, allowlist: DataFrame, host_col: str = "host") -> DataFrame:
    """Distinct hosts that are allow-listed by the static list.
    ``allowlist`` has one column ``domain``."""
    h = hosts.select(F.col(host_col).alias("host")).distinct()
    cand = h.select("host", F.explode(static_allow_candidates(F.col("host"))).alias("domain"))
    al = allowlist.select("domain").distinct()
    return cand.join(al, "domain", "left_semi").select("host").distinct()


def dynamic_allowlist_hits(hosts: DataFrame, dynamic: DataFrame, host_col: str = "host") -> DataFrame:
    """Hosts whose 'www.'-free form is in the dynamic list, exact only."""
    h = hosts.select(F.col(host_col).alias("host")).distinct()
    key = F.replace(F.lower(F.col("host")), F.lit("www."), F.lit(""))
    d = dynamic.select(F.col("domain").alias("_k")).distinct()
    return h.join(d, key == F.col("_k"), "left_semi").select("host")


def feed_url_hits(urls: DataFrame, feed_urls: DataFrame, url_col: str = "url", listed: Bloom | None = None) -> DataFrame:
    """URLs equal to a feed URL, or equal to one once trailing '/' are cut.
    ``listed``, a filter of the feed's URLs, drops most probes before the exchange.

    Each distinct URL probes with at most two keys (itself and its
    slash-trimmed form), so one equi-join replaces the OR condition that
    would otherwise force a nested-loop join."""
    u = urls.select(F.col(url_col).alias("url")).distinct()
    probe = u.select("url", F.explode(F.array_distinct(
        F.array(F.col("url"), F.regexp_replace(F.col("url"), "/+$", "")))).alias("f"))
    if listed is not None:
        probe = listed.passing(probe, F.col("f"))
    f = feed_urls.select(F.col("url").alias("f"))
    return probe.join(f, "f", "left_semi").select("url").distinct()


def feed_domain_hits(hosts: DataFrame, feed_domains: DataFrame, host_col: str = "feed_host",
                     listed: Bloom | None = None) -> DataFrame:
    """J4 + J5: feed hosts (U3(b)) with a listed suffix, minus protected brands.
    ``listed``, a filter of the feed's domains, drops most suffixes before the
    exchange."""
    h = hosts.select(F.col(host_col).alias("feed_host")).distinct()
    guarded = F.replace(F.col("feed_host"), F.lit("www."), F.lit("")).isin(lists.NEVER_PHISHING)
    cand = h.where(~guarded).select("feed_host", F.explode(feed_domain_candidates(F.col("feed_host"))).alias("domain"))
    if listed is not None:
        cand = listed.passing(cand, F.col("domain"))
    return cand.join(feed_domains.select("domain"), "domain", "left_semi").select("feed_host").distinct()


def feed_flags(urls: DataFrame, feed_urls: DataFrame, feed_domains: DataFrame, url_filter: Bloom | None = None,
               domain_filter: Bloom | None = None) -> DataFrame:
    """``urls(url, feed_host, ...)`` with in_feed_url and in_feed_domain."""
    out = with_flag(urls, feed_url_hits(urls, feed_urls, listed=url_filter), "url", "in_feed_url")
    return with_flag(out, feed_domain_hits(out, feed_domains, listed=domain_filter), "feed_host", "in_feed_domain")


def reflagged(flags: DataFrame, changed_urls: DataFrame, changed_domains: DataFrame, feed_urls: DataFrame,
              feed_domains: DataFrame) -> DataFrame:
    """Flags of ``feed_flags`` brought up to a new feed version: only URLs and
    hosts that probe an added or removed entry (``changed_urls(url)``,
    ``changed_domains(domain)``) are matched again; the others keep theirs."""
    hosts = flags.select("feed_host").distinct()
    again_u = feed_url_hits(flags, changed_urls).select("url")
    again_h = feed_domain_hits(hosts, changed_domains).select("feed_host")
    now_u = with_flag(again_u, feed_url_hits(again_u, feed_urls), "url", "_now_u").withColumnRenamed("url", "_au")
    now_h = with_flag(again_h, feed_domain_hits(again_h, feed_domains), "feed_host", "_now_h").withColumnRenamed("feed_host", "_ah")
    out = flags.join(now_u, F.col("url") == F.col("_au"), "left").join(now_h, F.col("feed_host") == F.col("_ah"), "left")
    return out.withColumns({"in_feed_url": F.coalesce("_now_u", "in_feed_url"),
                            "in_feed_domain": F.coalesce("_now_h", "in_feed_domain")}).drop("_au", "_now_u", "_ah", "_now_h")


def with_flag(df: DataFrame, hits: DataFrame, key: str, flag: str) -> DataFrame:
    """Left-joins a hit set (one row per key) and turns it into a boolean."""
    h = hits.select(F.col(key).alias("_hk"), F.lit(True).alias(flag))
    out = df.join(h, df[key] == h["_hk"], "left").drop("_hk")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
