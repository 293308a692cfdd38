"""Threat-feed ingest (S5-S10, SET1, SET2, A14).

Feeds arrive as text lines tagged with their source and format -- either a
``feed_lines(source, format, line)`` table or landing folders read with
``spark.read.text`` (the source is recovered from the file path).  Parsing
is one projection per format, so the whole ingest is a narrow job followed
by two ``distinct`` shuffles (URLs, domains) with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.urls import WS_CLASS, host_of_netloc, netloc_of, py_strip

# fixed values: the public feed catalog (name, location, format)
FEED_CATALOG = [
    ("OpenPhish", "https://openphish.com/feed.txt", "url_per_line"),
    ("URLhaus (abuse.ch)", "https://urlhaus.abuse.ch/downloads/text/", "url_per_line_skip_hash"),
    ("Phishing Army Extended", "https://phishing.army/download/phishing_extendedlist.txt", "url_per_line_skip_hash"),
    ("mitchellkrogza Active", "https://raw.githubusercontent.com/mitchellkrogza/Phishing.Database/master/phishing-links-ACTIVE.txt", "url_per_line_skip_hash"),
    ("mitchellkrogza New Today", "https://raw.githubusercontent.com/mitchellkrogza/Phishing.Database/master/phishing-links-NEW-today.txt", "url_per_line_skip_hash"),
    ("Jarelllama Scam Blocklist", "https://raw.githubusercontent.com/jarelllama/Scam-Blocklist/main/lists/wildcard_domains/scams.txt", "domain_per_line_skip_hash"),
    ("PeterDaveHello Phishing", "https://raw.githubusercontent.com/PeterDaveHello/threat-hostlist/master/phishing/hosts", "hosts_file"),
    ("CyberHost Malware", "https://lists.cyberhost.uk/malware.txt", "domain_per_line_skip_hash"),
    ("VX Vault URLs", "http://vxvault.net/URL_List.php", "url_per_line"),
    ("Phishing.Database Domains", "https://raw.githubusercontent.com/mitchellkrogza/Phishing.Database/master/phishing-domains-ACTIVE.txt", "domain_per_line_skip_hash"),
]

_SKIP_HASH = ["url_per_line_skip_hash", "domain_per_line_skip_hash", "hosts_file"]


def catalog_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEED_CATALOG, "source string, location string, format string")


def read_feed_folders(spark: SparkSession, landing_root: str, catalog: DataFrame) -> DataFrame:
    """One landing folder per source (``{landing_root}/{source}/``); the
    source name is the folder's (paths come URL-encoded), the format the
    catalog's.  Folders that the catalog doesn't know have a null format:
    :func:`unknown_sources` lists them, the parser leaves them out."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    # in a URL a plus sign is itself; the decoder takes it for a space
    source = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(landing_root + "/*/").select(F.col("value").alias("line"), source.alias("source"))
    return lines.join(catalog.select("source", "format"), "source", "left").select("source", "format", "line")


def unknown_sources(lines: DataFrame) -> DataFrame:
    """Quarantine: sources without a catalog entry and their line counts."""
    return lines.where(F.col("format").isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("lines"))


def parse_feed_lines(lines: DataFrame) -> DataFrame:
    """``(source, format, line)`` -> ``(source, kind, value)`` where
    kind is 'url' or 'domain'.  A URL line yields its URL and its host."""
    fmt = F.col("format")
    s = F.regexp_replace(py_strip(F.col("line")), r"\.+$", "")
    staged = (lines.select("source", "format", s.alias("s"))
              .where((F.col("s") != "") & ~(fmt.isin(_SKIP_HASH) & F.col("s").startswith("#"))))
    # hosts file: "0.0.0.0 name"
    tok = F.split(F.col("s"), WS_CLASS + "+")
    host_name = py_strip(F.lower(F.try_element_at(tok, F.lit(2))))
    hosts_ok = ((F.size(tok) >= 2) & F.element_at(tok, 1).isin(lists.FEED_HOST_PREFIXES)
                & host_name.contains("."))
    # domain per line: lower, one leading "*." removed
    dl = py_strip(F.lower(F.col("s")))
    dl = F.when(dl.startswith("*."), dl.substr(F.lit(3), F.length(dl))).otherwise(dl)
    dom_ok = dl.contains(".") & ~dl.startswith("http")
    # URL per line
    url_ok = F.col("s").startswith("http")
    url_host = host_of_netloc(netloc_of(F.col("s")))
    # any format that isn't a hosts file or a domain list is read as URLs
    is_url_fmt = fmt.isNotNull() & ~fmt.isin("hosts_file", "domain_per_line", "domain_per_line_skip_hash")
    is_dom_fmt = fmt.isin("domain_per_line", "domain_per_line_skip_hash")
    entries = F.when((fmt == "hosts_file") & hosts_ok,
                     F.array(F.struct(F.lit("domain").alias("kind"), host_name.alias("value"))))
    entries = entries.when(is_dom_fmt & dom_ok,
                           F.array(F.struct(F.lit("domain").alias("kind"), dl.alias("value"))))
    entries = entries.when(is_url_fmt & url_ok,
                           F.array(F.struct(F.lit("url").alias("kind"), F.col("s").alias("value")),
                                   F.struct(F.lit("domain").alias("kind"), url_host.alias("value"))))
    parsed = staged.select("source", F.explode(entries).alias("e"))
    return (parsed.select("source", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
                  .where(F.col("value") != ""))


def feed_stats(lines: DataFrame, parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accepted entries per source counted before de-duplication (a URL
    line counts once).  A source that was fetched is OK, with 0 if none of its
    lines was accepted; the others report an error.  ``catalog.fetched`` says
    which were; without that column, those that have lines."""
    counts = (parsed.groupBy("source")
              .agg(F.count_if(F.col("kind") == "url").alias("_u"),
                   F.count_if(F.col("kind") == "domain").alias("_d")))
    if "fetched" not in catalog.columns:
        landed = lines.select("source").distinct().withColumn("fetched", F.lit(True))
        catalog = catalog.join(landed, "source", "left")
    j = catalog.select("source", "format", "fetched").join(counts, "source", "left")
    is_url = ~F.col("format").isin("hosts_file", "domain_per_line", "domain_per_line_skip_hash")
    n = F.when(is_url, F.col("_u")).otherwise(F.col("_d"))
    ok = F.coalesce(F.col("fetched"), F.lit(False))
    return j.select("source", F.when(ok, F.coalesce(n, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("count"),
                    F.when(ok, F.lit("OK")).otherwise(F.lit("HTTP ERR")).alias("status"))


def feed_sets(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S9 + SET1 + SET2: distinct feed URLs and domains; protected brands
    (and their www. forms) are removed from the domains only."""
    urls_ = parsed.where(F.col("kind") == "url").select(F.col("value").alias("url")).distinct()
    protected = lists.NEVER_PHISHING + ["www." + d for d in lists.NEVER_PHISHING]
    domains = (parsed.where((F.col("kind") == "domain") & ~F.col("value").isin(protected))
               .select(F.col("value").alias("domain")).distinct())
    return urls_, domains


def feed_totals(feed_urls: DataFrame, feed_domains: DataFrame) -> DataFrame:
    """One row of set sizes."""
    both = (feed_urls.select(F.lit(1).alias("u"), F.lit(0).alias("d"))
            .unionByName(feed_domains.select(F.lit(0).alias("u"), F.lit(1).alias("d"))))
    t = both.agg(F.coalesce(F.sum("u"), F.lit(0)).cast("bigint").alias("total_urls"),
                 F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("total_domains"))
    return t.select("total_urls", "total_domains",
                    (F.col("total_urls") + F.col("total_domains")).alias("total_entries"))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries that were added or removed between two versions of a set:
    ``key`` and ``change``."""
    both = old.select(F.col(key), F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.select(F.col(key), F.lit(0).alias("o"), F.lit(1).alias("n")))
    sums = both.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n")).where(F.col("o") != F.col("n"))
    return sums.select(key, F.when(F.col("n") == 1, F.lit("added")).otherwise(F.lit("removed")).alias("change"))
