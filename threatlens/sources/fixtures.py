"""Fixture tables derived from the driver's ``pages`` and ``events`` tables.

Each derivation is one SQL text that runs unchanged on Spark (through
``spark.sql(text, pages=df, events=df)``) and on DuckDB (where the braces
are replaced by the registered view names).  That keeps the inputs of every
Spark query and of its oracle identical, and every fixture grows with the
base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

HOST = "regexp_extract(url,'^[a-z]+://([^/?#]*)',1)"

FIXTURE_SQL: dict[str, str] = {}

# scan log: one row per event, URL from a page or an internal page
FIXTURE_SQL["scans"] = """
SELECT e.event_id AS id,
  CASE e.event_id % 10 WHEN 0 THEN concat('http://localhost:5000/', CAST(e.user_id AS STRING)) WHEN 1 THEN 'chrome://settings'
    WHEN 2 THEN concat('HTTP://LOCALHOST/', CAST(e.user_id AS STRING))
    WHEN 3 THEN CASE e.event_id % 40 WHEN 3 THEN 'about:blank' WHEN 13 THEN concat('chrome-extension://x', CAST(e.user_id AS STRING))
      WHEN 23 THEN concat('https://www.google.com/maps?q=', CAST(e.user_id AS STRING)) ELSE p.url END ELSE p.url END AS url,
  CASE e.event_type WHEN 'error' THEN 'PHISHING' WHEN 'purchase' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS result,
  CASE e.event_type WHEN 'error' THEN 'PHISHING' ELSE 'SAFE' END AS ml_result,
  CASE WHEN e.event_id % 3 = 0 THEN 'N/A' WHEN e.event_type = 'error' THEN 'PHISHING' ELSE 'SAFE' END AS lstm_result,
  CASE WHEN e.event_id % 4 = 0 THEN 'UNAVAILABLE' WHEN e.event_type = 'error' THEN 'PHISHING' ELSE 'SAFE' END AS vt_result,
  CAST(50 + (e.event_id % 50) AS INT) AS confidence,
  CASE WHEN e.event_id % 4 = 0 THEN 'N/A' ELSE concat(CAST(e.event_id % 5 AS STRING), '/70') END AS vt_ratio,
  e.ts AS timestamp
FROM (SELECT e0.*, e0.event_id % c.n AS pid FROM {events} e0 CROSS JOIN (SELECT count(*) AS n FROM {pages}) c) e
JOIN {pages} p ON p.page_id = e.pid
"""

# user report log: every event reports a page; a quarter of the pages get only
# safe labels, a quarter only phishing ones, a quarter phishing ones in every third
# report, and every ninth page few reports at all
FIXTURE_SQL["reports"] = """
SELECT e.event_id AS id, p.url AS url,
  CASE WHEN p.page_id % 4 = 0 THEN 'safe' WHEN p.page_id % 4 = 1 THEN 'phishing'
    WHEN p.page_id % 4 = 2 THEN CASE WHEN e.event_id % 3 = 0 THEN 'phishing' ELSE 'safe' END
    WHEN e.event_type IN ('error','click') THEN 'phishing' ELSE 'safe' END AS label,
  concat('note ', CAST(e.event_id AS STRING)) AS note,
  CASE WHEN e.event_id % 11 = 0 THEN 1 ELSE 0 END AS used_in_verify, e.ts AS timestamp
FROM (SELECT e0.*, e0.event_id % c.n AS pid FROM {events} e0 CROSS JOIN (SELECT count(*) AS n FROM {pages}) c) e
JOIN {pages} p ON p.page_id = e.pid
WHERE p.page_id % 9 <> 4 OR e.event_id % 64 = 5
"""

# URLs with phishing-like variants
FIXTURE_SQL["url_corpus"] = """
SELECT page_id, CASE page_id % 8
  WHEN 0 THEN url
  WHEN 1 THEN concat('http://10.2.3.', CAST(page_id % 250 AS STRING), '/login?u=', url)
  WHEN 2 THEN concat('https://paypal.account', CAST(page_id AS STRING), '.xyz/verify?id=', CAST(page_id AS STRING))
  WHEN 3 THEN concat('http://paypa1.com/signin/', CAST(page_id AS STRING))
  WHEN 4 THEN concat('https://xn--site-', CAST(page_id AS STRING), '.net/')
  WHEN 5 THEN concat('https://www.google.com/search?q=', CAST(page_id AS STRING), '&utm_source=feed')
  WHEN 6 THEN concat('http://user:pw@login-', CAST(page_id AS STRING), '.top/a')
  ELSE concat('https://a.b.c.d.e', CAST(page_id AS STRING), '.example.com/p/q;v=1?x=1&&y=2') END AS url
FROM {pages}
"""

# requests as they arrive: unusable ones, control characters, and one name that
# only the brand guard keeps off the blocklist
FIXTURE_SQL["odd_requests"] = """
SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN '   ' WHEN 1 THEN repeat(url, 100) WHEN 2 THEN concat(chr(9), ' ', url, chr(10))
  WHEN 3 THEN concat(substr(url, 1, 9), chr(13), chr(10), substr(url, 10)) WHEN 4 THEN NULL
  ELSE concat('https://sub.google.com/x', CAST(page_id AS STRING)) END AS url
FROM {pages} WHERE page_id % 5 = 2
"""

# raw threat-feed lines, tagged with their source and format
FIXTURE_SQL["feed_lines"] = """
SELECT CASE WHEN page_id % 23 = 7 THEN 'comments only (test)' ELSE CASE page_id % 5 WHEN 0 THEN 'urls_plain' WHEN 1 THEN 'hosts' WHEN 2 THEN 'domains' WHEN 3 THEN 'urls_hash' ELSE 'domains' END END AS source,
  CASE WHEN page_id % 23 = 7 THEN 'url_per_line_skip_hash' ELSE CASE page_id % 5 WHEN 0 THEN 'url_per_line' WHEN 1 THEN 'hosts_file' WHEN 2 THEN 'domain_per_line_skip_hash' WHEN 3 THEN 'url_per_line_skip_hash' ELSE 'domain_per_line_skip_hash' END END AS format,
  CASE WHEN page_id % 23 = 7 THEN concat('# ', url) ELSE CASE page_id % 5 WHEN 0 THEN concat('  ', url, ' ') WHEN 1 THEN concat('0.0.0.0 ', upper(regexp_extract(url,'^[a-z]+://([^/?#]*)',1))) WHEN 2 THEN concat('*.', regexp_extract(url,'^[a-z]+://([^/?#]*)',1), '.') WHEN 3 THEN CASE WHEN page_id % 2 = 0 THEN concat('# ', url) ELSE url END ELSE CASE WHEN page_id % 2 = 0 THEN 'www.google.com' ELSE 'nodot' END END END AS line
FROM {pages}
"""

FIXTURE_SQL["whois"] = """
SELECT domain, CAST('2024-01-01' AS DATE) - CAST(min(page_id) % 400 AS INT) AS created_at FROM (SELECT regexp_extract(url,'^[a-z]+://([^/?#]*)',1) AS domain, page_id FROM {pages}) x WHERE page_id % 3 <> 0 GROUP BY domain
"""

FIXTURE_SQL["certs"] = """
SELECT domain, CAST('2024-01-01' AS DATE) - CAST(min(page_id) % 90 AS INT) AS not_before FROM (SELECT regexp_extract(url,'^[a-z]+://([^/?#]*)',1) AS domain, page_id FROM {pages}) x WHERE page_id % 4 <> 1 GROUP BY domain
"""

FIXTURE_SQL["dns_records"] = """
SELECT DISTINCT regexp_extract(url,'^[a-z]+://([^/?#]*)',1) AS domain, CASE page_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'MX' ELSE 'TXT' END AS rtype, CASE page_id % 3 WHEN 2 THEN CASE WHEN page_id % 2 = 0 THEN 'v=SPF1 -all' ELSE 'k=v' END ELSE 'x' END AS value FROM {pages}
"""

FIXTURE_SQL["redirects"] = """
SELECT p.url, h.hop_no, CASE WHEN h.hop_no = p.page_id % 5 AND p.page_id % 2 = 0 THEN concat('https://other', CAST(p.page_id AS STRING), '.test/') ELSE concat(p.url, '#', CAST(h.hop_no AS STRING)) END AS target FROM {pages} p CROSS JOIN (SELECT 1 AS hop_no UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) h WHERE h.hop_no <= p.page_id % 5 OR p.page_id % 19 = 6
"""

FIXTURE_SQL["resolutions"] = """
SELECT DISTINCT regexp_extract(url,'^[a-z]+://([^/?#]*)',1) AS domain,
  CASE page_id % 4 WHEN 0 THEN concat('10.0.0.', CAST(page_id % 200 AS STRING)) ELSE concat('203.0.', CAST(page_id % 7 AS STRING), '.', CAST(page_id % 200 AS STRING)) END AS ip
FROM {pages} WHERE page_id % 5 <> 2
"""

FIXTURE_SQL["ip_geo"] = """
SELECT DISTINCT concat('203.0.', CAST(page_id % 7 AS STRING), '.', CAST(page_id % 200 AS STRING)) AS ip,
  CASE page_id % 6 WHEN 0 THEN 'RU' WHEN 1 THEN 'US' WHEN 2 THEN 'VN' ELSE 'DE' END AS cc,
  (page_id % 7 = 3) AS proxy, (page_id % 11 = 4) AS hosting
FROM {pages} WHERE page_id % 4 <> 0
"""

FIXTURE_SQL["ct_entries"] = """
SELECT CASE x.page_id % 3 WHEN 0 THEN concat('account', CAST(x.page_id AS STRING), '.xyz') WHEN 1 THEN concat('xn--site-', CAST(x.page_id AS STRING), '.net') ELSE 'example.com' END AS root,
  concat('crt-', CAST(x.page_id AS STRING), '-', CAST(k.n AS STRING)) AS entry_id
FROM {pages} x CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE k.n <= x.page_id % 4
"""

FIXTURE_SQL["reputation"] = """
SELECT url, CAST(page_id % 5 AS INT) AS malicious, CAST(page_id % 2 AS INT) AS suspicious, CAST(60 AS INT) AS harmless, CAST(page_id % 9 AS INT) AS undetected FROM {pages} WHERE page_id % 4 <> 0
"""

FIXTURE_SQL["gsb_hits"] = """
SELECT url FROM {pages} WHERE page_id % 17 = 0
"""

FIXTURE_SQL["page_html"] = """
SELECT page_id, url, concat(CASE page_id % 6 WHEN 0 THEN '<form action="http://evil.test/x"><INPUT TYPE="password"></form>' WHEN 1 THEN '<iframe src="a" width="0"></iframe>' WHEN 2 THEN '<title>PayPal
 login</title>' WHEN 3 THEN '<form action="/local">' WHEN 4 THEN '<iframe style="display: none">' ELSE '' END, html) AS html FROM {pages}
"""

FIXTURE_SQL["model_scores"] = """
SELECT page_id, CAST((page_id * 37) % 101 AS DOUBLE) / 100 AS rf_prob, CASE WHEN page_id % 7 = 0 THEN NULL ELSE CAST((page_id * 53) % 101 AS DOUBLE) / 100 END AS nn_prob FROM {pages}
"""

# raw allow-list submissions (before S14 cleaning)
FIXTURE_SQL["allowlist_requests"] = """
SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN concat(' ', upper(url), ' ') WHEN 1 THEN regexp_extract(url,'^[a-z]+://([^/?#]*)',1) WHEN 2 THEN 'localhost' ELSE url END AS domain
FROM {pages} WHERE page_id % 9 = 0 OR page_id % 13 = 0
"""

# retrain log events (one row per status change)
FIXTURE_SQL["retrain_log"] = """
SELECT CAST(page_id AS BIGINT) AS id, CAST('2024-01-01 00:00:00' AS TIMESTAMP) + (page_id % 40) * INTERVAL 1 HOUR AS triggered_at,
  CAST(page_id % 7 AS INT) AS new_safe, CAST(page_id % 5 AS INT) AS new_phishing,
  CASE WHEN page_id % 4 IN (1, 2) THEN CAST(80 + page_id % 20 AS DOUBLE) / 100 ELSE 0.0 END AS accuracy,
  CASE page_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'done' WHEN 2 THEN 'rejected_low_accuracy' ELSE 'failed' END AS status,
  CAST(floor(page_id / 4.0) AS BIGINT) AS run_id
FROM {pages}
"""

# raw report submissions (before S12 validation)
FIXTURE_SQL["report_requests"] = """
SELECT e.event_id AS id,
  CASE WHEN e.event_id % 23 = 0 THEN repeat(p.url, 60) ELSE p.url END AS url,
  CASE e.event_id % 6 WHEN 0 THEN ' Safe ' WHEN 1 THEN 'PHISHING' WHEN 2 THEN 'spam' WHEN 3 THEN 'phishing' WHEN 4 THEN 'safe' ELSE '' END AS label,
  CASE WHEN e.event_id % 5 = 0 THEN repeat('n', 700) ELSE e.props END AS note,
  e.event_type AS reported_label, e.ts AS timestamp
FROM (SELECT e0.*, e0.event_id % c.n AS pid FROM {events} e0 CROSS JOIN (SELECT count(*) AS n FROM {pages}) c) e
JOIN {pages} p ON p.page_id = e.pid
"""

# which fixtures each derivation reads
_DEPENDS = {"scans": ("events", "pages"), "reports": ("events", "pages"),
            "report_requests": ("events", "pages")}


def fixture_sql_for(name: str, dialect: str = "spark") -> str:
    """The derivation text; for DuckDB the placeholders become view names."""
    text = FIXTURE_SQL[name]
    if dialect == "duckdb":
        text = text.replace("{pages}", "pages").replace("{events}", "events")
        text = text.replace("* INTERVAL 1 HOUR", "* INTERVAL '1 hour'")
    return text


def fixture(spark: SparkSession, sf_dir: str, name: str, base: dict | None = None) -> DataFrame:
    """Build one fixture table from the base tables under ``sf_dir`` (or from
    those given in ``base``, which a caller of several fixtures reads once)."""
    deps = _DEPENDS.get(name, ("pages",))
    args = {d: base[d] if base and d in base else read_table(spark, sf_dir, d) for d in deps}
    text = FIXTURE_SQL[name]
    return spark.sql(text, **args)
