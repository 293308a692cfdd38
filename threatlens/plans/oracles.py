"""Oracle SQL registry, keyed like :data:`threatlens.plans.queries.QUERIES`."""

from __future__ import annotations

from ..functions import lists
from . import oracle_sql as o

ORACLES: dict[str, str] = {}

_CORPUS = "SELECT page_id, url FROM url_corpus"

ORACLES["url_split"] = o.with_fixtures(["url_corpus"], f"""
SELECT page_id, url, scheme, netloc, path, params, query, fragment FROM ({o.url_parts_sql(_CORPUS)}) x""")

_NORM_SRC = """SELECT page_id AS id, url FROM url_corpus UNION ALL SELECT -id - 1 AS id, url FROM scans UNION ALL SELECT -id - 1099511627776 AS id, url FROM odd_requests"""
_WS = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = f"regexp_replace(url, '^{_WS}+|{_WS}+$', '', 'g')"
_PREF = (f"CASE WHEN starts_with(s, 'http://') OR starts_with(s, 'https://') THEN s ELSE 'https://' || s END")
_TRACK = lists.TRACKING_PARAM_PATTERN
ORACLES["url_normalize"] = o.with_fixtures(["url_corpus", "scans", "odd_requests"], f"""
SELECT id, raw AS url, error,
  scheme || '://' || netloc || CASE WHEN params <> '' THEN path || ';' || params ELSE path END
    || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS normalized,
  ({' OR '.join(f"starts_with(scheme || '://' || netloc || CASE WHEN params <> '' THEN path || ';' || params ELSE path END || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END, {o.q(p)})" for p in lists.SKIP_PREFIXES)}) AS skipped
FROM (SELECT *, regexp_replace(regexp_replace(query, {o.q(_TRACK)}, '', 'g'), '^&+|&+$', '', 'g') AS q2
      FROM ({o.url_parts_sql("SELECT id, raw, error, " + _PREF + " AS url FROM (SELECT id, url AS raw, CASE WHEN url IS NULL THEN 'Missing url' WHEN " + _STRIP + " = '' THEN 'Empty url' WHEN length(" + _STRIP + ") > 2048 THEN 'URL too long (max 2048 chars)' END AS error, " + _STRIP + " AS s FROM (" + _NORM_SRC + ") n0) n1")}) p) x""")

ORACLES["host_variants"] = o.with_fixtures(["url_corpus"], f"""
SELECT page_id, url, host,
  regexp_replace(host, '\\.+$', '') AS feed_host,
  replace(lower(netloc), 'www.', '') AS dynamic_host,
  replace(host, 'www.', '') AS purge_host,
  replace(replace(substr(url, instr(url, '://') + 3,
     CASE WHEN instr(substr(url, instr(url, '://') + 3), '/') > 0 THEN instr(substr(url, instr(url, '://') + 3), '/') - 1
          ELSE length(url) END), 'www.', ''), 'http://', '') AS report_host,
  CASE WHEN len(string_split(replace(host, 'www.', ''), '.')) >= 2
       THEN array_to_string(list_slice(string_split(replace(host, 'www.', ''), '.'), -2, -1), '.') ELSE host END AS root
FROM ({o.url_parts_sql(_CORPUS)}) x""")

ORACLES["url_features"] = o.with_fixtures(["url_corpus"], f"""
SELECT page_id, url, host, {', '.join(o.LEXICAL_KEYS)} FROM ({o.lexical_features_sql(_CORPUS)}) x""")

_BULK = o.rule_verdict_sql(f"SELECT *, false AS is_new_domain FROM ({o.lexical_features_sql(_CORPUS)}) lf")
ORACLES["rule_verdicts"] = o.with_fixtures(["url_corpus"], f"""
SELECT page_id, url, rule_score, result, confidence,
  {o.risk_level_sql("CASE WHEN result = 'PHISHING' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END", 'result')} AS risk_level
FROM ({_BULK}) b""")

ORACLES["verdict_summary"] = o.with_fixtures(["url_corpus"], f"""
SELECT result, risk_level, count(*)::BIGINT AS n_urls, sum(rule_score)::BIGINT AS sum_score,
  min(confidence)::BIGINT AS min_confidence, max(confidence)::BIGINT AS max_confidence
FROM (SELECT *, {o.risk_level_sql("CASE WHEN result = 'PHISHING' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END", 'result')} AS risk_level
      FROM ({_BULK}) b) r
GROUP BY result, risk_level""")


# ---- feeds -------------------------------------------------------------------------
_FEED = o.feed_lines_ctes()
ORACLES["feed_entries"] = o.with_fixtures(["feed_lines"], "SELECT source, kind, value FROM parsed", _FEED)
ORACLES["feed_urls"] = o.with_fixtures(["feed_lines"], "SELECT url FROM feed_urls", _FEED)
ORACLES["feed_domains"] = o.with_fixtures(["feed_lines"], "SELECT domain FROM feed_domains", _FEED)
ORACLES["feed_stats"] = o.with_fixtures(["feed_lines"], """
SELECT c.source, coalesce(CASE WHEN c.format IN ('url_per_line', 'url_per_line_skip_hash') THEN s.u ELSE s.d END, 0)::BIGINT AS count,
  CASE WHEN c.landed THEN 'OK' ELSE 'HTTP ERR' END AS status
FROM (SELECT DISTINCT source, format, true AS landed FROM feed_lines UNION ALL SELECT 'offline_source', 'url_per_line', false) c
LEFT JOIN (SELECT source, count(*) FILTER (WHERE kind = 'url') AS u, count(*) FILTER (WHERE kind = 'domain') AS d
           FROM parsed GROUP BY source) s ON s.source = c.source""", _FEED)
ORACLES["feed_folder_entries"] = o.with_fixtures(["feed_lines"], """
SELECT source, kind, value, NULL::BIGINT AS lines FROM parsed WHERE source <> 'hosts'
UNION ALL SELECT source, 'unknown source', NULL, count(*)::BIGINT FROM feed_lines WHERE source = 'hosts' GROUP BY source""", _FEED)
ORACLES["feed_totals"] = o.with_fixtures(["feed_lines"], """
SELECT u.n AS total_urls, d.n AS total_domains, (u.n + d.n)::BIGINT AS total_entries
FROM (SELECT count(*)::BIGINT AS n FROM feed_urls) u, (SELECT count(*)::BIGINT AS n FROM feed_domains) d""", _FEED)

# ---- J1-J5 -------------------------------------------------------------------------
_ALLOW = lists.DEFAULT_ALLOWLIST + ["example.net"]
ORACLES["allowlist_static_match"] = o.with_fixtures(["url_corpus", "page_html"], f"""
SELECT h.host, EXISTS (SELECT 1 FROM (SELECT unnest({o.static_candidates_sql('h.host')}) AS c) x
                       WHERE x.c IN {o.in_list(_ALLOW)}) AS allowlisted
FROM (SELECT DISTINCT host FROM probe) h""", o.probe_cte())

_CONS_FIX = ["reports", "allowlist_requests"]
ORACLES["allowlist_dynamic_match"] = o.with_fixtures(["url_corpus", "page_html"] + _CONS_FIX, """
SELECT h.host, replace(lower(h.host), 'www.', '') IN (SELECT domain FROM dyn_allow) AS allowlisted
FROM (SELECT DISTINCT host FROM probe) h""",
    ",\n".join([o.probe_cte(), f"cons AS ({o.consensus_sql('SELECT * FROM reports')})",
                o.user_allowlist_cte(), o.dynamic_allowlist_cte()]))

_GUARD = o.in_list(lists.NEVER_PHISHING)
ORACLES["blocklist_match"] = o.with_fixtures(["url_corpus", "page_html", "feed_lines"], f"""
SELECT url, host, feed_host, in_feed_url, in_feed_domain, (in_feed_url OR in_feed_domain) AS blocked FROM (
  SELECT p.url, p.host, p.feed_host,
    (p.url IN (SELECT url FROM feed_urls) OR regexp_replace(p.url, '/+$', '') IN (SELECT url FROM feed_urls)) AS in_feed_url,
    (replace(p.feed_host, 'www.', '') NOT IN {_GUARD} AND EXISTS (
       SELECT 1 FROM (SELECT unnest({o.suffixes_sql('p.feed_host', 1)}) AS c) x WHERE x.c IN (SELECT domain FROM feed_domains))) AS in_feed_domain
  FROM (SELECT url, host, regexp_replace(host, '\\.+$', '') AS feed_host FROM probe) p) z""",
    ",\n".join([o.probe_cte(), _FEED]))

ORACLES["dynamic_allowlist"] = o.with_fixtures(_CONS_FIX, "SELECT domain FROM dyn_allow", ",\n".join([
    f"cons AS ({o.consensus_sql('SELECT * FROM reports')})", o.user_allowlist_cte(), o.dynamic_allowlist_cte()]))
ORACLES["allowlist_additions"] = o.with_fixtures(["allowlist_requests"], "SELECT domain FROM user_allow",
                                                 o.user_allowlist_cte())

ORACLES["allowlist_new_hosts"] = o.with_fixtures(["allowlist_requests", "reports"], f"""
SELECT domain FROM user_allow EXCEPT
SELECT replace(lower({o.netloc_sql('url')}), 'www.', '') FROM cons WHERE decision = 'safe'""",
                                                 f"{o.user_allowlist_cte()}, cons AS ({o.consensus_sql('SELECT * FROM reports')})")

# ---- consensus ---------------------------------------------------------------------
ORACLES["report_consensus"] = o.with_fixtures(["reports"], f"""
SELECT url, pending_safe, pending_phishing, all_safe, all_phishing, decision, report_count::BIGINT AS report_count
FROM ({o.consensus_sql('SELECT * FROM reports')}) c""")
ORACLES["reports_after_verify"] = o.with_fixtures(["reports"], f"""
SELECT r.id, r.url, r.label, (CASE WHEN c.url IS NOT NULL THEN 1 ELSE r.used_in_verify END)::BIGINT AS used_in_verify
FROM reports r LEFT JOIN (SELECT url, decision FROM cons WHERE decision IN ('safe', 'phishing')) c
  ON r.url = c.url AND r.label = c.decision""", f"cons AS ({o.consensus_sql('SELECT * FROM reports')})")
_VER = o.verified_ctes()
ORACLES["verified_urls_upsert"] = o.with_fixtures(["reports"], """
SELECT url, label, report_count::BIGINT AS report_count, used_in_train::BIGINT AS used_in_train,
  strftime(verified_at, '%Y-%m-%d %H:%M:%S') AS verified_at FROM verified""", _VER)
ORACLES["pending_training_rows"] = o.with_fixtures(["reports"], "SELECT url, label FROM verified WHERE used_in_train = 0", _VER)
ORACLES["mark_trained"] = o.with_fixtures(["reports"], """
SELECT url, label, (CASE WHEN used_in_train = 0 AND label = 'phishing' THEN 1 ELSE used_in_train END)::BIGINT AS used_in_train
FROM verified""", _VER)
ORACLES["verified_safe_domains"] = o.with_fixtures(["reports"], f"""
SELECT DISTINCT domain FROM (SELECT replace(lower({o.netloc_sql('url')}), 'www.', '') AS domain FROM verified
  WHERE label = 'safe' AND used_in_train = 1) d WHERE domain <> ''""", _VER)
ORACLES["retrain_trigger"] = o.with_fixtures(["reports"], f"""
SELECT n AS pending, greatest(0, {lists.MIN_NEW_REPORTS_TO_RETRAIN} - n)::BIGINT AS remaining, (n >= {lists.MIN_NEW_REPORTS_TO_RETRAIN}) AS trigger
FROM (SELECT count(*)::BIGINT AS n FROM verified WHERE used_in_train = 0) x""", _VER)
ORACLES["retrain_status"] = o.with_fixtures(["reports", "retrain_log"], f"""
SELECT r.*, v.*, strftime(l.triggered_at, '%Y-%m-%d %H:%M:%S') AS last_triggered_at, l.accuracy AS last_accuracy,
  l.status AS last_status, {lists.SAFE_REPORT_THRESHOLD}::BIGINT AS safe_reports_needed,
  {lists.PHISHING_REPORT_THRESHOLD}::BIGINT AS phishing_reports_needed,
  {lists.MIN_NEW_REPORTS_TO_RETRAIN}::BIGINT AS min_to_trigger_retrain, {lists.MIN_ACCURACY_TO_REPLACE}::DOUBLE AS min_accuracy_to_replace
FROM (SELECT count(DISTINCT url) FILTER (WHERE label = 'safe' AND uv = 0)::BIGINT AS pending_safe_reports,
             count(DISTINCT url) FILTER (WHERE label = 'phishing' AND uv = 0)::BIGINT AS pending_phishing_reports
      FROM (SELECT r.url, r.label, CASE WHEN c.url IS NOT NULL THEN 1 ELSE r.used_in_verify END AS uv
            FROM reports r LEFT JOIN (SELECT url, decision FROM cons WHERE decision IN ('safe', 'phishing')) c
              ON r.url = c.url AND r.label = c.decision) rr) r,
     (SELECT count(*) FILTER (WHERE label = 'safe')::BIGINT AS verified_safe_urls,
             count(*) FILTER (WHERE label = 'phishing')::BIGINT AS verified_phishing_urls FROM verified) v,
     (SELECT triggered_at, accuracy, status FROM retrain_log ORDER BY id DESC LIMIT 1) l""", _VER)
ORACLES["retrain_log_latest"] = o.with_fixtures(["retrain_log"], """
SELECT run_id, id, strftime(triggered_at, '%Y-%m-%d %H:%M:%S') AS triggered_at, new_safe::BIGINT AS new_safe,
  new_phishing::BIGINT AS new_phishing, accuracy, status
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS rn FROM retrain_log) x WHERE rn = 1""")
ORACLES["report_tally"] = o.with_fixtures(["reports"], f"""
SELECT url, label, cnt, needed, greatest(0, needed - cnt)::BIGINT AS remaining, (cnt >= needed) AS verified,
  (processed = 1) AS processed, last_report
FROM (SELECT url, label, count(*)::BIGINT AS cnt, max(timestamp) AS last_report, min(used_in_verify) AS processed,
        (CASE WHEN label = 'safe' THEN {lists.SAFE_REPORT_THRESHOLD} ELSE {lists.PHISHING_REPORT_THRESHOLD} END)::BIGINT AS needed
      FROM reports GROUP BY url, label) g
ORDER BY cnt DESC, last_report DESC, url, label LIMIT 100""")

# ---- reporting -----------------------------------------------------------------------
_NOT_LOCAL = "url NOT ILIKE 'http://localhost%'"
_NOT_BROWSER = "url NOT ILIKE 'chrome://%' AND url NOT ILIKE 'about:%'"
ORACLES["scan_totals"] = o.with_fixtures(["scans"], """
SELECT total, phishing, suspicious, (total - phishing - suspicious)::BIGINT AS safe,
  CASE WHEN total > 0 THEN floor(phishing / total * 1000.0 + 0.5) / 10.0 ELSE 0.0 END AS phishing_rate
FROM (SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE result = 'PHISHING')::BIGINT AS phishing,
             count(*) FILTER (WHERE result = 'SUSPICIOUS')::BIGINT AS suspicious FROM scans) t""")
ORACLES["dashboard_kpis"] = o.with_fixtures(["scans"], f"""
SELECT count(*)::BIGINT AS total, coalesce(sum(CASE WHEN result = 'PHISHING' THEN 1 ELSE 0 END), 0)::BIGINT AS phishing,
  coalesce(sum(CASE WHEN result = 'SAFE' THEN 1 ELSE 0 END), 0)::BIGINT AS safe,
  coalesce(sum(CASE WHEN result = 'SUSPICIOUS' THEN 1 ELSE 0 END), 0)::BIGINT AS suspicious
FROM scans WHERE {_NOT_LOCAL} AND {_NOT_BROWSER}""")
ORACLES["daily_activity"] = o.with_fixtures(["scans"], f"""
SELECT CAST(timestamp AS DATE) AS day, count(*)::BIGINT AS scans,
  sum(CASE WHEN result = 'PHISHING' THEN 1 ELSE 0 END)::BIGINT AS phishing
FROM scans WHERE {_NOT_LOCAL} AND url NOT ILIKE 'chrome://%'
GROUP BY CAST(timestamp AS DATE) ORDER BY day DESC LIMIT 7""")
_SC = "id, url, result, ml_result, lstm_result, vt_result, confidence::BIGINT AS confidence, vt_ratio, timestamp"
ORACLES["recent_scans"] = o.with_fixtures(["scans"], f"""
SELECT {_SC} FROM scans WHERE {_NOT_BROWSER} ORDER BY timestamp DESC, id DESC LIMIT 50""")
ORACLES["scan_history"] = o.with_fixtures(["scans"], f"""
SELECT {_SC} FROM scans ORDER BY timestamp DESC, id DESC LIMIT 200""")
ORACLES["top_phishing_domains"] = o.with_fixtures(["scans"], f"""
SELECT replace(replace(substr(url, instr(url, '://') + 3,
    CASE WHEN instr(substr(url, instr(url, '://') + 3), '/') > 0 THEN instr(substr(url, instr(url, '://') + 3), '/') - 1
         ELSE length(url) END), 'www.', ''), 'http://', '') AS domain, count(*)::BIGINT AS cnt
FROM scans WHERE result = 'PHISHING' AND {_NOT_LOCAL}
GROUP BY 1 ORDER BY cnt DESC, domain LIMIT 8""")
_PURGE_RULE = ("CASE WHEN result = 'PHISHING' AND (h IN {a} OR replace(h, 'www.', '') IN {a}) THEN 'allowed_domain' "
               .format(a=o.in_list(lists.PURGE_ALLOWED_DOMAINS))
               + " ".join(f"WHEN url ILIKE {o.q(p)} THEN {o.q(p)}" for p in lists.PURGE_INTERNAL_PATTERNS) + " END")
ORACLES["scans_purged"] = o.with_fixtures(["scans"], f"""
SELECT id, url, result FROM (SELECT *, {_PURGE_RULE} AS purge_rule FROM (SELECT *, {o.host_sql('url')} AS h FROM scans) s) x
WHERE purge_rule IS NULL""")
ORACLES["purge_report"] = o.with_fixtures(["scans"], f"""
SELECT purge_rule, count(*)::BIGINT AS removed FROM (SELECT *, {_PURGE_RULE} AS purge_rule
  FROM (SELECT *, {o.host_sql('url')} AS h FROM scans) s) x WHERE purge_rule IS NOT NULL GROUP BY purge_rule""")
_LAB = o.strip_sql("lower(label)")
ORACLES["report_validation"] = o.with_fixtures(["report_requests"], f"""
SELECT id, substr(url, 1, 2048) AS url, {_LAB} AS label, substr(coalesce(note, ''), 1, 500) AS note, 0::BIGINT AS used_in_verify,
  CASE WHEN url IS NULL OR label IS NULL THEN 'Missing url or label'
       WHEN {_LAB} NOT IN ('safe', 'phishing') THEN 'Label must be ''safe'' or ''phishing''' END AS error
FROM report_requests""")
ORACLES["feedback_reports"] = o.with_fixtures(["report_requests"], f"""
SELECT id, substr(url, 1, 2048) AS url, {_LAB} AS label,
  substr('[feedback] was ' || reported_label || ', correct=' || {_LAB} || '. ' || coalesce(note, ''), 1, 500) AS note,
  CASE WHEN url IS NULL OR label IS NULL OR reported_label IS NULL THEN 'Missing fields'
       WHEN {_LAB} NOT IN ('safe', 'phishing') THEN 'correct_label must be ''safe'' or ''phishing''' END AS error
FROM report_requests""")


# ---- enrichment, ensemble, routing -----------------------------------------------------
_FEAT_SRC = ("SELECT page_id AS id, url FROM url_corpus UNION ALL "
             "SELECT -page_id - 1 AS id, url FROM page_html")
_ENR = o.enriched_sql(o.lexical_features_sql(_FEAT_SRC))
_ENR_FIX = ["url_corpus"] + o.ENRICH_FIXTURES
_FEATURE_KEYS = ["url_length", "has_ip", "has_at", "is_https", "suspicious_keywords", "dot_count", "subdomain_count",
                 "has_redirect", "has_hex", "domain_length", "path_depth", "has_dash_in_domain", "has_query",
                 "query_param_count", "domain_has_digits", "suspicious_tld", "has_double_slash",
                 "longest_word_length", "domain_entropy", "high_entropy_domain", "brand_impersonation",
                 "domain_age_days", "is_new_domain", "ssl_cert_age_days", "new_ssl_cert", "dns_resolves",
                 "has_mx_record", "has_spf_record", "typosquatting", "homograph_attack", "gsb_flagged",
                 "redirect_hop_count", "redirect_domain_changed", "redirect_chain_suspicious",
                 "high_risk_country", "is_proxy_hosting", "cert_transparency_count", "low_cert_history",
                 "has_password_field", "title_brand_mismatch", "has_hidden_iframe", "form_external_action",
                 "path_login_keyword"]
ORACLES["enriched_features"] = o.with_fixtures(_ENR_FIX, f"""
SELECT id, url, {', '.join(_FEATURE_KEYS)} FROM ({_ENR}) e""", o.enrichment_ctes())
ORACLES["fact_store_features"] = ORACLES["enriched_features"]
ORACLES["reputation_enrich"] = o.with_fixtures(_ENR_FIX, f"""
SELECT id, url, vt_result, vt_positives, vt_total, vt_ratio, vt_prob, gsb_flagged FROM ({_ENR}) e""", o.enrichment_ctes())
_ENS = o.ensemble_sql(f"SELECT e.*, ms.rf_prob, ms.nn_prob FROM ({_ENR}) e LEFT JOIN model_scores ms ON e.id = ms.page_id")
ORACLES["ensemble_verdicts"] = o.with_fixtures(_ENR_FIX + ["model_scores"], f"""
SELECT id, url, rule_score, rf_result, rf_confidence, nn_result, nn_confidence, weighted_score, votes, result,
  confidence, risk_level, reasons FROM ({_ENS}) v""", o.enrichment_ctes())

# full routing
_ERR = (f"CASE WHEN url IS NULL THEN 'Missing url' WHEN {o.strip_sql('url')} = '' THEN 'Empty url' "
        f"WHEN length({o.strip_sql('url')}) > 2048 THEN 'URL too long (max 2048 chars)' END")
_REQ = f"""req AS (SELECT id, raw_url, error, CASE WHEN error IS NULL THEN {o.normalize_sql('raw_url')} END AS url FROM (
    SELECT id, url AS raw_url, {_ERR} AS error FROM (
      SELECT page_id AS id, url FROM url_corpus UNION ALL SELECT -id - 1 AS id, url FROM scans UNION ALL SELECT -id - 1099511627776 AS id, url FROM odd_requests) a) b),
req2 AS (SELECT *, coalesce(({' OR '.join(f"starts_with(url, {o.q(p)})" for p in lists.SKIP_PREFIXES)}), false) AS skipped FROM req),
lex AS ({o.lexical_features_sql('SELECT * FROM req2')}),
hflags AS (SELECT host,
    EXISTS (SELECT 1 FROM (SELECT unnest({o.static_candidates_sql('h.host')}) AS c) x WHERE x.c IN {o.in_list(_ALLOW)}) AS in_static,
    replace(lower(host), 'www.', '') IN (SELECT domain FROM dyn_allow) AS in_dynamic,
    (replace(regexp_replace(host, '\\.+$', ''), 'www.', '') NOT IN {_GUARD} AND EXISTS (
       SELECT 1 FROM (SELECT unnest({o.suffixes_sql("regexp_replace(h.host, '\\.+$', '')", 1)}) AS c) x
       WHERE x.c IN (SELECT domain FROM feed_domains))) AS in_feed_domain
  FROM (SELECT DISTINCT host FROM lex WHERE error IS NULL AND NOT skipped) h),
lexf AS (SELECT l.*, hf2.in_static, hf2.in_dynamic, hf2.in_feed_domain,
    coalesce(l.url IN (SELECT url FROM feed_urls) OR regexp_replace(l.url, '/+$', '') IN (SELECT url FROM feed_urls), false) AS in_feed_url
  FROM lex l LEFT JOIN hflags hf2 ON l.host = hf2.host)"""
_ROUTE_CTES = ",\n".join([o.enrichment_ctes(), _FEED, f"cons AS ({o.consensus_sql('SELECT * FROM reports')})",
                          o.user_allowlist_cte(), o.dynamic_allowlist_cte(), _REQ])
_RENS = o.ensemble_sql(f"SELECT e.*, ms.rf_prob, ms.nn_prob FROM ({o.enriched_sql('SELECT * FROM lexf')}) e "
                       "LEFT JOIN model_scores ms ON e.id = ms.page_id")
_ROUTED = f"""
SELECT v.*,
  CASE WHEN route = 'error' THEN 'ERROR' WHEN route IN ('skipped', 'allowlist') THEN 'SAFE'
       WHEN route = 'blocklist' THEN 'PHISHING' ELSE result END AS final_result,
  CASE WHEN route = 'error' THEN NULL WHEN route IN ('skipped', 'allowlist') THEN 100
       WHEN route = 'blocklist' THEN 99 ELSE confidence END::BIGINT AS final_confidence,
  CASE WHEN route = 'error' THEN NULL WHEN route IN ('skipped', 'allowlist') THEN 'SAFE'
       WHEN route = 'blocklist' THEN 'CRITICAL' ELSE risk_level END AS final_risk,
  CASE WHEN route = 'allowlist' THEN CASE WHEN coalesce(in_static, false) THEN 'static_whitelist' ELSE 'user_verified' END END AS whitelist_source,
  CASE WHEN route = 'scored' THEN reasons WHEN route = 'blocklist' THEN 'blocklist' ELSE '' END AS final_reasons
FROM (SELECT u.*, CASE WHEN error IS NOT NULL THEN 'error' WHEN skipped THEN 'skipped'
                  WHEN coalesce(in_static, false) OR coalesce(in_dynamic, false) THEN 'allowlist'
                  WHEN coalesce(in_feed_url, false) OR coalesce(in_feed_domain, false) THEN 'blocklist'
                  ELSE 'scored' END AS route FROM ({_RENS}) u) v"""
_ROUTE_FIX = ["url_corpus", "scans", "odd_requests", "feed_lines", "reports", "allowlist_requests", "model_scores"] + o.ENRICH_FIXTURES
ORACLES["routed_verdicts"] = o.with_fixtures(_ROUTE_FIX, f"""
SELECT id, url, route, final_result AS result, final_confidence AS confidence, final_risk AS risk_level, whitelist_source,
  final_reasons AS reasons, CASE WHEN route = 'scored' THEN weighted_score END AS weighted_score,
  CASE WHEN route = 'scored' THEN votes END AS votes FROM ({_ROUTED}) r""", _ROUTE_CTES)
ORACLES["cached_routes"] = o.with_fixtures(_ROUTE_FIX, f"""
SELECT r.id, r.url, CASE WHEN hit THEN 'cached' ELSE route END AS route,
  CASE WHEN hit THEN 'R' || c.age ELSE final_result END AS result, CASE WHEN hit THEN c.age ELSE final_confidence END::BIGINT AS confidence,
  CASE WHEN hit THEN 'LOW' ELSE final_risk END AS risk_level
FROM ({_ROUTED}) r LEFT JOIN stored c ON r.url = c.n,
LATERAL (SELECT c.n IS NOT NULL AND r.route NOT IN ('error', 'skipped') AS hit) h""", _ROUTE_CTES + f""",
-- the youngest result below the TTL of 300 seconds; every page has one 299 old, most one 100 old
kept AS (SELECT {o.normalize_sql('url')} AS n, page_id FROM page_html WHERE page_id % 6 = 1),
gone AS (SELECT url AS n FROM page_html WHERE page_id % 6 = 1 AND page_id % 5 = 2),
stored AS (SELECT n, min(CASE WHEN page_id % 4 <> 3 THEN 100 ELSE 299 END) AS age FROM kept WHERE n NOT IN (SELECT n FROM gone) GROUP BY n)""")
ORACLES["scan_log_rows"] = o.with_fixtures(_ROUTE_FIX, f"""
SELECT id, url, final_result AS result,
  CASE WHEN route = 'blocklist' THEN 'BLOCKLIST' ELSE rf_result END AS ml_result,
  CASE WHEN route = 'blocklist' THEN 'N/A' ELSE coalesce(nn_result, 'N/A') END AS lstm_result,
  CASE WHEN route = 'blocklist' THEN 'BLOCKLIST' ELSE vt_result END AS vt_result,
  final_confidence AS confidence, CASE WHEN route = 'blocklist' THEN 'N/A' ELSE vt_ratio END AS vt_ratio
FROM ({_ROUTED}) r WHERE route IN ('blocklist', 'scored')
  AND NOT ({' OR '.join(f"starts_with(url, {o.q(p)})" for p in lists.NO_LOG_PREFIXES)})""", _ROUTE_CTES)
ORACLES["scan_log_roundtrip"] = o.with_fixtures(_ROUTE_FIX, f"""
SELECT r.d AS date, count(*)::BIGINT AS scans, count(*) FILTER (WHERE r.final_result = 'PHISHING')::BIGINT AS phishing
FROM (SELECT v.*, s.timestamp::DATE AS d FROM ({_ROUTED}) v JOIN scans s ON v.id = -s.id - 1) r
WHERE route IN ('blocklist', 'scored') AND NOT ({' OR '.join(f"starts_with(url, {o.q(p)})" for p in lists.NO_LOG_PREFIXES)})
GROUP BY r.d""", _ROUTE_CTES)


def _doc(allow: str, block: str, own: str) -> str:
    return f"CASE route WHEN 'allowlist' THEN {allow} WHEN 'blocklist' THEN {block} WHEN 'scored' THEN {own} END"


_LISTED = lambda own: _doc("'SAFE'", "'PHISHING'", own)
_COLOURS = " ".join(f"WHEN {o.q(r[0])} THEN {o.q(r[1])}" for r in (
    lists.RISK_SAFE, lists.RISK_LOW, lists.RISK_MEDIUM, lists.RISK_HIGH, lists.RISK_CRITICAL))
ORACLES["verdict_documents"] = o.with_fixtures(_ROUTE_FIX, f"""
SELECT id, route, final_result AS result, final_confidence AS confidence, final_risk AS risk_level,
  CASE final_risk {_COLOURS} END AS risk_color,
  CASE route WHEN 'blocklist' THEN 1 WHEN 'scored' THEN
    CASE WHEN final_reasons = '' THEN 0 ELSE len(string_split(final_reasons, ',')) END ELSE 0 END::BIGINT AS n_reasons,
  CASE WHEN route = 'blocklist' THEN 'Threat feed blocklist' END AS source,
  {_LISTED('rf_result')} AS rf, {_LISTED("coalesce(nn_result, 'unavailable')")} AS lstm, {_LISTED('vt_result')} AS vt,
  {_LISTED("CASE WHEN gsb_flagged THEN 'PHISHING' ELSE 'SAFE' END")} AS gsb,
  ({_doc('0', '1', 'vt_positives')})::BIGINT AS positives, ({_doc('0', '1', 'vt_total')})::BIGINT AS total,
  {_doc("'0/0'", "'1/1'", 'vt_ratio')} AS vt_ratio,
  CASE WHEN route = 'scored' THEN redirect_hop_count END::BIGINT AS redirect_hops,
  CASE WHEN route = 'scored' THEN length(url) END::BIGINT AS url_length, route = 'allowlist' AS whitelisted, whitelist_source,
  route = 'skipped' AS skipped
FROM ({_ROUTED}) r""", _ROUTE_CTES)
ORACLES["verdict_counters"] = o.with_fixtures(_ROUTE_FIX, f"""
SELECT count(*) FILTER (WHERE route = 'scored')::BIGINT AS total_scans,
  count(*) FILTER (WHERE route = 'scored' AND final_result = 'PHISHING')::BIGINT AS result_phishing,
  count(*) FILTER (WHERE route = 'scored' AND final_result = 'SUSPICIOUS')::BIGINT AS result_suspicious,
  count(*) FILTER (WHERE route = 'scored' AND final_result = 'SAFE')::BIGINT AS result_safe,
  0::BIGINT AS cache_hits, count(*) FILTER (WHERE route = 'blocklist')::BIGINT AS blocklist_hits,
  count(*) FILTER (WHERE route = 'scored' AND vt_result = 'UNAVAILABLE')::BIGINT AS vt_unavailable,
  count(*) FILTER (WHERE route = 'scored' AND gsb_flagged)::BIGINT AS gsb_flagged_count
FROM ({_ROUTED}) r""", _ROUTE_CTES)


# ---- ML ------------------------------------------------------------------------------------
_LABELLED = ("labelled AS (SELECT page_id, url, CASE WHEN page_id % 8 IN (1, 2, 3, 4, 6) THEN 'phishing' ELSE 'safe' END AS label "
             "FROM url_corpus)")
ORACLES["labelled_corpus"] = o.with_fixtures(["url_corpus"], """
SELECT page_id, url, label, (dense_rank() OVER (ORDER BY label) - 1)::BIGINT AS label_index,
  (label = 'phishing')::BIGINT AS y FROM labelled""", _LABELLED)
ORACLES["train_test_split"] = o.with_fixtures(["url_corpus"], """
SELECT page_id, url, b AS bucket, CASE WHEN b < 80 THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, (('0x' || substr(md5(url), 1, 8))::BIGINT % 100)::BIGINT AS b FROM labelled) x""", _LABELLED)
ORACLES["class_distribution"] = o.with_fixtures(["url_corpus"], """
SELECT label, count(*)::BIGINT AS n FROM labelled GROUP BY label""", _LABELLED)
ORACLES["training_set"] = o.with_fixtures(["url_corpus", "reports"], """
SELECT url, (label = 'phishing')::BIGINT AS y, 'base' AS source, 1::BIGINT AS copy FROM labelled
UNION ALL
SELECT url, CASE WHEN lower(label) = 'safe' THEN 0 ELSE 1 END::BIGINT AS y, 'verified' AS source, c.copy::BIGINT AS copy
FROM verified, (SELECT unnest(range(1, 6)) AS copy) c WHERE used_in_train = 0""", ",\n".join([_LABELLED, _VER]))
ORACLES["model_evaluation"] = o.with_fixtures(["url_corpus", "model_scores"], """
SELECT tp, fp, tn, fn,
  CASE WHEN n > 0 THEN (tp + tn)::DOUBLE / n ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0
       THEN 2.0 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / ((tp::DOUBLE / (tp + fp)) + (tp::DOUBLE / (tp + fn)))
       ELSE 0.0 END AS f1
FROM (SELECT count(*) FILTER (WHERE y = 1 AND p = 1)::BIGINT AS tp, count(*) FILTER (WHERE y = 0 AND p = 1)::BIGINT AS fp,
             count(*) FILTER (WHERE y = 0 AND p = 0)::BIGINT AS tn, count(*) FILTER (WHERE y = 1 AND p = 0)::BIGINT AS fn,
             count(*) AS n
      FROM (SELECT (l.label = 'phishing')::INT AS y, (m.rf_prob > 0.5)::INT AS p
            FROM labelled l JOIN model_scores m ON l.page_id = m.page_id) j) c""", _LABELLED)

_PRED = """pred AS (SELECT l.url, (l.label = 'phishing')::INT AS y, (m.rf_prob > 0.5)::INT AS p
         FROM labelled l JOIN model_scores m ON l.page_id = m.page_id)"""
ORACLES["model_report"] = o.with_fixtures(["url_corpus", "model_scores"], """
SELECT class, support, floor(prec * 1e9 + 0.5)::BIGINT AS precision_e9, floor(rec * 1e9 + 0.5)::BIGINT AS recall_e9,
  floor(f * 1e9 + 0.5)::BIGINT AS f1_e9
FROM (SELECT * FROM scores UNION ALL
      SELECT -1, sum(support)::BIGINT, sum(prec * support) / sum(support), sum(rec * support) / sum(support),
             sum(f * support) / sum(support) FROM scores) x""", ",\n".join([_LABELLED, _PRED, """scores AS (
  SELECT class::BIGINT AS class, support, prec, rec, CASE WHEN prec + rec > 0 THEN 2.0 * prec * rec / (prec + rec) ELSE 0.0 END AS f
  FROM (SELECT c.class, count(*) FILTER (WHERE y = c.class)::BIGINT AS support,
               coalesce(count(*) FILTER (WHERE y = c.class AND p = c.class)::DOUBLE / nullif(count(*) FILTER (WHERE p = c.class), 0), 0.0) AS prec,
               coalesce(count(*) FILTER (WHERE y = c.class AND p = c.class)::DOUBLE / nullif(count(*) FILTER (WHERE y = c.class), 0), 0.0) AS rec
        FROM pred, (SELECT y AS class FROM pred UNION SELECT p FROM pred) c GROUP BY c.class) s)"""]))
ORACLES["cv_summary"] = o.with_fixtures(["url_corpus", "model_scores"], """
SELECT fold, floor(a * 1e9 + 0.5)::BIGINT AS accuracy_e9, floor(s * 1e9 + 0.5)::BIGINT AS std_e9
FROM (SELECT fold, a, NULL::DOUBLE AS s FROM folds UNION ALL SELECT -1, avg(a), coalesce(stddev_pop(a), 0.0) FROM folds) x""",
    ",\n".join([_LABELLED, _PRED, """folds AS (SELECT ((('0x' || substr(md5(url), 1, 8))::BIGINT % 100) % 5)::BIGINT AS fold,
  avg((y = p)::INT::DOUBLE) AS a FROM pred GROUP BY 1)"""]))
ORACLES["model_gate"] = o.with_fixtures(["retrain_log"], """
SELECT id, run_id, accuracy, CASE WHEN accuracy >= 0.88 THEN 'done' ELSE 'rejected_low_accuracy' END AS gate
FROM retrain_log WHERE accuracy > 0""")

# T4, T5: one step of every key's sequence a round, carrying what the next decision depends on
ORACLES["throttle_decisions"] = f"""
WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch_us(ts) AS t,
                             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT event_id, user_id, rn, [t] AS log, false AS limited FROM ev WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, rn, CASE WHEN len(kept) >= 2 THEN kept ELSE list_append(kept, t) END, len(kept) >= 2
  FROM (SELECT e.*, list_filter(f.log, lambda x: e.t - x < {6 * 3600 * 1_000_000}) AS kept
        FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1) n)
SELECT event_id, user_id, limited FROM f"""
ORACLES["cache_reuse"] = o.with_fixtures(["scans"], """
SELECT id, key, cache_hit FROM f UNION ALL SELECT id, key, false FROM k WHERE skipped""", f"""
k AS (SELECT id, key, epoch_us(timestamp) AS t, coalesce(({' OR '.join(f"starts_with(key, {o.q(p)})" for p in lists.SKIP_PREFIXES)}), false) AS skipped
      FROM (SELECT id, {o.normalize_sql('url')} AS key, timestamp FROM scans) a),
ev AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS rn FROM k WHERE NOT skipped),
f AS (SELECT id, key, rn, t AS anchor, false AS cache_hit FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.id, e.key, e.rn, CASE WHEN e.t - f.anchor < {lists.CACHE_TTL_SECONDS * 1_000_000} THEN f.anchor ELSE e.t END,
         e.t - f.anchor < {lists.CACHE_TTL_SECONDS * 1_000_000}
  FROM f JOIN ev e ON e.key = f.key AND e.rn = f.rn + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)

ORACLES["windowed_scan_activity"] = o.with_fixtures(["scans"], """
SELECT date_trunc('day', timestamp) AS window_start, date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end,
  count(*)::BIGINT AS scans, sum(CASE WHEN result = 'PHISHING' THEN 1 ELSE 0 END)::BIGINT AS phishing
FROM scans WHERE url NOT ILIKE 'http://localhost%' AND url NOT ILIKE 'chrome://%' GROUP BY 1, 2""")

ORACLES["url_file_lines"] = o.with_fixtures(["feed_lines"], f"""
SELECT url FROM (SELECT {o.strip_sql('line')} AS url FROM feed_lines) x WHERE url <> '' AND starts_with(url, 'http')""")

ORACLES["batch_request_rows"] = o.with_fixtures(["page_html"], """
SELECT row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS pos, url,
  row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) > 15 AS over_limit FROM page_html""")
ORACLES["labelled_csv"] = o.with_fixtures(["url_corpus"], "SELECT url, label FROM labelled", _LABELLED)
ORACLES["watcher_state"] = o.with_fixtures(["reports"], """
SELECT url, label, report_count::BIGINT AS report_count, 0::BIGINT AS used_in_train, verified_at,
  (SELECT count(*) FROM flagged2 WHERE used_in_verify = 1)::BIGINT AS used_reports
FROM (SELECT url, decision AS label, report_count, '2024-02-01 00:00:00' AS verified_at FROM c2 WHERE decision IN ('safe', 'phishing')
      UNION ALL SELECT url, decision, report_count, '2024-01-01 00:00:00' FROM c1 WHERE decision IN ('safe', 'phishing')
        AND url NOT IN (SELECT url FROM c2 WHERE decision IN ('safe', 'phishing'))) x""", f"""
r1 AS (SELECT * FROM reports WHERE id % 3 <> 0),
c1 AS ({o.consensus_sql('SELECT * FROM r1')}),
used1 AS (SELECT r.id FROM r1 r LEFT JOIN c1 ON c1.url = r.url AND c1.decision = r.label
          WHERE r.used_in_verify = 1 OR c1.url IS NOT NULL),
flagged AS (SELECT r.* EXCLUDE (used_in_verify), CASE WHEN id IN (SELECT id FROM used1) THEN 1 ELSE used_in_verify END AS used_in_verify FROM reports r),
c2 AS ({o.consensus_sql('SELECT * FROM flagged')}),
flagged2 AS (SELECT f.* EXCLUDE (used_in_verify), CASE WHEN c2.url IS NOT NULL THEN 1 ELSE f.used_in_verify END AS used_in_verify
             FROM flagged f LEFT JOIN c2 ON c2.url = f.url AND c2.decision = f.label)""")

ORACLES["consensus_ticks"] = ORACLES["watcher_state"]
ORACLES["feed_delta_flags"] = ORACLES["blocklist_match_filtered"] = ORACLES["blocklist_match"]
ORACLES["stratified_split"] = o.with_fixtures(["url_corpus"], """
SELECT l.page_id, l.url, l.label, CASE WHEN r <= floor(n * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split,
  ((r > floor(n * 0.2 + 0.5))::INT + (r > floor(n * 0.4 + 0.5))::INT + (r > floor(n * 0.6 + 0.5))::INT
   + (r > floor(n * 0.8 + 0.5))::INT)::BIGINT AS fold
FROM labelled l JOIN (SELECT url, row_number() OVER (PARTITION BY label ORDER BY substr(md5(url), 1, 15)) AS r,
                             count(*) OVER (PARTITION BY label) AS n
                      FROM (SELECT url, max(label) AS label FROM labelled GROUP BY url) d) u ON u.url = l.url""", _LABELLED)
_LOGGED = ("logged AS (SELECT * FROM scans WHERE NOT ("
           + " OR ".join(f"starts_with(url, {o.q(p)})" for p in lists.NO_LOG_PREFIXES) + "))")
_LOG_DAY = f"""SELECT CAST(timestamp AS DATE) AS day, count(*)::BIGINT AS n, count(*) FILTER (WHERE result = 'PHISHING')::BIGINT AS p
  FROM logged WHERE {_NOT_LOCAL} AND url NOT ILIKE 'chrome://%' GROUP BY 1"""
ORACLES["scan_log_reports"] = o.with_fixtures(["scans"], f"""
SELECT 'totals' AS report, NULL::VARCHAR AS key, count(*)::BIGINT AS n0, count(*) FILTER (WHERE result = 'PHISHING')::BIGINT AS n1,
  count(*) FILTER (WHERE result = 'SUSPICIOUS')::BIGINT AS n2,
  count(*) FILTER (WHERE result NOT IN ('PHISHING', 'SUSPICIOUS'))::BIGINT AS n3 FROM logged
UNION ALL SELECT 'kpis', NULL, count(*)::BIGINT, count(*) FILTER (WHERE result = 'PHISHING')::BIGINT,
  count(*) FILTER (WHERE result = 'SAFE')::BIGINT, count(*) FILTER (WHERE result = 'SUSPICIOUS')::BIGINT
  FROM logged WHERE {_NOT_LOCAL} AND {_NOT_BROWSER}
UNION ALL SELECT 'daily', day::VARCHAR, n, p, NULL, NULL FROM (SELECT * FROM ({_LOG_DAY}) a ORDER BY day DESC LIMIT 7) b
UNION ALL SELECT 'windows', (day + 1)::DATE::VARCHAR, n, p, NULL, NULL FROM ({_LOG_DAY}) c
UNION ALL SELECT 'domains', domain, cnt, NULL, NULL, NULL FROM (
  SELECT replace(replace(substr(url, instr(url, '://') + 3,
    CASE WHEN instr(substr(url, instr(url, '://') + 3), '/') > 0 THEN instr(substr(url, instr(url, '://') + 3), '/') - 1
         ELSE length(url) END), 'www.', ''), 'http://', '') AS domain, count(*)::BIGINT AS cnt
  FROM logged WHERE result = 'PHISHING' AND {_NOT_LOCAL} GROUP BY 1 ORDER BY cnt DESC, domain LIMIT 8) d""", _LOGGED)
ORACLES["scan_log_newest"] = o.with_fixtures(["scans"], f"""
SELECT * FROM (SELECT {_SC}, 'recent' AS report FROM logged WHERE {_NOT_BROWSER} ORDER BY timestamp DESC, id DESC LIMIT 50) a
UNION ALL SELECT * FROM (SELECT {_SC}, 'history' AS report FROM logged ORDER BY timestamp DESC, id DESC LIMIT 200) b""", _LOGGED)
ORACLES["retrain_log_rows"] = o.with_fixtures(["reports"], f"""
SELECT 'r1' AS run_id, s.seq::BIGINT AS seq, (CASE WHEN s.seq = 1 THEN c.a ELSE 0 END)::BIGINT AS new_safe,
  (CASE WHEN s.seq = 1 THEN c.b ELSE 0 END)::BIGINT AS new_phishing, CASE WHEN s.seq = 1 THEN 'done' ELSE 'running' END AS status,
  0::BIGINT AS left_to_train
FROM (SELECT count(*) FILTER (WHERE decision = 'safe') AS a, count(*) FILTER (WHERE decision = 'phishing') AS b
      FROM ({o.consensus_sql('SELECT * FROM reports')}) x) c, (SELECT unnest([0, 1]) AS seq) s""")
