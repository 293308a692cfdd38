"""DuckDB oracle SQL for the registered queries.

Hand-written ANSI SQL (DuckDB dialect) for each query in
:mod:`threatlens.plans.queries`.  Fixture tables are the same derivation
texts the Spark side uses (:mod:`threatlens.sources.fixtures`), attached as
CTEs over the driver's pre-registered views.
"""

from __future__ import annotations

from ..functions import lists
from ..sources.fixtures import fixture_sql_for

SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


def with_fixtures(names, body: str, extra: str | None = None) -> str:
    """``WITH <fixtures>[, <extra CTEs>] <body>``."""
    parts = [f"{n} AS ({fixture_sql_for(n, 'duckdb')})" for n in names]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


# ---- URL parts ----------------------------------------------------------------

def url_parts_sql(src: str, url: str = "url") -> str:
    """Adds scheme, netloc, path, params, query, fragment, host to ``src``."""
    clean = rf"regexp_replace(regexp_replace({url}, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g')"
    return f"""
SELECT *, split_part(lower(netloc), ':', 1) AS host,
  CASE WHEN scheme IN {in_list(lists.USES_PARAMS)} AND contains(raw_path, ';') THEN regexp_replace(raw_path, ';[^/]*$', '') ELSE raw_path END AS path,
  CASE WHEN scheme IN {in_list(lists.USES_PARAMS)} AND contains(raw_path, ';') THEN regexp_extract(raw_path, ';([^/]*)$', 1) ELSE '' END AS params
FROM (SELECT *, lower(regexp_extract(_c, {q(SPLIT)}, 1)) AS scheme, regexp_extract(_c, {q(SPLIT)}, 2) AS netloc,
        regexp_extract(_c, {q(SPLIT)}, 3) AS raw_path, regexp_extract(_c, {q(SPLIT)}, 4) AS query,
        regexp_extract(_c, {q(SPLIT)}, 5) AS fragment
      FROM (SELECT *, {clean} AS _c FROM ({src}) s0) s1) s2"""


def any_contains(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def typosquat_sql(sld: str) -> str:
    branches = []
    for b in lists.BRANDS:
        branches.append(f"WHEN {sld} = {q(b)} THEN false")
        branches.append(f"WHEN levenshtein({sld}, {q(b)}) <= 2 THEN true")
    return f"(length({sld}) >= 4 AND CASE {' '.join(branches)} ELSE false END)"


def path_exempt_sql(d: str) -> str:
    conds = [f"{d} = {q(t)} OR ends_with({d}, {q('.' + t)})" for t in lists.PATH_KEYWORD_EXEMPT]
    parts = f"string_split({d}, '.')"
    return (f"(({' OR '.join(conds)}) OR (len({parts}) >= 2 AND ({parts}[-1] IN {in_list(lists.PATH_EXEMPT_TLDS)}"
            f" OR array_to_string(list_slice({parts}, -2, -1), '.') IN {in_list(lists.PATH_EXEMPT_TLD2)})))")


def round3_sql(x: str) -> str:
    """Same 3-place rounding as the Spark side (floor(x*1000 + 0.5) / 1000)."""
    return f"(floor(({x}) * 1000.0 + 0.5) / 1000.0)"


def entropy_sql(s: str) -> str:
    n = f"length({s})"
    p = f"((length({s}) - length(replace({s}, ch, '')))::DOUBLE / {n})"
    total = f"list_sum(list_transform(list_distinct(string_split({s}, '')), lambda ch: {p} * log2({p})))"
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE {round3_sql('-' + total)} + 0.0 END)"


def lexical_features_sql(src: str, url: str = "url") -> str:
    """URL-only features over ``src`` (which has a ``url`` column)."""
    d = "host"
    dc = "replace(host, 'www.', '')"
    brand = " OR ".join(f"(contains({dc}, {q(b)}) AND string_split({dc}, '.')[-2] <> {q(b)})" for b in lists.BRANDS)
    sld = f"CASE WHEN len(string_split({dc}, '.')) >= 2 THEN string_split({dc}, '.')[-2] ELSE {dc} END"
    ent = entropy_sql(f"split_part({dc}, '.', 1)")
    tld = f"(contains({d}, '.') AND ('.' || string_split({d}, '.')[-1]) IN {in_list(lists.SUSPICIOUS_TLDS)})"
    return f"""
SELECT f0.*, (domain_entropy > 3.5) AS high_entropy_domain FROM (
SELECT s.*,
  length({url})::BIGINT AS url_length,
  regexp_matches({d}, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') AS has_ip,
  contains({url}, '@') AS has_at,
  (scheme = 'https') AS is_https,
  {any_contains(d, lists.DOMAIN_SUSPICIOUS_WORDS)} AS suspicious_keywords,
  (length({d}) - length(replace({d}, '.', '')))::BIGINT AS dot_count,
  greatest(0, len(string_split({d}, '.')) - 2)::BIGINT AS subdomain_count,
  ((length({url}) - length(replace({url}, '//', ''))) > 2) AS has_redirect,
  contains({url}, '%') AS has_hex,
  length({d})::BIGINT AS domain_length,
  (length(lower(path)) - length(replace(lower(path), '/', '')))::BIGINT AS path_depth,
  contains({d}, '-') AS has_dash_in_domain,
  (length(query) > 0) AS has_query,
  (CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END)::BIGINT AS query_param_count,
  regexp_matches({d}, '[0-9]') AS domain_has_digits,
  {tld} AS suspicious_tld,
  contains(lower(path), '//') AS has_double_slash,
  coalesce(list_max(list_transform(regexp_split_to_array(lower({url}), '[/.\\-_?=&]'), lambda w: length(w))), 0)::BIGINT AS longest_word_length,
  {ent} AS domain_entropy,
  (len(string_split({dc}, '.')) >= 2 AND ({brand})) AS brand_impersonation,
  {typosquat_sql(f'({sld})')} AS typosquatting,
  (contains({dc}, 'xn--') OR regexp_matches({dc}, '[^\\x00-\\x7F]')) AS homograph_attack,
  false AS gsb_flagged,
  ({any_contains('lower(path)', lists.PATH_SUSPICIOUS_WORDS)} AND NOT {path_exempt_sql(d)}) AS path_login_keyword
FROM ({url_parts_sql(src, url)}) s) f0"""


LEXICAL_KEYS = ["url_length", "has_ip", "has_at", "is_https", "suspicious_keywords", "dot_count",
                "subdomain_count", "has_redirect", "has_hex", "domain_length", "path_depth",
                "has_dash_in_domain", "has_query", "query_param_count", "domain_has_digits",
                "suspicious_tld", "has_double_slash", "longest_word_length", "domain_entropy",
                "high_entropy_domain", "brand_impersonation", "typosquatting", "homograph_attack",
                "gsb_flagged", "path_login_keyword"]


def rule_score_sql() -> str:
    pts = [("has_ip", 3), ("has_at", 2), ("NOT is_https", 1), ("suspicious_keywords", 2),
           ("has_redirect", 2), ("suspicious_tld", 3), ("dot_count > 4", 1), ("subdomain_count > 3", 2),
           ("url_length > 100", 1), ("high_entropy_domain", 2), ("brand_impersonation", 3),
           ("is_new_domain", 2)]
    return "(" + " + ".join(f"CASE WHEN coalesce({c}, false) THEN {w} ELSE 0 END" for c, w in pts) + ")"


def risk_level_sql(score: str, final: str) -> str:
    return (f"CASE WHEN {final} = 'SAFE' AND {score} < 0.20::DOUBLE THEN 'SAFE' WHEN {final} = 'SAFE' THEN 'LOW' "
            f"WHEN {score} >= 0.80::DOUBLE THEN 'CRITICAL' WHEN {score} >= 0.60::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END")


def rule_verdict_sql(feat_sql: str) -> str:
    """V1 + V14 (bulk: risk from 0.9 / 0.1) over a feature relation."""
    return f"""
SELECT v.*, CASE WHEN rule_score >= 4 THEN 'PHISHING' ELSE 'SAFE' END AS result,
  (CASE WHEN rule_score >= 4 THEN least(50 + rule_score * 5, 95) ELSE least(60 + (10 - rule_score) * 3, 95) END)::BIGINT AS confidence
FROM (SELECT f.*, {rule_score_sql()}::BIGINT AS rule_score FROM ({feat_sql}) f) v"""


WS = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def host_sql(url: str) -> str:
    """U3(a) of a URL expression."""
    clean = rf"regexp_replace(regexp_replace({url}, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g')"
    return f"split_part(lower(regexp_extract({clean}, {q(SPLIT)}, 2)), ':', 1)"


def normalize_sql(url: str) -> str:
    """U2 of a URL expression (scalar form)."""
    s = strip_sql(url)
    pref = f"(CASE WHEN starts_with({s}, 'http://') OR starts_with({s}, 'https://') THEN {s} ELSE 'https://' || {s} END)"
    clean = rf"regexp_replace(regexp_replace({pref}, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g')"
    g = lambda i: f"regexp_extract({clean}, {q(SPLIT)}, {i})"
    scheme = f"lower({g(1)})"
    raw_path = g(3)
    has_params = f"({scheme} IN {in_list(lists.USES_PARAMS)} AND contains({raw_path}, ';'))"
    path = (f"(CASE WHEN {has_params} AND regexp_extract({raw_path}, ';([^/]*)$', 1) <> '' "
            f"THEN regexp_replace({raw_path}, ';[^/]*$', '') || ';' || regexp_extract({raw_path}, ';([^/]*)$', 1) "
            f"WHEN {has_params} THEN regexp_replace({raw_path}, ';[^/]*$', '') ELSE {raw_path} END)")
    q2 = f"regexp_replace(regexp_replace({g(4)}, {q(lists.TRACKING_PARAM_PATTERN)}, '', 'g'), '^&+|&+$', '', 'g')"
    return (f"({scheme} || '://' || {g(2)} || {path} || CASE WHEN {q2} <> '' THEN '?' || {q2} ELSE '' END"
            f" || CASE WHEN {g(5)} <> '' THEN '#' || {g(5)} ELSE '' END)")


def feed_parsed_sql() -> str:
    """S6-S8 over the feed_lines CTE: (source, kind, value)."""
    skip = in_list(["url_per_line_skip_hash", "domain_per_line_skip_hash", "hosts_file"])
    urlf = in_list(["url_per_line", "url_per_line_skip_hash"])
    domf = in_list(["domain_per_line", "domain_per_line_skip_hash"])
    tok = f"string_split_regex(s, '{WS}+')"
    hname = strip_sql(f"lower({tok}[2])")
    dl0 = strip_sql("lower(s)")
    return f"""
SELECT source, kind, value FROM (
  SELECT source, 'domain' AS kind, {hname} AS value FROM fl
   WHERE format = 'hosts_file' AND len({tok}) >= 2 AND {tok}[1] IN ('0.0.0.0', '127.0.0.1') AND contains({hname}, '.')
  UNION ALL
  SELECT source, 'domain' AS kind, dl AS value FROM (
    SELECT source, format, CASE WHEN starts_with({dl0}, '*.') THEN substr({dl0}, 3) ELSE {dl0} END AS dl FROM fl) d
   WHERE format IN {domf} AND contains(dl, '.') AND NOT starts_with(dl, 'http')
  UNION ALL
  SELECT source, 'url' AS kind, s AS value FROM fl WHERE format IN {urlf} AND starts_with(s, 'http')
  UNION ALL
  SELECT source, 'domain' AS kind, {host_sql('s')} AS value FROM fl WHERE format IN {urlf} AND starts_with(s, 'http')
) x WHERE value <> ''"""


def feed_lines_ctes() -> str:
    skip = in_list(["url_per_line_skip_hash", "domain_per_line_skip_hash", "hosts_file"])
    return f"""fl AS (SELECT * FROM (SELECT source, format, regexp_replace({strip_sql('line')}, '\\.+$', '') AS s FROM feed_lines) a
              WHERE s <> '' AND NOT (format IN {skip} AND starts_with(s, '#'))),
parsed AS ({feed_parsed_sql()}),
feed_urls AS (SELECT DISTINCT value AS url FROM parsed WHERE kind = 'url'),
feed_domains AS (SELECT DISTINCT value AS domain FROM parsed WHERE kind = 'domain'
                 AND value NOT IN {in_list(lists.NEVER_PHISHING + ['www.' + d for d in lists.NEVER_PHISHING])})"""


def suffixes_sql(h: str, start: int) -> str:
    """List of suffixes of h from label index ``start`` (1-based) to n-1."""
    parts = f"string_split({h}, '.')"
    return (f"(CASE WHEN len({parts}) >= {start + 1} THEN list_transform(range({start}, len({parts})), "
            f"lambda i: array_to_string(list_slice({parts}, i, len({parts})), '.')) ELSE [] END)")


def static_candidates_sql(h: str) -> str:
    return (f"list_distinct(list_concat([{h}], CASE WHEN starts_with({h}, 'www.') THEN [substr({h}, 5)] ELSE [] END, "
            f"{suffixes_sql(h, 2)}))")


def netloc_sql(url: str) -> str:
    clean = rf"regexp_replace(regexp_replace({url}, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g')"
    return f"regexp_extract({clean}, {q(SPLIT)}, 2)"


def consensus_sql(reports: str) -> str:
    lab = strip_sql("lower(label)")
    return f"""
SELECT url, pending_safe, pending_phishing, all_safe, all_phishing,
  CASE WHEN safe_ok THEN 'safe' WHEN phish_ok THEN 'phishing'
       WHEN pending_safe >= {lists.SAFE_REPORT_THRESHOLD} OR pending_phishing >= {lists.PHISHING_REPORT_THRESHOLD} THEN 'conflict'
       ELSE 'pending' END AS decision,
  CASE WHEN safe_ok THEN pending_safe WHEN phish_ok THEN pending_phishing END AS report_count
FROM (SELECT *, (pending_safe >= {lists.SAFE_REPORT_THRESHOLD} AND all_phishing < {lists.PHISHING_REPORT_THRESHOLD}) AS safe_ok,
             (pending_phishing >= {lists.PHISHING_REPORT_THRESHOLD} AND all_safe < {lists.SAFE_REPORT_THRESHOLD}) AS phish_ok
      FROM (SELECT url,
              count(*) FILTER (WHERE used_in_verify = 0 AND {lab} = 'safe')::BIGINT AS pending_safe,
              count(*) FILTER (WHERE used_in_verify = 0 AND {lab} = 'phishing')::BIGINT AS pending_phishing,
              count(*) FILTER (WHERE label = 'safe')::BIGINT AS all_safe,
              count(*) FILTER (WHERE label = 'phishing')::BIGINT AS all_phishing
            FROM ({reports}) r GROUP BY url) g) h"""


def verified_ctes() -> str:
    """cons, prior_verified, new_verified, verified (after upsert)."""
    return f"""cons AS ({consensus_sql('SELECT * FROM reports')}),
prior_verified AS (SELECT url, decision AS label, report_count::INT AS report_count,
                          TIMESTAMP '2024-01-01 00:00:00' AS verified_at, 1 AS used_in_train
                   FROM ({consensus_sql('SELECT * FROM reports WHERE id % 3 <> 0')}) c WHERE decision IN ('safe', 'phishing')),
new_verified AS (SELECT url, decision AS label, report_count::INT AS report_count,
                        TIMESTAMP '2024-02-01 00:00:00' AS verified_at, 0 AS used_in_train
                 FROM cons WHERE decision IN ('safe', 'phishing')),
verified AS (SELECT * FROM prior_verified WHERE url NOT IN (SELECT url FROM new_verified)
             UNION ALL SELECT * FROM new_verified)"""


def allowlist_clean_sql(x: str) -> str:
    d = f"substr({strip_sql(f'lower({x})')}, 1, {lists.MAX_DOMAIN_LENGTH})"
    return f"split_part(replace(replace({d}, 'https://', ''), 'http://', ''), '/', 1)"


def user_allowlist_cte() -> str:
    return f"""user_allow AS (SELECT DISTINCT domain FROM (SELECT {allowlist_clean_sql('domain')} AS domain FROM allowlist_requests) a
                WHERE domain <> '' AND contains(domain, '.'))"""


def dynamic_allowlist_cte() -> str:
    return f"""dyn_allow AS (SELECT DISTINCT domain FROM (
        SELECT domain FROM user_allow
        UNION ALL SELECT replace(lower({netloc_sql('url')}), 'www.', '') AS domain FROM cons WHERE decision = 'safe') d
      WHERE domain <> '')"""


def probe_cte() -> str:
    return f"""probe AS (SELECT url, {host_sql('url')} AS host FROM (
        SELECT DISTINCT {normalize_sql('url')} AS url FROM (SELECT url FROM url_corpus UNION ALL SELECT url FROM page_html) a) b)"""


# ---- enrichment (J6, J7, J9) ----------------------------------------------------------
AS_OF = "2024-01-15"
IFRAME = r"""<iframe[^>]*(width\s*=\s*["']?\s*0|height\s*=\s*["']?\s*0|display\s*:\s*none)"""
FORM = r"""<form[^>]*action\s*=\s*["']([^"']+)["']"""
TITLE = r"(?s)<title[^>]*>(.*?)</title>"
ENRICH_FIXTURES = ["whois", "certs", "dns_records", "resolutions", "ip_geo", "ct_entries",
                   "redirects", "page_html", "reputation", "gsb_hits"]


def enrichment_ctes() -> str:
    title = f"lower(regexp_extract(hh, {q(TITLE)}, 1))"
    mism = "(" + " OR ".join(f"(contains({title}, {q(b)}) AND NOT contains(lower(ph), {q(b)}))" for b in lists.BRANDS) + ")"
    priv = "(starts_with(r.ip, '10.') OR starts_with(r.ip, '192.168.') OR starts_with(r.ip, '127.'))"
    return f"""hfacts AS (
  SELECT domain, min(created_at) AS created_at, min(not_before) AS not_before, max(a) AS a, max(mx) AS mx,
         max(spf) AS spf, arg_min(risky, ip) AS risky, arg_min(proxy, ip) AS proxy, count(a) AS n_dns
  FROM (SELECT domain, created_at::DATE AS created_at, NULL::DATE AS not_before, NULL::INT AS a, NULL::INT AS mx,
               NULL::INT AS spf, NULL::VARCHAR AS ip, NULL::BOOLEAN AS risky, NULL::BOOLEAN AS proxy FROM whois
        UNION ALL SELECT domain, NULL, not_before::DATE, NULL, NULL, NULL, NULL, NULL, NULL FROM certs
        UNION ALL SELECT domain, NULL, NULL, (rtype = 'A')::INT, (rtype = 'MX')::INT,
                         (rtype = 'TXT' AND contains(lower(value), 'spf'))::INT, NULL, NULL, NULL FROM dns_records
        UNION ALL SELECT r.domain, NULL, NULL, NULL, NULL, NULL, r.ip,
                         NOT {priv} AND coalesce(g.cc IN {in_list(lists.HIGH_RISK_COUNTRIES)}, false),
                         NOT {priv} AND coalesce(g.px = 1 OR g.hs = 1, false)
                  FROM resolutions r LEFT JOIN (SELECT ip, min(cc) AS cc, max(proxy::INT) AS px, max(hosting::INT) AS hs
                                                FROM ip_geo GROUP BY ip) g ON r.ip = g.ip) u
  GROUP BY domain),
hf AS (SELECT domain,
         CASE WHEN created_at IS NULL THEN -1 ELSE greatest(0, DATE '{AS_OF}' - created_at) END AS domain_age_days,
         CASE WHEN not_before IS NULL THEN -1 ELSE greatest(0, DATE '{AS_OF}' - not_before) END AS ssl_cert_age_days,
         CASE WHEN n_dns > 0 THEN a = 1 END AS dns_resolves, CASE WHEN n_dns > 0 THEN mx = 1 END AS has_mx_record,
         CASE WHEN n_dns > 0 THEN spf = 1 END AS has_spf_record, risky AS high_risk_country, proxy AS is_proxy_hosting
       FROM hfacts),
ct AS (SELECT root, count(*) AS ct_n FROM ct_entries GROUP BY root),
ufacts AS (
  SELECT url, max(hops) AS hops, max(final_target) AS final_target, max(pw) AS pw, max(title) AS title,
         max(frame) AS frame, max(form) AS form, max(vt_m) AS vt_malicious,
         max(vt_s) AS vt_suspicious, max(vt_t) AS vt_all, max(gsb) AS gsb
  FROM (SELECT url, count(*)::INT AS hops, arg_max(target, hop_no) AS final_target, NULL::INT AS pw, NULL::INT AS title,
               NULL::INT AS frame, NULL::INT AS form, NULL::INT AS vt_m,
               NULL::INT AS vt_s, NULL::INT AS vt_t, NULL::INT AS gsb FROM redirects GROUP BY url
        UNION ALL SELECT url, NULL, NULL, (contains(hh, 'type="password"') OR contains(hh, 'type=''password'''))::INT, {mism}::INT,
                         regexp_matches(hh, {q(IFRAME)})::INT,
                         coalesce(len(list_filter(regexp_extract_all(hh, {q(FORM)}, 1),
                                  lambda a: starts_with(a, 'http') AND NOT contains(a, ph))) > 0, false)::INT,
                         NULL, NULL, NULL, NULL
                  FROM (SELECT url, lower(html) AS hh, {host_sql('url')} AS ph FROM page_html) pg
        UNION ALL SELECT url, NULL, NULL, NULL, NULL, NULL, NULL, malicious, suspicious,
                         malicious + suspicious + harmless + undetected, NULL FROM reputation
        UNION ALL SELECT url, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1 FROM gsb_hits) u
  GROUP BY url)"""


def etld1_sql(u: str) -> str:
    d = f"replace(lower({netloc_sql(u)}), 'www.', '')"
    parts = f"string_split({d}, '.')"
    return f"(CASE WHEN len({parts}) >= 2 THEN array_to_string(list_slice({parts}, -2, -1), '.') ELSE {d} END)"


def root_sql(h: str) -> str:
    d = f"replace({h}, 'www.', '')"
    parts = f"string_split({d}, '.')"
    return f"(CASE WHEN len({parts}) >= 2 THEN array_to_string(list_slice({parts}, -2, -1), '.') ELSE {h} END)"


def enriched_sql(src: str) -> str:
    """All 43 features plus vt_* columns over ``src`` (a lexical feature
    relation with url and host), joined to hf / ct / ufacts CTEs."""
    hops = "coalesce(e.hops, 0)"
    ok = f"({hops} > 0 AND {hops} <= 5)"
    changed = f"({ok} AND {etld1_sql('e.url')} <> {etld1_sql('e.final_target')})"
    known = "(e.vt_all IS NOT NULL)"
    pos = "(coalesce(e.vt_malicious, 0) + coalesce(e.vt_suspicious, 0))"
    tot0 = "e.vt_all"
    tot = f"(CASE WHEN {tot0} = 0 THEN 1 ELSE {tot0} END)"
    ctn = "coalesce(e.ct_n, -1)"
    return f"""
SELECT e.* EXCLUDE (hops, final_target, pw, title, frame, form, gsb, ct_n, vt_malicious, vt_suspicious, vt_all, gsb_flagged,
                    domain_age_days, ssl_cert_age_days, dns_resolves, has_mx_record, has_spf_record, high_risk_country,
                    is_proxy_hosting),
  coalesce(e.domain_age_days, -1)::BIGINT AS domain_age_days,
  (coalesce(e.domain_age_days, -1) <> -1 AND coalesce(e.domain_age_days, -1) < 30) AS is_new_domain,
  coalesce(e.ssl_cert_age_days, -1)::BIGINT AS ssl_cert_age_days,
  (coalesce(e.ssl_cert_age_days, -1) <> -1 AND coalesce(e.ssl_cert_age_days, -1) < 30) AS new_ssl_cert,
  coalesce(e.dns_resolves, true) AS dns_resolves, coalesce(e.has_mx_record, true) AS has_mx_record,
  coalesce(e.has_spf_record, false) AS has_spf_record,
  coalesce(e.high_risk_country, false) AS high_risk_country, coalesce(e.is_proxy_hosting, false) AS is_proxy_hosting,
  {ctn}::BIGINT AS cert_transparency_count, ({ctn} >= 0 AND {ctn} <= 2) AS low_cert_history,
  (CASE WHEN {ok} THEN {hops} ELSE 0 END)::BIGINT AS redirect_hop_count,
  {changed} AS redirect_domain_changed, ({ok} AND ({hops} >= 3 OR {changed})) AS redirect_chain_suspicious,
  coalesce(e.pw = 1, false) AS has_password_field, coalesce(e.title = 1, false) AS title_brand_mismatch,
  coalesce(e.frame = 1, false) AS has_hidden_iframe, coalesce(e.form = 1, false) AS form_external_action,
  coalesce(e.gsb = 1, false) AS gsb_flagged,
  CASE WHEN NOT {known} THEN 'UNAVAILABLE' WHEN {pos} >= 1 THEN 'PHISHING' ELSE 'SAFE' END AS vt_result,
  (CASE WHEN {known} THEN {pos} ELSE 0 END)::BIGINT AS vt_positives,
  (CASE WHEN {known} THEN {tot} ELSE 0 END)::BIGINT AS vt_total,
  CASE WHEN {known} THEN {pos}::VARCHAR || '/' || {tot}::VARCHAR ELSE 'N/A' END AS vt_ratio,
  CASE WHEN {known} THEN least({pos}::DOUBLE / {tot}::DOUBLE, 1.0) ELSE 0.0 END AS vt_prob
FROM (SELECT l.*, hf.* EXCLUDE (domain), ct.ct_n, uf.* EXCLUDE (url)
      FROM ({src}) l LEFT JOIN hf ON l.host = hf.domain
      LEFT JOIN ct ON {root_sql('l.host')} = ct.root
      LEFT JOIN ufacts uf ON l.url = uf.url) e"""


def ensemble_sql(src: str) -> str:
    """V1 + V4-V11 over an enriched relation with rf_prob / nn_prob."""
    d = lambda x: f"{x}::DOUBLE"
    b = lambda c: f"coalesce({c}, false)"
    reasons = [("has_ip", "raw_ip"), ("brand_impersonation", "brand_impersonation"), ("typosquatting", "typosquatting"),
               ("homograph_attack", "homograph"), ("NOT is_https", "no_https"),
               ("suspicious_keywords", "suspicious_keywords"), ("is_new_domain", "new_domain"),
               ("high_entropy_domain", "high_entropy")]
    rs = [f"CASE WHEN {b(c)} THEN {q(k)} END" for c, k in reasons]
    rs.append("CASE WHEN vt_positives >= 3 THEN 'vt_malicious' WHEN vt_positives >= 1 THEN 'vt_flagged' END")
    rs += [f"CASE WHEN {b(c)} THEN {q(k)} END" for c, k in [
        ("gsb_flagged", "gsb_flagged"), ("redirect_chain_suspicious", "redirect_chain"),
        ("subdomain_count > 3", "deep_subdomains"), ("title_brand_mismatch", "title_brand_mismatch"),
        ("form_external_action", "external_form"), ("has_hidden_iframe", "hidden_iframe"),
        ("suspicious_tld", "risky_tld")]]
    return f"""
SELECT z.*, {round3_sql('weighted_score_raw')} AS weighted_score,
  {risk_level_sql('weighted_score_raw', 'result')} AS risk_level,
  CASE WHEN codes = '' AND result = 'PHISHING' THEN 'ml_pattern' ELSE codes END AS reasons
FROM (SELECT y.*,
  CASE WHEN override THEN 'PHISHING'
       WHEN weighted_score_raw >= thr OR votes >= 5 THEN 'PHISHING'
       WHEN weighted_score_raw >= {d(0.38)} AND votes >= 2 THEN 'SUSPICIOUS'
       WHEN rf_result = 'SAFE' AND (nn_result IS NULL OR nn_result = 'SAFE') AND vt_result <> 'PHISHING' THEN 'SAFE'
       WHEN weighted_score_raw >= {d(0.35)} THEN 'SUSPICIOUS' ELSE 'SAFE' END AS result,
  greatest(rf_confidence, coalesce(nn_confidence, 0))::BIGINT AS confidence,
  concat_ws(',', {', '.join(rs)}) AS codes
FROM (SELECT x.*,
  (gsb_flagged OR vt_positives >= 3) AS override,
  CASE WHEN gsb_flagged THEN {d(0.99)} WHEN vt_positives >= 3 THEN {d(0.97)}
       ELSE rw2 * rf_p + nw2 * nn_p + vw2 * vt_p + gsb_p * gw2 END AS weighted_score_raw,
  CASE WHEN gsb_flagged OR vt_positives >= 3 THEN 99 ELSE
    (CASE WHEN rf_result = 'PHISHING' THEN 2 ELSE 0 END) + (CASE WHEN nn_result = 'PHISHING' THEN 1 ELSE 0 END)
    + (CASE WHEN vt_positives >= 1 THEN 1 ELSE 0 END) + (CASE WHEN {b('typosquatting')} THEN 2 ELSE 0 END)
    + (CASE WHEN {b('homograph_attack')} THEN 2 ELSE 0 END) + (CASE WHEN {b('redirect_chain_suspicious')} THEN 1 ELSE 0 END)
    + (CASE WHEN {b('title_brand_mismatch')} THEN 2 ELSE 0 END) + (CASE WHEN {b('suspicious_tld')} THEN 1 ELSE 0 END)
    + (CASE WHEN {b('brand_impersonation')} THEN 2 ELSE 0 END) END::BIGINT AS votes,
  CASE WHEN rf_result = 'PHISHING' AND coalesce(nn_result = 'PHISHING', false) THEN {d(0.42)} ELSE {d(0.62)} END AS thr
FROM (SELECT w.*,
  CASE WHEN vt_result = 'UNAVAILABLE' THEN rw / (rw + nw + gw) ELSE rw END AS rw2,
  CASE WHEN vt_result = 'UNAVAILABLE' THEN nw / (rw + nw + gw) ELSE nw END AS nw2,
  CASE WHEN vt_result = 'UNAVAILABLE' THEN {d(0.0)} ELSE vw END AS vw2,
  CASE WHEN vt_result = 'UNAVAILABLE' THEN gw / (rw + nw + gw) ELSE gw END AS gw2,
  CASE WHEN vt_result = 'UNAVAILABLE' THEN {d(0.0)} ELSE coalesce(vt_prob, {d(0.0)}) END AS vt_p,
  CASE WHEN gsb_flagged THEN {d(1.0)} ELSE {d(0.0)} END AS gsb_p
FROM (SELECT m.*,
  CASE WHEN agreement >= {d(0.8)} THEN {d(0.60)} WHEN agreement >= {d(0.5)} THEN {d(0.45)} ELSE {d(0.25)} END AS rw,
  CASE WHEN agreement >= {d(0.8)} THEN {d(0.25)} WHEN agreement >= {d(0.5)} THEN {d(0.20)} ELSE {d(0.15)} END AS nw,
  CASE WHEN agreement >= {d(0.8)} THEN {d(0.10)} WHEN agreement >= {d(0.5)} THEN {d(0.25)} ELSE {d(0.45)} END AS vw,
  CASE WHEN agreement >= {d(0.8)} THEN {d(0.05)} WHEN agreement >= {d(0.5)} THEN {d(0.10)} ELSE {d(0.15)} END AS gw
FROM (SELECT k2.*, {d(1.0)} - abs(rf_p - nn_p) AS agreement
FROM (SELECT k.*, coalesce(nn_prob::DOUBLE, rf_p) AS nn_p
FROM (SELECT r.*,
  CASE WHEN rf_prob IS NULL THEN rule_result WHEN rf_prob::DOUBLE > {d(0.5)} THEN 'PHISHING' ELSE 'SAFE' END AS rf_result,
  CASE WHEN rf_prob IS NULL THEN rule_confidence ELSE trunc(greatest(rf_prob::DOUBLE, {d(1.0)} - rf_prob::DOUBLE) * {d(100.0)}) END::BIGINT AS rf_confidence,
  coalesce(rf_prob::DOUBLE, CASE WHEN rule_result = 'PHISHING' THEN {d(0.9)} ELSE {d(0.1)} END) AS rf_p,
  CASE WHEN nn_prob IS NULL THEN NULL WHEN nn_prob::DOUBLE > {d(0.5)} THEN 'PHISHING' ELSE 'SAFE' END AS nn_result,
  CASE WHEN nn_prob IS NULL THEN 0 ELSE trunc(greatest(nn_prob::DOUBLE, {d(1.0)} - nn_prob::DOUBLE) * {d(100.0)}) END::BIGINT AS nn_confidence
FROM (SELECT s.*, CASE WHEN rule_score >= 4 THEN 'PHISHING' ELSE 'SAFE' END AS rule_result,
        (CASE WHEN rule_score >= 4 THEN least(50 + rule_score * 5, 95) ELSE least(60 + (10 - rule_score) * 3, 95) END)::BIGINT AS rule_confidence
      FROM (SELECT t.*, {rule_score_sql()}::BIGINT AS rule_score FROM ({src}) t) s) r) k) k2) m) w) x) y) z"""
