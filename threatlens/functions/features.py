"""The 43 URL feature columns (section 2.3) as native Spark expressions.

Every rule is a column expression over the URL, its split parts and the
feature host ``d`` (U3(a)).  List tests are unrolled into OR chains / CASE
chains or an ``IN`` set so they compile into whole-stage codegen; only the
entropy and longest-token rules use higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists
from .urls import strip_www

# fixed order of the feature vector
FEATURE_KEYS = [
    "url_length", "has_ip", "has_at", "is_https", "suspicious_keywords",
    "dot_count", "subdomain_count", "has_redirect", "has_hex", "domain_length",
    "path_depth", "has_dash_in_domain", "has_query", "query_param_count",
    "domain_has_digits", "suspicious_tld", "has_double_slash",
    "longest_word_length", "domain_entropy", "high_entropy_domain",
    "brand_impersonation", "domain_age_days", "is_new_domain",
    "ssl_cert_age_days", "new_ssl_cert", "dns_resolves", "has_mx_record",
    "has_spf_record", "typosquatting", "homograph_attack", "gsb_flagged",
    "redirect_hop_count", "redirect_domain_changed", "redirect_chain_suspicious",
    "high_risk_country", "is_proxy_hosting", "cert_transparency_count",
    "low_cert_history", "has_password_field", "title_brand_mismatch",
    "has_hidden_iframe", "form_external_action", "path_login_keyword",
]

# Values of the network-backed group when nothing is known about a host.
DEEP_DEFAULTS = {
    "domain_age_days": -1, "is_new_domain": False,
    "ssl_cert_age_days": -1, "new_ssl_cert": False,
    "dns_resolves": True, "has_mx_record": True, "has_spf_record": False,
    "redirect_hop_count": 0, "redirect_domain_changed": False,
    "redirect_chain_suspicious": False,
    "high_risk_country": False, "is_proxy_hosting": False,
    "cert_transparency_count": -1, "low_cert_history": False,
    "has_password_field": False, "title_brand_mismatch": False,
    "has_hidden_iframe": False, "form_external_action": False,
}


def count_char(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))




def any_contains(s: Column, words) -> Column:
    """Some word of the list occurs in ``s`` -- an OR chain of ``contains``,
    compiled (a higher-order ``exists`` over a literal array is interpreted
    per element and measured ~10x slower)."""
    cond = F.lit(False)
    for w in words:
        cond = cond | s.contains(w)
    return cond


def labels(s: Column) -> Column:
    return F.split(s, r"\.", -1)


def round3(x: Column) -> Column:
    """Round a non-negative double to 3 places, half up on the binary value
    (floor(x*1000 + 0.5) / 1000): one formula that every engine evaluates
    identically, unlike decimal-string based ROUND implementations."""
    return F.floor(x * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(1000.0)


def shannon_entropy(s: Column) -> Column:
    """Bits per symbol of ``s``, rounded to 3 places; '' gives 0."""
    n = F.length(s)
    chars = F.filter(F.array_distinct(F.split(s, "", -1)), lambda c: c != "")

    def add(acc, c):
        p = (n - F.length(F.replace(s, c, F.lit("")))).cast("double") / n
        return acc + p * F.log2(p)

    total = F.aggregate(chars, F.lit(0.0).cast("double"), add)
    return F.when(n == 0, F.lit(0.0)).otherwise(round3(-total) + F.lit(0.0))


def longest_word_length(url: Column) -> Column:
    words = F.split(F.lower(url), r"[/.\-_?=&]", -1)
    return F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0))




def lexical_feature_names() -> list[str]:
    return ["url_length", "has_ip", "has_at", "is_https", "suspicious_keywords", "dot_count",
            "subdomain_count", "has_redirect", "has_hex", "domain_length", "path_depth",
            "has_dash_in_domain", "has_query", "query_param_count", "domain_has_digits",
            "suspicious_tld", "has_double_slash", "longest_word_length", "domain_entropy",
            "high_entropy_domain", "brand_impersonation", "typosquatting", "homograph_attack",
            "gsb_flagged", "path_login_keyword"]




_COLUMN_CACHE: dict = {}


def _memo(key, build):
    """Column expressions that refer to columns by name are reusable; build
    each set once per application (building them is thousands of py4j
    calls, the plan itself is unaffected)."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    k = (sc.applicationId, key)
    if k not in _COLUMN_CACHE:
        _COLUMN_CACHE[k] = build()
    return _COLUMN_CACHE[k]


HOST_FEATURES = ["has_ip", "suspicious_keywords", "dot_count", "subdomain_count", "domain_length",
                 "has_dash_in_domain", "domain_has_digits", "suspicious_tld", "domain_entropy",
                 "high_entropy_domain", "brand_impersonation", "typosquatting", "homograph_attack"]
URL_FEATURES = ["url_length", "has_at", "is_https", "has_redirect", "has_hex", "path_depth", "has_query",
                "query_param_count", "has_double_slash", "longest_word_length", "gsb_flagged",
                "path_login_keyword"]
_HOST_TMP = ["_f_dc", "_f_parts", "_f_label1", "_f_dparts", "_f_sld2", "_f_sld"]


def with_host_features(df, host: str):
    """Adds the 13 host-only features and ``_path_exempt`` (staged)."""
    stages = _memo(("host", host), lambda: _host_stages(host))
    for st in stages:
        df = df.select("*", *st)
    return df.drop(*_HOST_TMP)


def with_url_features(df, url_col: str, scheme: str, path: str, query: str, exempt: str | None = "_path_exempt"):
    """Adds the URL-level features; ``exempt`` names the host's E1 flag
    (None: emit ``_path_kw`` and resolve the keyword rule after the host join)."""
    cols = _memo(("url", url_col, scheme, path, query, exempt),
                 lambda: _url_columns(url_col, scheme, path, query, exempt))
    return df.select("*", *cols)


def with_lexical_features(df, url_col: str, scheme: str, path: str, query: str, host: str):
    """All 25 URL-only features inline (one narrow projection chain)."""
    df = with_host_features(df, host)
    return with_url_features(df, url_col, scheme, path, query).drop("_path_exempt")


def host_feature_table(hosts, host_col: str = "host"):
    """One row per distinct host with the 13 host-only features and the
    path-exemption flag -- computed once per host instead of once per URL."""
    h = hosts.select(F.col(host_col).alias("host")).distinct()
    return with_host_features(h, "host")


def _sq(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_rules(dc: str, sld: str, sld2: str, dparts: str, d: str) -> dict[str, Column]:
    """The four list-heavy rules as single SQL expressions (one parse on the
    JVM instead of hundreds of py4j calls); same logic as the Column forms."""
    typo = " ".join(f"WHEN `{sld}` = {_sq(b)} THEN false WHEN levenshtein(`{sld}`, {_sq(b)}, 2) >= 0 THEN true"
                    for b in lists.BRANDS)
    brand = " OR ".join(f"(contains(`{dc}`, {_sq(b)}) AND coalesce(`{sld2}` <> {_sq(b)}, true))" for b in lists.BRANDS)
    exempt = " OR ".join(f"lower(`{d}`) = {_sq(t)} OR endswith(lower(`{d}`), {_sq('.' + t)})" for t in lists.PATH_KEYWORD_EXEMPT)
    tlds = ", ".join(_sq(t) for t in lists.SUSPICIOUS_TLDS)
    return {
        "typosquatting": F.expr(f"(length(`{sld}`) >= 4) AND (CASE {typo} ELSE false END)"),
        "brand_impersonation": F.expr(f"(size(`{dparts}`) >= 2) AND ({brand})"),
        "_exempt_listed": F.expr(f"({exempt})"),
        "suspicious_tld": F.expr(f"contains(`{d}`, '.') AND concat('.', substring_index(`{d}`, '.', -1)) IN ({tlds})"),
    }


def _host_stages(host):
    d = F.col(host)
    stage1 = [strip_www(F.lower(d)).alias("_f_dc"), labels(d).alias("_f_parts"),
              F.substring_index(strip_www(d), ".", 1).alias("_f_label1")]
    stage2 = [labels(F.col("_f_dc")).alias("_f_dparts")]
    dparts = F.col("_f_dparts")
    stage3 = [F.try_element_at(dparts, F.lit(-2)).alias("_f_sld2"),
              F.when(F.size(dparts) >= 2, F.try_element_at(dparts, F.lit(-2))).otherwise(F.col("_f_dc")).alias("_f_sld"),
              shannon_entropy(F.col("_f_label1")).alias("domain_entropy")]
    dc = F.col("_f_dc")
    rules = _sql_rules("_f_dc", "_f_sld", "_f_sld2", "_f_dparts", host)
    parts = labels(F.lower(d))
    exempt = rules["_exempt_listed"] | ((F.size(parts) >= 2) & (F.element_at(parts, -1).isin(lists.PATH_EXEMPT_TLDS)
                                        | F.array_join(F.slice(parts, -2, 2), ".").isin(lists.PATH_EXEMPT_TLD2)))
    cols = {
        "has_ip": d.rlike(r"(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}"),
        "suspicious_keywords": any_contains(d, lists.DOMAIN_SUSPICIOUS_WORDS),
        "dot_count": count_char(d, "."),
        "subdomain_count": F.greatest(F.lit(0), F.size(F.col("_f_parts")) - F.lit(2)),
        "domain_length": F.length(d),
        "has_dash_in_domain": d.contains("-"),
        "domain_has_digits": d.rlike(r"\p{Nd}"),
        "suspicious_tld": rules["suspicious_tld"],
        "high_entropy_domain": F.col("domain_entropy") > F.lit(3.5),
        "brand_impersonation": rules["brand_impersonation"],
        "typosquatting": rules["typosquatting"],
        "homograph_attack": dc.contains("xn--") | dc.rlike(r"[^\x00-\x7F]"),
        "_path_exempt": exempt,
    }
    return [stage1, stage2, stage3, [c.alias(k) for k, c in cols.items()]]


def _url_columns(url_col, scheme, path, query, exempt):
    url, q = F.col(url_col), F.col(query)
    p = F.lower(F.col(path))
    cols = {
        "url_length": F.length(url),
        "has_at": url.contains("@"),
        "is_https": F.col(scheme) == F.lit("https"),
        "has_redirect": (F.length(url) - F.length(F.replace(url, F.lit("//"), F.lit("")))) > F.lit(2),
        "has_hex": url.contains("%"),
        "path_depth": count_char(p, "/"),
        "has_query": F.length(q) > 0,
        "query_param_count": F.when(q == "", F.lit(0)).otherwise(F.size(F.split(q, "&", -1))),
        "has_double_slash": p.contains("//"),
        "longest_word_length": longest_word_length(url),
        "gsb_flagged": F.lit(False),
    }
    kw = any_contains(p, lists.PATH_SUSPICIOUS_WORDS)
    if exempt is None:  # host exemption joined in later
        cols["_path_kw"] = kw
    else:
        cols["path_login_keyword"] = kw & ~F.coalesce(F.col(exempt), F.lit(False))
    return [c.alias(k) for k, c in cols.items()]
