"""Verdict operators V1-V15: row-wise CASE logic over feature columns.

Every function adds columns to a DataFrame; nothing leaves the JVM.  Double
literals are used on purpose so weights and thresholds are IEEE doubles (a
bare decimal literal would be DECIMAL in SQL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.features import _memo, round3


def _b(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def _d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


# ---- V1 ---------------------------------------------------------------------

def rule_score(prefix: str = "") -> Column:
    """V1 points from the lexical and age features."""
    c = lambda n: F.col(prefix + n)
    pts = [
        (c("has_ip"), 3), (c("has_at"), 2), (~c("is_https"), 1),
        (c("suspicious_keywords"), 2), (c("has_redirect"), 2), (c("suspicious_tld"), 3),
        (c("dot_count") > 4, 1), (c("subdomain_count") > 3, 2), (c("url_length") > 100, 1),
        (c("high_entropy_domain"), 2), (c("brand_impersonation"), 3), (c("is_new_domain"), 2),
    ]
    total = F.lit(0)
    for cond, w in pts:
        total = total + F.when(F.coalesce(cond, F.lit(False)), F.lit(w)).otherwise(F.lit(0))
    return total


def with_rule_verdict(df: DataFrame) -> DataFrame:
    """V1: rule_score, rule_result, rule_confidence."""
    def build():
        s = F.col("rule_score")
        return ([("rule_score", rule_score())],
                [("rule_result", F.when(s >= 4, F.lit("PHISHING")).otherwise(F.lit("SAFE"))),
                 ("rule_confidence", F.when(s >= 4, F.least(F.lit(50) + s * 5, F.lit(95)))
                  .otherwise(F.least(F.lit(60) + (F.lit(10) - s) * 3, F.lit(95))))])
    st1, st2 = _memo(("rule",), build)
    return _add(_add(df, st1), st2)


def _add(df: DataFrame, named) -> DataFrame:
    """One select adding ``(name, column)`` pairs, replacing same-named columns."""
    names = {n for n, _ in named}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*keep, *[c.alias(n) for n, c in named])


# ---- V10 --------------------------------------------------------------------

def risk_literal(level) -> Column:
    """One of the fixed risk levels as a struct."""
    return F.struct(*[F.lit(v).alias(k) for k, v in zip(("level", "color", "label", "emoji"), level)])


def risk_struct(score: Column, final: Column) -> Column:
    """V10 risk level; the score is the unrounded weighted score."""
    def st(t):
        return F.struct(F.lit(t[0]).alias("level"), F.lit(t[1]).alias("color"),
                        F.lit(t[2]).alias("label"), F.lit(t[3]).alias("emoji"))
    return (F.when((final == "SAFE") & (score < _d(0.20)), st(lists.RISK_SAFE))
             .when(final == "SAFE", st(lists.RISK_LOW))
             .when(score >= _d(0.80), st(lists.RISK_CRITICAL))
             .when(score >= _d(0.60), st(lists.RISK_HIGH))
             .otherwise(st(lists.RISK_MEDIUM)))


# ---- V2/V3/V4 model inputs ----------------------------------------------------

def with_model_inputs(df: DataFrame, rf_prob: str = "rf_prob", nn_prob: str = "nn_prob") -> DataFrame:
    """Turns model probabilities of class 1 into (result, confidence, prob).

    Class = argmax (a tie goes to class 0 = SAFE); confidence = truncated
    max probability * 100.  A NULL tree probability falls back to the rule
    verdict with probability 0.9 / 0.1 (V4); a NULL net probability means no
    net, and the net term then reuses the tree probability.
    """
    st1, st2 = _memo(("model", rf_prob, nn_prob), lambda: _model_cols(rf_prob, nn_prob))
    return _add(_add(df, st1), st2)


def _model_cols(rf_prob, nn_prob):
    rf = F.col(rf_prob).cast("double")
    nn = F.col(nn_prob).cast("double")
    rule_p = F.when(F.col("rule_result") == "PHISHING", _d(0.9)).otherwise(_d(0.1))
    rf_res = F.when(rf.isNull(), F.col("rule_result")).when(rf > _d(0.5), F.lit("PHISHING")).otherwise(F.lit("SAFE"))
    rf_conf = F.when(rf.isNull(), F.col("rule_confidence")).otherwise(
        (F.greatest(rf, _d(1.0) - rf) * _d(100.0)).cast("int"))
    nn_res = F.when(nn.isNull(), F.lit(None).cast("string")).when(nn > _d(0.5), F.lit("PHISHING")).otherwise(F.lit("SAFE"))
    nn_conf = F.when(nn.isNull(), F.lit(0)).otherwise((F.greatest(nn, _d(1.0) - nn) * _d(100.0)).cast("int"))
    return ([("rf_result", rf_res), ("rf_confidence", rf_conf), ("rf_p", F.coalesce(rf, rule_p)),
             ("nn_result", nn_res), ("nn_confidence", nn_conf)],
            [("nn_p", F.coalesce(nn, F.col("rf_p")))])


# ---- V5-V9, V11 -------------------------------------------------------------

def with_ensemble(df: DataFrame) -> DataFrame:
    """V5-V9 + V10 + V11 over columns rf_result, rf_p, rf_confidence,
    nn_result, nn_p, nn_confidence, vt_result, vt_positives, vt_prob,
    gsb_flagged and the features."""
    for stage in _memo(("ensemble",), _ensemble_stages):
        df = _add(df, stage)
    return df.drop("_w")


def _ensemble_stages():
    rf_p, nn_p = F.col("rf_p"), F.col("nn_p")
    vt_pos = F.coalesce(F.col("vt_positives"), F.lit(0))
    vt_unavail = F.col("vt_result") == "UNAVAILABLE"
    gsb = _b("gsb_flagged")
    agreement = _d(1.0) - F.abs(rf_p - nn_p)
    # weights (RF, NN, VT, GSB) by agreement band
    w = (F.when(agreement >= _d(0.8), F.array(_d(0.60), _d(0.25), _d(0.10), _d(0.05)))
          .when(agreement >= _d(0.5), F.array(_d(0.45), _d(0.20), _d(0.25), _d(0.10)))
          .otherwise(F.array(_d(0.25), _d(0.15), _d(0.45), _d(0.15))))
    rw, nw, vw, gw = (F.col("_w")[i] for i in range(4))
    t = rw + nw + gw
    rw2 = F.when(vt_unavail, rw / t).otherwise(rw)
    nw2 = F.when(vt_unavail, nw / t).otherwise(nw)
    vw2 = F.when(vt_unavail, _d(0.0)).otherwise(vw)
    gw2 = F.when(vt_unavail, gw / t).otherwise(gw)
    vt_p = F.when(vt_unavail, _d(0.0)).otherwise(F.coalesce(F.col("vt_prob"), _d(0.0)))
    gsb_p = F.when(gsb, _d(1.0)).otherwise(_d(0.0))
    blended = rw2 * rf_p + nw2 * nn_p + vw2 * vt_p + gsb_p * gw2
    score = (F.when(gsb, _d(0.99)).when(vt_pos >= 3, _d(0.97)).otherwise(blended))
    signal_votes = (
        F.when(F.col("rf_result") == "PHISHING", 2).otherwise(0)
        + F.when(F.col("nn_result") == "PHISHING", 1).otherwise(0)
        + F.when(vt_pos >= 1, 1).otherwise(0)
        + F.when(_b("typosquatting"), 2).otherwise(0)
        + F.when(_b("homograph_attack"), 2).otherwise(0)
        + F.when(_b("redirect_chain_suspicious"), 1).otherwise(0)
        + F.when(_b("title_brand_mismatch"), 2).otherwise(0)
        + F.when(_b("suspicious_tld"), 1).otherwise(0)
        + F.when(_b("brand_impersonation"), 2).otherwise(0))
    override = gsb | (vt_pos >= 3)
    votes = F.when(override, F.lit(99)).otherwise(signal_votes)
    s, v = F.col("weighted_score_raw"), F.col("votes")
    both = (F.col("rf_result") == "PHISHING") & F.coalesce(F.col("nn_result") == "PHISHING", F.lit(False))
    thr = F.when(both, _d(0.42)).otherwise(_d(0.62))
    all_safe = ((F.col("rf_result") == "SAFE")
                & (F.col("nn_result").isNull() | (F.col("nn_result") == "SAFE"))
                & (F.col("vt_result") != "PHISHING"))
    final = (F.when(override, F.lit("PHISHING"))
              .when((s >= thr) | (v >= 5), F.lit("PHISHING"))
              .when((s >= _d(0.38)) & (v >= 2), F.lit("SUSPICIOUS"))
              .when(all_safe, F.lit("SAFE"))
              .when(s >= _d(0.35), F.lit("SUSPICIOUS"))
              .otherwise(F.lit("SAFE")))
    return [
        [("_w", w)],
        [("weighted_score_raw", score), ("votes", votes)],
        [("result", final),
         ("confidence", F.greatest(F.col("rf_confidence"), F.coalesce(F.col("nn_confidence"), F.lit(0))).cast("int")),
         ("weighted_score", round3(F.col("weighted_score_raw")))],
        [("risk", risk_struct(F.col("weighted_score_raw"), F.col("result"))), ("reason_codes", reason_codes())],
    ]


def reason_codes() -> Column:
    """Ordered reason codes; the message text is a lookup on the code."""
    vt_pos = F.coalesce(F.col("vt_positives"), F.lit(0))
    items = [
        F.when(_b("has_ip"), F.lit("raw_ip")),
        F.when(_b("brand_impersonation"), F.lit("brand_impersonation")),
        F.when(_b("typosquatting"), F.lit("typosquatting")),
        F.when(_b("homograph_attack"), F.lit("homograph")),
        F.when(~_b("is_https"), F.lit("no_https")),
        F.when(_b("suspicious_keywords"), F.lit("suspicious_keywords")),
        F.when(_b("is_new_domain"), F.lit("new_domain")),
        F.when(_b("high_entropy_domain"), F.lit("high_entropy")),
        F.when(vt_pos >= 3, F.lit("vt_malicious")).when(vt_pos >= 1, F.lit("vt_flagged")),
        F.when(_b("gsb_flagged"), F.lit("gsb_flagged")),
        F.when(_b("redirect_chain_suspicious"), F.lit("redirect_chain")),
        F.when(F.coalesce(F.col("subdomain_count"), F.lit(0)) > 3, F.lit("deep_subdomains")),
        F.when(_b("title_brand_mismatch"), F.lit("title_brand_mismatch")),
        F.when(_b("form_external_action"), F.lit("external_form")),
        F.when(_b("has_hidden_iframe"), F.lit("hidden_iframe")),
        F.when(_b("suspicious_tld"), F.lit("risky_tld")),
    ]
    arr = F.array_compact(F.array(*items))
    return F.when((F.size(arr) == 0) & (F.col("result") == "PHISHING"), F.array(F.lit("ml_pattern"))).otherwise(arr)


# message text per reason code (V11); numbers are filled from the row
REASON_TEXT = {
    "raw_ip": "URL uses a raw IP address instead of a domain name",
    "brand_impersonation": "Domain appears to impersonate a well-known brand",
    "typosquatting": "Domain is a near-typo of a trusted site (e.g. paypa1.com)",
    "homograph": "Domain uses lookalike Unicode or Punycode characters",
    "no_https": "Site does not use HTTPS encryption",
    "suspicious_keywords": "URL contains suspicious keywords (login, verify, confirm…)",
    "new_domain": "Domain was registered very recently (< 30 days)",
    "high_entropy": "Domain name appears randomly generated (high entropy)",
    "vt_malicious": "Flagged as malicious by {vt_positives} VirusTotal engines",
    "vt_flagged": "Flagged by {vt_positives} VirusTotal engine(s)",
    "gsb_flagged": "Flagged by Google Safe Browsing",
    "redirect_chain": "Suspicious redirect chain ({redirect_hop_count} hops)",
    "deep_subdomains": "Unusually high subdomain depth ({subdomain_count} levels)",
    "title_brand_mismatch": "Page title mentions a brand but domain doesn't match it",
    "external_form": "Form submits credentials to an external domain",
    "hidden_iframe": "Page contains hidden iframes (common in phishing kits)",
    "risky_tld": "Domain uses a high-risk TLD",
    "ml_pattern": "ML models detected phishing patterns in URL structure and features",
}


def reason_messages(codes: Column) -> Column:
    """Codes -> message strings, numbers substituted from the row."""
    def msg(code):
        expr = None
        for k, text in REASON_TEXT.items():
            t = F.lit(text)
            for fld in ("vt_positives", "redirect_hop_count", "subdomain_count"):
                if "{" + fld + "}" in text:
                    t = F.replace(t, F.lit("{" + fld + "}"), F.coalesce(F.col(fld), F.lit(0)).cast("string"))
            expr = F.when(code == k, t) if expr is None else expr.when(code == k, t)
        return expr
    return F.transform(codes, msg)
