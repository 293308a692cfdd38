"""End-to-end URL scoring plan (T1 batch form, V12 routing, V13, V15).

``requests (id, url)`` -> validation -> normalisation -> skip flag ->
features -> host table (enrichment + allow/block flags, one row per host) ->
URL table (enrichment + exact feed hits, one row per URL) -> model inputs ->
ensemble -> routing precedence.  The URL rows are joined twice (host, URL),
the requests once, and once to model scores when those come from a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import lists
from ..functions import urls as U
from ..operators import enrich as en
from ..operators import featurize as fz
from ..operators import matching as m
from ..operators import ml
from ..operators import verdict as vd
from ..session import materialize


@dataclass
class ListInputs:
    static_allowlist: DataFrame | None = None   # domain
    dynamic_allowlist: DataFrame | None = None  # domain
    feed_urls: DataFrame | None = None          # url
    feed_domains: DataFrame | None = None       # domain
    feed_url_filter: object | None = None       # membership filters of the two (Bloom)
    feed_domain_filter: object | None = None


@dataclass
class ScoringInputs:
    lists: ListInputs = field(default_factory=ListInputs)
    enrichment: en.Enrichment = field(default_factory=en.Enrichment)
    model_scores: DataFrame | None = None       # id, rf_prob, nn_prob
    tree_model: object | None = None            # fitted on the 43 features; used without model_scores
    neural_model: object | None = None
    facts: object | None = None                 # a kept FactStore, used instead of the enrichment tables
    cache: DataFrame | None = None              # cache_key, stored_at, result, confidence, risk_level, reasons
    now: str | None = None                      # time that cached results are judged at
    as_of: str = "2024-01-15"


def _host_flags(hosts: DataFrame, li: ListInputs) -> DataFrame:
    """host -> in_static, in_dynamic, in_feed_domain (one row per host)."""
    h = hosts.select("host").distinct()
    h = h.withColumn("feed_host", U.feed_host_of_netloc(F.col("host")))
    if li.static_allowlist is not None:
        h = m.with_flag(h, m.static_allowlist_hits(h, li.static_allowlist), "host", "in_static")
    else:
        h = h.withColumn("in_static", F.lit(False))
    if li.dynamic_allowlist is not None:
        h = m.with_flag(h, m.dynamic_allowlist_hits(h, li.dynamic_allowlist), "host", "in_dynamic")
    else:
        h = h.withColumn("in_dynamic", F.lit(False))
    if li.feed_domains is not None:
        h = m.with_flag(h, m.feed_domain_hits(h, li.feed_domains, listed=li.feed_domain_filter), "feed_host", "in_feed_domain")
    else:
        h = h.withColumn("in_feed_domain", F.lit(False))
    return h.drop("feed_host")


def score_requests(requests: DataFrame, inputs: ScoringInputs, id_col: str = "id",
                   url_col: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """Full verdict per request row; the request's columns named in ``keep``
    stay with it.

    Validation, normalisation and list routing run once per distinct request
    URL; features, enrichment and rules once per distinct URL that no list has
    decided.  Only the distinct URLs to be scored meet their features; the others
    pass by, and the requests meet the result in one join.
    """
    r = requests.select(F.col(id_col).alias("id"), F.col(url_col).alias("raw_url"), *keep)
    u = r.select("raw_url").distinct().withColumn("error", U.validation_error(F.col("raw_url")))
    u = U.with_normalized(u, "raw_url", "_norm")
    u = (u.withColumn("url", F.when(F.col("error").isNull(), F.col("_norm"))).drop("_norm")
          .withColumn("skipped", F.coalesce(U.is_skipped(F.col("url")), F.lit(False))))
    u = U.with_split(u, "url", "_u").withColumn("host", U.host_of_netloc(F.col("_u_netloc")))
    u = materialize(u.select("raw_url", "error", "url", "skipped", "host"), "request-urls")
    # lists: only hosts and URLs that are neither invalid nor skipped ask them
    asks = F.col("error").isNull() & ~F.col("skipped")
    flags = _host_flags(u.where(asks).select("host"), inputs.lists).select(
        F.col("host").alias("_fhost"), "in_static", "in_dynamic", "in_feed_domain")
    ask_host = F.when(asks, F.col("host"))
    routed = u.withColumn("_ask", ask_host).join(flags, F.col("_ask") == F.col("_fhost"), "left").drop("_ask", "_fhost")
    if inputs.lists.feed_urls is not None:
        hits = m.feed_url_hits(u.where(asks).select("url"), inputs.lists.feed_urls, listed=inputs.lists.feed_url_filter)
        routed = routed.join(hits.select(F.col("url").alias("_hit")).distinct(), F.col("url") == F.col("_hit"), "left")
        routed = routed.withColumn("in_feed_url", F.col("_hit").isNotNull()).drop("_hit")
    else:
        routed = routed.withColumn("in_feed_url", F.lit(False))
    if inputs.cache is not None:
        now = F.lit(inputs.now).cast("timestamp") if inputs.now else F.current_timestamp()
        routed = routed.join(fresh_results(inputs.cache, now), cache_key(F.col("url")) == F.col("_ckey"), "left").drop("_ckey")
    else:
        routed = routed.withColumn("_stored", F.lit(None).cast(STORED))
    routed = materialize(routed.withColumn("route", route_of()), "routed-urls")
    scored = _scored_urls(routed.where(F.col("route") == "scored").select("url").distinct(), inputs)
    scored = scored.withColumnRenamed("url", "_surl").drop("host")
    undecided = F.col("route") == "scored"
    ru = routed.where(undecided).join(scored, F.col("url") == F.col("_surl")).drop("_surl")
    ru = ru.unionByName(routed.where(~undecided), allowMissingColumns=True).withColumnRenamed("raw_url", "_raw")
    f = r.join(ru, r["raw_url"].eqNullSafe(F.col("_raw")), "left").drop("_raw")
    if inputs.model_scores is None and inputs.tree_model is not None:
        f = f if "nn_prob" in f.columns else f.withColumn("nn_prob", F.lit(None).cast("double"))
    elif inputs.model_scores is not None:
        ms = inputs.model_scores.select(F.col("id").alias("_mid"), "rf_prob", "nn_prob")
        f = f.join(ms, f["id"] == F.col("_mid"), "left").drop("_mid")
    else:
        f = f.withColumn("rf_prob", F.lit(None).cast("double")).withColumn("nn_prob", F.lit(None).cast("double"))
    return finish(vd.with_ensemble(vd.with_model_inputs(f)))


def _scored_urls(urls_: DataFrame, inputs: ScoringInputs) -> DataFrame:
    """One row per undecided URL: the 43 features, reputation and rule verdict."""
    f = materialize(fz.url_level_features(urls_, "url"), "undecided-urls")
    # the 13 host-only features join the URLs together with the host-keyed enrichment
    f = en.enrich_features(f, inputs.enrichment, "url", inputs.as_of,
                           extra_host_flags=feat.host_feature_table(f, "host"), store=inputs.facts)
    f = fz.finish_path_keyword(f)
    if "vt_result" not in f.columns:
        f = f.withColumns({"vt_result": F.lit("UNAVAILABLE"), "vt_positives": F.lit(0), "vt_total": F.lit(0),
                           "vt_ratio": F.lit("N/A"), "vt_prob": F.lit(0.0)})
    f = vd.with_rule_verdict(fz.with_deep_defaults(f))
    f = f.drop(*[c for c in f.columns if c in ("in_feed_url",)])
    if inputs.model_scores is None and inputs.tree_model is not None:
        f = ml.with_model_probability(f, inputs.tree_model, "rf_prob")
        if inputs.neural_model is not None:
            f = ml.with_model_probability(f, inputs.neural_model, "nn_prob")
    return materialize(f, "scored-urls")


def cache_key(url: Column) -> Column:
    """Key of a stored result: SHA-256 of the normalised URL."""
    return F.sha2(url, 256)


def fresh_results(cache: DataFrame, now: Column, ttl_s: int = lists.CACHE_TTL_SECONDS) -> DataFrame:
    """The newest stored result of each key that is younger than the TTL."""
    age = F.unix_micros(now) - F.unix_micros(F.col("stored_at").cast("timestamp"))
    stored = F.struct(F.col("stored_at"), "result", "confidence", "risk_level", "reasons")
    return (cache.where((age >= 0) & (age < ttl_s * 1_000_000)).groupBy(F.col("cache_key").alias("_ckey"))
            .agg(F.max(stored).alias("_stored")))


def evict(cache: DataFrame, feedback_urls: DataFrame) -> DataFrame:
    """The cache without the results that a feedback names (S13): the URL as it
    was given is the key."""
    gone = feedback_urls.select(cache_key(F.col("url")).alias("_gone")).distinct()
    return cache.join(gone, F.col("cache_key") == F.col("_gone"), "left_anti")


STORED = "struct<stored_at:timestamp,result:string,confidence:int,risk_level:string,reasons:string>"


def route_of() -> Column:
    """Invalid -> skipped -> cached -> allow-list -> blocklist -> scored."""
    in_allow = F.coalesce(F.col("in_static"), F.lit(False)) | F.coalesce(F.col("in_dynamic"), F.lit(False))
    in_block = F.coalesce(F.col("in_feed_url"), F.lit(False)) | F.coalesce(F.col("in_feed_domain"), F.lit(False))
    return (F.when(F.col("error").isNotNull(), F.lit("error"))
             .when(F.col("skipped"), F.lit("skipped"))
             .when(F.col("_stored").isNotNull(), F.lit("cached"))
             .when(in_allow, F.lit("allowlist"))
             .when(in_block, F.lit("blocklist"))
             .otherwise(F.lit("scored")))


def finish(f: DataFrame) -> DataFrame:
    """Final result, confidence, risk, source and reasons by route."""
    rt = F.col("route")
    old = lambda k: F.col("_stored").getField(k)
    safe100 = rt.isin("skipped", "allowlist")
    return f.select(
        "*",
        F.when(rt == "error", F.lit("ERROR")).when(safe100, F.lit("SAFE")).when(rt == "cached", old("result"))
         .when(rt == "blocklist", F.lit("PHISHING")).otherwise(F.col("result")).alias("final_result"),
        F.when(rt == "error", F.lit(None).cast("int")).when(safe100, F.lit(100)).when(rt == "cached", old("confidence"))
         .when(rt == "blocklist", F.lit(99)).otherwise(F.col("confidence")).alias("final_confidence"),
        F.when(rt == "error", F.lit(None).cast("string")).when(safe100, F.lit("SAFE")).when(rt == "cached", old("risk_level"))
         .when(rt == "blocklist", F.lit("CRITICAL")).otherwise(F.col("risk.level")).alias("risk_level"),
        F.when(rt == "allowlist", F.when(F.coalesce(F.col("in_static"), F.lit(False)), F.lit("static_whitelist"))
               .otherwise(F.lit("user_verified"))).alias("whitelist_source"),
        F.when(rt == "scored", F.array_join(F.col("reason_codes"), ","))
         .when(rt == "blocklist", F.lit("blocklist")).when(rt == "cached", old("reasons"))
         .otherwise(F.lit("")).alias("reasons"),
    ).drop("_stored")


def scan_log_rows(verdicts: DataFrame) -> DataFrame:
    """V13 + S11: rows the scan log receives -- blocklist hits and scored
    URLs, minus browser/file pages."""
    rt = F.col("route")
    blk = rt == "blocklist"
    out = verdicts.where(rt.isin("blocklist", "scored")).select(
        "id", "url",
        F.col("final_result").alias("result"),
        F.when(blk, F.lit("BLOCKLIST")).otherwise(F.col("rf_result")).alias("ml_result"),
        F.when(blk, F.lit("N/A")).otherwise(F.coalesce(F.col("nn_result"), F.lit("N/A"))).alias("lstm_result"),
        F.when(blk, F.lit("BLOCKLIST")).otherwise(F.col("vt_result")).alias("vt_result"),
        F.col("final_confidence").alias("confidence"),
        F.when(blk, F.lit("N/A")).otherwise(F.col("vt_ratio")).alias("vt_ratio"),
        *(["timestamp"] if "timestamp" in verdicts.columns else []))
    return out.where(~U.starts_with_any(F.col("url"), lists.NO_LOG_PREFIXES))


#: What a document of a list hit says.
BLOCKLIST_REASON = "Found in threat intelligence blocklist"
BLOCKLIST_SOURCE = "Threat feed blocklist"


def verdict_document(verdicts: DataFrame, gsb_known: bool = False) -> DataFrame:
    """The nested verdict by route, as a struct and as JSON text.

    Skipped pages carry result, risk and no models; allow-listed ones SAFE and
    blocklisted ones PHISHING from every model; scored ones the models' own
    answers, the signals and the 43 features.  ``gsb_known`` says that a
    safe-browsing table was asked, so that no hit means SAFE.
    """
    rt = F.col("route")
    scored, blocked, allowed, skipped = (rt == r for r in ("scored", "blocklist", "allowlist", "skipped"))

    def by_route(allow, block, score):
        return F.when(allowed, allow).when(blocked, block).when(scored, score)

    def listed(own):
        return by_route(F.lit("SAFE"), F.lit("PHISHING"), own)

    gsb = F.when(F.col("gsb_flagged"), F.lit("PHISHING")).otherwise(F.lit("SAFE" if gsb_known else "UNAVAILABLE"))
    risk = (F.when(skipped | allowed, vd.risk_literal(lists.RISK_SAFE)).when(blocked, vd.risk_literal(lists.RISK_CRITICAL))
             .when(scored, F.col("risk")))
    none = F.array().cast("array<string>")
    reasons = (F.when(blocked, F.array(F.lit(BLOCKLIST_REASON)))
                .when(scored, vd.reason_messages(F.col("reason_codes"))).when(rt != "error", none))
    doc = F.struct(
        F.col("url"), F.col("error"), F.col("final_result").alias("result"), F.col("final_confidence").alias("confidence"),
        F.when(scored, F.col("final_result") == "SUSPICIOUS").alias("is_suspicious"),
        F.when(scored, F.col("weighted_score")).alias("weighted_score"),
        risk.alias("risk"), reasons.alias("reasons"),
        F.when(blocked, F.lit(BLOCKLIST_SOURCE)).alias("source"),
        F.when(allowed | blocked | scored, F.struct(
            listed(F.col("rf_result")).alias("random_forest"),
            listed(F.coalesce(F.col("nn_result"), F.lit("unavailable"))).alias("lstm"),
            listed(F.col("vt_result")).alias("virustotal"),
            listed(gsb).alias("google_safebrowsing"))).alias("models"),
        F.when(allowed | blocked | scored, F.struct(
            listed(F.col("vt_result")).alias("vt_result"),
            by_route(F.lit(0), F.lit(1), F.col("vt_positives")).alias("positives"),
            by_route(F.lit(0), F.lit(1), F.col("vt_total")).alias("total"),
            by_route(F.lit("0/0"), F.lit("1/1"), F.col("vt_ratio")).alias("vt_ratio"),
            F.when(scored, F.col("vt_prob")).alias("vt_prob"))).alias("virustotal"),
        F.when(scored, F.struct(
            F.col("typosquatting"), F.col("homograph_attack"), F.col("gsb_flagged"),
            F.col("redirect_hop_count").alias("redirect_hops"),
            F.col("redirect_chain_suspicious").alias("redirect_suspicious"),
            F.col("high_risk_country"), F.col("is_proxy_hosting"))).alias("new_signals"),
        F.when(scored, F.struct(*[F.col(k) for k in feat.FEATURE_KEYS])).alias("features"),
        F.when(allowed, F.lit(True)).alias("whitelisted"), F.col("whitelist_source"),
        F.when(skipped, F.lit(True)).alias("skipped"),
    )
    return verdicts.select("id", "route", doc.alias("verdict")).withColumn("verdict_json", F.to_json("verdict"))


def counters(verdicts: DataFrame) -> DataFrame:
    """Service counters over routed verdicts (one pass)."""
    rt = F.col("route")
    scored = rt == "scored"
    return verdicts.agg(
        F.count_if(scored).alias("total_scans"),
        F.count_if(scored & (F.col("final_result") == "PHISHING")).alias("result_phishing"),
        F.count_if(scored & (F.col("final_result") == "SUSPICIOUS")).alias("result_suspicious"),
        F.count_if(scored & (F.col("final_result") == "SAFE")).alias("result_safe"),
        F.count_if(rt == "cached").alias("cache_hits"),
        F.count_if(rt == "blocklist").alias("blocklist_hits"),
        F.count_if(scored & (F.col("vt_result") == "UNAVAILABLE")).alias("vt_unavailable"),
        F.count_if(scored & F.col("gsb_flagged")).alias("gsb_flagged_count"))
