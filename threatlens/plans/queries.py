"""Registered queries: one per operator of the inventory, each
``(spark, sf_dir) -> DataFrame`` over the driver's tables (or fixtures Spark
derives from them).  Integer outputs are BIGINT so both engines agree on
types.  The matching DuckDB text is in :mod:`threatlens.plans.oracle_sql`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features as feat
from ..functions import urls
from ..operators import featurize as fz
from ..operators import verdict as vd
from ..sources.fixtures import fixture
from ..sources.tables import read_table
from ..session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def bigints(df: DataFrame) -> DataFrame:
    """Cast every int/short/byte column to BIGINT (engine-neutral types)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# ---- U1-U5 ----------------------------------------------------------------------

@register("url_split")
def q_url_split(spark, sf_dir):
    """Split corpus URLs into their six parts."""
    c = fixture(spark, sf_dir, "url_corpus")
    p = urls.url_split(F.col("url"))
    return c.select("page_id", "url", p["scheme"].alias("scheme"), p["netloc"].alias("netloc"),
                    p["path"].alias("path"), p["params"].alias("params"), p["query"].alias("query"),
                    p["fragment"].alias("fragment"))


def _odd_requests(spark, sf_dir) -> DataFrame:
    """Requests that validation or cleaning changes, ids below all others."""
    return fixture(spark, sf_dir, "odd_requests").select((-F.col("id") - F.lit(ODD_IDS)).alias("id"), "url")


ODD_IDS = 1 << 40


@register("url_normalize")
def q_url_normalize(spark, sf_dir):
    """U2 + U4 + U5 over the corpus and the (messier) scan-log URLs."""
    c = fixture(spark, sf_dir, "url_corpus").select(F.col("page_id").alias("id"), "url")
    s = fixture(spark, sf_dir, "scans").select(-F.col("id") - F.lit(1), "url")
    both = c.unionByName(s.toDF("id", "url")).unionByName(_odd_requests(spark, sf_dir))
    n = urls.normalize_url(F.col("url"))
    return (both.select("id", "url", urls.validation_error(F.col("url")).alias("error"), n.alias("normalized"))
                .withColumn("skipped", urls.is_skipped(F.col("normalized"))))


@register("host_variants")
def q_host_variants(spark, sf_dir):
    """U3 (a)-(f) host variants of corpus and page URLs."""
    c = fixture(spark, sf_dir, "url_corpus")
    nl = urls.netloc_of(F.col("url"))
    a = urls.host_of_netloc(nl)
    return c.select(
        "page_id", "url", a.alias("host"),
        urls.feed_host_of_netloc(nl).alias("feed_host"),
        urls.dynamic_host_of_netloc(nl).alias("dynamic_host"),
        urls.strip_www(a).alias("purge_host"),
        urls.sql_substring_host(F.col("url")).alias("report_host"),
        urls.root_of(a).alias("root"))


# ---- features, V1, V14 --------------------------------------------------------------

@register("url_features")
def q_url_features(spark, sf_dir):
    """Section 2.3 URL-only features (V16 without enrichment)."""
    c = fixture(spark, sf_dir, "url_corpus")
    f = fz.lexical_features(c, "url")
    keys = [k for k in feat.FEATURE_KEYS if k in f.columns]
    return bigints(f.select("page_id", "url", "host", *keys))


def _bulk_verdicts(spark, sf_dir) -> DataFrame:
    c = fixture(spark, sf_dir, "url_corpus")
    f = vd.with_rule_verdict(fz.featurize(c, "url"))
    p = F.when(F.col("rule_result") == "PHISHING", F.lit(0.9)).otherwise(F.lit(0.1))
    return f.select("page_id", "url", "rule_score", F.col("rule_result").alias("result"),
                    F.col("rule_confidence").alias("confidence"),
                    vd.risk_struct(p, F.col("rule_result"))["level"].alias("risk_level"))


@register("rule_verdicts")
def q_rule_verdicts(spark, sf_dir):
    """V1 + V10 + V14: rule score, verdict, confidence and risk per URL."""
    return bigints(_bulk_verdicts(spark, sf_dir))


@register("verdict_summary")
def q_verdict_summary(spark, sf_dir):
    """Flagship: corpus -> features -> rule verdict -> count by verdict, risk."""
    v = _bulk_verdicts(spark, sf_dir)
    return bigints(v.groupBy("result", "risk_level").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.sum("rule_score").alias("sum_score"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence")))


# ---- feeds: S6-S10, SET1, SET2, A14 --------------------------------------------------

from ..functions import lists  # noqa: E402
from ..operators import matching as mt  # noqa: E402
from ..sources import feeds as fd  # noqa: E402


def _feed_catalog(spark, sf_dir):
    lines = fixture(spark, sf_dir, "feed_lines")
    offline = spark.createDataFrame([("offline_source", "url_per_line")], "source string, format string")
    return lines.select("source", "format").distinct().unionByName(offline)


def _feed_sets(spark, sf_dir):
    parsed = fd.parse_feed_lines(fixture(spark, sf_dir, "feed_lines"))
    return fd.feed_sets(parsed)


@register("feed_entries")
def q_feed_entries(spark, sf_dir):
    """Every accepted feed entry before de-duplication."""
    return fd.parse_feed_lines(fixture(spark, sf_dir, "feed_lines"))


@register("feed_folder_entries")
def q_feed_folder_entries(spark, sf_dir):
    """Landing folders (names with spaces), written from the feed lines and
    read back by folder name; unknown folders go to the quarantine."""
    from ..session import scratch_path
    import uuid
    root = scratch_path(spark, f"feed-landing-{uuid.uuid4().hex[:12]}")
    lines = fixture(spark, sf_dir, "feed_lines")
    catalog = lines.select("source", "format").distinct().where(F.col("source") != "hosts")
    for r in lines.select("source").distinct().collect():  # the catalog's few sources
        lines.where(F.col("source") == r["source"]).select("line").write.text(f"{root}/{r['source']}")
    back = fd.read_feed_folders(spark, root, catalog)
    known = fd.parse_feed_lines(back).select("source", "kind", "value", F.lit(None).cast("bigint").alias("lines"))
    lost = fd.unknown_sources(back).select("source", F.lit("unknown source").alias("kind"),
                                           F.lit(None).cast("string").alias("value"), "lines")
    return known.unionByName(lost)


@register("feed_urls")
def q_feed_urls(spark, sf_dir):
    """Distinct feed URLs."""
    return _feed_sets(spark, sf_dir)[0]


@register("feed_domains")
def q_feed_domains(spark, sf_dir):
    """S9 + SET1 + SET2: distinct feed domains minus protected brands."""
    return _feed_sets(spark, sf_dir)[1]


@register("feed_stats")
def q_feed_stats(spark, sf_dir):
    """Entries per source before de-duplication, with status."""
    lines = fixture(spark, sf_dir, "feed_lines")
    return fd.feed_stats(lines, fd.parse_feed_lines(lines), _feed_catalog(spark, sf_dir))


@register("feed_totals")
def q_feed_totals(spark, sf_dir):
    """URL, domain and total entry counts of the built feed."""
    u, d = _feed_sets(spark, sf_dir)
    return fd.feed_totals(u, d)


# ---- J1-J5 -------------------------------------------------------------------------

def _probe_urls(spark, sf_dir) -> DataFrame:
    """Normalised corpus URLs plus plain page URLs, with their hosts."""
    c = fixture(spark, sf_dir, "url_corpus").select("url")
    p = fixture(spark, sf_dir, "page_html").select("url")
    u = urls.with_normalized(c.unionByName(p), "url", "n").select(F.col("n").alias("url")).distinct()
    u = urls.with_split(u, "url", "_p")
    u = u.select("url", urls.host_of_netloc(F.col("_p_netloc")).alias("host"))
    # probed by several joins (hosts, URLs): written once
    return materialize(u, "probe-urls")


def static_allowlist_for(spark) -> DataFrame:
    """Starter allow-list plus one parent domain present in the data."""
    return mt.list_df(spark, lists.DEFAULT_ALLOWLIST + ["example.net"], "domain")


@register("allowlist_static_match")
def q_allowlist_static(spark, sf_dir):
    """Hosts allow-listed directly, without 'www.', or by a parent."""
    hosts = _probe_urls(spark, sf_dir).select("host").distinct()
    hits = mt.static_allowlist_hits(hosts, static_allowlist_for(spark))
    return mt.with_flag(hosts, hits, "host", "allowlisted")


from ..operators import consensus as cs  # noqa: E402
from ..operators import maintenance as mn  # noqa: E402
from ..operators import reporting as rp  # noqa: E402
from ..sources import sinks as sk  # noqa: E402

AS_OF_TS = "2024-02-01 00:00:00"
PRIOR_TS = "2024-01-01 00:00:00"


def _reports(spark, sf_dir):
    return fixture(spark, sf_dir, "reports")


def _consensus(spark, sf_dir):
    return cs.report_consensus(_reports(spark, sf_dir))


def _prior_verified(spark, sf_dir):
    """verified_urls before this run: consensus over two thirds of
    the report log, all already used for training."""
    early = _reports(spark, sf_dir).where(F.col("id") % 3 != 0)
    return (cs.newly_verified(cs.report_consensus(early), PRIOR_TS)
            .withColumn("used_in_train", F.lit(1)))


def _verified_after(spark, sf_dir):
    new = cs.newly_verified(_consensus(spark, sf_dir), AS_OF_TS)
    return cs.upsert_verified(_prior_verified(spark, sf_dir), new)


def _user_allowlist(spark, sf_dir):
    return sk.allowlist_additions(fixture(spark, sf_dir, "allowlist_requests"))


def _dynamic_allowlist(spark, sf_dir):
    return cs.dynamic_allowlist(_user_allowlist(spark, sf_dir), _consensus(spark, sf_dir))


@register("allowlist_dynamic_match")
def q_allowlist_dynamic(spark, sf_dir):
    """J2 + SET3: hosts whose 'www.'-free form is in the dynamic list."""
    hosts = _probe_urls(spark, sf_dir).select("host").distinct()
    hits = mt.dynamic_allowlist_hits(hosts, _dynamic_allowlist(spark, sf_dir))
    return mt.with_flag(hosts, hits, "host", "allowlisted")


@register("blocklist_match")
def q_blocklist_match(spark, sf_dir):
    """J3 + J4 + J5: exact-URL and parent-domain feed hits per URL."""
    u = _probe_urls(spark, sf_dir).withColumn("feed_host", urls.feed_host_of_netloc(F.col("host")))
    fu, fdm = _feed_sets(spark, sf_dir)
    out = mt.with_flag(u, mt.feed_url_hits(u, fu), "url", "in_feed_url")
    out = mt.with_flag(out, mt.feed_domain_hits(out, fdm), "feed_host", "in_feed_domain")
    return out.withColumn("blocked", F.col("in_feed_url") | F.col("in_feed_domain"))


@register("feed_delta_flags")
def q_feed_delta_flags(spark, sf_dir):
    """T2 + J3 + J4: flags under an earlier feed (some lines missing, some since
    taken out), brought up to date by the published changes alone."""
    from ..session import scratch_path
    import uuid
    root = scratch_path(spark, f"feeds-{uuid.uuid4().hex[:12]}")
    lines, catalog = fixture(spark, sf_dir, "feed_lines"), _feed_catalog(spark, sf_dir)
    gone = fixture(spark, sf_dir, "page_html").where(F.pmod(F.col("page_id"), F.lit(7)) == 3).select(
        F.lit("urls_plain").alias("source"), F.lit("url_per_line").alias("format"), F.col("url").alias("line"))
    u = _probe_urls(spark, sf_dir).withColumn("feed_host", urls.feed_host_of_netloc(F.col("host")))
    sj.refresh_feeds(lines.where(F.pmod(F.xxhash64("line"), F.lit(3)) != 0).unionByName(gone), catalog, root, "v0")
    flags = materialize(mt.feed_flags(u, *sj.current_feeds(spark, root)), "feed-flags")
    sj.refresh_feeds(lines, catalog, root, "v1")
    out = mt.reflagged(flags, *sj.feed_changes(spark, root), *sj.current_feeds(spark, root))
    return out.withColumn("blocked", F.col("in_feed_url") | F.col("in_feed_domain"))


@register("blocklist_match_filtered")
def q_blocklist_match_filtered(spark, sf_dir):
    """J3 + J4 through the published feed's membership filters."""
    from ..session import scratch_path
    import uuid
    root = scratch_path(spark, f"feeds-{uuid.uuid4().hex[:12]}")
    sj.refresh_feeds(fixture(spark, sf_dir, "feed_lines"), _feed_catalog(spark, sf_dir), root, "v0")
    u = _probe_urls(spark, sf_dir).withColumn("feed_host", urls.feed_host_of_netloc(F.col("host")))
    out = mt.feed_flags(u, *sj.current_feeds(spark, root), *sj.feed_filters(spark, root))
    return out.withColumn("blocked", F.col("in_feed_url") | F.col("in_feed_domain"))


@register("dynamic_allowlist")
def q_dynamic_allowlist(spark, sf_dir):
    """SET3: user-added + report-verified hosts."""
    return _dynamic_allowlist(spark, sf_dir)


@register("allowlist_additions")
def q_allowlist_additions(spark, sf_dir):
    """Cleaned, valid, new allow-list hosts."""
    return _user_allowlist(spark, sf_dir)


@register("allowlist_new_hosts")
def q_allowlist_new_hosts(spark, sf_dir):
    """S14 against the list so far: requested hosts that no safe report has listed."""
    listed = cs.consensus_safe_domains(_consensus(spark, sf_dir))
    return sk.allowlist_additions(fixture(spark, sf_dir, "allowlist_requests"), listed)


@register("report_consensus")
def q_report_consensus(spark, sf_dir):
    """A9 + J8: consensus decision per reported URL."""
    c = _consensus(spark, sf_dir)
    return bigints(c.select("url", "pending_safe", "pending_phishing", "all_safe", "all_phishing",
                            "decision", "report_count"))


@register("reports_after_verify")
def q_reports_after_verify(spark, sf_dir):
    """A9 rewrite: reports with used_in_verify set for verified groups."""
    r = cs.mark_reports_verified(_reports(spark, sf_dir), _consensus(spark, sf_dir))
    return bigints(r.select("id", "url", "label", "used_in_verify"))


@register("verified_urls_upsert")
def q_verified_upsert(spark, sf_dir):
    """Insert-or-replace of verified URLs (replaced rows restart)."""
    v = _verified_after(spark, sf_dir)
    return bigints(v.select("url", "label", "report_count", "used_in_train",
                            F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at")))


@register("pending_training_rows")
def q_pending_training(spark, sf_dir):
    """Verified URLs awaiting training."""
    return cs.pending_training_rows(_verified_after(spark, sf_dir))


@register("mark_trained")
def q_mark_trained(spark, sf_dir):
    """A12 update: phishing verified URLs marked as trained."""
    v = _verified_after(spark, sf_dir)
    trained = cs.pending_training_rows(v).where(F.col("label") == "phishing")
    return bigints(cs.mark_trained(v, trained).select("url", "label", "used_in_train"))


@register("verified_safe_domains")
def q_verified_safe_domains(spark, sf_dir):
    """Hosts of verified, trained, safe URLs."""
    return cs.verified_safe_domains(_verified_after(spark, sf_dir))


@register("retrain_trigger")
def q_retrain_trigger(spark, sf_dir):
    """Pending verified rows vs the retrain threshold."""
    return bigints(cs.retrain_trigger(_verified_after(spark, sf_dir)))


@register("retrain_status")
def q_retrain_status(spark, sf_dir):
    """A10: watcher status row."""
    r = cs.mark_reports_verified(_reports(spark, sf_dir), _consensus(spark, sf_dir))
    out = cs.retrain_status(r, _verified_after(spark, sf_dir), fixture(spark, sf_dir, "retrain_log"))
    return bigints(out.withColumn("last_triggered_at", F.date_format("last_triggered_at", "yyyy-MM-dd HH:mm:ss")))


@register("retrain_log_latest")
def q_retrain_log_latest(spark, sf_dir):
    """Current state of each retrain run from its status events."""
    out = sk.retrain_log_latest(fixture(spark, sf_dir, "retrain_log"))
    return bigints(out.withColumn("triggered_at", F.date_format("triggered_at", "yyyy-MM-dd HH:mm:ss")))


@register("report_tally")
def q_report_tally(spark, sf_dir):
    """Report progress per (url, label), top 100."""
    return bigints(cs.report_tally(_reports(spark, sf_dir)))


# ---- A1-A7, A15, M1-M3 --------------------------------------------------------------

def _scans(spark, sf_dir):
    return fixture(spark, sf_dir, "scans")


@register("scan_totals")
def q_scan_totals(spark, sf_dir):
    """A1: scan totals and phishing rate."""
    return rp.scan_totals(_scans(spark, sf_dir))


@register("dashboard_kpis")
def q_dashboard_kpis(spark, sf_dir):
    """A2: dashboard counts over non-internal scans."""
    return bigints(rp.dashboard_kpis(_scans(spark, sf_dir)))


@register("daily_activity")
def q_daily_activity(spark, sf_dir):
    """A3: scans and phishing per day, latest 7 days."""
    return bigints(rp.daily_activity(_scans(spark, sf_dir)))


@register("recent_scans")
def q_recent_scans(spark, sf_dir):
    """A4: newest 50 scans excluding browser pages."""
    return bigints(rp.recent_scans(_scans(spark, sf_dir)))


@register("scan_history")
def q_history(spark, sf_dir):
    """A5: newest 200 scans (request capped at 1000)."""
    return bigints(rp.history(_scans(spark, sf_dir), 200))


@register("top_phishing_domains")
def q_top_domains(spark, sf_dir):
    """Top 8 hosts of PHISHING scans."""
    return bigints(rp.top_phishing_domains(_scans(spark, sf_dir)))


@register("scans_purged")
def q_scans_purged(spark, sf_dir):
    """M1 + M2: scan log after the false-positive and internal purges."""
    return bigints(mn.purge(_scans(spark, sf_dir)).select("id", "url", "result"))


@register("purge_report")
def q_purge_report(spark, sf_dir):
    """M3: rows removed per purge rule."""
    return mn.purge_report(_scans(spark, sf_dir))


@register("report_validation")
def q_report_validation(spark, sf_dir):
    """Validated report submissions (error NULL = accepted)."""
    v = sk.validate_reports(fixture(spark, sf_dir, "report_requests"))
    return bigints(v.select("id", "url", "label", "note", "used_in_verify", "error"))


@register("feedback_reports")
def q_feedback(spark, sf_dir):
    """Feedback submissions turned into reports."""
    r = fixture(spark, sf_dir, "report_requests").select(
        "id", "url", F.col("label").alias("correct_label"), "reported_label", "note", "timestamp")
    v = sk.feedback_reports(r)
    return bigints(v.select("id", "url", "label", "note", "error"))


# ---- J6, J7, J9, V4-V16, A6 ------------------------------------------------------------

from ..operators import enrich as en  # noqa: E402
from ..plans import scoring as sc  # noqa: E402

AS_OF_DATE = "2024-01-15"


def enrichment_for(spark, sf_dir) -> en.Enrichment:
    base = {"pages": read_table(spark, sf_dir, "pages")}
    fx = lambda n: fixture(spark, sf_dir, n, base)
    return en.Enrichment(
        whois=fx("whois"), certs=fx("certs"), dns_records=fx("dns_records"),
        resolutions=fx("resolutions"), ip_geo=fx("ip_geo"), ct_entries=fx("ct_entries"),
        redirects=fx("redirects"), pages=fx("page_html").select("url", "html"),
        reputation=fx("reputation").select("url", F.create_map(
            *[x for k in ("malicious", "suspicious", "harmless", "undetected") for x in (F.lit(k), F.col(k))]).alias("stats")),
        gsb_hits=fx("gsb_hits"))


def _feature_input(spark, sf_dir) -> DataFrame:
    """Corpus URLs plus raw page URLs (the enrichment tables know the latter);
    the latter's ids count down from -1, so the two never meet."""
    c = fixture(spark, sf_dir, "url_corpus").select(F.col("page_id").alias("id"), "url")
    p = fixture(spark, sf_dir, "page_html").select((-F.col("page_id") - F.lit(1)).alias("id"), "url")
    return c.unionByName(p)


def _enriched(spark, sf_dir) -> DataFrame:
    return fz.featurize(_feature_input(spark, sf_dir), "url", enrichment_for(spark, sf_dir), AS_OF_DATE)


@register("enriched_features")
def q_enriched_features(spark, sf_dir):
    """V16 with J9: all 43 features, network-backed ones from enrichment tables."""
    return bigints(_enriched(spark, sf_dir).select("id", "url", *feat.FEATURE_KEYS))


def _earlier(enr: en.Enrichment) -> tuple[en.Enrichment, en.Enrichment, en.Enrichment]:
    """The enrichment tables as they were: before the first update (a third of
    the keys not yet known, some facts older), between the updates, and the rows
    that differ between the latter and now."""
    from dataclasses import fields
    key = {"redirects": "url", "pages": "url", "reputation": "url", "gsb_hits": "url", "ip_geo": "ip", "ct_entries": "root"}
    part = lambda f: F.pmod(F.xxhash64(key.get(f, "domain")), F.lit(3))
    old = {"whois": ("created_at", F.date_sub("created_at", 400)), "certs": ("not_before", F.date_sub("not_before", 90)),
           "redirects": ("target", F.lit("https://moved.test/")), "pages": ("html", F.lit("<form action='http://x.test/'>")),
           "ip_geo": ("cc", F.lit("RU")), "dns_records": ("value", F.lit("v=spf1"))}
    first, second, differ = {}, {}, {}
    for f in (x.name for x in fields(enr)):
        df = getattr(enr, f)
        aged = df.withColumn(*old[f]) if f in old else df
        first[f] = aged.where(part(f) < 2)
        second[f] = aged.where(part(f) == 0).unionByName(df.where(part(f) == 1))
        differ[f] = df.where(part(f) != 1).unionByName(aged.where(part(f) == 0))
    return en.Enrichment(**first), en.Enrichment(**second), en.Enrichment(**differ)


@register("fact_store_features")
def q_fact_store_features(spark, sf_dir):
    """J9 from kept facts: a bucketed store built from earlier tables, updated
    twice by the rows that changed, gives all 43 features."""
    from dataclasses import fields
    from ..session import scratch_path
    from ..sources.facts import FactStore
    import uuid
    now = enrichment_for(spark, sf_dir)
    first, second, differ = _earlier(now)
    store = FactStore(spark, scratch_path(spark, f"facts-{uuid.uuid4().hex[:12]}"), buckets=8)
    store.build(first)
    part = lambda df, k: df.where(F.pmod(F.xxhash64(k), F.lit(3)) == 1)
    key = {"redirects": "url", "pages": "url", "reputation": "url", "gsb_hits": "url", "ip_geo": "ip", "ct_entries": "root"}
    both = {x.name: part(getattr(first, x.name), key.get(x.name, "domain")).unionByName(
        part(getattr(second, x.name), key.get(x.name, "domain"))) for x in fields(now)}
    store.update(second, en.Enrichment(**both))
    store.update(now, differ)
    f = fz.featurize(_feature_input(spark, sf_dir), "url", None, AS_OF_DATE, store=store)
    return bigints(f.select("id", "url", *feat.FEATURE_KEYS))


@register("reputation_enrich")
def q_reputation(spark, sf_dir):
    """J7 + J6: engine reputation verdict and safe-browsing flag per URL."""
    e = _enriched(spark, sf_dir)
    return bigints(e.select("id", "url", "vt_result", "vt_positives", "vt_total", "vt_ratio", "vt_prob", "gsb_flagged"))


def _ensemble(spark, sf_dir) -> DataFrame:
    e = vd.with_rule_verdict(_enriched(spark, sf_dir))
    ms = fixture(spark, sf_dir, "model_scores").select(F.col("page_id").alias("_mid"), "rf_prob", "nn_prob")
    e = e.join(ms, e["id"] == F.col("_mid"), "left").drop("_mid")
    return vd.with_ensemble(vd.with_model_inputs(e))


@register("ensemble_verdicts")
def q_ensemble(spark, sf_dir):
    """Model inputs, dynamic weights, votes, decision, risk, reasons."""
    v = _ensemble(spark, sf_dir)
    return bigints(v.select(
        "id", "url", "rule_score", "rf_result", "rf_confidence", "nn_result", "nn_confidence",
        "weighted_score", "votes", "result", "confidence", F.col("risk.level").alias("risk_level"),
        F.array_join("reason_codes", ",").alias("reasons")))


def scoring_inputs(spark, sf_dir) -> sc.ScoringInputs:
    fu, fdm = _feed_sets(spark, sf_dir)
    li = sc.ListInputs(static_allowlist=static_allowlist_for(spark),
                       dynamic_allowlist=_dynamic_allowlist(spark, sf_dir),
                       feed_urls=fu, feed_domains=fdm)
    ms = fixture(spark, sf_dir, "model_scores").select(F.col("page_id").alias("id"), "rf_prob", "nn_prob")
    return sc.ScoringInputs(lists=li, enrichment=enrichment_for(spark, sf_dir), model_scores=ms, as_of=AS_OF_DATE)


def scan_requests(spark, sf_dir) -> DataFrame:
    """Requests: corpus URLs and the scan-log URLs (internal pages included)."""
    c = fixture(spark, sf_dir, "url_corpus").select(F.col("page_id").alias("id"), "url")
    s = fixture(spark, sf_dir, "scans").select((-F.col("id") - F.lit(1)).alias("id"), "url")
    return c.unionByName(s).unionByName(_odd_requests(spark, sf_dir))


def routed(spark, sf_dir) -> DataFrame:
    return sc.score_requests(scan_requests(spark, sf_dir), scoring_inputs(spark, sf_dir))


@register("routed_verdicts")
def q_routed(spark, sf_dir):
    """V12 (T1 batch form): validation -> skip -> allow-lists -> blocklist -> scoring."""
    v = routed(spark, sf_dir)
    rt = F.col("route")
    return bigints(v.select(
        "id", "url", "route", F.col("final_result").alias("result"), F.col("final_confidence").alias("confidence"),
        "risk_level", "whitelist_source", "reasons",
        F.when(rt == "scored", F.col("weighted_score")).alias("weighted_score"),
        F.when(rt == "scored", F.col("votes")).alias("votes")))


def _result_cache(spark, sf_dir) -> DataFrame:
    """Results stored before the requests: two for every sixth page, one of
    them too old; some evicted by feedback."""
    p = fixture(spark, sf_dir, "page_html").where(F.pmod(F.col("page_id"), F.lit(6)) == 1)
    ages = F.explode(F.array(F.lit(100), F.lit(299), F.lit(300)))
    # a filter on the long normalisation expression would repeat it; written once first
    n = materialize(urls.with_normalized(p.select("page_id", "url"), "url", "n").select("page_id", "n"), "cached-pages")
    rows = n.select("page_id", "n", ages.alias("age"))
    rows = rows.where((F.col("age") != 100) | (F.pmod(F.col("page_id"), F.lit(4)) != 3))
    now = F.lit(AS_OF_TS).cast("timestamp")
    cache = rows.select(
        sc.cache_key(F.col("n")).alias("cache_key"),
        F.timestamp_micros(F.unix_micros(now) - F.col("age") * F.lit(1_000_000)).alias("stored_at"),
        F.concat(F.lit("R"), F.col("age").cast("string")).alias("result"), F.col("age").cast("int").alias("confidence"),
        F.lit("LOW").alias("risk_level"), F.lit("").alias("reasons"))
    return sc.evict(cache, p.where(F.pmod(F.col("page_id"), F.lit(5)) == 2).select("url"))


@register("cached_routes")
def q_cached_routes(spark, sf_dir):
    """V12 with stored results: precedence, TTL, newest result, eviction."""
    inp = scoring_inputs(spark, sf_dir)
    inp.cache, inp.now = _result_cache(spark, sf_dir), AS_OF_TS
    v = sc.score_requests(scan_requests(spark, sf_dir), inp)
    return bigints(v.select("id", "url", "route", F.col("final_result").alias("result"),
                            F.col("final_confidence").alias("confidence"), "risk_level"))


@register("model_scoring")
def q_model_scoring(spark, sf_dir):
    """V2 + V17: a forest fitted on the labelled corpus, saved to the registry,
    loaded again and used inside the scoring plan."""
    from pyspark.ml.classification import RandomForestClassifier
    from ..session import scratch_path
    import uuid
    base = ml.encode_labels(_labelled_corpus(spark, sf_dir), "label", positive_label="phishing")
    fit = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=20, maxDepth=6, seed=42)
    registry = scratch_path(spark, f"models-{uuid.uuid4().hex[:12]}")
    ml.save_model(fit.fit(ml.feature_vectors(base, "url")), f"{registry}/m1")
    sk.commit_version(spark, registry, "m1")
    inp = scoring_inputs(spark, sf_dir)
    inp.model_scores, inp.tree_model = None, ml.load_model(spark, registry)
    v = sc.score_requests(scan_requests(spark, sf_dir), inp)
    return bigints(v.where(F.col("route") == "scored").select("id", "url", "rf_prob", "rf_result", "final_result"))


@register("scan_log_rows")
def q_scan_log_rows(spark, sf_dir):
    """V13 + S11: the rows a scoring run appends to the scan log."""
    return bigints(sc.scan_log_rows(routed(spark, sf_dir)))


@register("scan_log_roundtrip")
def q_scan_log_roundtrip(spark, sf_dir):
    """S11 + A3: verdict rows appended to the date-partitioned scan log, read
    back, and the daily activity over what was read."""
    from ..session import scratch_path
    import uuid
    path = scratch_path(spark, f"scan-log-{uuid.uuid4().hex[:12]}")
    when = fixture(spark, sf_dir, "scans").select((-F.col("id") - F.lit(1)).alias("_tid"), "timestamp")
    v = routed(spark, sf_dir)
    v = v.join(when, v["id"] == F.col("_tid"), "left").drop("_tid").where(F.col("timestamp").isNotNull())
    sk.append_scans(sc.scan_log_rows(v), path)
    back = spark.read.parquet(path)
    return bigints(back.groupBy("date").agg(F.count(F.lit(1)).alias("scans"),
                                            F.count_if(F.col("result") == "PHISHING").alias("phishing")))


def _filled_log(spark, sf_dir):
    """A scan log of three batches, the reports refreshed before the last one,
    then compacted and refreshed again."""
    from ..session import scratch_path
    from ..sources.scan_log import ScanLog
    import uuid
    log = ScanLog(spark, scratch_path(spark, f"scan-log-{uuid.uuid4().hex[:12]}"), max_folders=2)
    s = _scans(spark, sf_dir)
    for k in range(3):
        if k == 2:
            log.refresh()
        log.append(s.where(F.pmod(F.col("id"), F.lit(3)) == k), f"batch-{k}")
    log.append(s, "batch-0")  # a batch that runs again adds nothing
    log.compact()
    log.refresh()
    return log


@register("scan_log_reports")
def q_scan_log_reports(spark, sf_dir):
    """S11 with A1, A2, A3, A7 and T6 from sums that are kept by date."""
    from ..sources import scan_log as sl
    p = _filled_log(spark, sf_dir).partials()
    none = F.lit(None).cast("bigint")
    row = lambda df, name, key, *v: df.select(
        F.lit(name).alias("report"), key.cast("string").alias("key"),
        *[(x if i < len(v) else none).cast("bigint").alias(f"n{i}") for i, x in enumerate([*map(F.col, v), *[none] * 4][:4])])
    none_key = F.lit(None)
    parts = [row(sl.totals(p), "totals", none_key, "total", "phishing", "suspicious", "safe"),
             row(sl.kpis(p), "kpis", none_key, "total", "phishing", "safe", "suspicious"),
             row(sl.daily(p), "daily", F.col("day"), "scans", "phishing"),
             row(sl.windows(p), "windows", F.date_format("window_end", "yyyy-MM-dd"), "scans", "phishing"),
             row(sl.top_domains(p), "domains", F.col("domain"), "cnt")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@register("scan_log_newest")
def q_scan_log_newest(spark, sf_dir):
    """A4 + A5 from a compacted log, opening the newest dates alone."""
    log = _filled_log(spark, sf_dir)
    return bigints(log.recent(50).withColumn("report", F.lit("recent")).unionByName(
        log.history(200).withColumn("report", F.lit("history"))))


@register("verdict_counters")
def q_counters(spark, sf_dir):
    """Service counters over the routed verdicts."""
    return bigints(sc.counters(routed(spark, sf_dir)))


@register("verdict_documents")
def q_documents(spark, sf_dir):
    """The fields of the nested verdict document of every request."""
    v = sc.verdict_document(routed(spark, sf_dir), gsb_known=True).select("id", "route", "verdict.*")
    return bigints(v.select(
        "id", "route", "result", "confidence", F.col("risk.level").alias("risk_level"), F.col("risk.color").alias("risk_color"),
        F.when(F.col("reasons").isNull(), F.lit(0)).otherwise(F.size("reasons")).cast("bigint").alias("n_reasons"), "source", F.col("models.random_forest").alias("rf"),
        F.col("models.lstm").alias("lstm"), F.col("models.virustotal").alias("vt"),
        F.col("models.google_safebrowsing").alias("gsb"), F.col("virustotal.positives").alias("positives"),
        F.col("virustotal.total").alias("total"), F.col("virustotal.vt_ratio").alias("vt_ratio"),
        F.col("new_signals.redirect_hops").alias("redirect_hops"), F.col("features.url_length").alias("url_length"),
        F.coalesce("whitelisted", F.lit(False)).alias("whitelisted"), "whitelist_source",
        F.coalesce("skipped", F.lit(False)).alias("skipped")))


# ---- S3, ML1, ML2, SET4, ML7, ML10, A15 ---------------------------------------------------

from ..operators import ml  # noqa: E402


def _labelled_corpus(spark, sf_dir) -> DataFrame:
    """url_corpus with a text label (phishing-like variants are 'phishing')."""
    c = fixture(spark, sf_dir, "url_corpus")
    lab = F.when(F.pmod(F.col("page_id"), F.lit(8)).isin(1, 2, 3, 4, 6), F.lit("phishing")).otherwise(F.lit("safe"))
    df = c.select("page_id", "url", lab.alias("label"))
    label_col, url_col = ml.resolve_columns(df.columns)  # S3 column discovery
    return df.select("page_id", F.col(url_col).alias("url"), F.col(label_col).alias("label"))


@register("labelled_corpus")
def q_labelled_corpus(spark, sf_dir):
    """S3 + ML1: labelled rows, alphabetical label index, explicit 0/1 target."""
    return bigints(ml.encode_labels(_labelled_corpus(spark, sf_dir), "label", positive_label="phishing")
                   .select("page_id", "url", "label", "label_index", "y"))


@register("train_test_split")
def q_split(spark, sf_dir):
    """ML2: deterministic hash split 80/20."""
    return bigints(ml.train_test_split(_labelled_corpus(spark, sf_dir)).select("page_id", "url", "bucket", "split"))


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    """ML2 + ML8: exact 80/20 split and five folds per class, by URL."""
    lab = ml.encode_labels(_labelled_corpus(spark, sf_dir), "label", positive_label="phishing").select("page_id", "url", "label", "y")
    return bigints(ml.stratified_folds(ml.stratified_split(lab)).select("page_id", "url", "label", "split", "fold"))


@register("class_distribution")
def q_class_distribution(spark, sf_dir):
    """Label histogram of the labelled corpus."""
    return rp.class_distribution(_labelled_corpus(spark, sf_dir))


def _training_union(spark, sf_dir):
    base = ml.encode_labels(_labelled_corpus(spark, sf_dir), "label", positive_label="phishing")
    return ml.training_union(base, cs.pending_training_rows(_verified_after(spark, sf_dir)))


@register("training_set")
def q_training_set(spark, sf_dir):
    """SET4: base rows plus each pending verified report five times."""
    return bigints(_training_union(spark, sf_dir))


@register("model_evaluation")
def q_model_evaluation(spark, sf_dir):
    """ML7: confusion counts and metrics of the tree-model scores."""
    lab = ml.encode_labels(_labelled_corpus(spark, sf_dir), "label", positive_label="phishing")
    ms = fixture(spark, sf_dir, "model_scores")
    pred = lab.join(ms, "page_id").withColumn("prediction", (F.col("rf_prob") > F.lit(0.5)).cast("int"))
    return bigints(ml.evaluation(pred))


@register("model_report")
def q_model_report(spark, sf_dir):
    """ML7: precision, recall, F1 and support per class, and weighted (class -1)."""
    lab = ml.encode_labels(_labelled_corpus(spark, sf_dir), "label", positive_label="phishing")
    ms = fixture(spark, sf_dir, "model_scores")
    pred = lab.join(ms, "page_id").withColumn("prediction", (F.col("rf_prob") > F.lit(0.5)).cast("int"))
    r = ml.per_class_report(pred)
    nine = lambda c: F.floor(F.col(c) * 1e9 + 0.5).cast("bigint").alias(c + "_e9")
    return bigints(r.select("class", "support", nine("precision"), nine("recall"), nine("f1")))


@register("cv_summary")
def q_cv_summary(spark, sf_dir):
    """ML8: accuracy per fold (hash buckets of the URL), mean and deviation."""
    lab = ml.encode_labels(_labelled_corpus(spark, sf_dir), "label", positive_label="phishing")
    ms = fixture(spark, sf_dir, "model_scores")
    pred = (lab.join(ms, "page_id").withColumn("prediction", (F.col("rf_prob") > F.lit(0.5)).cast("int"))
            .withColumn("fold", F.pmod(ml.split_bucket(F.col("url")), F.lit(5))))
    nine = lambda c: F.floor(F.col(c) * 1e9 + 0.5).cast("bigint").alias(c + "_e9")
    return bigints(ml.fold_summary(pred).select("fold", nine("accuracy"), nine("std")))


@register("model_gate")
def q_model_gate(spark, sf_dir):
    """ML9: the gate over the accuracies of the retrain log's runs."""
    log = fixture(spark, sf_dir, "retrain_log").where(F.col("accuracy") > 0)
    return bigints(log.select("id", "run_id", "accuracy", ml.gate_column(F.col("accuracy")).alias("gate")))


@register("retrain_run")
def q_retrain_run(spark, sf_dir):
    """ML9 + ML10: retrain on corpus + verified reports, gate on accuracy."""
    base = ml.encode_labels(_labelled_corpus(spark, sf_dir), "label", positive_label="phishing")
    r = ml.retrain(base, cs.pending_training_rows(_verified_after(spark, sf_dir)))
    return spark.createDataFrame([(r.status, float(r.accuracy), r.n_train, r.n_test, r.new_safe, r.new_phishing)],
                                 "status string, accuracy double, n_train bigint, n_test bigint, new_safe bigint, new_phishing bigint")


@register("retrain_log_rows")
def q_retrain_log_rows(spark, sf_dir):
    """S16 + S17 + ML10: the rows that a run of the retrain job logs (its gate
    open), with the verified URLs left to train on afterwards."""
    from ..session import scratch_path
    from ..streaming.consensus_state import ConsensusState
    import uuid
    base_path = scratch_path(spark, f"retrain-{uuid.uuid4().hex[:12]}")
    state = ConsensusState(spark, f"{base_path}/watcher", buckets=8)
    state.tick(_reports(spark, sf_dir), "v0", AS_OF_TS)
    base = ml.encode_labels(_labelled_corpus(spark, sf_dir), "label", positive_label="phishing")
    ml.run_retrain(spark, base, f"{base_path}/models", f"{base_path}/log", "r1", watcher=f"{base_path}/watcher", min_accuracy=0.0)
    log = spark.read.parquet(f"{base_path}/log").select("run_id", "seq", "new_safe", "new_phishing", "status")
    return bigints(log.withColumn("left_to_train", F.lit(state.totals()["pending"])))


# ---- T4, T5, T6 -------------------------------------------------------------------------------

from ..streaming import jobs as sj  # noqa: E402
from ..streaming import state as st  # noqa: E402


@register("throttle_decisions")
def q_throttle(spark, sf_dir):
    """T4 batch form: sliding-log throttle per user, 2 calls per 6 hours."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return st.throttle(ev, "user_id", "ts", limit=2, window_s=6 * 3600, tie="event_id").select("event_id", "user_id", "limited")


@register("cache_reuse")
def q_cache_reuse(spark, sf_dir):
    """T5 batch form: TTL result reuse per normalised URL over the scan log."""
    s = urls.with_normalized(fixture(spark, sf_dir, "scans").select("id", "url", "timestamp"), "url", "key")
    s = s.withColumn("skipped", urls.is_skipped(F.col("key")))
    # two branches filter on derived columns: write the table once first
    s = materialize(s.select("id", "key", "timestamp", "skipped"), "cache-requests")
    # skipped internal pages are answered before the cache and never stored
    folded = st.ttl_reuse(s.where(~F.col("skipped")).select("id", "key", "timestamp"), "key", "timestamp", tie="id")
    passed = s.where(F.col("skipped")).select("id", "key", F.lit(False).alias("cache_hit"))
    return folded.select("id", "key", "cache_hit").unionByName(passed)


@register("windowed_scan_activity")
def q_windowed_activity(spark, sf_dir):
    """T6 (batch form of the watermarked stream): scans per day window."""
    return bigints(sj.windowed_activity(_scans(spark, sf_dir)))


from ..sources import files as fl  # noqa: E402


@register("url_file_lines")
def q_url_file_lines(spark, sf_dir):
    """URL lines of an uploaded list (the raw feed lines used as file text)."""
    lines = fixture(spark, sf_dir, "feed_lines").select(F.col("line").alias("value"))
    return fl.url_lines(lines)


@register("batch_request_rows")
def q_batch_request_rows(spark, sf_dir):
    """URL batches written as JSON documents and read back, a row a URL."""
    from ..session import scratch_path
    import uuid
    path = scratch_path(spark, f"url-batches-{uuid.uuid4().hex[:12]}")
    pages = fixture(spark, sf_dir, "page_html").select("page_id", "url")
    docs = (pages.groupBy(F.floor(F.col("page_id") / 20).alias("b"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]).alias("urls")))
    docs.select("urls").write.json(path)
    rows = fl.read_batch_requests(spark, path, per_batch=15)
    return bigints(rows.select("pos", "url", "over_limit"))


@register("labelled_csv")
def q_labelled_csv(spark, sf_dir):
    """S3: the labelled corpus written as CSV with a header and read back with
    its columns found by name."""
    from ..session import scratch_path
    import uuid
    path = scratch_path(spark, f"labelled-{uuid.uuid4().hex[:12]}")
    c = _labelled_corpus(spark, sf_dir).select(F.col("label").alias("status"), F.col("url").alias("Url"), "page_id")
    c.write.option("header", True).csv(path)
    return ml.read_labelled_csv(spark, path)


@register("watcher_state")
def q_watcher_state(spark, sf_dir):
    """Two ticks of the report watcher (two thirds of the reports, then
    all), with the flags and verified URLs that each publishes."""
    from ..session import scratch_path
    import uuid
    root = scratch_path(spark, f"watcher-{uuid.uuid4().hex[:12]}")
    r = _reports(spark, sf_dir)
    sj.watcher_tick(spark, r.where(F.col("id") % 3 != 0), root, "v0", PRIOR_TS)
    sj.watcher_tick(spark, r, root, "v1", AS_OF_TS)
    verified, used = sj.watcher_state(spark, root)
    n = used.agg(F.count(F.lit(1)).alias("used_reports"))
    v = verified.select("url", "label", "report_count", "used_in_train",
                        F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at"))
    return bigints(v.withColumn("used_reports", F.lit(n.first()[0])))


@register("consensus_ticks")
def q_consensus_ticks(spark, sf_dir):
    """A9 + T3 by kept counts: two ticks, each of its own reports alone, the
    verified URLs and how many reports were used."""
    from ..session import scratch_path
    from ..streaming.consensus_state import ConsensusState
    import uuid
    state = ConsensusState(spark, scratch_path(spark, f"consensus-{uuid.uuid4().hex[:12]}"), buckets=8)
    r = _reports(spark, sf_dir)
    state.tick(r.where(F.col("id") % 3 != 0), "v0", PRIOR_TS, 0)
    state.tick(r.where(F.col("id") % 3 == 0), "v1", AS_OF_TS, 1)
    v = state.verified().select("url", "label", "report_count", "used_in_train",
                                F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at"))
    return bigints(v.withColumn("used_reports", F.lit(state.totals()["used"])))
