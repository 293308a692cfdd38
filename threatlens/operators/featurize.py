"""Featurise a URL table (section 2.3, V16).

One narrow projection: every lexical feature is a native expression over the
row's own URL, so the job needs no shuffle and scales with the input split
count.  The network-backed group comes from enrichment tables joined in by
:mod:`threatlens.operators.enrich`; without them the columns get the values
used when nothing is known about a host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import urls




def lexical_features(df: DataFrame, url_col: str = "url", keep_host: bool = True) -> DataFrame:
    """Adds the 25 URL-only feature columns (plus ``host``), as a few staged
    projections over the split URL."""
    staged = urls.with_split(df, url_col, "_u")
    staged = staged.withColumn("host", urls.host_of_netloc(F.col("_u_netloc")))
    out = feat.with_lexical_features(staged, url_col, "_u_scheme", "_u_path", "_u_query", "host")
    out = out.drop(*urls.split_cols("_u"))
    order = [c for c in df.columns] + ["host"] + list(feat.lexical_feature_names())
    out = out.select(*order)
    return out if keep_host else out.drop("host")


def url_level_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``host`` plus the 11 URL-level features and ``_path_kw``; the 13
    host-only features and the exemption flag come from a host table
    (:func:`threatlens.functions.features.host_feature_table`), joined later
    by :func:`finish_path_keyword`."""
    staged = urls.with_split(df, url_col, "_u")
    staged = staged.withColumn("host", urls.host_of_netloc(F.col("_u_netloc")))
    out = feat.with_url_features(staged, url_col, "_u_scheme", "_u_path", "_u_query", exempt=None)
    return out.drop(*urls.split_cols("_u"))


def finish_path_keyword(df: DataFrame) -> DataFrame:
    """path_login_keyword = path keyword and host not exempt (after the join)."""
    return (df.withColumn("path_login_keyword", F.col("_path_kw") & ~F.coalesce(F.col("_path_exempt"), F.lit(False)))
              .drop("_path_kw", "_path_exempt"))


def with_deep_defaults(df: DataFrame) -> DataFrame:
    """Fills any missing network-backed feature with its 'unknown' value."""
    add = [F.lit(v).alias(k) for k, v in feat.DEEP_DEFAULTS.items() if k not in df.columns]
    return df.select("*", *add) if add else df


def featurize(df: DataFrame, url_col: str = "url", enrichment=None, as_of=None, store=None) -> DataFrame:
    """All 43 features.  ``enrichment`` is an
    :class:`threatlens.operators.enrich.Enrichment`, ``store`` a kept
    :class:`threatlens.sources.facts.FactStore`; neither means defaults."""
    if enrichment is None and store is None:
        return with_deep_defaults(lexical_features(df, url_col))
    # with enrichment the rows meet a host table anyway: host-only features
    # are computed there once per distinct host; the URL-level table feeds
    # both sides, so it is written once
    from ..session import materialize
    from .enrich import enrich_features
    u = materialize(url_level_features(df, url_col), "featurize-urls")
    hosts = feat.host_feature_table(u, "host")
    out = enrich_features(u, enrichment, url_col=url_col, as_of=as_of, extra_host_flags=hosts, store=store)
    order = list(df.columns) + ["host"] + [k for k in feat.FEATURE_KEYS]
    out = with_deep_defaults(finish_path_keyword(out))
    return out.select(*order, *[c for c in out.columns if c not in order])


def feature_table(df: DataFrame, url_col: str = "url", key_cols=(), enrichment=None,
                  as_of=None) -> DataFrame:
    """V16 feature dump: keys, url and the 43 features in vector order."""
    f = featurize(df, url_col, enrichment, as_of)
    return f.select(*key_cols, url_col, *feat.FEATURE_KEYS)
