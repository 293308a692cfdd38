"""Kept URL, host and root-domain facts (J9), bucketed and sorted by key.

Scoring joins requests to facts about URLs and hosts.  Building those facts from
the sources reads the whole crawl; this store keeps them as tables bucketed by
key, so that a lookup shuffles only the asked keys, or opens only the buckets of
a few keys.  Each kind has a base and a small delta:

* an update names the source rows that changed; only the facts of their keys are
  made again, from the current sources cut to these keys, and go to the delta
  (a key that has no facts any more is kept there as gone);
* a delta over ``MERGE_SHARE`` of the base is merged into a new base, bucket by
  bucket.

What is current is one commit (:mod:`threatlens.sources.publish`); two updates at
once cannot both win, and the loser starts again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as en
from ..operators.reduction import Keys, asked, reduced
from ..session import materialize
from . import publish as pb

KEY = {"url": "url", "host": "domain", "root": "root"}
MERGE_SHARE = 0.1
#: Asked keys up to this number are written into the filter, which selects buckets.
LITERAL_KEYS = 500


def _facts(kind: str, enr: en.Enrichment) -> DataFrame | None:
    return {"url": en.url_facts, "host": en.host_fact_rows, "root": en.root_fact_rows}[kind](enr)


def changed_keys(kind: str, now: en.Enrichment, changed: en.Enrichment) -> DataFrame | None:
    """Keys (column ``key``) of a kind whose facts the changed rows may alter; a
    changed address also alters the hosts that resolve to it."""
    sources = {"url": [changed.redirects, changed.pages, changed.reputation, changed.gsb_hits],
               "host": [changed.whois, changed.certs, changed.dns_records, changed.resolutions],
               "root": [changed.ct_entries]}[kind]
    parts = [s.select(F.col(KEY[kind]).alias("key")) for s in sources if s is not None]
    if kind == "host" and changed.ip_geo is not None and now.resolutions is not None:
        parts.append(now.resolutions.join(changed.ip_geo.select("ip").distinct(), "ip", "left_semi").select(
            F.col("domain").alias("key")))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("key is not null").distinct()


class FactStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ---- tables ----------------------------------------------------------------

    def _write(self, kind: str, df: DataFrame, placed: bool = False) -> dict:
        """A bucketed table: its entry in the commit.  ``placed``: each of the
        frame's partitions lies within one bucket already."""
        key, n = KEY[kind], self.buckets
        name = f"facts_{kind}_{uuid.uuid4().hex[:16]}"
        path = f"{self.root}/{kind}/{name}"
        df = df if placed else df.repartition(n, key)
        (df.write.bucketBy(n, key).sortBy(key).option("path", path)
         .format("parquet").saveAsTable(name))
        table = self.spark.table(name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        return {"name": name, "path": path, "columns": columns, "buckets": n, "rows": table.count()}

    def _table(self, kind: str, entry: dict) -> DataFrame:
        """The table of an entry; a session that did not write it declares it."""
        if not self.spark.catalog.tableExists(entry["name"]):
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {entry['name']} ({entry['columns']}) USING parquet "
                           f"CLUSTERED BY ({KEY[kind]}) SORTED BY ({KEY[kind]}) INTO {entry['buckets']} BUCKETS "
                           f"LOCATION '{entry['path']}'")
        return self.spark.table(entry["name"])

    def current(self) -> pb.Commit | None:
        return pb.latest(self.spark, self.root)

    # ---- build and update ----------------------------------------------------------

    def build(self, enr: en.Enrichment) -> pb.Commit:
        """All facts from the sources, published as new bases."""
        def change():
            before = self.current()
            data = {}
            for kind in KEY:
                facts = _facts(kind, enr)
                if facts is not None:
                    data[kind] = {"base": self._write(kind, facts), "delta": None}
            return pb.publish(self.spark, self.root, uuid.uuid4().hex, data, after=before)
        return pb.retried(change)

    def update(self, now: en.Enrichment, changed: en.Enrichment) -> pb.Commit:
        """``now``: the sources as they are; ``changed``: the rows that were added
        or altered, and those that were removed, as they were."""
        def change():
            before = self.current()
            data = dict(before.data)
            for kind in data:
                keys = changed_keys(kind, now, changed)
                if keys is not None:
                    data[kind] = self._updated(kind, data[kind], now, materialize(keys, f"changed-{kind}"))
            return pb.publish(self.spark, self.root, uuid.uuid4().hex, data, after=before)
        return pb.retried(change)

    def _updated(self, kind: str, entry: dict, now: en.Enrichment, keys: DataFrame) -> dict:
        key = KEY[kind]
        k = asked(keys, key=F.col("key"))["key"]
        if not k.n:
            return entry
        none = Keys(keys.limit(0), 0, 0)
        cut = en.reduce_enrichment(now, **{x: k if x == f"{kind}s" else none for x in ("urls", "hosts", "roots")})
        base = self._table(kind, entry["base"])
        fresh = _facts(kind, cut).withColumn("_here", F.lit(True))
        made = keys.withColumnRenamed("key", key).join(fresh, key, "left")
        made = made.withColumn("gone", F.col("_here").isNull()).drop("_here").select(*base.columns, "gone")
        if entry["delta"]:
            old = self._table(kind, entry["delta"])
            made = made.unionByName(old.join(keys, F.col(key) == F.col("key"), "left_anti"))
        delta = self._write(kind, made)
        if delta["rows"] <= MERGE_SHARE * entry["base"]["rows"]:
            return {"base": entry["base"], "delta": delta}
        newer = self._table(kind, delta)
        kept = base.join(newer.select(key).hint("merge"), key, "left_anti")  # bucket by bucket
        return {"base": self._write(kind, kept.unionByName(newer.where("not gone").drop("gone")), placed=True), "delta": None}

    # ---- lookups ---------------------------------------------------------------------

    def lookup(self, kind: str, keys: Keys) -> DataFrame | None:
        """The facts of the asked keys, a row a key that has any."""
        commit = self.current()
        entry = commit.data.get(kind) if commit else None
        if entry is None:
            return None
        key = KEY[kind]
        base = self._table(kind, entry["base"])
        delta = self._table(kind, entry["delta"]) if entry["delta"] else None
        if keys.n <= LITERAL_KEYS:
            values = [r["key"] for r in keys.df.collect()]  # at most LITERAL_KEYS
            few = F.col(key).isin(values)
            base = base.where(few)
            if delta is None:
                return base
            delta = delta.where(few)
            return base.join(delta.select(key), key, "left_anti").unionByName(delta.where("not gone").drop("gone"))
        facts = [c for c in base.columns if c != key]
        # the asked keys come to the buckets; else Spark may choose their partitioning for the facts
        out = keys.df.withColumnRenamed("key", key).repartition(entry["base"]["buckets"], key).join(
            base.select(key, F.struct(*facts).alias("_b")), key, "left")
        if delta is not None:
            out = out.join(delta.select(key, F.col("gone").alias("_gone"), F.struct(*facts).alias("_d")), key, "left")
            out = out.withColumn("_b", F.when(F.col("_gone").isNull(), F.col("_b")).when(~F.col("_gone"), F.col("_d")))
        return out.where("_b is not null").select(key, "_b.*")
