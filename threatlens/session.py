"""Spark session helpers.

Every operator in the package is a ``DataFrame -> DataFrame`` function; this
module only builds a session with the settings the operators assume (UTC,
AQE with skew handling) and resolves the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Joins against data-derived tables (feeds, hosts, enrichment) are left to AQE:
# it measures the finished shuffle stage and switches to a broadcast hash join
# only when that measured side is below this bound.  Fixed-size reference lists
# are broadcast explicitly.
AQE_BROADCAST_BYTES = str(64 * 1024 * 1024)


def build_session(app_name: str = "threatlens", cpus: int | str = "*",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local or cluster session with the package defaults.

    On a cluster the master and memory come from spark-submit; only the
    SQL settings below are applied.
    """
    b = SparkSession.builder.appName(app_name)
    if not os.environ.get("SPARK_MASTER_URL") and not os.environ.get("MASTER"):
        b = b.master(f"local[{cpus}]")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": AQE_BROADCAST_BYTES,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("THREATLENS_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared filesystem).
    Only when it is unset -- local tests -- a private scratch folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster "
                               "(materialised tables and checkpoints are read back by other executors)")
        path = tempfile.mkdtemp(prefix="threatlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written snapshots."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back.

    Used where one expensive intermediate (e.g. the featurised URL table)
    feeds several branches: it is computed once instead of once per branch,
    the lineage is cut (a lost executor re-reads files instead of recomputing
    the chain), and the optimizer no longer pushes filters into -- and
    expands -- the expressions that produced it.
    """
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
