"""Training-data and model operators (S3, S4, SET4, ML1-ML10) on MLlib.

Feature extraction is the same native projection as scoring
(:func:`threatlens.operators.featurize.featurize`); the feature vector is
assembled with ``VectorAssembler`` in the fixed 43-column order.  Splits and
folds are hash buckets of the URL -- deterministic, no global sort or window,
and every copy of an oversampled row lands on the same side.
"""

from __future__ import annotations

import logging
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import lists
from ..session import materialize
from ..sources import sinks as sk
from ..sources.publish import latest, publish
from . import featurize as fz


FEATURES_OF_A_MODEL = 43

# ---- S3, S4 -------------------------------------------------------------------------

def first_present(columns, candidates, what: str) -> str:
    """The first candidate among the columns."""
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"none of the columns {', '.join(columns)} can be the {what} (looked for {', '.join(candidates)})")


def resolve_columns(columns, label_candidates=lists.LABEL_COLUMN_CANDIDATES,
                    url_candidates=lists.URL_COLUMN_CANDIDATES) -> tuple[str, str]:
    """S3: label and URL column names."""
    return first_present(columns, label_candidates, "label"), first_present(columns, url_candidates, "URL")


def labelled_frame(df: DataFrame) -> DataFrame:
    """S3 on a DataFrame: (url, label) with the label as text."""
    label, url = resolve_columns(df.columns)
    return df.select(F.col(url).cast("string").alias("url"), F.col(label).cast("string").alias("label"))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: labelled CSV with a header; the columns are discovered by name."""
    return labelled_frame(spark.read.option("header", True).csv(path))


# fixed values: the 10 safe and 12 phishing examples of the synthetic source
SYNTHETIC_SAFE = [
    "https://www.google.com/search?q=python",
    "https://github.com/torvalds/linux",
    "https://stackoverflow.com/questions/12345",
    "https://docs.python.org/3/library/os.html",
    "https://www.wikipedia.org/wiki/Machine_learning",
    "https://www.bbc.com/news/technology",
    "https://www.reddit.com/r/cybersecurity/",
    "https://www.microsoft.com/en-us/windows",
    "https://www.youtube.com/watch?v=abc123",
    "https://www.linkedin.com/in/username",
]
SYNTHETIC_PHISHING = [
    "http://192.168.1.1/login/paypal/verify?cmd=_login",
    "http://secure-paypal-login.tk/webscr?cmd=_login",
    "http://apple-id-verify.ml/account/confirm",
    "http://www.google.com.secure-login.xyz/signin",
    "http://192.168.0.1@malicious.com/banking",
    "http://paypal.com.account-verify.ga/login",
    "http://amazon-update-billing.click/account/signin",
    "http://microsoft-verify.tk/account/password",
    "http://asymptoticrelation.cfd/gateway/check.php",
    "http://ferdefor.vip/verify/identity",
    "http://secure-banking.cyou/login/confirm",
    "http://paypa1.com/signin/verify",
]


def synthetic_training_source(spark: SparkSession, n: int = 3000, seed: int = 42) -> DataFrame:
    """n/2 draws with replacement from each example list, labels 0/1,
    generated in parallel from ``spark.range`` (hash-based draws)."""
    half = n // 2
    ids = spark.range(2 * half)
    is_ph = F.col("id") >= half
    safe = F.array(*[F.lit(u) for u in SYNTHETIC_SAFE])
    ph = F.array(*[F.lit(u) for u in SYNTHETIC_PHISHING])
    k = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.when(is_ph, F.lit(len(SYNTHETIC_PHISHING))).otherwise(F.lit(len(SYNTHETIC_SAFE))))
    url = F.when(is_ph, F.element_at(ph, (k + 1).cast("int"))).otherwise(F.element_at(safe, (k + 1).cast("int")))
    return ids.select(url.alias("url"), is_ph.cast("int").alias("y"))


# ---- ML1, ML2, SET4 ---------------------------------------------------------------------

def encode_labels(df: DataFrame, label_col: str = "label", positive_label: str | None = None) -> DataFrame:
    """ML1: alphabetical label index (the reference's encoder) plus ``y``, the
    0/1 target; ``positive_label`` names class 1 explicitly (for labels
    'phishing'/'safe' the alphabetical index would make phishing 0)."""
    from pyspark.ml.feature import StringIndexer
    idx = StringIndexer(inputCol=label_col, outputCol="label_index", stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df)
    out = idx.transform(df).withColumn("label_index", F.col("label_index").cast("int"))
    if positive_label is not None:
        out = out.withColumn("y", (F.col(label_col) == F.lit(positive_label)).cast("int"))
    else:
        out = out.withColumn("y", F.col("label_index"))
    return out


def split_bucket(url: Column) -> Column:
    """Deterministic 0-99 bucket of a URL (first 32 bits of its MD5)."""
    return F.pmod(F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def train_test_split(df: DataFrame, test_pct: int = 20, url_col: str = "url") -> DataFrame:
    """ML2: adds ``bucket`` and ``split`` ('train' / 'test')."""
    b = split_bucket(F.col(url_col))
    return df.withColumn("bucket", b).withColumn(
        "split", F.when(F.col("bucket") < 100 - test_pct, F.lit("train")).otherwise(F.lit("test")))


HASH_BITS, STEP_BITS = 60, 15


def url_hash(url: Column) -> Column:
    """The first 60 bits of a URL's MD5, as a long."""
    return F.conv(F.substring(F.md5(url), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def class_thresholds(units: DataFrame, shares: list[float]) -> dict[str, list[int]]:
    """For each class of ``units(cls, h)``, distinct hashes, and each share the
    least hash up to which that share of the class lies (rounded half up to whole
    units; -1 for none of them).

    Selection by histograms: each pass counts the next ``STEP_BITS`` bits of the
    hashes that agree with a boundary so far, so four passes of at most 2**15
    counts a boundary find the exact unit, without a sort or a window."""
    sizes = {r["cls"]: r["n"] for r in units.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    # (class, share number): prefix found so far, units still to pass
    open_ = {(c, i): (0, math.floor(n * s + 0.5)) for c, n in sizes.items() for i, s in enumerate(shares)}
    done = {k: -1 for k, (_, rank) in open_.items() if rank == 0}
    for step in range(HASH_BITS // STEP_BITS):
        low = HASH_BITS - STEP_BITS * (step + 1)
        prefixes = {(c, prefix) for (c, i), (prefix, _) in open_.items() if (c, i) not in done}
        if not prefixes:
            break
        wanted = units.sparkSession.createDataFrame(sorted(prefixes, key=str), "cls string, p long")
        counts = (units.withColumn("q", F.shiftright("h", low)).withColumn("p", F.shiftright("q", STEP_BITS))
                  .join(F.broadcast(wanted), ["cls", "p"])  # a row a boundary
                  .groupBy("cls", "q").agg(F.count(F.lit(1)).alias("n")).collect())
        by: dict = {}
        for r in sorted(counts, key=lambda r: r["q"]):
            by.setdefault((r["cls"], r["q"] >> STEP_BITS), []).append((r["q"], r["n"]))
        for k, (prefix, rank) in open_.items():
            if k in done:
                continue
            for q, n in by[k[0], prefix]:
                if rank <= n:
                    open_[k] = (q, rank)
                    break
                rank -= n
    return {c: [done.get((c, i), open_[c, i][0]) for i in range(len(shares))] for c in sizes}


def stratified_parts(df: DataFrame, shares: list[float], url_col: str = "url", label_col: str = "y") -> DataFrame:
    """ML2, ML8: adds ``part``, from 0 to the number of ``shares``: ascending
    boundaries of the URLs of each class by their hash, exact to one URL.  All
    rows of a URL get one part; its class is the largest of their labels (as
    text).  Rows without a URL get the last part, those without a label are a class."""
    label = F.coalesce(F.col(label_col).cast("string"), F.lit(""))
    url = F.col(url_col)
    units = df.where(url.isNotNull()).groupBy(url_hash(url).alias("h")).agg(F.max(label).alias("cls"))
    units = materialize(units, "split-units")
    bounds = class_thresholds(units, shares)
    if not bounds:
        return df.withColumn("part", F.lit(len(shares)))
    part = F.lit(None).cast("int")
    for c, edges in bounds.items():
        which = F.lit(len(shares))
        for i in reversed(range(len(shares))):
            which = F.when(F.col("h") <= edges[i], i).otherwise(which)
        part = F.when(F.col("cls") == c, which).otherwise(part)
    placed = units.select(F.col("h").alias("_h"), part.alias("part"))
    out = df.withColumn("_k", url_hash(url)).join(placed, F.col("_k") == F.col("_h"), "left").drop("_k", "_h")
    return out.withColumn("part", F.coalesce("part", F.lit(len(shares))))


def stratified_split(df: DataFrame, test_share: float = 0.2, url_col: str = "url", label_col: str = "y") -> DataFrame:
    """ML2: adds ``split`` ('train' / 'test'), exact per class to one URL."""
    parts = stratified_parts(df, [1 - test_share], url_col, label_col)
    return parts.withColumn("split", F.when(F.col("part") == 0, F.lit("train")).otherwise(F.lit("test"))).drop("part")


def stratified_folds(df: DataFrame, folds: int = 5, url_col: str = "url", label_col: str = "y") -> DataFrame:
    """ML8: adds ``fold``, 0 to ``folds`` - 1, equal per class to one URL."""
    parts = stratified_parts(df, [k / folds for k in range(1, folds)], url_col, label_col)
    return parts.withColumnRenamed("part", "fold")


def training_union(base: DataFrame, verified: DataFrame, copies: int = lists.REPORT_COPIES) -> DataFrame:
    """SET4: base rows plus every verified report repeated ``copies`` times
    (label 'safe' -> 0, anything else -> 1)."""
    b = base.select("url", F.col("y").cast("int").alias("y"), F.lit("base").alias("source"), F.lit(1).alias("copy"))
    v = verified.select("url", F.when(F.lower(F.col("label")) == "safe", F.lit(0)).otherwise(F.lit(1)).alias("y"),
                        F.lit("verified").alias("source"),
                        F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    return b.unionByName(v)


# ---- vectors and models -----------------------------------------------------------------

def assembled(f: DataFrame) -> DataFrame:
    """``features`` (43 doubles in fixed order) of featurised rows.  The
    safe-browsing slot is 0 at model time, as in scoring."""
    from pyspark.ml.feature import VectorAssembler
    names = [f"_f_{k}" for k in feat.FEATURE_KEYS]
    if len(names) != FEATURES_OF_A_MODEL:
        raise ValueError(f"{len(names)} features, a model takes {FEATURES_OF_A_MODEL}")
    values = [(F.lit(False) if k == "gsb_flagged" else F.col(k)).cast("double").alias(n)
              for k, n in zip(feat.FEATURE_KEYS, names)]
    return VectorAssembler(inputCols=names, outputCol="features").transform(f.select("*", *values)).drop(*names)


def feature_vectors(df: DataFrame, url_col: str = "url", enrichment=None, as_of=None) -> DataFrame:
    """Features -> ``features`` vector."""
    return assembled(fz.featurize(df, url_col, enrichment, as_of))


def with_model_probability(f: DataFrame, model, name: str) -> DataFrame:
    """V2/V3: the model's class-1 probability of featurised rows as ``name``."""
    from pyspark.ml.functions import vector_to_array
    p = model.transform(assembled(f)).withColumn(name, vector_to_array(F.col("probability"))[1])
    return p.select(*f.columns, name)


def tree_classifier(kind: str = "forest", seed: int = 42):
    """ML3 / ML4.  'boosted' mirrors the preferred boosted-tree settings,
    'forest' the fallback forest (the path taken when no boosted-tree
    library is installed)."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    if kind == "boosted":
        return GBTClassifier(labelCol="y", featuresCol="features", maxIter=300, maxDepth=8, stepSize=0.05,
                             subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=200, maxDepth=15,
                                  minInstancesPerNode=2, seed=seed)


def neural_classifier(seed: int = 42):
    """ML5 + ML6: standardise then a feed-forward net 43-64-128-64-32-2."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    sc = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    mlp = MultilayerPerceptronClassifier(labelCol="y", featuresCol="scaled", layers=[43, 64, 128, 64, 32, 2],
                                         maxIter=60, blockSize=32, seed=seed)
    return Pipeline(stages=[sc, mlp])


def with_probability(pred: DataFrame) -> DataFrame:
    """V2/V3 outputs: class, truncated confidence, class-1 probability."""
    from pyspark.ml.functions import vector_to_array
    p = vector_to_array(F.col("probability"))
    return (pred.withColumn("p1", p[1])
                .withColumn("model_result", F.when(F.col("prediction") == 1, F.lit("PHISHING")).otherwise(F.lit("SAFE")))
                .withColumn("model_confidence", (F.greatest(p[0], p[1]) * F.lit(100.0)).cast("int")))


def evaluation(pred: DataFrame, label_col: str = "y", pred_col: str = "prediction") -> DataFrame:
    """ML7: one row -- confusion counts, accuracy, precision, recall, F1
    (binary, positive class 1; 0 where undefined)."""
    y, p = F.col(label_col).cast("int"), F.col(pred_col).cast("int")
    c = pred.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return c.select("tp", "fp", "tn", "fn",
                    F.when(n > 0, (tp + tn) / n).otherwise(F.lit(0.0)).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"))


def per_class_report(pred: DataFrame, label_col: str = "y", pred_col: str = "prediction") -> DataFrame:
    """ML7: precision, recall, F1 and support of each class and, as ``class``
    -1, their averages weighted by support (0 where undefined)."""
    y, p = F.col(label_col).cast("int"), F.col(pred_col).cast("int")
    pairs = pred.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("is"), F.lit(0).cast("long").alias("said"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("right")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("is"), F.col("n").alias("said"),
                 F.lit(0).cast("long").alias("right")))).alias("e")).select("e.*")
    c = both.groupBy("class").agg(F.sum("is").alias("support"), F.sum("said").alias("said"), F.sum("right").alias("right"))
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    c = c.select("class", "support", ratio(F.col("right"), F.col("said")).alias("precision"),
                 ratio(F.col("right"), F.col("support")).alias("recall"))
    pr = F.col("precision") + F.col("recall")
    c = c.withColumn("f1", F.when(pr > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / pr).otherwise(F.lit(0.0)))
    mean = lambda k: ratio(F.sum(F.col(k) * F.col("support")), F.sum("support")).alias(k)
    whole = c.agg(F.lit(-1).alias("class"), F.sum("support").alias("support"), mean("precision"), mean("recall"), mean("f1"))
    return c.unionByName(whole)


def fold_summary(pred: DataFrame, fold: str = "fold", label_col: str = "y", pred_col: str = "prediction") -> DataFrame:
    """ML8 from given predictions: accuracy per fold and, as fold -1, their
    mean, each with the population standard deviation over the folds."""
    ok = (F.col(label_col).cast("int") == F.col(pred_col).cast("int")).cast("int")
    per = pred.groupBy(F.col(fold).cast("int").alias("fold")).agg(
        (F.sum(ok).cast("double") / F.count(F.lit(1))).alias("accuracy"))
    whole = per.agg(F.avg("accuracy").alias("accuracy"), F.coalesce(F.stddev_pop("accuracy"), F.lit(0.0)).alias("std"))
    rows = per.withColumn("std", F.lit(None).cast("double"))
    return rows.unionByName(whole.select(F.lit(-1).alias("fold"), "accuracy", "std"))


def cross_validate(train: DataFrame, estimator, folds: int = 5) -> list[float]:
    """ML8: accuracy per fold; the folds are stratified."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    ev = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    t = stratified_folds(train, folds).withColumnRenamed("fold", "_fold")
    out = []
    for k in range(folds):
        m = estimator.fit(t.where(F.col("_fold") != k))
        out.append(ev.evaluate(m.transform(t.where(F.col("_fold") == k))))
    return out


@dataclass
class RetrainResult:
    status: str
    accuracy: float
    n_train: int
    n_test: int
    new_safe: int
    new_phishing: int
    model: object = None


def retrain(base: DataFrame, verified: DataFrame, min_accuracy: float = lists.MIN_ACCURACY_TO_REPLACE,
            kind: str = "forest", enrichment=None, as_of=None) -> RetrainResult:
    """ML9 + ML10: base rows + 5x verified rows -> features -> stratified split ->
    fit -> accuracy gate.  ``status`` is 'done' (accepted) or
    'rejected_low_accuracy'; 'failed' when there is no data."""
    data = training_union(base, verified)
    counts = verified.agg(F.count_if(F.lower(F.col("label")) == "safe").alias("s"),
                          F.count_if(F.lower(F.col("label")) != "safe").alias("p")).first()
    vec = stratified_split(feature_vectors(data, "url", enrichment, as_of)).select("url", "y", "features", "split")
    # the vectors feed two counts, the fit and the evaluation: written once
    vec = materialize(vec, "training-vectors")
    sizes = {r["split"]: r["count"] for r in vec.groupBy("split").count().collect()}
    n_train, n_test = sizes.get("train", 0), sizes.get("test", 0)
    if n_train == 0:
        return RetrainResult("failed", 0.0, 0, n_test, counts["s"], counts["p"])
    train, test = vec.where(F.col("split") == "train"), vec.where(F.col("split") == "test")
    model = tree_classifier(kind).fit(train)
    acc = evaluation(model.transform(test)).first()["accuracy"] if n_test else 0.0
    return RetrainResult(gate(acc, min_accuracy), round(float(acc), 4), n_train, n_test, counts["s"], counts["p"], model)


def gate(accuracy: float, least: float = lists.MIN_ACCURACY_TO_REPLACE) -> str:
    """ML9: whether a fitted model replaces the current one."""
    return "done" if accuracy >= least else "rejected_low_accuracy"


def gate_column(accuracy: Column, least: float = lists.MIN_ACCURACY_TO_REPLACE) -> Column:
    return F.when(accuracy >= least, F.lit("done")).otherwise(F.lit("rejected_low_accuracy"))


def save_model(model, path: str) -> None:
    """Versioned model folder (write, never overwrite in place)."""
    model.write().save(path)


def load_model(spark: SparkSession, registry: str, loader=None):
    """The registry's current model, or None before the first; a model of
    another width than the 43 features is refused."""
    from pyspark.ml.classification import RandomForestClassificationModel

    now = latest(spark, registry)
    if now is None:
        return None
    model = (loader or RandomForestClassificationModel.load)(f"{registry}/{now.data.get('folder', now.version)}")
    if model.numFeatures != FEATURES_OF_A_MODEL:
        raise ValueError(f"the model has {model.numFeatures} features, scoring gives {FEATURES_OF_A_MODEL}")
    return model


def run_retrain(spark: SparkSession, base: DataFrame, registry: str, log: str, run_id: str,
                watcher: str | None = None, verified: DataFrame | None = None, **kw) -> RetrainResult:
    """ML10 as a state machine: a running row, the fit, the gate; an accepted
    model is written under its own version and published last, then its URLs are
    marked as trained.  A rejected or failed run leaves the published version as
    it was; the log's last row of the run says which it was."""
    from ..operators import consensus as cs
    from ..streaming import jobs

    if verified is None:
        verified = cs.pending_training_rows(jobs.verified_urls(spark, watcher))
    sk.append_retrain_event(spark, log, run_id, 0, "running")
    try:
        r = retrain(base, verified, **kw)
        if r.status == "done":
            # a folder of its own for each attempt, so a run that died after saving can run again
            attempt = f"{run_id}-{uuid.uuid4().hex[:8]}"
            save_model(r.model, f"{registry}/{attempt}")
            publish(spark, registry, run_id, {"folder": attempt})
            if watcher is not None:
                jobs.mark_trained(spark, watcher, verified, f"{run_id}-trained")
    except Exception as e:
        sk.append_retrain_event(spark, log, run_id, 1, "failed")
        logging.getLogger(__name__).warning("retrain %s failed: %s", run_id, e, exc_info=True)
        return RetrainResult("failed", 0.0, 0, 0, 0, 0)
    sk.append_retrain_event(spark, log, run_id, 1, r.status, r.new_safe, r.new_phishing, r.accuracy)
    return r
