"""Model training, prediction and model-level utilities.

MLlib estimators do the distributed fitting (tree aggregation over partitions); the few
algorithms MLlib lacks are written as DataFrame jobs:
  * Lloyd step of k-means in plain SQL terms (centres broadcast: k rows).
  * isolation forest: trees are grown on hash-selected samples of <= 256 rows each
    (one applyInPandas group per tree), then broadcast and applied with mapInPandas.
  * self-training: an iterative fit / pseudo-label loop with a reliable checkpoint per round.
Signature: op(df, features, label=None, key, **params) -> (model, predictions).
"""

from __future__ import annotations

import math
import sys
import time
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, GaussianMixtureModel, KMeans
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepline.functions.exprs import attach_one_row, lehmer, null_safe_join
from prepline.session import cut_in_place, cut_lineage, cut_round

# ---- fixed values: default parameters per model name ----
DEFAULT_PARAMS = {
    "Random Forest": {"numTrees": 100, "maxDepth": 8},
    "Random Forest Regressor": {"numTrees": 100, "maxDepth": 8},
    "Logistic Regression": {"maxIter": 100, "regParam": 0.0},
    "Linear Regression": {"solver": "normal", "regParam": 0.0},
    "Gradient Boosting": {"maxIter": 50, "maxDepth": 5},
    "K-Means": {"k": 8, "maxIter": 20},
}
ISOLATION_SAMPLE = 256
EULER_GAMMA = 0.5772156649
# ---- end of fixed values ----


def assemble(df: DataFrame, features: Sequence[str], out: str = "features", invalid: str = "keep") -> DataFrame:
    """Numeric feature columns -> one vector column (NULL/NaN kept as NaN by default)."""
    cols = [F.col(c).cast("double").alias(c) for c in features]
    slim = df.select("*") if not features else df.withColumns({c: col for c, col in zip(features, cols, strict=True)})
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid=invalid).transform(slim)


def complete(df: DataFrame, features: Sequence[str]):
    """Whether a row has all features (none NULL or NaN). Whole numbers are not asked for NaN: the filter
    goes down to the files, and there a feature counted from a text would be counted again for it."""
    kinds = dict(df.dtypes)
    ok = F.lit(True)
    for c in features:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull()
        if kinds.get(c) not in ("tinyint", "smallint", "int", "bigint"):
            ok = ok & ~F.isnan(v)
    return F.coalesce(ok, F.lit(False))


def predict_all(transform, df: DataFrame, features: Sequence[str], keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keep`` and the predicted ``columns`` of every row of ``df``: rows with a missing feature are not
    shown to the model and have NULL there."""
    ok = complete(df, features)
    known = transform(df.where(ok))
    known = known.select(*keep, *columns)
    rest = df.where(~ok).select(*keep, *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in columns])
    return known.unionByName(rest)


def slim(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``keep`` and the features as doubles, computed once and written to the checkpoint folder."""
    casted = df.withColumns({c: F.col(c).cast("double") for c in features})
    return cut_lineage(casted.select(*dict.fromkeys([*keep, *features])))


def _fit_predict(est, df: DataFrame, features: Sequence[str], keep: Sequence[str]):
    """Fit on the rows with all features and a label, predict every row (:func:`predict_all`)."""
    label = keep[-1]
    model = est.fit(assemble(df.where(complete(df, features) & F.col(label).isNotNull()), features))

    def transform(rows: DataFrame) -> DataFrame:
        out = model.transform(assemble(rows, features))
        return out.withColumn("probability", vector_to_array("probability")) if "probability" in out.columns else out

    columns = ["prediction", "probability"] if "probability" in transform(df.limit(0)).columns else ["prediction"]
    return model, predict_all(transform, df, features, keep, columns)


# ------------------------------------------------------------------ T3-T7, T17

def linear_regression(df, features, label, key, **params):
    """Ordinary least squares (normal equations, one tree-aggregated pass)."""
    est = LinearRegression(featuresCol="features", labelCol=label, solver=params.pop("solver", "normal"), **params)
    return _fit_predict(est, df, features, [*key, label])


def logistic_regression(df, features, label, key, **params):
    """T4: logistic regression (MLlib regParam defaults to 0: no penalty, unlike scikit-learn)."""
    est = LogisticRegression(featuresCol="features", labelCol=label, **params)
    return _fit_predict(est, df, features, [*key, label])


def random_forest(df, features, label, key, task="classification", seed=42, **params):
    """T5: random forest classifier / regressor (seeded)."""
    cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
    est = cls(featuresCol="features", labelCol=label, seed=seed, **params)
    return _fit_predict(est, df, features, [*key, label])


def gradient_boosting(df, features, label, key, task="classification", n_classes=2, seed=42, **params):
    """GBT; binary directly, multi-class one-vs-rest."""
    if task == "regression":
        est = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, **params)
    elif n_classes <= 2:
        est = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **params)
    else:
        est = OneVsRest(classifier=GBTClassifier(seed=seed, **params), featuresCol="features", labelCol=label)
    return _fit_predict(est, df, features, [*key, label])


def linear_svm(df, features, label, key, **params):
    """Linear SVM (hinge loss, OWLQN)."""
    est = LinearSVC(featuresCol="features", labelCol=label, **params)
    return _fit_predict(est, df, features, [*key, label])


def mlp(df, features, label, key, hidden=(8,), n_classes=2, seed=42, **params):
    """Multilayer perceptron classifier."""
    layers = [len(features), *hidden, n_classes]
    est = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers, seed=seed, **params)
    return _fit_predict(est, df, features, [*key, label])


# ------------------------------------------------------------------ T8, T10, T11 unsupervised

def kmeans(df, vector_col, key, k=8, seed=42, **params):
    """K-means|| initialisation + Lloyd iterations (MLlib)."""
    data = df.withColumn("features", array_to_vector(F.col(vector_col)))
    model = KMeans(featuresCol="features", k=k, seed=seed, **params).fit(data)
    return model, model.transform(data).select(*key, F.col("prediction").alias("cluster"))


def lloyd_step(points: DataFrame, key: str, vector_col: str, centers: DataFrame) -> DataFrame:
    """T8 step in plain DataFrame terms: assign each point to the nearest centre (squared
    Euclidean, ties to the lowest centre id), new centre = mean of its points; a centre with no
    points keeps its position. ``centers``: (center_id, center array) -- k rows, broadcast."""
    cl = centers.agg(F.array_sort(F.collect_list(F.struct("center_id", "center"))).alias("__c"))
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    j = attach_one_row(points.select(key, x.alias("__x")), cl)
    d = F.transform(
        F.col("__c"),
        lambda c: F.struct(
            F.aggregate(F.zip_with(F.col("__x"), c["center"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v).alias("d"),
            c["center_id"].alias("id"),
        ),
    )
    assigned = j.select(key, "__x", F.array_min(d)["id"].alias("center_id"))
    ex = assigned.select("center_id", F.posexplode("__x").alias("pos", "v"))
    means = ex.groupBy("center_id", "pos").agg(F.avg("v").alias("m")).groupBy("center_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("new_center"),
    )
    sizes = assigned.groupBy("center_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        centers.join(means, "center_id", "left")
        .join(sizes, "center_id", "left")
        .select(
            "center_id",
            F.coalesce(F.col("new_center"), F.transform("center", lambda v: v.cast("double"))).alias("center"),
            F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        )
    )


def bisecting_kmeans(df, vector_col, key, k=8, seed=42, **params):
    """Divisive hierarchical clustering (bisecting k-means)."""
    data = df.withColumn("features", array_to_vector(F.col(vector_col)))
    model = BisectingKMeans(featuresCol="features", k=k, seed=seed, **params).fit(data)
    return model, model.transform(data).select(*key, F.col("prediction").alias("cluster"))


def gaussian_mixture(df, vector_col, key, k=4, seed=42, **params):
    """Gaussian mixture (EM). MLlib draws the start and predicts; the passes of EM are its formulas
    over blocks of rows (:func:`em_pass`), as MLlib's own take a row at a time."""
    import numpy as np
    import pyarrow as pa

    data = df.withColumn("features", array_to_vector(F.col(vector_col)))
    est = GaussianMixture(featuresCol="features", k=k, seed=seed, **params)
    if est.isDefined(est.weightCol):
        model = est.fit(data)
    else:
        start = est.fit(data, {est.maxIter: 0})
        weights = np.array(start.weights)
        parts = [(r["mean"].toArray(), r["cov"].toArray()) for r in start.gaussiansDF.collect()]

        def pack(batches):
            for b in batches:
                v = b.column(0).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"v": pa.array([np.ascontiguousarray(v, dtype="<f8").tobytes()], pa.binary())})

        blocks = data.select(vector_to_array("features").alias("v")).mapInArrow(pack, "v binary").persist(StorageLevel.MEMORY_AND_DISK)
        fit, before, turn = -sys.float_info.max, 0.0, 0
        while turn < est.getMaxIter() and abs(fit - before) > est.getTol():
            before, turn = fit, turn + 1
            rows, fit, w, m, c = em_pass(blocks, weights, parts)
            means = m / w[:, None]
            covs = (c - w[:, None, None] * means[:, :, None] * means[:, None, :]) / w[:, None, None]
            weights, parts = w / rows, list(zip(means, covs, strict=True))
        blocks.unpersist()
        model = _mixture_model(df.sparkSession, start, weights, parts)
    pred = model.transform(data)
    return model, pred.select(*key, F.col("prediction").alias("cluster"), vector_to_array("probability").alias("probability"))


def em_pass(blocks: DataFrame, weights, parts):
    """One pass of EM over blocks (v: doubles of many rows as bytes): rows, log likelihood, and per
    component the sums of shares, of share * x and of share * x x'. A task sends one row of these sums."""
    import numpy as np
    import pyarrow as pa

    k, d = len(weights), len(parts[0][0])
    eps = np.finfo(float).eps
    forms = []
    for mean, cov in parts:
        e, u = np.linalg.eigh(cov)
        ok = e > eps * e.max() * d
        root = u * np.where(ok, 1 / np.sqrt(np.where(ok, e, 1.0)), 0.0)
        forms.append((mean, root, -0.5 * (d * math.log(2 * math.pi) + np.log(e[ok]).sum())))

    def run(batches):
        rows, fit, w, m, c = 0, 0.0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        for b in batches:
            for v in b.column(0):
                x = np.frombuffer(v.as_buffer(), dtype="<f8").reshape(-1, d)
                p = np.empty((k, len(x)))
                for i, (mean, root, const) in enumerate(forms):
                    z = (x - mean) @ root
                    p[i] = eps + weights[i] * np.exp(const - 0.5 * np.einsum("ij,ij->i", z, z))
                total = p.sum(axis=0)
                p /= total
                rows += len(x)
                fit += np.log(total).sum()
                w += p.sum(axis=1)
                m += p @ x
                for i in range(k):
                    c[i] += (x * p[i][:, None]).T @ x
        sums = np.concatenate([[rows, fit], w, m.ravel(), c.ravel()])
        yield pa.RecordBatch.from_pydict({"s": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    got = np.sum([r["s"] for r in blocks.mapInArrow(run, "s array<double>").collect()], axis=0)
    w, m, c = np.split(got[2:], [k, k + k * d])
    return got[0], float(got[1]), w, m.reshape(k, d), c.reshape(k, d, d)


def _mixture_model(spark, start: GaussianMixtureModel, weights, parts) -> GaussianMixtureModel:
    """``start`` with other weights and components, as MLlib's model."""
    jvm, gate = spark._jvm, spark.sparkContext._gateway
    ws = gate.new_array(jvm.double, len(weights))
    gs = gate.new_array(jvm.org.apache.spark.ml.stat.distribution.MultivariateGaussian, len(weights))
    for i, (mean, cov) in enumerate(parts):
        ws[i] = float(weights[i])
        mu, sigma = (_py2java(spark.sparkContext, x) for x in (DenseVector(mean), DenseMatrix(*cov.shape, cov.ravel(order="F"))))
        gs[i] = jvm.org.apache.spark.ml.stat.distribution.MultivariateGaussian(mu, sigma)
    made = GaussianMixtureModel(jvm.org.apache.spark.ml.clustering.GaussianMixtureModel(start.uid, ws, gs))
    made._resetUid(start.uid)
    return made.setFeaturesCol(start.getFeaturesCol()).setPredictionCol(start.getPredictionCol()).setProbabilityCol(start.getProbabilityCol())


def gram(df: DataFrame, features: Sequence[str], means: Sequence[float]):
    """Sums of products of the centred features over the complete rows as a matrix: each task adds up the
    outer products of its batches, the tasks' matrices meet entry by entry in one aggregate, and what
    comes to the driver has the size of the schema squared."""
    import numpy as np
    import pandas as pd

    d, mu = len(features), np.array(means, float)

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = b.to_numpy(dtype=float) - mu
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(d, dtype=np.int32), "v": list(total)})

    rows = df.where(complete(df, features)).select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    parts = rows.mapInPandas(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def pca(df: DataFrame, features: Sequence[str], key: Sequence[str], k: int = 2):
    """Principal components of the centred features; returns (components, projections, explained
    variance ratios). The covariance comes from one distributed pass (:func:`gram`) and its
    eigenvectors from a symmetric solver, which always converges; a component's largest weight is
    positive. Every row stays: one with a missing feature has NULL projections (pcs)."""
    import numpy as np

    ok = complete(df, features)
    stats = df.where(ok).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    means = [stats[f"m{i}"] or 0.0 for i in range(len(features))]
    values, vectors = np.linalg.eigh(gram(df, features, means) / max(stats["n"] - 1, 1))
    order = np.argsort(values)[::-1][:k]
    components = vectors[:, order].T
    components = components * np.where(components[np.arange(len(order)), np.abs(components).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    total = float(values.sum())
    x = F.array(*[F.col(c).cast("double") - F.lit(m) for c, m in zip(features, means, strict=True)])

    def along(w):
        return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    proj = df.select(*key, F.when(ok, F.array(*[along(w) for w in components])).alias("pcs"))
    shares = [(i + 1, float(values[o]) / total if total else None) for i, o in enumerate(order)]
    return components, proj, df.sparkSession.createDataFrame(shares, "component int, variance_ratio double")


# ------------------------------------------------------------------ T12 isolation forest

def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


def isolation_forest(df: DataFrame, features: Sequence[str], key: str, n_trees: int = 100, sample_size: int = ISOLATION_SAMPLE, seed: int = 7) -> DataFrame:
    """score = 2^(-E[h(x)] / c(sample_size)); higher = more anomalous.

    Tree t is grown on rows whose portable hash h(key, t) falls under a threshold sized for
    about 1.5 x ``sample_size`` rows, trimmed to the ``sample_size`` smallest hashes per tree
    (each task keeps its own smallest per tree first). The (row, tree) pairs are generated
    only for selected rows inside one projection, so the input is scanned once, not once per
    tree. Trees are grown with applyInPandas (one bounded group each), collected (at most
    trees x 511 nodes) and broadcast; scoring routes whole Arrow batches down each tree with
    numpy (no per-row Python loop).
    """
    import numpy as np
    import pandas as pd

    from prepline.functions.exprs import LEHMER_MOD
    from prepline.functions.quantiles import smallest_k

    x = df.select(F.col(key).alias("__key"), *[F.col(c).cast("double").alias(c) for c in features]).na.fill(0.0, list(features))
    n = x.count()
    cut = int(min(1.0, 1.5 * sample_size / max(n, 1)) * LEHMER_MOD)
    picks = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_trees - 1)),
            lambda t: F.struct(t.alias("tree"), lehmer(lehmer(F.col("__key") + t * 1000003 + seed)).alias("h")),
        ),
        lambda p: p["h"] < cut,
    )
    pairs = x.select("*", F.explode(picks).alias("__p")).select(F.col("__p.tree").alias("tree"), F.col("__p.h").alias("__h"), "__key", *features)
    sample = smallest_k(pairs, "tree", ["__h", "__key"], sample_size, keep=list(features))
    limit = int(math.ceil(math.log2(max(sample_size, 2))))
    feats = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + t)
        data = pdf.sort_values(["__h", "__key"])[feats].to_numpy(dtype=float)
        feat, split, left, right, size = [], [], [], [], []

        def build(idx, depth):
            me = len(feat)
            feat.append(-1), split.append(0.0), left.append(-1), right.append(-1), size.append(int(len(idx)))
            if depth >= limit or len(idx) <= 1:
                return me
            sub = data[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.where(hi > lo)[0]
            if len(cand) == 0:
                return me
            f = int(rng.choice(cand))
            sp = float(rng.uniform(lo[f], hi[f]))
            feat[me], split[me] = f, sp
            lft = build(idx[sub[:, f] < sp], depth + 1)
            rgt = build(idx[sub[:, f] >= sp], depth + 1)
            left[me], right[me] = lft, rgt
            return me

        build(np.arange(len(data)), 0)
        return pd.DataFrame({"tree": [t], "feat": [feat], "split": [split], "left": [left], "right": [right], "size": [size], "n": [len(data)]})

    schema = "tree int, feat array<int>, split array<double>, left array<int>, right array<int>, size array<int>, n long"
    forest = sample.groupBy("tree").applyInPandas(grow, schema)
    grown = [
        (np.array(r["feat"]), np.array(r["split"]), np.array(r["left"]), np.array(r["right"]), np.array(r["size"]), r["n"])
        for r in forest.collect()  # n_trees x <= 511 nodes each
    ]
    bc = df.sparkSession.sparkContext.broadcast(grown)
    norm = _c(min(sample_size, max((g[5] for g in grown), default=sample_size)))
    c_table = np.array([_c(k) for k in range(sample_size + 2)])

    def score(batches):
        forest_ = bc.value
        for pdf in batches:
            data = pdf[feats].to_numpy(dtype=float)
            rows = np.arange(len(data))
            h = np.zeros(len(data))
            for feat, split, left, right, size, _ in forest_:
                node = np.zeros(len(data), dtype=int)
                depth = np.zeros(len(data))
                for _ in range(limit + 1):
                    inner = feat[node] >= 0
                    if not inner.any():
                        break
                    f = np.where(inner, feat[node], 0)
                    go_left = data[rows, f] < split[node]
                    nxt = np.where(go_left, left[node], right[node])
                    node = np.where(inner, nxt, node)
                    depth += inner
                h += depth + c_table[np.minimum(size[node], sample_size + 1)]
            h /= max(len(forest_), 1)
            yield pd.DataFrame({"__key": pdf["__key"], "score": np.power(2.0, -h / norm) if norm > 0 else np.zeros(len(data))})

    key_type = x.schema["__key"].dataType.simpleString()
    return x.mapInPandas(score, f"__key {key_type}, score double").withColumnRenamed("__key", key)


# ------------------------------------------------------------------ T13 statistical anomalies

def statistical_anomalies(df: DataFrame, column: str, by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """Per group, row flags for |z| > 3 (sample std), modified z > 3.5 (MAD; MAD 0 -> NULL)
    and IQR fences. Group statistics: one aggregate + exact quantiles per group. Every row stays:
    NULL is a group of its own, and a missing value or a group without values has no fences
    (iqr_flag NULL)."""
    from prepline.functions.quantiles import exact_quantiles, quantiles_wide, ranged_values

    v = F.col(column).cast("double")
    base = df.select(*key, *by, v.alias("__v"))
    mom = base.groupBy(*by).agg(F.avg("__v").alias("__mean"), F.stddev_samp("__v").alias("__sd"))
    w = base.where(F.col("__v").isNotNull()).groupBy(*by, F.col("__v").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    keys = list(by) if by else ["__g"]
    if not by:
        w = w.withColumn("__g", F.lit(0))
    w = ranged_values(w, keys)
    qs = quantiles_wide(exact_quantiles(w, keys, [0.25, 0.5, 0.75], ranged=w), keys, [0.25, 0.5, 0.75], ["__q1", "__med", "__q3"])
    dev = null_safe_join(w, qs.select(*keys, "__med"), keys).select(*keys, F.abs(F.col("v") - F.col("__med")).alias("v"), "w")
    dev = dev.groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    mad = exact_quantiles(dev, keys, [0.5]).select(*keys, F.col("q").alias("__mad"))
    stats = null_safe_join(qs, mad, keys)
    if not by:
        # no row at all if every value is missing
        stats = stats.agg(*[F.first(c).alias(c) for c in ("__q1", "__med", "__q3", "__mad")])
        j = attach_one_row(attach_one_row(base, mom), stats)
    else:
        j = null_safe_join(null_safe_join(base, mom, list(by)), stats, list(by), "left")
    z = (F.col("__v") - F.col("__mean")) / F.col("__sd")
    mz = F.when(F.col("__mad") > 0, F.lit(0.6745) * (F.col("__v") - F.col("__med")) / F.col("__mad"))
    iqr = F.col("__q3") - F.col("__q1")
    return j.select(
        *key,
        *by,
        F.col("__v").alias(column),
        F.coalesce(F.abs(z) > 3, F.lit(False)).alias("z_flag"),
        F.coalesce(F.abs(mz) > 3.5, F.lit(False)).alias("mad_flag"),
        ((F.col("__v") < F.col("__q1") - 1.5 * iqr) | (F.col("__v") > F.col("__q3") + 1.5 * iqr)).alias("iqr_flag"),
    )


# ------------------------------------------------------------------ T15, T16 ensembles

def vote(predictions: DataFrame, key: str, model_col: str = "model", prediction: str = "prediction", how: str = "majority") -> DataFrame:
    """Combine long-form predictions (key, model, prediction): majority class (ties to the
    smallest class) or mean."""
    if how == "mean":
        return predictions.groupBy(key).agg(F.avg(prediction).alias("prediction"), F.count(F.lit(1)).alias("n_models"))
    counts = predictions.groupBy(key, prediction).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(key).agg(
        F.min_by(prediction, F.struct(-F.col("__n"), F.col(prediction))).alias("prediction"), F.sum("__n").alias("n_models")
    )


#: fixed values: Poisson(1) probabilities of at most 0, 1, ... draws
POISSON_1 = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def bag_weight(key, bag: int):
    """How often a row is in a bootstrap sample: Poisson(1) by a portable hash of its key, so a bag does
    not depend on how rows are partitioned."""
    u = lehmer(lehmer(lehmer(key) + F.lit(bag + 1) * 7919)) / F.lit(float(2**31 - 1))
    return sum((F.when(u >= p, 1.0).otherwise(0.0) for p in POISSON_1[1:]), F.when(u >= POISSON_1[0], 1.0).otherwise(0.0))


def bagging(df, features, label, key, n_bags=5, seed=11, task="classification", **params):
    """Fit one model per bootstrap sample (Poisson(1) row weights by key hash) and combine with T15.
    Rows with a missing feature have no vote: prediction NULL, n_models 0."""
    train = assemble(slim(df.where(complete(df, features) & F.col(label).isNotNull()), [*key, label], features), features)
    df = slim(df, [*key, label], features)
    cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
    models = []
    for b in range(n_bags):
        bag = train.withColumn("__w", bag_weight(F.col(key[0]), b)).where("__w > 0")
        models.append(cls(featuresCol="features", labelCol=label, weightCol="__w", numTrees=params.get("numTrees", 20), seed=seed + b).fit(bag))

    def transform(rows: DataFrame) -> DataFrame:
        # one pass over the rows: each model adds its vote as a column
        out = assemble(rows, features)
        for b, m in enumerate(models):
            out = m.transform(out).withColumnRenamed("prediction", f"__p{b}").drop("rawPrediction", "probability")
        return out.withColumn("votes", F.array(*[f"__p{b}" for b in range(n_bags)]))

    votes = cut_lineage(predict_all(transform, df, features, list(key), ["votes"]))  # read twice
    long = votes.select(key[0], F.explode_outer("votes").alias("prediction"))
    out = vote(long.where("prediction is not null"), key[0], how="majority" if task == "classification" else "mean")
    rest = votes.where("votes is null").select(key[0], F.lit(None).cast("double").alias("prediction"), F.lit(0).cast("long").alias("n_models"))
    return out.unionByName(rest)


# ------------------------------------------------------------------ T21 self-training

def self_training(df: DataFrame, features: Sequence[str], label: str, key: str, threshold: float = 0.9, seed: int = 42):
    """Fit on labelled rows, add unlabelled rows predicted with probability >= threshold
    as pseudo-labels, refit, until no row is added; so the last model has seen them all. The
    growing label table is checkpointed (reliable) every round. Rows with a missing feature are
    neither fitted nor labelled; they stay with a NULL prediction."""
    data = assemble(slim(df.where(complete(df, features)), [key, label], features), features)
    data = data.drop(*[c for c in features if c not in (key, label)]).withColumn("__y", F.col(label).cast("double")).withColumn("__round", F.when(F.col(label).isNotNull(), 0))
    r = 0
    while True:
        r += 1
        train = data.where(F.col("__y").isNotNull())
        model = RandomForestClassifier(featuresCol="features", labelCol="__y", seed=seed, numTrees=30).fit(train)
        scored = model.transform(data.where(F.col("__y").isNull()))
        conf = F.array_max(vector_to_array("probability"))
        new = scored.where(conf >= threshold).select(key, F.col("prediction").alias("__new"))
        data = data.join(new, key, "left").withColumn("__round", F.when(F.col("__y").isNull() & F.col("__new").isNotNull(), F.lit(r)).otherwise(F.col("__round")))
        data = data.withColumn("__y", F.coalesce(F.col("__y"), F.col("__new"))).drop("__new")
        data = cut_in_place(data)
        if data.where(F.col("__round") == r).limit(1).count() == 0:
            break
    final = model.transform(data.drop("rawPrediction", "probability", "prediction"))
    out = final.select(key, label, F.col("__y").alias("training_label"), F.col("__round").alias("labelled_in_round"), "prediction")
    y = F.col(label).cast("double")
    rest = df.where(~complete(df, features)).select(key, label, y.alias("training_label"), F.when(y.isNotNull(), 0).alias("labelled_in_round"), F.lit(None).cast("double").alias("prediction"))
    return model, out.unionByName(rest)


# ------------------------------------------------------------------ T23, T24, T25, T26, T1, T2

def series_features(df: DataFrame, series: str, value: str) -> DataFrame:
    """T23 features: per series count, mean, std, min, max, first-to-last slope (by order of a
    numeric/time column is not needed for these moments)."""
    v = F.col(value).cast("double")
    return df.groupBy(series).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"),
    ).na.fill(0.0)


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance) from a tree model."""
    imp = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp, strict=True)], "feature string, importance double")


def tune(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 3, grid: dict | None = None, seed: int = 42):
    """Grid search with k-fold cross-validation; the fold column is the portable hash fold
    of E8 (deterministic, no per-run random split)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    data = assemble(slim(df, [key, label], features), features, invalid="skip").withColumn("__fold", (lehmer(F.col(key)) % folds).cast("int"))
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed)
    g = grid or {"numTrees": [10, 30], "maxDepth": [3, 6]}
    builder = ParamGridBuilder()
    for name, values in g.items():
        builder = builder.addGrid(rf.getParam(name), values)
    maps = builder.build()
    cv = CrossValidator(estimator=rf, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"), foldCol="__fold", seed=seed)
    model = cv.fit(data)
    rows = []
    for pm, m in zip(maps, model.avgMetrics, strict=True):
        rows.append(({p.name: v for p, v in pm.items()}.__repr__(), float(m)))
    return model, df.sparkSession.createDataFrame(rows, "params string, cv_accuracy double")


def predict(model, df: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Batch prediction of every row with a fitted model or pipeline; NULL where a feature is missing."""
    casted = df.withColumns({c: F.col(c).cast("double") for c in features})
    own = isinstance(model, PipelineModel)  # it assembles the features itself
    return predict_all(lambda rows: model.transform(rows if own else assemble(rows, features)), casted, features, key, ["prediction"])


def training_spec(models: DataFrame) -> DataFrame:
    """One row per (request, candidate model) with default parameters, metrics and folds."""
    spark = models.sparkSession
    params = spark.createDataFrame([(k, repr(v)) for k, v in DEFAULT_PARAMS.items()], "model_name string, default_params string")
    metrics = F.when(F.col("model_name").isin("Random Forest", "Logistic Regression", "Gradient Boosting"), F.lit("accuracy,precision,recall,f1")).when(
        F.col("model_name").isin("Random Forest Regressor", "Linear Regression"), F.lit("mse,rmse,mae,r2")
    ).otherwise(F.lit("inertia,silhouette"))
    return models.join(F.broadcast(params), "model_name", "left").withColumn("metrics", metrics).withColumn("cv_folds", F.lit(5))


def train(spec_model: str, df: DataFrame, features: Sequence[str], label: str | None, key: Sequence[str]):
    """Fit the named model as a Pipeline; returns (pipeline model, predictions, run facts). It is fitted
    on rows with all features and a label; the others are predicted as far as they have features."""
    t0 = time.time()
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")]
    p = DEFAULT_PARAMS.get(spec_model, {})
    if spec_model == "Random Forest":
        stages.append(RandomForestClassifier(labelCol=label, seed=42, **p))
    elif spec_model == "Random Forest Regressor":
        stages.append(RandomForestRegressor(labelCol=label, seed=42, **p))
    elif spec_model == "Logistic Regression":
        stages.append(LogisticRegression(labelCol=label, **p))
    elif spec_model == "Linear Regression":
        stages.append(LinearRegression(labelCol=label, **p))
    elif spec_model == "Gradient Boosting":
        stages.append(GBTClassifier(labelCol=label, seed=42, **p))
    elif spec_model == "K-Means":
        stages.append(KMeans(seed=42, **p))
    else:
        raise ValueError(spec_model)
    keep = [*key, label] if label else list(key)
    ok = complete(df, features) & (F.col(label).isNotNull() if label else F.lit(True))
    # an estimator reads its input several times: its rows are made once, with the partitions the filter gives
    model = Pipeline(stages=stages).fit(slim(df.where(ok), keep, features))
    casted = slim(df, keep, features)  # predicted in two parts, and often read again by metrics
    pred = predict_all(model.transform, casted, features, keep, ["prediction"])
    seconds = time.time() - t0
    run = df.sparkSession.createDataFrame([(spec_model, float(seconds))], "model_name string, training_seconds double")
    keep = [*key] + ([label] if label else []) + ["prediction"]
    return model, pred.select(*keep), run


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (MLlib's own format: metadata JSON + Parquet stages)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)




# ------------------------------------------------------------------ T22 label propagation

def label_propagation(df: DataFrame, key: str, label: str, group_cols: Sequence[str], tol: float = 1e-6, rounds: int | None = None) -> DataFrame:
    """Propagate a numeric label (e.g. 0/1) over the bipartite graph of rows and their
    attribute values (row -- "column=value"). Each round: every value node takes the mean
    score of its rows that have one; every unlabelled row takes the mean of its value nodes;
    labelled rows stay clamped. Rows with equal attributes have equal scores, so they are collapsed
    into one node that weighs its rows, and the rounds work on distinct attribute tuples only; a
    value shared by a third of all rows is one groupBy key with partial aggregation.

    Rounds are checkpointed and go on until the largest change is below ``tol``: the scores
    are weighted means of the labels and approach their fixed point from round to round. ``rounds``
    asks for exactly so many instead. Returns (key, label, score, prediction), prediction = score
    rounded (ties up); rows that no label reaches have a NULL score."""
    y = F.col(label).cast("double")
    base = df.select(F.col(key).alias("__k"), y.alias("__y"), F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)]).alias("__t"))
    nodes = cut_lineage(
        base.groupBy("__t").agg(F.count("__y").alias("nl"), F.sum("__y").alias("sl"), F.count_if(F.col("__y").isNull()).alias("nu")).withColumn("u", F.lit(None).cast("double"))
    )
    values = F.array(*[F.concat(F.lit(f"{i}="), F.coalesce(F.concat(F.lit("="), F.col(f"__t.g{i}").cast("string")), F.lit(""))) for i in range(len(group_cols))])
    done = 0
    while rounds is None or done < rounds:
        memb = nodes.select("__t", F.explode(values).alias("__g"), F.coalesce("sl", F.lit(0.0)).alias("sl"), "nl", "nu", "u")
        known = F.col("nl") + F.when(F.col("u").isNotNull(), F.col("nu")).otherwise(0)
        total = F.col("sl") + F.coalesce(F.col("u") * F.col("nu"), F.lit(0.0))
        mean = memb.groupBy("__g").agg(F.try_divide(F.sum(total), F.sum(known)).alias("gs"))
        new = memb.select("__t", "__g").join(mean, "__g").groupBy("__t").agg(F.avg("gs").alias("new"))
        nodes = cut_round(nodes.join(new, "__t").withColumn("change", F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("u", F.lit(0.0)))))
        done += 1
        moved = nodes.where("nu > 0").agg(F.max("change")).first()[0] or 0.0
        nodes = nodes.select("__t", "nl", "sl", "nu", F.col("new").alias("u"))
        if rounds is None and moved < tol:
            break
    score = F.coalesce("__y", "u")
    return base.join(nodes.select("__t", "u"), "__t", "left").select(
        F.col("__k").alias(key), F.col("__y").alias(label), score.alias("score"), F.floor(score + 0.5).alias("prediction")
    )
