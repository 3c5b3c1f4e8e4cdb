"""Evaluation (E1-E12) over any prediction table: long-form (metric, value) results.

Every metric is a conditional sum in one aggregation, or a per-class table with one row per
class. AUC ranks come from a distributed running count (no single-task window); cluster
metrics use cluster aggregates, never point pairs. Empty denominators give NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepline.functions.exprs import attach_one_row, lehmer
from prepline.session import cut_lineage


def _long(row_df: DataFrame, names: Sequence[str]) -> DataFrame:
    stack = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    return row_df.selectExpr(f"stack({len(names)}, {stack}) AS (metric, value)")


# ------------------------------------------------------------------ E3, E4, E1

def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class -- (class, precision, recall, f1, support). One row per class."""
    return _report(confusion_matrix(pred, label, prediction))


def _report(cm: DataFrame) -> DataFrame:
    tp = cm.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("class"), F.col("n").alias("tp"))
    support = cm.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    classes = support.select("class").union(predicted.select("class")).distinct()
    t = classes.join(support, "class", "left").join(predicted, "class", "left").join(tp, "class", "left").fillna(0, ["support", "predicted", "tp"])
    prec = F.try_divide(F.col("tp").cast("double"), F.col("predicted"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("support"))
    return t.select(
        "class",
        prec.alias("precision"),
        rec.alias("recall"),
        F.try_divide(2 * prec * rec, prec + rec).alias("f1"),
        F.col("support").cast("long").alias("support"),
    )


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction", positive=None) -> DataFrame:
    """Accuracy, macro / weighted precision, recall, F1; with ``positive`` also the binary
    precision, recall, F1 of that class. Long form."""
    cm = cut_lineage(confusion_matrix(pred, label, prediction))  # everything below comes from one pass over the rows
    rep = _report(cm)
    right = F.coalesce(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))), F.lit(0))
    acc = cm.agg(F.try_divide(right.cast("double"), F.sum("n")).alias("accuracy"))
    agg = rep.agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision_weighted"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall_weighted"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )
    names = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted"]
    row = attach_one_row(acc, agg)
    if positive is not None:
        pos = rep.where(F.col("class") == F.lit(positive)).select(
            F.col("precision").alias("precision"), F.col("recall").alias("recall"), F.col("f1").alias("f1")
        )
        pos = pos.unionByName(pos.sparkSession.createDataFrame([(None, None, None)], "precision double, recall double, f1 double")).agg(
            F.max("precision").alias("precision"), F.max("recall").alias("recall"), F.max("f1").alias("f1")
        )
        row = attach_one_row(row, pos)
        names += ["precision", "recall", "f1"]
    return _long(row, names)


# ------------------------------------------------------------------ E2

def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Tie-aware AUC = (sum of average ranks of positives - P(P+1)/2) / (P N).

    Scores are ranked over their distinct values with a distributed running count; each
    distinct score carries its positive count, so the sum needs no per-row window. Rows without
    a score or without a label are not counted."""
    from prepline.functions.ordering import running_before

    per = pred.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")
    )
    ranked = running_before(per, [], "s", "n")
    avg_rank = F.col("before") + (F.col("n") + 1) / 2.0
    tot = ranked.agg(F.sum(avg_rank * F.col("pos")).alias("rsum"), F.sum("pos").alias("P"), F.sum(F.col("n") - F.col("pos")).alias("N"))
    return tot.select(
        F.lit("roc_auc").alias("metric"),
        F.try_divide(F.col("rsum") - F.col("P") * (F.col("P") + 1) / 2.0, F.col("P") * F.col("N")).alias("value"),
    )


# ------------------------------------------------------------------ E5

def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """E5: mse, rmse, mae, r2 (NULL for a constant label), mape (rows with label 0 skipped)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = p - y
    row = pred.agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("sse"),
        F.var_pop(y).alias("vy"),
        F.count(y).alias("n"),
        F.avg(F.when(y != 0, F.abs(e / y))).alias("mape"),
    ).select(
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2"),
        "mape",
    )
    row = row.withColumn("r2", F.when(F.col("r2").isNotNull() & ~F.isnan("r2"), F.col("r2")))
    return _long(row, ["mse", "rmse", "mae", "r2", "mape"])


# ------------------------------------------------------------------ E6, E7 clustering (vectors as array<double>)

def _arr(c: str):
    return F.transform(F.col(c), lambda x: x.cast("double"))


def _sqnorm(a):
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cluster_stats(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """(cluster, n, centroid array, sum of squared norms): one row per cluster.
    Element-wise means come from a posexplode + groupBy (dimension-sized rows per point)."""
    ex = df.select(F.col(cluster).alias("cluster"), F.posexplode(_arr(features)).alias("pos", "x"))
    cen = ex.groupBy("cluster", "pos").agg(F.avg("x").alias("m"))
    cen = cen.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
    sizes = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum(_sqnorm(_arr(features))).alias("sq"))
    return sizes.join(cen, "cluster")


def silhouette_sq(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """E6/V8 per row with squared Euclidean distance, as MLlib's ClusteringEvaluator: the mean
    distance of x to cluster C is |x|^2 - 2 x.mean(C) + mean(|y|^2) -- cluster aggregates only.
    a uses the own cluster over its other points; singleton clusters score 0."""
    stats = cluster_stats(df, features, cluster)  # k rows
    ks = stats.select(F.collect_list(F.struct("cluster", "n", "centroid", "sq")).alias("cl"))
    x = _arr(features)
    j = attach_one_row(df.select("*", x.alias("__x")), ks)
    xx = _sqnorm(F.col("__x"))
    mean_d = lambda c: xx - 2 * _dot(F.col("__x"), c["centroid"]) + c["sq"] / c["n"]
    own = F.filter(F.col("cl"), lambda c: c["cluster"] == F.col(cluster))[0]
    others = F.filter(F.col("cl"), lambda c: c["cluster"] != F.col(cluster))
    a = F.when(own["n"] > 1, mean_d(own) * own["n"] / (own["n"] - 1))
    b = F.array_min(F.transform(others, mean_d))
    s = F.when(own["n"] <= 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return j.select(*[c for c in df.columns], s.alias("silhouette"))


def silhouette(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Mean squared-Euclidean silhouette."""
    return silhouette_sq(df, features, cluster).agg(F.avg("silhouette").alias("value")).select(F.lit("silhouette_sq").alias("metric"), "value")


def cluster_metrics(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Inertia (within sum of squares), Calinski-Harabasz, Davies-Bouldin. Inputs per
    cluster are k rows; the Davies-Bouldin pair step is k x k over centroids, not points."""
    stats = cluster_stats(df, features, cluster)
    x = _arr(features)
    j = df.select(F.col(cluster).alias("cluster"), x.alias("__x")).join(F.broadcast(stats.select("cluster", "centroid")), "cluster")  # k rows
    d2 = _sqnorm(F.zip_with(F.col("__x"), F.col("centroid"), lambda a, b: a - b))
    per = j.groupBy("cluster").agg(F.sum(d2).alias("w"), F.avg(F.sqrt(d2)).alias("scatter"), F.count(F.lit(1)).alias("n"))
    tot = df.select(F.posexplode(x).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("g"))
    gmean = tot.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "g"))), lambda s: s["g"]).alias("gm"))
    between = attach_one_row(stats.select("cluster", "n", "centroid"), gmean).select(
        F.sum(F.col("n") * _sqnorm(F.zip_with("centroid", "gm", lambda a, b: a - b))).alias("b")
    )
    between = between.agg(F.sum("b").alias("B"))
    within = per.agg(F.sum("w").alias("W"), F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"))
    ch = attach_one_row(within, between).select(
        F.col("W").alias("inertia"),
        F.try_divide(F.col("B") / (F.col("K") - 1), F.col("W") / (F.col("N") - F.col("K"))).alias("calinski_harabasz"),
    )
    c1 = per.join(stats.select("cluster", "centroid"), "cluster").select(F.col("cluster").alias("c1"), F.col("scatter").alias("s1"), F.col("centroid").alias("m1"))
    c2 = c1.select(F.col("c1").alias("c2"), F.col("s1").alias("s2"), F.col("m1").alias("m2"))
    pairs = c1.join(c2, F.col("c1") != F.col("c2"))  # centroid pairs: k x (k-1) rows, k = number of clusters
    ratio = (F.col("s1") + F.col("s2")) / F.sqrt(_sqnorm(F.zip_with("m1", "m2", lambda a, b: a - b)))
    db = pairs.groupBy("c1").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return _long(attach_one_row(ch, db), ["inertia", "calinski_harabasz", "davies_bouldin"])


# ------------------------------------------------------------------ E8-E10 folds

def kfold(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """fold = lehmer(key) mod k (portable, deterministic)."""
    return df.withColumn("fold", (lehmer(F.col(key)) % k).cast("int"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Within each class, rows ordered by (hash, key) are dealt round-robin into k folds.
    The position within a class is a distributed running count, not a per-class window."""
    from prepline.functions.ordering import running_before

    h = df.withColumn("__lbl", F.col(label)).withColumn("__ord", F.struct(lehmer(F.col(key)).alias("h"), F.col(key).alias("k"))).withColumn("__one", F.lit(1))
    r = running_before(h, ["__lbl"], "__ord", "__one", out="__pos")
    return r.withColumn("fold", (F.col("__pos") % k).cast("int")).drop("__lbl", "__ord", "__one", "__pos")


def time_series_split(df: DataFrame, ts: str, k: int = 5) -> DataFrame:
    """Rows ordered by time (ties by the remaining order column list) are cut into k+1
    equal blocks; ``fold`` = block index (block 0 only ever trains; fold i tests block i and
    trains on blocks < i). Positions come from a distributed running count. Rows without a
    time keep their place in the output with a NULL fold."""
    from prepline.functions.ordering import running_before

    n = df.agg(F.count(ts).alias("__n"))
    counts = df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("__t")).agg(F.count(F.lit(1)).alias("__c"))
    pos = running_before(counts, [], "__t", "__c", out="__before")
    blk = attach_one_row(pos, n).select("__t", F.floor(F.col("__before") * (k + 1) / F.col("__n")).cast("int").alias("fold"))
    return df.join(blk, F.col(ts) == F.col("__t"), "left").drop("__t")


# ------------------------------------------------------------------ E11, E12

def evaluate(pred: DataFrame, problem: str, label: str = "label", prediction: str = "prediction", score: str | None = None, features: str | None = None) -> DataFrame:
    """Dispatch by problem type into one long metrics table."""
    if "classification" in problem:
        out = classification_metrics(pred, label, prediction)
        if score:
            out = out.unionByName(roc_auc(pred, label, score))
        return out
    if "regression" in problem or "forecast" in problem:
        return regression_metrics(pred, label, prediction)
    if "clustering" in problem and features:
        return cluster_metrics(pred, features, prediction).unionByName(silhouette(pred, features, prediction))
    raise ValueError(f"no metrics for {problem!r}")


def model_report(run: DataFrame, metrics: DataFrame, importances: DataFrame | None = None) -> DataFrame:
    """One table -- run facts (model, timings) x metrics (+ top feature importances)."""
    out = attach_one_row(metrics, run)
    if importances is not None:
        w = Window.orderBy(F.desc("importance"))  # one row per feature: schema-sized
        top = importances.withColumn("r", F.row_number().over(w)).where("r <= 5").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "feature"))), lambda s: s["feature"]), ",").alias("top_features")
        )
        out = attach_one_row(out, top)
    return out
