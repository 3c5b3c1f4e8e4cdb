"""Plot-ready datasets (V1-V8). Rendering is not built; each operator returns the table a
chart is drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.functions.exprs import as_double, attach_one_row, lehmer


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """V1: equal-width bins over [min, max] -> (bin, lo, hi, n); the max falls in the last bin."""
    v = as_double(F.col(column), df.schema[column].dataType)
    mm = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((v - F.col("__lo")) / width), F.lit(bins - 1))).cast("int")
    counted = attach_one_row(df.where(v.isNotNull()), mm).groupBy(b.alias("bin"), "__lo", "__hi").agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("__hi") - F.col("__lo")) / bins
    return counted.select("bin", (F.col("__lo") + F.col("bin") * w).alias("lo"), (F.col("__lo") + (F.col("bin") + 1) * w).alias("hi"), "n")


def boxplot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V2: per column min, q1, median, q3, max (exact), whiskers at the 1.5 IQR fences clipped to
    the data, and the count outside them."""
    from prepline.operators.features import _long_values, q as qcol
    from prepline.functions.quantiles import exact_quantiles, quantiles_wide

    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    qs = quantiles_wide(exact_quantiles(_long_values(df, columns), ["position"], probs), ["position"], probs, ["min", "q1", "median", "q3", "max"])
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, column_name string")
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("position"), as_double(qcol(c), df.schema[c].dataType).alias("v")) for i, c in enumerate(columns)])).alias("e")
    ).select("e.*")
    fences = qs.select("position", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lf"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("uf"))
    inside = long.join(F.broadcast(fences), "position").groupBy("position").agg(  # one row per column
        F.min(F.when(F.col("v") >= F.col("lf"), F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= F.col("uf"), F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < F.col("lf")) | (F.col("v") > F.col("uf"))).alias("n_outliers"),
    )
    return names.join(qs, "position").join(inside, "position").select(
        "column_name", "min", "q1", "median", "q3", "max", "whisker_low", "whisker_high", "n_outliers"
    )


def scatter_sample(df: DataFrame, key: str, x: str, y: str, fraction: float = 0.1, buckets: int = 10000) -> DataFrame:
    """V3: deterministic sample (portable hash of an integer key below a threshold) of (x, y)."""
    cut = int(round(fraction * buckets))
    return df.where(lehmer(F.col(key)) % buckets < cut).select(key, x, y)


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """V4: one row per distinct score threshold t: predicting positive when score >= t gives
    (tpr, fpr). Cumulative counts over descending scores come from a distributed running sum."""
    from prepline.functions.ordering import running_before

    per = pred.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("__neg")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    totals = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum_p = running_before(per, [], "__neg", "pos", out="__bp")
    cum = running_before(cum_p.withColumn("__n", F.col("neg")), [], "__neg", "__n", out="__bn")
    out = attach_one_row(cum, totals)
    return out.select(
        (-F.col("__neg")).alias("threshold"),
        F.try_divide((F.col("__bp") + F.col("pos")).cast("double"), F.col("P")).alias("tpr"),
        F.try_divide((F.col("__bn") + F.col("neg")).cast("double"), F.col("N")).alias("fpr"),
    )


def residuals(pred: DataFrame, keys: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V5: (keys, label, prediction, residual = label - prediction)."""
    return pred.select(*keys, label, prediction, (F.col(label) - F.col(prediction)).alias("residual"))


def silhouette_rows(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """V8: per-row squared-Euclidean silhouette."""
    from prepline.operators.evaluate import silhouette_sq

    return silhouette_sq(df, features, cluster)
