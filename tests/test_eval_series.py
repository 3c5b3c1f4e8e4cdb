import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepline.functions.ordering import previous_values
from prepline.functions.quantiles import exact_quantiles
from prepline.operators import evaluate as E
from prepline.operators import series as W


def metrics(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_classification_golden(spark):
    rows = [(i, l, s, int(s >= 0.5)) for i, (l, s) in enumerate(zip([1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.3, 0.3, 0.2, 0.1]))]
    df = spark.createDataFrame(rows, "id int, label int, score double, prediction int")
    m = metrics(E.classification_metrics(df, positive=1))
    assert abs(m["accuracy"] - 0.8333) < 1e-4 and m["precision"] == 1.0 and abs(m["recall"] - 0.6667) < 1e-4 and abs(m["f1"] - 0.8) < 1e-9
    assert abs(metrics(E.roc_auc(df))["roc_auc"] - 8.5 / 9) < 1e-9
    cm = {(r["label"], r["prediction"]): r["n"] for r in E.confusion_matrix(df).collect()}
    assert cm[(1, 1)] == 2 and cm[(1, 0)] == 1 and cm[(0, 0)] == 3


def test_regression_golden(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (4.0, 4.0)], "label double, prediction double")
    m = metrics(E.regression_metrics(df))
    assert m["mse"] == 0.25 and m["rmse"] == 0.5 and m["mae"] == 0.25 and abs(m["r2"] - 0.8) < 1e-12 and abs(m["mape"] - 0.0833) < 1e-4


def test_cluster_golden_and_silhouette_brute_force(spark):
    pts = [(0, [0.0], 0), (1, [1.0], 0), (2, [10.0], 1), (3, [11.0], 1)]
    df = spark.createDataFrame(pts, "id int, x array<double>, c int")
    m = metrics(E.cluster_metrics(df, "x", "c"))
    assert abs(m["inertia"] - 1.0) < 1e-12 and abs(m["calinski_harabasz"] - 200.0) < 1e-9 and abs(m["davies_bouldin"] - 0.1) < 1e-12
    # squared-Euclidean silhouette (closed form) against a brute-force pairwise computation
    X = np.array([p[1][0] for p in pts])
    lab = np.array([p[2] for p in pts])

    def sil(dist):
        s = []
        for i in range(len(X)):
            same = [dist(X[i], X[j]) for j in range(len(X)) if lab[j] == lab[i] and j != i]
            other = [dist(X[i], X[j]) for j in range(len(X)) if lab[j] != lab[i]]
            a, b = np.mean(same), np.mean(other)
            s.append((b - a) / max(a, b))
        return np.mean(s)

    assert abs(metrics(E.silhouette(df, "x", "c"))["silhouette_sq"] - sil(lambda u, v: (u - v) ** 2)) < 1e-12
    assert abs(sil(lambda u, v: abs(u - v)) - 0.8998) < 1e-4  # Euclidean golden, brute force on the fixture


def test_ses_golden(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 8.0)], "t long, y double")
    got = [r["level"] for r in W.exponential_smoothing(df, "t", "y", alpha=0.5).orderBy("t").collect()]
    assert got == [2.0, 3.0, 5.5]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.lognormal(3, 2, 3000), np.full(2000, 7.0), rng.normal(0, 1e-3, 500)])
    keys = np.repeat([0, 1], len(vals) // 2 + 1)[: len(vals)]
    pdf = pd.DataFrame({"k": keys, "v": vals})
    w = spark.createDataFrame(pdf).groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(w, ["k"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).collect()}
    for (k, p), q in got.items():
        exp = np.quantile(pdf[pdf.k == k].v.to_numpy(), p)
        assert math.isclose(q, exp, rel_tol=1e-12, abs_tol=1e-12), (k, p)


def test_quantiles_of_null_keys_and_repeated_values(spark):
    rows = [(None, 1.0, 2), (None, 5.0, 1), ("a", 3.0, 1), ("a", 3.0, 4), ("a", 9.0, 1)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double, w long"), ["k"], [0.5, 1.0]).collect()
    assert {(r["k"], r["p"], r["q"]) for r in got} == {(None, 0.5, 1.0), (None, 1.0, 5.0), ("a", 0.5, 3.0), ("a", 1.0, 9.0)}


def test_quantile_plan_shuffles_no_value_by_its_column(spark):
    """Exchanges on the column position alone carry sums of partitions, never values."""
    from prepline.functions.quantiles import _located, ranged_values

    w = spark.range(20_000).select((F.col("id") % 3).cast("int").alias("position"), (F.col("id") * 7 % 9001).cast("double").alias("v"), F.lit(1).alias("w"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        ranged = ranged_values(w, ["position"])
        assert ranged.groupBy("_pid").count().count() > 3
        _, located = _located(ranged, ["position"], [0.25, 0.5])
        assert sorted(r["r"] for r in located.collect()) == sorted(3 * [1666, 1667, 3333] + [3332])
    finally:
        spark.conf.set(name, "true")
    plan = located._jdf.queryExecution().explainString(located.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    keyed = 0
    for node in plan.split("\n\n"):
        if "Exchange\n" in node and "hashpartitioning(_k" in node:
            keyed += 1
            assert " v#" not in node and "[v#" not in node, node
    assert keyed and "hashpartitioning(position" not in plan


def test_anomalies_keep_rows_of_missing_groups(spark):
    from prepline.operators.models import statistical_anomalies

    rows = [(k, None if k % 4 == 0 else "b" if k % 4 == 1 else "c", None if k % 4 == 1 else float(k * k % 17)) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    got = statistical_anomalies(df, "x", ["g"], ["id"])
    assert got.count() == 80 and got.where("g is null and iqr_flag is not null").count() == 20
    assert got.where("g = 'b' and iqr_flag is null and not z_flag").count() == 20
    assert statistical_anomalies(df.where("x is null"), "x", [], ["id"]).count() == 20


def test_previous_values_hot_key(spark):
    n = 3000
    pdf = pd.DataFrame({"k": np.where(np.arange(n) % 3 == 0, 1, np.arange(n) % 17), "t": np.arange(n), "v": np.arange(n) * 1.0})
    pdf.loc[pdf.t % 11 == 0, "v"] = np.nan  # NULL values keep their place among the lags
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7)
    got = previous_values(df, ["k"], "t", "v", 3, out="prev").toPandas().sort_values("t")
    pdf = pdf.sort_values(["k", "t"])
    for lag in (1, 2, 3):
        pdf[f"l{lag}"] = pdf.groupby("k")["v"].shift(lag)
    pdf = pdf.sort_values("t")
    for (_, g), (_, e) in zip(got.iterrows(), pdf.iterrows()):
        prev = [None if (x is None or (isinstance(x, float) and math.isnan(x))) else x for x in g["prev"]]
        have = pdf[(pdf.k == e["k"]) & (pdf.t < e["t"])].shape[0]  # rows before this one in its series
        exp = [None if math.isnan(e[f"l{j}"]) else e[f"l{j}"] for j in (3, 2, 1)][3 - min(3, have):]
        assert prev == exp


def test_smoothing_scan_matches_loop_with_hot_series(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in ((0, 2000), (1, 5), (2, 1), (3, 40)):
        for t in range(n):
            rows.append((k, t, float(rng.normal(10, 3))))
    pdf = pd.DataFrame(rows, columns=["k", "t", "y"])
    got = W.exponential_smoothing(spark.createDataFrame(pdf), "t", "y", ["k"], alpha=0.3, beta=0.2).toPandas()
    for k, g in pdf.groupby("k"):
        ys = g.sort_values("t").y.to_numpy()
        lv, tr = ys[0], (ys[1] - ys[0]) if len(ys) > 1 else 0.0
        exp = [(lv, tr)]
        for y in ys[1:]:
            nl = 0.3 * y + 0.7 * (lv + tr)
            tr = 0.2 * (nl - lv) + 0.8 * tr
            lv = nl
            exp.append((lv, tr))
        mine = got[got.k == k].sort_values("t")
        assert np.allclose(mine.level.to_numpy(), [e[0] for e in exp], rtol=1e-9, atol=1e-9)
        assert np.allclose(mine.trend.to_numpy(), [e[1] for e in exp], rtol=1e-9, atol=1e-9)


def test_last_non_null_hot_key_matches_pandas_ffill(spark):
    """90 % NULLs so whole partitions of a key hold no value and the carry must pass through."""
    from prepline.functions.ordering import last_non_null

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for seed, parts in ((9, "3"), (4, "16")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rng = np.random.default_rng(seed)
            n = 4000
            k = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n))
            v = np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n))
            pdf = pd.DataFrame({"k": k, "t": np.arange(n), "v": v})
            sdf = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
            got = last_non_null(sdf.repartition(5), ["k"], "t", "v", "f").toPandas().set_index("t").sort_index()["f"]
            exp = pdf.groupby("k")["v"].ffill()
            exp.index = pdf.t
            assert ((got.isna() != exp.isna()) | ((got - exp).abs() > 1e-12)).sum() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _smooth(rows, a, b):
    """(t, y) in order -> (level, trend, fitted) by a plain loop with the missing-value rule."""
    known = [y for _, y in rows if y is not None]
    out, state, begun = [], None, False
    for _, y in rows:
        if y is None:
            if not begun:
                out.append((None, None, None))
                continue
            level, trend = state
            fitted = level + (trend or 0.0)
            state = (fitted, trend)
        elif not begun:
            begun = True
            fitted = y if b is None else None
            state = (y, None if b is None else (known[1] - y if len(known) > 1 else 0.0))
        else:
            level, trend = state
            fitted = level + (trend or 0.0)
            new = a * y + (1 - a) * fitted
            state = (new, None if b is None else b * (new - level) + (1 - b) * trend)
        out.append((*state, fitted))
    return out


@pytest.mark.parametrize("beta", [None, 0.2])
def test_smoothing_over_missing_values_and_null_series(spark, beta):
    import random

    rng = random.Random(8)
    rows = []
    for t in range(3000):
        k = "hot" if t % 3 == 0 else rng.choice([None, "a", "late", "gone", *map(str, range(40))])
        y = None if k == "gone" or (k == "late" and t < 2500) or rng.random() < 0.3 else rng.choice([float("nan"), *[rng.uniform(-5, 5)] * 9])
        rows.append((k, t, y))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = W.exponential_smoothing(spark.createDataFrame(rows, "k string, t long, y double"), "t", "y", ["k"], alpha=0.3, beta=beta).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(rows)
    got = {(r["k"], r["t"]): r for r in got}
    for k in {r[0] for r in rows}:
        mine = [(t, None if y is None or math.isnan(y) else y) for kk, t, y in rows if kk == k]
        for (t, _), want in zip(mine, _smooth(mine, 0.3, beta), strict=True):
            r = got[k, t]
            have = (r["level"], None if beta is None else r["trend"], r["fitted"])
            assert all((g is None) == (w is None) and (g is None or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9)) for g, w in zip(have, want)), (k, t, have, want)


def test_tfidf_by_definition_with_repeated_and_missing_keys(spark, monkeypatch):
    """Rows with a key of their own are counted without a shuffle, those that share one together."""
    import math
    import re
    from collections import Counter, defaultdict

    from prepline.operators import features as FE

    rows = [(1, "b a b, A"), (2, "a"), (2, "a c"), (None, "x"), (None, "x y"), (3, ""), (4, None), (5, "  c_d c\tC É é ")]
    d = spark.createDataFrame(rows, "k long, text string")
    counts = defaultdict(Counter)
    for k, t in rows:
        counts[k].update(re.findall(r"\w+", (t or "").lower()))
    df = Counter(t for c in counts.values() for t in c)
    want = {(k, t): (n, df[t], n * (math.log((1 + len(rows)) / (1 + df[t])) + 1)) for k, c in counts.items() for t, n in c.items()}
    for most in (FE.BROADCAST_ROWS, 1):  # 1: more repeated keys and terms than are broadcast
        monkeypatch.setattr(FE, "BROADCAST_ROWS", most)
        out = FE.tfidf(d, "k", "text")
        got = out.collect()
        assert len(got) == len(want) and out.columns == ["k", "term", "tf", "df", "idf", "tfidf"]
        for r in got:
            tf, n, both = want[r["k"], r["term"]]
            assert (r["tf"], r["df"]) == (tf, n) and abs(r["tfidf"] - both) < 1e-9
    monkeypatch.undo()
    plan = FE.term_counts(d.where("k in (1, 5)"), "k", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
