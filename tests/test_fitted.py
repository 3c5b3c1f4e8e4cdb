"""Fitted preprocessing: nothing is learnt from rows outside the training split, jobs do not grow with columns."""

import pytest
from pyspark.sql import functions as F

from prepline.operators import features as FE
from prepline.plans.fitted import FITTED, apply_plan, fit_plan

STEPS = "step_order int, position int, column_name string, step string, method string"


def steps_of(spark, *rows):
    order = {"impute": 1, "treat_outliers": 2, "date_features": 3, "encode": 4, "scale": 5, "split": 6}
    return spark.createDataFrame([(order[s], i, c, s, m) for i, (c, s, m) in enumerate(rows)], STEPS)


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame([(k, float(k % 10) if k % 4 else None, "a" if k % 3 else "b", "x" if k % 5 else None) for k in range(60)], "k long, v double, g string, t string")


def test_statistics_come_from_the_training_rows(spark, train):
    steps = steps_of(spark, ("v", "impute", "mean"), ("t", "impute", "mode"), ("v", "treat_outliers", "clip_iqr"), ("g", "encode", "one_hot"), ("t", "encode", "ordinal"), ("v", "scale", "standard"))
    fitted = fit_plan(train, steps)
    assert fitted.schema.simpleString() == spark.createDataFrame([], FITTED).schema.simpleString()
    other = spark.createDataFrame([(1, None, "a", "x"), (2, 1e9, "new", "never"), (3, float("nan"), None, None)], "k long, v double, g string, t string")
    got = {r["k"]: r.asDict() for r in apply_plan(other, fitted).collect()}
    v = train.select(F.coalesce("v", F.lit(train.agg(F.avg("v")).first()[0])).alias("v")).toPandas()["v"]
    q1, q3 = v.quantile(0.25), v.quantile(0.75)
    high = q3 + 1.5 * (q3 - q1)
    c = v.clip(q1 - 1.5 * (q3 - q1), high)
    assert got[1]["v"] == pytest.approx((v.mean() - c.mean()) / c.std(ddof=0)) == got[3]["v"]
    assert got[2]["v"] == pytest.approx((high - c.mean()) / c.std(ddof=0))
    assert (got[1]["g_a"], got[1]["g_b"], got[1]["t_code"]) == (1, 0, 0)
    assert (got[2]["g_a"], got[2]["g_b"], got[2]["t_code"]) == (0, 0, None)
    assert (got[3]["g_a"], got[3]["t_code"]) == (0, 0)  # a missing text takes the training mode


def test_nothing_known(spark):
    empty = spark.createDataFrame([], "v double, g string")
    steps = steps_of(spark, ("v", "impute", "mean"), ("g", "impute", "mode"), ("v", "treat_outliers", "clip_iqr"), ("g", "encode", "one_hot"), ("v", "scale", "standard"))
    got = apply_plan(spark.createDataFrame([(1.0, "a"), (None, None)], "v double, g string"), fit_plan(empty, steps))
    assert got.columns == ["v"] and [r["v"] for r in got.collect()] == [0.0, None]


def test_jobs_do_not_grow_with_columns(spark, train):
    def jobs(n):
        wide = train.select("k", *[F.col("v").alias(f"v{i}") for i in range(n)], *[F.col("t").alias(f"t{i}") for i in range(n)], *[F.col("g").alias(f"g{i}") for i in range(n)])
        rows = [(f"v{i}", "impute", "mean") for i in range(n)] + [(f"t{i}", "impute", "mode") for i in range(n)] + [(f"v{i}", "treat_outliers", "clip_iqr") for i in range(n)]
        rows += [(f"g{i}", "encode", "one_hot") for i in range(n)] + [(f"t{i}", "encode", "ordinal") for i in range(n)] + [(f"v{i}", "scale", "standard") for i in range(n)]
        spark.sparkContext.setJobGroup(f"columns-{n}", "")
        apply_plan(wide, fit_plan(wide, steps_of(spark, *rows)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"columns-{n}"))

    assert 0 < jobs(6) <= jobs(2) + 2  # adaptive plans may run a stage more or less


def test_one_hot_beyond_the_wide_limit(spark, monkeypatch):
    monkeypatch.setattr("prepline.plans.fitted.WIDE_LEVELS", 1)
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "g string")
    fitted = fit_plan(df, steps_of(spark, ("g", "encode", "one_hot")))
    assert {r["method"] for r in fitted.collect()} == {"ordinal"}
    assert sorted((r["g_code"] is None, r["g_code"]) for r in apply_plan(df, fitted).collect()) == [(False, 0), (False, 1), (False, 1), (True, None)]


def test_sparse_one_hot_of_many_levels(spark):
    df = spark.range(100_000).select("id", F.concat(F.lit("level "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"))
    got = FE.encode_one_hot_sparse(df.unionByName(spark.createDataFrame([(-1, None)], "id long, c string")), "id", "c")
    assert got.agg(F.count(F.lit(1)), F.sum((F.col("id") == F.col("level_index")).cast("long"))).first() == (100_000, 100_000)
