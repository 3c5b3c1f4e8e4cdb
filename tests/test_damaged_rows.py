"""Rows with missing labels, keys and times, and negative keys: nothing vanishes."""

from pyspark.sql import functions as F

from prepline.operators import evaluate as E
from prepline.operators import features as X
from prepline.operators.density import dbscan


def test_negative_keys_spread(spark):
    df = spark.range(-1000, 0).withColumnRenamed("id", "k")
    folds = {r[0]: r[1] for r in E.kfold(df, "k").groupBy("fold").count().collect()}
    assert set(folds) == {0, 1, 2, 3, 4} and min(folds.values()) > 100
    test = X.train_test_split(df, "k").where("split = 'test'").count()
    assert 100 < test < 350


def test_missing_labels_keep_their_rows(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("y"))
    assert X.stratified_split(df, "k", "y").count() == 100
    assert E.stratified_kfold(df, "k", "y").count() == 100
    pred = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.95), (None, 0.01)], "label int, score double")
    assert E.roc_auc(pred).first()["value"] == 1.0


def test_missing_time_has_no_fold(spark):
    df = spark.range(21).select(F.when(F.col("id") < 20, F.col("id")).alias("t"))
    got = E.time_series_split(df, "t", 4)
    assert got.count() == 21 and got.where("fold is null").count() == 1
    assert got.where("fold = 0").count() == 4


def test_missing_level_is_encoded_out_of_fold(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("c"), (F.col("id") % 2).cast("double").alias("y"))
    got = X.encode_target(df, "c", "y", folds=5, key="k")
    assert got.count() == 100 and got.where("c_te is null").count() == 0


def test_a_long_chain_is_one_cluster(spark):
    df = spark.range(120).select(F.col("id").alias("k"), F.array(F.col("id") * 0.9, F.lit(0.0)).alias("v"))
    assert {r[0] for r in dbscan(df, "k", "v", 1.0, 2).select("cluster").distinct().collect()} == {0}
