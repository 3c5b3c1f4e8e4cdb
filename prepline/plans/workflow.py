"""Preprocessing plans (F1, F2), export (X1, X2) and the end-to-end run.

A plan is a DataFrame of steps derived from the column profile with Column expressions
(F1); executing it (F2) fits the steps on the training rows (``fitted``) and applies the fitted
table. X3 is a plain function that calls the stages in order; every stage is a Spark job.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepline.operators import features as FE
from prepline.operators.rules import name_type_expr, role_expr
from prepline.plans.fitted import TEST_SHARE, apply_plan, fit_plan
from prepline.session import cut_lineage

# ---- fixed values: step order ----
STEP_ORDER = {"impute": 1, "treat_outliers": 2, "date_features": 3, "encode": 4, "scale": 5, "split": 6}
# ---- end of fixed values ----


def plan(profile: DataFrame, problem: str) -> DataFrame:
    """steps (step_order, step, method, column_name) for the kept feature columns:
    impute (mean for numeric, mode otherwise) where values are missing, IQR clipping and
    standard scaling for numeric, one-hot for categorical, ordinal for text kept for
    classification, date parts for datetime; a final split step."""
    t = name_type_expr(F.col("column_name"), F.col("dtype"))
    role = role_expr(F.col("column_name"), F.col("dtype"))
    text_ok = "classification" in (problem or "")
    keep = (role == "feature") | ((role == "datetime") & (t == "datetime"))
    cols = profile.where(keep).select("position", "column_name", t.alias("t"), "n_missing")
    steps = F.array_compact(
        F.array(
            F.when(F.col("n_missing") > 0, F.struct(F.lit("impute").alias("step"), F.when(F.col("t") == "numeric", "mean").otherwise("mode").alias("method"))),
            F.when(F.col("t") == "numeric", F.struct(F.lit("treat_outliers").alias("step"), F.lit("clip_iqr").alias("method"))),
            F.when(F.col("t") == "datetime", F.struct(F.lit("date_features").alias("step"), F.lit("parts").alias("method"))),
            F.when(F.col("t") == "categorical", F.struct(F.lit("encode").alias("step"), F.lit("one_hot").alias("method"))),
            F.when((F.col("t") == "text") & F.lit(text_ok), F.struct(F.lit("encode").alias("step"), F.lit("ordinal").alias("method"))),
            F.when(F.col("t") == "numeric", F.struct(F.lit("scale").alias("step"), F.lit("standard").alias("method"))),
        )
    )
    per_col = cols.select("position", "column_name", F.explode(steps).alias("s")).select("position", "column_name", "s.step", "s.method")
    order = F.create_map(*[x for k, v in STEP_ORDER.items() for x in (F.lit(k), F.lit(v))])
    split = profile.sparkSession.createDataFrame([(None, None, "split", "hash_80_20")], "position int, column_name string, step string, method string")
    return per_col.unionByName(split).withColumn("step_order", order[F.col("step")])


def execute_plan(df: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """fit the steps on the training rows of the plan's split (on all rows if the plan has none)
    and apply them to the whole table."""
    return apply_plan(df, fit_on_train(df, steps, key))


def fit_on_train(df: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """the plan's fitted table, from rows outside the test split only."""
    train = df
    if steps.where("step = 'split'").limit(1).count():
        train = FE.train_test_split(df, key, TEST_SHARE).where("split = 'train'").drop("split")
    return fit_plan(train, steps, key)


def export_package(root: str, tables: dict[str, DataFrame], model=None) -> DataFrame:
    """Write each table (plan, spec, metrics, ...) as Parquet and the model with MLlib's
    writer under ``root``, then a manifest (name, kind, path, n_rows) read back from disk."""
    spark: SparkSession | None = None
    entries = []
    for name, t in tables.items():
        spark = t.sparkSession
        path = os.path.join(root, name)
        t.write.mode("overwrite").parquet(path)
        entries.append((name, "table", path))
    if model is not None:
        path = os.path.join(root, "model")
        model.write().overwrite().save(path)
        entries.append(("model", "model", path))
    manifest_path = os.path.join(root, "manifest")
    assert spark is not None
    m = spark.createDataFrame(entries, "name string, kind string, path string")
    m.coalesce(1).write.mode("overwrite").json(manifest_path)  # one row per exported item
    back = spark.read.json(manifest_path)
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, k, p in entries if k == "table"]
    if counts:
        u = counts[0]
        for c in counts[1:]:
            u = u.unionByName(c)
        back = back.join(u, "name", "left")
    return back


def end_to_end(
    spark: SparkSession,
    path: str,
    prompt: str,
    target: str,
    key: str,
    out_root: str,
    format_hint: str = "auto",
    drop: Sequence[str] = (),
) -> DataFrame:
    """Prompt + file -> classify (M1) -> read (S7) -> clean (P1) -> profile (A9) ->
    features (R10) -> models (M5) -> plan + execute (F1, F2) -> train (T2) -> evaluate (E11)
    -> export (X2). Returns the model report (E12) joined with the manifest count."""
    from prepline.operators import evaluate as E
    from prepline.operators import intent as M
    from prepline.operators import models as T
    from prepline.operators.clean import standardize_names
    from prepline.operators.profile import column_profile
    from prepline.operators.rules import data_facts, recommend_features
    from prepline.sources.readers import read_auto

    req = spark.createDataFrame([(prompt,)], "prompt string")
    df = standardize_names(read_auto(spark, path, format_hint)).drop(*drop)
    profile = column_profile(df)
    cls = M.classify_prompts(req, "prompt", preview_profile=profile)
    problem = cls.select("problem_type").first()["problem_type"]
    feats = recommend_features(profile.where(F.col("column_name") != target), problem)
    kept = [r["column_name"] for r in feats.where("decision = 'keep'").select("column_name").collect()]
    models = M.recommend_models(cls.select("problem_type"), data_facts(profile))
    steps = cut_lineage(plan(profile.where(F.col("column_name").isin(kept)), problem))  # a few rows
    chosen = df.select(key, target, *kept)
    fitted = cut_lineage(fit_on_train(chosen, steps, key))
    prepared = apply_plan(chosen, fitted)
    numeric = [f.name for f in prepared.schema.fields if f.name not in (key, target, "split") and f.dataType.typeName() in ("double", "integer", "long", "float", "boolean", "short", "byte")]
    prepared = prepared.withColumns({c: F.col(c).cast("double") for c in numeric})
    first_model = models.orderBy("priority").select("model_name").first()["model_name"]
    train_df = prepared.where(F.col("split") == "train")
    test_df = prepared.where(F.col("split") == "test")
    model, _, run = T.train(first_model, train_df, numeric, target, [key])
    pred = model.transform(test_df).select(key, F.col(target).alias("label"), "prediction")
    metrics = cut_lineage(E.evaluate(pred, problem))  # a few rows, read by export and report
    manifest = export_package(out_root, {"plan": steps, "fitted": fitted, "metrics": metrics, "models": models, "profile": profile.drop("sample_values")}, model)
    report = E.model_report(run.withColumn("problem_type", F.lit(problem)), metrics)
    return report.withColumn("n_exported", F.lit(manifest.count()))
