"""Registered streaming, plan, export and end-to-end queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepline.catalog import register
from prepline.catalog.q_models import DOC_FEATURES, doc_features
from prepline.catalog.q_profile import rounded
from prepline.operators import evaluate as E
from prepline.operators import models as T
from prepline.plans import workflow as X
from prepline.sources.readers import scratch_path
from prepline.sources.tables import load, orders_missing
from prepline.streaming import quality as Y


@register(
    "y1_stream_quality_daily",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end,
  CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(value) AS BIGINT) AS n_missing, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM events GROUP BY 1, 2""",
)
def y1(spark, sf):
    import uuid

    run = uuid.uuid4().hex[:8]
    src = f"{sf}/events.parque[t]"  # a glob: the file source watches a pattern, not a single file
    schema = load(spark, sf, "events").schema
    out = scratch_path(spark, "stream", run, "out")
    ckpt = scratch_path(spark, "stream", run, "ckpt")
    return rounded(Y.stream_quality(spark, src, schema, out, ckpt, "ts", "value", "1 day", "1 hour"))


@register(
    "y1_stream_quality_late_rows",
    """WITH e AS (SELECT event_id % 3 AS b, ts FROM events),
w AS (SELECT b, (SELECT max(ts) - INTERVAL 10 DAY FROM e p WHERE p.b < g.b) AS mark FROM (SELECT DISTINCT b FROM e) g)
SELECT CAST(e.b AS BIGINT) AS slice, CAST(count(*) AS BIGINT) AS n_read, CAST(count(*) FILTER (mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark) AS BIGINT) AS n_on_time,
  CAST(count(*) FILTER (date_trunc('day', ts) + INTERVAL 1 DAY <= mark) AS BIGINT) AS n_late
FROM e JOIN w USING (b) GROUP BY e.b""",
)
def y1_late(spark, sf):
    """Events arrive in three slices of the same weeks, ten days of delay allowed: later slices hold late rows."""
    import uuid

    from pyspark.sql import Window

    run = uuid.uuid4().hex[:8]
    events = load(spark, sf, "events")
    src = scratch_path(spark, "stream", run, "in")
    out = scratch_path(spark, "stream", run, "out")
    ckpt = scratch_path(spark, "stream", run, "ckpt")
    batches = None
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(src)
        _, batches = Y.run_quality_stream(spark, src, events.schema, out, ckpt, "ts", "value", "1 day", "10 days")
    slices = F.row_number().over(Window.orderBy("batch_id")) - 1  # one row per micro-batch
    return batches.select(slices.cast("long").alias("slice"), "n_read", "n_on_time", "n_late")


def _psi_sql(col: str) -> str:
    edges = ", ".join(f"(SELECT quantile_cont({col}, {k / 10}) FROM ref) AS e{k}" for k in range(1, 10))
    b = " + ".join(f"CAST({col} >= e{k} AS INTEGER)" for k in range(1, 10))
    return f"""(WITH ref AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'), cur AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
e AS (SELECT {edges}),
rb AS (SELECT {b} AS bin, count(*) AS n FROM ref, e GROUP BY 1), cb AS (SELECT {b} AS bin, count(*) AS n FROM cur, e GROUP BY 1),
g AS (SELECT unnest(range(10)) AS bin),
j AS (SELECT g.bin, greatest(coalesce(rb.n, 0) / (SELECT sum(n) FROM rb), 1e-6) AS r, greatest(coalesce(cb.n, 0) / (SELECT sum(n) FROM cb), 1e-6) AS c
      FROM g LEFT JOIN rb USING (bin) LEFT JOIN cb USING (bin))
SELECT '{col}' AS column_name, round(sum((c - r) * ln(c / r)), 6) AS psi FROM j)"""


@register("y2_drift_psi", f"SELECT * FROM {_psi_sql('value')} UNION ALL SELECT * FROM {_psi_sql('user_id')}")
def y2(spark, sf):
    ev = load(spark, sf, "events")
    ref = ev.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    cur = ev.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return rounded(Y.drift_psi(ref, cur, ["value", "user_id"]))


def _orders_profile(spark, sf):
    from prepline.operators.profile import column_profile

    return column_profile(orders_missing(spark, sf))


def _plan_sql() -> str:
    from prepline.catalog.sqlgen import meta_values, name_type_sql, role_sql
    from prepline.sources.tables import ORDERS_MISSING_SQL

    miss = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({e}) AS n_missing FROM {ORDERS_MISSING_SQL}"
        for c, e in [
            ("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_orderstatus", "o_orderstatus"),
            ("o_totalprice", "CASE WHEN isnan(o_totalprice) THEN NULL ELSE o_totalprice END"), ("o_orderdate", "o_orderdate"),
            ("o_orderpriority", "o_orderpriority"),
        ]
    )
    return f"""WITH m AS (SELECT position, column_name, dtype, {name_type_sql()} AS t, {role_sql()} AS role FROM {meta_values('orders')}),
p AS (SELECT m.*, x.n_missing FROM m JOIN ({miss}) x USING (column_name) WHERE role = 'feature' OR (role = 'datetime' AND t = 'datetime')),
s AS (
  SELECT position, column_name, 'impute' AS step, CASE WHEN t = 'numeric' THEN 'mean' ELSE 'mode' END AS method FROM p WHERE n_missing > 0
  UNION ALL SELECT position, column_name, 'treat_outliers', 'clip_iqr' FROM p WHERE t = 'numeric'
  UNION ALL SELECT position, column_name, 'date_features', 'parts' FROM p WHERE t = 'datetime'
  UNION ALL SELECT position, column_name, 'encode', 'one_hot' FROM p WHERE t = 'categorical'
  UNION ALL SELECT position, column_name, 'encode', 'ordinal' FROM p WHERE t = 'text'
  UNION ALL SELECT position, column_name, 'scale', 'standard' FROM p WHERE t = 'numeric'
  UNION ALL SELECT NULL, NULL, 'split', 'hash_80_20')
SELECT position, column_name, step, method, CASE step WHEN 'impute' THEN 1 WHEN 'treat_outliers' THEN 2 WHEN 'date_features' THEN 3
  WHEN 'encode' THEN 4 WHEN 'scale' THEN 5 ELSE 6 END AS step_order FROM s"""


@register("f1_preprocessing_plan", _plan_sql())
def f1(spark, sf):
    return X.plan(_orders_profile(spark, sf), "supervised_classification")


def _test_row(key: str) -> str:
    from prepline.functions.exprs import lehmer_sql

    return f"CASE WHEN {lehmer_sql(key)} % 1000 < 200 THEN 'test' ELSE 'train' END"


def _f2_sql() -> str:
    from prepline.sources.tables import ORDERS_MISSING_SQL

    return f"""WITH s AS (SELECT * REPLACE (CASE WHEN isnan(o_totalprice) THEN NULL ELSE o_totalprice END AS o_totalprice), {_test_row('o_orderkey')} AS split FROM {ORDERS_MISSING_SQL}),
i AS (SELECT * REPLACE (coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM s WHERE split = 'train')) AS o_totalprice) FROM s),
b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM i WHERE split = 'train'),
c AS (SELECT i.* REPLACE (least(greatest(o_totalprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS o_totalprice) FROM i, b),
m AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM c WHERE split = 'train'),
l AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code FROM (SELECT DISTINCT o_orderstatus FROM c WHERE split = 'train'))
SELECT o_orderkey, o_custkey, o_orderpriority, round((o_totalprice - mean) / std, 6) + 0.0 AS o_totalprice, code AS o_orderstatus_code,
  CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday, CAST(hour(o_orderdate) AS INTEGER) AS o_orderdate_hour, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter,
  isodow(o_orderdate) >= 6 AS o_orderdate_is_weekend, split
FROM c LEFT JOIN l USING (o_orderstatus), m"""


@register("f2_execute_plan", _f2_sql())
def f2(spark, sf):
    o = orders_missing(spark, sf)
    steps = X.plan(_orders_profile(spark, sf), "supervised_classification")
    out = rounded(X.execute_plan(o, steps, "o_orderkey"))
    return out.withColumn("o_totalprice", F.col("o_totalprice") + 0.0)  # no -0.0


def _parts(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.col("p_type").alias("p_group"), "p_size", "p_retailprice")
    size = F.when(F.col("p_partkey") % 9 > 0, F.col("p_size"))
    group = F.when(F.col("p_partkey") % 8 > 0, F.col("p_group"))
    return p.withColumns({"p_size": size, "p_group": group})


@register(
    "f2_apply_fitted_after_reload",
    f"""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 8 > 0 THEN p_type END AS g, CAST(CASE WHEN p_partkey % 9 > 0 THEN p_size END AS DOUBLE) AS z, p_retailprice AS r, {_test_row('p_partkey')} AS split FROM part),
f AS (SELECT avg(z) AS fz, (SELECT g FROM s WHERE split = 'train' AND g IS NOT NULL GROUP BY g ORDER BY count(*) DESC, g LIMIT 1) AS fg FROM s WHERE split = 'train'),
i AS (SELECT p_partkey, coalesce(g, fg) AS g, coalesce(z, fz) AS z, r, split FROM s, f),
b AS (SELECT quantile_cont(z, 0.25) AS z1, quantile_cont(z, 0.75) AS z3, quantile_cont(r, 0.25) AS r1, quantile_cont(r, 0.75) AS r3 FROM i WHERE split = 'train'),
c AS (SELECT p_partkey, g, least(greatest(z, z1 - 1.5 * (z3 - z1)), z3 + 1.5 * (z3 - z1)) AS z, least(greatest(r, r1 - 1.5 * (r3 - r1)), r3 + 1.5 * (r3 - r1)) AS r, split FROM i, b),
m AS (SELECT avg(z) AS mz, stddev_pop(z) AS dz, avg(r) AS mr, stddev_pop(r) AS dr FROM c WHERE split = 'train')
SELECT p_partkey, g AS level, round((z - mz) / dz, 6) + 0.0 AS p_size, round((r - mr) / dr, 6) + 0.0 AS p_retailprice, split FROM c, m WHERE split = 'test'""",
)
def f2_reload(spark, sf):
    """Fitted on the training rows, exported, read back, applied to the test rows alone; the one-hot
    columns are folded back into the level they mark."""
    import uuid

    from prepline.operators.profile import column_profile

    parts = _parts(spark, sf)
    steps = X.plan(column_profile(parts), "supervised_classification")
    path = scratch_path(spark, "fitted", uuid.uuid4().hex)
    X.fit_on_train(parts, steps, "p_partkey").write.parquet(path)
    test = X.FE.train_test_split(parts, "p_partkey").where("split = 'test'").drop("split")
    out = X.apply_plan(test, spark.read.parquet(path))
    level = F.coalesce(*[F.when(F.col(f"`{c}`") == 1, c.removeprefix("p_group_")) for c in out.columns if c.startswith("p_group_")])
    out = rounded(out.select("p_partkey", level.alias("level"), "p_size", "p_retailprice", "split"))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("p_size", "p_retailprice")})  # no -0.0


@register("e12_model_report", None)
def e12(spark, sf):
    model, pred, run = T.train("Random Forest", doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"])
    metrics = E.evaluate(pred.withColumnRenamed("quality", "label"), "supervised_classification")
    imp = T.feature_importance(model.stages[-1], DOC_FEATURES, spark)
    return E.model_report(run, metrics, imp)


@register("x1_save_load_pipeline", "SELECT doc_id, true AS same FROM documents JOIN labels USING (doc_id)")
def x1(spark, sf):
    model, pred, _ = T.train("Logistic Regression", doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"])
    path = scratch_path(spark, "models", "doc_quality_lr")
    T.save_model(model, path)
    loaded = T.load_model(path)
    again = loaded.transform(doc_features(spark, sf).withColumns({c: F.col(c).cast("double") for c in DOC_FEATURES})).select("doc_id", F.col("prediction").alias("p2"))
    return pred.join(again, "doc_id").select("doc_id", (F.col("prediction") == F.col("p2")).alias("same"))


@register("x2_export_package", None)
def x2(spark, sf):
    model, pred, run = T.train("Logistic Regression", doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"])
    metrics = E.evaluate(pred.withColumnRenamed("quality", "label"), "supervised_classification")
    return X.export_package(scratch_path(spark, "export", "doc_quality"), {"metrics": metrics, "run": run}, model)


@register("x3_end_to_end_customer_segment", None)
def x3(spark, sf):
    return _x3_run(spark, sf)


def _x3_run(spark, sf):
    """Customer table with the segment as a numeric class label."""
    cust = load(spark, sf, "customer")
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    label = F.coalesce(*[F.when(F.col("c_mktsegment") == s, F.lit(float(i))) for i, s in enumerate(segs)], F.lit(float(len(segs))))
    path = scratch_path(spark, "runs", "customer_input.parquet")
    cust.withColumn("segment_label", label).drop("c_mktsegment").write.mode("overwrite").parquet(path)
    return X.end_to_end(
        spark,
        path,
        "Classify customers into segment classes; the business goal is targeting",
        target="segment_label",
        key="c_custkey",
        out_root=scratch_path(spark, "runs", "customer_out"),
        drop=("c_name",),
    )


@register("v6_learning_curve", None)
def v6(spark, sf):
    from prepline.functions.exprs import lehmer

    data = T.slim(doc_features(spark, sf), ["doc_id", "quality"], DOC_FEATURES)  # the texts are read once for all fractions

    rows = None
    for frac in (0.25, 0.5, 1.0):
        part = data.where(lehmer(F.col("doc_id")) % 100 < int(frac * 100))
        _, pred, _ = T.train("Logistic Regression", part, DOC_FEATURES, "quality", ["doc_id"])
        acc = pred.agg(F.avg((F.col("prediction") == F.col("quality")).cast("double")).alias("train_accuracy"), F.count(F.lit(1)).alias("n_train"))
        acc = acc.select(F.lit(frac).alias("fraction"), "n_train", "train_accuracy")
        rows = acc if rows is None else rows.unionByName(acc)
    return rows


@register("v7_cluster_scatter", None)
def v7(spark, sf):
    emb = load(spark, sf, "embeddings")
    n = emb.agg(F.max(F.size("embedding"))).first()[0] or 0
    wide = emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])
    _, proj, _ = T.pca(wide, [f"e{i}" for i in range(n)], ["vec_id", "label"], k=2)
    return proj.select("vec_id", F.col("label").alias("cluster"), F.col("pcs")[0].alias("pc1"), F.col("pcs")[1].alias("pc2"))

