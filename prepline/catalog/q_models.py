"""Registered model queries (T1-T26). Fitted-model outputs are checked for row counts (and
invariants in tests); closed-form pieces (OLS with one feature, a Lloyd step, statistical
flags, voting, the training spec) also have SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepline.catalog import register
from prepline.catalog.q_eval import DOC_PRED_SQL
from prepline.catalog.q_profile import rounded
from prepline.operators import intent as M
from prepline.operators import models as T
from prepline.sources.tables import LINEITEM_OUTLIER_SQL, lineitem_outlier, load

DOC_FEATURES = ["n_chars", "n_lines", "n_words", "lang_code"]
LANGS = ["de", "en", "es", "fr"]


def doc_features(spark, sf, labelled_only: bool = True):
    """Numeric features of each document (whole text) joined with its quality label."""
    d = load(spark, sf, "documents")
    lab = load(spark, sf, "labels").select("doc_id", "quality", "toxic")
    lang_code = F.coalesce(*[F.when(F.col("lang") == lv, F.lit(float(i))) for i, lv in enumerate(LANGS)], F.lit(float(len(LANGS))))

    def pieces(by):
        # NULL where the text is, and Spark sees that: whether a count is there is known without counting
        return F.when(F.col("text").isNotNull(), F.coalesce(F.size(F.split("text", by)), F.lit(0)))

    feats = d.select("doc_id", "n_chars", pieces("\n").alias("n_lines"), pieces("\\s+").alias("n_words"), lang_code.alias("lang_code"))
    return feats.join(lab, "doc_id", "inner" if labelled_only else "left").withColumn("quality", F.col("quality").cast("double"))


def _lineitem_reg(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return li


@register(
    "t1_training_spec",
    f"""WITH cat AS (SELECT * FROM (VALUES {', '.join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in M.MODEL_CATALOGUE)})
  AS c(family, model_name, model_type, priority, min_samples, complexity, interpretability, performance_expectation, training_time)),
n AS (SELECT count(*) AS n_rows FROM labels)
SELECT model_name, priority, CASE WHEN model_name IN ('Random Forest', 'Logistic Regression', 'Gradient Boosting') THEN 'accuracy,precision,recall,f1'
  WHEN model_name IN ('Random Forest Regressor', 'Linear Regression') THEN 'mse,rmse,mae,r2' ELSE 'inertia,silhouette' END AS metrics, 5 AS cv_folds
FROM cat, n WHERE family = 'classification' AND n_rows >= min_samples""",
)
def t1(spark, sf):
    from prepline.catalog.q_rules import light_profile
    from prepline.operators.rules import data_facts

    req = spark.createDataFrame([("supervised_classification",)], "problem_type string")
    facts = data_facts(light_profile(load(spark, sf, "labels")))
    models = M.recommend_models(req, facts)
    return T.training_spec(models).select("model_name", "priority", "metrics", "cv_folds")


@register("t2_train_pipeline_random_forest", None)
def t2(spark, sf):
    _, pred, _ = T.train("Random Forest", doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"])
    return pred


@register(
    "t3_linear_regression_one_feature",
    "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS coef FROM lineitem",
)
def t3(spark, sf):
    model, _ = T.linear_regression(_lineitem_reg(spark, sf), ["l_quantity"], "l_extendedprice", ["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(round(float(model.intercept), 4), round(float(model.coefficients[0]), 6))], "intercept double, coef double").where(
        F.lit(True)
    )


@register("t3_linear_regression_predictions", None)
def t3p(spark, sf):
    _, pred = T.linear_regression(_lineitem_reg(spark, sf), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["l_orderkey", "l_linenumber"])
    return pred


@register("t4_logistic_regression", None)
def t4(spark, sf):
    return T.logistic_regression(doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"])[1]


@register("t5_random_forest_classifier", None)
def t5(spark, sf):
    return T.random_forest(doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"], numTrees=20)[1]


@register("t5_random_forest_regressor", None)
def t5r(spark, sf):
    return T.random_forest(_lineitem_reg(spark, sf), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["l_orderkey", "l_linenumber"], task="regression", numTrees=20)[1]


@register("t6_gradient_boosting", None)
def t6(spark, sf):
    return T.gradient_boosting(doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"], maxIter=10)[1]


@register("t6_gradient_boosting_multiclass", None)
def t6m(spark, sf):
    ev = load(spark, sf, "events")
    types = ["click", "error", "purchase", "signup", "view"]
    lab = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(float(i))) for i, t in enumerate(types)])
    data = ev.select("event_id", F.col("value").cast("double").alias("value"), F.col("user_id").cast("double").alias("user"), lab.alias("label"))
    return T.gradient_boosting(data, ["value", "user"], "label", ["event_id"], n_classes=5, maxIter=5)[1]


@register("t7_linear_svm", None)
def t7(spark, sf):
    return T.linear_svm(doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"], maxIter=20)[1]


@register("t8_kmeans_embeddings", None)
def t8(spark, sf):
    return T.kmeans(load(spark, sf, "embeddings"), "embedding", ["vec_id"], k=10)[1]


_CENTERS_SQL = """cen AS (SELECT c AS center_id, list(m ORDER BY i) AS center FROM (SELECT c, i, avg(v) AS m FROM
  (SELECT label AS c, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY c, i) GROUP BY c)"""


def _initial_centers(spark, sf):
    emb = load(spark, sf, "embeddings")
    ex = emb.select(F.col("label").alias("center_id"), F.posexplode(F.transform("embedding", lambda v: v.cast("double"))).alias("pos", "v"))
    m = ex.groupBy("center_id", "pos").agg(F.avg("v").alias("m"))
    return m.groupBy("center_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("center"))


@register(
    "t8_lloyd_step",
    f"""WITH {_CENTERS_SQL},
p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
a AS (SELECT vec_id, arg_min(center_id, (list_sum(list_transform(list_zip(x, center), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), center_id)) AS center_id FROM p, cen GROUP BY vec_id),
nm AS (SELECT center_id, list(m ORDER BY i) AS new_center, max(n) AS n FROM (SELECT center_id, i, avg(v) AS m, count(*) AS n FROM
  (SELECT a.center_id, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS i FROM a JOIN p USING (vec_id)) GROUP BY 1, 2) GROUP BY 1)
SELECT cen.center_id, list_transform(coalesce(nm.new_center, cen.center), lambda v: round(v, 6)) AS center, CAST(coalesce(nm.n, 0) AS BIGINT) AS n
FROM cen LEFT JOIN nm USING (center_id)""",
)
def t8s(spark, sf):
    step = T.lloyd_step(load(spark, sf, "embeddings"), "vec_id", "embedding", _initial_centers(spark, sf))
    return step.select("center_id", F.transform("center", lambda v: F.round(v, 6)).alias("center"), "n")


@register("t10_bisecting_kmeans", None)
def t10(spark, sf):
    return T.bisecting_kmeans(load(spark, sf, "embeddings"), "embedding", ["vec_id"], k=10)[1]


@register("t10_gaussian_mixture", None)
def t10g(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity"), F.col("l_discount") * 100).alias("v"))
    return T.gaussian_mixture(li, "v", ["l_orderkey", "l_linenumber"], k=3)[1]


@register("t11_pca_variance_ratios", None)
def t11(spark, sf):
    li = load(spark, sf, "lineitem")
    _, _, ratios = T.pca(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"], k=2)
    return ratios


@register("t11_pca_projection", None)
def t11p(spark, sf):
    li = load(spark, sf, "lineitem")
    return T.pca(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"], k=2)[1]


@register("t12_isolation_forest", None)
def t12(spark, sf):
    li = lineitem_outlier(spark, sf).withColumn("row_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return T.isolation_forest(li, ["l_extendedprice", "l_quantity"], "row_key", n_trees=50)


@register(
    "t13_statistical_anomalies",
    f"""WITH src AS (SELECT * FROM {LINEITEM_OUTLIER_SQL}),
g AS (SELECT l_returnflag, avg(l_extendedprice) m, stddev_samp(l_extendedprice) sd, quantile_cont(l_extendedprice, 0.25) q1,
  quantile_cont(l_extendedprice, 0.5) med, quantile_cont(l_extendedprice, 0.75) q3 FROM src GROUP BY 1),
mad AS (SELECT l_returnflag, quantile_cont(abs(l_extendedprice - med), 0.5) AS mad FROM src JOIN g USING (l_returnflag) GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, coalesce(abs((l_extendedprice - m) / sd) > 3, false) AS z_flag,
  coalesce(CASE WHEN mad > 0 THEN abs(0.6745 * (l_extendedprice - med) / mad) > 3.5 END, false) AS mad_flag,
  l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1) AS iqr_flag
FROM src JOIN g USING (l_returnflag) JOIN mad USING (l_returnflag)""",
)
def t13(spark, sf):
    return T.statistical_anomalies(lineitem_outlier(spark, sf), "l_extendedprice", ["l_returnflag"], ["l_orderkey", "l_linenumber"])


def _rule_predictions(spark, sf):
    from prepline.catalog.q_eval import doc_predictions

    base = doc_predictions(spark, sf)
    a = base.select("doc_id", F.lit("m1").alias("model"), F.col("prediction"))
    b = base.select("doc_id", F.lit("m2").alias("model"), (F.col("doc_id") % 2).cast("int").alias("prediction"))
    c = base.select("doc_id", F.lit("m3").alias("model"), (F.col("score") >= 0.3).cast("int").alias("prediction"))
    return a.unionByName(b).unionByName(c)


@register(
    "t15_vote_majority",
    f"""WITH p AS (SELECT doc_id, 'm1' AS model, prediction FROM {DOC_PRED_SQL}
  UNION ALL SELECT doc_id, 'm2', CAST(doc_id % 2 AS INTEGER) FROM {DOC_PRED_SQL}
  UNION ALL SELECT doc_id, 'm3', CAST(score >= 0.3 AS INTEGER) FROM {DOC_PRED_SQL}),
c AS (SELECT doc_id, prediction, count(*) AS n FROM p GROUP BY 1, 2)
SELECT doc_id, arg_min(prediction, (-n, prediction)) AS prediction, CAST(sum(n) AS BIGINT) AS n_models FROM c GROUP BY doc_id""",
)
def t15(spark, sf):
    return T.vote(_rule_predictions(spark, sf), "doc_id")


@register("t16_bagging", None)
def t16(spark, sf):
    return T.bagging(doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"], n_bags=3)


@register("t17_mlp", None)
def t17(spark, sf):
    return T.mlp(doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"], hidden=(6,), maxIter=50)[1]


@register("t21_self_training", None)
def t21(spark, sf):
    return T.self_training(doc_features(spark, sf, labelled_only=False), DOC_FEATURES, "quality", "doc_id", threshold=0.9)[1]


@register("t23_series_classification", None)
def t23(spark, sf):
    ev = load(spark, sf, "events")
    feats = T.series_features(ev, "user_id", "value")
    label = ev.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("np"), F.count(F.lit(1)).alias("n"))
    label = label.select("user_id", (F.col("np") * 5 > F.col("n")).cast("double").alias("label"))
    data = feats.join(label, "user_id")
    return T.random_forest(data, ["n", "mean", "std", "min", "max", "skew", "kurt"], "label", ["user_id"], numTrees=20)[1]


@register("t24_feature_importance", None)
def t24(spark, sf):
    model, _ = T.random_forest(doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"], numTrees=20)
    return T.feature_importance(model, DOC_FEATURES, spark)


@register("t25_hyperparameter_search", None)
def t25(spark, sf):
    return T.tune(doc_features(spark, sf), DOC_FEATURES, "quality", "doc_id", folds=3, grid={"numTrees": [5, 10], "maxDepth": [2, 4]})[1]


@register("t26_batch_prediction", None)
def t26(spark, sf):
    model, _, _ = T.train("Logistic Regression", doc_features(spark, sf), DOC_FEATURES, "quality", ["doc_id"])
    unlabelled = doc_features(spark, sf, labelled_only=False).where(F.col("quality").isNull()).drop("quality", "toxic")
    return model.transform(unlabelled.withColumns({c: F.col(c).cast("double") for c in DOC_FEATURES})).select("doc_id", "prediction")



def _dbscan_sql(points: str, key: str, eps: float, min_samples: int) -> str:
    """By definition: all pairs, and the smallest core key that a recursive walk reaches."""
    return f"""WITH RECURSIVE p AS ({points}),
nb AS (SELECT a.k, b.k AS n FROM p a JOIN p b ON b.x BETWEEN a.x - {eps} - 1e-9 AND a.x + {eps} + 1e-9
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps} * {eps}),
core AS (SELECT k FROM nb GROUP BY k HAVING count(*) >= {min_samples}),
e AS (SELECT k, n FROM nb WHERE k IN (FROM core) AND n IN (FROM core)),
walk AS (SELECT k, k AS root FROM core UNION SELECT e.n, w.root FROM walk w JOIN e ON e.k = w.k WHERE w.root < e.n),
label AS (SELECT k, min(root) AS c FROM walk GROUP BY k),
border AS (SELECT nb.k, min(n) AS c FROM nb WHERE nb.k NOT IN (FROM core) AND n IN (FROM core) GROUP BY nb.k)
SELECT p.k AS {key}, CAST(coalesce(l.c, lb.c, -1) AS BIGINT) AS cluster, l.k IS NOT NULL AS is_core
FROM p LEFT JOIN label l ON p.k = l.k LEFT JOIN border b ON p.k = b.k LEFT JOIN label lb ON lb.k = b.c"""


@register(
    "t9_dbscan_orders",
    _dbscan_sql("SELECT o_orderkey AS k, o_totalprice / 10000 AS x, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 30.0::DOUBLE AS y FROM orders", "o_orderkey", 0.5, 40),
)
def t9(spark, sf):
    """Orders as 2-D points: (total price / 10000, days since 1995-01-01 / 30)."""
    from prepline.operators.density import dbscan

    o = load(spark, sf, "orders").select(
        "o_orderkey",
        F.array(F.col("o_totalprice") / 10000, F.datediff(F.col("o_orderdate"), F.lit("1995-01-01")) / 30.0).alias("v"),
    )
    return dbscan(o, "o_orderkey", "v", eps=0.5, min_samples=40)


@register(
    "t9_dbscan_customers",
    _dbscan_sql("SELECT c_custkey AS k, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal / 1000 END AS x, c_nationkey / 4.0::DOUBLE AS y FROM customer", "c_custkey", 0.4, 8),
)
def t9_customers(spark, sf):
    """Customers as (balance / 1000, nation / 4); every ninth has no point and is noise."""
    from prepline.operators.density import dbscan

    c = load(spark, sf, "customer")
    v = F.when(F.col("c_custkey") % 9 > 0, F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey") / 4.0))
    return dbscan(c.select("c_custkey", v.alias("v")), "c_custkey", "v", eps=0.4, min_samples=8)


@register("t22_label_propagation_documents", None)
def t22(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang", "source")
    lab = load(spark, sf, "labels").select("doc_id", "quality")
    return T.label_propagation(d.join(lab, "doc_id", "left"), "doc_id", "quality", ["lang", "source"])


@register(
    "t22_label_propagation_step",
    """WITH d AS (SELECT doc_id, lang, source, CAST(quality AS DOUBLE) AS y FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT doc_id, y, 'lang=' || lang AS g FROM d UNION ALL SELECT doc_id, y, 'source=' || source FROM d),
v AS (SELECT g, avg(y) AS gs FROM m GROUP BY g),
u AS (SELECT doc_id, avg(gs) AS s FROM m JOIN v USING (g) GROUP BY doc_id)
SELECT doc_id, y AS quality, round(coalesce(y, s), 6) AS score, CAST(floor(coalesce(y, s) + 0.5) AS BIGINT) AS prediction FROM d JOIN u USING (doc_id)""",
)
def t22_step(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang", "source")
    lab = load(spark, sf, "labels").select("doc_id", "quality")
    return rounded(T.label_propagation(d.join(lab, "doc_id", "left"), "doc_id", "quality", ["lang", "source"], rounds=1))
