"""Registered evaluation queries (E1-E11) over prediction tables made by fixed rules from the
driver tables (no model needed; a model's predictions have the same shape)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepline.catalog import register
from prepline.catalog.q_profile import rounded
from prepline.functions.exprs import lehmer_sql
from prepline.operators import evaluate as E
from prepline.sources.tables import load

EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]


def doc_predictions(spark, sf):
    """label = quality; score and prediction from a fixed rule on n_chars."""
    d = load(spark, sf, "documents").select("doc_id", "n_chars")
    lab = load(spark, sf, "labels").select("doc_id", "quality")
    score = (F.col("n_chars") % 1000) / 1000.0
    return d.join(lab, "doc_id").select("doc_id", F.col("quality").alias("label"), score.alias("score"), (score >= 0.5).cast("int").alias("prediction"))


DOC_PRED_SQL = """(SELECT doc_id, quality AS label, (n_chars % 1000) / 1000.0 AS score, CAST((n_chars % 1000) / 1000.0 >= 0.5 AS INTEGER) AS prediction
FROM documents JOIN labels USING (doc_id))"""


def event_predictions(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    arr = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return ev.select("event_id", F.col("event_type").alias("label"), F.element_at(arr, (F.col("user_id") % 5 + 1).cast("int")).alias("prediction"))


EVENT_PRED_SQL = f"(SELECT event_id, event_type AS label, {[*EVENT_TYPES]}[user_id % 5 + 1] AS prediction FROM events)"


def price_predictions(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice")
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return li.join(p, "l_partkey").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("prediction")
    )


PRICE_PRED_SQL = """(SELECT l_orderkey, l_linenumber, l_extendedprice AS label, l_quantity * p_retailprice * (1 - l_discount) AS prediction
FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _metrics_sql(rows: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, round(CAST({expr} AS DOUBLE), 6) AS value FROM {source}" for m, expr in rows)


def _report_sql(src: str) -> str:
    return f"""(WITH cm AS (SELECT label, prediction, count(*) n FROM {src} GROUP BY 1, 2),
sup AS (SELECT label AS class, sum(n) support FROM cm GROUP BY 1), prd AS (SELECT prediction AS class, sum(n) predicted FROM cm GROUP BY 1),
tp AS (SELECT label AS class, n AS tp FROM cm WHERE label = prediction),
cls AS (SELECT class FROM sup UNION SELECT class FROM prd),
t AS (SELECT class, coalesce(support, 0) support, coalesce(predicted, 0) predicted, coalesce(tp, 0) tp FROM cls LEFT JOIN sup USING (class) LEFT JOIN prd USING (class) LEFT JOIN tp USING (class)),
m AS (SELECT class, CASE WHEN predicted = 0 THEN NULL ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN NULL ELSE tp / support END AS recall, support FROM t)
SELECT class, precision, recall, CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall) END AS f1, CAST(support AS BIGINT) AS support FROM m)"""


def _cls_metrics_sql(src: str, positive=None) -> str:
    rep = _report_sql(src)
    rows = [
        ("accuracy", f"max((SELECT count(*) FILTER (WHERE label = prediction) / count(*) FROM {src}))"),
        ("precision_macro", "avg(precision)"),
        ("recall_macro", "avg(recall)"),
        ("f1_macro", "avg(f1)"),
        ("precision_weighted", "sum(precision * support) / sum(support)"),
        ("recall_weighted", "sum(recall * support) / sum(support)"),
        ("f1_weighted", "sum(f1 * support) / sum(support)"),
    ]
    if positive is not None:
        rows += [(m, f"max({m}) FILTER (WHERE class = {positive})") for m in ("precision", "recall", "f1")]
    return _metrics_sql(rows, rep)


@register("e1_classification_metrics_binary", _cls_metrics_sql(DOC_PRED_SQL, positive=1))
def e1b(spark, sf):
    return rounded(E.classification_metrics(doc_predictions(spark, sf), positive=1))


@register("e1_classification_metrics_multiclass", _cls_metrics_sql(EVENT_PRED_SQL))
def e1m(spark, sf):
    return rounded(E.classification_metrics(event_predictions(spark, sf)))


@register(
    "e2_roc_auc",
    f"""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM {DOC_PRED_SQL})
SELECT 'roc_auc' AS metric, round((sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)), 6) AS value FROM r""",
)
def e2(spark, sf):
    return rounded(E.roc_auc(doc_predictions(spark, sf)))


@register("e3_confusion_matrix", f"SELECT label, prediction, count(*) AS n FROM {EVENT_PRED_SQL} GROUP BY 1, 2")
def e3(spark, sf):
    return E.confusion_matrix(event_predictions(spark, sf))


@register("e4_classification_report", f"SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM {_report_sql(EVENT_PRED_SQL)}")
def e4(spark, sf):
    return rounded(E.classification_report(event_predictions(spark, sf)))


@register(
    "e5_regression_metrics",
    _metrics_sql(
        [
            ("mse", "avg((prediction - label) * (prediction - label))"),
            ("rmse", "sqrt(avg((prediction - label) * (prediction - label)))"),
            ("mae", "avg(abs(prediction - label))"),
            ("r2", "1 - sum((prediction - label) * (prediction - label)) / nullif(var_pop(label) * count(label), 0)"),
            ("mape", "avg(CASE WHEN label <> 0 THEN abs((prediction - label) / label) END)"),
        ],
        PRICE_PRED_SQL,
    ),
)
def e5(spark, sf):
    return rounded(E.regression_metrics(price_predictions(spark, sf)))


_EMB = "(SELECT vec_id, label AS c, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_CL = f"""p AS {_EMB},
ex AS (SELECT c, i, avg(v) AS m FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p) GROUP BY c, i),
cen AS (SELECT c, list(m ORDER BY i) AS centroid FROM ex GROUP BY c),
st AS (SELECT c, count(*) AS n, sum(list_inner_product(x, x)) AS sq FROM p GROUP BY c),
cl AS (SELECT st.c, n, sq, centroid FROM st JOIN cen USING (c))"""


@register(
    "e6_silhouette_sq",
    f"""WITH {_CL},
d AS (SELECT p.vec_id, p.c AS own, cl.c AS other, cl.n, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, cl.centroid) + cl.sq / cl.n AS md FROM p, cl),
s AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS own_n, max(CASE WHEN own = other THEN md * n / (n - 1) END) AS a,
      min(CASE WHEN own <> other THEN md END) AS b FROM d GROUP BY vec_id)
SELECT 'silhouette_sq' AS metric, round(avg(CASE WHEN own_n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS value FROM s""",
)
def e6(spark, sf):
    return rounded(E.silhouette(load(spark, sf, "embeddings"), "embedding", "label"))


@register(
    "e7_cluster_metrics",
    f"""WITH {_CL},
pt AS (SELECT p.c, list_distance(p.x, cl.centroid) AS d FROM p JOIN cl USING (c)),
per AS (SELECT c, sum(d * d) AS w, avg(d) AS scatter, count(*) AS n FROM pt GROUP BY c),
g AS (SELECT list(m ORDER BY i) AS gm FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p) GROUP BY i)),
bw AS (SELECT sum(cl.n * list_distance(cl.centroid, g.gm) * list_distance(cl.centroid, g.gm)) AS B FROM cl, g),
wt AS (SELECT sum(w) AS W, sum(n) AS N, count(*) AS K FROM per),
db AS (SELECT avg(r) AS v FROM (SELECT a.c, max((a.scatter + b.scatter) / list_distance(ca.centroid, cb.centroid)) AS r
       FROM per a JOIN cl ca ON ca.c = a.c JOIN per b ON b.c <> a.c JOIN cl cb ON cb.c = b.c GROUP BY a.c))
SELECT 'inertia' AS metric, round(W, 6) AS value FROM wt
UNION ALL SELECT 'calinski_harabasz', round((B / (K - 1)) / (W / (N - K)), 6) FROM wt, bw
UNION ALL SELECT 'davies_bouldin', round(v, 6) FROM db""",
)
def e7(spark, sf):
    return rounded(E.cluster_metrics(load(spark, sf, "embeddings"), "embedding", "label"))


@register("e8_kfold", f"SELECT o_orderkey, CAST(({lehmer_sql('o_orderkey')}) % 5 AS INTEGER) AS fold FROM orders")
def e8(spark, sf):
    return E.kfold(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@register(
    "e9_stratified_kfold",
    f"""SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY ({lehmer_sql('o_orderkey')}), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""",
)
def e9(spark, sf):
    return E.stratified_kfold(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5)


@register(
    "e10_time_series_split",
    "SELECT event_id, ts, CAST(floor((rank() OVER (ORDER BY ts) - 1) * 6 / (SELECT count(*) FROM events)) AS INTEGER) AS fold FROM events",
)
def e10(spark, sf):
    return E.time_series_split(load(spark, sf, "events").select("event_id", "ts"), "ts", 5)


@register(
    "e11_evaluate_classification",
    _cls_metrics_sql(DOC_PRED_SQL)
    + f""" UNION ALL SELECT 'roc_auc' AS metric, round((sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)), 6) FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM {DOC_PRED_SQL})""",
)
def e11(spark, sf):
    return rounded(E.evaluate(doc_predictions(spark, sf), "supervised_classification", score="score"))
