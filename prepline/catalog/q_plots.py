"""Registered plot-data queries (V1-V5, V8)."""

from __future__ import annotations

from prepline.catalog import register
from prepline.catalog.q_eval import DOC_PRED_SQL, PRICE_PRED_SQL, doc_predictions, price_predictions
from prepline.catalog.q_profile import rounded
from prepline.functions.exprs import lehmer_sql
from prepline.operators import plots as V
from prepline.sources.tables import lineitem_outlier, load, LINEITEM_OUTLIER_SQL


@register(
    "v1_histogram",
    """WITH mm AS (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part),
b AS (SELECT CAST(CASE WHEN (hi - lo) / 10 = 0 THEN 0 ELSE least(floor((p_retailprice - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin, lo, hi FROM part, mm)
SELECT bin, round(lo + bin * (hi - lo) / 10, 6) AS lo, round(lo + (bin + 1) * (hi - lo) / 10, 6) AS hi, count(*) AS n FROM b GROUP BY bin, b.lo, b.hi""",
)
def v1(spark, sf):
    return rounded(V.histogram(load(spark, sf, "part"), "p_retailprice", 10))


_BOX_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _box_sql() -> str:
    ctes, parts = [], []
    for i, c in enumerate(_BOX_COLS):
        ctes.append(
            f"""f{i} AS (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lf,
  quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS uf FROM src)"""
        )
        q = [f"(SELECT round(quantile_cont({c}, {p}), 6) FROM src)" for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
        parts.append(
            f"""SELECT '{c}' AS column_name, {q[0]} AS min, {q[1]} AS q1, {q[2]} AS median, {q[3]} AS q3, {q[4]} AS max,
  (SELECT round(min({c}), 6) FROM src, f{i} WHERE {c} >= f{i}.lf) AS whisker_low, (SELECT round(max({c}), 6) FROM src, f{i} WHERE {c} <= f{i}.uf) AS whisker_high,
  (SELECT count(*) FROM src, f{i} WHERE {c} < f{i}.lf OR {c} > f{i}.uf) AS n_outliers"""
        )
    return f"WITH src AS (SELECT * FROM {LINEITEM_OUTLIER_SQL}), {', '.join(ctes)} " + " UNION ALL ".join(parts)


@register("v2_boxplot", _box_sql())
def v2(spark, sf):
    return rounded(V.boxplot(lineitem_outlier(spark, sf), _BOX_COLS))


@register(
    "v3_scatter_sample",
    f"SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE ({lehmer_sql('l_orderkey')}) % 10000 < 1000",
)
def v3(spark, sf):
    return V.scatter_sample(load(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice", 0.1)


@register(
    "v4_roc_curve",
    f"""WITH per AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM {DOC_PRED_SQL} GROUP BY score),
t AS (SELECT sum(pos) P, sum(neg) N FROM per)
SELECT round(score, 6) AS threshold, round(sum(pos) OVER (ORDER BY score DESC) / P, 6) AS tpr, round(sum(neg) OVER (ORDER BY score DESC) / N, 6) AS fpr FROM per, t""",
)
def v4(spark, sf):
    return rounded(V.roc_curve(doc_predictions(spark, sf)))


@register("v5_residuals", f"SELECT l_orderkey, l_linenumber, round(label, 6) AS label, round(prediction, 6) AS prediction, round(label - prediction, 6) AS residual FROM {PRICE_PRED_SQL}")
def v5(spark, sf):
    return rounded(V.residuals(price_predictions(spark, sf), ["l_orderkey", "l_linenumber"]))


@register(
    "v8_silhouette_rows",
    """WITH p AS (SELECT vec_id, label AS c, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ex AS (SELECT c, i, avg(v) AS m FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p) GROUP BY c, i),
cen AS (SELECT c, list(m ORDER BY i) AS centroid FROM ex GROUP BY c),
st AS (SELECT c, count(*) AS n, sum(list_inner_product(x, x)) AS sq FROM p GROUP BY c),
cl AS (SELECT st.c, n, sq, centroid FROM st JOIN cen USING (c)),
d AS (SELECT p.vec_id, p.c AS own, cl.c AS other, cl.n, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, cl.centroid) + cl.sq / cl.n AS md FROM p, cl),
s AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS own_n, max(CASE WHEN own = other THEN md * n / (n - 1) END) AS a,
      min(CASE WHEN own <> other THEN md END) AS b FROM d GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN own_n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""",
)
def v8(spark, sf):
    return rounded(V.silhouette_rows(load(spark, sf, "embeddings"), "embedding", "label").select("vec_id", "silhouette"))
