"""Registered preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepline.catalog import register
from prepline.catalog.q_profile import rounded
from prepline.functions.exprs import lehmer_sql
from prepline.operators import features as FE
from prepline.sources.tables import (
    LINEITEM_OUTLIER_SQL,
    ORDERS_MISSING_SQL,
    lineitem_outlier,
    load,
    orders_missing,
)

TP = "(CASE WHEN isnan(o_totalprice) THEN NULL ELSE o_totalprice END)"
LI3 = ["l_quantity", "l_extendedprice", "l_discount"]


def _r(x: str, places: int = 6) -> str:
    return f"round({x}, {places})"


# ------------------------------------------------------------------ F3, F4, F5

@register(
    "f3_impute_mean",
    f"SELECT o_orderkey, {_r(f'coalesce({TP}, (SELECT avg({TP}) FROM {ORDERS_MISSING_SQL}))')} AS o_totalprice FROM {ORDERS_MISSING_SQL}",
)
def f3a(spark, sf):
    return rounded(FE.impute(orders_missing(spark, sf).select("o_orderkey", "o_totalprice"), ["o_totalprice"], "mean"))


@register(
    "f3_impute_median",
    f"SELECT o_orderkey, {_r(f'coalesce({TP}, (SELECT quantile_cont({TP}, 0.5) FROM {ORDERS_MISSING_SQL}))')} AS o_totalprice FROM {ORDERS_MISSING_SQL}",
)
def f3b(spark, sf):
    return rounded(FE.impute(orders_missing(spark, sf).select("o_orderkey", "o_totalprice"), ["o_totalprice"], "median"))


@register(
    "f3_impute_mode",
    f"""SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {ORDERS_MISSING_SQL} WHERE o_orderpriority IS NOT NULL
  GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM {ORDERS_MISSING_SQL}""",
)
def f3c(spark, sf):
    return FE.impute(orders_missing(spark, sf).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "mode")


@register("f3_impute_constant", f"SELECT o_orderkey, coalesce({TP}, 0.0) AS o_totalprice FROM {ORDERS_MISSING_SQL}")
def f3d(spark, sf):
    return FE.impute(orders_missing(spark, sf).select("o_orderkey", "o_totalprice"), ["o_totalprice"], "constant", 0.0)


@register(
    "f4_missing_indicator",
    f"""SELECT o_orderkey, o_totalprice IS NULL OR isnan(o_totalprice) AS tp_null, CAST(o_totalprice IS NULL OR isnan(o_totalprice) AS INTEGER) AS o_totalprice_missing,
  CAST(o_orderpriority IS NULL AS INTEGER) AS o_orderpriority_missing FROM {ORDERS_MISSING_SQL}""",
)
def f4(spark, sf):
    o = orders_missing(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = FE.missing_indicator(o, ["o_totalprice", "o_orderpriority"])
    return out.select("o_orderkey", (F.col("o_totalprice").isNull() | F.isnan("o_totalprice")).alias("tp_null"), "o_totalprice_missing", "o_orderpriority_missing")


_EV_GAPS = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events)"


def _events_gaps(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return ev.withColumn("value", F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value")))


@register(
    "f5_impute_time_ffill",
    f"""SELECT event_id, user_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM {_EV_GAPS}""",
)
def f5(spark, sf):
    return FE.impute_time(_events_gaps(spark, sf), "ts", "value", ["user_id"], "ffill")


@register(
    "f5_impute_time_linear",
    f"""WITH b AS (SELECT *, epoch_us(ts) AS t,
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt
FROM {_EV_GAPS})
SELECT event_id, user_id, ts, round(CASE WHEN value IS NOT NULL THEN value WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END, 6) AS value FROM b""",
)
def f5l(spark, sf):
    return rounded(FE.impute_time(_events_gaps(spark, sf), "ts", "value", ["user_id"], "linear"))


# ------------------------------------------------------------------ F6, F7, F8

def _scale_sql(method: str) -> str:
    cols = []
    for c in LI3:
        if method == "standard":
            center, spread = f"(SELECT avg({c}) FROM lineitem)", f"(SELECT stddev_pop({c}) FROM lineitem)"
        elif method == "minmax":
            center, spread = f"(SELECT min({c}) FROM lineitem)", f"(SELECT max({c}) - min({c}) FROM lineitem)"
        elif method == "maxabs":
            center, spread = "0.0", f"(SELECT max(abs({c})) FROM lineitem)"
        else:
            center = f"(SELECT quantile_cont({c}, 0.5) FROM lineitem)"
            spread = f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"
        cols.append(f"round(CASE WHEN {spread} = 0 THEN 0.0 ELSE ({c} - {center}) / {spread} END, 6) AS {c}")
    return f"SELECT l_orderkey, l_linenumber, {', '.join(cols)} FROM lineitem"


for _m in ("standard", "minmax", "maxabs", "robust"):

    def _mk(m):
        def fn(spark, sf):
            li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI3)
            return rounded(FE.scale(li, LI3, m))

        return fn

    register(f"f6_scale_{_m}", _scale_sql(_m))(_mk(_m))


@register(
    "f7_normalize_rows_l2",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(CASE WHEN n = 0 THEN {c} ELSE {c} / n END, 6) AS {c}" for c in LI3)
    + f" FROM (SELECT *, sqrt({' + '.join(f'{c} * {c}' for c in LI3)}) AS n FROM lineitem)",
)
def f7(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI3)
    return rounded(FE.normalize_rows(li, LI3, "l2"))


@register(
    "f8_transform_log1p",
    "SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS l_extendedprice, round(sqrt(l_quantity), 6) AS l_quantity FROM lineitem",
)
def f8(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = FE.transform(FE.transform(li, ["l_extendedprice"], "log1p"), ["l_quantity"], "sqrt")
    return rounded(out)


@register(
    "f8_transform_rank",
    """SELECT o_orderkey, round(((rank() OVER (ORDER BY o_totalprice)) + ((count(*) OVER (PARTITION BY o_totalprice)) - 1) / 2.0) / (SELECT count(*) FROM orders), 6) AS o_totalprice
FROM orders""",
)
def f8r(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(FE.transform(o, ["o_totalprice"], "rank"))


# ------------------------------------------------------------------ F9-F13

@register(
    "f9_encode_ordinal",
    "SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type_code FROM part",
)
def f9(spark, sf):
    return FE.encode_ordinal(load(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


@register(
    "f9_encode_frequency",
    "SELECT o_orderkey, o_orderpriority, round(count(*) OVER (PARTITION BY o_orderpriority) / (SELECT count(*) FROM orders), 6) AS o_orderpriority_freq FROM orders",
)
def f9f(spark, sf):
    return rounded(FE.encode_frequency(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"))


@register(
    "f10_encode_one_hot",
    "SELECT o_orderkey, o_orderstatus, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, "
    "CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders",
)
def f10(spark, sf):
    return FE.encode_one_hot(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@register(
    "f10_encode_one_hot_sparse",
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS level_index, o_custkey AS level FROM orders",
)
def f10_sparse(spark, sf):
    return FE.encode_one_hot_sparse(load(spark, sf, "orders"), "o_orderkey", "o_custkey")


@register(
    "f11_encode_target",
    """SELECT p_partkey, p_type, round((s + 10.0 * (SELECT avg(p_retailprice) FROM part)) / (n + 10.0), 6) AS p_type_te
FROM part JOIN (SELECT p_type AS t, sum(p_retailprice) AS s, count(p_retailprice) AS n FROM part GROUP BY p_type) ON t = p_type""",
)
def f11(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    return rounded(FE.encode_target(p, "p_type", "p_retailprice", 10.0).drop("p_retailprice"))


@register(
    "f11_encode_target_out_of_fold",
    f"""WITH d AS (SELECT *, ({lehmer_sql('p_partkey')}) % 5 AS fold FROM part),
per AS (SELECT p_type, fold, sum(p_retailprice) s, count(*) n FROM d GROUP BY 1, 2),
tot AS (SELECT p_type, sum(s) ts, sum(n) tn FROM per GROUP BY 1),
ft AS (SELECT fold, sum(p_retailprice) fs, count(*) fn FROM d GROUP BY 1),
g AS (SELECT sum(p_retailprice) gs, count(*) gn FROM d)
SELECT d.p_partkey, d.p_type, round((tot.ts - per.s + 10.0 * ((g.gs - ft.fs) / (g.gn - ft.fn))) / (tot.tn - per.n + 10.0), 6) AS p_type_te
FROM d JOIN per USING (p_type, fold) JOIN tot USING (p_type) JOIN ft USING (fold) CROSS JOIN g""",
)
def f11f(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    return rounded(FE.encode_target(p, "p_type", "p_retailprice", 10.0, folds=5, key="p_partkey").drop("p_retailprice"))


@register(
    "f12_bin_width",
    """SELECT p_partkey, CAST(CASE WHEN (hi - lo) / 10 = 0 THEN 0 ELSE least(floor((p_retailprice - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS p_retailprice_bin
FROM part, (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part)""",
)
def f12w(spark, sf):
    return FE.bin_width(load(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 10).drop("p_retailprice")


@register(
    "f12_bin_quantile",
    "SELECT p_partkey, "
    + " + ".join(f"CAST(p_retailprice >= (SELECT quantile_cont(p_retailprice, {k / 4}) FROM part) AS INTEGER)" for k in range(1, 4))
    + " AS p_retailprice_bin FROM part",
)
def f12q(spark, sf):
    return FE.bin_quantile(load(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 4).drop("p_retailprice")


@register(
    "f12_bin_custom",
    "SELECT p_partkey, CAST(p_retailprice >= 1000 AS INTEGER) + CAST(p_retailprice >= 1500 AS INTEGER) + CAST(p_retailprice >= 2000 AS INTEGER) AS p_retailprice_bin FROM part",
)
def f12c(spark, sf):
    return FE.bin_custom(load(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", [1000, 1500, 2000]).drop("p_retailprice")


@register(
    "f13_group_rare",
    """SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) < 0.015 * (SELECT count(*) FROM part) THEN 'other' ELSE p_name END AS p_name FROM part""",
)
def f13(spark, sf):
    return FE.group_rare(load(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 0.015)


# ------------------------------------------------------------------ F14-F17

@register(
    "f14_date_features",
    """SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day,
  isodow(o_orderdate) - 1 AS o_orderdate_weekday, hour(o_orderdate) AS o_orderdate_hour, quarter(o_orderdate) AS o_orderdate_quarter,
  isodow(o_orderdate) >= 6 AS o_orderdate_is_weekend FROM orders""",
)
def f14(spark, sf):
    return FE.date_features(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@register(
    "f15_date_format_and_tz",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts_text, CAST(timezone('America/New_York', timezone('UTC', ts)) AS TIMESTAMP) AS ts_ny FROM events""",
)
def f15(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "ts")
    out = FE.convert_tz(FE.date_format(ev, "ts"), "ts", "UTC", "America/New_York", out="ts_ny")
    return out.drop("ts")


@register(
    "f16_tokenize_documents",
    r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM
(SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM documents)""",
)
def f16(spark, sf):
    d = FE.tokenize(load(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


_TERMS = r"""(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY 1, 2)"""


@register("f17_term_counts", f"SELECT doc_id, term, CAST(tf AS BIGINT) AS tf FROM {_TERMS}")
def f17(spark, sf):
    return FE.term_counts(load(spark, sf, "documents"), "doc_id", "text")


@register(
    "f17_tfidf",
    f"""WITH tc AS {_TERMS}, dfq AS (SELECT term, count(*) AS df FROM tc GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf, round(tf * (ln((1 + n) / (1 + df)) + 1), 6) AS tfidf
FROM tc JOIN dfq USING (term) CROSS JOIN n""",
)
def f17t(spark, sf):
    return rounded(FE.tfidf(load(spark, sf, "documents"), "doc_id", "text"))


# ------------------------------------------------------------------ F18-F23

@register(
    "f18_treat_outliers_clip",
    f"""WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3 FROM {LINEITEM_OUTLIER_SQL})
SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS l_extendedprice FROM {LINEITEM_OUTLIER_SQL}, b""",
)
def f18(spark, sf):
    li = lineitem_outlier(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(FE.treat_outliers(li, ["l_extendedprice"], "clip", "iqr"))


@register(
    "f18_treat_outliers_drop_percentile",
    f"""WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) lo, quantile_cont(l_extendedprice, 0.99) hi FROM {LINEITEM_OUTLIER_SQL})
SELECT l_orderkey, l_linenumber, l_extendedprice FROM {LINEITEM_OUTLIER_SQL}, b WHERE NOT (l_extendedprice < lo OR l_extendedprice > hi)""",
)
def f18d(spark, sf):
    li = lineitem_outlier(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return FE.treat_outliers(li, ["l_extendedprice"], "drop", "percentile")


@register(
    "f19_f20_interactions_polynomial",
    """SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount,
  round(l_quantity * l_quantity, 6) AS l_quantity_l_quantity_p2, round(l_quantity * l_discount, 6) AS l_quantity_l_discount_p2, round(l_discount * l_discount, 6) AS l_discount_l_discount_p2
FROM lineitem""",
)
def f1920(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = FE.polynomial(FE.interactions(li, [("l_quantity", "l_discount")]), ["l_quantity", "l_discount"], 2)
    return rounded(out.drop("l_quantity", "l_discount"))


_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue", "charge"]
_REV = "(SELECT *, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"


@register(
    "f21_collinear_drops",
    "WITH c AS ("
    + " UNION ALL ".join(
        f"SELECT '{_NUM[a]}' AS col_a, '{_NUM[b]}' AS col_b, covar_samp({_NUM[a]}, {_NUM[b]}) / nullif(stddev_samp({_NUM[a]}) * stddev_samp({_NUM[b]}), 0) AS r FROM {_REV}"
        for a in range(len(_NUM))
        for b in range(a + 1, len(_NUM))
    )
    + ") SELECT col_b AS column_name, arg_min(col_a, abs(round(r, 6))) AS partner, max(abs(round(r, 6))) AS abs_r FROM c WHERE abs(round(r, 6)) > 0.7 GROUP BY col_b",
)
def f21(spark, sf):
    li = load(spark, sf, "lineitem")
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    li = li.withColumn("revenue", rev).withColumn("charge", rev * (1 + F.col("l_tax")))
    return FE.collinear_drops(li, threshold=0.7)


@register("f22_select_by_variance", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def f22(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", F.lit(1.0).alias("l_const"))
    return FE.select_by_variance(li, ["l_quantity", "l_discount", "l_const"], 0.0)


@register(
    "f22_univariate_scores",
    """SELECT column_name, r AS corr, CAST(row_number() OVER (ORDER BY abs(r) DESC, column_name) AS INTEGER) AS rank FROM (
  SELECT 'l_quantity' AS column_name, round(covar_samp(l_quantity, l_extendedprice) / nullif(stddev_samp(l_quantity) * stddev_samp(l_extendedprice), 0), 6) AS r FROM lineitem
  UNION ALL SELECT 'l_discount', round(covar_samp(l_discount, l_extendedprice) / nullif(stddev_samp(l_discount) * stddev_samp(l_extendedprice), 0), 6) FROM lineitem
  UNION ALL SELECT 'l_tax', round(covar_samp(l_tax, l_extendedprice) / nullif(stddev_samp(l_tax) * stddev_samp(l_extendedprice), 0), 6) FROM lineitem)""",
)
def f22u(spark, sf):
    return FE.univariate_scores(load(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@register(
    "f23_train_test_split",
    f"SELECT o_orderkey, CASE WHEN ({lehmer_sql('o_orderkey')}) % 1000 < 200 THEN 'test' ELSE 'train' END AS split FROM orders",
)
def f23(spark, sf):
    return FE.train_test_split(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@register(
    "f23_stratified_split",
    f"""SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY ({lehmer_sql('o_orderkey')}), o_orderkey) - 1
  < round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def f23s(spark, sf):
    return FE.stratified_split(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.2)
