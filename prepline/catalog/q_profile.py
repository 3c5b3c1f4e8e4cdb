"""Registered profile queries (A1-A16) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepline.catalog import register
from prepline.catalog.sqlgen import NUMERIC, SCHEMAS, clean, ident, lit, profile_sql
from prepline.operators import profile as P
from prepline.sources.tables import (
    LINEITEM_OUTLIER_SQL,
    ORDERS_DUP_SQL,
    ORDERS_MISSING_SQL,
    lineitem_outlier,
    load,
    orders_dup,
    orders_missing,
    orders_text_dates,
    orders_text_dates_sql,
)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (both sides of the oracle compare do the same)."""
    return df.select(
        *[F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields]
    )


def _cols(table: str, kinds=None):
    return [(n, k) for n, k in SCHEMAS[table] if kinds is None or k in kinds]


# ------------------------------------------------------------------ A1-A3

def _missing_rows_sql(source: str, table: str) -> str:
    parts = []
    for i, (n, k) in enumerate(SCHEMAS[table]):
        c = clean(n, k)
        parts.append(
            f"SELECT {i} AS position, {lit(n)} AS column_name, CAST(count(*) AS BIGINT) AS n_rows, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percentage FROM {source}"
        )
    return " UNION ALL ".join(parts)


@register("a1_missing_by_column", _missing_rows_sql(ORDERS_MISSING_SQL, "orders"))
def a1(spark, sf):
    return P.missing_by_column(orders_missing(spark, sf))


@register(
    "a2_missing_total",
    f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, 6 AS n_cols, CAST(count(*) * 6 AS BIGINT) AS total_cells,
  CAST(sum(CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN 1 ELSE 0 END)
     + sum(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS total_missing,
  round(100.0 * (sum(CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN 1 ELSE 0 END)
     + sum(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END)) / (count(*) * 6), 6) AS missing_percentage
FROM {ORDERS_MISSING_SQL}""",
)
def a2(spark, sf):
    return P.missing_total(orders_missing(spark, sf))


@register("a3_columns_with_missing", f"SELECT position, column_name FROM ({_missing_rows_sql(ORDERS_MISSING_SQL, 'orders')}) WHERE n_missing > 0")
def a3(spark, sf):
    return P.columns_with_missing(orders_missing(spark, sf))


# ------------------------------------------------------------------ A4, A5, A6, A8, A9

def _unique_sql(source, table):
    return " UNION ALL ".join(
        f"SELECT {i} AS position, {lit(n)} AS column_name, CAST(count(DISTINCT {clean(n, k)}) AS BIGINT) AS unique_values FROM {source}"
        for i, (n, k) in enumerate(SCHEMAS[table])
    )


@register("a4_unique_values", _unique_sql("lineitem", "lineitem"))
def a4(spark, sf):
    return P.unique_values(load(spark, sf, "lineitem"))


#: means of two-decimal columns can end exactly on a five in the sixth place, where the order of
#: summation decides the rounding; four places are safe
SAFE_PLACES = 4


def _stats_sql(source, table, places=SAFE_PLACES):
    parts = []
    for i, (n, k) in enumerate(SCHEMAS[table]):
        if k not in NUMERIC:
            continue
        c = clean(n, k)
        parts.append(
            f"SELECT {i} AS position, {lit(n)} AS column_name, round(avg({c}), {places}) AS mean, round(stddev_samp({c}), {places}) AS std, "
            f"round(CAST(min({c}) AS DOUBLE), {places}) AS min, round(CAST(max({c}) AS DOUBLE), {places}) AS max, "
            f"round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), {places}) AS median FROM {source}"
        )
    return " UNION ALL ".join(parts)


@register("a5_numeric_stats", _stats_sql("lineitem", "lineitem"))
def a5(spark, sf):
    return rounded(P.numeric_stats(load(spark, sf, "lineitem")), SAFE_PLACES)


@register("a6_semantic_types_part", f"SELECT position, column_name, dtype, data_type FROM ({profile_sql('part', SCHEMAS['part'])})")
def a6(spark, sf):
    return P.infer_semantic_type(load(spark, sf, "part"))


@register("a8_sample_values", f"SELECT position, column_name, sample_values FROM ({profile_sql('orders', SCHEMAS['orders'])})")
def a8(spark, sf):
    return P.sample_values(load(spark, sf, "orders"))


@register("a9_column_profile_orders_missing", profile_sql(ORDERS_MISSING_SQL, SCHEMAS["orders"]))
def a9(spark, sf):
    return rounded(P.column_profile(orders_missing(spark, sf)))


@register("a9_column_profile_lineitem", profile_sql("lineitem", SCHEMAS["lineitem"], places=SAFE_PLACES))
def a9_li(spark, sf):
    return rounded(P.column_profile(load(spark, sf, "lineitem")), SAFE_PLACES)


@register("a9_column_profile_embeddings", profile_sql("embeddings", SCHEMAS["embeddings"]))
def a9_emb(spark, sf):
    return rounded(P.column_profile(load(spark, sf, "embeddings")))


@register("a9_column_profile_documents", profile_sql("documents", SCHEMAS["documents"]))
def a9_doc(spark, sf):
    return rounded(P.column_profile(load(spark, sf, "documents")))


# ------------------------------------------------------------------ A7, A10

@register(
    "a7_duplicate_rows",
    f"""SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
  round(100.0 * sum(c - 1) / sum(c), 6) AS duplicate_percentage
FROM (SELECT count(*) AS c FROM {ORDERS_DUP_SQL} GROUP BY ALL_COLUMNS_PLACEHOLDER)""".replace(
        "ALL_COLUMNS_PLACEHOLDER", ", ".join(n for n, _ in SCHEMAS["orders"])
    ),
)
def a7(spark, sf):
    return P.duplicate_rows(orders_dup(spark, sf))


def _list_sql(cond: str, source_cols: str) -> str:
    return f"(SELECT string_agg(column_name, ',' ORDER BY column_name) FROM {source_cols} WHERE {cond})"


@register(
    "a10_dataset_summary",
    f"""WITH p AS ({profile_sql(ORDERS_DUP_SQL, SCHEMAS['orders'])}),
d AS (SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM {ORDERS_DUP_SQL} GROUP BY {', '.join(n for n, _ in SCHEMAS['orders'])})),
s AS (SELECT max(n_rows) AS n_rows, CAST(count(*) AS BIGINT) AS n_cols, CAST(sum(n_missing) AS BIGINT) AS total_missing FROM p)
SELECT s.n_rows, s.n_cols, s.total_missing, round(100.0 * s.total_missing / (s.n_rows * s.n_cols), 6) AS missing_percentage,
  coalesce({_list_sql("n_missing > 0", "p")}, '') AS columns_with_missing,
  coalesce({_list_sql("starts_with(dtype, 'int') OR starts_with(dtype, 'float')", "p")}, '') AS numerical_columns,
  coalesce({_list_sql("dtype = 'object'", "p")}, '') AS categorical_columns,
  coalesce({_list_sql("starts_with(dtype, 'datetime')", "p")}, '') AS datetime_columns,
  d.duplicate_rows,
  concat_ws(',', CASE WHEN round(100.0 * s.total_missing / (s.n_rows * s.n_cols), 6) > 30 THEN 'HIGH_MISSING_GT_30' END,
    CASE WHEN s.n_cols > 1000 THEN 'HIGH_DIMENSIONAL_GT_1000' END, CASE WHEN s.n_rows < 100 THEN 'SMALL_LT_100' END,
    CASE WHEN d.duplicate_rows > 0 THEN 'DUPLICATE_ROWS' END) AS potential_issues
FROM s, d""",
)
def a10(spark, sf):
    return P.dataset_summary(orders_dup(spark, sf))


# ------------------------------------------------------------------ A11

def _outlier_sql(method: str) -> str:
    parts = []
    for i, (n, k) in enumerate(SCHEMAS["lineitem"]):
        if k not in NUMERIC:
            continue
        c = clean(n, k)
        if method == "iqr":
            bounds = (
                f"SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
                f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM src"
            )
            test = f"{c} < b.lo OR {c} > b.hi"
        elif method == "zscore":
            bounds = f"SELECT avg({c}) - 3 * stddev_samp({c}) AS lo, avg({c}) + 3 * stddev_samp({c}) AS hi, avg({c}) AS m, stddev_samp({c}) AS sd FROM src"
            test = f"abs(({c} - b.m) / b.sd) > 3"
        else:
            bounds = (
                f"SELECT med, mad, CASE WHEN mad > 0 THEN med - 3.5 / 0.6745 * mad END AS lo, CASE WHEN mad > 0 THEN med + 3.5 / 0.6745 * mad END AS hi "
                f"FROM (SELECT med, (SELECT quantile_cont(abs({c} - med), 0.5) FROM src) AS mad FROM (SELECT quantile_cont({c}, 0.5) AS med FROM src))"
            )
            test = f"b.mad > 0 AND abs(0.6745 * ({c} - b.med) / b.mad) > 3.5"
        parts.append(
            f"SELECT {i} AS position, {lit(n)} AS column_name, '{method}' AS method, "
            f"CAST((SELECT count(*) FROM src, ({bounds}) b WHERE {test}) AS BIGINT) AS n_outliers, "
            f"(SELECT round(lo, 6) FROM ({bounds})) AS lower, (SELECT round(hi, 6) FROM ({bounds})) AS upper"
        )
    return f"WITH src AS (SELECT * FROM {LINEITEM_OUTLIER_SQL}) " + " UNION ALL ".join(parts)


for _m in P.OUTLIER_METHODS:

    def _mk(method):
        def q(spark, sf):
            return P.outlier_counts(lineitem_outlier(spark, sf), method)

        return q

    register(f"a11_outlier_counts_{_m}", _outlier_sql(_m))(_mk(_m))


# ------------------------------------------------------------------ A12

_DATE_FORMATS_DUCK = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%m/%d/%Y', '%d.%m.%Y']"


def _consistency_sql(source: str) -> str:
    parts = []
    for i, (n, k) in enumerate(SCHEMAS["orders"]):
        if k not in ("string", "timestamp"):
            continue
        if n != "o_orderdate" and k != "string":
            continue
        c = ident(n)
        parts.append(
            f"SELECT {i} AS position, {lit(n)} AS column_name, CAST(count({c}) AS BIGINT) AS n_values, "
            f"round(count(TRY_CAST(trim({c}) AS DOUBLE)) / count({c}), 6) AS numeric_share, "
            f"round(count(try_strptime({c}, {_DATE_FORMATS_DUCK})) / count({c}), 6) AS date_share FROM {source}"
        )
    body = " UNION ALL ".join(parts)
    return (
        f"SELECT *, NOT coalesce((numeric_share > 0 AND numeric_share < 1) OR (date_share > 0 AND date_share < 1), false) AS consistent FROM ({body})"
    )


@register("a12_types_consistent", _consistency_sql(orders_text_dates_sql(mixed=True)))
def a12(spark, sf):
    return P.types_consistent(orders_text_dates(spark, sf, mixed=True))


# ------------------------------------------------------------------ A13, A14, A15, A16

@register(
    "a13_target_distribution",
    "SELECT CAST(quality AS VARCHAR) AS class_value, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY quality",
)
def a13d(spark, sf):
    return P.target_distribution(load(spark, sf, "labels"), "quality")


@register(
    "a13_target_analysis",
    """SELECT 'quality' AS target, round(100.0 * (count(*) - count(quality)) / count(*), 2) AS missing_percentage,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT quality FROM labels GROUP BY quality)) AS n_classes,
  (SELECT round(min(c) / sum(c), 6) FROM (SELECT count(*) c FROM labels GROUP BY quality)) AS min_class_share,
  (SELECT round(max(c) / sum(c), 6) FROM (SELECT count(*) c FROM labels GROUP BY quality)) AS max_class_share,
  (SELECT min(c) / max(c) >= 0.5 FROM (SELECT count(*) c FROM labels GROUP BY quality)) AS is_balanced,
  round(avg(quality), 6) AS mean, round(stddev_samp(quality), 6) AS std, 'accuracy,precision,recall,f1' AS recommended_metrics
FROM labels""",
)
def a13(spark, sf):
    return P.target_analysis(load(spark, sf, "labels"), "quality", "supervised_classification")


def _corr_target_sql():
    parts = []
    for n, k in SCHEMAS["lineitem"]:
        if k not in NUMERIC or n == "l_extendedprice":
            continue
        parts.append(
            f"SELECT {lit(n)} AS column_name, round(covar_samp({n}, l_extendedprice) / nullif(stddev_samp({n}) * stddev_samp(l_extendedprice), 0), 6) AS r FROM lineitem"
        )
    return f"SELECT column_name, r AS corr, abs(r) > 0.7 AS high FROM ({' UNION ALL '.join(parts)})"


@register("a14_correlation_with_target", _corr_target_sql())
def a14(spark, sf):
    return P.correlation_with_target(load(spark, sf, "lineitem"), "l_extendedprice", 0.7)


def _pairs(cols):
    return [(cols[a], cols[b]) for a in range(len(cols)) for b in range(a + 1, len(cols))]


_LI_NUM = [n for n, k in SCHEMAS["lineitem"] if k in NUMERIC]


@register(
    "a15_correlation_pearson",
    " UNION ALL ".join(
        f"SELECT {lit(a)} AS col_a, {lit(b)} AS col_b, round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 6) AS r FROM lineitem"
        for a, b in _pairs(_LI_NUM)
    ),
)
def a15p(spark, sf):
    return P.correlation_matrix(load(spark, sf, "lineitem"), "pearson")


_SPEAR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "a15_correlation_spearman",
    "WITH r AS (SELECT " + ", ".join(f"(rank() OVER (ORDER BY {c})) + ((count(*) OVER (PARTITION BY {c})) - 1) / 2.0 AS {c}" for c in _SPEAR) + " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT {lit(a)} AS col_a, {lit(b)} AS col_b, round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 6) AS r FROM r"
        for a, b in _pairs(_SPEAR)
    ),
)
def a15s(spark, sf):
    return P.correlation_matrix(load(spark, sf, "lineitem").select(*_SPEAR), "spearman")


@register(
    "a16_data_quality_report",
    f"""WITH src AS (SELECT * FROM {ORDERS_MISSING_SQL}),
m AS (SELECT count(*) AS n_rows, sum(CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN 1 ELSE 0 END) + sum(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS tm FROM src),
d AS (SELECT CAST(sum(c - 1) AS BIGINT) AS dr, round(100.0 * sum(c - 1) / sum(c), 6) AS dp FROM (SELECT count(*) c FROM src GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)),
o AS (SELECT sum(n) AS n FROM (
  {' UNION ALL '.join(f"SELECT (SELECT count(*) FROM src, (SELECT quantile_cont({clean(n, k)}, 0.25) AS q1, quantile_cont({clean(n, k)}, 0.75) AS q3 FROM src) b WHERE {clean(n, k)} < b.q1 - 1.5 * (b.q3 - b.q1) OR {clean(n, k)} > b.q3 + 1.5 * (b.q3 - b.q1)) AS n" for n, k in SCHEMAS['orders'] if k in NUMERIC)}))
SELECT CAST(m.n_rows AS BIGINT) AS n_rows, 6 AS n_cols, CAST(m.tm AS BIGINT) AS total_missing_values,
  round(100.0 * m.tm / (m.n_rows * 6), 6) AS missing_percentage, d.dr AS duplicate_rows, d.dp AS duplicate_percentage,
  CAST(o.n AS BIGINT) AS outliers_detected, true AS data_types_consistent,
  concat_ws(',', CASE WHEN 100.0 * m.tm / (m.n_rows * 6) > 30 THEN 'HIGH_MISSING_GT_30' END, CASE WHEN m.n_rows < 1000 THEN 'SMALL_LT_1000' END) AS recommendations
FROM m, d, o""",
)
def a16(spark, sf):
    return P.data_quality_report(orders_missing(spark, sf))
