"""Registered rule queries (R1-R14) with their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.catalog import register
from prepline.catalog.sqlgen import (
    SCHEMAS,
    contains_any,
    contains_count,
    lit,
    meta_values,
    name_type_sql,
    role_sql,
)
from prepline.operators import profile as P
from prepline.operators import rules as R
from prepline.sources.tables import ORDERS_DUP_SQL, TABLES, load, orders_dup


def light_profile(df: DataFrame) -> DataFrame:
    """(position, column_name, dtype, n_rows, n_missing): one scan of the table."""
    return P.missing_by_column(df).join(F.broadcast(P.columns_table(df).select("position", "dtype")), "position")


def light_sql(table: str, source: str | None = None) -> str:
    src = source or table
    return f"(SELECT m.*, (SELECT CAST(count(*) AS BIGINT) FROM {src}) AS n_rows FROM {meta_values(table)} m)"


# ------------------------------------------------------------------ R3, R4 (catalogue of every table)

def _catalogue_sql() -> str:
    parts = [
        f"SELECT {lit(t)} AS table_name, position, column_name, dtype, {name_type_sql()} AS name_type, {role_sql()} AS potential_role FROM {light_sql(t)}"
        for t in TABLES
    ]
    return " UNION ALL ".join(parts)


@register("r3_r4_types_and_roles_catalogue", _catalogue_sql())
def r34(spark, sf):
    profs = [light_profile(load(spark, sf, t)).withColumn("table_name", F.lit(t)) for t in TABLES]
    cat = reduce(DataFrame.unionByName, profs)
    return cat.select(
        "table_name",
        "position",
        "column_name",
        "dtype",
        R.name_type_expr(F.col("column_name"), F.col("dtype")).alias("name_type"),
        R.role_expr(F.col("column_name"), F.col("dtype")).alias("potential_role"),
    )


@register("r3_classify_by_name_orders", f"SELECT position, column_name, dtype, {name_type_sql()} AS name_type FROM {light_sql('orders')}")
def r3(spark, sf):
    return R.classify_by_name(light_profile(load(spark, sf, "orders")))


@register("r4_column_roles_events", f"SELECT position, column_name, {role_sql()} AS potential_role FROM {light_sql('events')}")
def r4(spark, sf):
    return R.column_roles(light_profile(load(spark, sf, "events")))


@register(
    "r7_analyze_schema_lineitem",
    f"SELECT position, column_name, dtype, {name_type_sql()} AS name_type, {role_sql()} AS potential_role FROM {light_sql('lineitem')}",
)
def r7(spark, sf):
    return R.analyze_schema(light_profile(load(spark, sf, "lineitem")))


# ------------------------------------------------------------------ R1, R2

_SUMMARY_SQL = f"""(WITH d AS (SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM {ORDERS_DUP_SQL} GROUP BY {', '.join(n for n, _ in SCHEMAS['orders'])})),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_rows, 6 AS n_cols FROM {ORDERS_DUP_SQL})
SELECT s.n_rows, s.n_cols, 0.0 AS missing_percentage, d.duplicate_rows,
  concat_ws(',', CASE WHEN s.n_cols > 1000 THEN 'HIGH_DIMENSIONAL_GT_1000' END, CASE WHEN s.n_rows < 100 THEN 'SMALL_LT_100' END,
    CASE WHEN d.duplicate_rows > 0 THEN 'DUPLICATE_ROWS' END) AS potential_issues FROM s, d)"""


@register("r2_potential_issues", f"SELECT potential_issues FROM {_SUMMARY_SQL}")
def r2(spark, sf):
    return R.potential_issues(P.dataset_summary(orders_dup(spark, sf)))


@register(
    "r1_validate",
    f"""SELECT n_rows > 0 AND n_cols > 0 AS is_valid,
  concat_ws(',', CASE WHEN n_rows = 0 THEN 'EMPTY_ROWS' END, CASE WHEN n_cols = 0 THEN 'NO_COLUMNS' END) AS issues,
  concat_ws(',', CASE WHEN n_rows < 100 THEN 'SMALL_LT_100' END, CASE WHEN missing_percentage > 50 THEN 'MISSING_GT_50' END) AS warnings,
  concat_ws(',', CASE WHEN n_rows < 1000 THEN 'MORE_DATA_LT_1000' END, CASE WHEN potential_issues <> '' THEN potential_issues END) AS recommendations
FROM {_SUMMARY_SQL}""",
)
def r1(spark, sf):
    return R.validate(P.dataset_summary(orders_dup(spark, sf)))


# ------------------------------------------------------------------ R5, R6

def _list(cond: str, src: str) -> str:
    return f"(SELECT string_agg(column_name, ',' ORDER BY position) FROM {src} WHERE {cond})"


@register(
    "r5_schema_insights_orders",
    f"""WITH p AS {light_sql('orders')}
SELECT max(n_rows) AS n_rows, CAST(count(*) AS BIGINT) AS n_cols,
  CAST(count(*) FILTER (WHERE {name_type_sql()} = 'numeric') AS BIGINT) AS numeric_columns,
  CAST(count(*) FILTER (WHERE {name_type_sql()} = 'categorical') AS BIGINT) AS categorical_columns,
  {_list(f"{role_sql()} = 'potential_target'", 'p')} AS potential_targets,
  CASE WHEN {_list(f"{role_sql()} = 'potential_target'", 'p')} IS NULL THEN 'NO_OBVIOUS_TARGET' END AS note
FROM p""",
)
def r5(spark, sf):
    return R.schema_insights(light_profile(load(spark, sf, "orders")), "supervised_regression")


@register(
    "r6_schema_recommendations_orders",
    f"""WITH p AS {light_sql('orders')}
SELECT {_list(f"{role_sql()} = 'identifier'", 'p')} AS drop_identifiers,
  coalesce(bool_or({name_type_sql()} = 'datetime'), false) AS expand_datetimes, 'ENCODE_TARGET' AS target_check FROM p""",
)
def r6(spark, sf):
    return R.schema_recommendations(light_profile(load(spark, sf, "orders")), "supervised_classification")


# ------------------------------------------------------------------ R8, R9

def _score_sql(problem: str, hints=()) -> str:
    s = f"{contains_count('column_name', R.TARGET_SCORE_WORDS)} * 10"
    if hints:
        s += f" + {contains_count('column_name', [h.lower() for h in hints])} * 15"
    if "supervised_classification" in problem:
        s += " + CASE WHEN contains(dtype, 'object') OR contains(dtype, 'category') THEN 5 ELSE 0 END"
    elif "supervised_regression" in problem:
        s += " + CASE WHEN contains(dtype, 'int') OR contains(dtype, 'float') THEN 5 ELSE 0 END"
    return s


def _scores_sql(table: str, problem: str, hints=()) -> str:
    kind = "classification" if "classification" in problem else "regression"
    return f"""(SELECT position, column_name, score, rk = 1 AND score > 0 AS is_best,
  CASE WHEN rk = 1 AND score > 0 THEN least(score / 20.0, 1.0) END AS confidence,
  score > 5 AND NOT (rk = 1 AND score > 0) AS is_alternative,
  CASE WHEN rk = 1 AND score > 0 THEN '{kind}' END AS target_type
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, position) AS rk
      FROM (SELECT position, column_name, CAST({_score_sql(problem, hints)} AS INTEGER) AS score FROM {light_sql(table)})))"""


@register("r8_target_scores_orders_regression", f"SELECT * FROM {_scores_sql('orders', 'supervised_regression')}")
def r8s(spark, sf):
    return R.target_scores(light_profile(load(spark, sf, "orders")), "supervised_regression")


def _identify_sql(table: str, problem: str, hints=()) -> str:
    s = _scores_sql(table, problem, hints)
    return f"""SELECT b.column_name AS target, b.target_type, b.confidence,
  (SELECT string_agg(column_name, ',' ORDER BY position) FROM {s} WHERE is_alternative) AS alternatives
FROM {s} b WHERE b.is_best"""


for _t, _p, _h in [
    ("orders", "supervised_regression", ()),
    ("orders", "supervised_classification", ()),
    ("events", "supervised_classification", ()),
    ("labels", "supervised_classification", ()),
    ("customer", "supervised_classification", ("segment",)),
]:

    def _mk(t, p, h):
        def q(spark, sf):
            return R.identify_target(light_profile(load(spark, sf, t)), p, h)

        return q

    _name = f"r8_identify_target_{_t}_{_p.split('_')[-1]}" + ("_hinted" if _h else "")
    register(_name, _identify_sql(_t, _p, _h))(_mk(_t, _p, _h))


@register(
    "r9_detect_time_series_events",
    f"""WITH p AS {light_sql('events')}
SELECT {_list("starts_with(dtype, 'datetime')", 'p')} IS NOT NULL OR {_list(contains_any('column_name', R.TIME_SERIES_NAME_WORDS), 'p')} IS NOT NULL AS is_time_series,
  {_list("starts_with(dtype, 'datetime')", 'p')} AS datetime_columns,
  {_list(contains_any('column_name', R.TIME_SERIES_NAME_WORDS), 'p')} AS potential_time_columns""",
)
def r9(spark, sf):
    return R.detect_time_series(light_profile(load(spark, sf, "events")))


# ------------------------------------------------------------------ R10, R11

def _features_sql(table: str, problem: str) -> str:
    t, r = name_type_sql(), role_sql()
    text_ok = "true" if "classification" in problem else "false"
    return f"""SELECT position, column_name, {t} AS name_type, {r} AS potential_role,
  CASE WHEN {r} = 'identifier' THEN 'drop' WHEN {r} = 'potential_target' THEN 'skip'
       WHEN {t} IN ('numeric', 'categorical', 'boolean', 'datetime') THEN 'keep'
       WHEN {t} = 'text' AND {text_ok} THEN 'keep' ELSE 'drop' END AS decision,
  CASE WHEN {r} = 'identifier' THEN 'IDENTIFIER' WHEN {r} = 'potential_target' THEN 'POTENTIAL_TARGET'
       WHEN {t} = 'datetime' THEN 'DATETIME_EXPAND' WHEN {t} IN ('numeric', 'categorical', 'boolean') THEN 'USEFUL_TYPE'
       WHEN {t} = 'text' AND {text_ok} THEN 'TEXT_FOR_CLASSIFICATION' ELSE 'UNSUPPORTED_TYPE' END AS reason
FROM {light_sql(table)}"""


@register("r10_recommend_features_orders", _features_sql("orders", "supervised_classification"))
def r10(spark, sf):
    return R.recommend_features(light_profile(load(spark, sf, "orders")), "supervised_classification")


@register("r10_recommend_features_customer_regression", _features_sql("customer", "supervised_regression"))
def r10c(spark, sf):
    return R.recommend_features(light_profile(load(spark, sf, "customer")), "supervised_regression")


@register(
    "r11_suggest_engineering_events",
    f"""SELECT * FROM (SELECT position, column_name,
  CASE {name_type_sql()} WHEN 'datetime' THEN 'DATE_PARTS' WHEN 'categorical' THEN 'ONE_HOT' WHEN 'text' THEN 'VECTORIZE_TFIDF' WHEN 'numeric' THEN 'SCALE' END AS suggestion
FROM {light_sql('events')}) WHERE suggestion IS NOT NULL
UNION ALL SELECT NULL, NULL, 'INTERACTIONS' UNION ALL SELECT NULL, NULL, 'POLYNOMIAL'""",
)
def r11(spark, sf):
    return R.suggest_engineering(light_profile(load(spark, sf, "events")), "supervised_classification")


# ------------------------------------------------------------------ R12, R13, R14

def _requirements_sql(table: str, problem: str) -> str:
    sup = "true" if R._is_supervised(problem) else "false"
    ts = "true" if "time_series" in problem else "false"
    return f"""WITH p AS {light_sql(table)},
f AS (SELECT max(n_rows) AS n_rows, count(*) AS n_cols, coalesce(bool_or({role_sql()} = 'potential_target'), false) AS has_target,
      coalesce(bool_or(starts_with(dtype, 'datetime')), false) AS has_datetime FROM p)
SELECT concat_ws(',', CASE WHEN n_rows < 100 THEN 'SMALL_LT_100' END, CASE WHEN n_cols < 2 THEN 'FEW_COLUMNS_LT_2' END,
  CASE WHEN {sup} AND NOT has_target THEN 'NEEDS_TARGET' END, CASE WHEN {ts} AND NOT has_datetime THEN 'NEEDS_DATETIME' END) AS data_issues FROM f"""


@register("r12_check_data_requirements_documents_forecasting", _requirements_sql("documents", "time_series_forecasting"))
def r12(spark, sf):
    return R.check_data_requirements(R.data_facts(light_profile(load(spark, sf, "documents"))), "time_series_forecasting")


@register("r12_check_data_requirements_region_classification", _requirements_sql("region", "supervised_classification"))
def r12b(spark, sf):
    return R.check_data_requirements(R.data_facts(light_profile(load(spark, sf, "region"))), "supervised_classification")


@register(
    "r13_check_problem_minimums_labels",
    """SELECT 'supervised_classification' AS problem_type, CAST(count(*) AS BIGINT) AS n_rows, 100 AS min_samples, count(*) >= 100 AS enough_rows,
  CAST(count(DISTINCT quality) AS BIGINT) AS n_classes, count(DISTINCT quality) >= 2 AS enough_classes,
  CAST(NULL AS DOUBLE) AS outlier_share, CAST(NULL AS BOOLEAN) AS rare_anomalies, count(*) >= 100 AND count(DISTINCT quality) >= 2 AS ok
FROM labels""",
)
def r13(spark, sf):
    return R.check_problem_minimums(load(spark, sf, "labels"), "supervised_classification", "quality")


@register(
    "r14_enforce_limits_lineitem",
    """SELECT CAST(count(*) AS BIGINT) AS n_rows, 11 AS n_cols, count(*) <= 1000000 AS rows_ok, true AS cols_ok,
  concat_ws(',', CASE WHEN count(*) > 1000000 THEN 'ROWS_OVER_LIMIT' END) AS limit_codes FROM lineitem""",
)
def r14(spark, sf):
    return R.enforce_limits(load(spark, sf, "lineitem"))
