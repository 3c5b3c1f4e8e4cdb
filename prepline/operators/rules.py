"""Rule operators over the column profile (R1-R14). Every rule is a Column expression over a
one-row-per-column table, so it runs on one dataset or a whole catalogue (add a
``table_name`` key) in one job. Matching is case-insensitive substring by default, which is
the observable behaviour of the rules (a lone ``y`` matches ``quantity``); ``match='token'``
matches whole ``_``/space-separated tokens instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepline.functions.exprs import attach_one_row

from prepline.functions.exprs import lower_contains_any, lower_contains_count

# ---- fixed values: word lists, codes and limits that must equal the rule set we reproduce ----
ROLE_TARGET_WORDS = ["target", "label", "class", "y", "output"]
ROLE_ID_WORDS = ["id", "index", "key", "identifier"]
ROLE_TIME_WORDS = ["date", "time"]
CATEGORY_NAME_WORDS = ["category", "type", "class", "group"]
TARGET_SCORE_WORDS = ["target", "label", "class", "y", "output", "prediction", "outcome", "result", "response", "dependent"]
TIME_SERIES_NAME_WORDS = ["date", "time", "timestamp", "day", "month", "year"]
PROBLEM_TYPES = [
    "supervised_classification",
    "supervised_regression",
    "semi_supervised_classification",
    "semi_supervised_regression",
    "unsupervised_clustering",
    "unsupervised_dimensionality_reduction",
    "unsupervised_anomaly_detection",
    "time_series_forecasting",
    "time_series_classification",
]
MIN_SAMPLES = {
    "supervised_classification": 100,
    "supervised_regression": 100,
    "semi_supervised_classification": 500,
    "unsupervised_clustering": 200,
    "unsupervised_dimensionality_reduction": 100,
    "unsupervised_anomaly_detection": 1000,
    "time_series_forecasting": 50,
    "time_series_classification": 100,
}
MAX_ROWS = 1_000_000
MAX_COLUMNS = 10_000
# ---- end of fixed values ----


def _match_any(name: Column, words: Sequence[str], match: str = "substring") -> Column:
    if match == "token":
        toks = F.split(F.lower(name), "[ _\\-]+")
        out = F.lit(False)
        for w in words:
            out = out | F.array_contains(toks, w)
        return out
    return lower_contains_any(name, words)


def _is_supervised(problem: str | None) -> bool:
    """Prefix test (documented choice): ``unsupervised_*`` is not supervised."""
    p = problem or ""
    return p.startswith("supervised") or p.startswith("semi_supervised")


# ------------------------------------------------------------------ R3, R4

def name_type_expr(name: Column, dtype: Column) -> Column:
    """Type by dtype and name (differs from the data-driven A6; both are kept)."""
    return (
        F.when(dtype.contains("int") | dtype.contains("float"), "numeric")
        .when(dtype.contains("datetime") | F.lower(name).contains("date"), "datetime")
        .when(dtype.contains("bool"), "boolean")
        .when(dtype.contains("object"), F.when(lower_contains_any(name, CATEGORY_NAME_WORDS), "categorical").otherwise("text"))
        .otherwise("mixed")
    )


def role_expr(name: Column, dtype: Column, match: str = "substring") -> Column:
    """First hit -- target words, identifier words, datetime dtype or time words, feature."""
    return (
        F.when(_match_any(name, ROLE_TARGET_WORDS, match), "potential_target")
        .when(_match_any(name, ROLE_ID_WORDS, match), "identifier")
        .when(dtype.contains("datetime") | _match_any(name, ROLE_TIME_WORDS, match), "datetime")
        .otherwise("feature")
    )


def classify_by_name(profile: DataFrame) -> DataFrame:
    """R3 over a profile/columns table: (position, column_name, dtype, name_type)."""
    return profile.select("position", "column_name", "dtype", name_type_expr(F.col("column_name"), F.col("dtype")).alias("name_type"))


def column_roles(profile: DataFrame, match: str = "substring") -> DataFrame:
    """(position, column_name, potential_role)."""
    return profile.select("position", "column_name", role_expr(F.col("column_name"), F.col("dtype"), match).alias("potential_role"))


def analyze_schema(profile: DataFrame) -> DataFrame:
    """R7 (per column part): name type + role in one table."""
    return profile.select(
        "position",
        "column_name",
        "dtype",
        name_type_expr(F.col("column_name"), F.col("dtype")).alias("name_type"),
        role_expr(F.col("column_name"), F.col("dtype")).alias("potential_role"),
    )


# ------------------------------------------------------------------ R1, R2

def issue_codes(n_rows: Column, n_cols: Column, missing_pct: Column, duplicates: Column) -> Column:
    """R2: comma-joined potential-issue codes."""
    return F.concat_ws(
        ",",
        F.when(missing_pct > 30, F.lit("HIGH_MISSING_GT_30")),
        F.when(n_cols > 1000, F.lit("HIGH_DIMENSIONAL_GT_1000")),
        F.when(n_rows < 100, F.lit("SMALL_LT_100")),
        F.when(duplicates > 0, F.lit("DUPLICATE_ROWS")),
    )


def potential_issues(summary: DataFrame) -> DataFrame:
    """R2 over a dataset summary (A10) row."""
    return summary.select(
        issue_codes(F.col("n_rows"), F.col("n_cols"), F.col("missing_percentage"), F.col("duplicate_rows")).alias("potential_issues")
    )


def validate(summary: DataFrame) -> DataFrame:
    """is_valid, issue/warning/recommendation codes from the real summary."""
    issues = F.concat_ws(",", F.when(F.col("n_rows") == 0, F.lit("EMPTY_ROWS")), F.when(F.col("n_cols") == 0, F.lit("NO_COLUMNS")))
    warnings = F.concat_ws(
        ",", F.when(F.col("n_rows") < 100, F.lit("SMALL_LT_100")), F.when(F.col("missing_percentage") > 50, F.lit("MISSING_GT_50"))
    )
    recs = F.concat_ws(
        ",",
        F.when(F.col("n_rows") < 1000, F.lit("MORE_DATA_LT_1000")),
        F.when(F.col("potential_issues") != "", F.col("potential_issues")),
    )
    return summary.select(
        ((F.col("n_rows") > 0) & (F.col("n_cols") > 0)).alias("is_valid"),
        issues.alias("issues"),
        warnings.alias("warnings"),
        recs.alias("recommendations"),
    )


# ------------------------------------------------------------------ R5, R6

def schema_insights(profile: DataFrame, problem: str | None) -> DataFrame:
    """Counts by R3 type and, for supervised problems, the potential targets (or a code)."""
    t = name_type_expr(F.col("column_name"), F.col("dtype"))
    role = role_expr(F.col("column_name"), F.col("dtype"))
    agg = profile.agg(
        F.max("n_rows").cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        F.count_if(t == "numeric").alias("numeric_columns"),
        F.count_if(t == "categorical").alias("categorical_columns"),
        F.array_join(F.array_sort(F.collect_list(F.when(role == "potential_target", F.struct("position", "column_name")))).getField("column_name"), ",").alias("targets"),
    )
    if _is_supervised(problem):
        tgt = F.when(F.col("targets") != "", F.col("targets"))
        note = F.when(F.col("targets") == "", F.lit("NO_OBVIOUS_TARGET"))
    else:
        tgt, note = F.lit(None).cast("string"), F.lit(None).cast("string")
    return agg.select("n_rows", "n_cols", "numeric_columns", "categorical_columns", tgt.alias("potential_targets"), note.alias("note"))


def schema_recommendations(profile: DataFrame, problem: str | None) -> DataFrame:
    """Identifier columns to drop, whether to expand datetimes, the target check code."""
    t = name_type_expr(F.col("column_name"), F.col("dtype"))
    role = role_expr(F.col("column_name"), F.col("dtype"))
    p = problem or ""
    target_code = "ENCODE_TARGET" if "classification" in p else ("CHECK_TARGET_OUTLIERS" if "regression" in p else None)
    return profile.agg(
        F.array_join(F.array_sort(F.collect_list(F.when(role == "identifier", F.struct("position", "column_name")))).getField("column_name"), ",").alias("drop_identifiers"),
        F.bool_or(t == "datetime").alias("expand_datetimes"),
    ).select(
        F.when(F.col("drop_identifiers") != "", F.col("drop_identifiers")).alias("drop_identifiers"),
        F.coalesce("expand_datetimes", F.lit(False)).alias("expand_datetimes"),
        F.lit(target_code).cast("string").alias("target_check"),
    )


# ------------------------------------------------------------------ R8, R9

def target_scores(profile: DataFrame, problem: str | None, hints: Sequence[str] = ()) -> DataFrame:
    """Score every column; best = highest score, ties to the first column; none when the
    best score is 0; confidence = min(score / 20, 1); alternatives score > 5."""
    p = problem or ""
    name, dtype = F.col("column_name"), F.col("dtype")
    score = lower_contains_count(name, TARGET_SCORE_WORDS) * 10
    if hints:
        score = score + lower_contains_count(name, [h.lower() for h in hints]) * 15
    if "supervised_classification" in p:
        score = score + F.when(dtype.contains("object") | dtype.contains("category"), 5).otherwise(0)
    elif "supervised_regression" in p:
        score = score + F.when(dtype.contains("int") | dtype.contains("float"), 5).otherwise(0)
    scored = profile.select("position", "column_name", score.cast("int").alias("score"))
    win = Window.orderBy(F.col("score").desc(), F.col("position"))  # one row per column: schema-sized
    ranked = scored.withColumn("_rk", F.row_number().over(win))
    best = (F.col("_rk") == 1) & (F.col("score") > 0)
    return ranked.select(
        "position",
        "column_name",
        "score",
        best.alias("is_best"),
        F.when(best, F.least(F.col("score") / 20.0, F.lit(1.0))).alias("confidence"),
        ((F.col("score") > 5) & ~best).alias("is_alternative"),
        F.when(best, F.lit("classification" if "classification" in p else "regression")).alias("target_type"),
    )


def identify_target(profile: DataFrame, problem: str | None, hints: Sequence[str] = ()) -> DataFrame:
    """R8 summary: one row (target, confidence, alternatives) or no row when nothing scores."""
    s = target_scores(profile, problem, hints)
    alts = s.where("is_alternative").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]), ",").alias("alternatives")
    )
    return attach_one_row(s.where("is_best"), alts).select(
        F.col("column_name").alias("target"), "target_type", "confidence", F.when(F.col("alternatives") != "", F.col("alternatives")).alias("alternatives")
    )


def detect_time_series(profile: DataFrame) -> DataFrame:
    """is_time_series when a datetime column or a time-like name exists."""
    is_dt = F.col("dtype").startswith("datetime")
    named = lower_contains_any(F.col("column_name"), TIME_SERIES_NAME_WORDS)
    lst = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("position", "column_name")))), lambda x: x["column_name"]), ",")
    return profile.agg(lst(is_dt).alias("datetime_columns"), lst(named).alias("potential_time_columns")).select(
        ((F.col("datetime_columns") != "") | (F.col("potential_time_columns") != "")).alias("is_time_series"),
        F.when(F.col("datetime_columns") != "", F.col("datetime_columns")).alias("datetime_columns"),
        F.when(F.col("potential_time_columns") != "", F.col("potential_time_columns")).alias("potential_time_columns"),
    )


# ------------------------------------------------------------------ R10, R11

def recommend_features(profile: DataFrame, problem: str | None) -> DataFrame:
    """(position, column_name, name_type, potential_role, decision, reason)."""
    p = problem or ""
    t = name_type_expr(F.col("column_name"), F.col("dtype"))
    role = role_expr(F.col("column_name"), F.col("dtype"))
    text_ok = "classification" in p
    decision = (
        F.when(role == "identifier", "drop")
        .when(role == "potential_target", "skip")
        .when(t.isin("numeric", "categorical", "boolean", "datetime"), "keep")
        .when((t == "text") & F.lit(text_ok), "keep")
        .otherwise("drop")
    )
    reason = (
        F.when(role == "identifier", "IDENTIFIER")
        .when(role == "potential_target", "POTENTIAL_TARGET")
        .when(t == "datetime", "DATETIME_EXPAND")
        .when(t.isin("numeric", "categorical", "boolean"), "USEFUL_TYPE")
        .when((t == "text") & F.lit(text_ok), "TEXT_FOR_CLASSIFICATION")
        .otherwise("UNSUPPORTED_TYPE")
    )
    return profile.select("position", "column_name", t.alias("name_type"), role.alias("potential_role"), decision.alias("decision"), reason.alias("reason"))


def suggest_engineering(profile: DataFrame, problem: str | None) -> DataFrame:
    """(position, column_name, suggestion) with two general rows (position NULL)."""
    p = problem or ""
    t = name_type_expr(F.col("column_name"), F.col("dtype"))
    sug = (
        F.when(t == "datetime", "DATE_PARTS")
        .when(t == "categorical", "ONE_HOT")
        .when((t == "text") & F.lit("classification" in p), "VECTORIZE_TFIDF")
        .when(t == "numeric", "SCALE")
    )
    per_col = profile.select("position", "column_name", sug.alias("suggestion")).where(F.col("suggestion").isNotNull())
    spark = profile.sparkSession
    general = spark.createDataFrame([(None, None, "INTERACTIONS"), (None, None, "POLYNOMIAL")], "position int, column_name string, suggestion string")
    return per_col.unionByName(general)


# ------------------------------------------------------------------ R12, R13, R14

def check_data_requirements(facts: DataFrame, problem: str | None) -> DataFrame:
    """R12 over a one-row facts table (n_rows, n_cols, has_target, has_datetime)."""
    p = problem or ""
    return facts.select(
        F.concat_ws(
            ",",
            F.when(F.col("n_rows") < 100, F.lit("SMALL_LT_100")),
            F.when(F.col("n_cols") < 2, F.lit("FEW_COLUMNS_LT_2")),
            F.when(F.lit(_is_supervised(p)) & ~F.col("has_target"), F.lit("NEEDS_TARGET")),
            F.when(F.lit("time_series" in p) & ~F.col("has_datetime"), F.lit("NEEDS_DATETIME")),
        ).alias("data_issues")
    )


def data_facts(profile: DataFrame) -> DataFrame:
    """(n_rows, n_cols, has_target, has_datetime) from a profile (roles by R4)."""
    role = role_expr(F.col("column_name"), F.col("dtype"))
    return profile.agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        F.coalesce(F.bool_or(role == "potential_target"), F.lit(False)).alias("has_target"),
        F.coalesce(F.bool_or(F.col("dtype").startswith("datetime")), F.lit(False)).alias("has_datetime"),
    )


def requirements_table(spark) -> DataFrame:
    rows = [(p, MIN_SAMPLES.get(p)) for p in PROBLEM_TYPES]
    return spark.createDataFrame(rows, "problem_type string, min_samples int")


def check_problem_minimums(df: DataFrame, problem: str, target: str | None = None) -> DataFrame:
    """Minimum samples, >= 2 classes for categorical targets, anomaly share < 10 %.

    One row: (problem_type, n_rows, min_samples, enough_rows, n_classes, enough_classes,
    outlier_share, rare_anomalies, ok)."""
    from prepline.operators.profile import outlier_counts, qcol

    spark = df.sparkSession
    req = requirements_table(spark).where(F.col("problem_type") == problem)
    base = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if target is not None:
        ncls = df.where(qcol(target).isNotNull()).agg(F.count_distinct(qcol(target)).alias("n_classes"))
    else:
        ncls = spark.createDataFrame([(None,)], "n_classes long")
    if "anomaly" in problem:
        share = attach_one_row(outlier_counts(df, "iqr").agg(F.max("n_outliers").alias("mo")), base.withColumnRenamed("n_rows", "nr")).select(
            F.try_divide(F.col("mo").cast("double"), F.col("nr")).alias("outlier_share")
        )
    else:
        share = spark.createDataFrame([(None,)], "outlier_share double")
    needs_classes = problem in ("supervised_classification", "semi_supervised_classification", "time_series_classification")
    out = attach_one_row(attach_one_row(attach_one_row(req, base), ncls), share)
    return out.select(
        "problem_type",
        F.col("n_rows").cast("long").alias("n_rows"),
        "min_samples",
        (F.col("n_rows") >= F.coalesce(F.col("min_samples"), F.lit(0))).alias("enough_rows"),
        F.col("n_classes").cast("long").alias("n_classes"),
        (F.col("n_classes") >= 2 if needs_classes and target else F.lit(None).cast("boolean")).alias("enough_classes"),
        F.round("outlier_share", 6).alias("outlier_share"),
        (F.col("outlier_share") < 0.10).alias("rare_anomalies"),
    ).withColumn(
        "ok",
        F.col("enough_rows") & F.coalesce(F.col("enough_classes"), F.lit(True)) & F.coalesce(F.col("rare_anomalies"), F.lit(True)),
    )


def enforce_limits(df: DataFrame) -> DataFrame:
    """Report (never truncate) against the row and column limits."""
    n_cols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(n_cols).alias("n_cols"),
        (F.col("n_rows") <= MAX_ROWS).alias("rows_ok"),
        F.lit(n_cols <= MAX_COLUMNS).alias("cols_ok"),
        F.concat_ws(
            ",", F.when(F.col("n_rows") > MAX_ROWS, F.lit("ROWS_OVER_LIMIT")), F.when(F.lit(n_cols > MAX_COLUMNS), F.lit("COLUMNS_OVER_LIMIT"))
        ).alias("limit_codes"),
    )
