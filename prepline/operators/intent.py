"""Problem classification of free-text requests and model choice (M1-M5), re-aimed at
tables: a DataFrame of requests is scored in one projection (no join, no shuffle) -- every
lexicon term is a ``instr(lower(text), term)`` test inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.functions.exprs import attach_one_row, lower_contains_any

# ---- fixed values: the five scored problem types (tie order = this order) and their lexicon ----
SCORED_TYPES = [
    "supervised_classification",
    "supervised_regression",
    "unsupervised_clustering",
    "unsupervised_anomaly_detection",
    "time_series_forecasting",
]
KEYWORDS = {
    "supervised_classification": [
        "classify", "classification", "predict category", "identify class", "binary classification",
        "multi-class", "sentiment analysis", "image recognition", "spam detection",
    ],
    "supervised_regression": [
        "predict", "regression", "forecast", "estimate value", "continuous prediction", "price prediction", "sales forecast",
    ],
    "unsupervised_clustering": ["cluster", "group", "segment", "find patterns", "customer segmentation", "market segmentation"],
    "unsupervised_anomaly_detection": ["anomaly", "outlier", "fraud detection", "abnormal", "unusual patterns", "detect anomalies"],
    "time_series_forecasting": ["time series", "forecast", "predict future", "temporal", "trend analysis", "seasonal patterns"],
}
INDICATORS = {
    "supervised_classification": ["categories", "classes", "labels", "discrete target"],
    "supervised_regression": ["continuous", "numerical target", "price", "value", "amount"],
    "unsupervised_clustering": ["groups", "clusters", "segments", "similar items"],
    "unsupervised_anomaly_detection": ["outliers", "anomalies", "fraud", "unusual"],
    "time_series_forecasting": ["time", "date", "temporal", "sequential", "trend"],
}
KEYWORD_WEIGHT = 1.0
INDICATOR_WEIGHT = 0.5
TEXT_WEIGHT = 0.6
DATA_WEIGHT = 0.4
LOW_CONFIDENCE = 0.3
CLARIFY_BELOW = 0.7
DEFAULT_TYPE = "supervised_classification"
DEFAULT_CONFIDENCE = 0.1
PREVIEW_TARGET_WORDS = ["target", "label", "class", "y", "output", "prediction"]
PREVIEW_SCORES = {  # (condition, type, score)
    "target": {"supervised_classification": 0.7, "supervised_regression": 0.7},
    "datetime": {"time_series_forecasting": 0.8},
    "no_target": {"unsupervised_clustering": 0.6, "unsupervised_anomaly_detection": 0.4},
}
MISSING_TARGET_WORDS = ["predict", "target", "outcome", "label", "class"]
MISSING_GOAL_WORDS = ["goal", "want", "need", "trying", "business", "problem"]
ALL_ZERO_CLARIFICATIONS = ["problem_goal", "target_variable", "data_description"]
QUESTION_TOPICS = ["target_variable", "problem_goal", "data_description", "time_component"]
QUESTIONS_PER_TOPIC = 3
MAX_QUESTIONS = 3
SUPPORTED = [
    "supervised_classification",
    "supervised_regression",
    "unsupervised_clustering",
    "unsupervised_dimensionality_reduction",
    "unsupervised_anomaly_detection",
    "time_series_forecasting",
]
PARTIAL = ["semi_supervised_classification", "time_series_classification"]
UNSUPPORTED = ["reinforcement_learning", "deep_learning_advanced", "nlp_advanced", "computer_vision_advanced"]
# model catalogue: (family, model, model_type, priority, min_samples, complexity, interpretability, performance, training_time)
MODEL_CATALOGUE = [
    ("classification", "Random Forest", "ensemble", 1, 100, "medium", "medium", "high", "medium"),
    ("classification", "Logistic Regression", "linear", 2, 0, "low", "high", "medium", "fast"),
    ("classification", "Gradient Boosting", "ensemble", 3, 500, "high", "low", "high", "slow"),
    ("regression", "Random Forest Regressor", "ensemble", 1, 0, "medium", "medium", "high", "medium"),
    ("regression", "Linear Regression", "linear", 2, 0, "low", "high", "medium", "fast"),
    ("clustering", "K-Means", "centroid", 1, 0, "low", "high", "medium", "fast"),
    ("default", "Random Forest", "ensemble", 1, 0, "medium", "medium", "medium", "medium"),
]
SMALL_DATASET = 1000
LARGE_DATASET = 100000
# ---- end of fixed values ----

MAX_SCORE = {t: len(KEYWORDS[t]) * KEYWORD_WEIGHT + len(INDICATORS[t]) * INDICATOR_WEIGHT for t in SCORED_TYPES}


def short(t: str) -> str:
    return {
        "supervised_classification": "classification",
        "supervised_regression": "regression",
        "unsupervised_clustering": "clustering",
        "unsupervised_anomaly_detection": "anomaly",
        "time_series_forecasting": "time_series",
    }[t]


def text_score(text: Column, problem_type: str) -> Column:
    """Normalised lexicon score of one problem type: (+1 per keyword, +0.5 per indicator) / max."""
    low = F.lower(F.coalesce(text, F.lit("")))
    s = F.lit(0.0)
    for w in KEYWORDS[problem_type]:
        s = s + F.when(F.instr(low, w) > 0, KEYWORD_WEIGHT).otherwise(0.0)
    for w in INDICATORS[problem_type]:
        s = s + F.when(F.instr(low, w) > 0, INDICATOR_WEIGHT).otherwise(0.0)
    return s / MAX_SCORE[problem_type]


def data_pattern_scores(profile: DataFrame) -> DataFrame:
    """M3: one row (has_likely_target, has_datetime, data_<type> x 5) from a column table."""
    name, dtype = F.col("column_name"), F.col("dtype")
    facts = profile.agg(
        F.coalesce(F.bool_or(lower_contains_any(name, PREVIEW_TARGET_WORDS)), F.lit(False)).alias("has_likely_target"),
        F.coalesce(F.bool_or(dtype.contains("datetime") | F.lower(name).contains("date")), F.lit(False)).alias("has_datetime"),
    )
    cols = []
    for t in SCORED_TYPES:
        v = F.lit(0.0)
        if t in PREVIEW_SCORES["target"]:
            v = F.when(F.col("has_likely_target"), F.lit(PREVIEW_SCORES["target"][t])).otherwise(v)
        if t in PREVIEW_SCORES["no_target"]:
            v = F.when(~F.col("has_likely_target"), F.lit(PREVIEW_SCORES["no_target"][t])).otherwise(v)
        if t in PREVIEW_SCORES["datetime"]:
            v = F.when(F.col("has_datetime"), F.lit(PREVIEW_SCORES["datetime"][t])).otherwise(v)
        cols.append(v.alias(f"data_{short(t)}"))
    return facts.select("has_likely_target", "has_datetime", *cols)


def missing_info_expr(text: Column, has_preview: bool) -> Column:
    """M2: array of missing-information codes for one request."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(~lower_contains_any(low, MISSING_TARGET_WORDS), F.lit("target_variable")),
            F.when(~lower_contains_any(low, MISSING_GOAL_WORDS), F.lit("problem_goal")),
            F.lit(None if has_preview else "data_description").cast("string"),
        )
    )


def question_codes(missing: Column) -> Column:
    """M2: at most three question codes, topics in fixed order, three per topic."""
    per_topic = [
        F.when(F.array_contains(missing, t), F.array(*[F.lit(f"{t}:{i}") for i in range(1, QUESTIONS_PER_TOPIC + 1)])).otherwise(F.array().cast("array<string>"))
        for t in QUESTION_TOPICS
    ]
    return F.slice(F.flatten(F.array(*per_topic)), 1, MAX_QUESTIONS)


def classify_prompts(requests: DataFrame, text_col: str, preview_profile: DataFrame | None = None) -> DataFrame:
    """M1 (+M2): per request -- five scores, best type, confidence, clarification codes.

    With a preview (a column table of the data the request is about), scores become
    0.6 * text + 0.4 * data. Best = highest score, ties in SCORED_TYPES order; all zero
    gives the default type at confidence 0.1 and the fixed clarification list.
    """
    text = F.col(text_col)
    out = requests
    for t in SCORED_TYPES:
        out = out.withColumn(f"text_{short(t)}", text_score(text, t))
    if preview_profile is not None:
        out = attach_one_row(out, data_pattern_scores(preview_profile).drop("has_likely_target", "has_datetime"))
        for t in SCORED_TYPES:
            s = short(t)
            out = out.withColumn(f"score_{s}", TEXT_WEIGHT * F.col(f"text_{s}") + DATA_WEIGHT * F.col(f"data_{s}")).drop(f"data_{s}")
    else:
        for t in SCORED_TYPES:
            out = out.withColumnRenamed(f"text_{short(t)}", f"score_{short(t)}")
    for t in SCORED_TYPES:
        if f"text_{short(t)}" in out.columns:
            out = out.drop(f"text_{short(t)}")
    cands = F.array(*[F.struct(F.col(f"score_{short(t)}").alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(SCORED_TYPES)])
    best = F.array_max(cands)
    all_zero = best["s"] <= 0
    conf = F.when(all_zero, F.lit(DEFAULT_CONFIDENCE)).otherwise(best["s"])
    missing = missing_info_expr(text, preview_profile is not None)
    needs = all_zero | (best["s"] < CLARIFY_BELOW)
    required = F.when(all_zero, F.array(*[F.lit(c) for c in ALL_ZERO_CLARIFICATIONS])).when(needs, missing).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("problem_type", F.when(all_zero, F.lit(DEFAULT_TYPE)).otherwise(best["t"]))
    out = out.withColumn("confidence", F.round(conf, 6))
    out = out.withColumn("confidence_band", F.when(conf < LOW_CONFIDENCE, "low").when(conf < CLARIFY_BELOW, "clarify").otherwise("confident"))
    out = out.withColumn("needs_clarification", needs)
    out = out.withColumn("required_clarifications", F.array_join(required, ","))
    out = out.withColumn("questions", F.array_join(question_codes(required), ","))
    for t in SCORED_TYPES:
        out = out.withColumn(f"score_{short(t)}", F.round(f"score_{short(t)}", 6))
    return out


def missing_info(requests: DataFrame, text_col: str, has_preview: bool = False) -> DataFrame:
    """M2 alone: (…, missing_info, questions) per request."""
    m = missing_info_expr(F.col(text_col), has_preview)
    return requests.withColumn("missing_info", F.array_join(m, ",")).withColumn("questions", F.array_join(question_codes(m), ","))


def capability_table(spark) -> DataFrame:
    rows = [(p, "supported") for p in SUPPORTED] + [(p, "partial") for p in PARTIAL] + [(p, "unsupported") for p in UNSUPPORTED]
    return spark.createDataFrame(rows, "problem_type string, support_level string")


def validate_capability(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """M4: requests (…, problem_type) + a one-row facts table (n_rows, n_cols, has_target,
    has_datetime) -> support level, R12 data issues, minimum samples, recommendation."""
    from prepline.operators.rules import MIN_SAMPLES, _is_supervised  # noqa: F401

    spark = requests.sparkSession
    cap = capability_table(spark)  # 14 rows: fixed size
    mins = spark.createDataFrame(list(MIN_SAMPLES.items()), "problem_type string, min_samples int")
    p = F.col("problem_type")
    sup = p.startswith("supervised") | p.startswith("semi_supervised")
    out = attach_one_row(requests, facts).join(F.broadcast(cap), "problem_type", "left").join(F.broadcast(mins), "problem_type", "left")
    issues = F.concat_ws(
        ",",
        F.when(F.col("n_rows") < 100, F.lit("SMALL_LT_100")),
        F.when(F.col("n_cols") < 2, F.lit("FEW_COLUMNS_LT_2")),
        F.when(sup & ~F.col("has_target"), F.lit("NEEDS_TARGET")),
        F.when(p.contains("time_series") & ~F.col("has_datetime"), F.lit("NEEDS_DATETIME")),
    )
    level = F.coalesce(F.col("support_level"), F.lit("unknown"))
    return out.select(
        *requests.columns,
        (level == "supported").alias("is_supported"),
        level.alias("support_level"),
        F.col("min_samples"),
        issues.alias("data_issues"),
        F.when((level == "supported") & (issues == ""), F.lit("proceed")).otherwise(F.lit("clarify_requirements")).alias("recommendation"),
    )


def model_catalogue(spark) -> DataFrame:
    return spark.createDataFrame(
        MODEL_CATALOGUE,
        "family string, model_name string, model_type string, priority int, min_samples int, complexity string, "
        "interpretability string, performance_expectation string, training_time string",
    )


def family_of(problem: Column) -> Column:
    return (
        F.when(problem.contains("classification"), "classification")
        .when(problem.contains("regression"), "regression")
        .when(problem.contains("clustering"), "clustering")
        .otherwise("default")
    )


def recommend_models(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """M5: requests (…, problem_type) x catalogue rows of the problem's family that suit the
    row count, with advice codes. The catalogue has 7 rows (broadcast, fixed size)."""
    cat = model_catalogue(requests.sparkSession)
    base = attach_one_row(requests, facts).withColumn("family", family_of(F.col("problem_type")))
    joined = base.join(F.broadcast(cat), "family").where(F.col("n_rows") >= F.col("min_samples"))
    advice = F.concat_ws(
        ",",
        F.when(F.col("n_rows") < SMALL_DATASET, F.lit("SMALL_PREFER_SIMPLE")).when(F.col("n_rows") > LARGE_DATASET, F.lit("LARGE_COMPLEX_OK")),
        F.when(F.col("n_cols") > F.col("n_rows"), F.lit("HIGH_DIM_REGULARISE")),
        F.when(F.col("family") == "classification", F.lit("BASELINE_LOGISTIC")).when(F.col("family") == "regression", F.lit("BASELINE_LINEAR")),
    )
    return joined.select(
        *requests.columns,
        "model_name",
        "model_type",
        "priority",
        "complexity",
        "interpretability",
        "performance_expectation",
        "training_time",
        advice.alias("advice"),
    )


def score_columns(types: Sequence[str] = SCORED_TYPES) -> list[str]:
    return [f"score_{short(t)}" for t in types]
