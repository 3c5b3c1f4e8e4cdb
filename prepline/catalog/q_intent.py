"""Registered request-classification and model-choice queries (M1-M5)."""

from __future__ import annotations

from prepline.catalog import register
from prepline.catalog.sqlgen import contains_any, lit, meta_values, role_sql
from prepline.operators import intent as M
from prepline.operators import rules as R
from prepline.sources.tables import load


def _score_sql(t: str, text: str = "text") -> str:
    low = f"lower(coalesce({text}, ''))"
    terms = [f"CASE WHEN contains({low}, {lit(w)}) THEN {M.KEYWORD_WEIGHT} ELSE 0.0 END" for w in M.KEYWORDS[t]]
    terms += [f"CASE WHEN contains({low}, {lit(w)}) THEN {M.INDICATOR_WEIGHT} ELSE 0.0 END" for w in M.INDICATORS[t]]
    return f"((0.0 + {' + '.join(terms)}) / {M.MAX_SCORE[t]})"


def _data_sql(table: str) -> dict[str, str]:
    meta = meta_values(table)
    tgt = f"(SELECT coalesce(bool_or({contains_any('column_name', M.PREVIEW_TARGET_WORDS)}), false) FROM {meta})"
    dt = f"(SELECT coalesce(bool_or(contains(dtype, 'datetime') OR contains(lower(column_name), 'date')), false) FROM {meta})"
    out = {}
    for t in M.SCORED_TYPES:
        v = "0.0"
        if t in M.PREVIEW_SCORES["target"]:
            v = f"CASE WHEN {tgt} THEN {M.PREVIEW_SCORES['target'][t]} ELSE {v} END"
        if t in M.PREVIEW_SCORES["no_target"]:
            v = f"CASE WHEN NOT {tgt} THEN {M.PREVIEW_SCORES['no_target'][t]} ELSE {v} END"
        if t in M.PREVIEW_SCORES["datetime"]:
            v = f"CASE WHEN {dt} THEN {M.PREVIEW_SCORES['datetime'][t]} ELSE {v} END"
        out[t] = f"CAST({v} AS DOUBLE)"
    return out


def classify_sql(source: str, keys: list[str], preview_table: str | None = None) -> str:
    if preview_table:
        data = _data_sql(preview_table)
        scores = {t: f"({M.TEXT_WEIGHT} * {_score_sql(t)} + {M.DATA_WEIGHT} * {data[t]})" for t in M.SCORED_TYPES}
    else:
        scores = {t: _score_sql(t) for t in M.SCORED_TYPES}
    sc = ", ".join(f"{scores[t]} AS score_{M.short(t)}" for t in M.SCORED_TYPES)
    names = [f"score_{M.short(t)}" for t in M.SCORED_TYPES]
    best = "greatest(" + ", ".join(names) + ")"
    best_type = "CASE " + " ".join(f"WHEN {n} = {best} THEN {lit(t)}" for n, t in zip(names, M.SCORED_TYPES, strict=True)) + " END"
    low = "lower(coalesce(text, ''))"
    missing = (
        f"concat_ws(',', CASE WHEN NOT {contains_any(low, M.MISSING_TARGET_WORDS)} THEN 'target_variable' END, "
        f"CASE WHEN NOT {contains_any(low, M.MISSING_GOAL_WORDS)} THEN 'problem_goal' END"
        + ("" if preview_table else ", 'data_description'")
        + ")"
    )
    all_zero = f"({best} <= 0)"
    needs = f"({all_zero} OR {best} < {M.CLARIFY_BELOW})"
    required = f"CASE WHEN {all_zero} THEN {lit(','.join(M.ALL_ZERO_CLARIFICATIONS))} WHEN {needs} THEN {missing} ELSE '' END"
    topics = ", ".join(
        f"CASE WHEN list_contains(string_split(required_clarifications, ','), {lit(t)}) THEN [{', '.join(lit(f'{t}:{i}') for i in range(1, 4))}] ELSE []::VARCHAR[] END"
        for t in M.QUESTION_TOPICS
    )
    conf = f"CASE WHEN {all_zero} THEN {M.DEFAULT_CONFIDENCE} ELSE {best} END"
    k = ", ".join(keys)
    return f"""SELECT *, array_to_string(list_slice(flatten([{topics}]), 1, 3), ',') AS questions FROM (
SELECT {k}, {', '.join(f'round({n}, 6) AS {n}' for n in names)},
  CASE WHEN {all_zero} THEN {lit(M.DEFAULT_TYPE)} ELSE {best_type} END AS problem_type,
  round({conf}, 6) AS confidence,
  CASE WHEN {conf} < {M.LOW_CONFIDENCE} THEN 'low' WHEN {conf} < {M.CLARIFY_BELOW} THEN 'clarify' ELSE 'confident' END AS confidence_band,
  {needs} AS needs_clarification, {required} AS required_clarifications
FROM (SELECT {k}, text, {sc} FROM {source}))"""


@register("m1_classify_prompts_conversations", classify_sql("conversations", ["conv_id", "turn"]))
def m1(spark, sf):
    conv = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    return M.classify_prompts(conv, "text").drop("text")


@register("m1_classify_prompts_documents_with_preview", classify_sql("documents", ["doc_id"], preview_table="orders"))
def m1p(spark, sf):
    from prepline.catalog.q_rules import light_profile

    docs = load(spark, sf, "documents").select("doc_id", "text")
    preview = light_profile(load(spark, sf, "orders"))
    return M.classify_prompts(docs, "text", preview_profile=preview).drop("text")


@register(
    "m2_missing_info_conversations",
    f"""SELECT conv_id, turn, missing_info, array_to_string(list_slice(flatten([{', '.join(
        f"CASE WHEN list_contains(string_split(missing_info, ','), {lit(t)}) THEN [{', '.join(lit(f'{t}:{i}') for i in range(1, 4))}] ELSE []::VARCHAR[] END"
        for t in M.QUESTION_TOPICS)}]), 1, 3), ',') AS questions
FROM (SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT {contains_any("lower(coalesce(text, ''))", M.MISSING_TARGET_WORDS)} THEN 'target_variable' END,
  CASE WHEN NOT {contains_any("lower(coalesce(text, ''))", M.MISSING_GOAL_WORDS)} THEN 'problem_goal' END, 'data_description') AS missing_info FROM conversations)""",
)
def m2(spark, sf):
    conv = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    return M.missing_info(conv, "text").drop("text")


def _preview_sql(table: str) -> str:
    d = _data_sql(table)
    meta = meta_values(table)
    return (
        f"SELECT (SELECT coalesce(bool_or({contains_any('column_name', M.PREVIEW_TARGET_WORDS)}), false) FROM {meta}) AS has_likely_target, "
        f"(SELECT coalesce(bool_or(contains(dtype, 'datetime') OR contains(lower(column_name), 'date')), false) FROM {meta}) AS has_datetime, "
        + ", ".join(f"{d[t]} AS data_{M.short(t)}" for t in M.SCORED_TYPES)
        + f" WHERE (SELECT count(*) FROM {table}) >= 0"
    )


@register("m3_data_pattern_scores_orders", _preview_sql("orders"))
def m3(spark, sf):
    from prepline.catalog.q_rules import light_profile

    return M.data_pattern_scores(light_profile(load(spark, sf, "orders")))


@register("m3_data_pattern_scores_customer", _preview_sql("customer"))
def m3c(spark, sf):
    from prepline.catalog.q_rules import light_profile

    return M.data_pattern_scores(light_profile(load(spark, sf, "customer")))


def _facts_sql(table: str) -> str:
    return f"""(SELECT (SELECT CAST(count(*) AS BIGINT) FROM {table}) AS n_rows, CAST(count(*) AS BIGINT) AS n_cols,
  coalesce(bool_or({role_sql()} = 'potential_target'), false) AS has_target, coalesce(bool_or(starts_with(dtype, 'datetime')), false) AS has_datetime
FROM {meta_values(table)})"""


def _requests_sql() -> str:
    return f"(SELECT conv_id, turn, problem_type FROM ({classify_sql('conversations', ['conv_id', 'turn'])}))"


_CAP_VALUES = ", ".join(
    [f"({lit(p)}, 'supported')" for p in M.SUPPORTED] + [f"({lit(p)}, 'partial')" for p in M.PARTIAL] + [f"({lit(p)}, 'unsupported')" for p in M.UNSUPPORTED]
)
_MIN_VALUES = ", ".join(f"({lit(p)}, {n})" for p, n in R.MIN_SAMPLES.items())


@register(
    "m4_validate_capability",
    f"""WITH r AS {_requests_sql()}, f AS {_facts_sql('orders')},
cap AS (SELECT * FROM (VALUES {_CAP_VALUES}) AS c(problem_type, support_level)),
mins AS (SELECT * FROM (VALUES {_MIN_VALUES}) AS m(problem_type, min_samples))
SELECT r.conv_id, r.turn, r.problem_type, coalesce(cap.support_level, 'unknown') = 'supported' AS is_supported,
  coalesce(cap.support_level, 'unknown') AS support_level, mins.min_samples,
  concat_ws(',', CASE WHEN f.n_rows < 100 THEN 'SMALL_LT_100' END, CASE WHEN f.n_cols < 2 THEN 'FEW_COLUMNS_LT_2' END,
    CASE WHEN (starts_with(r.problem_type, 'supervised') OR starts_with(r.problem_type, 'semi_supervised')) AND NOT f.has_target THEN 'NEEDS_TARGET' END,
    CASE WHEN contains(r.problem_type, 'time_series') AND NOT f.has_datetime THEN 'NEEDS_DATETIME' END) AS data_issues,
  CASE WHEN coalesce(cap.support_level, 'unknown') = 'supported' AND concat_ws(',', CASE WHEN f.n_rows < 100 THEN 'SMALL_LT_100' END, CASE WHEN f.n_cols < 2 THEN 'FEW_COLUMNS_LT_2' END,
    CASE WHEN (starts_with(r.problem_type, 'supervised') OR starts_with(r.problem_type, 'semi_supervised')) AND NOT f.has_target THEN 'NEEDS_TARGET' END,
    CASE WHEN contains(r.problem_type, 'time_series') AND NOT f.has_datetime THEN 'NEEDS_DATETIME' END) = '' THEN 'proceed' ELSE 'clarify_requirements' END AS recommendation
FROM r CROSS JOIN f LEFT JOIN cap USING (problem_type) LEFT JOIN mins USING (problem_type)""",
)
def m4(spark, sf):
    from prepline.catalog.q_rules import light_profile

    conv = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    req = M.classify_prompts(conv, "text").select("conv_id", "turn", "problem_type")
    facts = R.data_facts(light_profile(load(spark, sf, "orders")))
    return M.validate_capability(req, facts)


_CATALOGUE_VALUES = ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in M.MODEL_CATALOGUE)


@register(
    "m5_recommend_models",
    f"""WITH r AS {_requests_sql()}, f AS {_facts_sql('orders')},
cat AS (SELECT * FROM (VALUES {_CATALOGUE_VALUES}) AS c(family, model_name, model_type, priority, min_samples, complexity, interpretability, performance_expectation, training_time)),
b AS (SELECT r.*, f.*, CASE WHEN contains(problem_type, 'classification') THEN 'classification' WHEN contains(problem_type, 'regression') THEN 'regression'
        WHEN contains(problem_type, 'clustering') THEN 'clustering' ELSE 'default' END AS family FROM r CROSS JOIN f)
SELECT b.conv_id, b.turn, b.problem_type, cat.model_name, cat.model_type, cat.priority, cat.complexity, cat.interpretability, cat.performance_expectation, cat.training_time,
  concat_ws(',', CASE WHEN b.n_rows < {M.SMALL_DATASET} THEN 'SMALL_PREFER_SIMPLE' WHEN b.n_rows > {M.LARGE_DATASET} THEN 'LARGE_COMPLEX_OK' END,
    CASE WHEN b.n_cols > b.n_rows THEN 'HIGH_DIM_REGULARISE' END,
    CASE WHEN b.family = 'classification' THEN 'BASELINE_LOGISTIC' WHEN b.family = 'regression' THEN 'BASELINE_LINEAR' END) AS advice
FROM b JOIN cat USING (family) WHERE b.n_rows >= cat.min_samples""",
)
def m5(spark, sf):
    from prepline.catalog.q_rules import light_profile

    conv = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    req = M.classify_prompts(conv, "text").select("conv_id", "turn", "problem_type")
    facts = R.data_facts(light_profile(load(spark, sf, "orders")))
    return M.recommend_models(req, facts)

