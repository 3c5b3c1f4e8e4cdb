from prepline.catalog.q_rules import light_profile
from prepline.operators import intent as M
from prepline.operators import rules as R
from prepline.sources.tables import load

SF = "/root/testdata/sf0.01"

GOLD = {
    ("orders", "o_orderkey"): ("numeric", "potential_target", 10, 15),
    ("orders", "o_custkey"): ("numeric", "potential_target", 10, 15),
    ("orders", "o_orderstatus"): ("text", "feature", 5, 0),
    ("orders", "o_totalprice"): ("numeric", "feature", 0, 5),
    ("orders", "o_orderdate"): ("datetime", "datetime", 0, 0),
    ("orders", "o_orderpriority"): ("text", "potential_target", 15, 10),
    ("events", "event_id"): ("numeric", "identifier", 0, 5),
    ("events", "event_type"): ("categorical", "potential_target", 15, 10),
    ("events", "props"): ("text", "feature", 5, 0),
    ("labels", "quality"): ("numeric", "potential_target", 10, 15),
    ("labels", "toxic"): ("numeric", "feature", 0, 5),
    ("part", "p_type"): ("categorical", "potential_target", 15, 10),
    ("lineitem", "l_quantity"): ("numeric", "potential_target", 10, 15),
    ("lineitem", "l_shipdate"): ("datetime", "datetime", 0, 0),
}


def test_roles_types_scores_golden(spark):
    for table in {t for t, _ in GOLD}:
        prof = light_profile(load(spark, SF, table))
        a = {r["column_name"]: r for r in R.analyze_schema(prof).collect()}
        sc = {r["column_name"]: r["score"] for r in R.target_scores(prof, "supervised_classification").collect()}
        sr = {r["column_name"]: r["score"] for r in R.target_scores(prof, "supervised_regression").collect()}
        for (t, c), (nt, role, s_c, s_r) in GOLD.items():
            if t != table:
                continue
            assert a[c]["name_type"] == nt, (t, c)
            assert a[c]["potential_role"] == role, (t, c)
            assert sc[c] == s_c and sr[c] == s_r, (t, c)


def test_identify_target_golden(spark):
    prof = light_profile(load(spark, SF, "orders"))
    r = R.identify_target(prof, "supervised_regression").first()
    assert (r["target"], r["confidence"], r["alternatives"]) == ("o_orderkey", 0.75, "o_custkey,o_orderpriority")
    r = R.identify_target(prof, "supervised_classification").first()
    assert (r["target"], r["confidence"], r["alternatives"]) == ("o_orderpriority", 0.75, "o_orderkey,o_custkey")
    r = R.identify_target(light_profile(load(spark, SF, "events")), "supervised_classification").first()
    assert (r["target"], r["confidence"], r["alternatives"]) == ("event_type", 0.75, None)
    r = R.identify_target(light_profile(load(spark, SF, "labels")), "supervised_classification").first()
    assert (r["target"], r["confidence"]) == ("quality", 0.5)


PROMPTS = [
    ("I want to predict house prices based on features like size, location, etc.", "supervised_regression", 0.1579, "data_description"),
    ("Classify customer segments", "unsupervised_clustering", 0.1875, "problem_goal,data_description"),
    ("I want to predict customer churn", "supervised_regression", 0.1053, "data_description"),
    ("Predict sales based on historical data", "supervised_regression", 0.1053, "problem_goal,data_description"),
    ("Customer segmentation analysis", "unsupervised_clustering", 0.25, "target_variable,problem_goal,data_description"),
    ("Forecast seasonal patterns in the monthly sales time series", "time_series_forecasting", 0.4118, "target_variable,problem_goal,data_description"),
    ("", "supervised_classification", 0.1, "problem_goal,target_variable,data_description"),
]


def test_prompt_goldens(spark):
    df = spark.createDataFrame([(i, p) for i, (p, *_) in enumerate(PROMPTS)], "id int, text string")
    got = {r["id"]: r for r in M.classify_prompts(df, "text").collect()}
    for i, (_, t, conf, req) in enumerate(PROMPTS):
        assert got[i]["problem_type"] == t
        assert abs(got[i]["confidence"] - conf) < 1e-4
        assert got[i]["required_clarifications"] == req
    # topics are asked in fixed order (target, goal, data, time), three each, at most three
    assert got[6]["questions"] == "target_variable:1,target_variable:2,target_variable:3"
    assert got[0]["questions"] == "data_description:1,data_description:2,data_description:3"
    assert got[1]["score_classification"] == round(1 / 11, 6)


def test_prompt_with_preview(spark):
    prev = spark.createDataFrame([(0, "size", "float64"), (1, "location", "object"), (2, "price", "float64")], "position int, column_name string, dtype string")
    df = spark.createDataFrame([(0, PROMPTS[0][0])], "id int, text string")
    r = M.classify_prompts(df, "text", preview_profile=prev).first()
    assert r["problem_type"] == "unsupervised_clustering" and abs(r["confidence"] - 0.24) < 1e-9
    assert abs(r["score_regression"] - 0.6 * 1.5 / 9.5) < 1e-6 and abs(r["score_anomaly"] - 0.16) < 1e-9


MODELS = [
    ("supervised_classification", 99, ["Logistic Regression"]),
    ("supervised_classification", 100, ["Random Forest", "Logistic Regression"]),
    ("supervised_classification", 500, ["Random Forest", "Logistic Regression", "Gradient Boosting"]),
    ("time_series_classification", 500, ["Random Forest", "Logistic Regression", "Gradient Boosting"]),
    ("supervised_regression", 50, ["Random Forest Regressor", "Linear Regression"]),
    ("unsupervised_clustering", 7, ["K-Means"]),
    ("time_series_forecasting", 7, ["Random Forest"]),
    ("unsupervised_dimensionality_reduction", 7, ["Random Forest"]),
]


def test_model_choice_golden(spark):
    for problem, n, expected in MODELS:
        req = spark.createDataFrame([(problem,)], "problem_type string")
        facts = spark.createDataFrame([(n, 3)], "n_rows long, n_cols long")
        got = [r["model_name"] for r in M.recommend_models(req, facts).orderBy("priority").collect()]
        assert got == expected, problem


def test_model_advice(spark):
    req = spark.createDataFrame([("unsupervised_clustering",)], "problem_type string")
    for n, cols, code in [(999, 3, "SMALL_PREFER_SIMPLE"), (1000, 3, ""), (100000, 3, ""), (100001, 3, "LARGE_COMPLEX_OK"), (5, 9, "SMALL_PREFER_SIMPLE,HIGH_DIM_REGULARISE")]:
        facts = spark.createDataFrame([(n, cols)], "n_rows long, n_cols long")
        assert M.recommend_models(req, facts).first()["advice"] == code
