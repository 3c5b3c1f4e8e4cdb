import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepline.operators import clean as C
from prepline.operators import features as FE
from prepline.operators import profile as P
from prepline.operators import rules as R


def by_name(df, key="column_name"):
    return {r[key]: r for r in df.collect()}


def test_missing_and_totals(small):
    m = by_name(P.missing_by_column(small))
    assert m["x"]["n_missing"] == 2 and m["x"]["missing_percentage"] == 33.33
    assert m["c"]["n_missing"] == 1 and m["c"]["missing_percentage"] == 16.67
    assert m["d"]["n_missing"] == 1
    t = P.missing_total(small).first()
    assert t["total_missing"] == 4 and t["total_cells"] == 30
    assert abs(t["missing_percentage"] - 13.333333) < 1e-5


def test_duplicates(small):
    d = P.duplicate_rows(small).first()
    assert d["duplicate_rows"] == 1 and abs(d["duplicate_percentage"] - 16.666667) < 1e-5


def test_profile_golden(small):
    p = by_name(P.column_profile(small))
    assert [p[c]["unique_values"] for c in ("id", "x", "c", "d", "b")] == [5, 4, 2, 4, 2]
    x = p["x"]
    assert x["mean"] == 4.0 and abs(x["std"] - 4.0825) < 1e-4 and x["median"] == 2.5
    assert p["c"]["data_type"] == "categorical"
    assert p["d"]["data_type"] == "text"
    assert p["b"]["data_type"] == "boolean"
    assert p["x"]["sample_values"] == "1.0|2.0|3.0|10.0"
    assert p["c"]["sample_values"] == "a|b"


def test_quartiles_and_outliers(small):
    b = by_name(P.outlier_bounds(small, "iqr", ["x"]))["x"]
    assert b["lower"] == -2.75 and b["upper"] == 9.25
    assert by_name(P.outlier_counts(small, "iqr", ["x"]))["x"]["n_outliers"] == 1
    assert by_name(P.outlier_counts(small, "modified_z", ["x"]))["x"]["n_outliers"] == 1
    assert by_name(P.outlier_counts(small, "zscore", ["x"]))["x"]["n_outliers"] == 0


def test_coercion_makes_datetime(small):
    coerced = C.coerce_datetimes(small)
    assert dict(coerced.dtypes)["d"] == "timestamp_ntz"
    assert dict(coerced.dtypes)["c"] == "string"


def test_scalers(small):
    s = {r["id"]: r["x"] for r in FE.scale(small, ["x"], "standard").collect()}
    assert abs(s[4] - 1.6971) < 1e-4
    mm = {r["id"]: r["x"] for r in FE.scale(small, ["x"], "minmax").collect()}
    assert abs(mm[2] - 0.1111) < 1e-4
    rb = {r["id"]: r["x"] for r in FE.scale(small, ["x"], "robust").collect()}
    assert rb[4] == 2.5


def test_issue_codes(small):
    s = P.dataset_summary(small).first()
    assert s["potential_issues"] == "SMALL_LT_100,DUPLICATE_ROWS"
    v = R.validate(P.dataset_summary(small)).first()
    assert v["is_valid"] and "SMALL_LT_100" in v["warnings"]


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "a double, b string")
    p = P.column_profile(empty).collect()
    assert len(p) == 2 and all(r["n_rows"] == 0 for r in p)
    assert P.column_profile(spark.range(3).select()).count() == 0
    const = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, k double")
    r = P.correlation_matrix(const).first()
    assert r["r"] is None
    one = spark.createDataFrame([(1.0,)], "a double")
    assert P.column_profile(one).first()["std"] is None
    nan = spark.createDataFrame([(float("nan"),), (None,)], "a double")
    prof = P.column_profile(nan).first()
    assert prof["n_missing"] == 2 and prof["unique_values"] == 0 and prof["mean"] is None
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert P.column_profile(zeros).first()["unique_values"] == 1


def test_name_collisions_and_unicode(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "` Order Key` int, `order-key` int, `ORDER KEY` int, `Größe` int")
    assert C.standardize_names(df).columns == ["order_key", "order_key_2", "order_key_3", "größe"]
    prof = P.column_profile(C.standardize_names(df))
    assert prof.count() == 4


def test_spearman_matches_pandas(spark):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1.0, 2.0, 2.0, 5.0, 7.0, 3.0], "b": [3.0, 1.0, 4.0, 4.0, 9.0, 2.0]})
    r = P.correlation_matrix(spark.createDataFrame(pdf), "spearman").first()["r"]
    ranks = pdf.rank(method="average")  # Spearman = Pearson on average ranks
    assert math.isclose(r, ranks["a"].corr(ranks["b"]), abs_tol=1e-6)


@pytest.mark.parametrize("method", ["pearson"])
def test_pairwise_complete(spark, method):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0, 5.0], "b": [2.0, 4.1, 6.0, None, 9.9], "c": [1.0, 0.0, 1.0, 0.0, 1.0]})
    got = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlation_matrix(spark.createDataFrame(pdf), method).collect()}
    exp = pdf.corr()
    for (a, b), v in got.items():
        assert math.isclose(v, exp.loc[a, b], abs_tol=1e-6)
    assert F is not None


def test_approximate_profile_close_to_exact(spark):
    from prepline.sources.tables import load

    li = load(spark, "/root/testdata/sf0.001", "lineitem")
    exact = by_name(P.column_profile(li))
    approx = by_name(P.column_profile(li, exact=False))
    for name, e in exact.items():
        a = approx[name]
        assert a["n_missing"] == e["n_missing"] and a["sample_values"] == e["sample_values"]
        if e["median"] is not None:
            lo, hi = e["min"], e["max"]
            assert lo <= a["median"] <= hi
    au = by_name(P.unique_values(li, exact=False))
    for name, e in exact.items():
        assert abs(au[name]["unique_values"] - e["unique_values"]) <= max(2, 0.05 * e["unique_values"])


def test_correlation_of_many_columns(spark):
    c = 300
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, c))
    x[:, 150] = 2 * x[:, 3] + 1
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7] = 5.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(c)])
    got = P.correlation_matrix(spark.createDataFrame(pdf).coalesce(3)).toPandas()
    assert len(got) == c * (c - 1) // 2
    r = got.set_index(["col_a", "col_b"])["r"]
    assert np.isnan(r["c0", "c7"]) and abs(r["c3", "c150"] - 1) < 1e-6
    want = pdf[["c1", "c2", "c299"]].corr()
    assert abs(r["c1", "c2"] - want.loc["c1", "c2"]) < 1e-6 and abs(r["c2", "c299"] - want.loc["c2", "c299"]) < 1e-6
