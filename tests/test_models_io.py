import os

from pyspark.sql import functions as F

from prepline.operators import models as T
from prepline.sources import readers as S
from prepline.sources.tables import lineitem_outlier

SF = "/root/testdata/sf0.001"


def test_isolation_forest_planted_outliers(spark):
    li = lineitem_outlier(spark, SF).withColumn("row_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    planted = li.where(F.col("l_orderkey") % 997 == 0).select("row_key")
    scores = T.isolation_forest(li, ["l_extendedprice", "l_quantity"], "row_key", n_trees=40)
    k = planted.count()
    assert k > 0
    top = scores.orderBy(F.desc("score")).limit(k * 3).join(planted, "row_key").count()
    assert top >= max(1, k // 2)


def test_lloyd_step_keeps_empty_center(spark):
    pts = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [10.0, 0.0])], "id int, x array<double>")
    cen = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [100.0, 100.0])], "center_id int, center array<double>")
    got = {r["center_id"]: (list(r["center"]), r["n"]) for r in T.lloyd_step(pts, "id", "x", cen).collect()}
    assert got[0] == ([0.5, 0.0], 2) and got[1] == ([10.0, 0.0], 1) and got[2] == ([100.0, 100.0], 0)


def test_csv_header_row_and_sniff(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("junk\nmore junk\na;b;c\n1;x;2.5\n2;y;3.5\n")
    df = S.read_csv(spark, str(p), separator=";", header_row=2)
    assert df.columns == ["a", "b", "c"] and df.count() == 2 and dict(df.dtypes)["c"] == "double"
    sn = {r["separator"]: r for r in S.sniff_separator(spark, str(tmp_path / "g.csv") if False else str(p)).collect()}
    assert not sn[";"]["consistent"]  # junk lines have one field
    q = tmp_path / "h.csv"
    q.write_text("a;b\n1;2\n3;4\n")
    assert {r["separator"] for r in S.sniff_separator(spark, str(q)).collect() if r["chosen"]} == {";"}


def test_feather_roundtrip(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), (F.col("id") * 0.5).alias("v"))
    S.write_feather(df, str(tmp_path / "fe")).count()
    back = S.read_feather(spark, os.path.join(str(tmp_path / "fe"), "part-*.feather"))
    assert back.count() == 100 and back.agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]


def test_format_dispatch():
    assert S.format_of("x.tsv", "json") == "csv"
    assert S.format_of("x.unknown", "auto") == "csv"
    assert S.format_of("x.unknown", "parquet") == "parquet"


def test_label_propagation_brute_force(spark):
    import numpy as np
    import pandas as pd

    rows = [(1, "a", "x", 1.0), (2, "a", "y", None), (3, "b", "y", 0.0), (4, "b", "z", None), (5, "c", "z", None), (6, "a", "x", 0.0)]
    df = spark.createDataFrame(rows, "k long, g1 string, g2 string, y double")
    got = {r["k"]: r["score"] for r in T.label_propagation(df, "k", "y", ["g1", "g2"], tol=1e-12).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "g1", "g2", "y"])
    s = pdf.y.copy()
    for _ in range(300):
        mem = pd.concat([pd.DataFrame({"k": pdf.k, "g": "g1=" + pdf.g1}), pd.DataFrame({"k": pdf.k, "g": "g2=" + pdf.g2})])
        cur = pd.Series(s.values, index=pdf.k)
        mem["s"] = mem.k.map(cur)
        gs = mem.dropna().groupby("g").s.mean()
        mem["gs"] = mem.g.map(gs)
        new = mem.groupby("k").gs.mean()
        s = pd.Series(np.where(pdf.y.notna(), pdf.y, pdf.k.map(new).fillna(pd.Series(s.values))), index=pdf.index)
    for k, v in zip(pdf.k, s):
        assert abs(got[k] - v) < 1e-9


def test_csv_header_row_keeps_quoted_breaks(spark, tmp_path):
    """Several files with preambles of their own, one of them without the second junk line; breaks and separators in quotes."""
    (tmp_path / "d").mkdir()
    for i, junk in enumerate(["made by, a tool\n\n", "one\ntwo\n", "only one\n"]):
        (tmp_path / "d" / f"{i}.csv").write_text(junk + 'id,note,v\n' + f'{i}1,"first\nsecond, third",1.5\n{i}2,"say ""hi""\n\nend",\n{i}3,,3.5\n')
    df = S.read_csv(spark, str(tmp_path / "d"), header_row=2)
    assert dict(df.dtypes) == {"id": "int", "note": "string", "v": "double"}
    got = {r["id"]: (r["note"], r["v"]) for r in df.collect()}
    assert len(got) == 9 and got[11] == ("first\nsecond, third", 1.5) and got[22][1] is None and got[3] == (None, 3.5)
    plan = df._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan
    (tmp_path / "e.csv").write_text('a,b\n1,"x\ny"\n')
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "e.csv")).collect()] == [(1, "x\ny")]


def test_rows_with_missing_features_stay(spark):
    from prepline.operators import models as M

    rows = [(k, None if k % 10 == 0 else float(k % 7), float("nan") if k % 10 == 5 else float(k % 3), float(k % 2) if k % 9 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    gone = {k for k in range(200) if k % 5 == 0}
    _, lin = M.linear_regression(df, ["a", "b"], "y", ["id"])
    model, piped, _ = M.train("Logistic Regression", df, ["a", "b"], "y", ["id"])
    for pred in (lin, piped, M.predict(model, df, ["a", "b"], ["id"]), M.bagging(df, ["a", "b"], "y", ["id"], n_bags=2, numTrees=3)):
        got = {r["id"]: r["prediction"] for r in pred.collect()}
        assert len(got) == 200 and {k for k, p in got.items() if p is None} == gone
    again = M.bagging(df.repartition(7), ["a", "b"], "y", ["id"], n_bags=1, numTrees=1)
    weights = df.select(M.bag_weight(F.col("id"), 0).alias("w")).agg(F.avg("w")).first()[0]
    assert again.count() == 200 and 0.7 < weights < 1.3


def test_pca_equals_a_symmetric_solver(spark):
    import numpy as np

    from prepline.operators import models as M

    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 100.0
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(X)] + [(999, None, 1.0, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double, e double")
    comp, proj, ratios = M.pca(df.repartition(6), list("abcde"), ["id"], k=2)
    values, vectors = np.linalg.eigh(np.cov(X.T))
    assert np.allclose([r["variance_ratio"] for r in ratios.orderBy("component").collect()], values[::-1][:2] / values.sum())
    got = {r["id"]: r["pcs"] for r in proj.collect()}
    assert got.pop(999) is None and len(got) == 300
    assert np.allclose(np.abs([got[k] for k in range(300)]), np.abs((X - X.mean(axis=0)) @ vectors[:, ::-1][:, :2]))
    assert np.allclose(np.abs(comp @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-8)


def test_late_rows_are_counted(spark, tmp_path):
    import datetime as dt

    from prepline.streaming.quality import run_quality_stream

    day = lambda d: dt.datetime(2024, 1, d, 12)
    slices = [[day(1), day(2), day(9)], [day(2), day(8), day(10)], [day(1), day(1), day(30)]]
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in slices:
        df = spark.createDataFrame([(t, 1.0) for t in rows], "ts timestamp_ntz, value double")
        df.write.mode("append").parquet(src)
        windows, batches = run_quality_stream(spark, src, df.schema, out, ck, "ts", "value", "1 day", "2 days")
    got = [(r["n_read"], r["n_on_time"], r["n_late"]) for r in batches.orderBy("batch_id").collect()]
    assert got == [(3, 3, 0), (3, 2, 1), (3, 1, 2)]
    assert windows.agg(F.sum("n_rows")).first()[0] == 6


def test_estimators_read_their_input_once(spark, tmp_path):
    """Features made from wide rows are written once; predictions do not go back to the files."""
    from pyspark.sql import functions as F

    from prepline.operators import models as M

    rows = [(i, f"word{i % 7} " * (i % 5 + 1), float(i % 2)) for i in range(60)]
    spark.createDataFrame(rows, "id long, text string, y double").write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    df = wide.select("id", F.length("text").alias("a"), "y")
    for pred in (
        M.train("Logistic Regression", df, ["a"], "y", ["id"])[1],
        M.bagging(df, ["a"], "y", ["id"], n_bags=1, numTrees=1),
    ):
        assert pred.count() == 60 and "FileScan" not in pred._jdf.queryExecution().toString()


def test_spread_grows_with_the_files(spark, tmp_path, monkeypatch):
    from prepline.sources import tables

    spark.range(20000).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    few = tables.load(spark, str(tmp_path), "orders").rdd.getNumPartitions()
    assert few == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "SPREAD_BYTES", 2000)
    many = tables.load(spark, str(tmp_path), "orders")
    assert many.rdd.getNumPartitions() > 2 * few and many.count() == 20000


def test_files_with_a_header_row_are_split(spark, tmp_path):
    """The query's files are read in several splits, each row once."""
    from prepline.catalog.q_io import s1h

    rows = [(k, k % 7, "O", float(k), "1-URGENT") for k in range(4000)]
    src = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    src.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        back = s1h(spark, str(tmp_path))
        assert back.rdd.getNumPartitions() > 20
        assert sorted(map(tuple, back.collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gaussian_mixture_passes_equal_mllib(spark, monkeypatch):
    """The passes over blocks give MLlib's weights, components and probabilities; MLlib itself only draws the start."""
    import random

    import pytest
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    from prepline.operators import models as M

    rng = random.Random(4)
    rows = [(k, [rng.gauss(8 * (k % 3), 1), rng.gauss(-5 * (k % 2), 2)]) for k in range(900)]
    d = spark.createDataFrame(rows, "k long, v array<double>").repartition(3, "k")
    want = GaussianMixture(k=3, seed=42, maxIter=20).fit(d.withColumn("features", array_to_vector("v")))
    passes = []
    once = M.em_pass
    monkeypatch.setattr(M, "em_pass", lambda *a: passes.append(1) or once(*a))
    got, pred = M.gaussian_mixture(d, "v", ["k"], k=3, maxIter=20)
    assert 1 < len(passes) <= 20
    assert got.weights == pytest.approx(want.weights, abs=1e-9)
    for a, b in zip(got.gaussiansDF.collect(), want.gaussiansDF.collect(), strict=True):
        assert a["mean"].toArray() == pytest.approx(b["mean"].toArray(), abs=1e-7)
        assert a["cov"].toArray() == pytest.approx(b["cov"].toArray(), abs=1e-7)
    sure = {r["k"]: r["prediction"] for r in want.transform(d.withColumn("features", array_to_vector("v"))).collect() if max(r["probability"]) > 0.51}
    assert pred.columns == ["k", "cluster", "probability"] and pred.count() == len(rows)
    assert {r["k"]: r["cluster"] for r in pred.collect() if r["k"] in sure} == sure


def test_self_training_rounds(spark):
    """Labels spread from two ends until a round adds none. The planner's estimate does not grow with the
    rounds: a checkpoint of a join kept the product of both sides, with twice the digits after each."""
    from pyspark.sql import functions as F

    from prepline.operators import models as M

    n = 240
    rows = [(i, float(i), float((i * 7) % 11), 0.0 if i < 24 else 1.0 if i >= n - 24 else None) for i in range(n)]
    rows += [(n, None, 1.0, None), (n + 1, float("nan"), 1.0, 1.0), (None, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(2, "id")
    model, out = M.self_training(df, ["a", "b"], "y", "id", threshold=0.8)
    got = {r["id"]: r for r in out.collect()}
    assert out.count() == len(rows) and set(got) == {r[0] for r in rows}
    assert [tuple(got[i])[2:] for i in (n, n + 1)] == [(None, None, None), (1.0, 0, None)]
    assert got[None]["training_label"] is None and got[None]["prediction"] == 0.0
    known = [got[i] for i in range(n)]
    assert all(r["training_label"] == r["y"] and r["labelled_in_round"] == 0 for r in known if r["y"] is not None)
    assert all((r["training_label"] is None) == (r["labelled_in_round"] is None) for r in known)
    rounds = {r["labelled_in_round"] for r in known} - {None}
    assert rounds == set(range(len(rounds))) and len(rounds) >= 2
    assert known[0]["prediction"] == 0.0 and known[-1]["prediction"] == 1.0
    # the last model is sure of no row that is left
    left = M.assemble(df.where(M.complete(df, ["a", "b"]) & F.col("id").isin([r["id"] for r in known if r["training_label"] is None])), ["a", "b"])
    assert all(max(r["probability"]) < 0.8 for r in model.transform(left).collect())
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 160


def test_document_features_are_counted_once(spark, tmp_path):
    """Whether a row has all features is known without counting its text; a NULL text has no counts."""
    from prepline.catalog import q_models as Q
    from prepline.operators import models as M

    texts = ["a b\n c", "", " a ", None, "\n\n", "x\u00a0y\tz"]
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None and i else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = Q.doc_features(spark, str(tmp_path), labelled_only=False)
    got = {r["doc_id"]: (r["n_lines"], r["n_words"], r["quality"]) for r in df.collect()}
    assert got == {0: (2, 3, None), 1: (1, 1, 1.0), 2: (1, 3, None), 3: (None, None, None), 4: (3, 2, None), 5: (1, 2, None)}
    ok = df.where(M.complete(df, Q.DOC_FEATURES))
    assert sorted(r["doc_id"] for r in ok.collect()) == [1, 2, 4, 5]
    assert ok.select("doc_id", *Q.DOC_FEATURES)._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert "split(" not in df.where(~M.complete(df, Q.DOC_FEATURES)).select("doc_id")._jdf.queryExecution().optimizedPlan().toString()


def test_complete_asks_for_nan(spark):
    from prepline.operators import models as M

    df = spark.sql("select * from values (1, 1.0d, '2'), (2, double('NaN'), '2'), (3, 1.0d, 'NaN'), (null, 1.0d, '2'), (5, null, '2'), (6, 1.0d, null) as t(i, d, s)")
    assert [r["i"] for r in df.where(M.complete(df, ["i", "d", "s"])).collect()] == [1]
