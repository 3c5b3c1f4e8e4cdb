"""Fitted preprocessing (F2): statistics learnt once, on the training rows, as a table that can be
written, read back and applied to any table with the plan's columns.

One row per statistic: (step_order, position, column_name, step, method, stat, text, value). Each
step is fitted on the data as the steps before it leave them, all columns of a step in one
pass, so the jobs depend on the kinds of steps, never on the number of columns. What
:func:`apply_plan` reads into the driver is the plan and its scalars (a few per column and the
levels of one-hot columns, at most ``WIDE_LEVELS`` each); codes of ordinal columns stay a
table and are joined. A one-hot column with more levels than that is fitted as ordinal, which its
row in the table says.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.functions.exprs import is_numeric
from prepline.functions.ordering import running_before
from prepline.operators import features as FE
from prepline.session import cut_lineage

FITTED = "step_order int, position int, column_name string, step string, method string, stat string, text string, value double"
WIDE_LEVELS = 1000
TEST_SHARE = 0.2

Row = dict


def _row(step: Row, stat: str | None, text: str | None = None, value: float | None = None, method: str | None = None) -> Row:
    return {**step, "method": method or step["method"], "stat": stat, "text": text, "value": value}


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, v): every non-missing cell of the listed columns as text."""
    args = [x for i, c in enumerate(columns) for x in (F.lit(i), F.when(~FE._missing(df, c), FE.q(c).cast("string")))]
    return df.select(F.stack(F.lit(len(columns)), *args).alias("i", "v")).where(F.col("v").isNotNull())


def _fit_impute(df: DataFrame, steps: list[Row]) -> list[Row]:
    out = []
    means = [s for s in steps if s["method"] == "mean"]
    modes = [s for s in steps if s["method"] != "mean"]
    if means:
        got = df.agg(*[F.avg(FE._dbl(df, s["column_name"])).alias(f"m{i}") for i, s in enumerate(means)]).first()
        out += [_row(s, "fill", value=got[f"m{i}"]) for i, s in enumerate(means)]
    if modes:
        counts = _long(df, [s["column_name"] for s in modes]).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy("i").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))  # one row per column
        got = {r["i"]: r["v"] for r in top.collect()}
        out += [_row(s, "fill", text=got.get(i)) for i, s in enumerate(modes)]
    return out


def _fit_outliers(df: DataFrame, steps: list[Row]) -> list[Row]:
    qs = FE.column_quantiles(df, [s["column_name"] for s in steps], [0.25, 0.75], ["q1", "q3"])
    got = {r["position"]: (r["q1"], r["q3"]) for r in qs.collect()}  # one row per column
    out = []
    for i, s in enumerate(steps):
        q1, q3 = got.get(i, (None, None))
        known = q1 is not None
        out.append(_row(s, "low", value=q1 - 1.5 * (q3 - q1) if known else None))
        out.append(_row(s, "high", value=q3 + 1.5 * (q3 - q1) if known else None))
    return out


def _fit_scale(df: DataFrame, steps: list[Row]) -> list[Row]:
    aggs = []
    for i, s in enumerate(steps):
        v = FE._dbl(df, s["column_name"])
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"d{i}")]
    got = df.agg(*aggs).first()
    return [r for i, s in enumerate(steps) for r in (_row(s, "mean", value=got[f"m{i}"]), _row(s, "std", value=got[f"d{i}"]))]


def _fit_encode(df: DataFrame, steps: list[Row]) -> tuple[list[Row], DataFrame | None]:
    levels = cut_lineage(_long(df, [s["column_name"] for s in steps]).distinct())
    count = {r["i"]: r["count"] for r in levels.groupBy("i").count().collect()}  # one row per column
    wide = [i for i, s in enumerate(steps) if s["method"] == "one_hot" and count.get(i, 0) <= WIDE_LEVELS]
    out = []
    if wide:
        for r in sorted(levels.where(F.col("i").isin(wide)).collect()):  # at most WIDE_LEVELS per column
            out.append(_row(steps[r["i"]], "level", text=r["v"]))
        out += [_row(steps[i], None) for i in wide]
    coded = [i for i in range(len(steps)) if i not in wide]
    if not coded:
        return out, None
    out += [_row(steps[i], None, method="ordinal") for i in coded]
    ranked = running_before(levels.where(F.col("i").isin(coded)).withColumn("one", F.lit(1)), ["i"], "v", "one", out="code")
    meta = df.sparkSession.createDataFrame([(i, s["step_order"], s["position"], s["column_name"]) for i, s in enumerate(steps)], "i int, step_order int, position int, column_name string")
    codes = ranked.join(F.broadcast(meta), "i").select(
        "step_order", "position", "column_name", F.lit("encode").alias("step"), F.lit("ordinal").alias("method"), F.lit("code").alias("stat"), F.col("v").alias("text"), F.col("code").cast("double").alias("value")
    )
    return out, cut_lineage(codes)


def fit_plan(train: DataFrame, steps: DataFrame, key: str | None = None) -> DataFrame:
    """The fitted table of a plan (F1) on the training rows. ``key`` names the split's key."""
    plan = [r.asDict() for r in steps.orderBy("step_order", F.col("position").asc_nulls_last()).collect()]  # a few rows per column
    plan = [{k: r[k] for k in ("step_order", "position", "column_name", "step", "method")} for r in plan]
    fit = {"impute": _fit_impute, "treat_outliers": _fit_outliers, "scale": _fit_scale}
    spark, rows, codes, cur = train.sparkSession, [], None, train
    for step, group in groupby(plan, key=lambda r: r["step"]):
        some = list(group)
        if step == "encode":
            new, codes = _fit_encode(cur, some)
        elif step == "split":
            new = [_row(s, "key", text=key, value=TEST_SHARE) for s in some]
        else:
            new = fit[step](cur, some) if step in fit else [_row(s, None) for s in some]
        rows += new
        # later steps see encoded columns as they were: none of them reads one
        if step in ("impute", "treat_outliers"):
            cur = _apply(cur, new, None)
    fitted = spark.createDataFrame([tuple(r[c.split()[0]] for c in FITTED.split(", ")) for r in rows], FITTED)
    return fitted if codes is None else fitted.unionByName(codes)


def _apply(df: DataFrame, rows: list[Row], codes: DataFrame | None) -> DataFrame:
    out = df
    by_column = sorted(rows, key=lambda r: (r["step_order"], r["position"] is None, r["position"] or 0))
    for (order, step, column), group in groupby(by_column, key=lambda r: (r["step_order"], r["step"], r["column_name"])):
        some = list(group)
        stat = {r["stat"]: r for r in some}
        if step == "impute":
            fill = stat["fill"]
            v = FE.q(column) if fill["value"] is None else FE._dbl(out, column)
            lit = F.lit(fill["text"]).cast(out.schema[column].dataType) if fill["value"] is None else F.lit(fill["value"])
            if not is_numeric(out.schema[column].dataType) or fill["value"] is not None:
                out = out.withColumn(column, F.coalesce(v, lit))
        elif step == "treat_outliers":
            low, high = (F.lit(stat[k]["value"]).cast("double") for k in ("low", "high"))
            v = FE._dbl(out, column)
            out = out.withColumn(column, F.when(v.isNotNull(), F.least(F.greatest(v, low), high)))
        elif step == "scale":
            mean, std = stat["mean"]["value"], stat["std"]["value"]
            v = FE._dbl(out, column)
            flat = F.when(v.isNotNull(), F.lit(0.0))
            out = out.withColumn(column, flat if not std else (v - F.lit(mean)) / F.lit(std))
        elif step == "date_features":
            out = FE.date_features(out, column).drop(column)
        elif step == "encode" and some[0]["method"] == "one_hot":
            levels = [r["text"] for r in some if r["stat"] == "level"]
            out = out.select("*", *[F.coalesce((FE.q(column).cast("string") == F.lit(t)).cast("int"), F.lit(0)).alias(f"{column}_{t}") for t in levels]).drop(column)
        elif step == "encode":
            own = codes.where((F.col("step_order") == order) & (F.col("column_name") == column))
            own = own.select(F.col("text").alias("__lvl"), F.col("value").cast("long").alias(f"{column}_code"))
            out = out.join(own, FE.q(column).cast("string") == F.col("__lvl"), "left").drop("__lvl", column)
        elif step == "split":
            out = FE.train_test_split(out, stat["key"]["text"], stat["key"]["value"])
    return out


def apply_plan(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Apply a fitted table to any table with the plan's columns: projections of literals, and one
    join per ordinal column. Levels that the training rows lack are all zeros (one-hot) or NULL
    (ordinal); statistics are never taken from ``df``."""
    coded = F.coalesce(F.col("stat") == "code", F.lit(False))
    return _apply(df, [r.asDict() for r in fitted.where(~coded).collect()], fitted.where(coded))
