"""Time-series operators (W1-W6) and per-series models.

Signature: op(df, ts, y, by=[]) -> DataFrame, series identified by ``by``. Lags never use a
window holding a whole series: :func:`previous_values` splits series over range partitions
and carries partition tails, so a series holding a third of all rows is still spread over
many tasks. Series statistics are plain aggregates grouped by ``by`` (partial aggregation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.functions.exprs import attach_one_row, guarded_corr
from prepline.functions.ordering import affine_scan, next_values, previous_values, running_before

# ---- fixed values ----
DF_CRITICAL_5PCT = -2.86  # Dickey-Fuller, constant, large sample
# ---- end of fixed values ----


def _epoch(c, dt=None):
    """Epoch seconds; wall-clock timestamps are read in UTC whatever the session zone."""
    from pyspark.sql import types as T

    from prepline.functions.exprs import epoch_micros

    return epoch_micros(c, dt or T.TimestampNTZType()).cast("double") / 1e6


def _with_lags(df: DataFrame, ts: str, y: str, by: Sequence[str], k: int) -> DataFrame:
    return previous_values(df, by, ts, y, k, out="__prev")


def _lag(j: int):
    """lag j from the ``__prev`` array (last element = lag 1)."""
    return F.when(F.size("__prev") >= j, F.element_at("__prev", -j))


# ------------------------------------------------------------------ W1

def infer_frequency(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Modal gap in seconds between consecutive timestamps (ties to the smallest), the
    share of gaps at the mode, regular when that share is 1."""
    t = df.select(*by, _epoch(F.col(ts), df.schema[ts].dataType).alias("__t"))
    lagged = previous_values(t, by, "__t", "__t", 1, out="__prev")
    gaps = lagged.where(F.size("__prev") == 1).select(*by, (F.col("__t") - F.element_at("__prev", -1)).alias("gap"))
    counts = gaps.groupBy(*by, "gap").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(*by).agg(
        F.min_by("gap", F.struct(-F.col("n"), F.col("gap"))).alias("frequency_seconds"),
        F.max("n").alias("n_mode"),
        F.sum("n").alias("n_gaps"),
    )
    return per.select(
        *by,
        "frequency_seconds",
        F.col("n_gaps").cast("long").alias("n_gaps"),
        F.round(F.col("n_mode") / F.col("n_gaps"), 6).alias("share_at_mode"),
        (F.col("n_mode") == F.col("n_gaps")).alias("is_regular"),
    )


# ------------------------------------------------------------------ W2

def resample(df: DataFrame, ts: str, y: str, unit: str = "day", agg: str = "sum", by: Sequence[str] = (), fill_gaps: bool = True) -> DataFrame:
    """Aggregate into calendar buckets (``date_trunc`` unit); with ``fill_gaps`` every
    bucket between a series' first and last is present (y NULL where no data)."""
    fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "last": F.max_by}[agg]
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("ts")
    val = fn(F.col(y), F.col(ts)) if agg == "last" else fn(F.col(y))
    grid = df.groupBy(*by, bucket).agg(val.alias("y"))
    if not fill_gaps:
        return grid
    bounds = grid.groupBy(*by).agg(F.min("ts").alias("__lo"), F.max("ts").alias("__hi"))
    # calendar in two levels so no row holds more than CHUNK buckets: chunk starts, then
    # the buckets of each chunk (a series of a billion buckets is 250k rows of <= 4096)
    chunk = 4096
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    big = F.expr(f"INTERVAL {chunk} {unit.upper()}") if unit in ("second", "minute", "hour", "day", "week") else None
    if big is None:  # month / quarter / year: few buckets per series
        cal = bounds.select(*by, F.explode(F.sequence("__lo", "__hi", step)).alias("ts"))
    else:
        starts = bounds.select(*by, "__hi", F.explode(F.sequence("__lo", "__hi", big)).alias("__s"))
        ends = F.least(F.col("__hi"), F.col("__s") + F.expr(f"INTERVAL {chunk - 1} {unit.upper()}"))
        cal = starts.select(*by, F.explode(F.sequence("__s", ends, step)).alias("ts"))
    return cal.join(grid, [*by, "ts"], "left")


# ------------------------------------------------------------------ W3

def trend(df: DataFrame, ts: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope of y on time (per day), intercept at epoch 0, and r^2."""
    t = _epoch(F.col(ts), df.schema[ts].dataType) / 86400.0
    yy = F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.regr_slope(yy, t).alias("slope_per_day"),
        F.regr_intercept(yy, t).alias("intercept"),
        F.regr_r2(yy, t).alias("r2"),
        F.regr_count(yy, t).alias("n"),
    )


# ------------------------------------------------------------------ W4

def autocorrelation(df: DataFrame, ts: str, y: str, lags: Sequence[int] = (1, 7), by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of y_t with y_(t-L) per lag (pairs where both exist); NULL for a
    constant series. Long form (by..., lag, acf)."""
    k = max(lags)
    lagged = _with_lags(df.select(*by, ts, F.col(y).cast("double").alias("__y")), ts, "__y", by, k)
    aggs = []
    for L in lags:
        x = _lag(L)
        both = x.isNotNull() & F.col("__y").isNotNull()
        aggs.append(guarded_corr(F.when(both, F.col("__y")), F.when(both, x)).alias(f"acf{L}"))
    wide = lagged.groupBy(*by).agg(*aggs)
    stack = ", ".join(f"{L}, acf{L}" for L in lags)
    return wide.selectExpr(*[f"`{b}`" for b in by], f"stack({len(lags)}, {stack}) AS (lag, acf)")


# ------------------------------------------------------------------ W5

def stationarity(df: DataFrame, ts: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Dickey-Fuller regression dy_t = a + g y_(t-1); t = g / se(g); stationary when
    t < -2.86. Sums only: one aggregation per series after the lag."""
    lagged = _with_lags(df.select(*by, ts, F.col(y).cast("double").alias("__y")), ts, "__y", by, 1)
    x = _lag(1)
    d = F.col("__y") - x
    pairs = lagged.where(x.isNotNull()).select(*by, x.alias("x"), d.alias("d"))
    s = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("d", "x").alias("gamma"),
        F.regr_sxx("d", "x").alias("sxx"),
        F.regr_syy("d", "x").alias("syy"),
        F.regr_sxy("d", "x").alias("sxy"),
    )
    sse = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    se = F.sqrt(F.try_divide(sse, (F.col("n") - 2) * F.col("sxx")))
    tstat = F.try_divide(F.col("gamma"), se)
    return s.select(*by, F.col("n").cast("long").alias("n"), "gamma", tstat.alias("t_stat"), (tstat < DF_CRITICAL_5PCT).alias("is_stationary"))


# ------------------------------------------------------------------ W6

def lag_features(df: DataFrame, ts: str, y: str, lags: Sequence[int] = (1, 2, 3), windows: Sequence[int] = (3,), by: Sequence[str] = ()) -> DataFrame:
    """lag_L columns and rolling mean / sample std over the last w rows (current included)."""
    k = max(list(lags) + [w - 1 for w in windows] + [1])
    lagged = _with_lags(df, ts, y, by, k)
    cur = F.col(y).cast("double")
    out = lagged
    for L in lags:
        out = out.withColumn(f"{y}_lag{L}", _lag(L))
    for w in windows:
        prev_part = F.when(F.size("__prev") > w - 1, F.slice(F.col("__prev"), -(w - 1), w - 1)).otherwise(F.col("__prev")) if w > 1 else F.array()
        win = F.concat(F.transform(prev_part, lambda v: v.cast("double")), F.array(cur))
        win = F.filter(F.transform(win, lambda v: v.cast("double")), lambda v: v.isNotNull())
        n = F.size(win)
        mean = F.aggregate(win, F.lit(0.0), lambda a, v: a + v) / n
        ss = F.aggregate(win, F.lit(0.0), lambda a, v: a + v * v)
        out = out.withColumn(f"{y}_roll{w}_mean", F.when(n > 0, mean))
        out = out.withColumn(f"{y}_roll{w}_std", F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (ss - n * mean * mean) / (n - 1)))))
    return out.drop("__prev")


# ------------------------------------------------------------------ T18 exponential smoothing

def exponential_smoothing(df: DataFrame, ts: str, y: str, by: Sequence[str] = (), alpha: float = 0.5, beta: float | None = None) -> DataFrame:
    """Simple (beta None) or Holt's linear smoothing, per series, exactly.

    SES: l_1 = y_1, l_t = a y_t + (1 - a) l_(t-1). Holt: b_1 = y_2 - y_1,
    l_t = a y_t + (1 - a)(l_(t-1) + b_(t-1)), b_t = beta (l_t - l_(t-1)) + (1 - beta) b_(t-1).
    Returns (by..., ts, y, level[, trend], fitted) where fitted is the one-step-ahead
    forecast made before y_t. Runs as an affine scan (no series in one task). A missing y keeps its
    row: the state goes on as forecast (level + trend; the trend stays); before a series' first
    known value there is no state (NULL), and y_1, y_2 are its first two known values. A NULL
    ``by`` is a series of its own.
    """
    a = float(alpha)
    if beta is None:
        out = affine_scan(df, by, ts, y, [1 - a], [a], [1.0], lambda y1, y2: [y1], ["level"])
        # fitted = level before the row (the first row's prior is y_1 itself)
        return out.select(*by, ts, y, "level", F.col("prior_level").alias("fitted"))
    b = float(beta)

    def init(y1, y2):
        y2 = y1 if y2 is None else y2
        return [2 * y1 - y2, y2 - y1]

    # with p = level + trend: level' = a y + (1 - a) p, trend' = b (level' - level) + (1 - b) trend
    step = [[1 - a, 1 - a], [-a * b, b * (1 - a) + 1 - b]]
    out = affine_scan(df, by, ts, y, step, [a, a * b], [[1.0, 1.0], [0.0, 1.0]], init, ["level", "trend"])
    fitted = F.when(~F.col("is_first"), F.col("prior_level") + F.col("prior_trend"))
    return out.select(*by, ts, y, "level", "trend", fitted.alias("fitted"))


def smoothing_forecast(fitted: DataFrame, ts: str, by: Sequence[str] = (), horizon: int = 3) -> DataFrame:
    """T18 forecast: from the last state of each series, level (+ h x trend) for h = 1..horizon."""
    has_trend = "trend" in fitted.columns
    last = fitted.groupBy(*by).agg(
        F.max_by("level", F.col(ts)).alias("l"), *( [F.max_by("trend", F.col(ts)).alias("b")] if has_trend else [])
    )
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    fc = F.col("l") + (F.col("step") * F.col("b") if has_trend else F.lit(0.0))
    return steps.select(*by, "step", fc.alias("forecast"))


# ------------------------------------------------------------------ T19 seasonal decomposition

def seasonal_decompose(df: DataFrame, ts: str, y: str, period: int, by: Sequence[str] = ()) -> DataFrame:
    """T19 (additive): trend = centred moving average (2 x p for even p), seasonal = phase mean
    of y - trend centred to sum 0, resid = y - trend - seasonal. Edges have NULL trend. Needs a
    regular grid (run W2 first). Phase = position in the series mod p (distributed count)."""
    half = period // 2
    base = df.select(*by, ts, F.col(y).cast("double").alias("__y"))
    with_prev = previous_values(base, by, ts, "__y", half, out="__prev")
    both = next_values(with_prev, by, ts, "__y", half, out="__next")
    prev_ok = F.size("__prev") == half
    next_ok = F.size("__next") == half
    if period % 2 == 1:
        total = F.aggregate(F.concat("__prev", F.array("__y"), "__next"), F.lit(0.0), lambda acc, v: acc + v)
        ma = total / period
    else:
        inner = F.concat(F.slice("__prev", 2, half - 1) if half > 1 else F.array().cast("array<double>"), F.array("__y"),
                         F.slice("__next", 1, half - 1) if half > 1 else F.array().cast("array<double>"))
        s_inner = F.aggregate(inner, F.lit(0.0), lambda acc, v: acc + v)
        ends = F.element_at("__prev", 1) + F.element_at("__next", -1)
        ma = (s_inner + 0.5 * ends) / period
    trended = both.withColumn("trend", F.when(prev_ok & next_ok, ma)).drop("__prev", "__next")
    pos = running_before(trended.withColumn("__one", F.lit(1)), by, ts, "__one", out="__pos")
    phased = pos.withColumn("phase", (F.col("__pos") % period).cast("int")).drop("__one", "__pos")
    detr = phased.withColumn("__d", F.col("__y") - F.col("trend"))
    means = detr.groupBy(*by, "phase").agg(F.avg("__d").alias("__m"))
    centre = means.groupBy(*by).agg(F.avg("__m").alias("__c"))
    seas = means.join(centre, list(by)) if by else attach_one_row(means, centre)
    seas = seas.select(*by, "phase", (F.col("__m") - F.col("__c")).alias("seasonal"))
    out = detr.join(seas, [*by, "phase"], "left")
    return out.select(*by, ts, F.col("__y").alias(y), "trend", "seasonal", (F.col("__y") - F.col("trend") - F.col("seasonal")).alias("resid"), "phase")


# ------------------------------------------------------------------ T20 AR on differences

def ar_fit(df: DataFrame, ts: str, y: str, p: int = 1, d: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """AR(p) with intercept on the d-th difference (no MA term), least squares per series.
    AR(1) is closed form (regr_slope / regr_intercept); higher p solves the (p+1) normal
    equations per series from aggregated cross products (one row per series)."""
    import numpy as np
    import pandas as pd

    cur = df.select(*by, ts, F.col(y).cast("double").alias("__z"))
    for _ in range(d):
        lagged = _with_lags(cur, ts, "__z", by, 1)
        cur = lagged.select(*by, ts, (F.col("__z") - _lag(1)).alias("__z")).where(F.col("__z").isNotNull())
    lagged = _with_lags(cur, ts, "__z", by, p).where(F.size("__prev") == p)
    xs = [_lag(j).alias(f"x{j}") for j in range(1, p + 1)]
    rows = lagged.select(*by, F.col("__z").alias("z"), *xs)
    if p == 1:
        return rows.groupBy(*by).agg(
            F.regr_intercept("z", "x1").alias("intercept"), F.regr_slope("z", "x1").alias("phi1"), F.count(F.lit(1)).alias("n")
        )
    names = ["one"] + [f"x{j}" for j in range(1, p + 1)]
    cols = {"one": F.lit(1.0), **{f"x{j}": F.col(f"x{j}") for j in range(1, p + 1)}}
    aggs = [F.sum(cols[a] * cols[b]).alias(f"xx_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    aggs += [F.sum(cols[a] * F.col("z")).alias(f"xz_{a}") for a in names] + [F.count(F.lit(1)).alias("n")]
    sums = rows.groupBy(*by).agg(*aggs)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            m = np.zeros((p + 1, p + 1))
            for i, a in enumerate(names):
                for j in range(i, p + 1):
                    m[i, j] = m[j, i] = r[f"xx_{a}_{names[j]}"]
            v = np.array([r[f"xz_{a}"] for a in names])
            coef = np.linalg.lstsq(m, v, rcond=None)[0]
            out.append([r[b] for b in by] + list(coef) + [r["n"]])
        return pd.DataFrame(out, columns=[*by, "intercept", *[f"phi{j}" for j in range(1, p + 1)], "n"])

    schema = sums.select(*by).schema
    from pyspark.sql import types as T

    for n in ["intercept", *[f"phi{j}" for j in range(1, p + 1)]]:
        schema = schema.add(n, T.DoubleType())
    schema = schema.add("n", T.LongType())
    return sums.mapInPandas(lambda it: (solve(x) for x in it), schema)
