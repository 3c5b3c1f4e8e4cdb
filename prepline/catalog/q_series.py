"""Registered time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepline.catalog import register
from prepline.catalog.q_profile import rounded
from prepline.operators import series as W
from prepline.sources.tables import DAILY_REVENUE_SQL, daily_revenue, load

D = DAILY_REVENUE_SQL


@register(
    "w1_infer_frequency_users",
    """WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
c AS (SELECT user_id, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)
SELECT user_id, arg_min(gap, (-n, gap)) AS frequency_seconds, CAST(sum(n) AS BIGINT) AS n_gaps, round(max(n) / sum(n), 6) AS share_at_mode, max(n) = sum(n) AS is_regular
FROM c GROUP BY user_id""",
)
def w1(spark, sf):
    return W.infer_frequency(load(spark, sf, "events"), "ts", ["user_id"])


@register(
    "w1_infer_frequency_daily_revenue",
    f"""WITH g AS (SELECT epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY ts) AS gap FROM {D}),
c AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT arg_min(gap, (-n, gap)) AS frequency_seconds, CAST(sum(n) AS BIGINT) AS n_gaps, round(max(n) / sum(n), 6) AS share_at_mode, max(n) = sum(n) AS is_regular FROM c""",
)
def w1d(spark, sf):
    return W.infer_frequency(daily_revenue(spark, sf), "ts")


@register(
    "w2_resample_daily_gapfill",
    """WITH g AS (SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, sum(value) AS y FROM events GROUP BY 1, 2),
b AS (SELECT event_type, min(ts) lo, max(ts) hi FROM g GROUP BY 1),
cal AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM b)
SELECT cal.event_type, cal.ts, round(g.y, 6) AS y FROM cal LEFT JOIN g USING (event_type, ts)""",
)
def w2(spark, sf):
    return rounded(W.resample(load(spark, sf, "events"), "ts", "value", "day", "sum", ["event_type"]))


@register(
    "w2_resample_weekly_revenue",
    """SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts, round(sum(o_totalprice), 4) AS y FROM orders GROUP BY 1""",
)
def w2w(spark, sf):
    out = W.resample(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", "week", "sum", fill_gaps=False)
    return rounded(out, 4)


@register(
    "w3_trend_daily_revenue",
    f"""SELECT round(regr_slope(y, epoch_us(ts) / 1e6 / 86400.0), 6) AS slope_per_day, round(regr_intercept(y, epoch_us(ts) / 1e6 / 86400.0), 4) AS intercept,
  round(regr_r2(y, epoch_us(ts) / 1e6 / 86400.0), 6) AS r2, CAST(regr_count(y, epoch_us(ts) / 1e6 / 86400.0) AS BIGINT) AS n FROM {D}""",
)
def w3(spark, sf):
    out = W.trend(daily_revenue(spark, sf), "ts", "y")
    return out.select(F.round("slope_per_day", 6).alias("slope_per_day"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


def _acf_sql(lag: int) -> str:
    return f"""SELECT {lag} AS lag, round(covar_samp(y, x) / nullif(stddev_samp(y) * stddev_samp(x), 0), 6) AS acf
FROM (SELECT y, lag(y, {lag}) OVER (ORDER BY ts) AS x FROM {D}) WHERE x IS NOT NULL AND y IS NOT NULL"""


@register("w4_autocorrelation_daily_revenue", _acf_sql(1) + " UNION ALL " + _acf_sql(7))
def w4(spark, sf):
    return rounded(W.autocorrelation(daily_revenue(spark, sf), "ts", "y", [1, 7]))


@register(
    "w5_stationarity_daily_revenue",
    f"""WITH p AS (SELECT lag(y) OVER (ORDER BY ts) AS x, y - lag(y) OVER (ORDER BY ts) AS d FROM {D}),
s AS (SELECT count(*) n, regr_slope(d, x) g, regr_sxx(d, x) sxx, regr_syy(d, x) syy, regr_sxy(d, x) sxy FROM p WHERE x IS NOT NULL)
SELECT CAST(n AS BIGINT) AS n, round(g, 6) AS gamma, round(g / sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)), 6) AS t_stat,
  g / sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)) < -2.86 AS is_stationary FROM s""",
)
def w5(spark, sf):
    return rounded(W.stationarity(daily_revenue(spark, sf), "ts", "y"))


@register(
    "w6_lag_rolling_features",
    """SELECT event_id, user_id, ts, value,
  lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2,
  round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value_roll3_mean,
  round(CASE WHEN count(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 1 THEN stddev_samp(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS value_roll3_std
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def w6(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return rounded(W.lag_features(ev, "ts", "value", [1, 2], [3], ["user_id"]))


_SES = f"""WITH RECURSIVE d AS (SELECT ts, y, row_number() OVER (ORDER BY ts) AS rn FROM {D}),
s AS (SELECT rn, ts, y, y AS level, y AS fitted FROM d WHERE rn = 1
      UNION ALL SELECT d.rn, d.ts, d.y, 0.5 * d.y + 0.5 * s.level, s.level FROM d JOIN s ON d.rn = s.rn + 1)"""


@register("t18_ses_daily_revenue", _SES + " SELECT ts, round(y, 4) AS y, round(level, 4) AS level, round(fitted, 4) AS fitted FROM s")
def t18(spark, sf):
    return rounded(W.exponential_smoothing(daily_revenue(spark, sf), "ts", "y", alpha=0.5), 4)


@register(
    "t18_holt_daily_revenue",
    f"""WITH RECURSIVE d AS (SELECT ts, y, row_number() OVER (ORDER BY ts) AS rn FROM {D}),
s AS (SELECT rn, ts, y, y AS level, (SELECT y FROM d WHERE rn = 2) - y AS trend, CAST(NULL AS DOUBLE) AS fitted FROM d WHERE rn = 1
      UNION ALL SELECT d.rn, d.ts, d.y, 0.5 * d.y + 0.5 * (s.level + s.trend),
        0.3 * ((0.5 * d.y + 0.5 * (s.level + s.trend)) - s.level) + 0.7 * s.trend, s.level + s.trend FROM d JOIN s ON d.rn = s.rn + 1)
SELECT ts, round(y, 4) AS y, round(level, 4) AS level, round(trend, 4) AS trend, round(fitted, 4) AS fitted FROM s""",
)
def t18h(spark, sf):
    return rounded(W.exponential_smoothing(daily_revenue(spark, sf), "ts", "y", alpha=0.5, beta=0.3), 4)


@register(
    "t18_ses_per_user_forecast",
    """WITH RECURSIVE d AS (SELECT user_id, ts, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
s AS (SELECT user_id, rn, y AS level FROM d WHERE rn = 1
      UNION ALL SELECT d.user_id, d.rn, 0.5 * d.y + 0.5 * s.level FROM d JOIN s ON d.user_id = s.user_id AND d.rn = s.rn + 1),
last AS (SELECT user_id, arg_max(level, rn) AS l FROM s GROUP BY 1)
SELECT user_id, step, round(l, 6) AS forecast FROM last, (SELECT unnest([1, 2, 3]) AS step)""",
)
def t18f(spark, sf):
    ev = load(spark, sf, "events").select("user_id", "ts", "value")
    fitted = W.exponential_smoothing(ev, "ts", "value", ["user_id"], alpha=0.5)
    return rounded(W.smoothing_forecast(fitted, "ts", ["user_id"], 3))


@register(
    "t19_seasonal_decompose_weekly",
    f"""WITH b AS (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS pos,
  CASE WHEN count(*) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN avg(y) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend FROM {D}),
p AS (SELECT *, CAST(pos % 7 AS INTEGER) AS phase FROM b),
m AS (SELECT phase, avg(y - trend) AS m FROM p GROUP BY phase),
c AS (SELECT avg(m) AS c FROM m)
SELECT ts, round(y, 4) AS y, round(trend, 4) AS trend, round(m - c, 4) AS seasonal, round(y - trend - (m - c), 4) AS resid, phase FROM p JOIN m USING (phase), c""",
)
def t19(spark, sf):
    return rounded(W.seasonal_decompose(daily_revenue(spark, sf), "ts", "y", 7), 4)


@register(
    "t19_seasonal_decompose_even_period",
    f"""WITH b AS (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS pos,
  lag(y, 2) OVER (ORDER BY ts) AS p2, lag(y, 1) OVER (ORDER BY ts) AS p1, lead(y, 1) OVER (ORDER BY ts) AS n1, lead(y, 2) OVER (ORDER BY ts) AS n2 FROM {D}),
t AS (SELECT *, (p1 + y + n1 + 0.5 * (p2 + n2)) / 4 AS trend FROM b),
p AS (SELECT *, CAST(pos % 4 AS INTEGER) AS phase FROM t),
m AS (SELECT phase, avg(y - trend) AS m FROM p GROUP BY phase),
c AS (SELECT avg(m) AS c FROM m)
SELECT ts, round(y, 6) AS y, round(trend, 6) AS trend, round(m - c, 6) AS seasonal, round(y - trend - (m - c), 6) AS resid, phase FROM p JOIN m USING (phase), c""",
)
def t19e(spark, sf):
    return rounded(W.seasonal_decompose(daily_revenue(spark, sf), "ts", "y", 4), 6)


@register(
    "t20_ar1_on_differences",
    f"""WITH d AS (SELECT ts, y - lag(y) OVER (ORDER BY ts) AS z FROM {D}),
p AS (SELECT z, lag(z) OVER (ORDER BY ts) AS x1 FROM d WHERE z IS NOT NULL)
SELECT round(regr_intercept(z, x1), 4) AS intercept, round(regr_slope(z, x1), 6) AS phi1, CAST(count(*) AS BIGINT) AS n FROM p WHERE x1 IS NOT NULL""",
)
def t20(spark, sf):
    out = W.ar_fit(daily_revenue(spark, sf), "ts", "y", p=1, d=1)
    return out.select(F.round("intercept", 4).alias("intercept"), F.round("phi1", 6).alias("phi1"), "n")


@register("t20_ar2_per_user", None)
def t20b(spark, sf):
    return rounded(W.ar_fit(load(spark, sf, "events"), "ts", "value", p=2, d=0, by=["user_id"]))
