"""Queries of time-series features over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.clinical import rounded
from wardline.frames import Catalog
from wardline.operators import temporal as T
from wardline.plans.cohort import GAPS_SQL, LABS_SQL, labs

CATALOG = Catalog()
add = CATALOG.add
_DAY = "CAST(86400000000 AS DOUBLE)"
_REF = "r AS (SELECT *, max(ts) OVER (PARTITION BY patient_id) AS ref FROM labs)"


def _all_round(df, keep, at=6):
    return rounded(df, *(c for c, k in df.dtypes if k == "double" and c not in keep), at=at)


def _windows_sql(windows=(1, 3, 7, 14, 30)):
    parts = []
    for w in windows:
        f = f"FILTER (WHERE ts >= ref - INTERVAL {w} DAY)"
        n = f"value_{w}d"
        for a, e in {"mean": f"avg(value) {f}", "min": f"min(value) {f}", "max": f"max(value) {f}", "median": f"median(value) {f}", "std": f"stddev_samp(value) {f}", "var": f"var_samp(value) {f}", "sum": f"sum(value) {f}", "range": f"max(value) {f} - min(value) {f}", "iqr": f"quantile_cont(value, 0.75) {f} - quantile_cont(value, 0.25) {f}"}.items():
            parts.append(f"round({e}, 8) AS {n}_{a}")
        parts.append(f"CASE WHEN count(*) {f} > 0 THEN count(value) {f} END AS {n}_count")
        parts.append(f"round(CASE WHEN count(*) {f} > 0 THEN CASE WHEN count(value) {f} < 2 THEN 0 ELSE regr_slope(value, k) {f} END END, 8) AS {n}_slope")
    return f"WITH {LABS_SQL}, {_REF}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY ts) AS DOUBLE) AS k FROM r) SELECT patient_id, ref, {', '.join(parts)} FROM k GROUP BY patient_id, ref"


@add(_windows_sql())
def temporal_window_features(spark, sf):
    return _all_round(T.window_features(labs(spark, sf), ["patient_id"], "ts", "value"), [], 8)


@add(f"""WITH {LABS_SQL}, {_REF}, w AS (SELECT *, date_diff('microsecond', ref, ts) / {_DAY} AS age FROM r WHERE ts >= ref - INTERVAL 7 DAY)
    SELECT patient_id, ref, round(avg(value), 8) AS value_7d_mean, round(CASE WHEN count(*) >= 2 THEN date_diff('microsecond', min(ts), ref) / {_DAY} END, 8) AS value_7d_time_since_first,
    round(CASE WHEN count(*) >= 2 THEN date_diff('microsecond', max(ts), ref) / {_DAY} END, 8) AS value_7d_time_since_last,
    round(CASE WHEN count(*) >= 3 THEN regr_slope(value, age) END, 8) AS value_7d_slope, round(CASE WHEN count(*) >= 3 THEN regr_r2(value, age) END, 8) AS value_7d_r_squared FROM w GROUP BY patient_id, ref""")
def temporal_trend_features(spark, sf):
    return _all_round(T.window_features(labs(spark, sf), ["patient_id"], "ts", "value", (7,), ("mean",), trend=True), [], 8)


@add()
def temporal_trend_p_values(spark, sf):
    return T.window_features(labs(spark, sf), ["patient_id"], "ts", "value", (7, 30), ("mean",), trend=True, p_values=True)


@add(f"""WITH {LABS_SQL}, r AS (SELECT *, max(ts) OVER (PARTITION BY patient_id, variable) AS ref FROM labs) SELECT patient_id, """ + ", ".join(f"round(avg(value) FILTER (WHERE variable = '{v}' AND ts >= ref - INTERVAL {w} DAY), 8) AS {v}_{w}d_mean, CASE WHEN count(*) FILTER (WHERE variable = '{v}' AND ts >= ref - INTERVAL {w} DAY) > 0 THEN count(value) FILTER (WHERE variable = '{v}' AND ts >= ref - INTERVAL {w} DAY) END AS {v}_{w}d_count" for v in ("click", "view") for w in (7, 30)) + " FROM r GROUP BY patient_id")
def multivariate_temporal(spark, sf):
    return _all_round(T.multivariate(labs(spark, sf), ["patient_id"], "ts", "variable", "value", ["click", "view"], (7, 30), ("mean", "count")), [], 8)


def _gap_sql(windows=(1, 7, 30)):
    parts = []
    for w in windows:
        f = f"FILTER (WHERE ts >= ref - INTERVAL {w} DAY AND before >= ref - INTERVAL {w} DAY)"
        parts.append(f"count(*) FILTER (WHERE ts >= ref - INTERVAL {w} DAY) AS event_count_{w}d")
        parts += [f"round({g}(gap) {f}, 8) AS {n}_days_between_events_{w}d" for n, g in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))]
    return f"WITH {LABS_SQL}, {_REF}, g AS (SELECT *, lag(ts) OVER (PARTITION BY patient_id ORDER BY ts) AS before, date_diff('microsecond', lag(ts) OVER (PARTITION BY patient_id ORDER BY ts), ts) / {_DAY} AS gap FROM r) SELECT patient_id, ref, round(date_diff('microsecond', max(ts), ref) / {_DAY}, 8) AS days_since_last_event, {', '.join(parts)} FROM g GROUP BY patient_id, ref"


@add(_gap_sql())
def event_gap_features(spark, sf):
    return _all_round(T.event_features(labs(spark, sf), ["patient_id"], "ts", (1, 7, 30)), [], 8)


@add(f"""WITH {LABS_SQL}, refs AS (SELECT patient_id, max(ts) AS ref FROM labs WHERE variable = 'purchase' GROUP BY patient_id)
    SELECT l.patient_id, ref, round(avg(value), 8) AS value_7d_mean, count(value) AS value_7d_count FROM labs l JOIN refs r ON l.patient_id = r.patient_id AND ts BETWEEN ref - INTERVAL 7 DAY AND ref GROUP BY ALL""")
def windows_at_reference_times(spark, sf):
    rows = labs(spark, sf)
    refs = rows.where("variable = 'purchase'").groupBy("patient_id").agg(F.max("ts").alias("reference_time"))
    near = T.at_references(rows, refs, ["patient_id"], "ts", 7)
    return _all_round(T.window_features(near, ["patient_id"], "ts", "value", (7,), ("mean", "count")), [], 8)


@add(f"""WITH {GAPS_SQL} SELECT event_id, patient_id, ts, variable, last_value(value IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM labs""")
def forward_fill_labs(spark, sf):
    return T.forward_fill(labs(spark, sf, gaps=True), ["patient_id"], ["ts", "event_id"], "value")


@add(f"""WITH {GAPS_SQL}, n AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t0,
      first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t1 FROM labs
      WINDOW b AS (PARTITION BY patient_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY patient_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, patient_id, ts, variable, round(CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (date_diff('microsecond', t0, ts) / CAST(date_diff('microsecond', t0, t1) AS DOUBLE)) END, 8) AS value FROM n""")
def interpolate_labs(spark, sf):
    return rounded(T.interpolate(labs(spark, sf, gaps=True), ["patient_id"], "ts", ["ts", "event_id"], "value"), "value", at=8)


@add(f"""WITH {LABS_SQL} SELECT event_id, patient_id, ts, variable, value, round(avg(value) OVER w, 8) AS value_rolling_7d_mean, count(value) OVER w AS value_rolling_7d_count FROM labs
    WINDOW w AS (PARTITION BY patient_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""")
def rolling_week(spark, sf):
    return rounded(T.rolling(labs(spark, sf), ["patient_id"], "ts", "value", 7), "value_rolling_7d_mean", at=8)


_DAILY = f"""{LABS_SQL}, d AS (SELECT patient_id, CAST(ts AS DATE) AS day, avg(value) AS value FROM labs GROUP BY ALL),
    s AS (SELECT patient_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY patient_id),
    j AS (SELECT s.patient_id, s.day, d.value FROM s LEFT JOIN d USING (patient_id, day)),
    n AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER b AS t0, first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER a AS t1 FROM j
      WINDOW b AS (PARTITION BY patient_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY patient_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT patient_id, day, CASE WHEN value IS NOT NULL THEN value ELSE v0 + (v1 - v0) * (CAST(day - t0 AS DOUBLE) / (t1 - t0)) END AS value FROM n)"""


@add(f"WITH {_DAILY} SELECT patient_id, day, round(value, 8) AS value FROM f")
def daily_resample(spark, sf):
    return rounded(T.daily(labs(spark, sf), ["patient_id"], "ts", "value"), "value", at=8)


@add(f"WITH {_DAILY}, l AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3, lag(value, 7) OVER w AS l7 FROM f WINDOW w AS (PARTITION BY patient_id ORDER BY day)) SELECT patient_id, round(corr(value, l1), 8) AS autocorr_lag_1, round(corr(value, l2), 8) AS autocorr_lag_2, round(corr(value, l3), 8) AS autocorr_lag_3, round(corr(value, l7), 8) AS autocorr_lag_7 FROM l GROUP BY patient_id")
def autocorrelation(spark, sf):
    return _all_round(T.autocorrelation(T.daily(labs(spark, sf), ["patient_id"], "ts", "value"), ["patient_id"], "day", "value"), [], 8)


@add()
def spectral_features(spark, sf):
    return T.spectra(labs(spark, sf), ["patient_id"], "ts", "value")
