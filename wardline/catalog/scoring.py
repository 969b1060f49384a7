"""Queries of classifier evaluation, fairness and calibration over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.clinical import rounded
from wardline.frames import Catalog
from wardline.operators import calibration as K
from wardline.operators import classifier as C
from wardline.operators import fairness as Q
from wardline.plans.cohort import PREDICTIONS_SQL, predictions

CATALOG = Catalog()
add = CATALOG.add
_P = f"WITH {PREDICTIONS_SQL}"
_SCORES = ", s AS (SELECT g, p AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM pred GROUP BY ALL)"


def _auc_sql(by):
    part = f"PARTITION BY {by}" if by else ""
    s = f", s AS (SELECT {by + ',' if by else ''} p AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM pred GROUP BY ALL), a AS (SELECT *, coalesce(sum(pos) OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM s)"
    return f"{_P}{s} SELECT {by + ',' if by else ''} round(CAST(sum(neg * (above + pos / CAST(2 AS DOUBLE))) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 8) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM a {'GROUP BY ' + by if by else ''}"


@add(_auc_sql("g"))
def auc_by_group(spark, sf):
    return rounded(C.auc(predictions(spark, sf), by=["g"]), "auc", at=8)


@add(_auc_sql(""))
def auc_overall(spark, sf):
    return rounded(C.auc(predictions(spark, sf)), "auc", at=8)


_CURVE = f"""{_P}{_SCORES.replace('SELECT g, p', 'SELECT p')}, c AS (SELECT score AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS n_pos, CAST(sum(neg) OVER () AS BIGINT) AS n_neg FROM s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    d AS (SELECT *, CAST(tp AS DOUBLE) / CAST(n_pos AS DOUBLE) AS tpr, CAST(fp AS DOUBLE) / CAST(n_neg AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision FROM c),
    e AS (SELECT *, CASE WHEN precision + tpr > 0 THEN 2 * precision * tpr / (precision + tpr) ELSE 0 END AS f1, coalesce(lag(tpr) OVER (ORDER BY threshold DESC), 0) AS before FROM d)"""


@add(f"{_CURVE} SELECT threshold, tp, fp, n_pos, n_neg, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr, round(precision, 8) AS precision, round(f1, 8) AS f1 FROM e")
def roc_points(spark, sf):
    return rounded(C.curve(predictions(spark, sf)), "tpr", "fpr", "precision", "f1", at=8)


@add(f"{_CURVE} SELECT round(sum(precision * (tpr - before)), 8) AS average_precision FROM e")
def average_precision(spark, sf):
    return rounded(C.average_precision(predictions(spark, sf)), "average_precision", at=8)


@add(f"{_CURVE} SELECT threshold, round(precision, 8) AS precision, round(tpr, 8) AS recall, round(f1, 8) AS f1 FROM e ORDER BY e.f1 DESC, threshold DESC LIMIT 1")
def best_f1(spark, sf):
    return rounded(C.best_f1(predictions(spark, sf)), "precision", "recall", "f1", at=8)


@add(f"{_P} SELECT CAST(greatest(ceil(p * 10) - 1, 0) AS INTEGER) AS bin, round(avg(p), 8) AS mean_score, round(avg(y), 8) AS mean_outcome, count(*) AS n FROM pred GROUP BY bin")
def calibration_bins(spark, sf):
    return rounded(C.calibration_bins(predictions(spark, sf)), "mean_score", "mean_outcome", at=8)


@add(f"{_P} SELECT CAST(floor(p * 10) AS INTEGER) AS bin, round(avg(p), 8) AS mean_score, round(avg(y), 8) AS mean_outcome, count(*) AS n FROM pred WHERE floor(p * 10) < 10 GROUP BY bin")
def calibration_plot_points(spark, sf):
    return rounded(C.calibration_bins(predictions(spark, sf), plot=True), "mean_score", "mean_outcome", at=8)


@add(f"{_P}, b AS (SELECT greatest(ceil(p * 10) - 1, 0) AS bin, avg(p) AS x, avg(y) AS z FROM pred GROUP BY bin) SELECT round(regr_slope(z, x), 8) AS slope, round(regr_intercept(z, x), 8) AS intercept FROM b")
def calibration_line(spark, sf):
    return rounded(C.calibration_line(predictions(spark, sf)), "slope", "intercept", at=8)


@add(f"{_P} SELECT g, round(avg((p - y) * (p - y)), 8) AS brier FROM pred GROUP BY g")
def brier_by_group(spark, sf):
    return rounded(C.brier(predictions(spark, sf), by=["g"]), "brier", at=8)


_T = "t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold)"
_COUNTS = "count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y <> 1) AS fp, count(*) FILTER (WHERE NOT p >= threshold AND y = 1) AS fn, count(*) FILTER (WHERE NOT p >= threshold AND y <> 1) AS tn"


@add(f"{_P}, {_T}, c AS (SELECT threshold, {_COUNTS} FROM pred, t GROUP BY threshold) SELECT threshold, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 8) AS sensitivity, round(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 8) AS specificity, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 8) AS ppv, round(tn / CAST(nullif(tn + fn, 0) AS DOUBLE), 8) AS npv FROM c")
def threshold_metrics(spark, sf):
    return rounded(C.threshold_metrics(predictions(spark, sf)), "sensitivity", "specificity", "ppv", "npv", at=8)


@add(f"{_P} SELECT round(avg((p - y) * (p - y)), 8) AS mse, round(sqrt(avg((p - y) * (p - y))), 8) AS rmse, round(avg(abs(p - y)), 8) AS mae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 8) AS r2 FROM pred")
def regression_metrics(spark, sf):
    return rounded(C.regression_metrics(predictions(spark, sf)), "mse", "rmse", "mae", "r2", at=8)


@add(f"""{_CURVE}, f AS (SELECT precision, tpr AS recall FROM e ORDER BY e.f1 DESC, threshold DESC LIMIT 1), u AS (SELECT auc FROM ({_auc_sql("")[len("WITH "):].replace("pred AS", "WITH pred AS", 1)}))
    SELECT auc, round(precision, 8) AS precision, round(recall, 8) AS recall, auc >= 0.7 AND precision >= 0.6 AND recall >= 0.5 AS passed FROM f, u""")
def model_performance_gate(spark, sf):
    return rounded(C.model_gate(predictions(spark, sf)), "auc", "precision", "recall", at=8)


def _rates_sql(threshold, at=8):
    return f"count(*) AS n, round(count(*) FILTER (WHERE p >= {threshold}) / CAST(count(*) AS DOUBLE), {at}) AS positive_rate, round(coalesce(count(*) FILTER (WHERE p >= {threshold} AND y = 1) / CAST(nullif(count(*) FILTER (WHERE y = 1), 0) AS DOUBLE), 0), {at}) AS tpr, round(coalesce(count(*) FILTER (WHERE p >= {threshold} AND y <> 1) / CAST(nullif(count(*) FILTER (WHERE y <> 1), 0) AS DOUBLE), 0), {at}) AS fpr, round(coalesce(count(*) FILTER (WHERE p >= {threshold} AND y = 1) / CAST(nullif(count(*) FILTER (WHERE p >= {threshold}), 0) AS DOUBLE), 0), {at}) AS ppv"


_DIFFS = "round(max(positive_rate) - min(positive_rate), 6) AS demographic_parity, round(max(tpr) - min(tpr), 6) AS equal_opportunity, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equalized_odds, round(max(ppv) - min(ppv), 6) AS predictive_parity"
_FOUR = ("demographic_parity", "equal_opportunity", "equalized_odds", "predictive_parity")


@add(f"{_P} SELECT g, {_rates_sql(0.5)}, round(avg((p - y) * (p - y)), 8) AS brier FROM pred GROUP BY g")
def fairness_group_rates(spark, sf):
    return rounded(Q.group_rates(predictions(spark, sf), "g"), "positive_rate", "tpr", "fpr", "ppv", "brier", at=8)


for _metric in _FOUR:

    def _one(spark, sf, metric=_metric):
        return rounded(Q.disparities(Q.group_rates(predictions(spark, sf), "g")), *_FOUR).select(metric)

    add(f"{_P}, r AS (SELECT g, {_rates_sql(0.5, 15)} FROM pred GROUP BY g), d AS (SELECT {_DIFFS} FROM r) SELECT {_metric} FROM d", _metric)(_one)


@add(f"""{_P}, r AS (SELECT g, {_rates_sql(0.5, 15)}, avg((p - y) * (p - y)) AS brier FROM pred GROUP BY g), d AS (SELECT {_DIFFS}, round(max(brier) - min(brier), 6) AS calibration_disparity FROM r),
    u AS (SELECT round(max(auc) - min(auc), 6) AS auc_disparity FROM ({_auc_sql("g").replace("8) AS auc", "15) AS auc").replace("sum(pos) * sum(neg)", "nullif(sum(pos) * sum(neg), 0)")})) SELECT * FROM d, u""")
def fairness_report(spark, sf):
    return rounded(Q.report(predictions(spark, sf), "g"), *_FOUR, "calibration_disparity", "auc_disparity")


@add(f"{_P}, {_T}, r AS (SELECT threshold, g, {_rates_sql('threshold', 15)} FROM pred, t GROUP BY threshold, g) SELECT threshold, {_DIFFS} FROM r GROUP BY threshold")
def fairness_across_thresholds(spark, sf):
    return rounded(Q.across_thresholds(predictions(spark, sf), "g"), *_FOUR)


def _optimal_sql(odds):
    off = "abs(r.tpr - m.t1)" + (" + abs(r.fpr - m.t0)" if odds else "")
    return f"""{_P}, grid AS (SELECT round(0.05 + 0.01 * CAST(i AS DOUBLE), 2) AS threshold FROM range(91) x(i)),
    b AS (SELECT g, count(*) FILTER (WHERE p >= 0.5 AND y = 1) / CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS tpr, coalesce(count(*) FILTER (WHERE p >= 0.5 AND y <> 1) / CAST(nullif(count(*) FILTER (WHERE y <> 1), 0) AS DOUBLE), 0) AS fpr FROM pred GROUP BY g),
    m AS (SELECT avg(tpr) AS t1, avg(fpr) AS t0 FROM b),
    r AS (SELECT g, threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) / CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS tpr, coalesce(count(*) FILTER (WHERE p >= threshold AND y <> 1) / CAST(nullif(count(*) FILTER (WHERE y <> 1), 0) AS DOUBLE), 0) AS fpr FROM pred, grid GROUP BY g, threshold),
    o AS (SELECT g, threshold, tpr, fpr, row_number() OVER (PARTITION BY g ORDER BY round({off}, 12), threshold) AS k FROM r, m) SELECT g, threshold, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr FROM o WHERE k = 1"""


@add(_optimal_sql(False))
def optimal_thresholds_equal_opportunity(spark, sf):
    return rounded(Q.optimal_thresholds(predictions(spark, sf), "g"), "tpr", "fpr", at=8)


@add(_optimal_sql(True))
def optimal_thresholds_equalized_odds(spark, sf):
    return rounded(Q.optimal_thresholds(predictions(spark, sf), "g", goal="equalized_odds"), "tpr", "fpr", at=8)


@add(f"""{_P}, s AS (SELECT g, count(*) AS n FROM pred GROUP BY g) SELECT doc_id, p.g, round((SELECT sum(n) FROM s) / CAST((SELECT count(*) FROM s) * n AS DOUBLE), 8) AS weight FROM pred p JOIN s USING (g)""")
def fairness_group_weights(spark, sf):
    return rounded(Q.group_weights(predictions(spark, sf), "g").select("doc_id", "g", "weight"), "weight", at=8)


@add(f"""{_P}, o AS (SELECT g, avg(p) AS own FROM pred GROUP BY g), a AS (SELECT avg(p) AS mean FROM pred)
    SELECT doc_id, round(least(1, greatest(0, p * CASE WHEN own > 0 AND abs(own - mean) > 1e-9 THEN (0.8::DOUBLE * mean + 0.2::DOUBLE * own) / own ELSE 1 END)), 8) AS p FROM pred JOIN o USING (g), a""")
def fairness_reweighting(spark, sf):
    return rounded(Q.reweighted(predictions(spark, sf), "g").select("doc_id", "p"), "p", at=8)


@add()
def fairness_debiased(spark, sf):
    return Q.debiased(predictions(spark, sf).drop("p"), "doc_id", "g")


@add()
def fairness_cross_validated(spark, sf):
    return Q.cross_validated(predictions(spark, sf), "g", "doc_id")


@add(f"{_P} SELECT g || '_' || source AS pair, count(*) AS n, round(avg(p), 8) AS mean FROM pred GROUP BY pair")
def fairness_intersections(spark, sf):
    return rounded(predictions(spark, sf).groupBy(Q.intersection("g", "source").alias("pair")).agg(F.count("*").alias("n"), F.avg("p").alias("mean")), "mean", at=8)


@add()
def calibration_isotonic(spark, sf):
    return K.isotonic(predictions(spark, sf))


@add()
def calibration_platt(spark, sf):
    return K.platt(predictions(spark, sf))


@add()
def calibration_beta(spark, sf):
    return K.beta(predictions(spark, sf))


@add()
def calibration_by_group(spark, sf):
    return K.by_group(predictions(spark, sf), "g")
