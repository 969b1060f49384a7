"""Evaluation of a score against a 0/1 outcome: areas, curves, calibration, thresholds.

Ranks come from one row for each distinct score, with counts of both outcomes, so that the global order is over distinct
scores only; the group, if any, partitions it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.frames import running_totals

THRESHOLDS = tuple(round(0.1 * i, 1) for i in range(1, 10))


def by_score(df: DataFrame, p: str = "p", y: str = "y", by: list[str] = ()) -> DataFrame:
    """Distinct scores with the positives and negatives at each."""
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    return rows.groupBy(*by, F.col(p).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def auc(df: DataFrame, p: str = "p", y: str = "y", by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties at half (Mann-Whitney); null with one outcome only."""
    s = running_totals(by_score(df, p, y, by), "score", ["pos", "neg"], by)
    won = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2))
    return s.groupBy(*by).agg(won.alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).select(*by, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def curve(df: DataFrame, p: str = "p", y: str = "y", by: list[str] = (), with_counts: bool = False) -> DataFrame:
    """One row for each distinct threshold, from the highest: tp, fp, recall (tpr), fpr, precision and F1 at it (and
    its own positives, ``pos``)."""
    s = running_totals(by_score(df, p, y, by), "score", ["pos", "neg"], by)
    s = s.select(*by, F.col("score").alias("threshold"), F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"), F.col("pos_total").alias("n_pos"), F.col("neg_total").alias("n_neg"), *(["pos"] if with_counts else []))
    recall, precision = F.try_divide(F.col("tp").cast("double"), F.col("n_pos").cast("double")), F.col("tp") / (F.col("tp") + F.col("fp"))
    s = s.withColumn("tpr", recall).withColumn("fpr", F.try_divide(F.col("fp").cast("double"), F.col("n_neg").cast("double"))).withColumn("precision", precision)
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr")), F.lit(0.0)))


def average_precision(df: DataFrame, p: str = "p", y: str = "y", by: list[str] = ()) -> DataFrame:
    """The sum over thresholds of precision times the gain in recall."""
    c = curve(df, p, y, by, with_counts=True)
    return c.groupBy(*by).agg(F.sum(F.col("precision") * F.col("pos") / F.col("n_pos")).alias("average_precision"))


def best_f1(df: DataFrame, p: str = "p", y: str = "y", by: list[str] = ()) -> DataFrame:
    """The threshold of the best F1 (the highest threshold if several), with precision and recall there."""
    c = curve(df, p, y, by)
    top = F.max(F.struct("f1", "threshold", "precision", F.col("tpr").alias("recall"))).alias("b")
    return c.groupBy(*by).agg(top).select(*by, "b.threshold", "b.precision", "b.recall", "b.f1")


def calibration_bins(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10, plot: bool = False, by: list[str] = ()) -> DataFrame:
    """Mean score and outcome by bin of equal width. An edge belongs to the lower bin; with ``plot`` to the upper one, and a
    score of 1 to none. Empty bins are absent."""
    x = F.col(p) * bins
    at = F.floor(x) if plot else F.greatest(F.ceil(x) - 1, F.lit(0))
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", at.cast("int"))
    if plot:
        rows = rows.where(F.col("bin") < bins)
    return rows.groupBy(*by, "bin").agg(F.avg(p).alias("mean_score"), F.avg(y).alias("mean_outcome"), F.count("*").alias("n"))


def calibration_line(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10, by: list[str] = ()) -> DataFrame:
    """Slope and intercept of the bins' outcomes on their scores."""
    b = calibration_bins(df, p, y, bins, by=by)
    return b.groupBy(*by).agg(F.regr_slope("mean_outcome", "mean_score").alias("slope"), F.regr_intercept("mean_outcome", "mean_score").alias("intercept"))


def brier(df: DataFrame, p: str = "p", y: str = "y", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def confusion(p: Column, y: Column, threshold: Column) -> dict[str, Column]:
    """Counts at a threshold; a score equal to it is positive, a missing one negative."""
    yes = F.coalesce(p >= threshold, F.lit(False))
    return {"tp": F.count_if(yes & (y == 1)), "fp": F.count_if(yes & (y != 1)), "fn": F.count_if(~yes & (y == 1)), "tn": F.count_if(~yes & (y != 1))}


def threshold_metrics(df: DataFrame, p: str = "p", y: str = "y", thresholds=THRESHOLDS, by: list[str] = ()) -> DataFrame:
    """Sensitivity, specificity and predictive values at each threshold, null where a denominator is 0. All thresholds are
    conditional counts of one aggregation, unfolded afterwards."""
    parts = [F.struct(F.lit(float(t)).alias("threshold"), *(c.alias(n) for n, c in confusion(F.col(p), F.col(y), F.lit(t)).items())) for t in thresholds]
    rows = df.groupBy(*by).agg(F.array(*parts).alias("all")).select(*by, F.inline("all"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return rows.select(*by, "threshold", rate("tp", "fn").alias("sensitivity"), rate("tn", "fp").alias("specificity"), rate("tp", "fp").alias("ppv"), rate("tn", "fn").alias("npv"))


def regression_metrics(df: DataFrame, p: str = "p", y: str = "y", by: list[str] = ()) -> DataFrame:
    e = F.col(p) - F.col(y)
    sums = df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    return sums.withColumn("r2", 1 - F.try_divide(F.col("_sse"), F.col("_sst"))).drop("_sse", "_sst")


def model_gate(df: DataFrame, p: str = "p", y: str = "y", least_auc: float = 0.7, least_precision: float = 0.6, least_recall: float = 0.5) -> DataFrame:
    """One row: area, precision and recall at the best F1, and whether all three reach their least values."""
    both = auc(df, p, y).crossJoin(best_f1(df, p, y))
    passed = (F.col("auc") >= least_auc) & (F.col("precision") >= least_precision) & (F.col("recall") >= least_recall)
    return both.select("auc", "precision", "recall", F.coalesce(passed, F.lit(False)).alias("passed"))
