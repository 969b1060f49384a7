"""Calibration of scores: isotonic, logistic (Platt) and beta, over all rows by Spark ML and by group in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups with fewer rows keep their scores.
LEAST = 5


def isotonic(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Adds ``calibrated``: the isotonic fit of the outcome on the score."""
    rows = df.withColumn("_x", F.col(p).cast("double")).withColumn("_y", F.col(y).cast("double"))
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="calibrated").fit(rows)
    return model.transform(rows).withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated"))).drop("_x", "_y")


def _logistic(df: DataFrame, columns: dict, y: str) -> DataFrame:
    rows = VectorAssembler(inputCols=list(columns), outputCol="_f").transform(df.withColumns(columns).withColumn("_y", F.col(y).cast("double")))
    n = max(1, rows.count())
    model = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=1.0 / n, standardization=False, tol=1e-10, maxIter=200, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(rows)
    return model.transform(rows).withColumn("calibrated", vector_to_array("_p")[1]).drop(*columns, "_f", "_y", "_p", "_r", "_c")


def platt(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Adds ``calibrated``: logistic regression on the score, with a penalty of strength 1."""
    return _logistic(df, {"_x": F.col(p).cast("double")}, y)


def beta(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Adds ``calibrated``: logistic regression on the logarithms of the score and of what it lacks to 1."""
    x = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col(p)))
    return _logistic(df, {"_x0": F.ln(x), "_x1": F.ln(1 - x)}, y)


def _isotonic(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pools adjacent violators over distinct scores."""
    x, at = np.unique(p, return_inverse=True)
    n = np.bincount(at, w)
    means, sizes, spans = [], [], []
    for m, k in zip(np.bincount(at, y * w) / n, n):
        means.append(m), sizes.append(k), spans.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            m, k, s = means.pop(), sizes.pop(), spans.pop()
            means[-1] = (means[-1] * sizes[-1] + m * k) / (sizes[-1] + k)
            sizes[-1] += k
            spans[-1] += s
    return np.repeat(means, spans)[at]


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logistic regression with intercept and a penalty of strength 1 on the other coefficients."""
    x = np.column_stack([x, np.ones(len(y))])
    penalty = np.diag([1.0] * (x.shape[1] - 1) + [1e-9])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x.T * (w * q * (1 - q))) @ x + penalty, x.T @ (w * (y - q)) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return 1 / (1 + np.exp(-x @ b))


def calibrated(p: np.ndarray, y: np.ndarray, method: str, w: np.ndarray | None = None) -> np.ndarray:
    """``w``: how many rows each one stands for, over 0; 1 if left out."""
    w = np.ones(len(p)) if w is None else w
    if w.sum() < LEAST or len(np.unique(y)) < 2:
        return p
    if method == "isotonic":
        return np.clip(_isotonic(p, y, w), 0, 1)
    if method == "platt":
        return _newton(p[:, None], y, w)
    if method == "beta":
        q = np.clip(p, 1e-7, 1 - 1e-7)
        return _newton(np.column_stack([np.log(q), np.log(1 - q)]), y, w)
    raise ValueError(f"unknown method {method!r}")


def by_group(df: DataFrame, group: str, p: str = "p", y: str = "y", method: str = "isotonic", bins: int = 10_000) -> DataFrame:
    """Brier scores by group before and after calibration within it, and its size.

    A group is first summed up by score, rounded to one in ``bins``, so that what meets in one task is bounded. The fit takes
    each cell with its number of rows, whatever the group's size.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(p).isNotNull() & F.col(y).isNotNull())
    cells = rows.groupBy(group, (F.round(F.col(p) * bins) / bins).alias("_x")).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("double")).alias("_k"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("_e"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, n, k = (part[c].to_numpy(float) for c in ("_x", "_n", "_k"))
        p, y = np.repeat(x, 2), np.tile([1.0, 0.0], len(x))
        w = np.column_stack([k, n - k]).ravel()
        p, y, w = p[w > 0], y[w > 0], w[w > 0]
        after = np.average((calibrated(p, y, method, w) - y) ** 2, weights=w)
        return pd.DataFrame([{group: part[group].iloc[0], "n": int(n.sum()), "brier_before": part["_e"].sum() / n.sum(), "brier_after": float(after)}])

    return cells.groupBy(group).applyInPandas(fit, f"`{group}` {dict(df.dtypes)[group]}, n long, brier_before double, brier_after double")
