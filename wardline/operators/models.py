"""Risk models on Spark ML, batch scoring by any function, survival, and explanations.

Explainers take ``predict``, a function from a matrix of features to scores; it runs in Arrow batches on the executors, over a
background sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.frames import dealt, exact_quantiles, running_totals

Predict = Callable[[np.ndarray], np.ndarray]
MODELS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier, "factorization": FMClassifier}
#: Rows of background data that explainers hold.
BACKGROUND = 100


def pipeline(kind: str, numeric: list[str], categories: list[str], label: str, **options) -> Pipeline:
    """Scaled numbers, categories one-hot (unknown ones kept apart), and a classifier: logistic, forest, boosted,
    factorization or perceptron (with ``layers`` between input and output)."""
    stages, inputs = [], []
    if numeric:
        stages += [VectorAssembler(inputCols=numeric, outputCol="_numeric", handleInvalid="keep"), StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True)]
        inputs.append("_scaled")
    if categories:
        stages += [StringIndexer(inputCols=categories, outputCols=[f"_{c}_i" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_{c}_i" for c in categories], outputCols=[f"_{c}_v" for c in categories])]
        inputs += [f"_{c}_v" for c in categories]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    if kind == "perceptron":
        stages.append(MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", **options))
    else:
        stages.append(MODELS[kind](labelCol=label, featuresCol="features", **options))
    return Pipeline(stages=stages)


def scored(model, df: DataFrame) -> DataFrame:
    """The model's probability of label 1, its interval and the 30-day probability; score, low, high and score_30d to 4 places."""
    rows = model.transform(df).withColumn("_p", vector_to_array("probability")[1])
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    out = rows.withColumns({"score": F.bround("_p", 4), "low": F.bround(clamp(F.col("_p") - 0.1), 4), "high": F.bround(clamp(F.col("_p") + 0.1), 4), "score_30d": F.bround(clamp(F.col("_p") * 1.1), 4)})
    return out.drop("_p", *(c for c in out.columns if c not in df.columns and c not in ("score", "low", "high", "score_30d")))


def batch_score(df: DataFrame, features: list[str], predict: Predict, key: str = "patient_id") -> DataFrame:
    """``predict`` over Arrow batches: key, score, status and detail. If a batch fails, its rows are tried one by one, and those
    that fail have the status error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = part[features].to_numpy(float)
            try:
                yield pd.DataFrame({"key": part[key].astype(str), "score": predict(x), "status": "ok", "detail": None})
            except Exception:  # any error of the caller's function is reported by row
                rows = []
                for k, row in zip(part[key].astype(str), x):
                    try:
                        rows.append((k, float(predict(row[None])[0]), "ok", None))
                    except Exception as e:
                        rows.append((k, None, "error", str(e)))
                yield pd.DataFrame(rows, columns=["key", "score", "status", "detail"])

    return df.select(key, *features).mapInPandas(run, "key string, score double, status string, detail string")


def _median(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row, null without values."""
    return exact_quantiles(df, column, [0.5]).agg(F.max(F.col("q")[0]).alias(name))


def batch_summary(results: DataFrame, high: float = 0.75, medium: float = 0.40) -> DataFrame:
    """Scored, failed, patients by risk band, mean and median score."""
    s = F.col("score")
    return results.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(s >= high).alias("high"), F.count_if((s >= medium) & (s < high)).alias("medium"), F.count_if(s < medium).alias("low"), F.avg("score").alias("mean_score")).crossJoin(_median(results, "score", "median_score"))


def cox(df: DataFrame, time: str, event: str, features: list[str], rounds: int = 8) -> dict[str, float]:
    """Coefficients of a proportional hazards model by Newton's method (ties by Breslow).

    Rows are summed up by time first; sums over the risk sets are then running totals over distinct times, in bins by
    time, so that each round is two aggregations and only sums of the features' size reach the driver.
    """
    n = len(features)
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("d"), F.array(*(F.col(f).cast("double") for f in features)).alias("x")).where("t IS NOT NULL").persist()
    beta = np.zeros(n)
    for _ in range(rounds):
        z = sum((float(b) * F.col("x")[i] for i, b in enumerate(beta)), F.lit(0.0))
        w = rows.withColumn("e", F.exp(z))
        s1 = [F.sum(F.col("e") * F.col("x")[i]).alias(f"a{i}") for i in range(n)]
        s2 = [F.sum(F.col("e") * F.col("x")[i] * F.col("x")[j]).alias(f"b{i}_{j}") for i in range(n) for j in range(i, n)]
        sx = [F.sum(F.col("d") * F.col("x")[i]).alias(f"x{i}") for i in range(n)]
        by = w.groupBy("t").agg(F.sum("d").alias("d"), F.sum("e").alias("e"), *s1, *s2, *sx)
        sums = ["e", *(f"a{i}" for i in range(n)), *(f"b{i}_{j}" for i in range(n) for j in range(i, n))]
        total = running_totals(by, "t", sums).drop(*sums).withColumnsRenamed({f"{c}_upto": c for c in sums})
        g = [F.sum(F.col(f"x{i}") - F.col("d") * F.col(f"a{i}") / F.col("e")).alias(f"g{i}") for i in range(n)]
        h = [F.sum(F.col("d") * (F.col(f"b{i}_{j}") / F.col("e") - F.col(f"a{i}") * F.col(f"a{j}") / F.pow("e", F.lit(2)))).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
        r = total.where("d > 0").agg(*g, *h).first()
        grad = np.array([r[f"g{i}"] or 0.0 for i in range(n)])
        hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
        step = np.linalg.solve(hess + 1e-9 * np.eye(n), grad)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    rows.unpersist()
    return dict(zip(features, beta.tolist()))


def background(df: DataFrame, features: list[str], key: str, n: int = BACKGROUND) -> np.ndarray:
    """At most ``n`` rows of the smallest hashed keys, as a matrix."""
    rows = df.orderBy(F.xxhash64(key), key).limit(n).select(*(F.col(f).cast("double") for f in features)).collect()
    return np.array([list(r) for r in rows], float).reshape(-1, len(features))


def _uniform(keys: np.ndarray, *shape: int) -> np.ndarray:
    """Numbers from 0 to 1 for each row, drawn from its key alone, so that they don't depend on how rows are batched."""
    return _numbered(keys, np.arange(np.prod(shape, dtype=int))).reshape(len(keys), *shape)


def _numbered(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Of each row's numbers those in these places."""
    x = keys.astype(np.uint64)[:, None] + (numbers.ravel().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)).reshape(len(keys), *numbers.shape)


def _normal(keys: np.ndarray, draws: int, d: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """``draws`` vectors of ``d`` normal numbers for each row, of which those from ``begin`` to ``end`` are returned."""
    places = np.arange(draws * d).reshape(draws, d)[begin:end]
    return np.sqrt(-2 * np.log1p(-_numbered(keys, places))) * np.cos(2 * np.pi * _numbered(keys, places + draws * d))


def _predicted(predict: Predict, x: np.ndarray) -> np.ndarray:
    """Scores of an array of any shape whose last axis is the features."""
    return np.asarray(predict(x.reshape(-1, x.shape[-1])), float).reshape(x.shape[:-1])


def permutation_values(predict: Predict, x: np.ndarray, base: np.ndarray, keys: np.ndarray, rounds: int = 10, legacy: bool = False) -> np.ndarray:
    """Of each row of ``x``, the mean contributions over random orders of the features, from a background row to it; they sum to the
    difference of the scores. ``legacy``: each feature gets the difference of its prefix to the background itself."""
    n, d = x.shape
    u = _uniform(keys, rounds, d + 1)
    place = np.argsort(np.argsort(u[:, :, :d], axis=2), axis=2)
    start = base[(u[:, :, d] * len(base)).astype(int)]
    steps = np.where(place[:, :, None, :] < np.arange(d + 1)[None, None, :, None], x[:, None, None, :], start[:, :, None, :])
    y = _predicted(predict, steps)
    gain = y[:, :, 1:] - y[:, :, :1] if legacy else np.diff(y, axis=2)
    return np.take_along_axis(gain, place, axis=2).mean(axis=1)


def lime_values(predict: Predict, x: np.ndarray, base: np.ndarray, keys: np.ndarray, draws: int = 200) -> np.ndarray:
    """Coefficients of a ridge fit to scores around each row of ``x``, near ones weighing more."""
    n, d = x.shape
    spread = base.std(axis=0) + 1e-12
    near = x[:, None] + 0.1 * _normal(keys, draws, d) * spread
    far = np.sqrt((((near - x[:, None]) / spread) ** 2).sum(axis=2))
    w = np.exp(-np.square(far / np.maximum(np.percentile(far, 75, axis=1, keepdims=True), 1e-12)))
    y = _predicted(predict, near)
    total = w.sum(axis=1)
    near = near - (np.einsum("nk,nkd->nd", w, near) / total[:, None])[:, None]
    y = y - ((w * y).sum(axis=1) / total)[:, None]
    a = near * w[:, :, None]
    return np.linalg.solve(np.einsum("nkd,nke->nde", a, near) + np.eye(d), np.einsum("nkd,nk->nd", a, y)[:, :, None])[:, :, 0]


def counterfactuals(predict: Predict, x: np.ndarray, base: np.ndarray, keys: np.ndarray, n: int = 3, draws: int = 500, threshold: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """The nearest (L1) ``n`` of the first 3 n random changes of each row that put its score on the other side of the threshold: the
    rows' positions, and the changed rows, the nearest first."""
    spread, side, todo, count, found = base.std(axis=0) + 1e-12, _predicted(predict, x) >= threshold, np.arange(len(x)), np.zeros(len(x), int), []
    # A row is done with the part of its draws in which its last change comes.
    for begin in range(0, draws, _DRAWN):
        if not len(todo):
            break
        near = x[todo, None] + 0.5 * _normal(keys[todo], draws, x.shape[1], begin, begin + _DRAWN) * spread
        flips = (_predicted(predict, near) >= threshold) != side[todo, None]
        upto = np.cumsum(flips, axis=1) + count[todo, None]
        row, place = np.nonzero(flips & (upto <= 3 * n))
        found.append((todo[row], near[row, place]))
        count[todo] = upto[:, -1]
        todo = todo[count[todo] < 3 * n]
    if not found:
        return np.zeros(0, int), x[:0]
    row, near = (np.concatenate(f) for f in zip(*found))
    # Stable, so that equally near ones keep the order in which they were drawn.
    order = np.lexsort((np.abs(near - x[row]).sum(axis=1), row))
    row, near = row[order], near[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[first], near[first]


#: Numbers that a block of rows hands to ``predict`` at most, and how many a row takes, by method.
_BLOCK = 1 << 21
#: How many changes of a row are drawn at once.
_DRAWN = 50
_DRAWS = {"shap": 11, "lime": 200, "counterfactual": 500}


def _explained(method: str, predict: Predict, x: np.ndarray, base: np.ndarray, keys: np.ndarray, legacy: bool) -> tuple[np.ndarray, np.ndarray]:
    if method == "counterfactual":
        return counterfactuals(predict, x, base, keys)
    values = permutation_values(predict, x, base, keys, legacy=legacy) if method == "shap" else lime_values(predict, x, base, keys)
    return np.arange(len(x)), values


def explain(df: DataFrame, features: list[str], predict: Predict, base: np.ndarray, key: str, method: str = "shap", seed: int = 0, legacy: bool = False) -> DataFrame:
    """Long explanations: key, feature, value; shap, lime, attention, or counterfactual (with ``option``, one for each change).

    ``predict`` is called once for a block of rows, for counterfactuals once for each part of its draws. The rows are dealt over the cluster,
    whatever files they come from. Attention, each value's share of the row's absolute values, needs no Python.
    """
    if method == "attention":
        return attention(df, features, key)
    if method not in _DRAWS:
        raise ValueError(f"unknown method {method!r}")
    size = max(1, _BLOCK // (_DRAWS[method] * len(features) * (len(features) + 1 if method == "shap" else 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), size):
                some = part.iloc[i : i + size]
                row, values = _explained(method, predict, some[features].to_numpy(float), base, some["_draw"].to_numpy(np.int64), legacy)
                option = np.arange(len(row)) - np.searchsorted(row, row)
                names = some[key].astype(str).to_numpy()[row]
                yield pd.DataFrame({"key": np.repeat(names, len(features)), "option": np.repeat(option, len(features)), "feature": np.tile(features, len(row)), "value": values.ravel()})

    draw = F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("_draw")
    return dealt(df.select(key, *features, draw)).mapInPandas(run, "key string, option int, feature string, value double")


def attention(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """Each value's share of the row's absolute values, all equal in a row of zeros."""
    size = F.array(*(F.abs(F.col(f).cast("double")) for f in features))
    rows = df.select(F.col(key).cast("string").alias("key"), size.alias("_x")).withColumn("_s", F.aggregate("_x", F.lit(0.0), lambda a, x: a + x))
    share = lambda i: F.when(F.col("_s") > 0, F.col("_x")[i] / F.col("_s")).otherwise(1 / len(features))
    return rows.select("key", F.inline(F.array(*(F.struct(F.lit(0).alias("option"), F.lit(f).alias("feature"), share(i).alias("value")) for i, f in enumerate(features)))))


def interactions(df: DataFrame, features: list[str], predict: Predict, base: np.ndarray, key: str, seed: int = 0, rounds: int = 10) -> DataFrame:
    """How much each two features do together beyond what they do apart: key, a, b, value. For random orders of the features and
    background rows, the score with both set to the row's values, less that with either alone, plus that with neither, after the features
    that come before both; half of the mean, so that a and b share it."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    size = max(1, _BLOCK // (4 * rounds * max(1, len(pairs)) * len(features)))

    def values(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        n, d = x.shape
        u = _uniform(keys, rounds, d + 1)
        start, out = base[(u[:, :, d] * len(base)).astype(int)], np.zeros((n, len(pairs)))
        for p, (i, j) in enumerate(pairs):
            before = u[:, :, :d] < np.minimum(u[:, :, i], u[:, :, j])[:, :, None]
            with_ = np.repeat(before[:, :, None, :], 4, axis=2)
            with_[:, :, :, i], with_[:, :, :, j] = np.array([True, True, False, False]), np.array([True, False, True, False])
            y = _predicted(predict, np.where(with_, x[:, None, None, :], start[:, :, None, :]))
            out[:, p] = (y[:, :, 0] - y[:, :, 1] - y[:, :, 2] + y[:, :, 3]).mean(axis=1) / 2
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for k in range(0, len(part), size):
                some = part.iloc[k : k + size]
                v = values(some[features].to_numpy(float), some["_draw"].to_numpy(np.int64))
                yield pd.DataFrame({"key": np.repeat(some[key].astype(str).to_numpy(), len(pairs)), "a": np.tile([features[i] for i, _ in pairs], len(some)), "b": np.tile([features[j] for _, j in pairs], len(some)), "value": v.ravel()})

    draw = F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("_draw")
    return dealt(df.select(key, *features, draw)).mapInPandas(run, "key string, a string, b string, value double")


def global_importance(explanations: DataFrame, n: int | None = None) -> DataFrame:
    """Mean absolute value by feature, the largest first."""
    out = explanations.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.desc("importance"), "feature")
    return out.limit(n) if n else out


def permutation_importance(df: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], metric: Callable[[DataFrame], float], key: str, seed: int = 0) -> list[tuple[str, float]]:
    """How much a metric falls when one feature's values are dealt anew among the rows: a shift by hashed order, within buckets of the key's
    hash, of some 10,000 rows each in a large table."""
    from pyspark.sql.window import Window

    whole, buckets = metric(score(df)), max(256, df.count() // 10_000)
    out = []
    for i, f in enumerate(features):
        bucket = F.pmod(F.xxhash64(key, F.lit(seed + i)), F.lit(buckets))
        w = Window.partitionBy(bucket).orderBy(F.xxhash64(F.lit(seed + i), key))
        moved = df.withColumn(f, F.coalesce(F.lag(f).over(w), F.first(f).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        out.append((f, whole - metric(score(moved))))
    return sorted(out, key=lambda x: -x[1])


def partial_dependence(df: DataFrame, feature: str, grid: list[float], score: Callable[[DataFrame], DataFrame], column: str = "score") -> DataFrame:
    """The mean score with the feature set to each value of the grid."""
    grid_ = F.array(*(F.lit(float(g)) for g in grid))
    return score(df.withColumn(feature, F.explode(grid_))).groupBy(feature).agg(F.avg(column).alias("mean_score"))
