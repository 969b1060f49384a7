"""Exact Shapley values and interactions of Spark ML's trees, forests and boosted trees, by their paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wardline.frames import require

#: Rows of a batch that are explained together.
ROWS = 2048


class Leaves:
    """A model's leaves: what each adds to the prediction, and by feature of its path the splits a row must pass and the share of training
    rows that pass them."""

    def __init__(self, model):
        self.paths: list[tuple[float, list[tuple[int, float, list]]]] = []
        several = hasattr(model, "trees")
        trees = model.trees if several else [model]
        weights = list(model.treeWeights) if several else [1.0]
        boosted = type(model).__name__.startswith("GBT")
        scale = 1.0 if boosted else 1.0 / sum(weights)
        votes = type(model).__name__.endswith("ClassificationModel") and not boosted
        for tree, weight in zip(trees, weights):
            self._walk(tree._java_obj.rootNode(), weight * scale, votes, {})

    def _walk(self, node, weight: float, votes: bool, path: dict) -> None:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats()) if votes else None
            value = stats[1] / sum(stats) if votes else node.prediction()
            self.paths.append((weight * value, [(f, share, tests) for f, (share, tests) in path.items()]))
            return
        split, whole = node.split(), node.impurityStats().count()
        kind = split.getClass().getSimpleName()
        bound = split.threshold() if kind == "ContinuousSplit" else np.array(list(split.leftCategories()), float)
        f = split.featureIndex()
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            share, tests = path.get(f, (1.0, []))
            self._walk(child, weight, votes, {**path, f: (share * child.impurityStats().count() / whole, [*tests, (bound, left)])})

    def base(self) -> float:
        """The prediction of no feature known: the mean over training rows."""
        return sum(v * float(np.prod([s for _, s, _ in path])) for v, path in self.paths)

    def _terms(self, x: np.ndarray) -> Iterator[tuple[float, list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """By leaf: its value, features, whether rows pass their splits less the share that does, factors at the nodes of a quadrature, and its weights.

        A set of known features has the leaf's value times, for each feature of the path, 1 or 0 if known and the share if not. A Shapley
        value weighs sets by the integral of t to their size and 1 - t to the rest, so sums over all sets become the integral of a
        product of t * passed + (1 - t) * share, which Gauss and Legendre's nodes give exactly.
        """
        for value, path in self.paths:
            if value == 0 or not path:
                continue
            passed = np.ones((len(x), len(path)))
            for i, (f, _, tests) in enumerate(path):
                for bound, left in tests:
                    goes = x[:, f] <= bound if np.isscalar(bound) else np.isin(x[:, f], bound)
                    passed[:, i] *= goes == left
            share = np.array([s for _, s, _ in path])
            nodes, weights = np.polynomial.legendre.leggauss(len(path) // 2 + 1)
            t = (nodes + 1) / 2
            factors = t * passed[:, :, None] + (1 - t) * share[None, :, None]
            yield value, [f for f, _, _ in path], passed - share, factors, weights / 2

    @staticmethod
    def _without(factors: np.ndarray, *skip: int) -> np.ndarray:
        return np.delete(factors, skip, axis=1).prod(axis=1)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Rows by features."""
        out = np.zeros(x.shape)
        for value, features, change, factors, weights in self._terms(x):
            for i, f in enumerate(features):
                out[:, f] += value * change[:, i] * (self._without(factors, i) @ weights)
        return out

    def interactions(self, x: np.ndarray) -> np.ndarray:
        """Rows by features by features: half of each pair's interaction on either side, what is left of a feature's value on the diagonal."""
        out = np.zeros((*x.shape, x.shape[1]))
        for value, features, change, factors, weights in self._terms(x):
            for i, f in enumerate(features):
                for j, g in enumerate(features[:i]):
                    both = value * change[:, i] * change[:, j] * (self._without(factors, i, j) @ weights) / 2
                    out[:, f, g] += both
                    out[:, g, f] += both
        at = np.arange(x.shape[1])
        out[:, at, at] = self.values(x) - out.sum(axis=2)
        return out


def _explained(df: DataFrame, model, features: list[str], key: str, pairs: bool) -> DataFrame:
    require(df, [key, *features])
    if model.numFeatures != len(features):
        raise ValueError(f"the model has {model.numFeatures} features")
    leaves = df.sparkSession.sparkContext.broadcast(Leaves(model))
    names, n = np.array(features), len(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                some = batch.iloc[k : k + ROWS]
                x, keys = some[features].to_numpy(float), some[key].to_numpy()
                if pairs:
                    v = leaves.value.interactions(x)
                    yield pd.DataFrame({key: np.repeat(keys, n * n), "a": np.tile(np.repeat(names, n), len(x)), "b": np.tile(names, n * len(x)), "value": v.ravel()})
                else:
                    yield pd.DataFrame({key: np.repeat(keys, n), "feature": np.tile(names, len(x)), "value": leaves.value.values(x).ravel()})

    rows = df.select(key, *features).dropna(subset=features)
    kind = dict(df.dtypes)[key]
    return rows.mapInPandas(run, f"`{key}` {kind}, a string, b string, value double" if pairs else f"`{key}` {kind}, feature string, value double")


def tree_values(df: DataFrame, model, features: list[str], key: str) -> DataFrame:
    """key, feature and value: how each feature of a row moves the model's prediction from ``Leaves(model).base()``; a row's values sum to
    its prediction less that. Unknown features are averaged along the trees, by how many training rows went either way.

    ``model`` is a fitted decision tree, forest or boosted trees of Spark ML, ``features`` its vector's columns in order. Of classifiers, trees and
    forests are explained by the probability of class 1, boosted trees by their margin. Rows that lack a feature (null or NaN) are left
    out, repeated keys are each explained. Nothing is shuffled; the cost is rows times leaves times a path's features.
    """
    return _explained(df, model, features, key, False)


def tree_interactions(df: DataFrame, model, features: list[str], key: str) -> DataFrame:
    """key, a, b and value for all pairs of features, in both orders: half their interaction each; where a is b, the feature's value less its
    interactions. A row's values by a sum to ``tree_values``. Rows as there."""
    return _explained(df, model, features, key, True)
