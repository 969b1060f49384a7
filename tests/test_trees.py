"""Tree explanations against all subsets of features, walked down the trees."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from wardline.operators import trees

FEATURES = list("abcde")


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(7)
    rows = []
    for i in range(400):
        x = [float(v) for v in r.integers(0, 6, 2)] + [float(v) for v in r.normal(size=3)]
        y = x[0] * x[2] + x[1] + x[3] * x[4] + float(r.normal()) / 5
        rows.append((i, *x, y, float(y > 2)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, y double, l double")
    df = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(df)
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=6).fit(df).transform(df).cache()


def game(node, x, known, votes):
    """The prediction of a tree where only some features are known."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats) if votes else node.prediction()
    s, children = node.split(), (node.leftChild(), node.rightChild())
    if s.featureIndex() in known:
        v = x[s.featureIndex()]
        left = v <= s.threshold() if s.getClass().getSimpleName() == "ContinuousSplit" else v in list(s.leftCategories())
        return game(children[not left], x, known, votes)
    return sum(c.impurityStats().count() * game(c, x, known, votes) for c in children) / node.impurityStats().count()


@pytest.mark.parametrize(
    "kind, options",
    [
        (GBTRegressor, {"labelCol": "y", "maxIter": 3, "maxDepth": 4}),
        (RandomForestRegressor, {"labelCol": "y", "numTrees": 3, "maxDepth": 4}),
        (GBTClassifier, {"labelCol": "l", "maxIter": 2, "maxDepth": 3}),
        (RandomForestClassifier, {"labelCol": "l", "numTrees": 3, "maxDepth": 3}),
        (DecisionTreeClassifier, {"labelCol": "l", "maxDepth": 4}),
    ],
)
def test_all_subsets(spark, data, kind, options):
    model = kind(seed=1, **options).fit(data)
    some = data.where("id < 6")
    name = type(model).__name__
    votes = name.endswith("ClassificationModel") and not name.startswith("GBT")
    parts = list(zip(model.trees, model.treeWeights)) if hasattr(model, "trees") else [(model, 1.0)]
    of = 1.0 if name.startswith("GBT") else sum(w for _, w in parts)
    whole = lambda x, known: sum(w * game(t._java_obj.rootNode(), x, known, votes) for t, w in parts) / of
    got = {(r.id, r.feature): r.value for r in trees.tree_values(some, model, FEATURES, "id").collect()}
    pairs = {(r.id, r.a, r.b): r.value for r in trees.tree_interactions(some, model, FEATURES, "id").collect()}
    assert len(got) == 30 and len(pairs) == 150
    n, base = len(FEATURES), trees.Leaves(model).base()
    predicted = {r.id: r for r in model.transform(some).collect()}
    for r in some.collect():
        x = [r[f] for f in FEATURES]
        v = {s: whole(x, set(s)) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        at = lambda *s: v[tuple(sorted(s))]
        assert base == pytest.approx(at())
        p = predicted[r.id]
        want = p.probability[1] if votes else p.rawPrediction[1] if name.startswith("GBTC") else p.prediction
        assert base + sum(got[r.id, f] for f in FEATURES) == pytest.approx(want)
        for i, f in enumerate(FEATURES):
            rest = [k for k in range(n) if k != i]
            shapley = sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (at(*s, i) - at(*s)) for k in range(n) for s in itertools.combinations(rest, k))
            assert got[r.id, f] == pytest.approx(shapley, abs=1e-9)
            assert sum(pairs[r.id, f, g] for g in FEATURES) == pytest.approx(shapley, abs=1e-9)
            for j in rest:
                others = [k for k in rest if k != j]
                both = sum(
                    math.factorial(k) * math.factorial(n - k - 2) / math.factorial(n - 1) / 2 * (at(*s, i, j) - at(*s, i) - at(*s, j) + at(*s)) for k in range(n - 1) for s in itertools.combinations(others, k)
                )
                assert pairs[r.id, f, FEATURES[j]] == pytest.approx(both, abs=1e-9)


def test_odd_rows(spark, data):
    model = RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=2, seed=1).fit(data)
    rows = spark.createDataFrame([(1, None, 0.0, 0.0, 0.0, 0.0), (2, 1.0, float("nan"), 0.0, 0.0, 0.0), (3, 1.0, 0.0, 0.0, 0.0, 0.0), (3, 1.0, 0.0, 0.0, 0.0, 0.0)], "id long, a double, b double, c double, d double, e double")
    assert [r.id for r in trees.tree_values(rows, model, FEATURES, "id").collect()] == [3] * 10
    assert trees.tree_interactions(rows.limit(0), model, FEATURES, "id").count() == 0
    with pytest.raises(ValueError, match="5 features"):
        trees.tree_values(rows, model, FEATURES[:2], "id")
    with pytest.raises(ValueError, match="lack|missing"):
        trees.tree_values(rows.drop("a"), model, FEATURES, "id")
