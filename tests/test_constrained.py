"""Fits under a bound on disparity, judged on rows that they haven't seen."""

import numpy as np
import pytest

from wardline.operators.constrained import fit_constrained

SCHEMA = "id long, g string, in_a double, x double, y int, share string"


def people(spark, n, seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = r.random() < 0.3
        x = r.normal(1.0 if a else -0.2)
        rows.append((i, "a" if a else None, float(a), float(x), int(r.random() < 1 / (1 + np.exp(-2 * x))), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def rates(fitted, rows):
    got = fitted.decided(rows.drop("share"), "id").toPandas()
    means = got.assign(g=got.g.fillna("none")).groupby("g").decision.mean()
    return means.max() - means.min(), (got.decision != got.y).mean()


def test_bound_holds_on_unseen_rows(spark):
    train, unseen = people(spark, 12_000, 1), people(spark, 12_000, 2)
    free = fit_constrained(train, ["x", "in_a"], "y", "g", 1.0, rounds=1)
    bound = fit_constrained(train, ["x", "in_a"], "y", "g", 0.1)
    gap, wrong = rates(free, unseen)
    assert gap > 0.3 and len(free.models) == 1
    fair, cost = rates(bound, unseen)
    assert bound.met and bound.disparity <= 0.1 and fair <= 0.1 and cost < wrong + 0.12
    assert [r["round"] for r in bound.rounds] == list(range(12)) and sum(r["mixed"] for r in bound.rounds) == len(bound.models)
    one, two = (bound.decided(unseen.drop("share"), "id").orderBy("id").collect() for _ in range(2))
    assert one == two


def test_odd_rows(spark):
    rows = people(spark, 300, 3)
    odd = spark.createDataFrame([(900, "a", 1.0, None, 1, ""), (901, "a", 1.0, float("nan"), 1, ""), (902, "a", 1.0, 0.0, None, "")], SCHEMA)
    fitted = fit_constrained(rows.union(odd), ["x", "in_a"], "y", "g", 0.2, rounds=2)
    got = {r.id: r for r in fitted.decided(odd.drop("share"), "id").collect()}
    assert got[900].decision is None and got[901].share is None and got[902].decision in (0, 1)
    with pytest.raises(ValueError, match="rows"):
        fit_constrained(rows.limit(0), ["x"], "y", "g", 0.1)
