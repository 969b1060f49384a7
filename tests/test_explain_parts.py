"""Explanations are dealt over all cores, and counterfactuals stop drawing once they have their changes."""

import numpy as np
import pytest

from wardline import catalog
from wardline.operators import models

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["explain_counterfactual", "explain_shap", "explain_lime"])
def test_a_small_file_is_many_tasks(spark, name):
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def all_draws(predict, x, base, keys, n=3, draws=500, threshold=0.5):
    u = models._uniform(keys, 2, draws, x.shape[1])
    near = x[:, None] + 0.5 * np.sqrt(-2 * np.log1p(-u[:, 0])) * np.cos(2 * np.pi * u[:, 1]) * (base.std(axis=0) + 1e-12)
    flips = (models._predicted(predict, near) >= threshold) != (models._predicted(predict, x) >= threshold)[:, None]
    flips &= np.cumsum(flips, axis=1) <= 3 * n
    far = np.where(flips, np.abs(near - x[:, None]).sum(axis=2), np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, :n]
    row, place = np.nonzero(np.isfinite(np.take_along_axis(far, order, axis=1)))
    return row, near[row, order[row, place]]


def test_counterfactuals_equal_those_of_all_draws():
    r = np.random.default_rng(1)
    x, base, keys = r.normal(0, 1, (300, 3)), r.normal(0, 1, (50, 3)), r.integers(-(2**62), 2**62, 300)
    x[7] = np.nan
    seen = []

    def predict(z):
        seen.append(len(z))
        return 1 / (1 + np.exp(-z.sum(axis=1)))

    got, want = models.counterfactuals(predict, x, base, keys), all_draws(predict, x, base, keys)
    assert (got[0] == want[0]).all() and np.allclose(got[1], want[1], rtol=1e-14, atol=0) and len(set(got[0])) < 300
    assert sum(seen[:-2]) < 0.7 * seen[-2]
    assert models.counterfactuals(lambda z: np.zeros(len(z)), x, base, keys)[0].size == 0
    assert models.counterfactuals(predict, x[:0], base, keys[:0])[0].size == 0
