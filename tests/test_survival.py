"""Baseline hazard, survival and concordance against loops over all pairs."""

import math
import random

import pytest

from wardline.operators import survival

SCHEMA = "t double, d int, x double, r double"


def sample(n, seed, times):
    r = random.Random(seed)
    rows = [(float(r.choice(times)), r.randint(0, 1), r.uniform(-1, 1), float(r.randint(0, 8))) for _ in range(n)]
    return rows + [(None, 1, 0.0, 1.0), (2.0, None, 0.0, 1.0), (2.0, 1, None, None), (float("nan"), 1, 0.0, 1.0)]


def whole(rows):
    return [r for r in rows if all(v is not None and not math.isnan(v) for v in r)]


def pairs(rows):
    out = [0, 0, 0]
    for t, d, _, r in rows:
        for u, e, _, s in rows:
            if d and (t < u or (t == u and not e)):
                out[0] += 1
                out[1] += r > s
                out[2] += r == s
    return out


@pytest.mark.parametrize("times", [range(1, 6), [i / 7 for i in range(500)], [3]])
def test_concordance(spark, times):
    rows = sample(200, 1, times)
    got = survival.concordance(spark.createDataFrame(rows, SCHEMA), "t", "d", "r").first()
    n, more, same = pairs(whole(rows))
    assert (got.comparable, got.concordant, got.tied) == (n, more, same)
    assert got.concordance == pytest.approx((more + same / 2) / n)


def test_no_pairs(spark):
    for rows in ([], [(1.0, 0, 0.0, 1.0)] * 3, [(1.0, 1, 0.0, 1.0)] * 3):
        got = survival.concordance(spark.createDataFrame(rows, SCHEMA), "t", "d", "r").first()
        assert got.comparable == 0 and got.concordance is None
    assert survival.baseline_hazard(spark.createDataFrame([], SCHEMA), "t", "d", {"x": 1.0}).count() == 0


def test_hazard_and_survival(spark):
    rows, b = sample(150, 2, range(1, 30)), {"x": 0.7}
    df = spark.createDataFrame(rows, SCHEMA)
    base = survival.baseline_hazard(df, "t", "d", b)
    some, total, want = whole(rows), 0.0, {}
    for t in sorted({r[0] for r in some if r[1]}):
        events = sum(r[1] for r in some if r[0] == t)
        h = events / sum(math.exp(0.7 * r[2]) for r in some if r[0] >= t)
        total += h
        want[t] = (events, h, total)
    got = {r.time: (r.events, r.hazard, r.cumulative) for r in base.collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)
    upto = lambda day: sum(h for t, (_, h, _) in want.items() if t <= day)
    for r in survival.survival(df, base, b, [0, 7, 100]).collect():
        if r.x is None:
            assert r.survival_7 is None
        else:
            assert r.survival_0 == 1 and r.survival_7 == pytest.approx(math.exp(-upto(7) * math.exp(0.7 * r.x)))
            assert r.survival_100 <= r.survival_7
    assert survival.hazard_ratios({"x": 0.0, "y": math.log(2)}) == pytest.approx({"x": 1.0, "y": 2.0})
