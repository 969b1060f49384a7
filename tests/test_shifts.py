"""Drift tests against loops over values, and against closed forms of their distributions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import shifts

SCHEMA = "g string, x double, c string, now boolean, n0 long"


def sample(n, seed, values):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        now = r.random() < 0.4
        rows.append((r.choice(["a", None]), float(r.choice(values) + 2 * now), r.choice("uvwxy" if now else "uvw"), now, 7))
    return rows + [("a", None, None, True, 0), ("a", float("nan"), "u", False, 0), ("a", 1.0, "u", None, 0), ("none now", 1.0, "u", False, 0)]


def ks(was, now):
    share = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    return max(abs(share(was, v) - share(now, v)) for v in {*was, *now})


def psi(was, now, bins):
    ordered = sorted(was)
    cuts = {ordered[math.ceil(i * len(was) / bins) - 1] for i in range(1, bins)}
    place = lambda v: sum(c < v for c in cuts)
    out = 0.0
    for b in range(bins):
        e, a = (max(sum(place(v) == b for v in xs) / len(xs), 1e-4) for xs in (was, now))
        out += (a - e) * math.log(a / e)
    return out


@pytest.mark.parametrize("values", [range(5), [i / 3 for i in range(300)], [1]])
def test_numeric(spark, values):
    rows = sample(300, 1, values)
    got = {r.g: r for r in shifts.numeric_shift(spark.createDataFrame(rows, SCHEMA), ["x"], "now", ["g"], bins=4).collect()}
    for g in ("a", None):
        was, now = ([r[1] for r in rows if r[0] == g and r[3] is side and r[1] is not None and not math.isnan(r[1])] for side in (False, True))
        assert (got[g].baseline_rows, got[g].current_rows) == (len(was), len(now))
        assert got[g].ks == pytest.approx(ks(was, now)) and got[g].psi == pytest.approx(psi(was, now, 4))
        assert got[g].level == ("major" if got[g].psi >= 0.25 else "moderate" if got[g].psi >= 0.1 else "stable")
    lone = got["none now"]
    assert (lone.baseline_rows, lone.current_rows, lone.ks, lone.psi, lone.level, lone.ks_p) == (1, 0, None, None, None, None)


def test_same_rows_do_not_drift(spark):
    rows = [("a", float(i % 9), "u", now, 0) for i in range(90) for now in (True, False)]
    got = shifts.numeric_shift(spark.createDataFrame(rows, SCHEMA), ["x", "n0"], "now").collect()
    assert {(r.feature, r.ks, r.psi, r.ks_p, r.level) for r in got} == {("x", 0, 0, 1, "stable"), ("n0", 0, 0, 1, "stable")}


def test_categorical(spark):
    rows = sample(300, 2, [1])
    got = {r.g: r for r in shifts.categorical_shift(spark.createDataFrame(rows, SCHEMA), ["c"], "now", ["g"]).collect()}
    for g in ("a", None):
        some = [r for r in rows if r[0] == g and r[3] is not None]
        names, want = {r[2] for r in some}, 0.0
        for c in names:
            for side in (False, True):
                o = sum(r[2] == c and r[3] is side for r in some)
                e = sum(r[2] == c for r in some) * sum(r[3] is side for r in some) / len(some)
                want += (o - e) ** 2 / e
        assert got[g].chi_square == pytest.approx(want) and got[g].freedom == len(names) - 1
    assert got["none now"].chi_square is None and got["none now"].p is None


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shifts.numeric_shift(empty, ["x"], "now", ["g"]).count() == 0 and shifts.categorical_shift(empty, ["c"], "now").count() == 0
    with pytest.raises(ValueError, match="missing"):
        shifts.numeric_shift(empty, ["lacking"], "now")


def chi_tail(x, k):
    """From the closed forms for 1 and 2 degrees, two degrees at a time."""
    q, at = (math.erfc(math.sqrt(x / 2)), 1) if k % 2 else (math.exp(-x / 2), 2)
    while at < k:
        q += math.exp(at / 2 * math.log(x / 2) - x / 2 - math.lgamma(at / 2 + 1))
        at += 2
    return q


def test_tails(spark):
    some = [(x, k) for k in (1, 2, 3, 7, 40, 501) for x in (0.01, 0.5, 1.0, k * 0.8, k + 0.1, k * 1.3, k + 30.0)]
    df = spark.createDataFrame([(float(x), float(k)) for x, k in some], "x double, k double")
    for r in df.select("x", "k", shifts.chi_square_tail(F.col("x"), F.col("k")).alias("q")).collect():
        assert r.q == pytest.approx(chi_tail(r.x, int(r.k)), rel=1e-6, abs=1e-12)
    both = lambda x: 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 200))
    tail = spark.createDataFrame([(x / 10,) for x in range(3, 30)], "x double")
    for r in tail.select("x", shifts.kolmogorov_tail(F.col("x")).alias("q")).collect():
        assert r.q == pytest.approx(both(r.x), rel=1e-6, abs=1e-9)
