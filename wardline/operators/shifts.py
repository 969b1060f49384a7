"""Statistical tests of drift between a baseline and current rows: Kolmogorov-Smirnov, population stability, chi-square."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.frames import known, null_safe, require, running_totals

#: Population stability indexes from which a shift is called moderate and major.
MODERATE, MAJOR = 0.1, 0.25


def _cells(df: DataFrame, features: list[str], current: str, by: list[str], kind: str) -> DataFrame:
    """Rows of the baseline (n0) and of now (n1) by group, feature and value; rows whose ``current`` is null are left out."""
    require(df, [*features, current, *by])
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("value")) for f in features))).alias("_f")
    rows = df.where(F.col(current).isNotNull()).select(*by, F.col(current).cast("boolean").alias("_now"), each).select(*by, "_now", "_f.feature", "_f.value")
    if kind == "double":
        rows = rows.where(known(F.col("value")))
    return rows.groupBy(*by, "feature", "value").agg(F.count_if(~F.col("_now")).alias("n0"), F.count_if("_now").alias("n1"))


def kolmogorov_tail(x: Column) -> Column:
    """The probability that Kolmogorov's distribution exceeds ``x``, by the series that converges fast on either side of 1."""
    small = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / x * sum((F.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 6)), F.lit(0.0))
    large = 2 * sum(((-1.0) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 6)), F.lit(0.0))
    return F.when(x <= 0, 1.0).when(x < 1, small).otherwise(large)


def _log_gamma(a: Column) -> Column:
    """Stirling's series at a + 10, brought back by ten factors."""
    z = a + 10
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - sum((F.log(a + i) for i in range(10)), F.lit(0.0))


def chi_square_tail(x: Column, freedom: Column, terms: int = 400) -> Column:
    """The probability that chi-square with ``freedom`` degrees exceeds ``x``: the incomplete gamma function, by its series below the
    mean and by its continued fraction above. ``terms`` suffice to some 10,000 degrees."""
    a, h = freedom / 2, x / 2
    front = F.exp(a * F.log(h) - h - _log_gamma(a))
    step = lambda s, k: F.struct((s.t * h / (a + k)).alias("t"), (s.total + s.t * h / (a + k)).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct((1 / a).alias("t"), (1 / a).alias("total")), step, lambda s: s.total)
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, k: k * (a - k) / (h + 2 * k + 1 - a + f))
    return F.when(x <= 0, 1.0).when(h < a + 1, F.lit(1.0) - front * series).otherwise(front / (h + 1 - a + fraction))


def numeric_shift(df: DataFrame, features: list[str], current: str, by: list[str] = (), bins: int = 10, least: float = 1e-4) -> DataFrame:
    """By group and feature: rows of the baseline (``current`` false) and of now, the two-sample Kolmogorov-Smirnov statistic ``ks`` with
    its asymptotic ``ks_p``, the population stability index ``psi`` and its ``level`` (stable, moderate or major).

    ``psi`` compares shares in ``bins`` cut at the baseline's quantiles (the least value that so many rows are at or under; a value equal
    to a cut is under it; equal cuts are one); a share counts as ``least`` at least. Rows lacking the value (null or NaN)
    or ``current`` are left out; null is a group. Without rows on one side the statistics and the level are null.

    Rows are summed up by value; both statistics are read off the same running totals over distinct values, in bins, as the rows
    of the baseline below a value give its quantile bin. So neither cuts nor values are gathered, and nothing is joined by range.
    """
    by = list(by)
    run = running_totals(_cells(df, features, current, by, "double"), "value", ["n0", "n1"], by=[*by, "feature"])
    below = lambda i: F.col(f"n{i}_total") - F.col(f"n{i}_upto")
    whole = lambda i: F.nullif(F.col(f"n{i}_total"), F.lit(0))
    apart = F.abs(below(0) / whole(0) - below(1) / whole(1))
    binned = run.withColumn("_bin", F.least(F.floor(below(0) * bins / whole(0)), F.lit(bins - 1)))
    sums = binned.groupBy(*by, "feature", "_bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max(apart).alias("ks"), F.max(whole(0)).alias("t0"), F.max(whole(1)).alias("t1"))
    was, now = (F.greatest(F.col(f"n{i}") / F.col(f"t{i}"), F.when(F.col("t0").isNotNull() & F.col("t1").isNotNull(), F.lit(least))) for i in (0, 1))
    psi = F.sum(F.when(F.col("t0").isNotNull() & F.col("t1").isNotNull(), (now - was) * F.log(now / was)))
    out = sums.groupBy(*by, "feature").agg(F.sum("n0").alias("baseline_rows"), F.sum("n1").alias("current_rows"), F.max("ks").alias("ks"), psi.alias("psi"))
    size = F.col("baseline_rows") * F.col("current_rows").cast("double") / (F.col("baseline_rows") + F.col("current_rows"))
    level = F.when(F.col("psi") >= MAJOR, "major").when(F.col("psi") >= MODERATE, "moderate").when(F.col("psi").isNotNull(), "stable")
    return out.withColumns({"ks_p": F.when(F.col("ks").isNotNull(), kolmogorov_tail(F.sqrt(size) * F.col("ks"))), "level": level})


def categorical_shift(df: DataFrame, features: list[str], current: str, by: list[str] = ()) -> DataFrame:
    """By group and feature: rows of the baseline and of now, categories (null is one), the chi-square statistic that both have the same
    shares, its degrees of ``freedom`` and ``p``. The statistic is null without rows on one side, and ``p`` is 1 with a single category."""
    by = list(by)
    cells = _cells(df, features, current, by, "string")
    totals = cells.groupBy(*by, "feature").agg(F.sum("n0").cast("double").alias("t0"), F.sum("n1").cast("double").alias("t1")).withColumnsRenamed({k: f"_k_{k}" for k in [*by, "feature"]})
    cell = (F.col("n0") * F.col("t1") - F.col("n1") * F.col("t0")) ** 2 / (F.nullif(F.col("t0") * F.col("t1"), F.lit(0.0)) * (F.col("n0") + F.col("n1")))
    out = cells.join(totals, null_safe([*by, "feature"])).groupBy(*by, "feature").agg(
        F.sum("n0").alias("baseline_rows"), F.sum("n1").alias("current_rows"), F.count("*").alias("categories"), F.sum(cell).alias("chi_square")
    )
    freedom = F.col("categories") - 1
    p = F.when(F.col("chi_square").isNull(), None).when(freedom == 0, 1.0).otherwise(chi_square_tail(F.col("chi_square"), F.nullif(freedom, F.lit(0)).cast("double")))
    return out.withColumn("freedom", freedom).withColumn("p", p)
