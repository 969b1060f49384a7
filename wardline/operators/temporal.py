"""Features of irregular time series by patient: windows that end at a reference time, trends, gaps, filling, spectra.

Windows don't join or explode rows: all windows and all aggregates are conditional aggregates of one shuffle by patient.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.frames import days_between, known, require
from wardline.functions.student import two_sided_p

WINDOWS = (1, 3, 7, 14, 30)
AGGREGATES = ("mean", "min", "max", "median", "std", "var", "count", "sum", "range", "iqr", "slope")


def with_reference(df: DataFrame, keys: list[str], time: str, reference: str | None = None) -> DataFrame:
    """Adds ``ref``: the given reference time, or the last time of the patient."""
    require(df, [*keys, time, reference])
    rows = df.where(F.col(keys[0]).isNotNull())
    return rows.withColumn("ref", F.col(reference)) if reference else rows.withColumn("ref", F.max(time).over(Window.partitionBy(*keys)))


def at_references(df: DataFrame, references: DataFrame, keys: list[str], time: str, longest: int = max(WINDOWS)) -> DataFrame:
    """Rows of each patient in the longest window before each of their reference times: an interval join on the patient."""
    r = references.select(*keys, F.col("reference_time").alias("ref")).distinct()
    return df.join(r, keys).where((F.col(time) <= F.col("ref")) & (F.col(time) >= F.col("ref") - F.make_dt_interval(F.lit(longest))))


def _inside(time: str, days: int) -> Column:
    return F.col(time).between(F.col("ref") - F.make_dt_interval(F.lit(days)), F.col("ref"))


def _aggregate(name: str, v: Column, place: Column, rows: Column) -> Column:
    """One aggregate of the values ``v`` inside a window; null for a window without rows, counts included."""
    quantile = lambda q: F.percentile(v, q)
    made = {
        "mean": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v), "median": lambda: F.median(v), "std": lambda: F.stddev_samp(v),
        "var": lambda: F.var_samp(v), "count": lambda: F.when(rows > 0, F.count(v)), "sum": lambda: F.when(rows > 0, F.coalesce(F.sum(v), F.lit(0.0))),
        "range": lambda: F.max(v) - F.min(v), "iqr": lambda: quantile(0.75) - quantile(0.25),
        "slope": lambda: F.when(rows > 0, F.when(F.count(v) < 2, 0.0).otherwise(F.regr_slope(v, place))),
    }
    if name not in made:
        raise ValueError(f"unknown aggregate {name!r}; there are {', '.join(AGGREGATES)}")
    return made[name]()


def window_features(df: DataFrame, keys: list[str], time: str, value: str, windows=WINDOWS, aggregates=AGGREGATES, trend: bool = False, reference: str | None = None, p_values: bool = False) -> DataFrame:
    """One row for each patient (and reference time, if given), with ``{value}_{w}d_{aggregate}`` for every window.

    A window holds the rows from w days before the reference time up to it, both ends included. With ``trend``, the
    slope by days replaces the one by position (then ``_slope_idx``) where a window has three rows or more.
    """
    rows = with_reference(df, keys, time, reference) if "ref" not in df.columns else df
    by = [*keys, "ref"]
    value_ = F.when(known(F.col(value)), F.col(value))
    order = Window.partitionBy(*by).orderBy(time)
    rows = rows.select(*by, time, value_.alias(value), F.row_number().over(order).cast("double").alias("_place"))
    out, after = [], []
    for w in windows:
        inside, name = _inside(time, w), f"{value}_{w}d"
        v, n = F.when(inside, F.col(value)), F.count_if(inside)
        for a in aggregates:
            out.append(_aggregate(a, v, F.when(inside, F.col("_place")), n).alias(f"{name}_{a}"))
        if trend:
            t, age = F.when(inside, F.col(time)), F.when(inside, -days_between(F.col(time), F.col("ref")))
            whole = (n >= 3) & (F.count(v) == n)
            out.append(F.when(n >= 2, days_between(F.min(t), F.max("ref"))).alias(f"{name}_time_since_first"))
            out.append(F.when(n >= 2, days_between(F.max(t), F.max("ref"))).alias(f"{name}_time_since_last"))
            flat = F.var_pop(age) == 0
            out.append(F.when(n >= 3, F.when(whole & ~flat, F.regr_slope(v, age))).alias(f"{name}_trend"))
            out.append(F.when(whole & ~flat, F.when(F.var_pop(v) == 0, 0.0).otherwise(F.pow(F.corr(v, age), 2))).alias(f"{name}_r_squared"))
            out.append(n.alias(f"{name}_rows"))
            after.append(name)
    made = rows.groupBy(*by).agg(*out)
    for name in after:
        if f"{name}_slope" in made.columns:
            made = made.withColumn(f"{name}_slope_idx", F.col(f"{name}_slope")).withColumn(f"{name}_slope", F.when(F.col(f"{name}_rows") >= 3, F.col(f"{name}_trend")).otherwise(F.col(f"{name}_slope")))
        else:
            made = made.withColumn(f"{name}_slope", F.col(f"{name}_trend"))
        if p_values:
            made = made.withColumn(f"{name}_p_value", _p_value(F.col(f"{name}_r_squared"), F.col(f"{name}_rows")))
    return made.drop(*(f"{n}_{x}" for n in after for x in ("rows", "trend")))


def _p_value(r_squared: Column, n: Column) -> Column:
    """The two-sided p-value of a slope; Spark has no distribution of Student's t."""

    @F.pandas_udf("double")
    def p_value(r_squared: pd.Series, n: pd.Series) -> pd.Series:
        r2, df = r_squared.to_numpy(float), np.maximum(n.to_numpy(float) - 2, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = two_sided_p(np.sqrt(np.clip(r2, 0, 1) * df / np.maximum(1 - r2, 0)), df)
        return pd.Series(p).where(~np.isnan(r2), None)

    return p_value(r_squared, n)


def multivariate(df: DataFrame, keys: list[str], time: str, variable: str, value: str, variables: list[str], windows=WINDOWS, aggregates=("mean",)) -> DataFrame:
    """Window features of several variables side by side, in one aggregation, each up to the last
    time that the patient has the variable; a patient without a variable has nulls."""
    rows = with_reference(df, [*keys, variable], time)
    out = []
    for name, w in itertools.product(variables, windows):
        inside = _inside(time, w) & (F.col(variable) == name)
        for a in aggregates:
            out.append(_aggregate(a, F.when(inside, F.col(value)), F.lit(None).cast("double"), F.count_if(inside)).alias(f"{name}_{w}d_{a}"))
    return rows.groupBy(*keys).agg(*out)


def event_features(df: DataFrame, keys: list[str], time: str, windows=WINDOWS, reference: str | None = None) -> DataFrame:
    """Counts of events by window, days since the last, and mean, sd (population), least and most days between events."""
    rows = with_reference(df, keys, time, reference)
    by = [*keys, "ref"]
    gap = days_between(F.lag(time).over(Window.partitionBy(*by).orderBy(time)), F.col(time))
    rows = rows.withColumn("gap", gap).withColumn("_before", F.lag(time).over(Window.partitionBy(*by).orderBy(time)))
    out = [days_between(F.max(F.when(F.col(time) <= F.col("ref"), F.col(time))), F.max("ref")).alias("days_since_last_event")]
    for w in windows:
        inside = _inside(time, w)
        g = F.when(inside & F.col("_before").between(F.col("ref") - F.make_dt_interval(F.lit(w)), F.col("ref")), F.col("gap"))
        out.append(F.count_if(inside).alias(f"event_count_{w}d"))
        out += [f(g).alias(f"{n}_days_between_events_{w}d") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*by).agg(*out)


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def interpolate(df: DataFrame, keys: list[str], time: str, order: list[str], value: str) -> DataFrame:
    """Missing values linear in time between their neighbours; before the first they stay missing, after the last it holds."""
    back = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(time))
    v0, t0 = F.last(value, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(back)
    v1, t1 = F.first(value, ignorenulls=True).over(ahead), F.first(at, ignorenulls=True).over(ahead)
    rows = df.withColumn("_v0", v0).withColumn("_t0", t0).withColumn("_v1", v1).withColumn("_t1", t1)
    share = F.try_divide(days_between("_t0", time), days_between("_t0", "_t1"))
    made = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_v0").isNull(), F.lit(None)).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.coalesce(share, F.lit(0.0)))
    return rows.withColumn(value, made).drop("_v0", "_t0", "_v1", "_t1")


def rolling(df: DataFrame, keys: list[str], time: str, value: str, days: int, aggregates=("mean", "count")) -> DataFrame:
    """The same windows anchored at every row: a trailing range of ``days``, both ends included."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-days * 86_400_000_000, 0)
    made = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count, "sum": F.sum}
    return df.withColumns({f"{value}_rolling_{days}d_{a}": made[a](value).over(w) for a in aggregates})


def daily(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Means by calendar day from a patient's first day to the last; days without values are linear in between."""
    day = df.withColumn("day", F.col(time).cast("date")).groupBy(*keys, "day").agg(F.avg(value).alias(value))
    span = day.groupBy(*keys).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    rows = span.join(day, [*keys, "day"], "left").withColumn("_t", F.col("day").cast("timestamp_ntz"))
    return interpolate(rows, keys, "_t", ["day"], value).drop("_t")


def autocorrelation(df: DataFrame, keys: list[str], order: str, value: str, lags=(1, 2, 3, 7)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({f"_{k}": F.lag(value, k).over(w) for k in lags})
    return rows.groupBy(*keys).agg(*(F.corr(value, f"_{k}").alias(f"autocorr_lag_{k}") for k in lags))


def _welch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Power density by day of a series: Hann windows of at most 10 days, half overlapping, means removed."""
    n = min(len(x), 10)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[:: max(1, n - n // 2)]
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2 / np.square(taper).sum()
    power[:, 1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n), power.mean(axis=0)


def spectra(df: DataFrame, keys: list[str], time: str, value: str, days: int = max(WINDOWS)) -> DataFrame:
    """Autocorrelations, spectral entropy and the strongest frequency of the daily series in the last ``days``; null for fewer
    than five rows or days. A group is one patient's series of at most ``days`` daily values."""
    last = with_reference(df.where(known(F.col(value))), keys, time)
    recent = last.where(_inside(time, days))
    counted = recent.withColumn("_rows", F.count("*").over(Window.partitionBy(*keys))).where("_rows >= 5")
    series = daily(counted, keys, time, value)
    lagged = autocorrelation(series, keys, "day", value)
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", spectral_entropy double, dominant_frequency double, dominant_power double"

    def spectrum(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("day")[value].to_numpy(float)
        row = {k: part[k].iloc[0] for k in keys} | {"spectral_entropy": None, "dominant_frequency": None, "dominant_power": None}
        if len(x) >= 5:
            f, p = _welch(x)
            share = p / p.sum() if p.sum() > 0 else np.zeros_like(p)
            row |= {"spectral_entropy": float(-(share * np.log2(share + 1e-10)).sum()), "dominant_frequency": float(f[p.argmax()]), "dominant_power": float(p.max())}
        return pd.DataFrame([row])

    return series.groupBy(*keys).applyInPandas(spectrum, schema).join(lagged, keys)
