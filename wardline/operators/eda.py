"""Exploration of a cohort: descriptions, shares, cross tables, bins, correlations, odds, months."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.frames import exact_quantiles

AGE_BINS = (18, 35, 50, 65, 80, 100)
AGE_NAMES = ("18-34", "35-49", "50-64", "65-79", "80+")
STAY_BINS = (0, 3, 7, 14, 30)
STAY_NAMES = ("0-3 days", "4-7 days", "8-14 days", "15-30 days")


def binned(x: Column, edges=AGE_BINS, names=AGE_NAMES) -> Column:
    """Bins closed on the right; the lowest edge is in none."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges, edges[1:], names))):
        out = F.when((x > low) & (x <= high), name).otherwise(out)
    return out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max by column."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], ["column"])
    made = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    return made.join(q, "column", "left").select("column", "n", "mean", "std", "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "high")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and percent of each value, nulls left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(column, "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Shares of ``values`` of one column within each value of another, 0 for absent pairs."""
    counts = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).agg(F.count("*").alias("_all"), *(F.count_if(F.col(column) == v).alias(f"_{i}") for i, v in enumerate(values)))
    return counts.select(row, *((F.col(f"_{i}") / F.col("_all")).alias(str(v)) for i, v in enumerate(values)))


def outcome_rates(df: DataFrame, by: str | Column, outcomes: list[str]) -> DataFrame:
    """Percent of each 0/1 outcome by group."""
    key = F.col(by).alias(by) if isinstance(by, str) else by
    return df.groupBy(key).agg(F.count("*").alias("n"), *((F.avg(o) * 100).alias(o) for o in outcomes))


def group_stats(df: DataFrame, by: str, prediction: str, threshold: float = 0.5) -> DataFrame:
    """Mean prediction, positive rate (to 3 places) and size by group, and the largest difference of positive rates."""
    rows = df.groupBy(by).agg(F.avg(prediction).alias("_m"), F.avg((F.col(prediction) >= threshold).cast("double")).alias("_r"), F.count("*").alias("n"))
    spread = rows.agg((F.max("_r") - F.min("_r")).alias("_d"))
    return rows.crossJoin(F.broadcast(spread)).select(by, F.bround("_m", 3).alias("mean_prediction"), F.bround("_r", 3).alias("positive_rate"), "n", F.bround("_d", 3).alias("disparity"))


def melted(df: DataFrame, keys: list[str], values: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Wide to long: outcome and rate, with other names for the outcomes."""
    long = df.unpivot(keys, values, "outcome", "rate")
    return long.replace(names, subset=["outcome"]) if names else long


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of every two columns over the rows that have both, in one aggregation."""
    pairs = list(combinations(columns, 2))
    made = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return made.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))


def odds_ratio(df: DataFrame, outcome: str, factors: dict[str, Column]) -> DataFrame:
    """The odds of the outcome with each factor over those without; null where a count is 0."""
    parts = []
    for i, test in enumerate(factors.values()):
        has, yes = F.coalesce(test, F.lit(False)), F.col(outcome) == 1
        parts += [F.count_if(has & yes).alias(f"a{i}"), F.count_if(has & ~yes).alias(f"b{i}"), F.count_if(~has & yes).alias(f"c{i}"), F.count_if(~has & ~yes).alias(f"d{i}")]
    d = lambda n: F.col(n).cast("double")
    rows = [F.struct(F.lit(name).alias("factor"), F.try_divide(F.try_divide(d(f"a{i}"), d(f"b{i}")), F.try_divide(d(f"c{i}"), d(f"d{i}"))).alias("odds_ratio")) for i, name in enumerate(factors)]
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def monthly(df: DataFrame, time: str, outcomes: list[str]) -> DataFrame:
    month = F.date_format(time, "yyyy-MM").alias("month")
    return df.groupBy(month).agg(F.count("*").alias("n"), *(F.sum(o).alias(f"{o}_count") for o in outcomes), *((F.avg(o) * 100).alias(f"{o}_percent") for o in outcomes))


def risk_factors(age: str = "age", comorbidity: str = "comorbidity_count", stay: str = "length_of_stay", hba1c: str = "hba1c", pressure: str = "systolic_bp") -> dict[str, Column]:
    """Risk factors as conditions on a cohort's columns."""
    return {"elderly": F.col(age) > 75, "multimorbid": F.col(comorbidity) >= 3, "long_stay": F.col(stay) > 7, "poor_control": F.col(hba1c) >= 6.5, "hypertensive": F.col(pressure) >= 140}


def with_flags(df: DataFrame, factors: dict[str, Column]) -> DataFrame:
    return df.withColumns({n: F.coalesce(t, F.lit(False)).cast("int") for n, t in factors.items()})


def top_values(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The ``n`` largest rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
