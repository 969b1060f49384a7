"""Survival after a proportional hazards fit: baseline hazard, survival at given days, hazard ratios and concordance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.frames import known, require, running_totals


def _ratio(coefficients: dict[str, float]) -> Column:
    """A row's hazard relative to the baseline; null if a feature is."""
    return F.exp(sum((float(b) * F.col(f).cast("double") for f, b in coefficients.items()), F.lit(0.0)))


def hazard_ratios(coefficients: dict[str, float]) -> dict[str, float]:
    """By feature, what one unit more multiplies the hazard by."""
    return {f: math.exp(b) for f, b in coefficients.items()}


def baseline_hazard(df: DataFrame, time: str, event: str, coefficients: dict[str, float]) -> DataFrame:
    """time, events, hazard and cumulative hazard of the baseline at each time of an event (Breslow; equal times share their risk set).

    Rows without a time, an event or a feature are left out. Rows are summed up by time, then both the risk sets and the cumulative
    hazard are running totals over distinct times, in bins, so no task holds all times. Without events the result is empty.
    """
    require(df, [time, event, *coefficients])
    rows = df.select(F.col(time).cast("double").alias("time"), F.col(event).cast("double").alias("d"), _ratio(coefficients).alias("e"))
    rows = rows.where(known(F.col("time")) & known(F.col("d")) & known(F.col("e")))
    by = rows.groupBy("time").agg(F.sum("d").alias("events"), F.sum("e").alias("e"))
    hazards = running_totals(by, "time", ["e"]).where("events > 0").select("time", F.col("events").cast("long").alias("events"), (F.col("events") / F.col("e_upto")).alias("hazard"))
    later = F.col("hazard_total") - F.col("hazard_upto")
    return running_totals(hazards, "time", ["hazard"]).select("time", "events", "hazard", (later + F.col("hazard")).alias("cumulative"))


def survival(df: DataFrame, baseline: DataFrame, coefficients: dict[str, float], days: list[float]) -> DataFrame:
    """``df`` with ``survival_{day}`` for each of ``days``: the probability of no event up to that day, its end included. Null for rows
    without a feature. One aggregate of as many numbers as there are days joins all rows."""
    require(df, list(coefficients))
    upto = baseline.agg(*(F.coalesce(F.sum(F.when(F.col("time") <= d, F.col("hazard"))), F.lit(0.0)).alias(f"_h{i}") for i, d in enumerate(days)))
    at = {f"survival_{d:g}": F.exp(-F.col(f"_h{i}") * _ratio(coefficients)) for i, d in enumerate(days)}
    return df.crossJoin(F.broadcast(upto)).withColumns(at).drop(*(f"_h{i}" for i in range(len(days))))


def concordance(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """comparable, concordant and tied pairs, and Harrell's concordance (null without comparable pairs), in one row.

    A pair is comparable if one row has its event before the other's time, or at that time if the other is censored; it is concordant if
    the earlier one has the higher risk, and tied risks count half. Rows lacking a value are left out. Pairs are counted, not formed: two places in
    the order of times part at one bit of their numbers, so each row enters a group for each bit, in which running totals by risk
    count the later rows of lower risk. That makes the logarithm of the distinct times as many rows, whatever the pairs.
    """
    require(df, [time, event, risk])
    rows = df.select(F.col(time).cast("double").alias("t"), (F.col(event).cast("double") > 0).alias("d"), F.col(risk).cast("double").alias("r"))
    cells = rows.where(known(F.col("t")) & F.col("d").isNotNull() & known(F.col("r"))).groupBy("t", "d", "r").agg(F.count("*").alias("n"))
    times = running_totals(cells.select("t", F.lit(1).cast("long").alias("one")).distinct(), "t", ["one"])
    times = times.select("t", (F.col("one_total") - F.col("one_upto")).alias("place"), F.col("one_total").alias("of"))
    # Events come before the censored rows of their time, and share their place with each other.
    placed = cells.join(times, "t").withColumn("at", 2 * F.col("place") + (~F.col("d")).cast("int"))
    bits = F.sequence(F.lit(0), F.ceil(F.log2(2 * F.col("of"))).cast("int"))
    by_bit = placed.select("d", "r", "n", "at", F.explode(bits).alias("bit"))
    later = F.expr("shiftright(at, bit) & 1") == 1
    sums = by_bit.groupBy("bit", F.expr("shiftright(at, bit + 1)").alias("group"), "r").agg(
        F.coalesce(F.sum(F.when(~later & F.col("d"), F.col("n"))), F.lit(0)).alias("first"), F.coalesce(F.sum(F.when(later, F.col("n"))), F.lit(0)).alias("second")
    )
    run = running_totals(sums, "r", ["second"], by=["bit", "group"])
    big = lambda c: c.cast("decimal(38,0)")
    pairs = lambda c: F.coalesce(F.sum(big(F.col("first") * c)), F.lit(0)).cast("long")
    out = run.agg(pairs(F.col("second_total")).alias("comparable"), pairs(F.col("second_total") - F.col("second_upto")).alias("concordant"), pairs(F.col("second")).alias("tied"))
    c = (F.col("concordant") + F.col("tied") / 2) / F.nullif(F.col("comparable"), F.lit(0))
    return out.withColumn("concordance", c)
