"""Clinical quality metrics over encounters: stay, readmission, observed and expected outcomes.

Each takes ``by``, a list of grouping columns (none: one row over all), and makes one aggregation; readmissions need a window
by patient first, which is the only other shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.frames import days_between, exact_quantiles, null_safe, require


@dataclass(frozen=True)
class Encounters:
    """Names of an encounter table's columns."""

    patient: str = "patient_id"
    encounter: str = "encounter_id"
    admission: str = "admission_date"
    discharge: str = "discharge_date"
    mortality: str = "mortality"
    expected: str = "expected"
    readmission: str = "readmission"
    expected_readmission: str = "expected_readmission"
    expected_los: str = "expected_los"
    complication: str = "complication"


C = Encounters()


def with_los(df: DataFrame, c: Encounters = C) -> DataFrame:
    """Adds ``los``, the stay in fractional days."""
    return require(df, [c.admission, c.discharge]).withColumn("los", days_between(c.admission, c.discharge))


def with_gaps(df: DataFrame, by: list[str] = (), c: Encounters = C) -> DataFrame:
    """Adds ``next_gap`` and ``previous_gap``: days from a discharge to the patient's next admission and, on the later encounter,
    from the previous discharge. Patients are followed within ``by``."""
    require(df, [c.patient, c.admission, c.discharge])
    order = [c.admission] + ([c.encounter] if c.encounter in df.columns else [])
    w = Window.partitionBy(*by, c.patient).orderBy(*order)
    return df.withColumn("next_gap", days_between(F.col(c.discharge), F.lead(c.admission).over(w))).withColumn("previous_gap", days_between(F.lag(c.discharge).over(w), F.col(c.admission)))


def within(gap: str, days: float) -> Column:
    return F.coalesce((F.col(gap) >= 0) & (F.col(gap) <= days), F.lit(False))


def readmission_rate(df: DataFrame, days: int = 30, by: list[str] = (), condition: tuple[str, object] | None = None, c: Encounters = C) -> DataFrame:
    """Readmissions, discharges that count (all but a patient's last; one for a single encounter) and their rate."""
    if condition and condition[0] and condition[1]:
        df = require(df, [condition[0]]).where(F.col(condition[0]) == F.lit(condition[1]))
    gaps = with_gaps(df.where(F.col(c.patient).isNotNull()), by, c)
    each = gaps.groupBy(*by, c.patient).agg(F.count("*").alias("n"), F.count_if(within("next_gap", days)).alias("back"))
    all_ = each.groupBy(*by).agg(F.sum("back").alias("readmissions"), F.sum(F.greatest(F.col("n") - 1, F.lit(1))).alias("discharges"))
    return all_.withColumn("rate", F.try_divide(F.col("readmissions").cast("double"), F.col("discharges").cast("double")))


def with_readmission_flag(df: DataFrame, days: int = 30, c: Encounters = C) -> DataFrame:
    """Adds the readmission column: 1 on an encounter that follows a discharge by at most ``days``."""
    return with_gaps(df, (), c).withColumn(c.readmission, within("previous_gap", days).cast("int")).drop("next_gap", "previous_gap")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def mortality_index(df: DataFrame, by: list[str] = (), c: Encounters = C) -> DataFrame:
    """Mean observed over mean expected mortality, null where nothing is expected."""
    return require(df, [c.mortality, c.expected]).groupBy(*by).agg(_ratio(F.avg(c.mortality), F.avg(c.expected)).alias("mortality_index"))


def los_index(df: DataFrame, by: list[str] = (), c: Encounters = C) -> DataFrame:
    return with_los(require(df, [c.expected_los]), c).groupBy(*by).agg(_ratio(F.avg("los"), F.avg(c.expected_los)).alias("los_index"))


def complication_rate(df: DataFrame, kind: str | None = None, by: list[str] = (), c: Encounters = C) -> DataFrame:
    """The share of a text column equal to ``kind``, or the mean of a numeric one."""
    x = F.col(c.complication)
    text = dict(require(df, [c.complication]).dtypes)[c.complication] == "string"
    value = (x == F.lit(kind)).cast("double") if text else x
    return df.groupBy(*by).agg(F.avg(F.coalesce(value, F.lit(0.0)) if text else value).alias("complication_rate"))


def standardized_mortality(df: DataFrame, by: list[str] = (), c: Encounters = C) -> DataFrame:
    """Observed, expected, their ratio and a 95 % interval; with nothing observed it runs from 0 to 3.69 / expected."""
    sums = require(df, [c.mortality, c.expected]).groupBy(*by).agg(F.sum(c.mortality).cast("double").alias("observed"), F.sum(c.expected).cast("double").alias("expected_sum"))
    o, e = F.col("observed"), F.col("expected_sum")
    half = F.when(o > 0, 1.96 * F.sqrt(1 / o))
    smr = _ratio(o, e)
    return sums.select(*by, "observed", "expected_sum", smr.alias("smr"), F.when(e > 0, F.when(o == 0, F.lit(0.0)).otherwise(smr * F.exp(-half))).alias("lower"), F.when(e > 0, F.when(o == 0, 3.69 / e).otherwise(smr * F.exp(half))).alias("upper"))


def risk_adjusted_readmission(df: DataFrame, by: list[str] = (), days: int = 30, c: Encounters = C) -> DataFrame:
    """Observed over expected readmissions. If any group expects none, all results are null."""
    if c.readmission not in df.columns:
        df = with_readmission_flag(df, days, c)
    sums = df.groupBy(*by).agg(F.sum(c.readmission).cast("double").alias("observed"), F.sum(c.expected_readmission).cast("double").alias("expected_sum"))
    if not by:
        return sums.withColumn("ratio", _ratio(F.col("observed"), F.col("expected_sum")))
    bad = sums.agg(F.coalesce(F.bool_or(~F.coalesce(F.col("expected_sum") > 0, F.lit(False))), F.lit(False)).alias("bad"))
    return sums.crossJoin(F.broadcast(bad)).withColumn("ratio", F.when(~F.col("bad"), F.col("observed") / F.col("expected_sum"))).drop("bad")


def observed_expected(df: DataFrame, observed: str, expected: str, by: list[str] = ()) -> DataFrame:
    return require(df, [observed, expected]).groupBy(*by).agg(_ratio(F.avg(observed), F.avg(expected)).alias("oe_ratio"))


def risk_adjusted_rate(df: DataFrame, observed: str, expected: str, reference: float | None = None, by: list[str] = ()) -> DataFrame:
    """The observed-to-expected ratio times a reference rate, the mean over all rows if none is given."""
    ratio = observed_expected(df, observed, expected, by)
    if reference is not None:
        return ratio.withColumn("adjusted_rate", F.col("oe_ratio") * reference)
    return ratio.crossJoin(F.broadcast(df.agg(F.avg(observed).alias("_mean")))).withColumn("adjusted_rate", F.col("oe_ratio") * F.col("_mean")).drop("_mean")


def excess_events(df: DataFrame, observed: str, expected: str, by: list[str] = ()) -> DataFrame:
    return require(df, [observed, expected]).groupBy(*by).agg((F.sum(observed) - F.sum(expected)).cast("double").alias("excess"))


def quality_metrics(df: DataFrame, by: list[str] = (), least: int = 1, c: Encounters = C) -> DataFrame:
    """All metrics that the columns allow, in one aggregation over an enriched frame. Groups of fewer than ``least``
    encounters are left out; readmissions are followed within a group."""
    rows = with_gaps(with_los(df, c), by, c).withColumn("_one", F.row_number().over(Window.partitionBy(*by, c.patient).orderBy(c.admission)))
    rows = rows.withColumn("_last", F.col("next_gap").isNull())
    counted = F.sum(F.when(F.col("_last") & (F.col("_one") > 1), 0).otherwise(1))
    parts = [F.count("*").alias("n"), F.avg("los").alias("mean_los"), F.stddev_samp("los").alias("std_los")]
    for days in (30, 7):
        parts.append(F.try_divide(F.count_if(within("next_gap", days)).cast("double"), counted.cast("double")).alias(f"readmission_rate_{days}d"))
    if c.expected_los in df.columns:
        parts.append(_ratio(F.avg("los"), F.avg(c.expected_los)).alias("los_index"))
    if c.mortality in df.columns:
        parts.append(F.avg(c.mortality).alias("mortality_rate"))
        if c.expected in df.columns:
            parts += [_ratio(F.avg(c.mortality), F.avg(c.expected)).alias("mortality_index"), _ratio(F.sum(c.mortality).cast("double"), F.sum(c.expected).cast("double")).alias("smr")]
    if c.complication in df.columns and dict(df.dtypes)[c.complication] != "string":
        parts.append(F.avg(c.complication).alias("complication_rate"))
    made = rows.groupBy(*by).agg(*parts).where(F.col("n") >= least)
    medians = exact_quantiles(rows, "los", [0.5], by).select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("q")[0].alias("median_los"))
    return made.join(medians, null_safe(by), "left").drop(*(f"_k_{k}" for k in by))
