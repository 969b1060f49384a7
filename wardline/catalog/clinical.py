"""Queries of the quality metrics over encounters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.frames import Catalog
from wardline.operators import healthcare as H
from wardline.plans.cohort import ENCOUNTERS_SQL, encounters

CATALOG = Catalog()
add = CATALOG.add


def rounded(df, *columns, at=6):
    return df.withColumns({c: F.round(c, at) for c in columns})


def _readmission_sql(days, by="segment", where=""):
    return f"""WITH {ENCOUNTERS_SQL}, g AS (SELECT *, date_diff('microsecond', discharge_date, lead(admission_date) OVER (PARTITION BY {by}, patient_id ORDER BY admission_date, encounter_id)) / CAST(86400000000 AS DOUBLE) AS gap FROM enc {where}),
    p AS (SELECT {by}, patient_id, count(*) AS n, count(*) FILTER (WHERE gap >= 0 AND gap <= {days}) AS b FROM g GROUP BY ALL)
    SELECT {by}, CAST(sum(b) AS BIGINT) AS readmissions, CAST(sum(greatest(n - 1, 1)) AS BIGINT) AS discharges, round(CAST(sum(b) AS DOUBLE) / CAST(sum(greatest(n - 1, 1)) AS DOUBLE), 6) AS rate FROM p GROUP BY {by}"""


@add(_readmission_sql(30))
def readmission_30d_by_segment(spark, sf):
    return rounded(H.readmission_rate(encounters(spark, sf), 30, ["segment"]), "rate")


@add(_readmission_sql(7, "region"))
def readmission_7d_by_region(spark, sf):
    return rounded(H.readmission_rate(encounters(spark, sf), 7, ["region"]), "rate")


@add(_readmission_sql(30, "nation", "WHERE segment = 'BUILDING'"))
def readmission_30d_one_condition(spark, sf):
    return rounded(H.readmission_rate(encounters(spark, sf), 30, ["nation"], ("segment", "BUILDING")), "rate")


_LOS = "date_diff('microsecond', admission_date, discharge_date) / CAST(86400000000 AS DOUBLE)"


@add(f"WITH {ENCOUNTERS_SQL} SELECT segment, count(*) AS n, round(avg({_LOS}), 6) AS mean_los, median({_LOS}) AS median_los, round(stddev_samp({_LOS}), 6) AS std_los, max({_LOS}) AS max_los FROM enc GROUP BY segment")
def los_by_segment(spark, sf):
    rows = H.with_los(encounters(spark, sf))
    return rounded(rows.groupBy("segment").agg(F.count("*").alias("n"), F.avg("los").alias("mean_los"), F.median("los").alias("median_los"), F.stddev_samp("los").alias("std_los"), F.max("los").alias("max_los")), "mean_los", "std_los")


@add(f"""WITH {ENCOUNTERS_SQL}, s AS (SELECT region, CAST(sum(mortality) AS DOUBLE) AS o, sum(expected) AS e FROM enc GROUP BY region)
    SELECT region, o AS observed, round(e, 6) AS expected_sum, round(o / e, 6) AS smr, round(o / e * exp(-1.96 * sqrt(1 / o)), 6) AS lower, round(o / e * exp(1.96 * sqrt(1 / o)), 6) AS upper FROM s""")
def smr_by_region(spark, sf):
    return rounded(H.standardized_mortality(encounters(spark, sf), ["region"]), "expected_sum", "smr", "lower", "upper")


@add(f"WITH {ENCOUNTERS_SQL} SELECT round(avg(mortality) / avg(expected), 6) AS mortality_index FROM enc")
def mortality_index(spark, sf):
    return rounded(H.mortality_index(encounters(spark, sf)), "mortality_index")


@add(f"WITH {ENCOUNTERS_SQL} SELECT segment, round(avg({_LOS}) / avg(expected_los), 6) AS los_index FROM enc GROUP BY segment")
def los_index_by_segment(spark, sf):
    return rounded(H.los_index(encounters(spark, sf), ["segment"]), "los_index")


@add(f"WITH {ENCOUNTERS_SQL} SELECT region, round(avg(complication), 6) AS complication_rate FROM enc GROUP BY region")
def complication_rate(spark, sf):
    return rounded(H.complication_rate(encounters(spark, sf), by=["region"]), "complication_rate")


@add(f"WITH {ENCOUNTERS_SQL} SELECT segment, round(avg(CAST(region = 'ASIA' AS DOUBLE)), 6) AS complication_rate FROM enc GROUP BY segment")
def complication_rate_of_type(spark, sf):
    return rounded(H.complication_rate(encounters(spark, sf), "ASIA", ["segment"], H.Encounters(complication="region")), "complication_rate")


@add(f"""WITH {ENCOUNTERS_SQL}, g AS (SELECT *, date_diff('microsecond', lag(discharge_date) OVER (PARTITION BY patient_id ORDER BY admission_date, encounter_id), admission_date) / CAST(86400000000 AS DOUBLE) AS gap FROM enc)
    SELECT segment, CAST(sum(CASE WHEN gap >= 0 AND gap <= 30 THEN 1 ELSE 0 END) AS DOUBLE) AS observed, round(sum(expected_readmission), 6) AS expected_sum,
    round(sum(CASE WHEN gap >= 0 AND gap <= 30 THEN 1 ELSE 0 END) / sum(expected_readmission), 6) AS ratio FROM g GROUP BY segment""")
def risk_adjusted_readmission(spark, sf):
    return rounded(H.risk_adjusted_readmission(encounters(spark, sf), ["segment"]), "expected_sum", "ratio")


@add(f"WITH {ENCOUNTERS_SQL} SELECT nation, round(avg(mortality) / avg(expected), 6) AS oe_ratio FROM enc GROUP BY nation")
def observed_expected_ratio(spark, sf):
    return rounded(H.observed_expected(encounters(spark, sf), "mortality", "expected", ["nation"]), "oe_ratio")


@add(f"WITH {ENCOUNTERS_SQL} SELECT region, round(avg(mortality) / avg(expected), 6) AS oe_ratio, round(avg(mortality) / avg(expected) * (SELECT avg(mortality) FROM enc), 6) AS adjusted_rate FROM enc GROUP BY region")
def risk_adjusted_rate(spark, sf):
    return rounded(H.risk_adjusted_rate(encounters(spark, sf), "mortality", "expected", by=["region"]), "oe_ratio", "adjusted_rate")


@add(f"WITH {ENCOUNTERS_SQL} SELECT region, round(sum(mortality) - sum(expected), 6) AS excess FROM enc GROUP BY region")
def excess_deaths(spark, sf):
    return rounded(H.excess_events(encounters(spark, sf), "mortality", "expected", ["region"]), "excess")


def _quality_sql(by, least):
    return f"""WITH {ENCOUNTERS_SQL}, g AS (SELECT *, {_LOS} AS los, date_diff('microsecond', discharge_date, lead(admission_date) OVER w) / CAST(86400000000 AS DOUBLE) AS gap, row_number() OVER w AS k, count(*) OVER (PARTITION BY {by}, patient_id) AS m
      FROM enc WINDOW w AS (PARTITION BY {by}, patient_id ORDER BY admission_date, encounter_id))
    SELECT {by}, count(*) AS n, round(avg(los), 6) AS mean_los, median(los) AS median_los, round(stddev_samp(los), 6) AS std_los,
    round(count(*) FILTER (WHERE gap BETWEEN 0 AND 30) / CAST(count(*) FILTER (WHERE k < m OR m = 1) AS DOUBLE), 6) AS readmission_rate_30d,
    round(count(*) FILTER (WHERE gap BETWEEN 0 AND 7) / CAST(count(*) FILTER (WHERE k < m OR m = 1) AS DOUBLE), 6) AS readmission_rate_7d,
    round(avg(los) / avg(expected_los), 6) AS los_index, round(avg(mortality), 6) AS mortality_rate, round(avg(mortality) / avg(expected), 6) AS mortality_index,
    round(sum(mortality) / sum(expected), 6) AS smr, round(avg(complication), 6) AS complication_rate FROM g GROUP BY {by} HAVING count(*) >= {least}"""


_QUALITY = ("mean_los", "std_los", "readmission_rate_30d", "readmission_rate_7d", "los_index", "mortality_rate", "mortality_index", "smr", "complication_rate")


@add(_quality_sql("segment", 1))
def quality_metrics_by_segment(spark, sf):
    return rounded(H.quality_metrics(encounters(spark, sf), ["segment"]), *_QUALITY)


@add(_quality_sql("nation", 10))
def stratified_metrics_by_nation(spark, sf):
    return rounded(H.quality_metrics(encounters(spark, sf), ["nation"], 10), *_QUALITY)
