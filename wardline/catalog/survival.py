"""Queries of survival: the stay as time, death as event."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.clinical import rounded
from wardline.frames import Catalog
from wardline.operators import survival as S
from wardline.plans.cohort import ENCOUNTERS_SQL, encounters

CATALOG = Catalog()
add = CATALOG.add
#: The hazard's coefficient of the expected mortality, as a fit would give it.
COEFFICIENTS = {"expected": 1.5}
DAYS = [3, 7, 14]
_ROWS = f"""WITH {ENCOUNTERS_SQL}, x AS (SELECT encounter_id, CAST(date_diff('day', admission_date, discharge_date) AS DOUBLE) AS t, mortality AS d, expected AS r, exp(1.5 * expected) AS e FROM enc)"""
_HAZARD = f"""{_ROWS}, b AS (SELECT t, sum(d) AS events, sum(e) AS e FROM x GROUP BY t),
    h AS (SELECT t, CAST(events AS BIGINT) AS events, events / sum(e) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS hazard FROM b),
    c AS (SELECT *, sum(hazard) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS cumulative FROM h WHERE events > 0)"""


def stays(spark, sf):
    return encounters(spark, sf).withColumn("days", F.date_diff("discharge_date", "admission_date").cast("double"))


@add(f"{_HAZARD} SELECT t AS time, events, round(hazard, 8) AS hazard, round(cumulative, 8) AS cumulative FROM c")
def survival_baseline_hazard(spark, sf):
    return rounded(S.baseline_hazard(stays(spark, sf), "days", "mortality", COEFFICIENTS), "hazard", "cumulative", at=8)


_AT = ", ".join(f"round(exp(-(SELECT coalesce(sum(hazard), 0) FROM c WHERE t <= {d}) * e), 6) AS survival_{d}" for d in DAYS)


@add(f"{_HAZARD} SELECT encounter_id, {_AT} FROM x")
def survival_at_days(spark, sf):
    rows = stays(spark, sf)
    out = S.survival(rows, S.baseline_hazard(rows, "days", "mortality", COEFFICIENTS), COEFFICIENTS, DAYS)
    return rounded(out.select("encounter_id", *(f"survival_{d}" for d in DAYS)), *(f"survival_{d}" for d in DAYS), at=6)


@add(f"""{_ROWS}, g AS (SELECT t, d, r, count(*) AS n FROM x GROUP BY ALL),
    p AS (SELECT sum(a.n * b.n) AS comparable, coalesce(sum(a.n * b.n) FILTER (WHERE a.r > b.r), 0) AS concordant, coalesce(sum(a.n * b.n) FILTER (WHERE a.r = b.r), 0) AS tied
          FROM g a JOIN g b ON a.d = 1 AND (a.t < b.t OR (a.t = b.t AND b.d = 0)))
    SELECT CAST(comparable AS BIGINT) AS comparable, CAST(concordant AS BIGINT) AS concordant, CAST(tied AS BIGINT) AS tied, round((concordant + tied / CAST(2 AS DOUBLE)) / CAST(comparable AS DOUBLE), 8) AS concordance FROM p""")
def survival_concordance(spark, sf):
    return rounded(S.concordance(stays(spark, sf), "days", "mortality", "expected"), "concordance", at=8)
