"""Queries of drift: tests of encounters admitted before and from a day on, and windows of so many events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.catalog.clinical import rounded
from wardline.frames import Catalog, shared_folder
from wardline.operators import shifts
from wardline.plans.cohort import ENCOUNTERS_SQL, encounters
from wardline.streaming import streams

CATALOG = Catalog()
add = CATALOG.add
SINCE = "1995-07-01"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _admitted(spark, sf):
    rows = encounters(spark, sf).withColumn("now", F.col("admission_date") >= F.lit(SINCE).cast("date"))
    return rows.withColumn("stay", F.date_diff("discharge_date", "admission_date"))


# Kolmogorov's tail on either side of 1, as five terms of a series.
_TAIL = """CASE WHEN l <= 0 THEN 1 WHEN l < 1 THEN 1 - sqrt(2 * pi()) / l * list_sum([exp(-power(2 * k - 1, 2) * power(pi(), 2) / (8 * l * l)) FOR k IN range(1, 6)])
    ELSE 2 * list_sum([power(-1, k - 1) * exp(-2 * k * k * l * l) FOR k IN range(1, 6)]) END"""


@add(f"""WITH {ENCOUNTERS_SQL},
    x AS (SELECT segment, unnest(['expected', 'expected_los', 'stay']) AS feature, unnest([expected, expected_los, CAST(date_diff('day', admission_date, discharge_date) AS DOUBLE)]) AS v, admission_date >= DATE '{SINCE}' AS now FROM enc),
    c AS (SELECT segment, feature, v, count(*) FILTER (WHERE NOT now) AS n0, count(*) FILTER (WHERE now) AS n1 FROM x GROUP BY ALL),
    t AS (SELECT *, sum(n0) OVER g AS t0, sum(n1) OVER g AS t1, sum(n0) OVER u AS u0, sum(n1) OVER u AS u1 FROM c WINDOW g AS (PARTITION BY segment, feature), u AS (PARTITION BY segment, feature ORDER BY v)),
    k AS (SELECT segment, feature, max(abs(u0 / t0 - u1 / t1)) AS ks, CAST(max(t0) AS DOUBLE) AS t0, CAST(max(t1) AS DOUBLE) AS t1 FROM t GROUP BY ALL),
    b AS (SELECT segment, feature, greatest(sum(n0) / max(t0), 0.0001) AS e, greatest(sum(n1) / max(t1), 0.0001) AS a FROM t GROUP BY segment, feature, least(9, CAST((u0 - n0) * 10 AS BIGINT) // CAST(t0 AS BIGINT))),
    p AS (SELECT segment, feature, sum((a - e) * ln(a / e)) AS psi FROM b GROUP BY ALL),
    o AS (SELECT *, sqrt(t0 * t1 / (t0 + t1)) * ks AS l FROM k JOIN p USING (segment, feature))
    SELECT segment, feature, CAST(t0 AS BIGINT) AS baseline_rows, CAST(t1 AS BIGINT) AS current_rows, round(ks, 8) AS ks, round(psi, 8) AS psi, round({_TAIL}, 8) AS ks_p,
        CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS level FROM o""")  # fmt: skip
def drift_numeric_tests(spark, sf):
    return rounded(shifts.numeric_shift(_admitted(spark, sf), ["expected", "expected_los", "stay"], "now", ["segment"]), "ks", "psi", "ks_p", at=8)


# Chi-square's tail with an even number of degrees is a finite sum.
@add(f"""WITH {ENCOUNTERS_SQL},
    x AS (SELECT segment, unnest(['region', 'expected_los']) AS feature, unnest([region, CAST(expected_los AS VARCHAR)]) AS v, admission_date >= DATE '{SINCE}' AS now FROM enc),
    o AS (SELECT segment, feature, v, now, count(*) AS n FROM x GROUP BY ALL),
    e AS (SELECT a.segment, a.feature, a.v, b.now, CAST(a.n AS DOUBLE) * CAST(b.n AS DOUBLE) / CAST(sum(a.n) OVER (PARTITION BY a.segment, a.feature, b.now) AS DOUBLE) AS want
          FROM (SELECT segment, feature, v, sum(n) AS n FROM o GROUP BY ALL) a JOIN (SELECT segment, feature, now, sum(n) AS n FROM o GROUP BY ALL) b USING (segment, feature)),
    s AS (SELECT segment, feature, sum(power(coalesce(n, 0) - want, 2) / want) AS chi, count(DISTINCT v) AS categories FROM e LEFT JOIN o USING (segment, feature, v, now) GROUP BY ALL),
    r AS (SELECT segment, feature, CAST(sum(n) FILTER (WHERE NOT now) AS BIGINT) AS baseline_rows, CAST(sum(n) FILTER (WHERE now) AS BIGINT) AS current_rows FROM o GROUP BY ALL)
    SELECT segment, feature, baseline_rows, current_rows, categories, round(chi, 6) AS chi_square, categories - 1 AS freedom,
        round(exp(-chi / 2) * list_sum([power(chi / 2, i) / gamma(i + 1) FOR i IN range(0, (categories - 1) // 2)]), 8) AS p FROM s JOIN r USING (segment, feature)""")  # fmt: skip
def drift_categorical_tests(spark, sf):
    return rounded(rounded(shifts.categorical_shift(_admitted(spark, sf), ["region", "expected_los"], "now", ["segment"]), "chi_square"), "p", at=8)


_SIZE, _EVERY, _DAYS = 100, 50, 7


@add(f"""WITH o AS (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, min(ts) OVER (PARTITION BY event_type) AS first FROM events
        WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events) AND event_type IS NOT NULL AND value IS NOT NULL AND event_id IS NOT NULL),
    a AS (SELECT event_type, i, first, min(ts) OVER w AS start, ts AS "end", avg(value) OVER w AS mean FROM o WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS {_SIZE - 1} PRECEDING)),
    n AS (SELECT event_type, CAST((i + 1 - {_SIZE}) // {_EVERY} AS BIGINT) AS "window", start, "end", mean, first + to_days(CAST(date_diff('microsecond', first, "end") // (86400000000 * {_DAYS}) * {_DAYS} AS INTEGER)) AS due
          FROM a WHERE i + 1 >= {_SIZE} AND (i + 1 - {_SIZE}) % {_EVERY} = 0),
    b AS (SELECT n.*, coalesce((SELECT max_by(m.mean, m."window") FROM n m WHERE m.event_type = n.event_type AND m."end" < n.due), (SELECT m.mean FROM n m WHERE m.event_type = n.event_type AND m."window" = 0 AND n."window" > 0)) AS baseline FROM n)
    SELECT event_type, "window", start, "end", round(mean, 6) AS mean, round(baseline, 6) AS baseline, round(abs(mean - baseline) / abs(baseline), 6) AS shift, abs(mean - baseline) / abs(baseline) > 0.05 AS drifted FROM b""")  # fmt: skip
def stream_count_windows(spark, sf):
    """The store of a stream's state is the session's setting, put back once the stream has ended."""
    name, (setting, provider) = f"count_{uuid.uuid4().hex}", streams.STATE_STORE
    before = spark.conf.get(setting)
    spark.conf.set(setting, provider)
    try:
        rows = streams.count_windows(streams.read(spark, sf, EVENTS, "events.parquet"), "event_type", "event_id", _SIZE, _EVERY, days=_DAYS)
        place = f"{shared_folder(spark)}/{name}"
        rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}-state").trigger(availableNow=True).start(place).awaitTermination()
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(rows.schema).parquet(place).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    return rounded(out, "mean", "baseline", "shift")
