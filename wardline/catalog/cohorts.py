"""Queries of exploration, stores, monitoring, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.catalog.clinical import rounded
from wardline.catalog.records import resources
from wardline.frames import Catalog, shared_folder, table
from wardline.operators import eda as E
from wardline.operators import models as M
from wardline.operators import monitor as O
from wardline.plans import etl
from wardline.plans.cohort import ENCOUNTERS_SQL, encounters
from wardline.sources import files, synthetic
from wardline.sources import stores as S
from wardline.streaming import streams

CATALOG = Catalog()
add = CATALOG.add

_DESCRIBE = "SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS low, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75, CAST(max({c}) AS DOUBLE) AS high FROM part"


@add(" UNION ALL ".join(_DESCRIBE.format(c=c) for c in ("p_size", "p_retailprice")))
def eda_describe(spark, sf):
    return rounded(E.describe(table(spark, sf, "part"), ["p_size", "p_retailprice"]), "mean", "std")


@add("SELECT c_mktsegment, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM customer), 6) AS percent FROM customer GROUP BY c_mktsegment")
def eda_shares(spark, sf):
    return rounded(E.shares(table(spark, sf, "customer"), "c_mktsegment"), "percent")


@add(f"WITH {ENCOUNTERS_SQL} SELECT segment, round(count(*) FILTER (WHERE region = 'ASIA') / CAST(count(*) AS DOUBLE), 6) AS \"ASIA\", round(count(*) FILTER (WHERE region = 'EUROPE') / CAST(count(*) AS DOUBLE), 6) AS \"EUROPE\" FROM enc GROUP BY segment")
def eda_crosstab(spark, sf):
    return rounded(E.crosstab(encounters(spark, sf), "segment", "region", ["ASIA", "EUROPE"]), "ASIA", "EUROPE")


_AGE = "CAST(18 + patient_id % 80 AS INTEGER)"
_BAND = f"CASE WHEN {_AGE} > 18 AND {_AGE} <= 35 THEN '18-34' WHEN {_AGE} > 35 AND {_AGE} <= 50 THEN '35-49' WHEN {_AGE} > 50 AND {_AGE} <= 65 THEN '50-64' WHEN {_AGE} > 65 AND {_AGE} <= 80 THEN '65-79' WHEN {_AGE} > 80 AND {_AGE} <= 100 THEN '80+' END"


def _aged(spark, sf):
    return encounters(spark, sf).withColumn("age", (18 + F.col("patient_id") % 80).cast("int"))


@add(f"WITH {ENCOUNTERS_SQL} SELECT {_BAND} AS age_group, count(*) AS n, round(avg(mortality) * 100, 6) AS mortality, round(avg(complication) * 100, 6) AS complication FROM enc GROUP BY age_group")
def eda_age_group_rates(spark, sf):
    return rounded(E.outcome_rates(_aged(spark, sf), E.binned(F.col("age")).alias("age_group"), ["mortality", "complication"]), "mortality", "complication")


@add(f"WITH {ENCOUNTERS_SQL}, l AS (SELECT *, date_diff('day', admission_date, discharge_date) AS los FROM enc) SELECT CASE WHEN los > 0 AND los <= 3 THEN '0-3 days' WHEN los > 3 AND los <= 7 THEN '4-7 days' WHEN los > 7 AND los <= 14 THEN '8-14 days' WHEN los > 14 AND los <= 30 THEN '15-30 days' END AS stay, count(*) AS n, round(avg(mortality) * 100, 6) AS mortality FROM l GROUP BY stay")
def eda_stay_rates(spark, sf):
    from wardline.operators.healthcare import with_los

    return rounded(E.outcome_rates(with_los(encounters(spark, sf)), E.binned(F.col("los"), E.STAY_BINS, E.STAY_NAMES).alias("stay"), ["mortality"]), "mortality")


@add(f"WITH {ENCOUNTERS_SQL}, r AS (SELECT segment, avg(mortality) * 100 AS m, avg(complication) * 100 AS c FROM enc GROUP BY segment) SELECT segment, 'Mortality' AS outcome, round(m, 6) AS rate FROM r UNION ALL SELECT segment, 'Complication', round(c, 6) FROM r")
def eda_melted_rates(spark, sf):
    r = E.outcome_rates(encounters(spark, sf), "segment", ["mortality", "complication"])
    return rounded(E.melted(r, ["segment"], ["mortality", "complication"], {"mortality": "Mortality", "complication": "Complication"}), "rate")


@add(f"WITH {ENCOUNTERS_SQL} SELECT 'mortality' AS a, 'expected' AS b, round(corr(mortality, expected), 6) AS r FROM enc UNION ALL SELECT 'mortality', 'expected_los', round(corr(mortality, expected_los), 6) FROM enc UNION ALL SELECT 'expected', 'expected_los', round(corr(expected, expected_los), 6) FROM enc")
def eda_correlations(spark, sf):
    return rounded(E.correlations(encounters(spark, sf), ["mortality", "expected", "expected_los"]), "r")


@add(f"""WITH {ENCOUNTERS_SQL}, c AS (SELECT CASE WHEN k = 1 THEN 'elderly' ELSE 'asian' END AS factor, CASE WHEN k = 1 THEN {_AGE} > 75 ELSE region = 'ASIA' END AS has, mortality = 1 AS yes FROM enc, (VALUES (1), (2)) t(k))
    SELECT factor, round((count(*) FILTER (WHERE has AND yes) / CAST(count(*) FILTER (WHERE has AND NOT yes) AS DOUBLE)) / (count(*) FILTER (WHERE NOT has AND yes) / CAST(count(*) FILTER (WHERE NOT has AND NOT yes) AS DOUBLE)), 6) AS odds_ratio FROM c GROUP BY factor""")
def eda_odds_ratios(spark, sf):
    return rounded(E.odds_ratio(_aged(spark, sf), "mortality", {"elderly": F.col("age") > 75, "asian": F.col("region") == "ASIA"}), "odds_ratio")


@add(f"WITH {ENCOUNTERS_SQL} SELECT strftime(admission_date, '%Y-%m') AS month, count(*) AS n, CAST(sum(mortality) AS BIGINT) AS mortality_count, round(avg(mortality) * 100, 6) AS mortality_percent FROM enc GROUP BY month")
def eda_monthly_outcomes(spark, sf):
    return rounded(E.monthly(encounters(spark, sf), "admission_date", ["mortality"]), "mortality_percent")


@add()
def synthetic_encounters(spark, sf):
    return synthetic.encounters(spark, 500)


@add()
def synthetic_cohort_flags(spark, sf):
    return E.with_flags(synthetic.cohort(spark, 500), E.risk_factors())


@add()
def synthetic_bundles(spark, sf):
    return synthetic.bundles(spark, 50)


def _patients(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("name"), F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("mrn"), (F.col("c_custkey") * 37 % 1000 / 1000.0).alias("risk_score"), F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 11).cast("int")).alias("length_of_stay"))


_PATIENTS = "pt AS (SELECT c_custkey AS patient_id, c_name AS name, 'M' || CAST(c_custkey AS VARCHAR) AS mrn, (c_custkey * 37 % 1000) / CAST(1000 AS DOUBLE) AS risk_score, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 11 AS INTEGER) END AS length_of_stay FROM customer)"


@add(f"WITH {_PATIENTS} SELECT * FROM pt WHERE (lower(name) LIKE '%12%' OR lower(CAST(patient_id AS VARCHAR)) LIKE '%12%' OR lower(mrn) LIKE '%12%') AND risk_score >= 0.75 ORDER BY risk_score DESC, patient_id LIMIT 20 OFFSET 5")
def patient_page(spark, sf):
    return S.find_patients(_patients(spark, sf), "12", "high").orderBy(F.desc("risk_score"), "patient_id").offset(5).limit(20)


@add(f"WITH {_PATIENTS} SELECT * FROM (SELECT *, CASE WHEN patient_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM pt) WHERE gender = 'F' AND risk_score >= 0.4 AND risk_score < 0.75 AND lower(name) LIKE '%7%'")
def patient_filter(spark, sf):
    rows = _patients(spark, sf).withColumn("gender", F.when(F.col("patient_id") % 2 == 0, "F").otherwise("M"))
    return S.find_patients(rows, " 7 ", "medium", ("name",), "F")


@add(f"WITH {_PATIENTS} SELECT patient_id, CAST(3 + (length_of_stay IS NOT NULL)::INT AS BIGINT) AS n, name, CAST(length_of_stay AS VARCHAR) AS stay FROM pt")
def patient_demographics(spark, sf):
    r = files.as_patient_records(_patients(spark, sf))
    return r.select("patient_id", F.size("demographics").cast("long").alias("n"), F.col("demographics")["name"].alias("name"), F.try_element_at("demographics", F.lit("length_of_stay")).alias("stay"))


@add("SELECT user_id, '[' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) || ']' AS events FROM events GROUP BY user_id")
def nested_columns_as_json(spark, sf):
    return files.nested_as_json(table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("events")))


@add(f"WITH {_PATIENTS} SELECT * FROM pt ORDER BY risk_score DESC, patient_id LIMIT 50 OFFSET 50")
def patient_second_page(spark, sf):
    return S.page(_patients(spark, sf), 2, 50)


@add(f"WITH {_PATIENTS} SELECT * FROM pt ORDER BY lower(name) DESC, patient_id LIMIT 10")
def patient_sorted_page(spark, sf):
    return S.sorted_page(_patients(spark, sf), "name", descending=True)


@add(f"WITH {_PATIENTS} SELECT count(*) AS total, count(*) FILTER (WHERE risk_score >= 0.75) AS high, count(*) FILTER (WHERE risk_score >= 0.4 AND risk_score < 0.75) AS medium, count(*) FILTER (WHERE risk_score < 0.4) AS low, round(avg(coalesce(length_of_stay, 0)), 1) AS mean_stay FROM pt")
def dashboard_summary(spark, sf):
    return S.summary(_patients(spark, sf))


@add("WITH n AS (SELECT count(*) AS n FROM customer) SELECT CAST(i AS INTEGER) AS i, greatest(4, n - 3 * i) AS admissions, CAST(round_even(greatest(4, n - 3 * i) * (0.25::DOUBLE + 0.05::DOUBLE * (i % 3)), 0) AS BIGINT) AS readmissions FROM n, range(6) t(i)")
def dashboard_trend(spark, sf):
    return S.trend(_patients(spark, sf))


@add(f"""WITH {_PATIENTS}, t AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, patient_id) - 1 AS i FROM pt ORDER BY risk_score DESC, patient_id LIMIT 8)
    SELECT 'n-' || CAST(patient_id AS VARCHAR) AS notification_id, patient_id, CASE WHEN risk_score >= 0.85 THEN 'critical' ELSE 'warning' END AS severity, 'Risk score ' || CAST(CAST(round(risk_score * 100) AS INTEGER) AS VARCHAR) || '% for patient ' || CAST(patient_id AS VARCHAR) AS message, TIMESTAMP '2024-06-01 12:00:00' - to_hours(CAST(3 * i + 1 AS INTEGER)) AS created_at, patient_id % 2 = 0 AS read FROM t""")
def notifications(spark, sf):
    reads = _patients(spark, sf).where("patient_id % 2 = 0").select(F.lit("u1").alias("user_id"), F.concat(F.lit("n-"), F.col("patient_id").cast("string")).alias("notification_id"))
    return S.with_read(S.notifications(_patients(spark, sf), "2024-06-01 12:00:00"), reads, "u1")


def _features(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("patient_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("feature_timestamp"), "value").withColumn("feature_date", F.substring("feature_timestamp", 1, 10))


@add("WITH r AS (SELECT user_id AS patient_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS feature_timestamp, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) SELECT patient_id, feature_timestamp, value FROM r WHERE k = 1")
def latest_features(spark, sf):
    return S.latest(_features(spark, sf), ["patient_id"], "feature_timestamp").drop("feature_date")


@add("SELECT user_id AS patient_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS feature_timestamp, value FROM events WHERE ts >= TIMESTAMP '2024-01-25 06:00:00'")
def recent_features(spark, sf):
    return S.recent(_features(spark, sf), "2024-01-30T06:00:00", 5).drop("feature_date")


def _log(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string")).alias("user_id"), F.col("user_id").alias("patient_id"), F.col("event_type").alias("operation"))


@add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'u' || CAST(event_id % 7 AS VARCHAR) AS user, user_id AS patient, event_type AS operation FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') BETWEEN '2024-01-05' AND '2024-01-09'")
def audit_range(spark, sf):
    return S.log_between(_log(spark, sf), "2024-01-05", "2024-01-09")


@add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'u' || CAST(event_id % 7 AS VARCHAR) AS user, user_id AS patient, event_type AS operation FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def audit_range_typed(spark, sf):
    return S.log_between(_log(spark, sf), "2024-01-05", "2024-01-09", typed=True)


@add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'u' || CAST(event_id % 7 AS VARCHAR) AS user, user_id AS patient, event_type AS operation FROM events WHERE user_id = 42")
def audit_of_patient(spark, sf):
    return S.log_of_patient(_log(spark, sf), 42)


@add("WITH b AS (SELECT CAST(ts AS DATE) AS day, avg(coalesce(value, 0)) AS m FROM events GROUP BY day) SELECT day, round(m, 6) AS value_mean, round(abs(m - 50) / 50, 6) AS value_shift, CASE WHEN abs(m - 50) / 50 > 0.05 THEN 'Value Drift' ELSE 'Stable' END AS status FROM b")
def drift_check(spark, sf):
    rows = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    return rounded(O.drift(rows, ["day"], 0.05, {"value": 50.0}), "value_mean", "value_shift")


@add("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def recent_adverse_events(spark, sf):
    return O.recent_events(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 25)


_CONTROLS = "c AS (SELECT c_mktsegment AS standard, 'r' || CAST(c_custkey % 3 AS VARCHAR) AS requirement, CASE WHEN c_custkey % 5 = 0 THEN 'not_applicable' WHEN c_acctbal > 0 THEN 'compliant' ELSE 'non_compliant' END AS status FROM customer)"


@add(f"""WITH {_CONTROLS}, r AS (SELECT standard, requirement, count(*) FILTER (WHERE status = 'compliant') AS compliant, count(*) FILTER (WHERE status <> 'not_applicable') AS applicable FROM c GROUP BY ROLLUP (standard, requirement)),
    p AS (SELECT *, CASE WHEN applicable = 0 THEN 100 ELSE 100.0::DOUBLE * compliant / applicable END AS q FROM r) SELECT standard, requirement, compliant, applicable, round(q, 6) AS percent, CASE WHEN q >= 90 THEN 'excellent' WHEN q >= 80 THEN 'good' WHEN q >= 70 THEN 'fair' ELSE 'poor' END AS band FROM p""")
def compliance_rollup(spark, sf):
    c = table(spark, sf, "customer")
    status = F.when(F.col("c_custkey") % 5 == 0, "not_applicable").when(F.col("c_acctbal") > 0, "compliant").otherwise("non_compliant")
    return rounded(O.compliance(c.select(F.col("c_mktsegment").alias("standard"), F.concat(F.lit("r"), (F.col("c_custkey") % 3).cast("string")).alias("requirement"), status.alias("status"))), "percent")


@add("SELECT 'AC-1' AS control, count(*) FILTER (WHERE regexp_matches(text, 'License')) AS evidence, CASE WHEN count(*) FILTER (WHERE regexp_matches(text, 'License')) > 0 THEN 'compliant' ELSE 'non_compliant' END AS status FROM documents UNION ALL SELECT 'AU-9', 0, 'not_applicable'")
def compliance_controls(spark, sf):
    return O.control_status(table(spark, sf, "documents"), {"AC-1": "License", "AU-9": ""})


@add("SELECT o_orderpriority, CASE max(CASE WHEN o_orderkey % 50 = 0 THEN 3 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) WHEN 3 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS overall, count(*) FILTER (WHERE o_orderkey % 50 <> 0 AND o_orderkey % 7 <> 0) AS pass, CAST(0 AS BIGINT) AS warn, CAST(0 AS BIGINT) AS fail, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS error, count(*) FILTER (WHERE o_orderkey % 50 <> 0 AND o_orderkey % 7 = 0) AS unknown FROM orders GROUP BY o_orderpriority")
def status_rollup(spark, sf):
    o = table(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderkey") % 50 == 0, "ERROR").when(F.col("o_orderkey") % 7 == 0, "UNKNOWN").otherwise("PASS"))
    return O.overall_status(o, ["o_orderpriority"])


def _linear(x):
    return 1 / (1 + 2.718281828459045 ** -(x.sum(axis=1) / 40 - 3))


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("patient_id"), F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 20).alias("price"))


@add("SELECT CAST(p_partkey AS VARCHAR) AS key, round(1 / (1 + pow(2.718281828459045::DOUBLE, -((p_size + p_retailprice / 20) / 40 - 3))), 6) AS score, 'ok' AS status FROM part")
def batch_scores(spark, sf):
    return rounded(M.batch_score(_parts(spark, sf), ["size", "price"], _linear).drop("detail"), "score")


@add("""WITH s AS (SELECT 1 / (1 + pow(2.718281828459045::DOUBLE, -((p_size + p_retailprice / 20) / 40 - 3))) AS s FROM part)
    SELECT count(*) AS n, CAST(0 AS BIGINT) AS errors, count(*) FILTER (WHERE s >= 0.75) AS high, count(*) FILTER (WHERE s >= 0.4 AND s < 0.75) AS medium, count(*) FILTER (WHERE s < 0.4) AS low, round(avg(s), 6) AS mean_score, round(median(s), 6) AS median_score FROM s""")
def batch_score_summary(spark, sf):
    return rounded(M.batch_summary(M.batch_score(_parts(spark, sf), ["size", "price"], _linear)), "mean_score", "median_score")


@add("""SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(0 AS INTEGER) AS option, feature, round(v / (p_size + p_retailprice / 20), 6) AS value
    FROM (SELECT *, 'size' AS feature, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT *, 'price', p_retailprice / 20 FROM part)""")
def explain_attention(spark, sf):
    return rounded(M.attention(_parts(spark, sf), ["size", "price"], "patient_id"), "value")


for _method in ("shap", "lime", "counterfactual"):

    def _explained(spark, sf, method=_method):
        rows = _parts(spark, sf)
        return M.explain(rows, ["size", "price"], _linear, M.background(rows, ["size", "price"], "patient_id", 50), "patient_id", method)

    add(name=f"explain_{_method}")(_explained)


@add()
def global_feature_importance(spark, sf):
    return M.global_importance(_explained(spark, sf, "shap"))


def _risk_rows(spark, sf):
    return encounters(spark, sf).select("encounter_id", "segment", "region", "expected", "expected_los", F.col("mortality").cast("double").alias("label"))


for _kind in ("logistic", "boosted", "factorization"):

    def _risk(spark, sf, kind=_kind):
        rows = _risk_rows(spark, sf)
        options = {"maxIter": 5} if kind != "logistic" else {}
        return M.scored(M.pipeline(kind, ["expected", "expected_los"], ["segment", "region"], "label", **options).fit(rows), rows)

    add(name=f"risk_model_{_kind}")(_risk)


@add()
def cox_coefficients(spark, sf):
    o = encounters(spark, sf).withColumn("t", F.col("encounter_id") % 500 + 1.0)
    b = M.cox(o, "t", "mortality", ["expected", "expected_los"], rounds=3)
    return spark.createDataFrame(sorted(b.items()), "feature string, coefficient double")


@add()
def clinical_etl_features(spark, sf):
    return etl.features(resources(spark, sf), "click")


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _streamed(spark, sf, make):
    """A streaming query over the events that are there, as a table once it has ended."""
    place = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"
    rows = make(streams.read(spark, sf, _EVENTS, "events.parquet"))
    streams.completed(rows, place, f"{place}-state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(place)


@add("SELECT CAST(day AS TIMESTAMP) AS \"start\", CAST(day + INTERVAL 7 DAY AS TIMESTAMP) AS \"end\", user_id, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT CAST(ts AS DATE) - CAST(i AS INTEGER) AS day, user_id, value FROM events, range(7) r(i)) GROUP BY day, user_id")
def stream_sliding_weeks(spark, sf):
    rows = rounded(_streamed(spark, sf, streams.sliding_weeks), "mean")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@add("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, user_id, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_means(spark, sf):
    return rounded(_streamed(spark, sf, streams.daily_means), "mean").withColumn("day", F.col("day").cast("timestamp_ntz"))


@add("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf):
    return _streamed(spark, sf, streams.sessions).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
