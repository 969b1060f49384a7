"""Queries of what is read, written and marked one by one: patients, notices, features, models, files, streams, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.catalog.clinical import rounded
from wardline.catalog.cohorts import _PATIENTS, _linear, _parts, _patients
from wardline.catalog.records import _code, _row, _subject, bundles, resources
from wardline.frames import Catalog, nan_to_null, shared_folder, table
from wardline.operators import eda as E
from wardline.operators import fairness as Q
from wardline.operators import icd as I
from wardline.operators import models as M
from wardline.operators import monitor as O
from wardline.operators import privacy as V
from wardline.operators import quality
from wardline.operators.privacy import Deidentification
from wardline.plans import etl, lineage
from wardline.plans.cohort import DIAGNOSES_SQL, ENCOUNTERS_SQL, PREDICTIONS_SQL, diagnoses, encounters, predictions
from wardline.sources import fhir, files
from wardline.sources import stores as S
from wardline.streaming import streams

CATALOG = Catalog()
add = CATALOG.add


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Diagnoses by row.

_NORM = "CASE WHEN regexp_full_match(replace(upper(trim(code)), '.', ''), '[A-Z][0-9]+') THEN replace(upper(trim(code)), '.', '') ELSE '' END"


def _has(*prefixes):
    return f"CAST(norm <> '' AND substr(norm, 1, 3) IN ({', '.join(repr(p) for p in prefixes)}) AS INTEGER)"


@add(f"""WITH {DIAGNOSES_SQL}, nx AS (SELECT *, {_NORM} AS norm FROM dx)
    SELECT encounter_id, line, {_has("I10", "I11", "I12", "I13", "I15")} AS icd_group_hypertension, {_has("J45")} AS icd_group_asthma, {_has("E08", "E09", "E10", "E11", "E13")} AS icd_group_diabetes FROM nx""")
def icd_rows_binary(spark, sf):
    return I.encode_rows(diagnoses(spark, sf)).select("encounter_id", "line", "icd_group_hypertension", "icd_group_asthma", "icd_group_diabetes")


@add(f"""WITH {DIAGNOSES_SQL}, nx AS (SELECT *, {_NORM} AS norm FROM dx)
    SELECT encounter_id, CAST(count(*) FILTER (WHERE substr(norm, 1, 1) = 'I') AS INTEGER) AS circulatory, CAST(count(*) FILTER (WHERE substr(norm, 1, 1) = 'J') AS INTEGER) AS respiratory FROM nx GROUP BY encounter_id""")
def icd_rows_count_of_lists(spark, sf):
    lists = diagnoses(spark, sf).groupBy("encounter_id").agg(F.collect_list("code").alias("codes"))
    return I.encode_rows(lists, "codes", "count", "chapter").select("encounter_id", F.col("icd_chapter_I00-I99").alias("circulatory"), F.col("icd_chapter_J00-J99").alias("respiratory"))


@add(f"WITH {DIAGNOSES_SQL} SELECT encounter_id, line FROM dx WHERE NOT regexp_full_match(code, '[A-Z][0-9]{{2}}(\\.[0-9]{{1,4}})?')")
def icd_invalid_rows(spark, sf):
    return quality.invalid_codes(diagnoses(spark, sf), "code").select("encounter_id", "line")


# Patients and notices.


def _chart(spark, sf):
    return _patients(spark, sf).withColumn("medications", F.when(F.col("patient_id") % 2 == 0, F.lit('["metformin"]')))


_BAND = "CASE WHEN risk_score >= 0.75 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END"


@add(f"WITH {_PATIENTS} SELECT patient_id AS id, name, mrn, {_BAND} AS \"riskBand\", length_of_stay AS \"lengthOfStay\" FROM pt")
def patient_entries(spark, sf):
    return S.projected(_chart(spark, sf)).select("id", "name", "mrn", "riskBand", "lengthOfStay")


@add(f"WITH {_PATIENTS} SELECT patient_id AS id, name, {_BAND} AS \"riskBand\", '[\"metformin\"]' AS medications, '[]' AS \"labResults\" FROM pt WHERE patient_id = 42")
def patient_by_id(spark, sf):
    return S.get_patient(_chart(spark, sf), 42).select("id", "name", "riskBand", "medications", "labResults")


@add("SELECT count(*) AS n FROM customer")
def patient_count(spark, sf):
    return S.count_patients(_chart(spark, sf))


@add(f"WITH {_PATIENTS} SELECT patient_id, name FROM pt WHERE patient_id % 10 <> 0")
def patients_after_deletion(spark, sf):
    p = _chart(spark, sf)
    return S.delete_patients(p, p.where("patient_id % 10 = 0")).select("patient_id", "name")


@add("SELECT c_custkey AS patient_id, score AS risk_score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_band, CASE WHEN c_custkey % 3 = 0 THEN '2024-06-01' END AS updated_at FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 8) / CAST(8 AS DOUBLE) ELSE (c_custkey * 37 % 1000) / CAST(1000 AS DOUBLE) END AS score FROM customer)")
def patients_recomputed(spark, sf):
    p = _chart(spark, sf)
    scores = p.where("patient_id % 3 = 0").select("patient_id", (F.col("patient_id") % 8 / 8.0).alias("score"))
    return S.recomputed(p, scores, "2024-06-01").select("patient_id", "risk_score", "risk_band", "updated_at")


@add(f"WITH {_PATIENTS} SELECT patient_id, CASE WHEN patient_id % 5 = 0 THEN 'renamed' ELSE name END AS name FROM pt")
def patients_overlaid(spark, sf):
    p = _patients(spark, sf)
    return S.overlay(p, p.where("patient_id % 5 = 0").select("patient_id", F.lit("renamed").alias("name"))).select("patient_id", "name")


def _notices(spark, sf):
    return S.notifications(_patients(spark, sf), "2024-06-01 12:00:00")


def _reads(spark, sf):
    who = F.concat(F.lit("u"), (F.col("c_custkey") % 2).cast("string")).alias("user_id")
    return table(spark, sf, "customer").select(who, F.concat(F.lit("n-"), F.col("c_custkey").cast("string")).alias("notification_id"), F.lit("2024-01-01").alias("read_at"))


_TOP = f"{_PATIENTS}, top AS (SELECT patient_id FROM pt ORDER BY risk_score DESC, patient_id LIMIT 8)"


@add(f"WITH {_TOP} SELECT count(*) FILTER (WHERE patient_id % 2 <> 1) AS unread FROM top")
def notices_unread(spark, sf):
    return S.unread(_notices(spark, sf), _reads(spark, sf), "u1")


@add(f"WITH {_TOP} SELECT 'u' || CAST(c_custkey % 2 AS VARCHAR) AS user_id, 'n-' || CAST(c_custkey AS VARCHAR) AS notification_id, '2024-01-01' AS read_at FROM customer WHERE NOT (c_custkey % 2 = 1 AND c_custkey IN (SELECT patient_id FROM top)) UNION ALL SELECT 'u1', 'n-' || CAST(patient_id AS VARCHAR), '2024-06-02' FROM top")
def notices_all_marked(spark, sf):
    return S.mark_read(_reads(spark, sf), "u1", _notices(spark, sf), "2024-06-02")


@add(f"WITH {_TOP}, one AS (SELECT patient_id FROM top ORDER BY patient_id LIMIT 1) SELECT count(*) FILTER (WHERE patient_id NOT IN (SELECT patient_id FROM one)) AS unread FROM top")
def notices_one_marked(spark, sf):
    first = _notices(spark, sf).orderBy("patient_id").limit(1)
    return S.unread(_notices(spark, sf), S.mark_read(_reads(spark, sf).limit(0), "u9", first, "2024-06-02"), "u9")


# The feature store, the log, the registry.


def _days(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    daily = e.groupBy(F.col("user_id").alias("patient_id"), "day").agg(F.max("event_id").cast("double").alias("x"))
    return daily.select("patient_id", F.concat("day", F.lit("T08:00:00")).alias("feature_timestamp"), "x")


def _store(spark, sf):
    """Daily features of users under 50, those of user 7 replaced later in the same days, user 9 erased."""
    store = S.FeatureStore(spark, _place(spark, "features"))
    rows = _days(spark, sf).where("patient_id < 50")
    store.upsert(rows)
    store.upsert(rows.where("patient_id = 7").select("patient_id", F.replace("feature_timestamp", F.lit("T08"), F.lit("T09")).alias("feature_timestamp"), (-F.col("x")).alias("x"), F.lit(1).alias("later")))
    store.erase(9)
    return store


_KEPT = "f AS (SELECT user_id AS patient_id, strftime(ts, '%Y-%m-%d') AS day, CAST(max(event_id) AS DOUBLE) AS m FROM events WHERE user_id < 50 AND user_id <> 9 GROUP BY ALL)"


@add(f"WITH {_KEPT} SELECT patient_id, day || CASE WHEN patient_id = 7 THEN 'T09:00:00' ELSE 'T08:00:00' END AS feature_timestamp, CASE WHEN patient_id = 7 THEN -m ELSE m END AS x, CASE WHEN patient_id = 7 THEN 1 END AS later FROM f")
def feature_store_rows(spark, sf):
    return _store(spark, sf).all().select("patient_id", "feature_timestamp", "x", "later")


@add(f"WITH {_KEPT} SELECT count(DISTINCT patient_id) AS patients, count(*) AS n_rows, count(DISTINCT day) AS days, CAST(2 AS INTEGER) AS features FROM f")
def feature_store_stats(spark, sf):
    return _store(spark, sf).stats().select("patients", "n_rows", F.size("dates").cast("long").alias("days"), "features")


@add(f"WITH {_KEPT} SELECT DISTINCT patient_id FROM f")
def feature_store_patients(spark, sf):
    return _store(spark, sf).patients()


@add(f"WITH {_KEPT} SELECT patient_id, max(day) AS day FROM f WHERE patient_id IN (3, 7, 9, 1000) GROUP BY patient_id")
def feature_store_batch(spark, sf):
    wanted = spark.createDataFrame([(3,), (7,), (9,), (1000,)], "patient_id long")
    return _store(spark, sf).batch(wanted).select("patient_id", F.substring("feature_timestamp", 1, 10).alias("day"))


@add("SELECT event_id, user_id AS patient FROM events WHERE user_id = 42")
def audit_log_written(spark, sf):
    e = table(spark, sf, "events")
    path = _place(spark, "log")
    text = lambda x: F.lit(x)
    rows = e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), text("u").alias("user_id"), F.col("user_id").alias("patient_id"), text("Patient").alias("resource_type"), F.col("event_type").alias("operation"), text("care").alias("justification"))
    S.append_log(rows.where("event_id % 2 = 0"), path)
    S.append_log(rows.where("event_id % 2 = 1"), path)
    return S.log_of_patient(spark.read.parquet(path), 42).select("event_id", "patient")


def _registry(spark, sf):
    """Parts as models of five brands, versions in the order of their keys."""
    p = table(spark, sf, "part")
    stage = F.when(F.col("p_partkey") % 4 == 0, "production").otherwise("staging")
    return p.select(F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("version"), stage.alias("stage"), F.lit("c").alias("checksum"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("registered_at"), F.lit("p").alias("path"))


@add("SELECT p_brand AS name, count(*) AS n, CAST(max(p_partkey) AS VARCHAR) AS latest FROM part GROUP BY p_brand")
def registry_listed(spark, sf):
    return S.listed(_registry(spark, sf)).select("name", F.size("versions").cast("long").alias("n"), "latest")


@add("SELECT CAST(max(p_partkey) AS VARCHAR) AS version FROM part WHERE p_brand = 'Brand#11' HAVING count(*) > 0")
def registry_latest(spark, sf):
    return S.get_version(_registry(spark, sf), "Brand#11").select("version")


@add("SELECT CAST(p_partkey AS VARCHAR) AS version FROM part WHERE p_brand = 'Brand#11' AND p_partkey % 4 = 0")
def registry_in_production(spark, sf):
    return S.versions(_registry(spark, sf), "Brand#11", "production").select("version")


@add("SELECT CAST(p_partkey AS VARCHAR) AS version, CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part WHERE p_brand = 'Brand#11') THEN 'production' WHEN p_partkey % 4 = 0 THEN 'archived' ELSE 'staging' END AS stage FROM part WHERE p_brand = 'Brand#11'")
def registry_promoted(spark, sf):
    r = _registry(spark, sf)
    last = S.get_version(r, "Brand#11").first()
    moved = S.promote(r, "Brand#11", last.version, "production") if last else r
    return moved.where("name = 'Brand#11'").select("version", "stage")


@add("SELECT 'ok' AS status, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'changed', 1 UNION ALL SELECT 'missing', 1")
def artifacts_verified(spark, sf):
    path = _place(spark, "artifacts")
    for name, rows in (("a", "region"), ("b", "nation")):
        table(spark, sf, rows).coalesce(1).write.parquet(f"{path}/{name}")
    have = S.checksums(spark, path).where(F.endswith("path", F.lit(".parquet"))).select("path", "sha256")
    known = have.select(F.element_at(F.split("path", "/artifacts-[0-9a-f]+/"), -1).alias("file"), "sha256")
    wanted = known.withColumn("sha256", F.when(F.startswith("file", F.lit("a/")), F.col("sha256")).otherwise("other")).unionByName(spark.createDataFrame([("c", "x")], "file string, sha256 string"))
    return S.verified(spark, path, wanted).where("status <> 'unregistered'").groupBy("status").agg(F.count("*").alias("n"))


# Files and resources.


@add("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tables_saved_and_loaded(spark, sf):
    rows, path, out = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), _place(spark, "saved"), None
    for form in ("csv", "parquet", "json"):
        files.save(rows, f"{path}/t.{form}")
        got = files.load(spark, f"{path}/t.{form}", lines=True)
        got = got.select(*(F.col(c).cast(k).alias(c) for c, k in rows.dtypes))
        out = got if out is None else out.unionByName(got)
    return out


@add("SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS name FROM customer")
def batch_of_patients_loaded(spark, sf):
    path = _place(spark, "batch") + "/patients.jsonl"
    table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_name").alias("name")).write.json(path)
    return files.load_batch(spark, path).select("patient_id", "name")


@add("SELECT CAST(2 AS BIGINT) AS n")
def files_found(spark, sf):
    path = _place(spark, "tree")
    for name in ("a", "b/c"):
        table(spark, sf, "region").coalesce(1).write.csv(f"{path}/{name}")
    return files.find(spark, path, "*.csv").agg(F.count("*").alias("n"))


@add("SELECT 'Patient' AS resource_type, count(*) AS n FROM customer UNION ALL SELECT 'Condition', count(*) FROM orders WHERE o_orderkey % 5 = 0")
def resources_exported(spark, sf):
    path, out = _place(spark, "export"), None
    for kind in files.export(resources(spark, sf), path, ["Patient", "Condition", "Device"]):
        rows = fhir.read_ndjson(spark, f"{path}/{kind}").groupBy("resource_type").agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@add("SELECT count(*) AS n FROM customer")
def bundles_that_are_none_left_out(spark, sf):
    b = bundles(spark, sf)
    bad = b.withColumn("bundle", F.when(F.col("bundle_id").cast("long") % 2 == 0, '{"resourceType":"Patient"}').otherwise(F.lit("no json")))
    return fhir.resources(b.unionByName(bad), strict=False).where("resource_type = 'Patient'").agg(F.count("*").alias("n"))


@add("""SELECT CAST(o_orderkey AS VARCHAR) AS procedure_id, CAST(o_custkey AS VARCHAR) AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS performed_date, o_orderpriority AS code, 'http://snomed.info/sct' AS system, lower(o_orderpriority) AS display,
    'Surgical' AS category, o_clerk AS performer, 'completed' AS status FROM orders WHERE o_orderkey % 3 = 0""".replace("o_clerk", "'Dr ' || CAST(o_custkey % 7 AS VARCHAR)"))
def fhir_flatten_procedures(spark, sf):
    o, day, who = table(spark, sf, "orders").where("o_orderkey % 3 = 0"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("Dr "), (F.col("o_custkey") % 7).cast("string"))
    made = [
        F.lit("completed").alias("status"), _subject(F.col("o_custkey")), _code(F.col("o_orderpriority"), F.lower("o_orderpriority"), "http://snomed.info/sct").alias("code"), _code(F.lit("387713003"), F.lit("Surgical")).alias("category"),
        F.when(F.col("o_orderkey") % 2 == 0, day).alias("performedDateTime"), F.when(F.col("o_orderkey") % 2 == 1, F.struct(day.alias("start"))).alias("performedPeriod"), F.array(F.struct(F.struct(who.alias("display")).alias("actor"))).alias("performer"),
    ]
    return fhir.procedures(o.select(*_row("Procedure", F.col("o_orderkey").cast("string"), made)))


@add("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'changed' ELSE 'kept' END AS status, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'added', CAST(1 AS BIGINT)")
def resources_upserted(spark, sf):
    rows = fhir.search(resources(spark, sf), "Encounter")
    new = rows.where("CAST(id AS BIGINT) % 2 = 0").withColumn("resource", F.lit("{}")).unionByName(spark.createDataFrame([("Encounter", "new", "[]")], "resource_type string, id string, resource string"))
    status = F.when(F.col("resource") == "{}", "changed").when(F.col("resource") == "[]", "added").otherwise("kept")
    return fhir.upsert(new, rows).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@add("""SELECT CAST(u.c_custkey AS VARCHAR) AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender, kind, n FROM customer u JOIN
    (SELECT user_id AS k, 'observation' AS kind, count(*) AS n FROM events GROUP BY user_id UNION ALL SELECT o_custkey, 'condition', count(*) FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey UNION ALL SELECT o_custkey, 'medication', count(*) FROM orders WHERE o_orderkey % 7 = 0 GROUP BY o_custkey) ON k = c_custkey""")
def patients_joined_with_records(spark, sf):
    return etl.joined(resources(spark, sf)).groupBy("patient_id", "gender", "kind").agg(F.count("*").alias("n"))


@add("SELECT count(*) AS patients FROM customer")
def clinical_etl_written(spark, sf):
    path = _place(spark, "etl")
    etl.run(resources(spark, sf), path, "click")
    return spark.read.parquet(path).agg(F.count_distinct("patient_id").alias("patients"))


@add("""SELECT '{"key":' || CAST(l_orderkey AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ',"half":' || CAST(CAST(l_linenumber AS DOUBLE) / 2 AS VARCHAR) END || '}' AS json FROM lineitem""")
def report_rows_as_json(spark, sf):
    half = F.when(F.col("l_linenumber") % 3 == 0, F.when(F.col("l_orderkey") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("l_linenumber") / 2.0)
    return files.as_report(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), half.alias("half")))


@add("SELECT event_type, round(avg(CASE WHEN event_id % 7 <> 0 THEN value END), 6) AS mean, count(CASE WHEN event_id % 7 <> 0 THEN value END) AS n FROM events GROUP BY event_type")
def means_without_nan(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(float("nan")))
    return rounded(nan_to_null(e).groupBy("event_type").agg(F.avg("value").alias("mean"), F.count("value").alias("n")), "mean")


@add("SELECT 'START' AS event, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'COMPLETE', 1")
def lineage_events(spark, sf):
    path = _place(spark, "lineage")
    with lineage.Run(spark, "job", path) as run:
        run.watch(table(spark, sf, "region"), "region").write.parquet(_place(spark, "copied"))
    return spark.read.text(path).groupBy(F.get_json_object("value", "$.eventType").alias("event")).agg(F.count("*").alias("n"))


# Reports, dates and texts.


@add("SELECT user_id AS patient_id, event_id, CAST(k AS INTEGER) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3")
def top_three_events(spark, sf):
    return E.top_values(table(spark, sf, "events").select(F.col("user_id").alias("patient_id"), "event_id"), ["patient_id"], "event_id", 3)


@add(f"WITH {PREDICTIONS_SQL}, r AS (SELECT g, avg(p) AS m, avg(CAST(p >= 0.5 AS INTEGER)) AS r, count(*) AS n FROM pred GROUP BY g) SELECT g, round_even(m, 3) AS mean_prediction, round_even(r, 3) AS positive_rate, n, round_even((SELECT max(r) - min(r) FROM r), 3) AS disparity FROM r")
def group_statistics(spark, sf):
    return E.group_stats(predictions(spark, sf), "g", "p")


@add("SELECT doc_id FROM documents WHERE regexp_matches(text, 'License') ORDER BY doc_id LIMIT 10")
def log_evidence(spark, sf):
    return O.evidence(table(spark, sf, "documents"), "License", "doc_id").select("doc_id")


_LINE = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%m-%d-%Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'no date' END"


@add("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 4 OR CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def log_lines_in_range(spark, sf):
    day = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 5
    line = F.when(k == 0, day("yyyy-MM-dd")).when(k == 1, day("MM/dd/yyyy")).when(k == 2, day("MM-dd-yyyy")).when(k == 3, day("yyyy/MM/dd")).otherwise("no date")
    rows = table(spark, sf, "orders").withColumn("line", F.concat(F.lit("at "), line, F.lit(" done")))
    return rows.where(O.in_range(F.col("line"), "1995-01-01", "1996-06-30")).select("o_orderkey")


@add("SELECT c_custkey, 'from [IP] by [EMAIL] user=[USER] patient_id=[PATIENT] on ' || c_mktsegment AS line FROM customer")
def report_lines_anonymised(spark, sf):
    key = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("from 10.0."), (F.col("c_custkey") % 250).cast("string"), F.lit(".7 by a"), key, F.lit("@x.org user: u"), key, F.lit(" patient_id="), key, F.lit(" on "), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", O.anonymised(line).alias("line"))


@add("SELECT o_orderkey, d - 1 AS day, d - 7 AS week, CAST(d - INTERVAL 1 MONTH AS DATE) AS month, CAST(d - INTERVAL 3 MONTH AS DATE) AS quarter, CAST(d - INTERVAL 12 MONTH AS DATE) AS year FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def period_starts(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", *(O.period_start(d, p).alias(p) for p in ("day", "week", "month", "quarter", "year")))


_IDS = ("hipaa-164-308-a", "gdpr-article-5-1", "hitech-13403", "other")


def _remedy_sql():
    texts = ("'Implement administrative safeguards for ' || c_name || ' by updating security policies and procedures.'", "'Ensure compliance with data processing principles for ' || c_name || ' by updating privacy policies.'")
    texts += ("'Enhance breach reporting mechanisms for ' || c_name || ' by establishing clear reporting channels.'", "'Review and update policies and procedures related to ' || c_name || ' to ensure compliance.'")
    return "SELECT c_custkey, CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END AS remedy FROM customer"


@add(_remedy_sql())
def control_remedies(spark, sf):
    id_ = F.element_at(F.array(*map(F.lit, _IDS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", O.remedy(id_, F.col("c_name")).alias("remedy"))


@add("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE date_part('year', age(DATE '2024-03-01', CAST(o_orderdate AS DATE))) END AS INTEGER) AS age FROM orders")
def ages_on_a_day(spark, sf):
    born = F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", V.age_on(born, "2024-03-01").alias("age"))


@add("""SELECT column_name AS name FROM (DESCRIBE orders) WHERE column_type LIKE 'DATE%' OR column_type LIKE 'TIMESTAMP%'
    UNION ALL SELECT name FROM (SELECT 'o_orderstatus' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT 'written', CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END FROM orders)
    GROUP BY name HAVING bool_or(coalesce(regexp_matches(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), false))""")
def date_columns_found(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("written"))
    return spark.createDataFrame([(c,) for c in V.date_columns(rows)], "name string")


@add("SELECT CAST(1 AS BIGINT) AS columns_before, CAST(0 AS BIGINT) AS columns_after, TRUE AS passed")
def deidentification_gate(spark, sf):
    before = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("@example.org")).alias("contact"))
    return V.deidentification_gate(before, before.withColumn("contact", F.lit("[REDACTED]")), "n_nationkey", "n_nationkey")


@add("SELECT count(*) AS n, TRUE AS in_range FROM part")
def mock_metrics_in_range(spark, sf):
    m = O.mock_metrics(table(spark, sf, "part"), "p_partkey")
    return m.agg(F.count("*").alias("n"), F.bool_and(F.col("accuracy").between(0.8, 0.95) & F.col("c_index").between(0.7, 0.9)).alias("in_range"))


# Scores.

_SHIFTED = "CASE WHEN g = 'en' THEN 0.3 WHEN g = 'de' THEN 0.6 ELSE 0.5 END"


@add(f"WITH {PREDICTIONS_SQL} SELECT g, count(*) FILTER (WHERE p - {_SHIFTED} + 0.5 >= 0.5) AS n FROM pred GROUP BY g")
def scores_at_group_thresholds(spark, sf):
    t = spark.createDataFrame([("en", 0.3), ("de", 0.6)], "g string, threshold double")
    return Q.rescored(predictions(spark, sf), "g", t).groupBy("g").agg(F.count_if(F.col("p") >= 0.5).alias("n"))


def _effect_sql(numerator, denominator):
    rate = f"coalesce(count(*) FILTER (WHERE {{p}} >= 0.5{numerator}) / CAST(nullif(count(*){denominator}, 0) AS DOUBLE), 0)"
    return f"""WITH {PREDICTIONS_SQL}, m AS (SELECT g, avg(p) AS own, (SELECT avg(p) FROM pred) AS mean FROM pred GROUP BY g),
    q AS (SELECT pred.*, greatest(0, least(1, p * CASE WHEN own > 0 AND abs(own - mean) > 1e-9 THEN (0.8::DOUBLE * mean + 0.2::DOUBLE * own) / own ELSE 1 END)) AS p2 FROM pred JOIN m USING (g)),
    r AS (SELECT g, {rate.format(p="p")} AS a, {rate.format(p="p2")} AS b FROM q GROUP BY g) SELECT round(max(a) - min(a), 6) AS fairness_before, round(least(max(a) - min(a), max(b) - min(b)), 6) AS fairness_after FROM r"""


@add(_effect_sql("", ""))
def reweighting_effect_on_parity(spark, sf):
    return rounded(Q.reweighting_effect(predictions(spark, sf), "g"), "fairness_before", "fairness_after")


@add(_effect_sql(" AND y = 1", " FILTER (WHERE y = 1)"))
def reweighting_effect_on_opportunity(spark, sf):
    return rounded(Q.reweighting_effect(predictions(spark, sf), "g", "equal_opportunity"), "fairness_before", "fairness_after")


@add("SELECT toxic, n, CAST(ceil(0.3 * (n - 1)) AS BIGINT) AS test FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)")
def train_test_sizes(spark, sf):
    parts = quality.split(table(spark, sf, "labels"), "doc_id", 0.3, "toxic")
    return parts.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "test").alias("test"))


@add("SELECT CAST(g AS DOUBLE) AS size, round(avg(1 / (1 + pow(2.718281828459045::DOUBLE, -((g + p_retailprice / 20) / 40 - 3)))), 6) AS mean_score FROM part, (VALUES (10), (30)) t(g) GROUP BY g")
def partial_dependence_on_size(spark, sf):
    logit = (F.col("size") + F.col("price")) / 40 - 3
    return rounded(M.partial_dependence(_parts(spark, sf), "size", [10.0, 30.0], lambda d: d.withColumn("score", 1 / (1 + F.pow(F.lit(2.718281828459045), -logit)))), "mean_score")


@add("SELECT CAST(p_partkey AS VARCHAR) AS key, 'size' AS a, 'price' AS b, round(p_size * (p_retailprice / 20) / 2, 4) AS value FROM part")
def shap_interactions_of_a_product(spark, sf):
    import numpy as np

    return rounded(M.interactions(_parts(spark, sf), ["size", "price"], lambda x: x[:, 0] * x[:, 1], np.zeros((1, 2)), "patient_id"), "value", at=4)


@add("SELECT 'size' AS feature, TRUE AS matters UNION ALL SELECT 'price', FALSE")
def permutation_importances(spark, sf):
    score = lambda d: d.withColumn("score", F.col("size"))
    metric = lambda d: -d.agg(F.avg(F.abs(F.col("score") - F.col("truth")))).first()[0]
    rows = _parts(spark, sf).withColumn("truth", F.col("size"))
    return spark.createDataFrame([(f, bool(v > 0)) for f, v in M.permutation_importance(rows, ["size", "price"], score, metric, "patient_id")], "feature string, matters boolean")


# Streams.

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@add("SELECT event_id, event_type FROM events")
def stream_appended_log(spark, sf):
    path = _place(spark, "stream-log")
    streams.appended(streams.read(spark, sf, _EVENTS, "events.parquet"), path, _place(spark, "stream")).awaitTermination()
    return spark.read.parquet(path).select("event_id", "event_type")


@add("SELECT user_id AS patient_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(value, ts) AS value FROM events GROUP BY ALL")
def stream_upserted_features(spark, sf):
    store = S.FeatureStore(spark, _place(spark, "stream-features"))
    rows = streams.read(spark, sf, _EVENTS, "events.parquet").select(F.col("user_id").alias("patient_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("feature_timestamp"), "value")
    streams.upserted(rows, store, _place(spark, "stream")).awaitTermination()
    return store.all().select("patient_id", F.col("feature_date").alias("day"), "value")


@add("SELECT event_type, count(*) AS n, CASE WHEN abs(avg(coalesce(value, 0)) - 50) / 50 > 0.02 THEN 'Drift' ELSE 'Stable' END AS status FROM events GROUP BY event_type")
def stream_drift_states(spark, sf):
    name = f"drift_{uuid.uuid4().hex}"
    states = streams.drift_states(streams.read(spark, sf, _EVENTS, "events.parquet"), "event_type", 50.0, 0.02)
    states.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", _place(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("event_type", "n", "status")


@add("SELECT 'masked' AS kind, CAST((SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) + (SELECT count(*) FROM orders WHERE o_custkey % 2 = 0) + (SELECT count(*) FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 5 = 0) AS BIGINT) AS n UNION ALL SELECT 'refused', count(*) FROM customer WHERE c_custkey % 2 = 1")
def stream_deidentified(spark, sf):
    path, out, bad = (_place(spark, x) for x in ("bundles", "masked", "refused"))
    b = bundles(spark, sf)
    b.withColumn("bundle", F.when(F.col("bundle_id").cast("long") % 2 == 1, "broken").otherwise(F.col("bundle"))).write.parquet(path)
    streams.deidentified(streams.read(spark, path, "bundle_id string, bundle string"), Deidentification("s"), out, bad, _place(spark, "stream")).awaitTermination()
    count = lambda p, kind: spark.read.parquet(p).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(out, "masked").unionByName(count(bad, "refused"))


@add(f"""WITH {ENCOUNTERS_SQL}, b AS (SELECT max(encounter_id) AS newest FROM enc GROUP BY encounter_id % 5)
    SELECT CASE WHEN count(*) FILTER (WHERE newest % 5 = 2) > 0 THEN 'Age Drift' ELSE 'Stable' END AS status FROM b""")
def sticky_drift_status(spark, sf):
    days = encounters(spark, sf).groupBy(F.col("encounter_id") % 5).agg(F.max("encounter_id").alias("at"))
    batches = days.select("at", F.when(F.col("at") % 5 == 2, "Age Drift").otherwise("Stable").alias("status"))
    return O.sticky(batches, "at")
