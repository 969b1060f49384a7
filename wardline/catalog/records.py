"""Queries of FHIR resources: made of the test tables as JSON, flattened and mapped to OMOP."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.frames import Catalog, table
from wardline.operators.privacy import Deidentification, deidentify_bundles
from wardline.sources import fhir as R

CATALOG = Catalog()
add = CATALOG.add


def _row(kind, id_, made):
    return (F.lit(kind).alias("resource_type"), id_.alias("id"), F.to_json(F.struct(F.lit(kind).alias("resourceType"), id_.alias("id"), *made)).alias("resource"))


def _code(code, display, system="http://loinc.org"):
    return F.struct(F.array(F.struct(F.lit(system).alias("system"), code.alias("code"), display.alias("display"))).alias("coding"))


def _subject(c):
    return F.struct(F.concat(F.lit("Patient/"), c.cast("string")).alias("reference")).alias("subject")


def resources(spark, sf):
    """Customers as patients, events as observations, orders as encounters and conditions, line items as medication requests."""
    c, e, o = table(spark, sf, "customer"), table(spark, sf, "events"), table(spark, sf, "orders")
    p = c.select(*_row("Patient", F.col("c_custkey").cast("string"), [
        F.array(F.struct(F.col("c_name").alias("family"), F.array(F.lit("A"), F.lit("B")).alias("given"))).alias("name"), F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("gender"), F.lit("1960-05-01").alias("birthDate"),
        F.when(F.col("c_custkey") % 3 != 0, F.array(F.struct(F.lit("phone").alias("system"), F.concat(F.lit("555-"), F.col("c_custkey").cast("string")).alias("value")))).alias("telecom"),
    ]))
    kind = F.col("event_id") % 4
    obs = e.select(*_row("Observation", F.col("event_id").cast("string"), [
        F.lit("final").alias("status"), _code(F.col("event_type"), F.upper("event_type")).alias("code"), _subject(F.col("user_id")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("effectiveDateTime"),
        F.array(_code(F.lit("laboratory"), F.lit("Laboratory"))).alias("category"),
        F.when(kind == 0, F.struct(F.col("value").alias("value"), F.lit("mg").alias("unit"))).alias("valueQuantity"), F.when(kind == 1, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("valueString"), F.when(kind == 2, F.col("event_id") % 3 == 0).alias("valueBoolean"),
        F.when(kind == 3, F.array(F.struct(_code(F.lit("sys"), F.lit("Systolic")).alias("code"), F.struct(F.col("value").alias("value"), F.lit("mmHg").alias("unit")).alias("valueQuantity")), F.struct(_code(F.lit("none"), F.lit("None")).alias("code"), F.lit(None).cast("struct<value:double,unit:string>").alias("valueQuantity")))).alias("component"),
    ]))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    enc = o.select(*_row("Encounter", F.col("o_orderkey").cast("string"), [F.lower("o_orderstatus").alias("status"), _subject(F.col("o_custkey")), F.struct(day.alias("start")).alias("period"), F.array(_code(F.col("o_orderpriority"), F.lower("o_orderpriority"))).alias("type")]))
    con = o.where("o_orderkey % 5 = 0").select(*_row("Condition", F.col("o_orderkey").cast("string"), [_code(F.lit("I10"), F.lit("Hypertension"), "http://hl7.org/fhir/sid/icd-10").alias("code"), _subject(F.col("o_custkey")), F.when(F.col("o_orderkey") % 2 == 0, day).alias("onsetDateTime"), F.when(F.col("o_orderkey") % 2 == 1, F.struct(day.alias("start"))).alias("onsetPeriod"), day.alias("recordedDate")]))
    med = o.where("o_orderkey % 7 = 0").select(*_row("MedicationRequest", F.col("o_orderkey").cast("string"), [F.lit("active").alias("status"), _subject(F.col("o_custkey")), day.alias("authoredOn"), _code(F.lit("860975"), F.lit("Metformin"), "rx").alias("medicationCodeableConcept"), F.array(F.struct(F.lit("twice daily").alias("text"))).alias("dosageInstruction")]))
    return p.unionByName(obs).unionByName(enc).unionByName(con).unionByName(med)


def bundles(spark, sf):
    """Patients with their encounters as one bundle each."""
    rows = resources(spark, sf).where("resource_type IN ('Patient', 'Encounter', 'Condition')")
    owner = F.when(F.col("resource_type") == "Patient", F.col("id")).otherwise(F.regexp_replace(F.get_json_object("resource", "$.subject.reference"), "^Patient/", ""))
    lists = rows.groupBy(owner.alias("bundle_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("resource")), lambda r: F.concat(F.lit('{"resource":'), r, F.lit("}"))), ",").alias("e"))
    return lists.select("bundle_id", F.concat(F.lit('{"resourceType":"Bundle","entry":['), "e", F.lit("]}")).alias("bundle"))


@add("SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS family_name, 'A B' AS given_name, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender, '1960-05-01' AS birth_date, '' AS address_line, '' AS city, '' AS state, '' AS postal_code, '' AS country, CASE WHEN c_custkey % 3 <> 0 THEN '555-' || CAST(c_custkey AS VARCHAR) ELSE '' END AS phone, '' AS email, '' AS mrn, '' AS ssn FROM customer")
def fhir_flatten_patients(spark, sf):
    return R.patients(resources(spark, sf))


@add("""SELECT CAST(event_id AS VARCHAR) AS observation_id, CAST(user_id AS VARCHAR) AS patient_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date, event_type || CASE WHEN event_id % 4 = 3 THEN '.sys' ELSE '' END AS code, 'http://loinc.org' AS system,
    upper(event_type) || CASE WHEN event_id % 4 = 3 THEN ' - Systolic' ELSE '' END AS display, CASE event_id % 4 WHEN 1 THEN 'string' WHEN 2 THEN 'boolean' ELSE 'quantity' END AS value_type, CASE event_id % 4 WHEN 0 THEN 'mg' WHEN 3 THEN 'mmHg' END AS unit, CASE WHEN event_id % 4 IN (0, 3) THEN value END AS value_num, 'final' AS status FROM events""")
def fhir_flatten_observations(spark, sf):
    return R.observations(resources(spark, sf)).drop("value")


@add("SELECT CAST(o_orderkey AS VARCHAR) AS condition_id, CAST(o_custkey AS VARCHAR) AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS onset_date, '' AS abatement_date, 'I10' AS code, 'http://hl7.org/fhir/sid/icd-10' AS system, 'Hypertension' AS display, '' AS severity, '' AS category, '' AS clinical_status, '' AS verification_status FROM orders WHERE o_orderkey % 5 = 0")
def fhir_flatten_conditions(spark, sf):
    return R.conditions(resources(spark, sf))


@add("SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id, CAST(o_custkey AS VARCHAR) AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS start_date, '' AS end_date, o_orderpriority AS type_code, lower(o_orderpriority) AS type_display, '' AS class_code, '' AS class_display, '' AS location, '' AS service_provider, lower(o_orderstatus) AS status FROM orders")
def fhir_flatten_encounters(spark, sf):
    return R.encounters(resources(spark, sf))


@add("SELECT CAST(o_orderkey AS VARCHAR) AS medication_id, CAST(o_custkey AS VARCHAR) AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS authored_date, '' AS medication_reference, 'Metformin' AS medication_display, '860975' AS code, 'rx' AS system, 'twice daily' AS dosage_text, '' AS dose, '' AS frequency, '' AS route, 'active' AS status FROM orders WHERE o_orderkey % 7 = 0")
def fhir_flatten_medications(spark, sf):
    return R.medications(resources(spark, sf))


@add("SELECT CAST(c_custkey AS VARCHAR) AS person_id, CAST(CASE WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS INTEGER) AS gender_concept_id, '1960-05-01' AS birth_datetime FROM customer")
def omop_person(spark, sf):
    return R.omop(resources(spark, sf))["person"]


@add("SELECT CAST(o_custkey AS VARCHAR) AS person_id, 'I10' AS condition_source_value, strftime(o_orderdate, '%Y-%m-%d') AS condition_start_date FROM orders WHERE o_orderkey % 5 = 0")
def omop_condition_occurrence(spark, sf):
    return R.omop(resources(spark, sf))["condition_occurrence"]


@add("SELECT CAST(o_custkey AS VARCHAR) AS person_id, 'Metformin' AS drug_source_value, '860975' AS drug_source_concept_id FROM orders WHERE o_orderkey % 7 = 0")
def omop_drug_exposure(spark, sf):
    return R.omop(resources(spark, sf))["drug_exposure"]


@add("SELECT CAST(user_id AS VARCHAR) AS person_id, event_type AS observation_source_value, CASE WHEN event_id % 4 = 0 THEN value END AS value_as_number, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS observation_date FROM events")
def omop_observation(spark, sf):
    return R.omop(resources(spark, sf))["observation"]


@add("SELECT CAST(c_custkey AS VARCHAR) AS patient_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 = 0) AS n_events, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_labs, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 = 0) AS n_medications FROM customer")
def patient_records(spark, sf):
    r = R.patient_records(resources(spark, sf))
    return r.select("patient_id", *(F.size(c).cast("long").alias(n) for c, n in (("clinical_events", "n_events"), ("lab_results", "n_labs"), ("medications", "n_medications"))))


@add("SELECT CAST(o_custkey AS VARCHAR) AS patient_id, count(*) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT CAST(c_custkey AS VARCHAR), 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def bundle_resources(spark, sf):
    rows = R.resources(bundles(spark, sf))
    owner = F.when(F.col("resource_type") == "Patient", F.col("id")).otherwise(F.regexp_replace(F.get_json_object("resource", "$.subject.reference"), "^Patient/", ""))
    return rows.groupBy(owner.alias("patient_id")).agg(F.count_if(F.col("resource_type") == "Encounter").alias("n"))


@add("SELECT 'created' AS status, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS n FROM orders UNION ALL SELECT 'updated', count(*) FILTER (WHERE o_orderkey % 2 = 0) FROM orders")
def bulk_import_status(spark, sf):
    rows = R.search(resources(spark, sf), "Encounter")
    return R.import_status(rows, rows.where(F.col("id").cast("long") % 2 == 0))


@add("SELECT 'Patient' AS resource_type, count(*) AS n FROM customer UNION ALL SELECT 'Encounter', count(*) FROM orders UNION ALL SELECT 'Condition', count(*) FROM orders WHERE o_orderkey % 5 = 0")
def deidentified_bundles(spark, sf):
    return deidentify_bundles(bundles(spark, sf), Deidentification("s")).where("error IS NULL").groupBy("resource_type").agg(F.count("*").alias("n"))


@add("SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS family_name, CASE WHEN c_custkey % 3 <> 0 THEN '555-' || CAST(c_custkey AS VARCHAR) ELSE '' END AS phone FROM customer")
def patients_round_trip(spark, sf):
    flat = R.patients(resources(spark, sf))
    return R.patients(R.from_patients(flat)).select("patient_id", "family_name", "phone")


@add("SELECT CAST(event_id AS VARCHAR) AS observation_id, CASE WHEN event_id % 4 IN (0, 3) THEN value END AS value_num FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT CAST(event_id AS VARCHAR), value FROM events WHERE event_id % 4 = 3")
def observations_round_trip(spark, sf):
    flat = R.observations(resources(spark, sf))
    return R.observations(R.from_observations(flat)).select("observation_id", "value_num")


@add("SELECT CAST(o_orderkey AS VARCHAR) AS condition_id, strftime(o_orderdate, '%Y-%m-%d') AS onset_date, 'I10' AS code FROM orders WHERE o_orderkey % 5 = 0")
def conditions_round_trip(spark, sf):
    return R.conditions(R.from_conditions(R.conditions(resources(spark, sf)))).select("condition_id", "onset_date", "code")
