"""Synthetic cohorts, derived from row numbers and a seed by hashing: the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = ("I10", "E11", "J44", "I50", "N18", "F32", "E66", "J45")
DRUGS = ("Lisinopril", "Metformin", "Albuterol", "Furosemide", "Sertraline", "Atorvastatin")


def uniform(seed: int, salt: str) -> Column:
    return F.pmod(F.xxhash64("n", F.lit(seed), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0


def _pick(values: tuple, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def _normal(seed: int, salt: str) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, salt + "a") * 0.999998 + 1e-6)) * F.cos(6.283185307179586 * uniform(seed, salt + "b"))


def encounters(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` patients with an encounter each: demographics, codes and drugs as pipe lists, stay, outcomes, two labs."""
    u = lambda s: uniform(seed, s)
    stay = (1 + F.floor(-4 * F.ln(u("stay") * 0.999 + 0.001))).cast("int")
    admitted = F.date_add(F.lit("2023-01-01").cast("date"), F.floor(u("day") * 365).cast("int"))
    age = (18 + F.floor(u("age") * 77)).cast("int")
    lists = lambda values, s: F.array_join(F.array_distinct(F.array(*(_pick(values, u(f"{s}{i}")) for i in range(3)))), "|")
    return spark.range(n).withColumnRenamed("id", "n").select(
        F.format_string("P%06d", "n").alias("patient_id"), F.concat(F.lit("Patient "), F.col("n").cast("string")).alias("name"), age.alias("age"), _pick(("M", "F"), u("sex")).alias("gender"),
        F.date_sub(admitted, F.floor(age * 365.25).cast("int")).alias("birth_date"), lists(CODES, "dx").alias("diagnoses"), lists(DRUGS, "rx").alias("medications"), admitted.alias("admission_date"),
        F.date_add(admitted, stay).alias("discharge_date"), stay.alias("length_of_stay"), (u("back") < 0.15).cast("int").alias("readmission_30d"), (u("dead") < 0.03).cast("int").alias("in_hospital_mortality"),
        F.round(F.greatest(F.lit(0.3), 1.0 + 0.4 * _normal(seed, "cr")), 2).alias("creatinine"), F.round(F.greatest(F.lit(4.0), 6.2 + 1.1 * _normal(seed, "a1c")), 1).alias("hba1c"),
    )


def cohort(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """A wide cohort for exploration: demographics, insurance, diagnosis, counts, labs, pressure and outcomes tied to them."""
    u = lambda s: uniform(seed, s)
    base = encounters(spark, n, seed).select("patient_id", "age", "gender", "admission_date", "discharge_date", "length_of_stay", "hba1c", F.xxhash64("patient_id").alias("n"))
    many = (F.floor(u("comorbid") * 6)).cast("int")
    risk = 0.05 + 0.04 * many + F.when(F.col("age") > 75, 0.1).otherwise(0.0)
    return base.select(
        "patient_id", "age", "gender", _pick(("White", "Black", "Asian", "Hispanic", "Other"), u("race")).alias("race"), "admission_date", "discharge_date", "length_of_stay", _pick(("Medicare", "Medicaid", "Private"), u("payer")).alias("insurance_type"),
        _pick(CODES, u("dx0")).alias("primary_diagnosis_code"), many.alias("comorbidity_count"), (1 + F.floor(u("drugs") * 10)).cast("int").alias("medication_count"), "hba1c", F.round(130 + 18 * _normal(seed, "sbp")).cast("int").alias("systolic_bp"),
        F.round(80 + 10 * _normal(seed, "dbp")).cast("int").alias("diastolic_bp"), (u("r30") < risk).cast("int").alias("readmission_30d"), (u("died") < risk / 4).cast("int").alias("mortality"),
    )


def bundles(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """A bundle for each of ``n`` patients: the patient, one to three conditions, seven observations."""
    rows = encounters(spark, n, seed)
    code = lambda c, system: F.struct(F.array(F.struct(F.lit(system).alias("system"), c.alias("code"), c.alias("display"))).alias("coding")).alias("code")
    subject = F.struct(F.concat(F.lit("Patient/"), "patient_id").alias("reference")).alias("subject")
    patient = F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.col("patient_id").alias("id"), F.col("gender"), F.col("birth_date").cast("string").alias("birthDate")))
    conditions = F.transform(F.split("diagnoses", "\\|"), lambda d: F.to_json(F.struct(F.lit("Condition").alias("resourceType"), F.concat_ws("-", F.lit("c"), "patient_id", d).alias("id"), code(d, "http://hl7.org/fhir/sid/icd-10"), subject, F.col("admission_date").cast("string").alias("onsetDateTime"))))
    labs = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.to_json(F.struct(F.lit("Observation").alias("resourceType"), F.concat_ws("-", F.lit("o"), "patient_id", i.cast("string")).alias("id"), F.lit("final").alias("status"), code(F.concat(F.lit("lab-"), i.cast("string")), "http://loinc.org"), subject, F.col("admission_date").cast("string").alias("effectiveDateTime"), F.struct((F.col("creatinine") + i / 10.0).alias("value"), F.lit("mg/dL").alias("unit")).alias("valueQuantity"))))
    entries = F.array_join(F.transform(F.concat(F.array(patient), conditions, labs), lambda r: F.concat(F.lit('{"resource":'), r, F.lit("}"))), ",")
    return rows.select(F.col("patient_id").alias("bundle_id"), F.concat(F.lit('{"resourceType":"Bundle","entry":['), entries, F.lit("]}")).alias("bundle"))
