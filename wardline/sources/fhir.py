"""FHIR resources as JSON text to flat tables and back, and to OMOP tables.

A resource table has the columns resource_type, id and resource (JSON text). Each flat table is one from_json with a fixed schema
and one projection; what is absent is an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CODE = "struct<coding:array<struct<system:string,code:string,display:string>>,text:string>"
_REF = "struct<reference:string,display:string>"
_QUANTITY = "struct<value:double,unit:string>"
_PERIOD = "struct<start:string,end:string>"
_VALUES = f"valueQuantity:{_QUANTITY},valueCodeableConcept:{_CODE},valueString:string,valueBoolean:boolean,valueInteger:bigint,valueRange:struct<low:{_QUANTITY},high:{_QUANTITY}>,valueRatio:struct<numerator:{_QUANTITY},denominator:{_QUANTITY}>"
SCHEMAS = {
    "Patient": "id string, name array<struct<family:string,given:array<string>>>, gender string, birthDate string, address array<struct<line:array<string>,city:string,state:string,postalCode:string,country:string>>, telecom array<struct<system:string,value:string>>, identifier array<struct<system:string,value:string,type:struct<coding:array<struct<code:string>>>>>",
    "Observation": f"id:string,status:string,category:array<{_CODE}>,subject:{_REF},effectiveDateTime:string,code:{_CODE},{_VALUES},component:array<struct<code:{_CODE},{_VALUES}>>",
    "Condition": f"id string, subject {_REF}, onsetDateTime string, onsetPeriod {_PERIOD}, abatementDateTime string, abatementPeriod {_PERIOD}, recordedDate string, code {_CODE}, severity {_CODE}, category array<{_CODE}>, clinicalStatus {_CODE}, verificationStatus {_CODE}",
    "Procedure": f"id string, subject {_REF}, performedDateTime string, performedPeriod {_PERIOD}, code {_CODE}, category {_CODE}, performer array<struct<actor:{_REF}>>, status string",
    "MedicationRequest": f"id string, subject {_REF}, authoredOn string, medicationReference {_REF}, medicationCodeableConcept {_CODE}, status string, dosageInstruction array<struct<text:string,doseAndRate:array<struct<doseQuantity:{_QUANTITY}>>,timing:struct<repeat:struct<frequency:bigint,period:double,periodUnit:string>>,route:{_CODE}>>",
    "Encounter": f"id string, subject {_REF}, period {_PERIOD}, type array<{_CODE}>, class struct<code:string,display:string>, location array<struct<location:{_REF}>>, serviceProvider {_REF}, status string",
}
SSN = "http://hl7.org/fhir/sid/us-ssn"


def resources(bundles: DataFrame, column: str = "bundle", strict: bool = True) -> DataFrame:
    """Bundles as JSON text to their resources, one row each. With ``strict``, what is no bundle is an error, else no row."""
    parsed = bundles.withColumn("_b", F.from_json(column, "resourceType string, entry array<struct<resource:string>>"))
    ok = F.coalesce(F.col("_b.resourceType") == "Bundle", F.lit(False))
    entries = F.when(ok, F.col("_b.entry.resource"))
    if strict:
        entries = F.when(ok, F.col("_b.entry.resource")).otherwise(F.raise_error(F.lit("resourceType must be Bundle")).cast("array<string>"))
    rows = parsed.select(F.explode(entries).alias("resource")).where("resource IS NOT NULL AND resource <> '{}'")
    return rows.select(F.get_json_object("resource", "$.resourceType").alias("resource_type"), F.get_json_object("resource", "$.id").alias("id"), "resource")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Resources from files of one JSON object a line, or one array or object a file (.json)."""
    lines = spark.read.option("recursiveFileLookup", True)
    if path.endswith(".json"):
        whole = lines.text(path, wholetext=True).select(F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value")).alias("v")).select(F.explode("v").alias("resource"))
    else:
        whole = lines.text(path).select(F.col("value").alias("resource")).where(F.trim("resource") != "")
    return whole.select(F.get_json_object("resource", "$.resourceType").alias("resource_type"), F.get_json_object("resource", "$.id").alias("id"), "resource")


def search(rows: DataFrame, kind: str, patient: str | None = None, most: int | None = None) -> DataFrame:
    """Resources of a kind (and patient), at most ``most``."""
    out = rows.where(F.col("resource_type") == kind)
    if patient is not None:
        reference = F.coalesce(F.get_json_object("resource", "$.subject.reference"), F.get_json_object("resource", "$.patient.reference"))
        out = out.where(reference == f"Patient/{patient}")
    return out.limit(most) if most is not None else out


def import_status(new: DataFrame, target: DataFrame, update: bool = True) -> DataFrame:
    """How many resources an import would create, update or fail for want of a type: status, n."""
    known = target.select(F.col("resource_type").alias("t"), F.col("id").alias("i"), F.lit(1).alias("seen")).distinct()
    joined = new.join(known, (F.col("resource_type") == F.col("t")) & (F.col("id") == F.col("i")), "left")
    status = F.when(F.col("resource_type").isNull(), "failed").when(F.lit(update) & F.col("seen").isNotNull(), "updated").otherwise("created")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def upsert(new: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` with its rows replaced by those of ``new`` with the same type and id, and the others added."""
    keys = ["resource_type", "id"]
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.where("resource_type IS NOT NULL"))


def _parsed(rows: DataFrame, kind: str) -> DataFrame:
    schema = SCHEMAS[kind] if kind != "Observation" else f"struct<{SCHEMAS[kind]}>"
    return rows.where(F.col("resource_type") == kind).select(F.inline(F.array(F.from_json("resource", schema))))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _first(array: str) -> Column:
    return F.get(F.col(array), 0)


def _coding(code: Column, field: str) -> Column:
    return F.get(code.getField("coding"), 0).getField(field)


def _subject() -> Column:
    return F.replace(_text(F.col("subject.reference")), F.lit("Patient/"), F.lit("")).alias("patient_id")


def patients(rows: DataFrame) -> DataFrame:
    p = _parsed(rows, "Patient")
    by = lambda array, test: F.get(F.filter(F.col(array), test), 0).getField("value")
    a, n = _first("address"), _first("name")
    return p.select(
        _text(F.col("id")).alias("patient_id"), _text(n["family"]).alias("family_name"), _text(F.array_join(n["given"], " ")).alias("given_name"),
        _text(F.col("gender")).alias("gender"), _text(F.col("birthDate")).alias("birth_date"), _text(F.array_join(a["line"], ", ")).alias("address_line"),
        _text(a["city"]).alias("city"), _text(a["state"]).alias("state"), _text(a["postalCode"]).alias("postal_code"), _text(a["country"]).alias("country"),
        _text(by("telecom", lambda t: t["system"] == "phone")).alias("phone"), _text(by("telecom", lambda t: t["system"] == "email")).alias("email"),
        _text(by("identifier", lambda i: F.get(i["type"]["coding"], 0)["code"] == "MR")).alias("mrn"), _text(by("identifier", lambda i: i["system"] == SSN)).alias("ssn"),
    )


def _value(v) -> dict[str, Column]:
    """value, its type and unit, of the first kind of value that is there."""
    get = (lambda n: F.col(n)) if v is None else (lambda n: v[n])
    q, c, r, ratio = get("valueQuantity"), get("valueCodeableConcept"), get("valueRange"), get("valueRatio")
    kinds = [
        ("quantity", q.isNotNull(), q["value"].cast("string"), q["unit"]),
        ("codeable", c.isNotNull(), F.coalesce(_coding(c, "display"), c["text"]), None),
        ("string", get("valueString").isNotNull(), get("valueString"), None),
        ("boolean", get("valueBoolean").isNotNull(), get("valueBoolean").cast("string"), None),
        ("integer", get("valueInteger").isNotNull(), get("valueInteger").cast("string"), None),
        ("range", r.isNotNull(), F.concat_ws("-", r["low"]["value"].cast("string"), r["high"]["value"].cast("string")), r["low"]["unit"]),
        ("ratio", ratio.isNotNull(), F.concat_ws("/", ratio["numerator"]["value"].cast("string"), ratio["denominator"]["value"].cast("string")), ratio["numerator"]["unit"]),
    ]
    value = kind = unit = F.lit(None).cast("string")
    for name, test, x, u in reversed(kinds):
        value, kind = F.when(test, x).otherwise(value), F.when(test, name).otherwise(kind)
        unit = F.when(test, u if u is not None else F.lit(None)).otherwise(unit)
    return {"value": value, "value_type": kind, "unit": unit, "value_num": value.try_cast("double")}


def observations(rows: DataFrame) -> DataFrame:
    """One row for each observation, and for one without a value of its own one for each component that has one."""
    o = _parsed(rows, "Observation")
    base = [_text(F.col("id")).alias("observation_id"), _subject(), _text(F.col("effectiveDateTime")).alias("date")]
    end = [_text(F.col("status")).alias("status")]
    own = _value(None)
    has = o.select("*", own["value_type"].isNotNull().alias("_own"), F.exists(F.coalesce("component", F.array().cast(o.schema["component"].dataType)), lambda c: _value(c)["value_type"].isNotNull()).alias("_parts"))
    code = lambda f: _text(_coding(F.col("code"), f))
    whole = has.where("_own OR NOT _parts").select(*base, code("code").alias("code"), code("system").alias("system"), code("display").alias("display"), *(own[k].alias(k) for k in own), *end)
    parts = has.where("NOT _own AND _parts").withColumn("c", F.explode("component"))
    v = _value(F.col("c"))
    part = lambda f, sep: F.concat(code(f), F.lit(sep), _text(_coding(F.col("c.code"), f)))
    split = parts.where(v["value_type"].isNotNull()).select(*base, part("code", ".").alias("code"), code("system").alias("system"), part("display", " - ").alias("display"), *(v[k].alias(k) for k in v), *end)
    return whole.unionByName(split)


def conditions(rows: DataFrame) -> DataFrame:
    c = _parsed(rows, "Condition")
    one = lambda x, f="code": _text(_coding(x, f))
    return c.select(
        _text(F.col("id")).alias("condition_id"), _subject(), _text(F.coalesce("onsetDateTime", "onsetPeriod.start")).alias("onset_date"), _text(F.coalesce("abatementDateTime", "abatementPeriod.end")).alias("abatement_date"),
        one(F.col("code")).alias("code"), one(F.col("code"), "system").alias("system"), one(F.col("code"), "display").alias("display"), one(F.col("severity"), "display").alias("severity"),
        one(_first("category"), "display").alias("category"), one(F.col("clinicalStatus")).alias("clinical_status"), one(F.col("verificationStatus")).alias("verification_status"),
    )


def procedures(rows: DataFrame) -> DataFrame:
    p = _parsed(rows, "Procedure")
    one = lambda x, f="code": _text(_coding(x, f))
    return p.select(
        _text(F.col("id")).alias("procedure_id"), _subject(), _text(F.coalesce("performedDateTime", "performedPeriod.start")).alias("performed_date"), one(F.col("code")).alias("code"), one(F.col("code"), "system").alias("system"),
        one(F.col("code"), "display").alias("display"), one(F.col("category"), "display").alias("category"), _text(_first("performer")["actor"]["display"]).alias("performer"), _text(F.col("status")).alias("status"),
    )


def medications(rows: DataFrame) -> DataFrame:
    """Code and system are given only where the name comes from the coded concept."""
    m = _parsed(rows, "MedicationRequest")
    d = _first("dosageInstruction")
    named, code = F.col("medicationReference.display"), F.col("medicationCodeableConcept")
    coded = named.isNull()
    dose, repeat = F.get(d["doseAndRate"], 0)["doseQuantity"], d["timing"]["repeat"]
    frequency = F.when(repeat["frequency"].isNotNull(), F.concat(repeat["frequency"].cast("string"), F.lit(" times per "), _text(F.format_string("%s", repeat["period"])), F.lit(" "), _text(repeat["periodUnit"])))
    return m.select(
        _text(F.col("id")).alias("medication_id"), _subject(), _text(F.col("authoredOn")).alias("authored_date"), _text(F.col("medicationReference.reference")).alias("medication_reference"), _text(F.coalesce(named, _coding(code, "display"))).alias("medication_display"),
        _text(F.when(coded, _coding(code, "code"))).alias("code"), _text(F.when(coded, _coding(code, "system"))).alias("system"), _text(d["text"]).alias("dosage_text"),
        _text(F.when(dose["value"].isNotNull(), F.concat_ws(" ", dose["value"].cast("string"), dose["unit"]))).alias("dose"), _text(frequency).alias("frequency"), _text(_coding(d["route"], "display")).alias("route"), _text(F.col("status")).alias("status"),
    )


def encounters(rows: DataFrame) -> DataFrame:
    e = _parsed(rows, "Encounter")
    t = _first("type")
    return e.select(
        _text(F.col("id")).alias("encounter_id"), _subject(), _text(F.col("period.start")).alias("start_date"), _text(F.col("period.end")).alias("end_date"), _text(_coding(t, "code")).alias("type_code"), _text(_coding(t, "display")).alias("type_display"),
        _text(F.col("class.code")).alias("class_code"), _text(F.col("class.display")).alias("class_display"), _text(_first("location")["location"]["display"]).alias("location"), _text(F.col("serviceProvider.display")).alias("service_provider"), _text(F.col("status")).alias("status"),
    )


def _some(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def from_patients(flat: DataFrame) -> DataFrame:
    """Flat patients to resources; contacts and identifiers only where given."""
    contact = lambda system: F.when(_some(system), F.struct(F.lit(system).alias("system"), F.col(system).alias("value")))
    mr = F.when(_some("mrn"), F.struct(F.lit(None).cast("string").alias("system"), F.col("mrn").alias("value"), F.struct(F.array(F.struct(F.lit("MR").alias("code"))).alias("coding")).alias("type")))
    ssn = F.when(_some("ssn"), F.struct(F.lit(SSN).alias("system"), F.col("ssn").alias("value"), F.lit(None).cast("struct<coding:array<struct<code:string>>>").alias("type")))
    address = F.struct(F.split("address_line", ", ").alias("line"), "city", "state", F.col("postal_code").alias("postalCode"), "country")
    made = F.struct(
        F.lit("Patient").alias("resourceType"), F.col("patient_id").alias("id"), F.array(F.struct(F.col("family_name").alias("family"), F.split("given_name", " ").alias("given"))).alias("name"), F.col("gender"),
        F.when(_some("birth_date"), F.col("birth_date")).alias("birthDate"), F.array(address).alias("address"), F.array_compact(F.array(contact("phone"), contact("email"))).alias("telecom"), F.array_compact(F.array(mr, ssn)).alias("identifier"),
    )
    return flat.select(F.lit("Patient").alias("resource_type"), F.col("patient_id").alias("id"), F.to_json(made).alias("resource"))


def _code_struct() -> Column:
    return F.struct(F.array(F.struct(F.col("system"), F.col("code"), F.col("display"))).alias("coding")).alias("code")


def from_observations(flat: DataFrame) -> DataFrame:
    """Flat observations to resources, their value by its type; ranges and ratios are dropped."""
    is_ = lambda k: F.col("value_type") == k
    number = F.col("value").try_cast("double")
    made = F.struct(
        F.lit("Observation").alias("resourceType"), F.col("observation_id").alias("id"), F.when(_some("status"), F.col("status")).alias("status"), _code_struct(), F.struct(F.concat(F.lit("Patient/"), "patient_id").alias("reference")).alias("subject"),
        F.when(_some("date"), F.col("date")).alias("effectiveDateTime"), F.when(is_("quantity"), F.struct(number.alias("value"), F.col("unit").alias("unit"))).alias("valueQuantity"),
        F.when(is_("codeable"), F.struct(F.col("value").alias("text"))).alias("valueCodeableConcept"), F.when(is_("string"), F.col("value")).alias("valueString"), F.when(is_("boolean"), F.col("value").try_cast("boolean")).alias("valueBoolean"), F.when(is_("integer"), F.col("value").try_cast("bigint")).alias("valueInteger"),
    )
    return flat.select(F.lit("Observation").alias("resource_type"), F.col("observation_id").alias("id"), F.to_json(made).alias("resource"))


def from_conditions(flat: DataFrame) -> DataFrame:
    coded = lambda c, f: F.when(_some(c), F.struct(F.array(F.struct(F.col(c).alias(f))).alias("coding")))
    made = F.struct(
        F.lit("Condition").alias("resourceType"), F.col("condition_id").alias("id"), _code_struct(), F.struct(F.concat(F.lit("Patient/"), "patient_id").alias("reference")).alias("subject"),
        F.when(_some("onset_date"), F.col("onset_date")).alias("onsetDateTime"), F.when(_some("abatement_date"), F.col("abatement_date")).alias("abatementDateTime"), coded("severity", "display").alias("severity"),
        F.when(_some("category"), F.array(coded("category", "display"))).alias("category"), coded("clinical_status", "code").alias("clinicalStatus"), coded("verification_status", "code").alias("verificationStatus"),
    )
    return flat.select(F.lit("Condition").alias("resource_type"), F.col("condition_id").alias("id"), F.to_json(made).alias("resource"))


def omop(rows: DataFrame) -> dict[str, DataFrame]:
    """person, condition_occurrence, drug_exposure and observation, each with the person's id."""
    get = lambda p: F.get_json_object("resource", p)
    of = lambda kind: rows.where(F.col("resource_type") == kind)
    person = F.regexp_replace(get("$.subject.reference"), "^Patient/", "").alias("person_id")
    return {
        "person": of("Patient").select(F.col("id").alias("person_id"), F.when(get("$.gender") == "male", 8507).otherwise(8532).alias("gender_concept_id"), get("$.birthDate").alias("birth_datetime")),
        "condition_occurrence": of("Condition").select(person, get("$.code.coding[0].code").alias("condition_source_value"), F.coalesce(get("$.onsetDateTime"), get("$.recordedDate")).alias("condition_start_date")),
        "drug_exposure": of("MedicationRequest").select(person, get("$.medicationCodeableConcept.coding[0].display").alias("drug_source_value"), get("$.medicationCodeableConcept.coding[0].code").alias("drug_source_concept_id")),
        "observation": of("Observation").select(person, get("$.code.coding[0].code").alias("observation_source_value"), get("$.valueQuantity.value").try_cast("double").alias("value_as_number"), get("$.effectiveDateTime").alias("observation_date")),
    }


def patient_records(rows: DataFrame) -> DataFrame:
    """One nested record for each patient: demographics, clinical events, laboratory results, medications; empty lists where
    there is nothing. Each list is one aggregation joined to the patients."""
    p = patients(rows)
    names = [c for c in p.columns if c != "patient_id"]
    demographics = F.map_filter(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull() & (v != ""))
    c = conditions(rows).groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct(F.col("onset_date").alias("date"), F.lit("diagnosis").alias("type"), "code", F.col("display").alias("description")))).alias("clinical_events"))
    labs = rows.where((F.col("resource_type") == "Observation") & (F.get_json_object("resource", "$.category[0].coding[0].code") == "laboratory"))
    o = observations(labs).groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct("date", F.col("display").alias("name"), "value", "unit"))).alias("lab_results"))
    m = medications(rows).groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct(F.col("authored_date").alias("date"), F.col("medication_display").alias("name"), "dose"))).alias("medications"))
    joined = p.select("patient_id", demographics.alias("demographics")).join(c, "patient_id", "left").join(o, "patient_id", "left").join(m, "patient_id", "left")
    lists = {n: F.coalesce(n, F.array().cast(joined.schema[n].dataType)) for n in ("clinical_events", "lab_results", "medications")}
    return joined.withColumns(lists)
