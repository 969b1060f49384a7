"""De-identification and detection of personal health information, as one projection over the frame.

Hashes and date shifts depend on a salt that the caller must give, so results are reproducible and links between tables hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import phi

REDACTED = "[REDACTED]"
DATE_PATTERNS = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}")


@dataclass(frozen=True)
class Deidentification:
    salt: str
    hash_ids: bool = True
    shift_dates: bool = True
    max_shift: int = 365
    truncate_ages: bool = True
    k: int = 0


def hashed(value: Column, salt: str) -> Column:
    """SHA-256 of the value and the salt, in hexadecimal; empty and null values stay."""
    text = value.cast("string")
    return F.when(text == "", text).otherwise(F.sha2(F.concat(text, F.lit(salt)), 256))


def shift_days(patient: Column, salt: str, most: int = 365) -> Column:
    """A patient's shift: from -most to most - 1 days."""
    word = F.substring(F.sha2(F.concat(patient.cast("string"), F.lit(salt)), 256), 1, 8)
    return (F.conv(word, 16, 10).cast("long") % (2 * most) - most).cast("int")


def shifted(time: Column, patient: Column, salt: str, most: int = 365) -> Column:
    return time + F.make_dt_interval(shift_days(patient, salt, most))


def shifted_text(text: Column, patient: Column, salt: str, most: int = 365) -> Column:
    """An ISO date or time as text, shifted; null if it is neither."""
    time = F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")
    moved = time + F.make_dt_interval(shift_days(patient, salt, most))
    return F.when(F.contains(text, F.lit("T")), F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.endswith(text, F.lit("Z")), "+00:00").otherwise(""))).otherwise(F.date_format(moved, "yyyy-MM-dd"))


def truncated_age(age: Column) -> Column:
    """``89+`` from 89 on, else the age, as text."""
    return F.when(age >= 89, "89+").otherwise(age.cast("string"))


def age_on(birth: Column, today: str) -> Column:
    """Whole years at ``today``, 0 for a birth date that is none."""
    b, t = birth.cast("string").try_cast("date"), F.lit(today).cast("date")
    years = F.year(t) - F.year(b) - (F.date_format(t, "MMdd") < F.date_format(b, "MMdd")).cast("int")
    return F.coalesce(years, F.lit(0))


def date_columns(df: DataFrame) -> list[str]:
    """Columns of a date type, and text columns with a date in any value (one pass over all rows, so that reruns agree)."""
    out = [c for c, k in df.dtypes if k.startswith(("timestamp", "date"))]
    texts = [c for c, k in df.dtypes if k == "string"]
    if texts:
        dated = df.agg(*(F.bool_or(F.col(f"`{c}`").rlike("|".join(DATE_PATTERNS))).alias(f"d{i}") for i, c in enumerate(texts))).first()
        out += [c for c, found in zip(texts, dated) if found]
    return [c for c in df.columns if c in out]


def deidentify(df: DataFrame, patient: str, config: Deidentification, columns: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
    """Masks columns by what they hold. ``columns``: those with personal data (by name if none are given).

    Dates move by the patient's shift, ages stop at 89, addresses, names, contacts, record numbers and the rest are redacted,
    other ids hashed. The patient's id is hashed once, and shifts depend on the id before it. With ``k`` over 1, rare
    combinations of quasi-identifiers are generalised, by the ages before they became text.
    """
    columns = [c for c in df.columns if phi.suspicious(c)] if columns is None else columns
    dates = date_columns(df.select(*columns)) if dates is None else dates
    id_, out = F.col(patient), {}
    for c in df.columns:
        x = F.col(c)
        if c == patient:
            out[c] = hashed(x, config.salt) if config.hash_ids else x
        elif c not in columns:
            out[c] = x
        elif c in dates:
            if not config.shift_dates:
                out[c] = x
            else:
                out[c] = shifted_text(x, id_, config.salt, config.max_shift) if dict(df.dtypes)[c] == "string" else shifted(x, id_, config.salt, config.max_shift)
        elif phi.looks_like(c, "age"):
            out[c] = truncated_age(x) if config.truncate_ages else x
        elif any(phi.looks_like(c, k) for k in ("address", "name", "contact", "mrn", "ssn", "device")):
            out[c] = F.when(x.isNotNull(), REDACTED)
        elif phi.looks_like(c, "id"):
            out[c] = hashed(x, config.salt)
        else:
            out[c] = F.when(x.isNotNull(), REDACTED)
    if config.k > 1:
        quasi = [c for c in df.columns if c in phi.QUASI]
        ages = [c for c in quasi if phi.looks_like(c, "age")]
        return k_anonymous(df, quasi, config.k, ages, out)
    return df.select(*(x.alias(c) for c, x in out.items()))


def k_anonymous(df: DataFrame, quasi: list[str], k: int, ages: list[str] = ("age",), masks: dict[str, Column] | None = None) -> DataFrame:
    """Rows in groups of fewer than ``k`` by the quasi-identifiers get five-year ages (89+ stays) and otherwise
    ``[REDACTED]``. Nulls are a value. Group sizes are counted before the join, so a frequent group costs a row per task."""
    masks = masks or {}
    kept = df.select(*(masks.get(c, F.col(c)).alias(c) for c in df.columns), *(F.col(c).alias(f"_q{i}") for i, c in enumerate(quasi)))
    keys = [f"_q{i}" for i in range(len(quasi))]
    small = df.groupBy(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(quasi))).agg(F.count("*").alias("_n")).where(F.col("_n") < k)
    on = F.lit(True)
    for i in range(len(quasi)):
        on = on & F.col(f"_q{i}").eqNullSafe(F.col(f"_s{i}"))
    joined = kept.join(small, on, "left")
    rare, out = F.col("_n").isNotNull(), []
    for c in df.columns:
        x = F.col(c)
        if c in quasi:
            if c in ages:
                age = F.col(keys[quasi.index(c)]).cast("string").try_cast("int")
                low = F.floor(age / 5) * 5
                band = F.when(age >= 89, "89+").when(age.isNull(), F.coalesce(x.cast("string"), F.lit(REDACTED))).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string")))
                x = F.when(rare, band).otherwise(x.cast("string"))
            else:
                x = F.when(rare, REDACTED).otherwise(x.cast("string"))
        out.append(x.alias(c))
    return joined.select(*out)


def small_groups(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Groups of the quasi-identifiers with fewer than ``k`` rows; those with a null key don't count."""
    rows = df
    for c in quasi:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*quasi).agg(F.count("*").alias("n")).where(F.col("n") < k)


def phi_counts(df: DataFrame, columns: list[str] | None = None, by: list[str] = (), kinds=tuple(phi.PATTERNS)) -> DataFrame:
    """Instances of each kind of personal data by text column: column, kind, instances."""
    columns = columns or [c for c, k in df.dtypes if k == "string"]
    parts = [F.sum(phi.instances(F.col(c), k)).alias(f"c{i}_{j}") for i, c in enumerate(columns) for j, k in enumerate(kinds)]
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"c{i}_{j}").alias("instances")) for i, c in enumerate(columns) for j, k in enumerate(kinds)))
    return df.groupBy(*by).agg(*parts).select(*by, F.inline(each))


def phi_report(df: DataFrame, key: str, rows: int = 100, share: float = 0.1) -> DataFrame:
    """Columns that hold personal data: found by content (instances over sampled rows of at least ``share``: high risk) or
    suggested by name (medium)."""
    from wardline.operators.quality import sample

    some = sample(df, rows, key)
    n = some.agg(F.count("*").alias("n"))
    found = phi_counts(some).crossJoin(n).where((F.col("n") > 0) & (F.col("instances") / F.col("n") >= share)).groupBy("column").agg(F.sort_array(F.collect_list("kind")).alias("content"))
    names = df.sparkSession.createDataFrame([(c, phi.indicated(c)) for c in df.columns], "column string, names array<string>")
    both = names.join(found, "column", "left").where(F.col("content").isNotNull() | (F.size("names") > 0))
    return both.select("column", F.coalesce("content", F.array().cast("array<string>")).alias("content"), "names", F.when(F.col("content").isNotNull(), "high").otherwise("medium").alias("risk"))


def deidentification_gate(before: DataFrame, after: DataFrame, key_before: str, key_after: str) -> DataFrame:
    """Columns with personal data by content before and after, and whether none is left."""
    count = lambda df, k, n: phi_report(df, k).agg(F.count_if(F.col("risk") == "high").alias(n))
    both = count(before, key_before, "columns_before").crossJoin(count(after, key_after, "columns_after"))
    return both.withColumn("passed", F.col("columns_after") == 0)


def deidentify_bundles(bundles: DataFrame, config: Deidentification, column: str = "bundle") -> DataFrame:
    """Bundles as JSON text to their resources, one row each: bundle_id, resource_type, patient (hashed), resource (masked
    JSON) and ``error``. A bundle that can't be read goes on only as an error, never raw: without resource."""
    entry = "array<struct<resource:string>>"
    parsed = bundles.withColumn("_b", F.from_json(column, f"resourceType string, entry {entry}"))
    broken = F.col("_b.resourceType").isNull() | (F.col("_b.resourceType") != "Bundle")
    bad = parsed.where(F.coalesce(broken, F.lit(True))).select("bundle_id", *(F.lit(None).cast("string").alias(c) for c in ("resource_type", "patient", "resource")), F.lit("not a readable bundle").alias("error"))
    rows = parsed.where(~F.coalesce(broken, F.lit(True))).select("bundle_id", F.explode("_b.entry.resource").alias("r")).where("r IS NOT NULL")
    get = lambda p: F.get_json_object("r", p)
    kind = get("$.resourceType")
    raw = F.when(kind == "Patient", get("$.id")).otherwise(F.regexp_replace(F.coalesce(get("$.subject.reference"), get("$.patient.reference")), "^Patient/", ""))
    move = lambda p: shifted_text(get(p), F.col("_p"), config.salt, config.max_shift)
    who = hashed(F.col("_p"), config.salt)
    subject = F.struct(F.concat(F.lit("Patient/"), who).alias("reference"))
    code = F.from_json(get("$.code"), "coding array<struct<system:string,code:string,display:string>>, text string")
    made = {
        "Patient": F.struct(kind.alias("resourceType"), who.alias("id"), get("$.gender").alias("gender"), move("$.birthDate").alias("birthDate")),
        "Observation": F.struct(kind.alias("resourceType"), hashed(get("$.id"), config.salt).alias("id"), get("$.status").alias("status"), code.alias("code"), subject.alias("subject"), move("$.effectiveDateTime").alias("effectiveDateTime"), F.from_json(get("$.valueQuantity"), "value double, unit string").alias("valueQuantity")),
        "Condition": F.struct(kind.alias("resourceType"), hashed(get("$.id"), config.salt).alias("id"), code.alias("code"), subject.alias("subject"), move("$.onsetDateTime").alias("onsetDateTime"), move("$.recordedDate").alias("recordedDate")),
        "Encounter": F.struct(kind.alias("resourceType"), hashed(get("$.id"), config.salt).alias("id"), get("$.status").alias("status"), subject.alias("subject"), F.struct(move("$.period.start").alias("start"), move("$.period.end").alias("end")).alias("period")),
        "MedicationRequest": F.struct(kind.alias("resourceType"), hashed(get("$.id"), config.salt).alias("id"), get("$.status").alias("status"), subject.alias("subject"), move("$.authoredOn").alias("authoredOn"), F.from_json(get("$.medicationCodeableConcept"), "coding array<struct<system:string,code:string,display:string>>, text string").alias("medicationCodeableConcept")),
    }
    out = F.lit(None).cast("string")
    for k, s in made.items():
        out = F.when(kind == k, F.to_json(s)).otherwise(out)
    rows = rows.withColumn("_p", raw)
    good = rows.select("bundle_id", kind.alias("resource_type"), who.alias("patient"), out.alias("resource"), F.when(out.isNull(), "no rule for this resource").alias("error"))
    return good.unionByName(bad)
