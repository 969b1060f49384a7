"""Stores on Parquet: features by date, the access log, patients and notifications, registered models.

A feature store is partitioned by date. An upsert or an erasure rewrites only the partitions that hold its rows, through a
checkpoint, so that nothing is read and overwritten at once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.frames import require, shared_folder

#: Columns of a patient that an update may change.
UPDATABLE = ("name", "age", "gender", "primary_diagnosis", "risk_score", "length_of_stay", "last_visit", "medications")


class FeatureStore:
    """Rows keyed by patient_id and feature_timestamp (ISO text), any further columns; one partition for each date."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self, strict: bool = False) -> DataFrame:
        """Every partition, columns united by name. Files that can't be read are left out, or, with ``strict``, an error: what is
        written back must hold every row."""
        rows = self.spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", not strict).parquet(self.path)
        return rows.withColumn("feature_date", F.col("feature_date").cast("string"))

    def upsert(self, rows: DataFrame) -> None:
        """Replaces a patient's row within the date of its timestamp, or adds it; of several new ones the last stays."""
        require(rows, ["patient_id", "feature_timestamp"])
        dated = rows.withColumn("feature_date", F.substring("feature_timestamp", 1, 10))
        new = latest(dated, ["patient_id", "feature_date"], "feature_timestamp")
        try:
            old = self.all(strict=True)
        except AnalysisException:
            if self._exists():
                raise
            return self._write(new)
        touched = old.join(new.select("feature_date").distinct(), "feature_date", "left_semi")
        kept = touched.join(new.select("patient_id", "feature_date"), ["patient_id", "feature_date"], "left_anti")
        self._write(_stable(kept.unionByName(new, allowMissingColumns=True)))

    def _exists(self) -> bool:
        """Whether any date has been written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/feature_date=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return found is not None and len(found) > 0

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_date").parquet(self.path)

    def erase(self, patient: str) -> None:
        """Removes a patient from the partitions that hold it."""
        old = self.all(strict=True)
        dates = [r[0] for r in old.where(F.col("patient_id") == patient).select("feature_date").distinct().collect()]
        if dates:
            touched = _stable(old.where(F.col("feature_date").isin(dates)))
            left = touched.where(F.col("patient_id") != patient)
            emptied = set(dates) - {r[0] for r in left.select("feature_date").distinct().collect()}
            self._write(left)
            jvm = self.spark._jvm.org.apache.hadoop.fs
            for d in emptied:
                path = jvm.Path(f"{self.path}/feature_date={d}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def get(self, patient: str) -> DataFrame:
        return latest(self.all().where(F.col("patient_id") == patient), ["patient_id"], "feature_timestamp")

    def batch(self, patients: DataFrame) -> DataFrame:
        """The newest row of each patient in ``patients``."""
        return latest(self.all().join(patients.select("patient_id").distinct(), "patient_id", "left_semi"), ["patient_id"], "feature_timestamp")

    def recent(self, now: str, days: int) -> DataFrame:
        """Rows of the last ``days``; partitions before aren't read."""
        return recent(self.all(), now, days)

    def stats(self) -> DataFrame:
        rows = self.all()
        counts = rows.agg(F.count_distinct("patient_id").alias("patients"), F.count("*").alias("n_rows"), F.sort_array(F.collect_set("feature_date")).alias("dates"))
        return counts.withColumn("features", F.lit(len(rows.columns) - 3))

    def patients(self) -> DataFrame:
        return self.all().select("patient_id").distinct().orderBy("patient_id")


def _stable(df: DataFrame) -> DataFrame:
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row by key. One pass of max_by over the whole row, combined before the shuffle."""
    columns = df.columns
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order, F.xxhash64(*columns))).alias("_row"))
    return picked.select(*(F.col("_row")[c].alias(c) for c in columns))


def recent(df: DataFrame, now: str, days: int) -> DataFrame:
    start = F.date_format(F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)), "yyyy-MM-dd'T'HH:mm:ss")
    return df.where((F.col("feature_date") >= F.substring(start, 1, 10)) & (F.col("feature_timestamp") >= start))


# The access log: timestamps are ISO text.

LOG_NAMES = {"user_id": "user", "patient_id": "patient", "resource_type": "resource", "justification": "reason", "model_used": "model"}


def append_log(rows: DataFrame, path: str) -> None:
    require(rows, ["timestamp", "user_id", "patient_id", "resource_type", "operation", "justification"])
    rows.withColumn("log_date", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("log_date").parquet(path)


def log_between(log: DataFrame, start: str, end: str, typed: bool = False) -> DataFrame:
    """Entries from ``start`` to ``end`` as text, so that an end without time leaves out its day; ``typed``: as times, with it."""
    if typed:
        last = F.lit(end).cast("timestamp_ntz") + (F.expr("INTERVAL 1 DAY") if len(end) == 10 else F.expr("INTERVAL 0 DAY"))
        t = F.col("timestamp").cast("timestamp_ntz")
        rows = log.where((t >= F.lit(start).cast("timestamp_ntz")) & ((t < last) if len(end) == 10 else (t <= last)))
    else:
        rows = log.where(F.col("timestamp").between(start, end))
    return rows.withColumnsRenamed(LOG_NAMES).orderBy(F.desc("timestamp"))


def log_of_patient(log: DataFrame, patient) -> DataFrame:
    return log.where(F.col("patient_id") == patient).withColumnsRenamed(LOG_NAMES).orderBy(F.desc("timestamp"))


# Patients and notifications.


def risk_band(score: Column, high: float = 0.75, medium: float = 0.40) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def find_patients(patients: DataFrame, term: str = "", band: str = "all", fields=("name", "patient_id", "mrn"), gender: str = "all") -> DataFrame:
    """Patients with the term in one of the fields, whatever its case (% and _ are wildcards), of a risk band and gender."""
    rows = patients if gender in ("", "all") else patients.where(F.col("gender") == gender)
    term = term.strip().lower()
    if term:
        test = F.lit(False)
        for f in fields:
            if f in patients.columns:
                test = test | F.lower(F.col(f).cast("string")).like(f"%{term}%")
        rows = rows.where(test)
    return rows if band in ("", "all") else rows.where(risk_band(F.col("risk_score")) == band)


def page(patients: DataFrame, number: int = 1, size: int = 50, key: str = "patient_id") -> DataFrame:
    """A page of the patients of the highest risk; at most 200 a page."""
    size = min(max(size, 1), 200)
    return patients.orderBy(F.desc("risk_score"), key).offset((max(number, 1) - 1) * size).limit(size)


def sorted_page(df: DataFrame, column: str, descending: bool = False, number: int = 1, size: int = 10, key: str = "patient_id") -> DataFrame:
    """A page in the order of a column, text whatever its case."""
    x = F.lower(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.orderBy(x.desc() if descending else x.asc(), key).offset((number - 1) * size).limit(size)


def summary(patients: DataFrame) -> DataFrame:
    """One row: patients in all and by band, mean stay to one place (unknown: 0)."""
    band = risk_band(F.col("risk_score"))
    stay = F.coalesce(F.bround(F.avg(F.coalesce("length_of_stay", F.lit(0))), 1), F.lit(0.0))
    return patients.agg(F.count("*").alias("total"), *(F.count_if(band == b).alias(b) for b in ("high", "medium", "low")), stay.alias("mean_stay"))


def trend(patients: DataFrame, months: int = 6) -> DataFrame:
    """The admissions and readmissions shown for the last months, made from the number of patients alone."""
    n = patients.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("i"))
    base = F.greatest(F.lit(4), F.col("n") - 3 * F.col("i"))
    return n.select("i", base.alias("admissions"), F.bround(base * (0.25 + 0.05 * (F.col("i") % 3))).cast("long").alias("readmissions"))


def notifications(patients: DataFrame, now: str, n: int = 8, key: str = "patient_id") -> DataFrame:
    """A notice for each of the patients of the highest risk, each 3 hours older than the one before."""
    top = patients.orderBy(F.desc("risk_score"), key).limit(n).withColumn("i", F.row_number().over(Window.orderBy(F.desc("risk_score"), key)) - 1)
    made = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), 3 * F.col("i") + 1)
    text = F.concat(F.lit("Risk score "), F.bround(F.col("risk_score") * 100).cast("int").cast("string"), F.lit("% for patient "), F.col(key).cast("string"))
    return top.select(F.concat(F.lit("n-"), F.col(key).cast("string")).alias("notification_id"), F.col(key), F.when(F.col("risk_score") >= 0.85, "critical").otherwise("warning").alias("severity"), text.alias("message"), made.alias("created_at")).orderBy(F.desc("created_at"))


def with_read(notices: DataFrame, reads: DataFrame, user: str) -> DataFrame:
    """Adds ``read``: whether the user has read a notice."""
    mine = reads.where(F.col("user_id") == user).select("notification_id", F.lit(True).alias("_r")).distinct()
    return notices.join(mine, "notification_id", "left").withColumn("read", F.coalesce("_r", F.lit(False))).drop("_r")


def mark_read(reads: DataFrame, user: str, notices: DataFrame, now: str) -> DataFrame:
    """``reads`` (user_id, notification_id, read_at) after a user has read ``notices``, one or all: a second reading replaces the first."""
    new = notices.select(F.lit(user).alias("user_id"), "notification_id", F.lit(now).alias("read_at")).distinct()
    mine = (F.col("user_id") == user).alias("_mine")
    kept = reads.select("user_id", "notification_id", "read_at").join(new.select("notification_id", F.lit(True).alias("_again")), "notification_id", "left")
    return kept.where(~F.coalesce(mine & F.col("_again"), F.lit(False))).select(new.columns).unionByName(new)


def unread(notices: DataFrame, reads: DataFrame, user: str) -> DataFrame:
    """One row: how many notices the user hasn't read."""
    return with_read(notices, reads, user).agg(F.count_if(~F.col("read")).alias("unread"))


# The names that a patient's columns have outside, of a list's entry and, further, of one patient's full record.
BASIC = {"patient_id": "id", "mrn": "mrn", "name": "name", "age": "age", "gender": "gender", "primary_diagnosis": "diagnosis", "risk_score": "riskScore", "risk_band": "riskBand", "length_of_stay": "lengthOfStay", "last_visit": "lastVisit"}
FULL = {"dob": "dob", "phone": "phone", "email": "email", "address": "address", "created_at": "createdAt", "updated_at": "updatedAt"}
FULL_LISTS = {"lab_results": "labResults", "diagnoses": "diagnoses", "medications": "medications", "risk_factors": "riskFactors", "interventions": "interventions", "timeline": "timeline"}


def projected(patients: DataFrame, full: bool = False) -> DataFrame:
    """Patients as they are shown: an entry of a list or, with ``full``, the whole record, whose lists are JSON text, ``[]`` if unknown.
    Columns that aren't there are null; the band follows from the score."""
    have = patients if "risk_band" in patients.columns else patients.withColumn("risk_band", risk_band(F.col("risk_score")))
    pick = lambda c: F.col(c) if c in have.columns else F.lit(None).cast("string")
    out = [pick(c).alias(n) for c, n in BASIC.items()]
    if full:
        out += [pick(c).alias(n) for c, n in FULL.items()] + [pick("primary_diagnosis").alias("primaryDiagnosis")]
        out += [F.coalesce(F.nullif(pick(c), F.lit("")), F.lit("[]")).alias(n) for c, n in FULL_LISTS.items()]
    return have.select(*out)


def get_patient(patients: DataFrame, patient) -> DataFrame:
    """The full record of one patient; the filter on the key reaches the scan."""
    return projected(patients.where(F.col("patient_id") == patient), full=True)


def count_patients(patients: DataFrame) -> DataFrame:
    return patients.agg(F.count("*").alias("n"))


def delete_patients(patients: DataFrame, gone: DataFrame) -> DataFrame:
    return patients.join(gone.select("patient_id").distinct(), "patient_id", "left_anti").select(patients.columns)


def recomputed(patients: DataFrame, scores: DataFrame, now: str) -> DataFrame:
    """``patients`` with the scores of ``scores`` (patient_id, score), their band, and the time of the change; others stay. Of several scores
    of a patient the highest counts."""
    new = scores.groupBy(F.col("patient_id").alias("_k")).agg(F.max("score").alias("_s"))
    changed = F.col("_s").isNotNull()
    rows = patients.join(new, F.col("patient_id") == F.col("_k"), "left")
    made = {"risk_score": F.coalesce("_s", "risk_score"), "risk_band": risk_band(F.coalesce("_s", "risk_score"))}
    made["updated_at"] = F.when(changed, F.lit(now)).otherwise(F.col("updated_at") if "updated_at" in patients.columns else F.lit(None).cast("string"))
    return rows.withColumns(made).drop("_k", "_s")


def overlay(table: DataFrame, changes: DataFrame, key: str = "patient_id", columns=UPDATABLE) -> DataFrame:
    """``table`` with the columns that may change taken from ``changes`` where they aren't null, and unknown keys added. Of changes that repeat
    a key, each column's largest value counts."""
    use = [c for c in columns if c in table.columns and c in changes.columns]
    changes = changes.groupBy(key).agg(*(F.max(c).alias(c) for c in use)) if use else changes.select(key).distinct()
    new = changes.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in use))
    kept = table.join(new, F.col(key) == F.col("_k"), "left").select(*((F.coalesce(f"_{c}", c) if c in use else F.col(c)).alias(c) for c in table.columns))
    added = changes.join(table.select(key), key, "left_anti").select(key, *use)
    return kept.unionByName(added, allowMissingColumns=True)


# Registered models: rows of name, version, stage, checksum, registered_at, path.


def register(registry: DataFrame, name: str, version: str, checksum: str, path: str, now: str) -> DataFrame:
    row = registry.sparkSession.createDataFrame([(name, version, "staging", checksum, now, path)], "name string, version string, stage string, checksum string, registered_at string, path string")
    return registry.where(~((F.col("name") == name) & (F.col("version") == version))).unionByName(row)


def promote(registry: DataFrame, name: str, version: str, stage: str) -> DataFrame:
    """Moves a version to a stage; a new production version archives the one before."""
    mine = F.col("name") == name
    moved = F.when(mine & (F.col("version") == version), stage)
    if stage == "production":
        moved = moved.when(mine & (F.col("stage") == "production"), "archived")
    return registry.withColumn("stage", moved.otherwise(F.col("stage")))


def delete_version(registry: DataFrame, name: str, version: str) -> DataFrame:
    """Without a version; one in production stays."""
    return registry.where(~((F.col("name") == name) & (F.col("version") == version) & (F.col("stage") != "production")))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path, to verify what was registered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """``expected``: file (its path under ``path``) and sha256. Returns file and status: ok, changed, missing, or unregistered."""
    rows = checksums(spark, path).select("sha256", "path", F.lit(path.rstrip("/") + "/").alias("_root"))
    found = rows.select(F.expr("substring_index(path, _root, -1)").alias("file"), F.col("sha256").alias("_found"))
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("sha256").isNull(), "unregistered").when(F.col("_found") == F.col("sha256"), "ok").otherwise("changed")
    return expected.select("file", "sha256").join(found, "file", "full").select("file", status.alias("status"))


def get_version(registry: DataFrame, name: str, version: str | None = "latest") -> DataFrame:
    """The row of a version; ``latest`` (or none) is the one registered last."""
    rows = registry.where(F.col("name") == name)
    if version not in (None, "latest"):
        return rows.where(F.col("version") == version)
    return rows.orderBy(F.desc("registered_at"), F.desc("version")).limit(1)


def listed(registry: DataFrame) -> DataFrame:
    """Each model with its versions in order of registration, and which is the latest."""
    each = registry.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("registered_at", "version"))).alias("_v"))
    return each.select("name", F.transform("_v", lambda v: v.version).alias("versions"), F.element_at("_v", -1).version.alias("latest"))


def versions(registry: DataFrame, name: str, stage: str | None = None) -> DataFrame:
    rows = registry.where((F.col("name") == name) & (F.col("version") != "latest"))
    return (rows.where(F.col("stage") == stage) if stage else rows).orderBy("registered_at", "version")
