"""From FHIR resources to one wide row of features for each patient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import icd, temporal
from wardline.sources import fhir


def features(resources: DataFrame, lab: str = "creatinine", windows=temporal.WINDOWS, aggregates=("mean", "min", "max", "std", "count")) -> DataFrame:
    """Demographics, condition groups and windows of one laboratory value that end at its last time, unknown numbers 0.

    The resources are flattened by kind; two aggregations by patient are joined to the patients. Series aren't interpolated.
    """
    people = fhir.patients(resources).select("patient_id", "gender", "birth_date")
    codes = icd.encode(fhir.conditions(resources), "code", "patient_id", "binary", "group")
    values = fhir.observations(resources).where(F.lower("code") == lab.lower()).select("patient_id", F.col("date").try_cast("timestamp_ntz").alias("time"), F.col("value_num").alias(lab)).where("time IS NOT NULL")
    labs = temporal.window_features(values, ["patient_id"], "time", lab, windows, aggregates).drop("ref")
    return people.join(codes, "patient_id", "left").join(labs, "patient_id", "left").fillna(0)


def joined(resources: DataFrame) -> DataFrame:
    """One row for each patient's observation, condition or medication: patients inner-joined with each kind on their id."""
    people = fhir.patients(resources).select("patient_id", "gender")
    kinds = {"observation": (fhir.observations, "date"), "condition": (fhir.conditions, "onset_date"), "medication": (fhir.medications, "authored_date")}
    rows = [people.join(f(resources).select("patient_id", F.lit(k).alias("kind"), F.col(date).alias("date"), "code"), "patient_id") for k, (f, date) in kinds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def run(resources: DataFrame, path: str, lab: str = "creatinine") -> None:
    features(resources, lab).write.mode("overwrite").parquet(path)
