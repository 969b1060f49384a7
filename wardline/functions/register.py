"""The library's scalar functions for SQL, as temporary SQL functions: no Python runs when they are called."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wardline.functions.icd import CHAPTERS
from wardline.functions.phi import PATTERNS


def register(spark: SparkSession) -> list[str]:
    """Creates normalize_icd10, icd_chapter, is_icd10, deid_hash, risk_band and phi_instances; returns their names."""
    plain = "replace(upper(trim(code)), '.', '')"
    category = "rpad(substring(replace(code, '.', ''), 1, 3), 3, '0')"
    chapters = " ".join(f"WHEN {category} >= '{a}' AND {category} <= '{b}' THEN '{n}'" for n in CHAPTERS for a, b in [n.replace("9A", "99").split("-")])
    counts = " + ".join(f"regexp_count(content, r'{p}')" for p in PATTERNS.values() if "'" not in p)
    functions = {
        "normalize_icd10(code STRING) RETURNS STRING": f"CASE WHEN {plain} RLIKE '^[A-Z][0-9]+$' THEN {plain} ELSE '' END",
        "icd_chapter(code STRING) RETURNS STRING": f"CASE WHEN length(code) = 0 THEN NULL {chapters} END",
        "is_icd10(code STRING) RETURNS BOOLEAN": r"code RLIKE r'^[A-Z][0-9]{2}(\.[0-9]{1,4})?$'",
        "deid_hash(value STRING, salt STRING) RETURNS STRING": "CASE WHEN value = '' THEN value ELSE sha2(concat(value, salt), 256) END",
        "risk_band(score DOUBLE) RETURNS STRING": "CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END",
        "phi_instances(content STRING) RETURNS BIGINT": f"coalesce(CAST({counts} AS BIGINT), 0)",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in functions]
