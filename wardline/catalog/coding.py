"""Queries of ICD-10 codes over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.frames import Catalog
from wardline.functions import icd
from wardline.operators.icd import encode
from wardline.plans.cohort import DIAGNOSES_SQL, diagnoses

CATALOG = Catalog()
add = CATALOG.add

_NORMAL = f"{DIAGNOSES_SQL}, nx AS (SELECT *, CASE WHEN regexp_full_match(replace(upper(trim(code)), '.', ''), '[A-Z][0-9]+') THEN replace(upper(trim(code)), '.', '') ELSE '' END AS norm FROM dx), cx AS (SELECT *, rpad(substr(norm, 1, 3), 3, '0') AS cat FROM nx)"


def _chapter_sql() -> str:
    bounds = [(n, *n.replace("9A", "99").split("-")) for n in icd.CHAPTERS]
    return "CASE WHEN norm = '' THEN NULL " + " ".join(f"WHEN cat >= '{a}' AND cat <= '{b}' THEN '{n}'" for n, a, b in bounds) + " END"


@add(f"WITH {_NORMAL} SELECT encounter_id, line, norm, {_chapter_sql()} AS chapter, regexp_full_match(upper(trim(code)), '[A-Z][0-9]{{2}}(\\.[0-9]{{1,4}})?') AS is_valid FROM cx")
def icd_normalise(spark, sf):
    rows = diagnoses(spark, sf).withColumn("norm", icd.normal(F.col("code")))
    return rows.select("encounter_id", "line", "norm", icd.chapter(F.col("norm")).alias("chapter"), icd.valid(F.upper(F.trim("code"))).alias("is_valid"))


def _features(level, kind):
    if level == "chapter":
        tests = {f"icd_chapter_{n}": f"{_chapter_sql()} = '{n}'" for n in icd.CHAPTERS}
    elif level == "group":
        tests = {f"icd_group_{g}": f"norm <> '' AND substr(norm, 1, 3) IN ({', '.join(repr(x) for x in p)})" for g, p in icd.GROUPS.items()}
    elif level == "category":
        tests = {f"icd_category_{c}": f"norm <> '' AND cat = '{c}'" for c in _CATEGORIES}
    else:
        tests = {f"icd_custom_{g}": " OR ".join(f"norm LIKE '{x}%'" for x in p if x) or "FALSE" for g, p in _CUSTOM.items()}
    total = "max(CAST(coalesce({}, FALSE) AS INTEGER))" if kind == "binary" else "CAST(sum(CAST(coalesce({}, FALSE) AS INTEGER)) AS BIGINT)"
    return f"WITH {_NORMAL} SELECT patient_id, " + ", ".join(f'{total.format(t)} AS "{n}"' for n, t in tests.items()) + " FROM cx GROUP BY patient_id"


_CUSTOM = {"a_block": ["A1", "A2"], "b_code": ["B27"], "none": [""]}
_CATEGORIES = ["A00", "B01", "C02", "Z25"]

for _level in ("chapter", "group", "category", "custom"):
    for _kind in ("binary", "count"):

        def _query(spark, sf, level=_level, kind=_kind):
            return encode(diagnoses(spark, sf), "code", "patient_id", kind, level, _CUSTOM, _CATEGORIES)

        add(_features(_level, _kind), f"icd_{_level}_{_kind}")(_query)


@add(f"WITH {DIAGNOSES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE NOT regexp_full_match(code, '[A-Z][0-9]{{2}}(\\.[0-9]{{1,4}})?')) AS invalid FROM dx")
def icd_validity(spark, sf):
    return diagnoses(spark, sf).agg(F.count("*").alias("total"), F.count_if(~icd.valid(F.col("code"))).alias("invalid"))
