"""ICD-10 features: presence or counts of chapters, categories and condition groups, by patient in one aggregation or row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.frames import require
from wardline.functions import icd

KINDS, LEVELS = ("binary", "count"), ("chapter", "category", "group", "custom")


def _tests(level: str, custom: dict[str, list[str]] | None, categories: list[str]) -> dict[str, Callable[[Column, Column, Column], Column]]:
    """By feature, whether a code has it, given its normal form, its category and its chapter."""
    if level == "category":
        return {f"icd_category_{c}": lambda code, three, chapter, c=c: three == c for c in categories}
    if level == "chapter":
        return {f"icd_chapter_{c}": lambda code, three, chapter, c=c: chapter == c for c in icd.CHAPTERS}
    groups = icd.GROUPS if level == "group" else (custom or {})
    test = lambda p: (lambda code, three, chapter: F.substring(code, 1, 3).isin(p)) if all(len(x) == 3 for x in p) else (lambda code, three, chapter: icd.starts_with_any(code, p))
    return {f"icd_{level}_{g}": test(p) for g, p in groups.items()}


def _known(kind: str, level: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")


def _coded(rows: DataFrame, code: Column) -> DataFrame:
    """Adds a code's normal form, category and chapter, each a column of its own, so that it is computed once."""
    rows = rows.withColumn("_code", icd.normal(code))
    rows = rows.withColumn("_three", F.when(F.length("_code") > 0, icd.category(F.col("_code"))))
    return rows.withColumn("_chapter", icd.chapter_of(F.col("_three")))


def _categories(rows: DataFrame, categories: list[str] | None, level: str) -> list[str]:
    if level != "category" or categories is not None:
        return categories or []
    return sorted(r[0] for r in rows.select("_three").where("_three IS NOT NULL").distinct().collect())


def encode(df: DataFrame, code: str = "code", patient: str = "patient_id", kind: str = "binary", level: str = "group", custom: dict[str, list[str]] | None = None, categories: list[str] | None = None) -> DataFrame:
    """One row for each patient and one column for each chapter, group or category, 0 where a patient has none.

    Codes are normalised first; those that aren't valid count for nothing. A code counts in every group it is in. The
    categories are those given or, by a job of their own, all that occur.
    """
    require(df, [code, patient])
    _known(kind, level)
    rows = _coded(df.where(F.col(patient).isNotNull()), F.col(code))
    total = (lambda test: F.max(test.cast("int"))) if kind == "binary" else (lambda test: F.sum(test.cast("int")))
    tests = _tests(level, custom, _categories(rows, categories, level))
    if not tests:
        return rows.select(patient).distinct()
    has = {n: t(F.col("_code"), F.col("_three"), F.col("_chapter")) for n, t in tests.items()}
    return rows.groupBy(patient).agg(*(F.coalesce(total(F.coalesce(t, F.lit(False))), F.lit(0)).alias(n) for n, t in has.items()))


def encode_rows(df: DataFrame, code: str = "code", kind: str = "binary", level: str = "group", custom: dict[str, list[str]] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Every row with its own features behind its columns; ``code`` is one code or an array of codes. No shuffle, unless the
    categories have to be found."""
    require(df, [code])
    _known(kind, level)
    codes = F.col(code) if dict(df.dtypes)[code].startswith("array") else F.array(code)
    if level == "category" and categories is None:
        categories = _categories(_coded(df.select(F.explode(codes).alias("_one")), F.col("_one")), None, level)
    normal = lambda c: F.struct(icd.normal(c).alias("code"), F.when(F.length(icd.normal(c)) > 0, icd.category(icd.normal(c))).alias("three"))
    parts = lambda s: F.struct(s.code.alias("code"), s.three.alias("three"), icd.chapter_of(s.three).alias("chapter"))
    rows = df.withColumn("_codes", F.transform(F.transform(F.coalesce(codes, F.array().cast("array<string>")), normal), parts))
    hits = lambda t: F.size(F.filter("_codes", lambda s: F.coalesce(t(s.code, s.three, s.chapter), F.lit(False))))
    value = (lambda n: F.least(n, F.lit(1))) if kind == "binary" else (lambda n: n)
    return rows.withColumns({n: value(hits(t)).cast("int") for n, t in _tests(level, custom, categories or []).items()}).drop("_codes")
