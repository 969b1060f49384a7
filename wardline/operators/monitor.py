"""Drift, adverse events, compliance and status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASELINE = {"age": 55.0, "prediction": 0.35}


def drift(df: DataFrame, by: list[str] = (), sensitivity: float = 0.1, baseline: dict[str, float] | None = None) -> DataFrame:
    """The relative shift of each column's mean against its baseline (a missing value counts as 0), and the status: of the
    last column that drifts, else Stable."""
    baseline = baseline or BASELINE
    out = df.groupBy(*by).agg(*(F.avg(F.coalesce(c, F.lit(0.0))).alias(f"{c}_mean") for c in baseline))
    status = F.lit("Stable")
    for c, b in baseline.items():
        out = out.withColumn(f"{c}_shift", F.abs(F.col(f"{c}_mean") - b) / b)
        status = F.when(F.col(f"{c}_shift") > sensitivity, f"{c.title()} Drift").otherwise(status)
    return out.withColumn("status", status)


def sticky(batches: DataFrame, order: str, status: str = "status") -> DataFrame:
    """The status after the last batch when it never goes back to Stable: the last other one."""
    return batches.agg(F.coalesce(F.max_by(status, F.when(F.col(status) != "Stable", F.col(order))), F.lit("Stable")).alias("status"))


def recent_events(events: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The last ``n`` events, oldest first."""
    return events.orderBy(F.desc(order)).limit(n).orderBy(order)


def compliance(controls: DataFrame) -> DataFrame:
    """``controls``: standard, requirement, control, status (compliant, non_compliant, not_applicable). Percent compliant of
    those applicable, 100 if none is, by requirement, by standard (requirement null) and overall (both null)."""
    r = controls.rollup("standard", "requirement").agg(F.count_if(F.col("status") == "compliant").alias("compliant"), F.count_if(F.col("status") != "not_applicable").alias("applicable"))
    percent = F.when(F.col("applicable") == 0, 100.0).otherwise(100.0 * F.col("compliant") / F.col("applicable"))
    return r.withColumn("percent", percent).withColumn("band", F.when(percent >= 90, "excellent").when(percent >= 80, "good").when(percent >= 70, "fair").otherwise("poor"))


def control_status(documents: DataFrame, controls: dict[str, str], text: str = "text") -> DataFrame:
    """Controls with the pattern that proves them: compliant if it is in any text, else non_compliant; not_applicable without a
    pattern. Evidence: how many texts have it."""
    used = {c: p for c, p in controls.items() if p}
    counts = documents.agg(*(F.count_if(F.col(text).rlike(p)).alias(f"n{i}") for i, p in enumerate(used.values())), F.count("*").alias("_n"))
    rows = [F.struct(F.lit(c).alias("control"), F.col(f"n{i}").alias("evidence"), F.when(F.col(f"n{i}") > 0, "compliant").otherwise("non_compliant").alias("status")) for i, c in enumerate(used)]
    rows += [F.struct(F.lit(c).alias("control"), F.lit(0).cast("long").alias("evidence"), F.lit("not_applicable").alias("status")) for c in controls if c not in used]
    return counts.select(F.inline(F.array(*rows)))


def evidence(documents: DataFrame, pattern: str, key: str, text: str = "text", most: int = 10) -> DataFrame:
    """The first texts with a pattern."""
    return documents.where(F.col(text).rlike(pattern)).orderBy(key).limit(most)


# Date patterns of log lines, in the order they are tried, with their formats.
LOG_DATES = ((r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"(\d{2}/\d{2}/\d{4})", "MM/dd/yyyy"), (r"(\d{2}-\d{2}-\d{4})", "MM-dd-yyyy"), (r"(\d{4}/\d{2}/\d{2})", "yyyy/MM/dd"))


def log_date(line: Column) -> Column:
    """The date of a log line by the first pattern that fits and is a date; null for none."""
    tried = [F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(line, p, 1), F.lit("")), F.lit(f))) for p, f in LOG_DATES]
    return F.coalesce(*tried)


def in_range(line: Column, start: str, end: str) -> Column:
    """Lines without a date are in any range."""
    d = log_date(line)
    return d.isNull() | d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def anonymised(text: Column) -> Column:
    """Addresses, e-mails, users and patients replaced in a report's text."""
    for pattern, mark in ((r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"), (r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"), (r"(?i)\buser(name)?[:=]\s*\w+", "user=[USER]"), (r"(?i)\bpatient[_ ]?id[:=]\s*\w+", "patient_id=[PATIENT]")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def period_start(end: Column, period: str) -> Column:
    """The start of the day, week, month, quarter or year that ends at a date."""
    return {"day": F.date_sub(end, 1), "week": F.date_sub(end, 7), "month": F.add_months(end, -1), "quarter": F.add_months(end, -3), "year": F.add_months(end, -12)}[period]


# What to do about a control that isn't met, by a part of its id; the first part that fits counts.
REMEDIES = (
    ("hipaa-164-308", "Implement administrative safeguards for {} by updating security policies and procedures."),
    ("hipaa-164-310", "Implement physical safeguards for {} by enhancing facility security controls."),
    ("hipaa-164-312", "Implement technical safeguards for {} by enhancing system security controls."),
    ("gdpr-article-5", "Ensure compliance with data processing principles for {} by updating privacy policies."),
    ("gdpr-article-25", "Implement privacy by design and default for {} by integrating privacy controls into development processes."),
    ("gdpr-article-30", "Maintain records of processing activities for {} by documenting all data processing operations."),
    ("gdpr-article-32", "Enhance security of processing for {} by implementing additional technical and organizational measures."),
    ("gdpr-article-33", "Implement breach notification procedures for {} by establishing clear reporting workflows."),
    ("hitech-13401", "Implement breach notification procedures for {} by establishing notification templates and workflows."),
    ("hitech-13402", "Enhance breach reporting mechanisms for {} by establishing clear reporting channels."),
    ("hitech-13403", "Enhance breach reporting mechanisms for {} by establishing clear reporting channels."),
    ("hitech-13404", "Update business associate agreements for {} to include breach notification requirements."),
    ("hitech-13405", "Implement encryption and secure destruction methods for {} to protect PHI."),
)
_REVIEW = "Review and update policies and procedures related to {} to ensure compliance."


def remedy(control: Column, title: Column) -> Column:
    """What to do about a control of this id and title."""
    out = F.lit(_REVIEW)
    for part, text in reversed(REMEDIES):
        out = F.when(F.contains(control, F.lit(part)), text).otherwise(out)
    return F.replace(out, F.lit("{}"), title)


SEVERITY = {"PASS": 0, "UNKNOWN": 1, "WARN": 1, "FAIL": 2, "ERROR": 3}


def overall_status(checks: DataFrame, by: list[str] = ()) -> DataFrame:
    """The worst status of each group, with counts by status; unknown ones count as a warning."""
    level = F.lit(0)
    for s, n in SEVERITY.items():
        level = F.when(F.col("status") == s, n).otherwise(level)
    worst = F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "FAIL", "ERROR"))), F.max(level) + 1)
    return checks.groupBy(*by).agg(worst.alias("overall"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL", "ERROR", "UNKNOWN")))


def mock_metrics(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Placeholder metrics of a model by row, from hashes of its key."""
    u = lambda s: F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(s)), F.lit(10_007)) / 10_007.0
    return df.select(key, (0.8 + 0.15 * u("a")).alias("accuracy"), (0.7 + 0.2 * u("b")).alias("c_index"))
