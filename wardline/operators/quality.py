"""Data validation: schema rules, relationships, outliers, missing values, duplicates, consistency, profiles.

Rules are configuration; checks of one kind are one aggregation over the frame, and errors are rows of an error table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.frames import exact_quantiles, null_safe, require, running_totals

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_missing(df: DataFrame, column: str) -> Column:
    return F.col(column).isNull() | F.isnan(column) if dict(df.dtypes)[column] in ("float", "double") else F.col(column).isNull()


def _predicate(text: str) -> Column:
    """A comparison in Python's operators, joined by and, or and not, as a Column; a missing value makes it false."""
    if not re.fullmatch(r"[\w\s.<>=!&|~()'\"+\-*/%]+", text) or ";" in text or "--" in text:
        raise ValueError(f"not a predicate: {text!r}")
    sql = re.sub(r"(?<![<>=!])==", "=", text)
    sql = re.sub(r"&&?", " AND ", sql)
    sql = re.sub(r"\|\|?", " OR ", sql)
    return F.coalesce(F.expr(re.sub(r"~", " NOT ", sql)), F.lit(False))


def _checks(column: str, rule: dict) -> list[tuple[str, Column]]:
    """(name, failure) of a column's rules; values are checked as text, so that any input type is."""
    c, s = F.col(column), F.col(column).cast("string")
    number, present = s.try_cast("double"), c.isNotNull()
    out, kind = [], rule.get("type")
    if rule.get("required"):
        out.append(("required", c.isNull()))
    if kind in ("int", "integer"):
        out.append(("integer", present & (number.isNull() | (number != F.floor(number)))))
    elif kind in ("float", "numeric"):
        out.append(("float", present & number.isNull()))
    elif kind == "boolean":
        out.append(("boolean", present & ~s.isin("0", "1", "true", "false", "True", "False")))
    elif kind in ("date", "datetime"):
        out.append(("datetime", present & s.try_cast("timestamp").isNull()))
    if rule.get("min") is not None:
        out.append(("min", F.coalesce(number < rule["min"], F.lit(False))))
    if rule.get("max") is not None:
        out.append(("max", F.coalesce(number > rule["max"], F.lit(False))))
    if rule.get("categories"):
        out.append(("category", present & ~s.isin([str(x) for x in rule["categories"]])))
    if rule.get("pattern"):
        out.append(("pattern", present & ~s.rlike(f"^(?:{rule['pattern']})")))
    return out


def schema_errors(df: DataFrame, schema: dict[str, dict], key: str) -> DataFrame:
    """One row for each failed rule of a row: key, column, rule, value. A required column that is absent and values of a
    unique column that repeat are one row each, without key."""
    lacking = [c for c, r in schema.items() if c not in df.columns and r.get("required")]
    checks = [(c, n, fail) for c, r in schema.items() if c in df.columns for n, fail in _checks(c, r)]
    parts = [F.when(fail, F.struct(F.lit(c).alias("column"), F.lit(n).alias("rule"), F.col(c).cast("string").alias("value"))) for c, n, fail in checks]
    id_ = F.col(key).cast("string").alias("key")
    empty = df.sparkSession.createDataFrame([(None, c, "missing", None) for c in lacking], "key string, column string, rule string, value string")
    rows = df.select(id_, F.explode(F.array_compact(F.array(*parts))).alias("e")).select("key", "e.column", "e.rule", "e.value") if parts else empty.limit(0)
    out = rows.unionByName(empty)
    for c in (c for c, r in schema.items() if c in df.columns and r.get("unique")):
        repeats = df.groupBy(c).count().where("count > 1").agg(F.sum(F.col("count") - 1).alias("n")).where("n > 0")
        out = out.unionByName(repeats.select(F.lit(None).cast("string").alias("key"), F.lit(c).alias("column"), F.lit("unique").alias("rule"), F.col("n").cast("string").alias("value")))
    return out


def relationship_violations(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Violations by rule. Rules: {type: temporal, start, end, operator}, {type: logical, condition, implication},
    {type: referential, source, target}. Missing values never violate a temporal rule; other operators than <=, < and >= pass."""
    counts, joined = [], []
    for i, r in enumerate(rules):
        name = f"r{i}"
        if r["type"] == "temporal":
            a, b = F.col(r["start"]), F.col(r["end"])
            bad = {"<=": a > b, "<": a >= b, ">=": a < b}.get(r.get("operator", "<="), F.lit(False))
            counts.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(name))
        elif r["type"] == "logical":
            counts.append(F.count_if(_predicate(r["condition"]) & ~_predicate(r["implication"])).alias(name))
        elif r["type"] == "referential":
            target = df.select(F.col(r["target"]).alias("_t")).distinct()
            lost = df.join(target, F.col(r["source"]).eqNullSafe(F.col("_t")), "left_anti").agg(F.count("*").alias("violations"))
            joined.append(lost.select(F.lit(i).alias("rule"), F.lit(r["type"]).alias("type"), "violations"))
        else:
            raise ValueError(f"unknown relationship {r['type']!r}")
    out = joined
    if counts:
        names = [i for i, r in enumerate(rules) if r["type"] != "referential"]
        array = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(rules[i]["type"]).alias("type"), F.col(f"r{i}").alias("violations")) for i in names))
        out = [df.agg(*counts).select(F.inline(array)), *joined]
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def outliers(df: DataFrame, columns: list[str], key: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """One row for each value outside its column's fences: quartiles and ``threshold`` ranges (iqr), or as many standard
    deviations from the mean (z-score). Values that aren't numbers are skipped."""
    require(df, [*columns, key])
    if method not in ("iqr", "z-score"):
        raise ValueError(f"unknown method {method!r}")
    long = df.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").try_cast("double").alias("value")) for c in columns))).alias("x")).select("key", "x.*")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    if method == "iqr":
        stats = exact_quantiles(long, "value", [0.25, 0.75], ["column"]).select("column", (F.col("q")[0] - threshold * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + threshold * (F.col("q")[1] - F.col("q")[0])).alias("high"))
    else:
        stats = long.groupBy("column").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("s > 0").select("column", (F.col("m") - threshold * F.col("s")).alias("low"), (F.col("m") + threshold * F.col("s")).alias("high"))
    return long.join(F.broadcast(stats), "column").where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).select("key", "column", "value")


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing values by column: count, and percent of rows to two places (half to even)."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)))
    return counts.select("n", F.inline(each)).select("column", "missing", F.coalesce(F.bround(100.0 * F.col("missing") / F.nullif(F.col("n"), F.lit(0)), 2), F.lit(0.0)).alias("percent"))


def duplicates(df: DataFrame, subset: list[str]) -> DataFrame:
    """All rows of groups that share the values of ``subset``, with the group's size. Only keys that repeat are joined back."""
    many = df.groupBy(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(subset))).agg(F.count("*").alias("copies")).where("copies > 1")
    on = F.lit(True)
    for i, c in enumerate(subset):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    return df.join(many, on).select(*df.columns, "copies")


def duplicate_count(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    return df.groupBy(*(subset or df.columns)).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def invalid_codes(df: DataFrame, column: str) -> DataFrame:
    from wardline.functions.icd import valid

    return df.where(F.col(column).isNotNull() & ~valid(F.col(column)))


def date_range_violations(df: DataFrame, column: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Rows whose time is before ``low`` or after ``high``; values that are no time are skipped."""
    t = F.col(column).cast("string").try_cast("timestamp_ntz")
    bad = F.lit(False)
    if low:
        bad = bad | (t < F.lit(low).cast("timestamp_ntz"))
    if high:
        bad = bad | (t > F.lit(high).cast("timestamp_ntz"))
    return df.where(F.coalesce(bad, F.lit(False)))


def consistency(df: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """For each rule (condition, expectation): rows that match, rows that match and fail, and whether none fails."""
    counts = []
    for i, (condition, expected) in enumerate(rules.values()):
        c = _predicate(condition)
        counts += [F.count_if(c).alias(f"m{i}"), F.count_if(c & ~_predicate(expected)).alias(f"v{i}")]
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"m{i}").alias("matched"), F.col(f"v{i}").alias("violations"), (F.col(f"v{i}") == 0).alias("valid")) for i, n in enumerate(rules)))
    return df.agg(*counts).select(F.inline(each))


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, the most frequent (the smallest if several) and how often, by text column; missing values don't count."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))).alias("x")).select("x.*").where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    return counts.groupBy("column").agg(F.count("*").alias("distinct_values"), top.alias("t")).select("column", "distinct_values", F.col("t.value").alias("top"), (-F.col("t.n")).alias("top_count"))


def numeric_outlier_counts(df: DataFrame, columns: list[str] | None = None, threshold: float = 1.5) -> DataFrame:
    columns = columns or [c for c, k in df.dtypes if k in NUMERIC]
    long = df.withColumn("_k", F.lit(0))
    found = outliers(long, columns, "_k", "iqr", threshold).groupBy("column").agg(F.count("*").alias("outliers"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("outliers", F.lit(0)).alias("outliers"))


def pipeline_gate(df: DataFrame, most_missing: float = 0.1, most_duplicates: float = 0.05, most_outliers: float = 0.1) -> DataFrame:
    """One row: the worst column's share of missing values and of outliers, the share of duplicate rows, and the verdict."""
    n = df.agg(F.count("*").alias("n"))
    missing = missing_profile(df).agg(F.max("missing").alias("missing"))
    out = numeric_outlier_counts(df).agg(F.max("outliers").alias("outliers"))
    r = n.crossJoin(missing).crossJoin(duplicate_count(df)).crossJoin(out)
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n").cast("double")), F.lit(0.0))
    r = r.select(share("missing").alias("missing_share"), share("duplicates").alias("duplicate_share"), share("outliers").alias("outlier_share"))
    return r.withColumn("passed", (F.col("missing_share") <= most_missing) & (F.col("duplicate_share") <= most_duplicates) & (F.col("outlier_share") <= most_outliers))


def validation_report(df: DataFrame, key: str, schema: dict, relationships: list[dict], rules: dict[str, tuple[str, str]], numeric: list[str], subset: list[str]) -> DataFrame:
    """One row: errors (schema, relationships, failed rules) and warnings (missing values, outlying columns, duplicates)."""
    errors = schema_errors(df, schema, key).agg(F.count("*").alias("schema_errors"))
    broken = relationship_violations(df, relationships).agg(F.sum((F.col("violations") > 0).cast("int")).alias("broken_relationships"))
    failed = consistency(df, rules).agg(F.sum((~F.col("valid")).cast("int")).alias("failed_rules"))
    gaps = missing_profile(df).agg(F.max((F.col("missing") > 0).cast("int")).alias("has_missing"))
    odd = outliers(df, numeric, key).agg(F.count_distinct("column").alias("outlying_columns"))
    twice = duplicate_count(df, subset).select((F.col("duplicates") > 0).cast("int").alias("has_duplicates"))
    r = errors.crossJoin(broken).crossJoin(failed).crossJoin(gaps).crossJoin(odd).crossJoin(twice)
    return r.withColumn("errors", F.col("schema_errors") + F.col("broken_relationships") + F.col("failed_rules")).withColumn("warnings", F.col("has_missing") + F.col("outlying_columns") + F.col("has_duplicates")).withColumn("valid", F.col("errors") == 0)


def lineage_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns and missing values of a dataset, with its schema as text."""
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + F.count_if(is_missing(df, c))
    return df.agg(F.count("*").alias("n_rows"), missing.alias("n_missing")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_missing", F.lit(df.schema.simpleString()).alias("schema"))


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows, the same on every run: those of the smallest hashes."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def split(df: DataFrame, key: str, share: float = 0.2, stratum: str | None = None, seed: int = 42) -> DataFrame:
    """Adds ``part``, train or test, by a hash of the key; with ``stratum``, in exact proportion within each value, whose
    rows run in bins of their hash, so that no task holds a whole stratum. Rows that repeat a key go to the same part."""
    if stratum is None:
        return df.withColumn("part", F.when(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) < int(share * 10_000), "test").otherwise("train"))
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    cells = running_totals(hashed.groupBy(stratum, "_h").agg(F.count("*").alias("_c")), "_h", ["_c"], [stratum])
    before = F.col("_c_total") - F.col("_c_upto")
    place = F.coalesce(F.try_divide(before.cast("double"), (F.col("_c_total") - 1).cast("double")), F.lit(0.0))
    test = cells.select(F.col(stratum).alias(f"_k_{stratum}"), F.col("_h").alias("_k__h"), (place < share).alias("_t"))
    placed = hashed.join(test, null_safe([stratum, "_h"]))
    return placed.select(*df.columns, F.when(F.col("_t"), "test").otherwise("train").alias("part"))
