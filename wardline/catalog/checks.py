"""Queries of data validation, detection of personal data and de-identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.clinical import rounded
from wardline.frames import Catalog, table
from wardline.functions import phi
from wardline.operators import privacy as V
from wardline.operators import quality as Q
from wardline.plans.cohort import ENCOUNTERS_SQL, GAPS_SQL, encounters, labs

CATALOG = Catalog()
add = CATALOG.add

_SCHEMA = {
    "p_partkey": {"type": "integer", "required": True, "unique": True},
    "p_size": {"type": "integer", "min": 3, "max": 48},
    "p_brand": {"type": "string", "pattern": r"Brand#[1-4]\d"},
    "p_type": {"type": "category", "categories": ["ECONOMY", "STANDARD"]},
    "p_retailprice": {"type": "float", "max": 1500},
    "p_origin": {"type": "string", "required": True},
}


@add("""SELECT CAST(p_partkey AS VARCHAR) AS key, 'p_size' AS "column", 'min' AS rule, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size < 3
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_size', 'max', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 48
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_brand', 'pattern', p_brand FROM part WHERE NOT regexp_matches(p_brand, '^(?:Brand#[1-4]\\d)')
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_type', 'category', p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD')
    UNION ALL SELECT NULL, 'p_origin', 'missing', NULL""")
def schema_errors(spark, sf):
    return Q.schema_errors(table(spark, sf, "part"), {k: r for k, r in _SCHEMA.items() if k != "p_retailprice"}, "p_partkey")


@add(f"""WITH {ENCOUNTERS_SQL} SELECT CAST(0 AS INTEGER) AS rule, 'temporal' AS type, count(*) FILTER (WHERE admission_date > discharge_date) AS violations FROM enc
    UNION ALL SELECT 1, 'logical', count(*) FILTER (WHERE mortality = 1 AND NOT complication = 0) FROM enc UNION ALL SELECT 2, 'referential', count(*) FILTER (WHERE patient_id NOT IN (SELECT encounter_id FROM enc)) FROM enc""")
def relationship_violations(spark, sf):
    rules = [{"type": "temporal", "start": "admission_date", "end": "discharge_date"}, {"type": "logical", "condition": "mortality == 1", "implication": "complication == 0"}, {"type": "referential", "source": "patient_id", "target": "encounter_id"}]
    return Q.relationship_violations(encounters(spark, sf), rules)


@add("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey AS key, 'o_totalprice' AS "column", o_totalprice AS value FROM orders, q WHERE o_totalprice < a - 0.3 * (b - a) OR o_totalprice > b + 0.3 * (b - a)""")
def outliers_iqr(spark, sf):
    return Q.outliers(table(spark, sf, "orders"), ["o_totalprice"], "o_orderkey", "iqr", 0.3)


@add("""WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id AS key, 'value' AS "column", value FROM events, q WHERE value < m - 2 * s OR value > m + 2 * s""")
def outliers_zscore(spark, sf):
    return Q.outliers(table(spark, sf, "events"), ["value"], "event_id", "z-score", 2)


@add(f"""WITH {GAPS_SQL}, m AS (SELECT count(*) AS n, count(*) - count(event_id) AS a, count(*) - count(patient_id) AS b, count(*) - count(ts) AS c, count(*) - count(variable) AS d, count(*) - count(value) AS e FROM labs)
    SELECT 'event_id' AS "column", a AS missing, round(100.0::DOUBLE * a / n, 2) AS percent FROM m UNION ALL SELECT 'patient_id', b, round(100.0::DOUBLE * b / n, 2) FROM m UNION ALL SELECT 'ts', c, round(100.0::DOUBLE * c / n, 2) FROM m
    UNION ALL SELECT 'variable', d, round(100.0::DOUBLE * d / n, 2) FROM m UNION ALL SELECT 'value', e, round(100.0::DOUBLE * e / n, 2) FROM m""")
def missing_profile(spark, sf):
    return Q.missing_profile(labs(spark, sf, gaps=True))


@add("SELECT o_orderkey, c AS copies FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority) AS c FROM orders) WHERE c > 1")
def duplicate_rows(spark, sf):
    return Q.duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"]).select("o_orderkey", "copies")


@add("SELECT CAST(count(*) - count(DISTINCT (p_brand, p_type, p_size)) AS BIGINT) AS duplicates FROM part")
def duplicate_count(spark, sf):
    return Q.duplicate_count(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@add(f"""WITH {ENCOUNTERS_SQL} SELECT 'dead_are_old' AS rule, count(*) FILTER (WHERE mortality = 1) AS matched, count(*) FILTER (WHERE mortality = 1 AND NOT expected > 0.2) AS violations, count(*) FILTER (WHERE mortality = 1 AND NOT expected > 0.2) = 0 AS valid FROM enc
    UNION ALL SELECT 'stays_are_short', count(*) FILTER (WHERE expected_los >= 4), 0, TRUE FROM enc""")
def consistency_rules(spark, sf):
    return Q.consistency(encounters(spark, sf), {"dead_are_old": ("mortality == 1", "expected > 0.2"), "stays_are_short": ("expected_los >= 4", "expected_los < 15")})


@add("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' OR o_orderdate > TIMESTAMP '1997-06-30'")
def date_range_violations(spark, sf):
    return Q.date_range_violations(table(spark, sf, "orders"), "o_orderdate", "1993-01-01", "1997-06-30").select("o_orderkey")


@add("""WITH l AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS v FROM customer UNION ALL SELECT 'c_name', c_name FROM customer), c AS (SELECT "column", v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS k, count(*) OVER (PARTITION BY "column") AS d FROM c) SELECT "column", d AS distinct_values, v AS top, n AS top_count FROM r WHERE k = 1""")
def categorical_profile(spark, sf):
    return Q.categorical_profile(table(spark, sf, "customer"), ["c_mktsegment", "c_name"])


@add("""WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b, quantile_cont(p_size, 0.25) AS c, quantile_cont(p_size, 0.75) AS d FROM part)
    SELECT 'p_retailprice' AS "column", count(*) AS outliers FROM part, q WHERE p_retailprice < a - 0.2 * (b - a) OR p_retailprice > b + 0.2 * (b - a) UNION ALL SELECT 'p_size', count(*) FROM part, q WHERE p_size < c - 0.2 * (d - c) OR p_size > d + 0.2 * (d - c)""")
def numeric_outlier_counts(spark, sf):
    return Q.numeric_outlier_counts(table(spark, sf, "part"), ["p_retailprice", "p_size"], 0.2)


def _outlying(c):
    return f"(SELECT count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) FROM labs, (SELECT quantile_cont({c}, 0.25)::DOUBLE AS a, quantile_cont({c}, 0.75)::DOUBLE AS b FROM labs))"


@add(f"""WITH {GAPS_SQL}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) - count(value) AS gaps, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labs)) AS twice FROM labs),
    s AS (SELECT gaps / n AS missing_share, twice / n AS duplicate_share, greatest({_outlying("event_id")}, {_outlying("patient_id")}, {_outlying("value")}) / n AS outlier_share FROM n)
    SELECT round(missing_share, 6) AS missing_share, round(duplicate_share, 6) AS duplicate_share, round(outlier_share, 6) AS outlier_share, missing_share <= 0.1 AND duplicate_share <= 0.05 AND outlier_share <= 0.1 AS passed FROM s""")
def data_pipeline_gate(spark, sf):
    return rounded(Q.pipeline_gate(labs(spark, sf, gaps=True)), "missing_share", "duplicate_share", "outlier_share")


@add(f"""WITH {ENCOUNTERS_SQL}, q AS (SELECT quantile_cont(expected, 0.25) AS a, quantile_cont(expected, 0.75) AS b FROM enc),
    c AS (SELECT count(*) FILTER (WHERE expected > 0.5) + CAST(count(*) > count(DISTINCT encounter_id) AS BIGINT) AS schema_errors, CAST(count(*) FILTER (WHERE admission_date > discharge_date) > 0 AS BIGINT) AS broken_relationships,
      CAST(count(*) FILTER (WHERE mortality = 1 AND NOT expected > 0.2) > 0 AS BIGINT) AS failed_rules, CAST(0 AS INTEGER) AS has_missing, CAST(count(*) FILTER (WHERE expected < a - 1.5 * (b - a) OR expected > b + 1.5 * (b - a)) > 0 AS BIGINT) AS outlying_columns,
      CAST(count(*) > count(DISTINCT encounter_id) AS INTEGER) AS has_duplicates FROM enc, q)
    SELECT *, schema_errors + broken_relationships + failed_rules AS errors, has_missing + outlying_columns + has_duplicates AS warnings, schema_errors + broken_relationships + failed_rules = 0 AS valid FROM c""")
def validation_report(spark, sf):
    return Q.validation_report(encounters(spark, sf), "encounter_id", {"encounter_id": {"type": "integer", "unique": True}, "expected": {"type": "float", "max": 0.5}}, [{"type": "temporal", "start": "admission_date", "end": "discharge_date"}], {"old": ("mortality == 1", "expected > 0.2")}, ["expected"], ["encounter_id"])


@add(f"WITH {GAPS_SQL} SELECT count(*) AS n_rows, CAST(5 AS INTEGER) AS n_columns, CAST(sum((event_id IS NULL)::INT + (patient_id IS NULL)::INT + (ts IS NULL)::INT + (variable IS NULL)::INT + (value IS NULL)::INT) AS BIGINT) AS n_missing, 'struct<event_id:bigint,patient_id:bigint,ts:timestamp_ntz,variable:string,value:double>' AS schema FROM labs")
def lineage_metrics(spark, sf):
    return Q.lineage_metrics(labs(spark, sf, gaps=True))


@add()
def train_test_split(spark, sf):
    return Q.split(table(spark, sf, "labels"), "doc_id", 0.3, "toxic")


_NINE = [k for k in phi.PATTERNS if k != "name"]


def _count_sql(k):
    pattern = phi.PATTERNS[k].replace("'", "''")
    return f"CAST(sum(len(regexp_extract_all(text, '{pattern}'))) AS BIGINT)"


@add(" UNION ALL ".join(f"SELECT source, 'text' AS \"column\", '{k}' AS kind, {_count_sql(k)} AS instances FROM documents GROUP BY source" for k in _NINE))
def phi_counts_by_source(spark, sf):
    return V.phi_counts(table(spark, sf, "documents"), ["text"], ["source"], _NINE)


@add()
def phi_report(spark, sf):
    return V.phi_report(table(spark, sf, "documents"), "doc_id")


@add("SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR) || 'pepper') AS id_hash, sha256(c_name || 'pepper') AS name_hash FROM customer")
def deid_hash(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", V.hashed(F.col("c_custkey"), "pepper").alias("id_hash"), V.hashed(F.col("c_name"), "pepper").alias("name_hash"))


_SHIFT = "CAST(CAST(('0x' || substr(sha256(CAST(o_custkey AS VARCHAR) || 'pepper'), 1, 8)) AS BIGINT) % 730 - 365 AS INTEGER)"


@add(f"SELECT o_orderkey, {_SHIFT} AS days, o_orderdate + to_days({_SHIFT}) AS moved FROM orders")
def deid_date_shift(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", V.shift_days(F.col("o_custkey"), "pepper").alias("days"), V.shifted(F.col("o_orderdate"), F.col("o_custkey"), "pepper").alias("moved"))


_AGE = "CAST(18 + c_custkey % 80 AS INTEGER)"


@add(f"SELECT c_custkey, CASE WHEN {_AGE} >= 89 THEN '89+' ELSE CAST({_AGE} AS VARCHAR) END AS age FROM customer")
def age_truncate(spark, sf):
    return _people(spark, sf).select("c_custkey", V.truncated_age(F.col("age")).alias("age"))


def _people(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", (18 + F.col("c_custkey") % 80).cast("int").alias("age"), F.col("c_mktsegment").alias("race"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"))


_PEOPLE = f"pp AS (SELECT c_custkey, {_AGE} AS age, c_mktsegment AS race, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer)"


@add(f"""WITH {_PEOPLE}, n AS (SELECT *, count(*) OVER (PARTITION BY age, race, gender) AS n FROM pp)
    SELECT c_custkey, CASE WHEN n >= 4 THEN CAST(age AS VARCHAR) WHEN age >= 89 THEN '89+' ELSE CAST(age // 5 * 5 AS VARCHAR) || '-' || CAST(age // 5 * 5 + 4 AS VARCHAR) END AS age, CASE WHEN n < 4 THEN '[REDACTED]' ELSE race END AS race, CASE WHEN n < 4 THEN '[REDACTED]' ELSE gender END AS gender FROM n""")
def k_anonymity(spark, sf):
    return V.k_anonymous(_people(spark, sf), ["age", "race", "gender"], 4)


@add(f"WITH {_PEOPLE} SELECT age, race, gender, count(*) AS n FROM pp GROUP BY ALL HAVING count(*) < 4")
def k_anonymity_small_groups(spark, sf):
    return V.small_groups(_people(spark, sf), ["age", "race", "gender"], 4)


@add(f"""WITH {ENCOUNTERS_SQL} SELECT sha256(CAST(patient_id AS VARCHAR) || 's') AS patient_id, encounter_id, admission_date + to_days(CAST(CAST(('0x' || substr(sha256(CAST(patient_id AS VARCHAR) || 's'), 1, 8)) AS BIGINT) % 730 - 365 AS INTEGER)) AS admission_date, mortality FROM enc""")
def deidentified_encounters(spark, sf):
    rows = encounters(spark, sf).select("patient_id", "encounter_id", "admission_date", "mortality")
    return V.deidentify(rows, "patient_id", V.Deidentification("s"), ["admission_date"])


@add("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}\\b', '[REDACTED]', 'g'), '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b', '[REDACTED]', 'g')) AS digest FROM documents")
def phi_masked_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(phi.masked(F.col("text"), ("email", "ip_address"))).alias("digest"))
