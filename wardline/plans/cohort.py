"""The clinical views of the general test tables: encounters, lab series, diagnosis codes, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.frames import table


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as encounters of customers, with the customer's segment, nation and region."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderkey").alias("encounter_id"),
        F.col("o_orderdate").alias("admission_date"),
        F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 14 + 1 AS INT))").alias("discharge_date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("mortality"),
        ((F.floor("o_totalprice") % 1000) / 2000.0 + 0.05).alias("expected"),
        ((F.col("o_orderkey") % 7) / 20.0 + 0.01).alias("expected_readmission"),
        ((F.col("o_orderkey") % 5) + 4.0).alias("expected_los"),
        (F.col("o_orderkey") % 9 == 0).cast("int").alias("complication"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
    )


#: The same view in DuckDB's SQL, to stand before a query.
ENCOUNTERS_SQL = """enc AS (SELECT o_custkey AS patient_id, o_orderkey AS encounter_id, o_orderdate AS admission_date,
    o_orderdate + to_days(CAST(o_orderkey % 14 + 1 AS INTEGER)) AS discharge_date, CAST(o_orderstatus = 'F' AS INTEGER) AS mortality,
    (CAST(floor(o_totalprice) AS BIGINT) % 1000) / CAST(2000 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS expected,
    (o_orderkey % 7) / CAST(20 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS expected_readmission, (o_orderkey % 5) + CAST(4 AS DOUBLE) AS expected_los,
    CAST(o_orderkey % 9 = 0 AS INTEGER) AS complication, c_mktsegment AS segment, n_name AS nation, r_name AS region
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def labs(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Events as a long lab series: patient, time, variable, value; with ``gaps``, every seventh value is missing."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value")) if gaps else F.col("value")
    return e.select("event_id", F.col("user_id").alias("patient_id"), "ts", F.col("event_type").alias("variable"), value.alias("value"))


LABS_SQL = "labs AS (SELECT event_id, user_id AS patient_id, ts, event_type AS variable, value FROM events)"
GAPS_SQL = "labs AS (SELECT event_id, user_id AS patient_id, ts, event_type AS variable, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as coded diagnoses: a letter and two digits of the part, a decimal on some, some malformed."""
    code = F.concat(F.chr(65 + F.col("l_partkey") % 26), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"))
    code = F.when(F.col("l_linenumber") % 3 == 0, F.concat(code, F.lit("."), (F.col("l_suppkey") % 10).cast("string"))).otherwise(code)
    code = F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit(" "), F.lower(code))).when(F.col("l_partkey") % 97 == 0, F.concat(code, F.lit("A"))).otherwise(code)
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("patient_id"), F.col("l_orderkey").alias("encounter_id"), F.col("l_linenumber").alias("line"), code.alias("code"))


DIAGNOSES_SQL = """raw AS (SELECT o_custkey AS patient_id, l_orderkey AS encounter_id, l_linenumber AS line, l_partkey,
    chr(CAST(65 + l_partkey % 26 AS INTEGER)) || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') || CASE WHEN l_linenumber % 3 = 0 THEN '.' || CAST(l_suppkey % 10 AS VARCHAR) ELSE '' END AS c
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    dx AS (SELECT patient_id, encounter_id, line, CASE WHEN l_partkey % 11 = 0 THEN ' ' || lower(c) WHEN l_partkey % 97 = 0 THEN c || 'A' ELSE c END AS code FROM raw)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as predictions: score, outcome and two groups."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", ((F.col("n_chars") % 997) / 997.0).alias("p"), F.col("quality").alias("y"), F.col("lang").alias("g"), "source")


PREDICTIONS_SQL = "pred AS (SELECT doc_id, (n_chars % 997) / CAST(997 AS DOUBLE) AS p, quality AS y, lang AS g, source FROM documents JOIN labels USING (doc_id))"
