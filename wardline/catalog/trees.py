"""Queries of tree explanations (a tree of two yes-or-no features, whose splits and values SQL can follow) and of fits under a bound on disparity."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from wardline.catalog.clinical import rounded
from wardline.frames import Catalog
from wardline.operators import trees
from wardline.operators.constrained import fit_constrained
from wardline.plans.cohort import ENCOUNTERS_SQL, encounters

CATALOG = Catalog()
add = CATALOG.add
FEATURES = ["complication", "likely"]
# The root is the feature whose split leaves less variance. v_: the mean with no feature known, the root, the other one (averaged over the root's
# branches by their rows), both.
_SQL = f"""WITH {ENCOUNTERS_SQL},
    x AS (SELECT encounter_id, complication AS a, CAST(expected > 0.3 AS INTEGER) AS b, CAST(mortality AS DOUBLE) AS y FROM enc),
    g AS (SELECT coalesce((SELECT sum(n * m * m) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS m FROM x GROUP BY a)) >= (SELECT sum(n * m * m) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS m FROM x GROUP BY b)), true) AS first),
    o AS (SELECT encounter_id, y, CASE WHEN first THEN a ELSE b END AS r, CASE WHEN first THEN b ELSE a END AS o, CASE WHEN first THEN 'complication' ELSE 'likely' END AS root, CASE WHEN first THEN 'likely' ELSE 'complication' END AS other FROM x, g),
    ro AS (SELECT r, o, avg(y) AS v_ro FROM o GROUP BY ALL), r AS (SELECT r, avg(y) AS v_r, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM o) AS share FROM o GROUP BY r),
    oo AS (SELECT o, sum(share * v_ro) AS v_o FROM ro JOIN r USING (r) GROUP BY o),
    v AS (SELECT encounter_id, root, other, v_r, v_o, v_ro, (SELECT avg(y) FROM o) AS v_0 FROM o JOIN ro USING (r, o) JOIN r USING (r) JOIN oo USING (o))"""


def _fitted(spark, sf):
    rows = encounters(spark, sf).withColumns({"likely": (F.col("expected") > 0.3).cast("int"), "mortality": F.col("mortality").cast("double")})
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return rows, DecisionTreeRegressor(labelCol="mortality", maxDepth=2).fit(vectors)


@add(f"""{_SQL} SELECT encounter_id, root AS feature, round(((v_r - v_0) + (v_ro - v_o)) / 2, 8) AS value FROM v
    UNION ALL SELECT encounter_id, other, round(((v_o - v_0) + (v_ro - v_r)) / 2, 8) FROM v""")
def explain_tree_values(spark, sf):
    rows, model = _fitted(spark, sf)
    return rounded(trees.tree_values(rows, model, FEATURES, "encounter_id"), "value", at=8)


@add(f"""{_SQL}, i AS (SELECT *, (v_ro - v_r - v_o + v_0) / 2 AS pair FROM v)
    SELECT encounter_id, root AS a, other AS b, round(pair, 8) AS value FROM i UNION ALL SELECT encounter_id, other, root, round(pair, 8) FROM i
    UNION ALL SELECT encounter_id, root, root, round(((v_r - v_0) + (v_ro - v_o)) / 2 - pair, 8) FROM i
    UNION ALL SELECT encounter_id, other, other, round(((v_o - v_0) + (v_ro - v_r)) / 2 - pair, 8) FROM i""")
def explain_tree_interactions(spark, sf):
    rows, model = _fitted(spark, sf)
    return rounded(trees.tree_interactions(rows, model, FEATURES, "encounter_id"), "value", at=8)


@add()
def fairness_constrained_decisions(spark, sf):
    """Decisions about all encounters by a fit whose rates differ by at most 0.1 between regions."""
    rows = encounters(spark, sf).select("encounter_id", "region", "expected", "expected_los", "mortality")
    fitted = fit_constrained(rows, ["expected", "expected_los"], "mortality", "region", 0.1, rounds=4)
    return fitted.decided(rows, "encounter_id").select("encounter_id", "region", "share", "decision")
