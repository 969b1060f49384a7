"""Classifiers under a bound on disparity: weighted fits of Spark ML, whose weights follow multipliers of the groups' constraints."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.frames import known, require

#: Groups at most: a round brings one row for each to the driver.
GROUPS = 1000


@dataclass
class Constrained:
    """Models that decide by lot, each for an equal share of rows; ``rounds``: round, error, disparity and whether it is in the mix;
    ``disparity`` and ``error`` of the mix on the rows of the fit; ``met``: whether the bound holds there."""

    models: list
    features: list[str]
    rounds: list[dict]
    disparity: float
    error: float
    met: bool

    def decided(self, df: DataFrame, key: str, seed: int = 0) -> DataFrame:
        """``df`` with ``share``, the part of the models that say 1, and ``decision``, that of the model drawn by a hash of the key, so that
        reruns agree. Both are null for rows that lack a feature."""
        require(df, [key, *self.features])
        whole = F.lit(True)
        for f in self.features:
            whole = whole & known(F.col(f).cast("double"))
        draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(self.models))).cast("int")
        out = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(df)
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumnRenamed("_said", f"_m{i}")
        votes = F.array(*(F.col(f"_m{i}") for i in range(len(self.models))))
        share = F.aggregate(votes, F.lit(0.0), lambda s, v: s + v) / len(self.models)
        return out.withColumns({"share": F.when(whole, share), "decision": F.when(whole, F.get(votes, draw).cast("int"))}).select(*df.columns, "share", "decision")


def fit_constrained(df: DataFrame, features: list[str], label: str, group: str, max_disparity: float, rounds: int = 12, rate: float = 2.0, most: float = 1.0, margin: float = 0.8, **options) -> Constrained:
    """A logistic classifier (``options`` are its parameters) whose rates of 1 differ by at most ``max_disparity`` between groups.

    Exponentiated gradient: a round fits rows whose cost of saying 1 is that of the error plus their group's multiplier, then multipliers (in sum at
    most ``most``; with 1 any group's rows can all be turned) grow by the excess of a group's rate over, or under, the overall one times ``rate`` by
    the root of the round. The mix is the run of rounds that meets the bound times ``margin`` (room for rows not seen) with the least
    error; if none does, that of the least disparity, and ``met`` is whether the bound itself holds. Rows lacking a feature or the label (0 or 1) are left out; null is a group.

    A round is a fit of Spark ML and one aggregate by group; of either only coefficients and a row for each group reach the driver.
    """
    require(df, [*features, label, group])
    rows = df.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_y"), F.coalesce(F.col(group).cast("string"), F.lit("\0null")).alias("_g"))
    for f in [*features, "_y"]:
        rows = rows.where(known(F.col(f)))
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(rows).select("_x", "_y", "_g").persist()
    try:
        sizes = {r["_g"]: r["n"] for r in rows.groupBy("_g").agg(F.count("*").alias("n")).limit(GROUPS + 1).collect()}
        if not sizes or len(sizes) > GROUPS:
            raise ValueError("there must be rows, of at most 1,000 groups")
        n, theta, fits, log = sum(sizes.values()), {(g, s): 0.0 for g in sizes for s in (1, -1)}, [], []
        for k in range(rounds):
            top = max(0.0, *theta.values())
            scale = math.exp(-top) + sum(math.exp(t - top) for t in theta.values())
            push = {g: most * (math.exp(theta[g, 1] - top) - math.exp(theta[g, -1] - top)) / scale if k else 0.0 for g in sizes}
            extra = F.create_map(*(x for g in sizes for x in (F.lit(g), F.lit(push[g] * n / sizes[g] - sum(push.values())))))
            cost = 1 - 2 * F.col("_y") + extra[F.col("_g")]
            weighted = rows.withColumns({"_label": (cost < 0).cast("double"), "_weight": F.abs(cost)}).where("_weight > 0")
            model = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_weight", predictionCol="_said", rawPredictionCol="", probabilityCol="", **options).fit(weighted)
            told = model.transform(rows).groupBy("_g").agg(F.sum("_said").alias("ones"), F.sum(F.abs(F.col("_said") - F.col("_y"))).alias("wrong")).collect()
            rates, overall = {r["_g"]: r["ones"] / sizes[r["_g"]] for r in told}, sum(r["ones"] for r in told) / n
            fits.append((model, rates, sum(r["wrong"] for r in told) / n))
            log.append({"round": k, "error": fits[-1][2], "disparity": max(rates.values()) - min(rates.values())})
            for (g, s), t in theta.items():
                theta[g, s] = t + rate / math.sqrt(k + 1) * (s * (rates[g] - overall) - margin * max_disparity / 2)
    finally:
        rows.unpersist()
    mixes = []
    for start, end in combinations(range(rounds + 1), 2):
        mix = fits[start:end]
        means = [sum(r[g] for _, r, _ in mix) / len(mix) for g in sizes]
        mixes.append((max(means) - min(means), sum(e for _, _, e in mix) / len(mix), start, end))
    within = [m for m in mixes if m[0] <= margin * max_disparity]
    disparity, error, start, end = min(within, key=lambda m: m[1]) if within else min(mixes)
    for entry in log:
        entry["mixed"] = start <= entry["round"] < end
    return Constrained([m for m, _, _ in fits[start:end]], features, log, disparity, error, disparity <= max_disparity)
