"""Small shared helpers: column checks, missing values, registering a catalogue's queries."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, or a ValueError that names the columns it lacks; no job runs."""
    lacking = [c for c in columns if c and c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def known(x: Column) -> Column:
    """Not null and not NaN, for numbers."""
    return x.isNotNull() & ~F.isnan(x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes null, so that aggregates skip it."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in kinds.items() if k in ("double", "float")})


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start) if isinstance(start, str) else start, F.col(end) if isinstance(end, str) else end) / 8.64e10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in at least four parts of equal size for each core, for rows that are small but take long: a file of some
    MB would be one task, however many rows it has."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def running_totals(rows: DataFrame, order: str, columns: list[str], by: list[str] = (), bins: int = 256) -> DataFrame:
    """Adds to each row, for each column, ``{c}_upto``: its sum over the rows of the group from the largest ``order`` down to this
    one, and ``{c}_total``, over all of the group.

    No task sees a whole group: rows are cut into bins by quantiles of ``order``, run within their bin, and get the totals of
    the bins above, of which there are ``bins`` for each group at most. ``order`` tells a group's rows apart.
    """
    cuts = rows.select(F.percentile_approx(order, [i / bins for i in range(1, bins)], 10_000).alias("c")).first().c or []
    bin_ = F.coalesce(F.array_size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(order))), F.lit(0)) if cuts else F.lit(0)
    binned = rows.withColumn("_bin", bin_)
    sums = binned.groupBy(*by, "_bin").agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    above = Window.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = sums.select(*(F.col(k).alias(f"_k_{k}") for k in [*by, "_bin"]), *(F.coalesce(F.sum(f"_s_{c}").over(above), F.lit(0)).alias(f"_a_{c}") for c in columns), *(F.sum(f"_s_{c}").over(whole).alias(f"{c}_total") for c in columns))
    on = F.lit(True)
    for k in [*by, "_bin"]:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = Window.partitionBy(*by, "_bin").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    run = binned.join(totals, on)
    return run.select(*rows.columns, *((F.sum(c).over(own) + F.col(f"_a_{c}")).alias(f"{c}_upto") for c in columns), *(f"{c}_total" for c in columns))


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder that spark.checkpoint.dir names. Where it is unset, a temporary folder of this machine,
    but only if all tasks run on it; on a cluster they couldn't read it, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp()
    return folder


def null_safe(keys: Iterable[str], other: str = "_k_") -> Column:
    """That all ``keys`` equal those of the same name after ``other``, null being equal to null."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return on


def exact_quantiles(rows: DataFrame, value: str, probabilities: list[float], by: list[str] = (), whole: int = 10_000) -> DataFrame:
    """The columns ``by`` and ``q``, the quantiles of ``value`` (linear between neighbours), nulls left out.

    No task holds a group's values: approximate quantiles bracket each wanted place by a thousandth of the rows on either side,
    values below a bracket are counted, and only the values within one are put in order, equal ones as one with its count. In groups
    of up to ``whole`` rows a bracket is the whole group.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    wide = [x for p in probabilities for x in (max(0.0, p - 0.001), min(1.0, p + 0.001))]
    known = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", wide, 10_000).alias("_b")).withColumnsRenamed({k: f"_k_{k}" for k in by})
    small = F.col("_n") <= whole
    low = [F.when(small, float("-inf")).otherwise(F.col("_b")[2 * i]) for i in range(len(probabilities))]
    high = [F.when(small, float("inf")).otherwise(F.col("_b")[2 * i + 1]) for i in range(len(probabilities))]
    joined = rows.join(known, null_safe(by))
    under = F.array(*(F.count_if(F.col("_v") < x) for x in low))
    below = joined.groupBy(*by).agg(F.first("_n").alias("_n"), under.alias("_u")).withColumnsRenamed({k: f"_k_{k}" for k in by})
    within = F.array_compact(F.array(*(F.when((F.col("_v") >= a) & (F.col("_v") <= b), F.lit(i)) for i, (a, b) in enumerate(zip(low, high)))))
    cells = joined.select(*by, "_v", F.explode(within).alias("_i")).groupBy(*by, "_i", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.withColumn("_s", upto).join(below, null_safe(by)).withColumn("_s", F.col("_s") + F.get("_u", "_i"))
    place = F.element_at(F.array(*(F.lit(float(p)) for p in probabilities)), F.col("_i") + 1) * (F.col("_n") - 1)
    at = lambda rank: F.max(F.when((F.col("_s") - F.col("_c") <= rank) & (rank < F.col("_s")), F.col("_v")))
    ends = placed.withColumn("_p", place).groupBy(*by, "_i").agg(F.first("_p").alias("_p"), at(F.floor("_p")).alias("_x"), at(F.ceil("_p")).alias("_y"))
    between = F.when(F.floor("_p") == F.ceil("_p"), F.col("_x")).otherwise((F.ceil("_p") - F.col("_p")) * F.col("_x") + (F.col("_p") - F.floor("_p")) * F.col("_y"))
    return ends.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", between.alias("q")))), lambda s: s.q).alias("q"))


class Catalog:
    """Queries by name, each with its DuckDB equivalent where there is one."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def put(f):
            self.queries[name or f.__name__] = f
            if sql:
                self.oracles[name or f.__name__] = sql
            return f

        return put
