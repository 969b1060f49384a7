"""Files in and out: tables by extension, patient batches, results, reports, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.frames import require


def load(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A table by its path's extension: csv, parquet, json (one document or, with ``lines``, one a line), jsonl, xls and xlsx
    (by pandas on the driver, if it has a reader for them)."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if end == "parquet":
        return spark.read.parquet(path)
    if end in ("json", "jsonl", "ndjson"):
        return spark.read.json(path, multiLine=end == "json" and not lines)
    if end in ("xls", "xlsx"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"unknown format {end!r}")


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    """A batch of patients to score: csv, parquet or JSON lines, with patient_id."""
    return require(load(spark, path, lines=True), ["patient_id"])


def find(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Paths and sizes of the files below a folder whose names match."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")


def save(df: DataFrame, path: str, form: str | None = None, mode: str = "error") -> None:
    """csv, parquet or json (one object a line); no other format is tried if one fails."""
    form = form or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if form not in ("csv", "parquet", "json"):
        raise ValueError(f"unknown format {form!r}")
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if form == "csv" else getattr(writer, form)(path)


def export(resources: DataFrame, folder: str, kinds: list[str]) -> list[str]:
    """Resources of each kind as JSON lines under ``folder``; kinds without any are left out. Returns the kinds written."""
    have = {r[0] for r in resources.where(F.col("resource_type").isin(kinds)).select("resource_type").distinct().collect()}
    for kind in (k for k in kinds if k in have):
        resources.where(F.col("resource_type") == kind).select("resource").write.mode("overwrite").text(f"{folder}/{kind}")
    return [k for k in kinds if k in have]


def as_report(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, NaN and infinities as null."""
    kinds = dict(df.dtypes)
    clean = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c, k in kinds.items() if k in ("double", "float")})
    return clean.select(F.to_json(F.struct(*clean.columns)).alias("json"))


def nested_as_json(df: DataFrame) -> DataFrame:
    """Struct, map and array columns as JSON text, so that any format can hold them."""
    return df.withColumns({c: F.to_json(c) for c, k in df.dtypes if k.startswith(("struct", "map", "array"))})


def as_patient_records(df: DataFrame, key: str = "patient_id") -> DataFrame:
    """The key, and all other values that aren't missing as a map of texts."""
    require(df, [key])
    names = [c for c in df.columns if c != key]
    text = {c: F.when(~F.isnan(c), F.col(c)).cast("string") if k in ("double", "float") else F.col(c).cast("string") for c, k in df.dtypes}
    pairs = F.create_map(*(x for c in names for x in (F.lit(c), text[c])))
    return df.select(key, F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("demographics"))
