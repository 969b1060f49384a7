"""Lineage events of a job and its datasets' metrics, observed while the job runs."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wardline.operators.quality import is_missing


class Run:
    """Events START and COMPLETE (or FAIL) of a job, appended as JSON lines to ``path`` by Spark."""

    def __init__(self, spark, job: str, path: str, now=lambda: datetime.now(UTC).isoformat()):
        self.spark, self.job, self.path, self.now, self.id = spark, job, path, now, str(uuid.uuid4())
        self.watched: dict[str, tuple[Observation, DataFrame]] = {}

    def watch(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, with its rows and missing values counted by the job that reads it, without another pass."""
        missing = F.lit(0)
        for c in df.columns:
            missing = missing + F.count_if(is_missing(df, c))
        seen = Observation(f"{name}-{self.id}")
        self.watched[name] = (seen, df)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), missing.alias("missing"))

    def _write(self, kind: str, datasets: list[dict], error: str | None = None) -> None:
        event = {"eventType": kind, "eventTime": self.now(), "run": self.id, "job": self.job, "datasets": datasets} | ({"error": error} if error else {})
        self.spark.createDataFrame([(json.dumps(event),)], "value string").write.mode("append").text(self.path)

    def __enter__(self) -> Run:
        self._write("START", [])
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self._write("FAIL", [], str(error))
            return
        self._write("COMPLETE", [{"name": n, "columns": len(df.columns), "schema": df.schema.simpleString()} | seen.get for n, (seen, df) in self.watched.items()])
