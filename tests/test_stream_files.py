"""Results of streamed aggregations are files of the executors, not rows of the driver."""

import pytest

from wardline import catalog
from wardline.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_daily_means", "stream_sliding_weeks", "stream_sessions"])
def test_result_is_files(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    assert len(rows.inputFiles()) > 0 and "LocalTableScan" not in rows._jdf.queryExecution().toString()


def test_restart_holds_the_whole_result(spark, tmp_path):
    """A later batch's result replaces the earlier one's, and holds all rows."""
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    schema = "ts timestamp, user_id long, value double"
    for value in (1.0, 3.0):
        spark.sql(f"SELECT timestamp'2024-01-09 10:00:00' AS ts, 7L AS user_id, {value}D AS value").coalesce(1).write.mode("append").parquet(folder)
        streams.completed(streams.sliding_weeks(streams.read(spark, folder, schema)), out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 7 and {(r.user_id, r["mean"], r.n) for r in rows} == {(7, 2.0, 2)}
