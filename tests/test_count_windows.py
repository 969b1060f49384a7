"""Streams of count windows against row numbers over all rows: out of order, late and repeated rows, restarts, recalibration."""

import random
import uuid
from datetime import datetime, timedelta

import pytest

from wardline.streaming import streams

SCHEMA = "k string, id long, ts timestamp, value double, window long"
FIRST = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    spark.conf.set(*streams.STATE_STORE)
    yield
    spark.conf.unset(streams.STATE_STORE[0])


def expected(rows, size, every, baseline, days, passed):
    out = []
    for k in sorted({r[0] for r in rows if r[0]}):
        mine = sorted({(r[2], r[1], r[3]) for r in rows if r[0] == k and r[3] is not None and r[2] <= passed})
        base, last, due, number = baseline, None, mine[0][0] + timedelta(days=days), 0
        for i, (ts, _, _) in enumerate(mine):
            while ts >= due:
                base, due = (base if last is None else last), due + timedelta(days=days)
            if i + 1 >= size and (i + 1 - size) % every == 0:
                window = mine[i + 1 - size : i + 1]
                last = sum(v for _, _, v in window) / size
                out.append((k, number, window[0][0], ts, last, base))
                number, base = number + 1, last if base is None else base
    return out


def run(spark, folder, checkpoint, name, **options):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    windows = streams.count_windows(rows, "k", "id", **options)
    windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(name).awaitTermination()


@pytest.mark.parametrize("baseline, every", [(None, 10), (5.0, 5)])
def test_equals_row_numbers(spark, store, tmp_path, baseline, every):
    r = random.Random(3)
    rows = [(r.choice("ab"), i, FIRST + timedelta(hours=i // 3), r.uniform(0, 10) + i / 40, 9) for i in range(240)]
    rows += [(None, 1, FIRST, 1.0, 9), ("a", 2, FIRST, None, 9)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    # Batches by time, the rows of each in any order; a tenth comes a batch later, within the delay, and some rows come twice.
    batches = [[] for _ in range(5)]
    for row in rows:
        at = min(3, (row[2] - FIRST) // timedelta(hours=20))
        batches[at + (r.random() < 0.1)].append(row)
        if r.random() < 0.1:
            batches[at].append(row)
    options = dict(size=10, every=every, baseline=baseline, days=1.0, delay="48 hours")
    for i, batch in enumerate(batches):
        r.shuffle(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if i in (1, 4):
            # The second run goes on from the first one's checkpoint.
            run(spark, folder, str(tmp_path / "c"), out, **options)
    # The last batch carries the watermark beyond all rows; what is older than that is late.
    end = FIRST + timedelta(days=30)
    spark.createDataFrame([("z", 1, end, 1.0, 9)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, str(tmp_path / "c"), out, **options)
    spark.createDataFrame([("a", 9999, FIRST, 1e9, 9)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, str(tmp_path / "c"), out, **options)
    got = sorted(spark.read.parquet(out).collect(), key=lambda w: (w.k, w.window))
    want = expected(rows, 10, every, baseline, 1.0, end - timedelta(hours=48))
    assert [(w.k, w.window, w.start, w.end) for w in got] == [x[:4] for x in want] and len(want) > 15
    for w, x in zip(got, want):
        assert w.mean == pytest.approx(x[4]) and w.baseline == (x[5] if x[5] is None else pytest.approx(x[5]))
        assert w.shift == (None if x[5] is None else pytest.approx(abs(x[4] - x[5]) / x[5]))
        assert w.drifted is (None if x[5] is None else w.shift > 0.05)


def test_bad_sizes(spark, tmp_path):
    empty = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    rows = spark.readStream.schema(SCHEMA).parquet(empty)
    with pytest.raises(ValueError, match="divide"):
        streams.count_windows(rows, "k", "id", size=10, every=3)
