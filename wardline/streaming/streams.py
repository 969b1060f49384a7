"""Structured Streaming: de-identification, feature upserts, drift state, and windows over event time.

The windows (daily means, sliding weeks, sessions) are additions of this library; they agree with their batch forms on
complete input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.frames import known, require
from wardline.operators.privacy import Deidentification, deidentify_bundles
from wardline.sources.stores import FeatureStore


def read(spark: SparkSession, folder: str, schema: str, pattern: str | None = None, form: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def deidentified(bundles: DataFrame, config: Deidentification, path: str, quarantine: str, checkpoint: str):
    """Starts the stream of bundles (bundle_id, bundle): masked resources to ``path``, bundles that can't be masked to
    ``quarantine`` by their id, never raw. Each micro-batch has a folder of its own (batch=number), which a retry replaces, so that
    a failure between the two writes repeats nothing."""

    def write(batch: DataFrame, number: int) -> None:
        rows = deidentify_bundles(batch, config).persist()
        rows.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.where("error IS NOT NULL").select("bundle_id", "error").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        rows.unpersist()

    return bundles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(rows: DataFrame, store: FeatureStore, checkpoint: str):
    """Starts the stream of features into a store, upserted by micro-batch."""
    return rows.writeStream.foreachBatch(lambda batch, number: store.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(rows: DataFrame, path: str, checkpoint: str):
    """Starts the stream of log entries into files, each once."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def completed(rows: DataFrame, path: str, checkpoint: str):
    """Starts the stream of an aggregation into files: after each micro-batch ``path`` holds its whole result, written by the
    executors. A retry replaces it."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(path)
    return rows.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def daily_means(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Mean and count by user and day; events later than ``delay`` are dropped."""
    day = _late(events, delay).groupBy(F.window("ts", "1 day"), "user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return day.select(F.col("window.start").alias("day"), "user_id", "mean", "n")


def sliding_weeks(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Mean and count by user of the seven days from each day on; events later than ``delay`` are dropped.

    An event is in seven windows: a user's events are brought together first, so that many tasks, not one for a large file, make
    them, and a window's sum goes to the state once."""
    near = _late(events, delay).repartition("user_id")
    week = near.groupBy(F.window("ts", "7 days", "1 day"), "user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return week.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "user_id", "mean", "n")


def sessions(events: DataFrame, gap: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Bursts of a user's events with less than ``gap`` between them."""
    s = _late(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def drift_states(scores: DataFrame, key: str, baseline: float, sensitivity: float) -> DataFrame:
    """Running mean and sticky status by key: once drifted, always drifted."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, drifted = state.get if state.exists else (0, 0.0, False)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].fillna(0).sum())
        drifted = bool(drifted or (n and abs(total / n - baseline) / baseline > sensitivity))
        state.update((n, total, drifted))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [total / n if n else None], "status": ["Drift" if drifted else "Stable"]})

    kind = dict(scores.dtypes)[key]
    return scores.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, mean double, status string", "n long, total double, drifted boolean", "update", GroupStateTimeout.NoTimeout)


#: What a session must be set to before it starts a stream with ``count_windows``: their state is in several columns.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows of a key that tasks collect before they write them to the state, and that they put in order at once.
_HELD = 1 << 17
#: The rows that wait are kept by the hour.
_SLOT = 3_600_000_000


class _CountWindows(StatefulProcessor):
    """Rows wait in ``pending``, blocks of columns by hour, until the watermark passes them, then enter panes of ``every`` rows in order of
    time and id; the ring of the last ``size / every`` panes is a window. Hours are taken one after the other, those of many rows in parts."""

    def __init__(self, key: str, kind: str, size: int, every: int, baseline: float | None, days: float):
        self.key, self.kind, self.size, self.every = key, kind, size, every
        self.baseline, self.step = baseline, int(days * 86_400_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slot long, block long", f"us array<long>, id array<{self.kind}>, value array<double>")
        self.slots = handle.getMapState("slots", "slot long", "first long, next long, n long")
        self.panes = handle.getListState("panes", "start long, total double")
        self.at = handle.getValueState("at", "n long, total double, start long, window long, baseline double, last double, due long")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def _wait(self, rows: pd.DataFrame) -> None:
        for slot, some in rows.groupby(rows["us"] // _SLOT):
            first, next_, n = self.slots.getValue((int(slot),)) or (0, 0, 0)
            self.pending.updateValue((int(slot), next_), tuple(some[c].tolist() for c in ("us", "id", "value")))
            self.slots.updateValue((int(slot),), (first, next_ + 1, n + len(some)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in rows:
            if len(b):
                self._wake(int(b["us"].min()))
                held, n = [*held, b[["us", "id", "value"]]], n + len(b)
            if n >= _HELD:
                self._wait(pd.concat(held))
                held, n = [], 0
        if held:
            self._wait(pd.concat(held))
        return iter(())

    def _parts(self, slot: int, begin: int, end: int) -> Iterator[list[tuple]]:
        """The rows of a slot from ``begin`` to before ``end``, each once, in parts in order of time."""
        first, next_, n = self.slots.getValue((slot,))
        step = -(-_SLOT // (n // _HELD + 1))
        for low in range(begin, end, step):
            high, rows = min(low + step, end), []
            for block in range(first, next_):
                rows += [r for r in zip(*self.pending.getValue((slot, block))) if low <= r[0] < high]
            rows.sort()
            rows = [r for i, r in enumerate(rows) if not i or r[:2] != rows[i - 1][:2]]
            if rows:
                yield rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for slot in sorted(k[0] for k in self.slots.keys()):
            begin, end = slot * _SLOT, (slot + 1) * _SLOT
            if begin > passed:
                self._wake(begin)
                return
            for ready in self._parts(slot, begin, min(end, passed + 1)):
                out = self._windows(ready)
                if out:
                    columns = ["window", "start", "end", "mean", "baseline"]
                    yield pd.DataFrame(out, columns=columns).assign(**{self.key: key[0]})[[self.key, *columns]].astype({"baseline": float})
            # Rows beyond the watermark stay, in blocks after the old ones.
            first, next_, _ = self.slots.getValue((slot,))
            stay = 0
            for rest in self._parts(slot, passed + 1, end):
                if not stay:
                    self._wake(rest[0][0])
                self._wait(pd.DataFrame(rest, columns=["us", "id", "value"]))
                stay += len(rest)
            for block in range(first, next_):
                self.pending.removeKey((slot, block))
            if stay:
                self.slots.updateValue((slot,), (next_, self.slots.getValue((slot,))[1], stay))
            else:
                self.slots.removeKey((slot,))

    def _windows(self, ready: list[tuple]) -> list[tuple]:
        n, total, start, window, baseline, last, due = self.at.get() if self.at.exists() else (0, 0.0, 0, 0, self.baseline, None, ready[0][0] + self.step)
        panes, out = [tuple(p) for p in self.panes.get()], []
        for us, _, value in ready:
            if us >= due:
                due += ((us - due) // self.step + 1) * self.step
                baseline = baseline if last is None else last
            start = start if n else us
            n, total = n + 1, total + value
            if n == self.every:
                panes = [*panes, (start, total)][-(self.size // self.every) :]
                n, total = 0, 0.0
                if len(panes) == self.size // self.every:
                    last = sum(t for _, t in panes) / self.size
                    out.append((window, panes[0][0], us, last, baseline))
                    window, baseline = window + 1, last if baseline is None else baseline
        self.at.update((n, total, start, window, baseline, last, due))
        if panes:
            self.panes.put(panes)
        return out

    def close(self) -> None:
        pass


def count_windows(rows: DataFrame, key: str, order: str, size: int = 1000, every: int | None = None, baseline: float | None = None, threshold: float = 0.05, days: float = 30.0, delay: str = "1 hour") -> DataFrame:
    """A stream of windows of ``size`` rows (ts, value) of a key, one for each ``every`` rows (by default ``size``, of which it is a divisor):
    key, window (from 0), start, end, mean, the ``baseline`` it is compared with, their relative ``shift`` and whether it is ``drifted``.

    Rows are taken in order of ts and ``order``, whatever their batches, once the watermark (the latest ts less ``delay``) has passed them;
    rows that come after that are dropped, as are those lacking a key, ts, ``order`` or value (null or NaN). Rows that repeat ts and
    ``order`` count once, of different values the least. Each ``days`` after a key's first row the mean of its latest
    window becomes its baseline, from the next row on. Without a given baseline the first window is, and its own shift is null, as
    is any from a baseline of 0. An unfinished window gives nothing. The result is that of row numbers over the whole table.

    Rows of a key are handled one after the other; a task holds those of an hour, or a part of one that has many. State: its rows within ``delay`` and ``size / every`` panes. The session needs ``STATE_STORE``.
    """
    require(rows, [key, order, "ts", "value"])
    every = every or size
    if size < 1 or every < 1 or size % every:
        raise ValueError("every must divide size")
    kind, id_kind = dict(rows.dtypes)[key], dict(rows.dtypes)[order]
    value = F.col("value").cast("double")
    some = _late(rows.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col(order).isNotNull() & known(value)), delay)
    # The column with the watermark stays, so that Spark drops late rows; the microseconds don't depend on a time zone.
    some = some.select(F.col(key), "ts", F.unix_micros("ts").alias("us"), F.col(order).alias("id"), value.alias("value"))
    processor = _CountWindows(key, id_kind, size, every, baseline, days)
    schema = f"`{key}` {kind}, window long, start long, end long, mean double, baseline double"
    windows = some.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")
    shift = F.abs(F.col("mean") - F.col("baseline")) / F.nullif(F.abs("baseline"), F.lit(0.0))
    at = {c: F.timestamp_micros(c) for c in ("start", "end")}
    return windows.withColumns(at).withColumn("baseline", F.nanvl("baseline", F.lit(None))).withColumn("shift", shift).withColumn("drifted", F.col("shift") > threshold)
