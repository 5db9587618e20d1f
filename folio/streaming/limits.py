"""Stateful request limiting and incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WINDOW_S = 60.0


def admit(log: list[float], now: float, limit: int, window: float = WINDOW_S) -> tuple[list[float], float | None]:
    """(admitted times still in the window, seconds to wait or None if admitted). Rejected hits are not logged."""
    if limit <= 0:
        return log, None
    log = [t for t in log if t > now - window]
    if len(log) >= limit:
        return log, log[0] + window - now
    return [*log, now], None


def rate_limited(hits: DataFrame, limit: int, key: str = "key", at: str = "ts") -> DataFrame:
    """(key, hit, ts, admitted, retry_after) of a batch of hits; each key's log holds at most ``limit`` times.

    Rows come sorted by key and time, so a hot key streams through its task without being collected.
    """
    ordered = hits.select(F.col(key).cast("string").alias("key"), F.col("hit"), F.col(at).cast("double").alias("ts")).repartition("key").sortWithinPartitions("key", "ts", "hit")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, []
        for part in parts:
            waits = []
            for k, now in zip(part["key"], part["ts"], strict=True):
                if k != current:
                    current, log = k, []
                log, wait = admit(log, now, limit)
                waits.append(wait)
            part["admitted"] = [w is None for w in waits]
            part["retry_after"] = pd.Series(waits, index=part.index, dtype="float64").round(6)
            yield part

    return ordered.mapInPandas(run, "key string, hit long, ts double, admitted boolean, retry_after double")


class _Ordered(StatefulProcessor):
    """Rows (ts, row) of a key, held until the watermark has passed them, so that they are taken in order of
    time however they arrive. A timer takes what is due; what is done leaves the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ts double, row long")
        self.log = handle.getListState("log", "ts double")

    #: Seconds after a row's time at which it may be taken.
    wait = 0.0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:  # a batch of a hot key comes in parts
            own = list(zip(part["ts"].astype(float).tolist(), part["row"].astype(int).tolist(), strict=True))
            self.pending.appendList(own)
            latest = max([x for x, _ in own] + ([] if latest is None else [latest]))
        self._wake(latest + self.wait)
        return iter(())

    def _wake(self, ts: float) -> None:
        self.handle.registerTimer(int(ts * 1000) + 1)

    def _hold(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


class RateLimiter(_Ordered):
    """Admits at most ``limit`` hits of a key in any ``window`` seconds."""

    def __init__(self, limit: int, window: float = WINDOW_S):
        self.limit, self.window = limit, window

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted((r[0], r[1]) for r in self.pending.get()) if self.pending.exists() else []
        log = [r[0] for r in self.log.get()] if self.log.exists() else []
        due, waits = [r for r in rows if r[0] <= now], []
        for ts, _ in due:
            log, wait = admit(log, ts, self.limit, self.window)
            waits.append(wait)
        log = [t for t in log if t > now - self.window]
        self._hold(self.pending, rows[len(due) :])
        self._hold(self.log, [(t,) for t in log])
        if log:  # the key's last admitted hit leaves the window then, and with it the key's state goes
            self._wake(log[-1] + self.window)
        if due:
            yield pd.DataFrame({"key": key[0], "hit": [r for _, r in due], "ts": [t for t, _ in due], "admitted": [w is None for w in waits], "retry_after": pd.Series(waits, dtype="float64").round(6)})


class Debouncer(_Ordered):
    """Passes an event once its key has been quiet for ``wait`` seconds after it."""

    def __init__(self, wait: float):
        self.wait = wait

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted((r[0], r[1]) for r in self.pending.get()) if self.pending.exists() else []
        due = sum(ts + self.wait <= now for ts, _ in rows)
        # compared in whole microseconds, as the batch form does
        quiet = [r for r, other in zip(rows[:due], [*rows[1:], None][:due], strict=True) if other is None or round(other[0] * 1e6) - round(r[0] * 1e6) >= round(self.wait * 1e6)]
        self._hold(self.pending, rows[due:])
        if quiet:
            yield pd.DataFrame({"key": key[0], "row": [r for _, r in quiet]})


def _timed(rows: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    """``processor`` over (key, row, at: timestamp), which arrive at most ``delay`` late."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = rows.withWatermark("at", delay).withColumn("ts", F.unix_micros("at") / 1e6)
    return own.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def rate_limited_stream(hits: DataFrame, limit: int, delay: str = "10 seconds", window: float = WINDOW_S) -> DataFrame:
    """``rate_limited`` over a stream of (key, hit, at: timestamp) that arrives in any order, at most ``delay`` late.

    A hit is judged when the watermark has passed it. A key's state is the hits that wait and at most ``limit``
    admitted times; a timer deletes it when the last of them leaves the window.
    """
    return _timed(hits.withColumnRenamed("hit", "row"), RateLimiter(limit, window), "key string, hit long, ts double, admitted boolean, retry_after double", delay)


def debounced_stream(events: DataFrame, quiet_ms: int, delay: str = "10 seconds") -> DataFrame:
    """(key, row) of the events of a stream (key, row, at: timestamp) after which their key is quiet for ``quiet_ms``,
    as ``debounced`` finds them, once the watermark is past that time."""
    return _timed(events, Debouncer(quiet_ms / 1000), "key string, row long", delay)


def ingest_stream(works: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Apply each arriving batch once per batch id until the source is drained; ``apply`` is an idempotent upsert."""
    return works.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(store, works: DataFrame, topics: list[tuple[str, str, str]], checkpoint: str, **options: object):
    """Ingest a stream of works into a store: each batch is one version, whose facts name the batch.

    A batch that is delivered again after a restart finds itself published and is left out, so a stream that was
    killed and restarted gives the store of one that was not. Works that can't be kept are the version's dead
    letters. ``options`` are those of ``runs.run_batch``.
    """
    from folio.operators.runs import run_batch

    return ingest_stream(works, lambda batch, number: run_batch(store, batch, topics, number, **options), checkpoint)


def debounced(events: DataFrame, key: str, at: str, quiet_ms: int) -> DataFrame:
    """Events after which their key is quiet for ``quiet_ms``, or that are its last."""
    from pyspark.sql import Window

    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, "event_id"))
    gap = (F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1000
    return events.where(F.lit(True)).withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") >= quiet_ms)).drop("__gap")
