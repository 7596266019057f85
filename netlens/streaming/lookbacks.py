"""Look-backs that move on with every minute, and results that can be read while a scan is still running."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from netlens.operators.dashboard import LOOKBACKS

_MINUTE = 60


class _Panes(StatefulProcessor):
    """Counts of one key by minute, for as many minutes as the longest look-back has.

    A timer fires at the end of every minute from the first count on and gives the sums of all look-backs that end there.
    When the longest look-back is empty, the key's state is gone."""

    def __init__(self, lookbacks: tuple[int, ...]):
        self.lookbacks = lookbacks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getListState("panes", "minute long, n long")
        self.due = handle.getValueState("due", "end long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        panes = dict(tuple(r) for r in self.panes.get()) if self.panes.exists() else {}
        for batch in rows:
            for minute, n in batch.groupby("minute")["n"].sum().items():
                panes[int(minute)] = panes.get(int(minute), 0) + int(n)
        self.panes.put(sorted(panes.items()))
        first = min(panes) + _MINUTE
        if not self.due.exists() or self.due.get()[0] > first > timerValues.getCurrentWatermarkInMs() // 1000:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0] * 1000)
            self.due.update((first,))
            self.handle.registerTimer(first * 1000)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        panes = dict(tuple(r) for r in self.panes.get()) if self.panes.exists() else {}
        end, passed = self.due.get()[0], timerValues.getCurrentWatermarkInMs() // 1000
        out = []
        # a watermark that jumps on passes several minutes at once
        while panes and end <= passed:
            out.append((*key, end, *[sum(n for m, n in panes.items() if end - k <= m < end) for k in self.lookbacks]))
            end += _MINUTE
            panes = {m: n for m, n in panes.items() if m >= end - max(self.lookbacks)}
        if panes:
            self.panes.put(sorted(panes.items()))
            self.due.update((end,))
            self.handle.registerTimer(end * 1000)
        else:
            self.panes.clear()
            self.due.clear()
        if out:
            yield pd.DataFrame(out, columns=["service", "kind", "end", *[f"last{k}" for k in self.lookbacks]])

    def close(self) -> None:
        pass


def service_counters(markers: DataFrame, late: str = "60 seconds", lookbacks: tuple[int, ...] = LOOKBACKS) -> DataFrame:
    """Anomalies of every service over the look-backs, at the end of every minute, from a stream of (service, kind, second).

    A row for ``end`` has what :func:`dashboard.service_counters` finds at the second before it.  Markers are first added up
    by minute, so a key's state has one number for each minute of the longest look-back, however many markers there are."""
    if any(k % _MINUTE for k in lookbacks):
        raise ValueError("look-backs are whole minutes")
    minute = F.expr(f"second div {_MINUTE} * {_MINUTE}")
    timed = markers.select("service", "kind", minute.alias("minute"), F.timestamp_seconds("second").alias("ts"), F.lit(1).cast("long").alias("n")).withWatermark("ts", late)
    schema = "service string, kind string, end long, " + ", ".join(f"last{k} long" for k in lookbacks)
    return timed.groupBy("service", "kind").transformWithStateInPandas(_Panes(lookbacks), schema, outputMode="append", timeMode="EventTime")


def as_it_comes(stream: DataFrame, rows_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, seen: Callable[[int], None] | None = None) -> StreamingQuery:
    """Run a scan as a stream of file batches whose results can be read from ``path`` as they come (:func:`so_far`).

    Every batch has a folder of its own, which a repetition after a failure replaces, so no row is there twice.  ``seen``
    is called with a batch's number once its rows can be read."""

    def add(batch: DataFrame, number: int) -> None:
        rows_of(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if seen is not None:
            seen(number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def so_far(spark: SparkSession, path: str) -> DataFrame:
    """What a running or finished :func:`as_it_comes` has found."""
    return spark.read.parquet(path).drop("batch")


def tls_rows(sessions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Rows of the TLS dump of a batch of TLS remarks; :func:`first_of_session` leaves one for each session."""
    from netlens.functions import net

    own = sessions.where(F.col("l7") == 7).select("session_id", F.col("first_second").alias("timestamp"), F.col("src_ip").alias("client_ip"), F.col("dst_ip").alias("server_ip"), F.col("dst_port").alias("server_port"))

    def rows(batch: DataFrame) -> DataFrame:
        named = batch.withColumn("sni", net.remark(F.col("content"), "TLSSNI")).where(F.col("sni").rlike("^[A-Za-z0-9.-]+$"))
        return named.join(own, "session_id").select("session_id", "timestamp", "client_ip", "server_ip", "server_port", "sni", "file_seq")

    return rows


def first_of_session(rows: DataFrame) -> DataFrame:
    """The row of the earliest file of each session, as :func:`trackers.tls_rows` has it."""
    return rows.groupBy("session_id", "timestamp").agg(F.min_by(F.struct("client_ip", "server_ip", "server_port", "sni"), "file_seq").alias("x")).select("session_id", "timestamp", "x.*")


__all__ = ["as_it_comes", "first_of_session", "service_counters", "so_far", "tls_rows"]
