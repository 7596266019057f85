"""Requests and what answers them, on streams: HTTP pairs with event-time timers, DNS questions against timeouts, and names
that are kept once with a bounded state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netlens import model
from netlens.functions import net
from netlens.operators import trackers

#: How much later a row may come than rows that are further on in time.
LATE = "60 seconds"
#: The state store that timers and list state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_TEXTS = ("method", "path", "host", "referer", "browser", "os")
_BLOCK = "file_seq long, place long, at long, request boolean, status int, " + ", ".join(f"{c} string" for c in _TEXTS)
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
PAIR_SCHEMA = "session_id long, requestat long, responseat long, status int, " + ", ".join(f"{c} string" for c in _TEXTS)
_PAIR = [c.split()[0] for c in PAIR_SCHEMA.split(", ")]


def use_timers(spark: SparkSession) -> None:
    """Choose the state store for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def http_events(remarks: DataFrame) -> DataFrame:
    """HTTP remarks (session_id, file_seq, content), streamed or not, as one row for each request or response, with its time."""
    rows = remarks.select("session_id", "file_seq", F.posexplode(F.split("content", r"HttpEnd=[A-Za-z]+\n")).alias("place", "block")).where("block <> ''")
    block, agent = F.col("block"), net.header(F.col("block"), "User-Agent")
    rows = rows.withColumn("asked", net.remark(block, "HttpRequest")).withColumn("answer", net.remark(block, "HttpResponse")).where("asked <> '' OR answer <> ''")
    asked = F.col("asked") != ""
    at = F.substring(F.when(asked, F.col("asked")).otherwise(F.col("answer")), 1, 19).cast("long")
    return rows.select(
        "session_id", "file_seq", F.col("place").cast("long").alias("place"), at.alias("at"), F.timestamp_micros(net.div(at, 1000)).alias("ts"), asked.alias("request"),
        F.when(asked, 0).otherwise(F.substring("answer", 21, 3).cast("int")).alias("status"), F.regexp_extract("asked", r"^\d+ (\S+) ", 1).alias("method"), F.regexp_extract("asked", r"^\d+ \S+ (.*)$", 1).alias("path"),
        net.header(block, "Host").alias("host"), net.header(block, "Referer").alias("referer"), net.browser(agent).alias("browser"), net.operating_system(agent).alias("os"),
    )


class _Pairs(StatefulProcessor):
    """Blocks of one session that can't be settled yet.

    The first block in order of file and place is settled once it is sure which block follows it: the next place of the
    same remark, or a block whose time the watermark has passed, since no block between them can still come.  A request
    that nothing follows waits for 72 seconds of event time.  So the state holds what came in the last minutes only."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", _BLOCK)

    def _settle(self, session_id: int, blocks: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        blocks.sort()
        out, k = [], 0
        wake = None
        while k < len(blocks):
            own = dict(zip(_NAMES, blocks[k], strict=True))
            after = dict(zip(_NAMES, blocks[k + 1], strict=True)) if k + 1 < len(blocks) else None
            ms = own["at"] // 1_000_000
            if not own["request"]:
                if ms > watermark:
                    wake = ms  # its request may still come
                    break
                k += 1
                continue
            if after is not None:
                adjacent = after["file_seq"] == own["file_seq"] and after["place"] == own["place"] + 1
                if not adjacent and after["at"] // 1_000_000 > watermark:
                    wake = after["at"] // 1_000_000
                    break
                answered = not after["request"]
                out.append((session_id, own["at"], after["at"] if answered else -1, after["status"] if answered else 0, *[own[c] for c in _TEXTS]))
                k += 2 if answered else 1
            elif ms + self.wait_ms <= watermark:
                out.append((session_id, own["at"], -1, 0, *[own[c] for c in _TEXTS]))
                k += 1
            else:
                wake = ms + self.wait_ms
                break
        left = blocks[k:]
        if left:
            self.blocks.put(left)
            self.handle.registerTimer(max(wake, watermark) + 1)
        else:
            self.blocks.clear()
        if out:
            yield pd.DataFrame(out, columns=_PAIR).astype({"requestat": "int64", "responseat": "int64", "status": "int32"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        blocks = [tuple(r) for r in self.blocks.get()] if self.blocks.exists() else []
        for batch in rows:
            blocks += [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in batch[_NAMES].itertuples(index=False)]
        yield from self._settle(int(key[0]), blocks, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.blocks.exists():
            yield from self._settle(int(key[0]), [tuple(r) for r in self.blocks.get()], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def http_pairs(remarks: DataFrame, late: str = LATE) -> DataFrame:
    """Requests with their responses from a stream of HTTP remarks, as :func:`trackers.http_records` pairs them; a request
    without one comes out with status 0 and responseat -1 once 72 seconds have passed without a block of its session.

    Blocks of a session may come in any order within ``late``."""
    timed = http_events(remarks).withWatermark("ts", late)
    return timed.groupBy("session_id").transformWithStateInPandas(_Pairs(model.TIMEOUT_SECONDS * 1000), PAIR_SCHEMA, outputMode="append", timeMode="EventTime")


def with_ends(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Pairs as :func:`trackers.http_records` shows them: with the addresses of their sessions of HTTP."""
    own = sessions.where(F.col("l7") == 2).select("session_id", F.col("src_ip").alias("client_ip"), F.col("dst_ip").alias("server_ip"), F.col("dst_port").alias("server_port"))
    return pairs.join(own, "session_id").select(F.col("session_id").alias("sessionid"), "client_ip", "server_ip", "server_port", "host", "method", "path", "referer", "browser", "os", "requestat", "responseat", "status")


def dns_questions(remarks: DataFrame, timeouts: DataFrame, late: str = LATE, wait: int = 2 * model.TIMEOUT_SECONDS) -> DataFrame:
    """DNS questions of a stream, each once and with its final status.

    ``remarks``: session_id, second, client, server, content; ``timeouts``: session_id, marker_second.  A question that has
    no answer meets the first timeout of its session up to ``wait`` seconds later in an outer join of the two streams, and
    comes out as TIMEOUT, or as REQUESTONLY once the watermark shows that no timeout can come."""
    content = F.col("content")
    status = trackers.dns_status(content)
    asked = remarks.select("session_id", F.timestamp_seconds("second").alias("ts"), "client", "server", status.alias("status"), F.substring_index(net.remark(content, "DnsQuestion"), ",", 1).alias("query")).withWatermark("ts", late)
    gone = timeouts.select(F.col("session_id").alias("of"), F.timestamp_seconds("marker_second").alias("gone_at")).withWatermark("gone_at", late).dropDuplicatesWithinWatermark(["of"])
    limit = F.expr(f"INTERVAL {wait} SECONDS")
    meet = (F.col("session_id") == F.col("of")) & (F.col("gone_at") >= F.col("ts")) & (F.col("gone_at") <= F.col("ts") + limit) & (F.col("status") == "REQUESTONLY")
    joined = asked.join(gone, meet, "leftOuter")
    final = F.when(F.col("of").isNotNull(), "TIMEOUT").otherwise(F.col("status"))
    return joined.select("session_id", "ts", "client", "server", final.alias("status"), "query")


def dns_minutes(questions: DataFrame) -> DataFrame:
    """Hits by minute, status, question and client; each minute once and when it is complete."""
    out = questions.groupBy(F.window("ts", "1 minute"), "status", "query", "client").agg(F.count(F.lit(1)).alias("hits"))
    return out.select(F.col("window.start").cast("long").alias("minute"), "status", "query", "client", "hits")


def names_once(remarks: DataFrame, known: DataFrame, late: str = "1 hour") -> DataFrame:
    """Names and addresses of DNS answers (``remarks``: second, content) that are not ``known`` (name, ip_hex) yet.

    Within ``late`` the state tells repetitions; older pairs are in the stored table that an anti-join reads, so the state
    holds the pairs of about an hour and not those of the stream's life."""
    rows = trackers.dns_answers(remarks.withColumn("ts", F.timestamp_seconds("second")), "ts")
    fresh = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["name", "ip_hex"])
    return fresh.join(known.select("name", "ip_hex"), ["name", "ip_hex"], "left_anti").select("name", "ip_hex")


def learn_names(remarks: DataFrame, path: str, checkpoint: str, late: str = "1 hour"):
    """Append names to the table at ``path``, each pair once; every micro-batch is compared with what the table has then.

    A micro-batch that is repeated after a failure finds its own rows stored, so it adds none twice."""
    rows = trackers.dns_answers(remarks.withColumn("ts", F.timestamp_seconds("second")), "ts")
    fresh = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["name", "ip_hex"]).select("name", "ip_hex")

    def add(batch: DataFrame, _: int) -> None:
        known = batch.sparkSession.read.schema("name string, ip_hex string").option("ignoreMissingFiles", True)
        try:
            old = known.parquet(path)
            batch = batch.join(old, ["name", "ip_hex"], "left_anti")
        except Exception as error:  # the first batch: there is no table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        batch.dropDuplicates(["name", "ip_hex"]).write.mode("append").parquet(path)

    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["PAIR_SCHEMA", "dns_minutes", "dns_questions", "http_events", "http_pairs", "learn_names", "names_once", "use_timers", "with_ends"]
