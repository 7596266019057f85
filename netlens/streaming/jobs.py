"""Continuous versions of the rollup, of the name learner and of threshold events, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netlens import model
from netlens.operators import trackers
from netlens.operators.events import Trigger

#: A minute is complete once so much later data has come; what comes later still is dropped.
COMPLETE = "60 seconds"


def traffic_stream(spark: SparkSession, path: str, schema: str = model.TRAFFIC_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """Per-session traffic facts as they are written below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def minute_bits(stream: DataFrame) -> DataFrame:
    """Bits per minute, each minute once and when it is complete."""
    timed = stream.withColumn("ts", F.timestamp_seconds("second")).withWatermark("ts", COMPLETE)
    out = timed.groupBy(F.window("ts", "1 minute")).agg(((F.sum(F.col("small_to_big") + F.col("big_to_small"))) * 8).cast("long").alias("value"))
    return out.select(F.col("window.start").cast("long").alias("minute"), "value")


def learned_names(remarks: DataFrame) -> DataFrame:
    """Names and addresses of DNS answers, each pair once over the life of the stream."""
    return trackers.fqdn_from_dns(remarks)


def window_sums(stream: DataFrame, seconds: int) -> DataFrame:
    """Sums of bits over consecutive windows, for triggers."""
    timed = stream.withColumn("ts", F.timestamp_seconds("second")).withWatermark("ts", COMPLETE)
    out = timed.groupBy(F.window("ts", f"{seconds} seconds")).agg(((F.sum(F.col("small_to_big") + F.col("big_to_small"))) * 8).cast("long").alias("sum"))
    return out.select(F.col("window.end").cast("long").alias("end"), "sum")


EVENT_SCHEMA = "occurredat long, severity int, datasource string, lookbackwindow long, type string, value long, threshold long, tag string, description string"


def watch(sums: DataFrame, trigger: Trigger) -> DataFrame:
    """Events of a trigger over window sums.  The state is the last window's end and sum; a window without traffic between
    two others counts as 0.  The mean truncates, as in the batch operator."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, before = state.get if state.exists else (None, None)
        rows = sorted((int(at), int(total)) for b in batches for at, total in zip(b["end"], b["sum"], strict=True))
        found = []
        for at, total in rows:
            gaps = [] if end is None else [(x, 0) for x in range(end + trigger.lookback, at, trigger.lookback)]
            for moment, own in [*gaps, (at, total)]:
                mean = own // trigger.lookback
                fires = {
                    "over": mean > trigger.threshold,
                    "under": mean < trigger.threshold,
                    "delta": before is not None and before // trigger.lookback > trigger.threshold and own * (100 + trigger.delta) // 100 > before,
                }[trigger.type]
                if fires:
                    found.append((moment - 1, trigger.severity, trigger.datasource, trigger.lookback, trigger.type, mean, trigger.threshold, trigger.tag, trigger.message))
                end, before = moment, own
        if end is not None:
            state.update((end, before))
        if found:
            yield pd.DataFrame(found, columns=[x.split()[0] for x in EVENT_SCHEMA.split(", ")])

    state = T.StructType([T.StructField("end", T.LongType()), T.StructField("before", T.LongType())])
    return sums.withColumn("watched", F.lit(trigger.tag)).groupBy("watched").applyInPandasWithState(step, EVENT_SCHEMA, state, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, continuous: bool = False, every: str = "60 seconds") -> StreamingQuery:
    """Append a stream to Parquet: all that is there now, or for good every ``every``."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if continuous else writer.trigger(availableNow=True)).start()


__all__ = ["EVENT_SCHEMA", "learned_names", "minute_bits", "run_to_table", "traffic_stream", "watch", "window_sums"]
