"""Triggers, threshold events and their store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens import model
from netlens.functions import net
from netlens.plans.conditions import Conditions


@dataclass(frozen=True)
class Trigger:
    """What to watch: ``over`` and ``under`` compare a window's mean with the threshold; ``delta`` fires where the window
    before had a mean above it and this window's sum, raised by ``delta`` percent, exceeds that window's sum."""

    message: str
    severity: int
    datasource: str
    type: str
    lookback: int
    threshold: int
    delta: int = 0
    tag: str = "all"

    def __post_init__(self) -> None:
        problems = []
        if self.datasource not in model.DATASOURCES:
            problems.append(f"datasource {self.datasource!r}")
        if self.type not in model.TRIGGER_TYPES:
            problems.append(f"type {self.type!r}")
        if self.severity not in model.SEVERITIES:
            problems.append(f"severity {self.severity!r}")
        if self.lookback <= 0 or self.lookback % 60:
            problems.append(f"lookback {self.lookback!r} (whole minutes)")
        if problems:
            raise ValueError("invalid trigger: " + ", ".join(problems))


def events(series: DataFrame, trigger: Trigger, where: Conditions) -> DataFrame:
    """Events of one trigger over consecutive whole windows of a dense series."""
    w = trigger.lookback
    windows = (
        series.groupBy(net.div(F.col("timestamp") - where.second_from, w).alias("k"))
        .agg(F.sum("value").cast("long").alias("sum"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == w)
        .withColumn("mean", net.div(F.col("sum"), w))
    )
    # windows, not seconds, are in order here: one row for each lookback
    before = W.orderBy("k")
    windows = windows.withColumn("before", F.lag("sum").over(before))
    threshold = trigger.threshold
    if trigger.type == "over":
        fires = F.col("mean") > threshold
    elif trigger.type == "under":
        fires = F.col("mean") < threshold
    else:
        fires = (net.div(F.col("before"), w) > threshold) & (net.div(F.col("sum") * (100 + trigger.delta), 100) > F.col("before"))
    return windows.where(fires).select(
        ((F.col("k") + 1) * w + where.second_from - 1).alias("occurredat"),
        F.lit(trigger.severity).alias("severity"),
        F.lit(trigger.datasource).alias("datasource"),
        F.lit(w).cast("long").alias("lookbackwindow"),
        F.lit(trigger.type).alias("type"),
        F.col("mean").alias("value"),
        F.lit(threshold).cast("long").alias("threshold"),
        F.lit(trigger.tag).alias("tag"),
        F.lit(trigger.message).alias("description"),
    )


def query(store: DataFrame, where: Conditions, tags: tuple[str, ...] = (), severity: int | None = None, datasource: str | None = None, text: str | None = None, limit: int = 100) -> DataFrame:
    rows = store.where(F.col("occurredat").between(where.second_from, where.second_to))
    if tags:
        rows = rows.where(F.col("tag").isin(*tags))
    if severity is not None:
        rows = rows.where(F.col("severity") >= severity)
    if datasource:
        rows = rows.where(F.col("datasource") == datasource)
    if text:
        rows = rows.where(F.col("description").contains(text))
    return rows.orderBy("occurredat", "description").limit(limit)
