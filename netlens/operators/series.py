"""Per-second series of a feed, and the operators that re-bin them.

A series is a DataFrame (timestamp, value) or (timestamp, column...), dense over the query's range: seconds without facts
are 0.  Facts are aggregated before the calendar is joined, so the shuffle carries one row a second and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens import model
from netlens.functions import net
from netlens.plans.conditions import Conditions, Network, facts, accepted, member
from netlens.sources.tables import TIME, Tables

CASTS = ("unknown", "broadcast", "multicast", "unicast")


def dense(sparse: DataFrame, where: Conditions) -> DataFrame:
    """Every second of the range, with 0 where ``sparse`` has no row."""
    calendar = sparse.sparkSession.range(where.second_from, where.second_to + 1).withColumnRenamed("id", "timestamp")
    names = [c for c in sparse.columns if c != "timestamp"]
    return calendar.join(sparse, "timestamp", "left").select("timestamp", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def _per_second(rows: DataFrame, value: Column, time: str = "second") -> DataFrame:
    return rows.groupBy(F.col(time).alias("timestamp")).agg(value.cast("long").alias("value"))


def bps(tables: Tables, where: Conditions) -> DataFrame:
    """Bits per second, both directions."""
    return dense(_per_second(facts(tables, "bps", where), F.sum(F.col("small_to_big") + F.col("big_to_small")) * 8), where)


#: Series that count markers: table, and the anomaly code if one is meant.
COUNTS = {
    "timeoutcounts": ("timeouts", None),
    "tcprsts": ("tcp_rsts", None),
    "tcpzerowindows": ("tcp_misc", model.ZERO_WINDOW),
    "tcpdupacks": ("tcp_dupacks", None),
    "tcpretransmissions": ("tcp_retransmissions", None),
    "tcpportsreused": ("tcp_misc", model.PORTS_REUSED),
    "tcpoutoforders": ("tcp_misc", model.OUT_OF_ORDER),
}


def marker_rows(tables: Tables, kind: str, where: Conditions, columns: list[str] | None = None) -> DataFrame:
    table, code = COUNTS[kind]
    rows = facts(tables, table, where, columns)
    if table == "timeouts":
        return rows.where("marker_second <> 0").withColumn("second", F.col("marker_second"))
    return rows if code is None else rows.where(F.col("tail").bitwiseAND(0xFFFFFFFF) == code)


def markers(tables: Tables, kinds: tuple[str, ...], where: Conditions) -> DataFrame:
    """(session_id, second, kind) of the markers of several kinds in time, whatever their session: each table is read once."""
    rows = None
    for table in dict.fromkeys(COUNTS[k][0] for k in kinds):
        time = F.col(TIME[table])
        found = tables[table].where(where.within(time))
        codes = {COUNTS[k][1]: k for k in kinds if COUNTS[k][0] == table}
        if None in codes:
            kind = F.lit(codes[None])
            found = found.where(time != 0) if table == "timeouts" else found
        else:
            kind = net.label(F.col("tail").bitwiseAND(0xFFFFFFFF), codes)
        part = found.select("session_id", time.alias("second"), kind.alias("kind")).where("kind <> ''")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def counts(tables: Tables, kind: str, where: Conditions) -> DataFrame:
    """Markers per second of one of :data:`COUNTS`."""
    return dense(_per_second(marker_rows(tables, kind, where), F.count(F.lit(1))), where)


def pps(tables: Tables, where: Conditions, ignore_macs: tuple[str, ...] = ()) -> DataFrame:
    """Packets per second by cast type; packets from or to ``ignore_macs`` are taken off."""
    keys = ["source_is_small", "src_ip", "dst_ip"]
    cast = F.lower(net.cast_type(*[F.col(k) for k in keys]))
    rows = facts(tables, "pps", where, keys).select(F.col("second").alias("timestamp"), cast.alias("cast"), (F.col("small_to_big") + F.col("big_to_small")).alias("n"))
    if ignore_macs:
        own = facts(tables, "packets", where, keys).where(F.col("src_mac").isin(*ignore_macs) | F.col("dst_mac").isin(*ignore_macs))
        rows = rows.unionByName(own.select(F.col("second").alias("timestamp"), cast.alias("cast"), F.lit(-1).cast("long").alias("n")))
    return dense(rows.groupBy("timestamp").agg(*[F.sum(F.when(F.col("cast") == c, F.col("n")).otherwise(0)).alias(c) for c in CASTS]), where)


def good_rtt() -> Column:
    return (F.col("tail") >= 0) & (F.col("tail") < model.RTT_LIMIT)


def rtt_sums() -> list[Column]:
    """Sums and counts of round trips by side; side 0 is the session's source."""
    side0 = F.col("small_to_big") == F.col("source_is_small")
    out = []
    for k, side in enumerate((side0, ~side0)):
        out += [F.sum(F.when(side, F.col("tail")).otherwise(0)).cast("long").alias(f"n{k}"), F.sum(F.when(side, 1).otherwise(0)).cast("long").alias(f"d{k}")]
    return out


def represent() -> Column:
    """Sum of the truncated means of both sides; a side without samples counts 0."""
    return sum((F.when(F.col(f"d{k}") > 0, net.div(F.col(f"n{k}"), F.col(f"d{k}"))).otherwise(0) for k in (0, 1)), F.lit(0)).cast("long")


def average_latency(tables: Tables, where: Conditions) -> DataFrame:
    rows = facts(tables, "rtts", where, ["source_is_small"]).where(good_rtt())
    return dense(rows.groupBy(F.col("second").alias("timestamp")).agg(*rtt_sums()).select("timestamp", represent().alias("value")), where)


def flow_counts(tables: Tables, where: Conditions) -> DataFrame:
    """Sessions alive in each second: +1 where one begins and -1 after it ends, summed over time.

    The running sum is built from sums of blocks of seconds, so no task holds the whole range: within a block by a window
    over that block, and across blocks by a window over one row a block."""
    alive = accepted(tables, where)
    first, last = F.greatest("first_second", F.lit(where.second_from)), F.least("last_second", F.lit(where.second_to))
    steps = alive.select(F.explode(F.array(F.struct(first.alias("t"), F.lit(1).alias("n")), F.struct((last + 1).alias("t"), F.lit(-1).alias("n")))).alias("x"))
    change = steps.groupBy(F.col("x.t").alias("timestamp")).agg(F.sum("x.n").alias("value"))
    series = dense(change, where).withColumn("block", net.div(F.col("timestamp"), 3600))
    blocks = series.groupBy("block").agg(F.sum("value").alias("n"))
    before = blocks.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("before"))  # a row for each hour
    inner = F.sum("value").over(W.partitionBy("block").orderBy("timestamp"))
    return series.withColumn("value", inner).join(before, "block").select("timestamp", (F.col("value") + F.col("before")).cast("long").alias("value"))


def bps2(tables: Tables, where: Conditions, internal: tuple[Network, ...]) -> DataFrame:
    """Bits per second that enter, leave, stay inside or pass outside the ``internal`` networks."""
    rows = facts(tables, "bps", where, ["src_ip", "dst_ip", "source_is_small"])
    rows = rows.withColumn("s", member(F.col("src_ip"), internal)).withColumn("d", member(F.col("dst_ip"), internal))
    to_dst = F.when(F.col("source_is_small") == 1, F.col("small_to_big")).otherwise(F.col("big_to_small")) * 8
    to_src = F.when(F.col("source_is_small") == 1, F.col("big_to_small")).otherwise(F.col("small_to_big")) * 8
    s, d = F.col("s"), F.col("d")
    parts = {
        "ingress": F.when(~s & d, to_dst).when(s & ~d, to_src).otherwise(0),
        "egress": F.when(s & ~d, to_dst).when(~s & d, to_src).otherwise(0),
        "local": F.when(s & d, to_dst + to_src).otherwise(0),
        "other": F.when(~s & ~d, to_dst + to_src).otherwise(0),
    }
    return dense(rows.groupBy(F.col("second").alias("timestamp")).agg(*[F.sum(v).alias(k) for k, v in parts.items()]), where)


def bpms(tables: Tables, where: Conditions, second: int) -> DataFrame:
    """Bits in each of the 1000 milliseconds of a second, from packets."""
    rows = facts(tables, "packets", where).where(F.col("second") == second)
    found = rows.groupBy(net.div(F.col("ns"), 1_000_000).alias("ms")).agg((F.sum("saved_length") * 8).alias("value"))
    return tables.spark.range(1000).withColumnRenamed("id", "ms").join(found, "ms", "left").select("ms", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


# ---------------------------------------------------------------- binding


def bins(series: DataFrame, where: Conditions, width: int, column: str = "value", zeros: bool = False) -> DataFrame:
    """Tumbling bins of ``width`` seconds from the start: containers, total, top and bottom with their first second.

    top starts at 0 with the bin's first second; bottom is the least non-zero value (0 at the bin's start if there is
    none), or the least of all with ``zeros``.
    """
    v, t = F.col(column), F.col("timestamp")
    start = (net.div(t - where.second_from, width) * width + where.second_from).alias("start")
    counted = v if zeros else F.when(v != 0, v)
    out = series.groupBy(start).agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum(v).cast("long").alias("total"),
        F.max(F.struct(v.alias("v"), (-t).alias("t"))).alias("hi"),
        F.min(F.when(counted.isNotNull(), F.struct(v.alias("v"), t.alias("t")))).alias("lo"),
    )
    return out.select(
        F.col("start").alias("timestamp"),
        "containers",
        "total",
        F.col("hi.v").cast("long").alias("top"),
        F.when(F.col("hi.v") > 0, -F.col("hi.t")).otherwise(F.col("start")).cast("long").alias("topat"),
        F.coalesce("lo.v", F.lit(0)).cast("long").alias("bottom"),
        F.coalesce("lo.t", "start").cast("long").alias("bottomat"),
    )


def min_max(series: DataFrame, column: str = "value") -> DataFrame:
    """The least positive and the greatest value with their first seconds, in one row."""
    v, t = F.col(column), F.col("timestamp")
    out = series.agg(F.min(F.when(v > 0, F.struct(v.alias("v"), t.alias("t")))).alias("lo"), F.max(F.when(v > 0, F.struct(v.alias("v"), (-t).alias("t")))).alias("hi"))
    zero = F.lit(0).cast("long")
    return out.select(
        F.coalesce("lo.t", zero).alias("minimum_timestamp"), F.coalesce("lo.v", zero).alias("minimum_value"), F.coalesce(-F.col("hi.t"), zero).alias("maximum_timestamp"), F.coalesce("hi.v", zero).alias("maximum_value")
    )


def top(series: DataFrame, n: int, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """The n seconds of greatest (summed) value; the earlier one of equals first."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return series.orderBy(total.desc(), "timestamp").limit(n)


def page(series: DataFrame, start: int, stop: int, offset_from: int) -> DataFrame:
    """The seconds from ``start`` to ``stop``, counted from the series' first second."""
    return series.where(F.col("timestamp").between(offset_from + start, offset_from + stop)).orderBy("timestamp")
