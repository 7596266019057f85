"""Rankings by source, by destination and by client-to-service pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens import model
from netlens.functions import net
from netlens.operators import series
from netlens.plans.conditions import Conditions, accepted, facts
from netlens.sources.tables import Tables

#: (tables, base, grain, conditions) -> keys of the grain with value and l7; and (tables, grain, conditions) -> n0, d0, n1, d1
Totals = Callable[[Tables, str, str, Conditions], DataFrame]
Trips = Callable[[Tables, str, Conditions], DataFrame]
BASES = ("bytes", "packets", "timeouts", "tcprsts", "tcpdupacks", "tcpzerowindows", "tcpretransmissions", "tcpoutoforders", "tcpportsreused")
GRAINS = ("source", "destination", "service")
_MARKERS = {"timeouts": "timeoutcounts"} | {b: b for b in BASES[3:]}
SESSION = ["src_ip", "dst_ip", "dst_port", "source_is_small", "payload_protocol", "l7"]


def keys(grain: str) -> list[Column]:
    """Key columns of a grain.  Direction 1 is from the client (the session's source) to the service."""
    if grain == "source":
        return [F.col("src_ip").alias("ip")]
    if grain == "destination":
        return [F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")]
    return [F.col("src_ip").alias("ip"), F.col("dst_ip").alias("ip2"), F.col("dst_port").alias("port"), F.col("direction"), F.col("payload_protocol").alias("payloadprotocol")]


def names(grain: str) -> list[str]:
    return {"source": ["ip"], "destination": ["ip", "port"], "service": ["ip", "ip2", "port", "direction", "payloadprotocol"]}[grain]


def _traffic(tables: Tables, table: str, where: Conditions) -> DataFrame:
    """Two rows for each fact, one for each direction."""
    rows = facts(tables, table, where, SESSION)
    forward = F.when(F.col("source_is_small") == 1, F.col("small_to_big")).otherwise(F.col("big_to_small"))
    backward = F.when(F.col("source_is_small") == 1, F.col("big_to_small")).otherwise(F.col("small_to_big"))
    both = F.array(F.struct(F.lit(1).alias("direction"), forward.alias("n")), F.struct(F.lit(0).alias("direction"), backward.alias("n")))
    return rows.select("session_id", "second", *SESSION, F.explode(both).alias("x")).select("session_id", "second", *SESSION, "x.direction", "x.n")


def measured(tables: Tables, base: str, where: Conditions) -> DataFrame:
    """Rows of a base with their session's id and columns, second, direction and n."""
    if base in ("bytes", "packets"):
        return _traffic(tables, "bps" if base == "bytes" else "pps", where).where("n > 0")
    if base == "timeouts":
        rows = series.marker_rows(tables, "timeoutcounts", where)
        return rows.select("session_id", "second", *SESSION, F.lit(1).alias("direction"), F.lit(1).cast("long").alias("n"))
    rows = series.marker_rows(tables, _MARKERS[base], where, SESSION)
    direction = F.when(F.col("small_to_big") == F.col("source_is_small"), 1).otherwise(0)
    return rows.select("session_id", "second", *SESSION, direction.alias("direction"), F.lit(1).cast("long").alias("n"))


def totals(tables: Tables, base: str, grain: str, where: Conditions) -> DataFrame:
    """Every key of a grain with its value, and the l7 that its sessions show."""
    return measured(tables, base, where).groupBy(*keys(grain)).agg(F.sum("n").cast("long").alias("value"), F.max("l7").alias("l7"))


def ranking(tables: Tables, base: str, grain: str, where: Conditions, n: int | None = 100, totals: Totals = totals) -> DataFrame:
    """The n keys of greatest value, from the ``totals`` of facts or of another source.  value2 puts it in proportion: the grain's total for bytes and packets, packets of
    the key for anomalies, sessions of the key for timeouts (plus the value) and reused ports.  Where value exceeds
    value2, it is added to it.  Keys are exact, not cut to a bounded table on the way."""
    own = names(grain)
    found = totals(tables, base, grain, where)
    if base in ("bytes", "packets"):
        whole = found.agg(F.sum("value").cast("long").alias("value2"))
        out = found.join(F.broadcast(whole))  # one row
    else:
        if base in ("timeouts", "tcpportsreused"):
            other = accepted(tables, where).withColumn("direction", F.lit(1))
            if grain == "service":
                other = other.withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1))))
            other = other.groupBy(*keys(grain)).agg(F.count(F.lit(1)).alias("other"))
        else:
            other = totals(tables, "packets", grain, where).select(*own, F.col("value").alias("other"))
        out = found.join(other, own, "left")
        value2 = F.coalesce("other", F.lit(0)) + (F.col("value") if base == "timeouts" else F.lit(0))
        out = out.withColumn("value2", F.when(F.col("value") > value2, value2 + F.col("value")).otherwise(value2).cast("long"))
    out = out.select(*own, "l7", "value", "value2")
    return out if n is None else out.orderBy(F.desc("value"), *own).limit(n)


def ranking6(tables: Tables, base: str, end: str, where: Conditions, n: int = 100) -> DataFrame:
    """IPv6 addresses (32 hex digits) of one ``end`` (src or dst) by their value."""
    six = tables["session_ip6"].select("session_id", F.col(f"{end}_ip6").alias("ip6"))
    rows = facts(tables, "bps" if base == "bytes" else "pps", where).groupBy("session_id").agg(F.sum(F.col("small_to_big") + F.col("big_to_small")).alias("n"))
    return rows.join(six, "session_id").groupBy("ip6").agg(F.sum("n").cast("long").alias("value")).where("value > 0").orderBy(F.desc("value"), "ip6").limit(n)


def protocol_split(tables: Tables, base: str, where: Conditions) -> DataFrame:
    """Value by application protocol, or by transport where none was detected."""
    label = net.protocol_label(F.col("l7"), F.col("payload_protocol"))
    return measured(tables, base, where).groupBy(label.alias("protocol")).agg(F.sum("n").cast("long").alias("value"))


def round_trips(tables: Tables, grain: str, where: Conditions) -> DataFrame:
    """Sums and counts of the round trips of every key by side, which can be added."""
    rows = facts(tables, "rtts", where, SESSION).where(series.good_rtt())
    rows = rows.withColumn("direction", F.when(F.col("small_to_big") == F.col("source_is_small"), 1).otherwise(0))
    return rows.groupBy(*keys(grain)).agg(*series.rtt_sums())


def latencies(tables: Tables, grain: str, where: Conditions, n: int = 100, totals: Totals = totals, trips: Trips = round_trips) -> DataFrame:
    """Keys by mean round trip; for services one row a direction.  value2 is the bytes of the key."""
    own = names(grain)
    found = trips(tables, grain, where)
    if grain == "service":
        found = found.withColumn("total", F.col("n0") + F.col("n1")).where("total > 0").select(*own, net.div(F.col("total"), F.col("d0") + F.col("d1")).alias("value"))
    else:
        found = found.select(*own, series.represent().alias("value"))
    bytes_ = totals(tables, "bytes", grain, where).select(*own, F.col("value").alias("value2"))
    out = found.join(bytes_, own, "left").withColumn("value2", F.coalesce("value2", F.lit(0)).cast("long"))
    return out.orderBy(F.desc("value"), *own).limit(n)


def http_errors(blocks: DataFrame, n: int = 100) -> DataFrame:
    """Hits by description (status, host, port, path and server) of paired HTTP blocks with status 400 and up."""
    return described(blocks).groupBy("description").agg(F.count(F.lit(1)).alias("value")).orderBy(F.desc("value"), "description").limit(n)


def http_error_sources(blocks: DataFrame) -> DataFrame:
    return described(blocks).groupBy("description", "ip").agg(F.count(F.lit(1)).alias("value"))


def described(blocks: DataFrame) -> DataFrame:
    """Failed requests with their description: status, host, port unless it is 80, path and server."""
    server = net.ip_to_text(F.col("server_ip"))
    host = F.when(F.col("host") == "", server).otherwise(F.col("host"))
    port = F.when(F.col("server_port") == 80, "").otherwise(F.concat(F.lit(":"), F.col("server_port").cast("string")))
    text = F.concat(F.col("status").cast("string"), host, port, F.col("path"), F.lit(" ("), server, F.lit(")"))
    return blocks.where("status >= 400").withColumn("description", text).withColumnRenamed("client_ip", "ip")


__all__ = ["BASES", "GRAINS", "http_error_sources", "http_errors", "latencies", "measured", "model", "protocol_split", "ranking", "totals"]
