"""Operators over sessions and packets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens import model
from netlens.functions import net
from netlens.operators import series, texts
from netlens.plans.conditions import Conditions, accepted, facts
from netlens.sources.sessions import fix_direction, learn_services, merge_sessions
from netlens.sources.tables import Tables

__all__ = ["fix_direction", "learn_services", "merge_sessions"]


def _directed(forward: bool) -> Column:
    a, b = (F.col("small_to_big"), F.col("big_to_small")) if forward else (F.col("big_to_small"), F.col("small_to_big"))
    return F.when(F.col("source_is_small") == 1, a).otherwise(b)


def session_bytes(tables: Tables, where: Conditions, table: str = "bps") -> DataFrame:
    rows = facts(tables, table, where, ["source_is_small"])
    return rows.groupBy("session_id").agg(F.sum(_directed(True)).cast("long").alias("ip1toip2"), F.sum(_directed(False)).cast("long").alias("ip2toip1"))


def data_streams(tables: Tables, where: Conditions) -> DataFrame:
    """One row for each session with bytes (IPv4 TCP, or UDP): ends, bytes each way, round trip (-1: none or timed out)."""
    s = accepted(tables, where).where(((F.col("ether_type") == 2048) & (F.col("payload_protocol") == model.TCP)) | (F.col("payload_protocol") == model.UDP))
    rtt = facts(tables, "rtts", where, ["source_is_small"]).where(series.good_rtt()).groupBy("session_id").agg(*series.rtt_sums()).select("session_id", series.represent().alias("mean"))
    gone = facts(tables, "timeouts", where).select("session_id").distinct().withColumn("gone", F.lit(True))
    out = s.join(session_bytes(tables, where), "session_id").join(rtt, "session_id", "left").join(gone, "session_id", "left")
    value = F.when(F.col("gone").isNotNull(), -1).otherwise(F.coalesce("mean", F.lit(-1))).cast("long")
    return out.where(F.col("ip1toip2") + F.col("ip2toip1") > 0).select(
        F.col("first_second").alias("start"), F.col("last_second").alias("end"), F.col("src_ip").alias("client"), F.col("src_port").alias("clientport"), F.col("dst_ip").alias("server"), F.col("dst_port").alias("serverport"),
        F.col("payload_protocol").alias("payloadprotocol"), F.col("l7").alias("detectedl7"), F.col("session_id").alias("sessionid"), "ip1toip2", "ip2toip1", value.alias("rtt"),
    )


def data_streams_page(streams: DataFrame, offset: int, limit: int) -> DataFrame:
    return streams.orderBy("start", "sessionid").offset(offset).limit(limit)


def data_streams_summary(streams: DataFrame) -> DataFrame:
    total, rtt = F.col("ip1toip2") + F.col("ip2toip1"), F.when(F.col("rtt") >= 0, F.col("rtt"))
    mean = lambda x: F.coalesce(net.div(F.sum(x), F.nullif(F.count(x), F.lit(0))), F.lit(0)).cast("long")
    return streams.agg(
        F.count(F.lit(1)).alias("sessions"), F.coalesce(F.min(total), F.lit(0)).cast("long").alias("bytes_min"), F.coalesce(F.max(total), F.lit(0)).cast("long").alias("bytes_max"), mean(total).alias("bytes_avg"),
        F.coalesce(F.min(rtt), F.lit(0)).cast("long").alias("rtt_min"), F.coalesce(F.max(rtt), F.lit(0)).cast("long").alias("rtt_max"), mean(rtt).alias("rtt_avg"), F.sum(F.when(F.col("rtt") < 0, 1).otherwise(0)).cast("long").alias("without_rtt"),
    )


def data_streams_matching(streams: DataFrame, rows: DataFrame, pattern: str) -> DataFrame:
    """Streams whose text, put together in file order, matches a pattern (:func:`netlens.operators.texts.matching`)."""
    return streams.join(texts.matching(rows, pattern), F.col("sessionid") == F.col("session_id"), "left_semi")


def services_clients(tables: Tables, where: Conditions) -> DataFrame:
    """Sessions of each client of each service (server ip, port, protocol)."""
    s = accepted(tables, where).where(F.col("payload_protocol").isin(model.TCP, model.UDP))
    return s.groupBy(F.col("dst_ip").alias("serverip"), F.col("dst_port").alias("serverport"), F.col("payload_protocol").alias("payloadprotocol"), F.col("l7").alias("l7protocol"), F.col("src_ip").alias("client")).agg(F.count(F.lit(1)).alias("hits"))


def services(clients: DataFrame) -> DataFrame:
    return clients.groupBy("serverip", "serverport", "payloadprotocol", "l7protocol").agg(F.count(F.lit(1)).alias("clients"), F.sum("hits").cast("long").alias("totalhits"))


def macs_per_ip(tables: Tables, where: Conditions) -> DataFrame:
    """Source MACs seen with each sending IP."""
    rows = facts(tables, "packets", where, ["src_ip", "dst_ip", "source_is_small"])
    from_source = F.col("small_to_big") == F.col("source_is_small")
    ip = F.when(from_source, F.col("src_ip")).otherwise(F.col("dst_ip"))
    mac = F.when(from_source, F.col("src_mac")).otherwise(F.col("dst_mac"))
    return rows.select(ip.alias("ip"), mac.alias("mac")).distinct()


def overview(tables: Tables, where: Conditions, gather_by: str) -> DataFrame:
    """Bytes and packets by transport, server port and address(es)."""
    ips = {"source": ["src_ip"], "destination": ["dst_ip"], "iptoservice": ["src_ip", "dst_ip"]}[gather_by]
    by = ["payload_protocol", "dst_port", *ips]
    tcp_udp = F.col("payload_protocol").isin(model.TCP, model.UDP)
    n = (F.col("small_to_big") + F.col("big_to_small")).alias("n")
    rows = facts(tables, "bps", where, by).where(tcp_udp).select(*by, n.alias("bytes"), F.lit(0).cast("long").alias("packets"))
    rows = rows.unionByName(facts(tables, "pps", where, by).where(tcp_udp).select(*by, F.lit(0).cast("long").alias("bytes"), n.alias("packets")))
    out = rows.groupBy(*by).agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("packets").cast("long").alias("packets"))
    shown = [F.col(c).alias("ip" if k == 0 else "ip2") for k, c in enumerate(ips)]
    return out.select(F.col("payload_protocol").alias("payloadprotocol"), F.col("dst_port").alias("port"), *shown, "bytes", "packets")


def overview_summary(table: DataFrame, where: Conditions) -> DataFrame:
    """By port: bytes, packets, different addresses, and averages over the range's seconds."""
    seconds = where.second_to - where.second_from + 1
    out = table.groupBy("payloadprotocol", "port").agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("packets").cast("long").alias("packets"), F.countDistinct("ip").alias("ips"))
    return out.select("*", net.div(F.col("bytes"), seconds).alias("averagebps"), net.div(F.col("packets"), seconds).alias("averagepps"))


def low_hop_records(tables: Tables, where: Conditions, n: int) -> DataFrame:
    rows = facts(tables, "packets", where, ["src_ip", "dst_ip", "source_is_small"]).where(F.col("hop_limit") <= n)
    rows = rows.where(net.cast_type(F.col("source_is_small"), F.col("src_ip"), F.col("dst_ip")) != "UNKNOWN")
    out = F.col("small_to_big") == F.col("source_is_small")
    return rows.select(
        "second", F.col("ns").alias("nanosecond"), F.col("hop_limit").alias("hop"), F.when(out, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("source"), F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("destination"), out.cast("int").alias("fromclient")
    )


def low_hop_per_second(records: DataFrame, where: Conditions) -> DataFrame:
    return series.dense(records.groupBy(F.col("second").alias("timestamp")).agg(F.count(F.lit(1)).alias("value")), where)


def low_hop_ranking(records: DataFrame, limit: int = 100) -> DataFrame:
    return records.where("fromclient = 1").groupBy("source", "destination").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "source", "destination").limit(limit)


def _icmp(tables: Tables, where: Conditions, version: int) -> DataFrame:
    table = {4: "icmp_packets", 6: "icmp6_packets"}[version]
    return tables[table].where(where.within(F.col("second"))).join(accepted(tables, where).select("session_id", "src_ip", "dst_ip"), "session_id")


def icmp_summary(tables: Tables, where: Conditions, version: int = 4) -> DataFrame:
    """Packets by ICMP type, code and pair of addresses."""
    return _icmp(tables, where, version).groupBy("type", "code", F.col("src_ip").alias("ip"), F.col("dst_ip").alias("ip2")).agg(F.count(F.lit(1)).alias("count"))


#: Remark lines of ICMP packets by version: table, hex digits of an address, pattern of (packet index, protocol, addresses
#: and ports) with the groups' numbers, and the protocols that are not given as numbers.
ICMP_LINES = {
    4: ("icmp_remarks", 8, r"^ICMP(\d+)=(\d+) ([0-9a-f]{16}|[0-9a-f]{24})$", (1, 2, 3), {}),
    6: ("icmp6_remarks", 32, r"^ICMPV6(\d+)=([0-9a-f]{64})\t([TU]?)((?:[0-9a-f]{8})?)$", (1, 3, 2, 4), {"T": "6", "U": "17", "": "0"}),
}


def icmp_detail(tables: Tables, where: Conditions, kind: int, code: int, version: int = 4) -> DataFrame:
    """Packets of a type and code with the addresses and ports of the packet that they report on, from the remark lines
    ``ICMP<index>=<protocol> <hex>`` or ``ICMPV6<index>=<hex>\\t[T or U<hex>]``; ports follow the addresses, low byte first."""
    table, digits, pattern, (at_idx, at_proto, *at_raw), names = ICMP_LINES[version]
    rows = _icmp(tables, where, version).where((F.col("type") == kind) & (F.col("code") == code))
    part = lambda k: F.regexp_extract("line", pattern, k)
    lines = tables[table].select("session_id", "file_seq", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(pattern))
    proto = net.label(part(at_proto), names) if names else part(at_proto)
    lines = lines.select("session_id", "file_seq", part(at_idx).cast("long").alias("idx"), proto.cast("int").alias("proto"), F.concat(*[part(k) for k in at_raw]).alias("raw"))
    both = 2 * digits
    port = lambda at: F.when(F.length("raw") == both + 8, F.conv(F.concat(F.substring("raw", at + 2, 2), F.substring("raw", at, 2)), 16, 10).cast("int")).otherwise(0)
    text = lambda at: F.coalesce(F.substring("raw", at, digits), F.lit(""))
    out = rows.join(lines, ["session_id", "file_seq", "idx"], "left")
    return out.select(
        F.col("second"), F.col("ns").alias("nanosecond"), F.col("src_ip").alias("ip"), F.col("dst_ip").alias("ip2"), "type", "code", F.coalesce("proto", F.lit(0)).alias("payloadprotocol"),
        text(1).alias("original_ip"), text(1 + digits).alias("original_ip2"), F.coalesce(port(both + 1), F.lit(0)).alias("port"), F.coalesce(port(both + 5), F.lit(0)).alias("port2"),
    )


RESOLUTION = {"ms": 1_000_000, "us": 1_000, "ns": 1}


def microburst(tables: Tables, where: Conditions, resolution: str = "ms", threshold_bits: int = 1_400_000) -> DataFrame:
    """Time buckets whose packets carry ``threshold_bits`` or more."""
    step = RESOLUTION[resolution]
    at = net.div(F.col("second") * 1_000_000_000 + F.col("ns"), step) * step
    return facts(tables, "packets", where).groupBy(at.alias("timestamp")).agg(F.sum("saved_length").cast("long").alias("bytes")).where(F.col("bytes") >= threshold_bits // 8)


def microburst_detail(tables: Tables, where: Conditions, resolution: str = "ms", threshold_bits: int = 1_400_000) -> DataFrame:
    """Bytes each way of the pairs in each burst."""
    step = RESOLUTION[resolution]
    at = net.div(F.col("second") * 1_000_000_000 + F.col("ns"), step) * step
    rows = facts(tables, "packets", where, ["src_ip", "dst_ip", "dst_port", "source_is_small"]).withColumn("timestamp", at)
    forward = F.col("small_to_big") == F.col("source_is_small")
    out = rows.join(microburst(tables, where, resolution, threshold_bits).select("timestamp"), "timestamp", "left_semi").groupBy("timestamp", F.col("src_ip").alias("ip"), F.col("dst_ip").alias("ip2"), F.col("dst_port").alias("port2"))
    return out.agg(F.sum(F.when(forward, F.col("saved_length")).otherwise(0)).cast("long").alias("iptoip2"), F.sum(F.when(forward, 0).otherwise(F.col("saved_length"))).cast("long").alias("ip2toip"))


HASHED = ["session_id", "tcp_seq", "tcp_ack", "saved_length", "status", "small_to_big"]


def packet_hash(tables: Tables, where: Conditions) -> DataFrame:
    """The first packet of each different set of hashed fields in a file, of TCP sessions.  Equality of the fields takes
    the place of a hash, so two packets never match by accident."""
    s = accepted(tables, where).where(F.col("payload_protocol") == model.TCP).select("session_id")
    rows = tables["packets"].where(where.within(F.col("second"))).join(s, "session_id", "left_semi").withColumn("timestamp", F.col("second") * 1_000_000_000 + F.col("ns"))
    return rows.groupBy("file_seq", *HASHED).agg(F.min(F.struct("timestamp", "idx")).alias("x")).select("file_seq", *HASHED, "x.timestamp", "x.idx")


def packet_loss_latency(near: DataFrame, far: DataFrame, window_ns: int = 10_000_000_000) -> DataFrame:
    """Each packet of ``near`` with the least non-negative delay to an equal packet of ``far`` within the window; else the
    least delay backwards; else it is lost.  A packet with a null among the hashed fields equals none.

    Both sides are merged in the order of time, key by key and by blocks as long as the window: the nearest packet of
    ``far`` stands in the own block, or is the first of the next or the last of the one before.  The work grows with the
    packets, not with their pairs, and one key with very many packets is as many groups as it has blocks."""
    block = F.expr(f"(t - pmod(t, {window_ns}L)) div {window_ns}L").alias("block")
    mine = near.select("file_seq", "idx", *HASHED, F.col("timestamp").alias("t"), F.lit(1).alias("own"))
    other = far.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in HASHED])).select(F.lit(None).cast("long").alias("file_seq"), F.lit(None).cast("long").alias("idx"), *HASHED, F.col("timestamp").alias("t"), F.lit(0).alias("own"))
    both = mine.unionByName(other).select("*", block, F.when(F.col("own") == 0, F.col("t")).alias("there"))
    group = W.partitionBy(*HASHED, "block")
    # of equal times, a packet of far counts as ahead and not as behind
    ahead = F.last("there", ignorenulls=True).over(group.orderBy(F.desc("t"), "own").rowsBetween(W.unboundedPreceding, 0))
    behind = F.last("there", ignorenulls=True).over(group.orderBy("t", F.desc("own")).rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("ahead", ahead).withColumn("behind", behind).where("own = 1")
    edges = other.select(*HASHED, block, "t").groupBy(*HASHED, "block").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    after = edges.select(*HASHED, (F.col("block") - 1).alias("block"), F.col("first").alias("next"))
    before = edges.select(*HASHED, (F.col("block") + 1).alias("block"), F.col("last").alias("previous"))
    found = found.join(after, [*HASHED, "block"], "left").join(before, [*HASHED, "block"], "left")
    near_by = lambda d: F.when(d <= window_ns, d)
    forward, back = near_by(F.coalesce("ahead", "next") - F.col("t")), near_by(F.col("t") - F.coalesce("behind", "previous"))
    status = F.when(forward.isNotNull(), "FORWARD").when(back.isNotNull(), "REVERSE").otherwise("LOST")
    return found.select("session_id", "small_to_big", "idx", F.col("t").alias("timestamp"), status.alias("status"), F.coalesce(forward, back, F.lit(-1)).cast("long").alias("latency"))


def packet_report(matched: DataFrame, limit: int = 100) -> DataFrame:
    """Mean latency and losses of each session and direction, the slowest first."""
    out = matched.groupBy(F.col("session_id").alias("sessionid"), F.col("small_to_big").alias("direction")).agg(
        F.coalesce(net.div(F.sum(F.when(F.col("status") != "LOST", F.col("latency"))), F.nullif(F.count(F.when(F.col("status") != "LOST", 1)), F.lit(0))), F.lit(0)).cast("long").alias("latency"),
        F.count(F.when(F.col("status") == "LOST", 1)).alias("lost"),
    )
    return out.orderBy(F.desc("latency"), "sessionid", "direction").limit(limit)


#: Seconds of one block of a session in ordered scans.
BLOCK_SECONDS = 60


def lag_in_blocks(rows: DataFrame, keys: list[str], order: list[str], value: str, second: Column) -> DataFrame:
    """``rows`` with ``before``, the value of the row before in the order of their key (null for the first).

    A window covers one minute of a key, and a second one the minutes of a key, which hand over their last values: a
    session with most of the rows is as many groups as it has minutes."""
    rows = rows.withColumn("block", net.div(second, BLOCK_SECONDS))
    last = rows.groupBy(*keys, "block").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    handed = last.select(*keys, "block", F.lag("_last").over(W.partitionBy(*keys).orderBy("block")).alias("_handed"))
    inside = W.partitionBy(*keys, "block").orderBy(*order)
    own = rows.withColumn("_own", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    return own.join(handed, [*keys, "block"]).withColumn("before", F.when(F.col("_first"), F.col("_handed")).otherwise(F.col("_own"))).drop("_own", "_first", "_handed", "block")


def running_sum_in_blocks(rows: DataFrame, keys: list[str], order: str, value: str, second: Column) -> DataFrame:
    """``rows`` with ``total``, the sum of the values up to their place, rows of equal order included; by minutes as in
    :func:`lag_in_blocks`."""
    rows = rows.withColumn("block", net.div(second, BLOCK_SECONDS))
    sums = rows.groupBy(*keys, "block").agg(F.sum(value).alias("_sum"))
    ahead = F.sum("_sum").over(W.partitionBy(*keys).orderBy("block")) - F.col("_sum")
    inside = F.sum(value).over(W.partitionBy(*keys, "block").orderBy(order))
    return rows.withColumn("_inside", inside).join(sums.select(*keys, "block", ahead.alias("_ahead")), [*keys, "block"]).withColumn("total", F.col("_inside") + F.col("_ahead")).drop("_inside", "_ahead", "block")


def jitter(tables: Tables, where: Conditions) -> DataFrame:
    """Per session and side: mean, deviation and number of the changes from one round trip to the next.

    The deviation needs no second pass: the squares around the mean follow from the sums of the values and their squares."""
    rows = facts(tables, "rtts", where, ["source_is_small"]).where(series.good_rtt())
    side = F.when(F.col("small_to_big") == F.col("source_is_small"), 0).otherwise(1)
    change = lag_in_blocks(rows.withColumn("side", side), ["session_id", "side"], ["second", "ns", "tail"], "tail", F.col("second"))
    change = change.select("session_id", "side", F.abs(F.col("tail") - F.col("before")).alias("v")).where("v IS NOT NULL")
    v = F.col("v").cast("decimal(11,0)")  # 10 s at most; the squares do not fit 64 bits
    sums = change.groupBy("session_id", "side").agg(F.count("v").alias("n"), F.sum(v).cast("decimal(24,0)").alias("s"), F.sum(v * v).cast("decimal(36,0)").alias("ss"))
    sums = sums.withColumn("mean", net.div(F.col("s"), F.col("n")))
    mean, n = F.col("mean").cast("decimal(11,0)"), F.col("n").cast("decimal(13,0)")
    spread = sums.withColumn("q", F.col("ss") - (F.col("s") + F.col("s")).cast("decimal(25,0)") * mean + n * (mean * mean).cast("decimal(22,0)"))
    deviation = F.floor(F.sqrt(F.floor(F.col("q") / F.col("n")).cast("double"))).cast("long")
    spread = spread.select("session_id", "side", "mean", "n", deviation.alias("deviation"))
    pick = lambda c, k: F.coalesce(F.max(F.when(F.col("side") == k, F.col(c))), F.lit(0)).cast("long")
    both = spread.groupBy("session_id").agg(pick("mean", 0).alias("jitter"), pick("deviation", 0).alias("deviation"), pick("n", 0).alias("count"), pick("mean", 1).alias("jitter2"), pick("deviation", 1).alias("deviation2"), pick("n", 1).alias("count2"))
    packets = session_bytes(tables, where, "pps").select("session_id", (F.col("ip1toip2") + F.col("ip2toip1")).alias("totalpackets"))
    s = accepted(tables, where).select("session_id", F.col("src_ip").alias("clientip"), F.col("src_port").alias("clientport"), F.col("dst_ip").alias("serverip"), F.col("dst_port").alias("serverport"), F.col("payload_protocol").alias("payloadprotocol"))
    return both.join(s, "session_id").join(packets, "session_id", "left").withColumn("totalpackets", F.coalesce("totalpackets", F.lit(0)).cast("long"))


#: Flags of TCP packets, a packet of none of which carries data.
FIN, SYN, RST, ACK, CLOSED = 1, 2, 4, 16, 512
EVENTS = {"tcp_dupacks": "DUPACK", "tcp_retransmissions": "RETRANSMISSION", "tcp_misc": "OUTOFORDER"}


def session_packets(tables: Tables, where: Conditions) -> DataFrame:
    """Packets with the direction from the client and the events that they are; none: the packet transmits data.

    A TCP packet with a start, end or reset flag or without a receive window is an event; a start or end may also close
    the window."""
    rows = facts(tables, "packets", where, ["source_is_small", "payload_protocol"])
    flag = lambda *bits: F.col("status").bitwiseAND(sum(bits)) == sum(bits)
    kind = F.when(flag(SYN, ACK), "SYNACK").when(flag(SYN), "SYN").when(flag(FIN), "FIN").when(flag(RST), "RST").when(F.col("window") == 0, "ZEROWINDOW")
    more = F.when((flag(SYN) | flag(FIN)) & flag(CLOSED), "ZEROWINDOW")
    found = F.when(F.col("payload_protocol") == model.TCP, F.array_compact(F.array(kind, more))).otherwise(F.array().cast("array<string>"))
    return rows.select("session_id", "second", F.col("ns").alias("nanosecond"), F.col("saved_length").cast("long").alias("value"), (F.col("small_to_big") == F.col("source_is_small")).cast("int").alias("fromclient"), found.alias("events"))


def session_events(tables: Tables, where: Conditions, packets: DataFrame) -> DataFrame:
    """Things that happened in sessions, with the direction from the client (-1: none)."""
    columns = ["session_id", "second", "nanosecond", "value", "fromclient", "event"]
    out = packets.withColumn("event", F.explode("events")).select(*columns)
    for table, name in EVENTS.items():
        rows = facts(tables, table, where, ["source_is_small"])
        rows = rows.where(F.col("tail") == model.OUT_OF_ORDER) if table == "tcp_misc" else rows
        out = out.unionByName(rows.select("session_id", "second", F.col("ns").alias("nanosecond"), F.lit(0).cast("long").alias("value"), (F.col("small_to_big") == F.col("source_is_small")).cast("int").alias("fromclient"), F.lit(name).alias("event")))
    gone = facts(tables, "timeouts", where).select("session_id", F.col("marker_second").alias("second"), F.col("marker_ns").alias("nanosecond"), F.lit(0).cast("long").alias("value"), F.lit(-1).alias("fromclient"), F.lit("TIMEOUT").alias("event"))
    return out.unionByName(gone)


def session_audit(tables: Tables, where: Conditions) -> DataFrame:
    """Per session, events in order, and between them one Transmit row a direction with the bytes that went there.

    A packet belongs to the gap before the first event that is later than it; the gap's number is the count of events up
    to the packet's time.
    """
    packets = session_packets(tables, where)
    events = session_events(tables, where, packets)
    data = packets.where(F.size("events") == 0).select("session_id", "second", "nanosecond", "value", "fromclient", F.lit("Transmit").alias("event"))
    both = events.unionByName(data).withColumn("t", F.struct("second", "nanosecond")).withColumn("mark", (F.col("event") != "Transmit").cast("int"))
    gaps = running_sum_in_blocks(both, ["session_id"], "t", "mark", F.col("second")).withColumnRenamed("total", "gap").where("mark = 0")
    moved = gaps.groupBy("session_id", "gap", "fromclient").agg(F.min("t").alias("t"), F.sum("value").cast("long").alias("value")).where("value > 0")
    return events.unionByName(moved.select("session_id", "t.second", "t.nanosecond", "value", "fromclient", F.lit("Transmit").alias("event")))


def session_audit_index(tables: Tables, where: Conditions) -> DataFrame:
    return accepted(tables, where).select(F.col("session_id").alias("sessionid"), F.col("src_ip").alias("ip"), F.col("dst_ip").alias("ip2"), F.col("src_port").alias("port"), F.col("dst_port").alias("port2"), F.col("payload_protocol").alias("payloadprotocol"))


def cast_type_counts(tables: Tables, where: Conditions) -> DataFrame:
    return accepted(tables, where).groupBy(net.cast_type(F.col("source_is_small"), F.col("src_ip"), F.col("dst_ip")).alias("cast")).agg(F.count(F.lit(1)).alias("sessions"))


def schrodinger_tags(tables: Tables, where: Conditions) -> DataFrame:
    """Different VLAN tags and MPLS labels of accepted sessions."""
    ids = accepted(tables, where).select("session_id")
    parts = [tables[t].join(ids, "session_id", "left_semi").select(F.lit(k).alias("kind"), "tag") for k, t in (("vlanq", "session_vlan"), ("mpls", "session_mpls"))]
    return parts[0].unionByName(parts[1]).distinct()


def raw(tables: Tables, name: str, where: Conditions) -> DataFrame:
    """A fact table as it is, cut to the conditions."""
    if name == "sessions":
        return accepted(tables, where)
    if name == "remarks":
        # one join for all protocols (a semi-join would be done for each), against a hash table of ids, so no text is sorted
        ids = accepted(tables, where).select("session_id").distinct()
        return remarks(tables).join(ids.hint("shuffle_hash"), "session_id").select("protocol", "session_id", "file_seq", "content")
    return facts(tables, name, where)


#: Tables of remark lines by protocol: table and column.
REMARKS = {"HTTP": ("http_remarks", "content"), "DNS": ("dns_remarks", "content"), "TLS": ("tls_remarks", "content"), "SMTP": ("mail_remarks", "smtp"), "POP3": ("mail_remarks", "pop3"), "IMAP": ("mail_remarks", "imap"), "FTP": ("mail_remarks", "ftp"), "ICMP": ("icmp_remarks", "content"), "ICMPv6": ("icmp6_remarks", "content"), "SIP": ("sip_remarks", "body")}


def remarks(tables: Tables) -> DataFrame:
    """(protocol, session_id, file_seq, content) of the remarks of all protocols."""
    parts = [tables[table].select(F.lit(name).alias("protocol"), "session_id", F.col("file_seq").cast("long").alias("file_seq"), F.col(column).alias("content")) for name, (table, column) in REMARKS.items()]
    return reduce(DataFrame.unionByName, parts).where("content <> ''")


def session_tags(tables: Tables, where: Conditions) -> DataFrame:
    """VLAN tags and MPLS labels of every accepted session."""
    ids = accepted(tables, where).select("session_id")
    parts = [tables[t].join(ids, "session_id", "left_semi").select("session_id", F.lit(k).alias("kind"), "tag") for k, t in (("vlanq", "session_vlan"), ("mpls", "session_mpls"))]
    return parts[0].unionByName(parts[1])


def payload_stream(packets: DataFrame, session_id: int) -> DataFrame:
    """Payload of a session in packet order, for stores that keep a ``payload`` column; a long session is read in parts
    (:func:`netlens.operators.texts.payload_parts`)."""
    own = packets.where(F.col("session_id") == session_id)
    ordered = F.array_sort(F.collect_list(F.struct("second", "ns", "idx", F.hex("payload").alias("h"))))
    return own.groupBy("session_id", "small_to_big").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias("payload"))
