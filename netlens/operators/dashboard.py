"""Service dashboard, working hours and composed reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens.functions import net
from netlens.operators import flows, series, topn, trackers
from netlens.plans.conditions import Conditions, accepted, facts
from netlens.sources.tables import Tables

LOOKBACKS = (60, 600, 1800, 3600, 21600)
COUNTERS = ("timeoutcounts", "tcpretransmissions", "tcpzerowindows")


def alias_of(rows: DataFrame, cidr: DataFrame, ip: str, port: str | None = None) -> DataFrame:
    """``rows`` with the alias of the first network in order that holds ``ip`` and whose port is equal or 0; '' without.

    The networks are a user's list.  They are put in groups by mask, so each group is an equality join and a large fact
    table is never compared with every network.
    """
    masks = [r["mask"] for r in cidr.select("mask").distinct().orderBy("mask").collect()]  # 33 at most
    ips = rows.select(ip, *([port] if port else [])).distinct()
    found = None
    for mask in masks:
        own = cidr.where(F.col("mask") == mask).select(F.col("ip").alias("_net"), F.col("port").alias("_port"), F.col("alias").alias("_alias"), F.col("ord").alias("_ord"))
        hit = ips.withColumn("_net", F.col(ip).bitwiseAND(mask)).join(own, "_net")
        hit = hit.where((F.col("_port") == 0) | (F.col("_port") == F.col(port))) if port else hit.where("_port = 0")
        hit = hit.select(*ips.columns, "_alias", "_ord")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return rows.withColumn("alias", F.lit(""))
    best = found.groupBy(*ips.columns).agg(F.min_by("_alias", "_ord").alias("alias"))
    return rows.join(best, ips.columns, "left").withColumn("alias", F.coalesce("alias", F.lit("")))


def prefix6(ip6: Column, length: Column) -> Column:
    """The first ``length`` bits of an address of 32 hex digits, as its whole digits and the bits of the next one."""
    whole, rest = net.div(length, 4).cast("int"), (length % 4).cast("int")
    digit = F.conv(F.substring(ip6, whole + 1, F.lit(1)), 16, 10).cast("int")
    bits = F.when(rest > 0, F.conv(digit.bitwiseAND(F.lit(16) - F.call_function("shiftright", F.lit(16), rest)), 10, 16)).otherwise("")
    return F.concat(F.substring(ip6, F.lit(1), whole), F.lit("/"), F.lower(bits))


def alias_of6(rows: DataFrame, networks: DataFrame, ip6: str, port: str | None = None) -> DataFrame:
    """As :func:`alias_of` for version 6.  ``networks``: (ip6 of 32 hex digits, length, port, alias, ord).

    Every different address meets the networks by its prefix of each length that the list has (129 at most), in one
    equality join, so there is no comparison with every network.  A row without an address has no alias."""
    nets = networks.select(F.col("length").cast("int").alias("_length"), prefix6(F.lower("ip6"), F.col("length")).alias("_prefix"), F.col("port").alias("_port"), F.col("alias").alias("_alias"), F.col("ord").alias("_ord"))
    lengths = [r["_length"] for r in nets.select("_length").distinct().orderBy("_length").collect()]
    ips = rows.where(F.col(ip6).isNotNull()).select(ip6, *([port] if port else [])).distinct()
    probes = ips.withColumn("_length", F.explode(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"))).withColumn("_prefix", prefix6(F.lower(ip6), F.col("_length")))
    hit = probes.join(nets, ["_length", "_prefix"])
    hit = hit.where((F.col("_port") == 0) | (F.col("_port") == F.col(port))) if port else hit.where("_port = 0")
    best = hit.groupBy(*ips.columns).agg(F.min_by("_alias", "_ord").alias("alias"))
    return rows.join(best, ips.columns, "left").withColumn("alias", F.coalesce("alias", F.lit("")))


def service_facts(tables: Tables, table: str, where: Conditions) -> DataFrame:
    """Facts of sessions whose destination is a service of the list 'servers', with its alias."""
    rows = facts(tables, table, where, ["src_ip", "dst_ip", "dst_port", "source_is_small"])
    return alias_of(rows, tables["cidr"].where("set_name = 'servers'"), "dst_ip", "dst_port").where("alias <> ''").withColumnRenamed("alias", "service")


def service_bps(tables: Tables, now: int, seconds: int = 600) -> DataFrame:
    """Bits in each of the last seconds of every service that had traffic."""
    where = Conditions(now - seconds + 1, now)
    found = service_facts(tables, "bps", where).groupBy("service", F.col("second").alias("timestamp")).agg(((F.sum(F.col("small_to_big") + F.col("big_to_small"))) * 8).cast("long").alias("value"))
    grid = found.select("service").distinct().withColumn("timestamp", F.explode(F.sequence(F.lit(where.second_from).cast("long"), F.lit(now).cast("long"))))
    return grid.join(found, ["service", "timestamp"], "left").select("service", "timestamp", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def service_clients(tables: Tables, now: int, seconds: int = 600) -> DataFrame:
    """Active clients of every service by client group and second."""
    rows = service_facts(tables, "bps", Conditions(now - seconds + 1, now))
    rows = alias_of(rows, tables["cidr"].where("set_name = 'inside'"), "src_ip").withColumnRenamed("alias", "clientgroup")
    return rows.groupBy("service", "clientgroup", F.col("second").alias("timestamp")).agg(F.countDistinct("src_ip").alias("clients"))


def service_counters(tables: Tables, now: int) -> DataFrame:
    """Anomalies of every service over the look-backs, in one pass over the longest; sessions are named once."""
    where = Conditions(now - max(LOOKBACKS) + 1, now)
    sessions = accepted(tables, where).select("session_id", "dst_ip", "dst_port")
    named = alias_of(sessions, tables["cidr"].where("set_name = 'servers'"), "dst_ip", "dst_port").where("alias <> ''")
    rows = series.markers(tables, COUNTERS, where).join(named.select("session_id", F.col("alias").alias("service")), "session_id")
    return rows.groupBy("service", "kind").agg(*[F.count(F.when(F.col("second") > now - k, 1)).alias(f"last{k}") for k in LOOKBACKS])


def service_rtt(tables: Tables, now: int) -> DataFrame:
    """Mean, least and greatest round trip of every service over the look-backs."""
    rows = service_facts(tables, "rtts", Conditions(now - max(LOOKBACKS) + 1, now)).where(series.good_rtt())
    cells = []
    for k in LOOKBACKS:
        v = F.when(F.col("second") > now - k, F.col("tail"))
        cells += [F.coalesce(net.div(F.sum(v), F.nullif(F.count(v), F.lit(0))), F.lit(0)).cast("long").alias(f"avg{k}"), F.coalesce(F.min(v), F.lit(0)).alias(f"bottom{k}"), F.coalesce(F.max(v), F.lit(0)).alias(f"top{k}")]
    return rows.groupBy("service").agg(*cells)


# ---------------------------------------------------------------- working hours


def working_hours(tables: Tables, where: Conditions, by: str, base: str = "bytes", weekdays: tuple[int, ...] = (2, 3, 4, 5, 6), begin: int = 540, end: int = 1080) -> DataFrame:
    """Values in working hours by day, tag (names that start with *) or service: sum, and the greatest minute with its
    time.  weekdays: 1 is Sunday; begin and end: minutes of the day, end excluded.  The session's time zone counts.

    ``base`` is one of :data:`topn.BASES` or ``bps``: bits a second, the sum over all working minutes (of the day, or of the
    range) that had any traffic, the greatest minute over its 60 seconds."""
    rows = topn.measured(tables, "bytes" if base == "bps" else base, where)
    at = F.timestamp_seconds("second")
    minute_of_day = F.hour(at) * 60 + F.minute(at)
    rows = rows.where(F.dayofweek(at).isin(*weekdays) & (minute_of_day >= begin) & (minute_of_day < end))
    working = rows.select(F.date_format(at, "yyyy-MM-dd").alias("key"), net.minute(F.col("second")).alias("minute")).distinct()
    if by == "days":
        rows = rows.withColumn("key", F.date_format(at, "yyyy-MM-dd"))
    elif by == "services":
        rows = rows.withColumn("key", F.concat_ws(":", net.ip_to_text(F.col("dst_ip")), F.col("dst_port").cast("string")))
    else:
        tags = tables["tag_ip"].where(F.col("tag").startswith("*")).select(net.hex_to_ip(F.col("ip_hex")).alias("ip"), F.col("tag").alias("key"))
        ends = rows.withColumn("ip", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))))
        rows = ends.join(tags, "ip")
    minutes = rows.groupBy("key", net.minute(F.col("second")).alias("minute")).agg(F.sum("n").cast("long").alias("value"))
    best = minutes.groupBy("key").agg(F.sum("value").cast("long").alias("value"), F.max(F.struct("value", (-F.col("minute")).alias("m"))).alias("top"))
    out = best.select("key", "value", F.col("top.value").alias("top"), (-F.col("top.m")).alias("topat"))
    if base != "bps":
        return out
    read = working.groupBy("key").agg(F.count(F.lit(1)).alias("n")) if by == "days" else working.agg(F.count(F.lit(1)).alias("n"))
    out = out.join(read, "key") if by == "days" else out.join(F.broadcast(read))  # one row
    return out.select("key", net.div(F.col("value") * 8, F.col("n") * 60).alias("value"), net.div(F.col("top") * 8, 60).alias("top"), "topat")


# ---------------------------------------------------------------- reports


def usage(tables: Tables, where: Conditions, n: int = 100) -> DataFrame:
    return topn.ranking(tables, "bytes", "source", where, n)


def bps_peak(tables: Tables, where: Conditions, n: int = 5) -> DataFrame:
    """The n seconds of most traffic with the pair that moved most in each, and that pair's anomalies in the range."""
    peaks = series.top(series.bps(tables, where), n).select("timestamp", F.col("value").alias("bits"))
    moved = topn.measured(tables, "bytes", where).join(peaks.select(F.col("timestamp").alias("second")), "second", "left_semi").groupBy(F.col("second").alias("timestamp"), F.col("src_ip").alias("ip"), F.col("dst_ip").alias("ip2")).agg(F.sum("n").cast("long").alias("bytes"))
    first = moved.withColumn("k", F.row_number().over(W.partitionBy("timestamp").orderBy(F.desc("bytes"), "ip", "ip2"))).where("k = 1").drop("k")
    out = peaks.join(first, "timestamp")
    for kind in ("tcprsts", "tcpdupacks", "tcpretransmissions"):
        hits = topn.measured(tables, kind, where).groupBy(F.col("src_ip").alias("ip"), F.col("dst_ip").alias("ip2")).agg(F.sum("n").cast("long").alias(kind))
        out = out.join(hits, ["ip", "ip2"], "left").withColumn(kind, F.coalesce(kind, F.lit(0)).cast("long"))
    return out


TCP_PAGE = ("tcpzerowindows", "tcpretransmissions", "tcpdupacks", "tcprsts", "tcpoutoforders")


def tcp_page(tables: Tables, where: Conditions, n: int = 5) -> DataFrame:
    """The first n services of each TCP anomaly with the other anomalies of the same pair, either way round."""
    out = None
    pair = [F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b")]
    for kind in TCP_PAGE:
        first = topn.ranking(tables, kind, "service", where, n).select(F.lit(kind).alias("kind"), "ip", "ip2", "port", "direction", "value")
        out = first if out is None else out.unionByName(first)
    out = out.withColumn("a", F.least("ip", "ip2")).withColumn("b", F.greatest("ip", "ip2"))
    for kind in TCP_PAGE:
        hits = topn.measured(tables, kind, where).groupBy(*pair).agg(F.sum("n").cast("long").alias(f"all_{kind}"))
        out = out.join(hits, ["a", "b"], "left").withColumn(f"all_{kind}", F.coalesce(f"all_{kind}", F.lit(0)).cast("long"))
    return out.drop("a", "b")


def busiest_ports(tables: Tables, where: Conditions, n: int = 100) -> DataFrame:
    """Server ports by bytes."""
    return flows.overview_summary(flows.overview(tables, where, "source"), where).orderBy(F.desc("bytes"), "payloadprotocol", "port").limit(n)


def icmp_page(tables: Tables, where: Conditions, n: int = 100) -> DataFrame:
    return flows.icmp_summary(tables, where).orderBy(F.desc("count"), "type", "code", "ip", "ip2").limit(n)


def dns_page(tables: Tables, where: Conditions, n: int = 100) -> DataFrame:
    """DNS servers by questions, with what went wrong there."""
    return trackers.dns_statistics(trackers.dns_sessions(tables, where), ["server"]).orderBy(F.desc("queriestaken"), "server").limit(n)


def tcp_page_events(tables: Tables, where: Conditions, kind: str, pairs: int = 3, n: int = 5) -> DataFrame:
    """The first n raw markers of each of the first pairs of client and service of a TCP anomaly."""
    own = ["ip", "ip2", "port", "direction"]
    first = topn.ranking(tables, kind, "service", where, pairs).select(*own)
    rows = topn.measured(tables, kind, where).select("second", *topn.keys("service"))
    order = W.partitionBy(*own).orderBy("second")
    return rows.join(F.broadcast(first), own, "left_semi").withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select(F.lit(kind).alias("kind"), *own, "k", "second")  # pairs rows


#: Pages of a diagnostic report by name; each makes a lazy DataFrame of (tables, conditions).
PAGES = {
    "bps": lambda t, w: series.bins(series.bps(t, w), w, 3600),
    "pps": series.pps,
    "icmp": icmp_page,
    "port": busiest_ports,
    "dns": dns_page,
    "http-error": lambda t, w: topn.http_errors(trackers.http_records(t, w)),
    "usage": usage,
    "bps-peak": bps_peak,
    "tcp": tcp_page,
    **{name: lambda t, w, kind=kind: topn.ranking(t, kind, "service", w, 100) for name, kind in {"zero-windows": "tcpzerowindows", "retransmissions": "tcpretransmissions", "dup-acks": "tcpdupacks", "resets": "tcprsts", "out-of-orders": "tcpoutoforders"}.items()},
}


def compose(tables: Tables, where: Conditions, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The named pages of a diagnostic report (all without names), in order."""
    return {name: PAGES[name](tables, where) for name in names or PAGES}
