"""The catalogue: every registered query of the traffic engine, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.operators import flows, rollup, series, texts, topn
from netlens.plans import catalog_apps, catalog_stored
from netlens.plans import oracles as o
from netlens.plans.conditions import Conditions, Network
from netlens.sources.fixtures import duckdb_with
from netlens.sources.sessions import whole_sessions
from netlens.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
DAY, MONTH = Conditions(*o.DAY), Conditions(*o.MONTH)
INSIDE = (Network(167772160, 0xFFFFFFC0),)

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None) -> None:
    _queries[name] = lambda spark, sf_dir: build(Tables.derived(spark, sf_dir))
    if sql:
        _sql[name] = duckdb_with(sql)


def _month(sql: str) -> str:
    """SQL text of the day, over the month."""
    return sql.replace(str(o.DAY[1] + 1), str(o.MONTH[1] + 1)).replace(str(o.DAY[0]), str(o.MONTH[0])).replace(str(o.DAY[1]), str(o.MONTH[1]))


def _series() -> None:
    register("bps", lambda t: series.bps(t, DAY), o.bps())
    for kind in series.COUNTS:
        register(kind, lambda t, kind=kind: series.counts(t, kind, DAY), o.count_series(kind))
    macs = ("020000001001", "020000001002")
    register("pps", lambda t: series.pps(t, DAY), o.pps())
    register("pps_ignoremac", lambda t: series.pps(t, DAY, macs), o.pps(macs=macs))
    register("averagelatency", lambda t: series.average_latency(t, DAY), o.latency())
    register("flowcounts", lambda t: series.flow_counts(t, DAY), o.flow_counts())
    register("bps2", lambda t: series.bps2(t, DAY, INSIDE), o.bps2())
    register("bpms", lambda t: series.bpms(t, MONTH, 1704067207), o.bpms())
    register("bps_bins", lambda t: series.bins(series.bps(t, MONTH), MONTH, 3600), o.bins(o.bps(o.MONTH), o.MONTH, 3600))
    register("tcprsts_bins", lambda t: series.bins(series.counts(t, "tcprsts", MONTH), MONTH, 7000), o.bins(o.count_series("tcprsts", o.MONTH), o.MONTH, 7000))
    register("averagelatency_bins", lambda t: series.bins(series.average_latency(t, MONTH), MONTH, 600), o.bins(o.latency(o.MONTH), o.MONTH, 600))
    register("pps_bins", lambda t: series.bins(series.pps(t, MONTH), MONTH, 3600, "unicast", zeros=True), o.bins(o.pps(o.MONTH), o.MONTH, 3600, "unicast", zeros=True))
    register("bps2_bins", lambda t: series.bins(series.bps2(t, MONTH, INSIDE), MONTH, 3600, "egress", zeros=True), o.bins(o.bps2(o.MONTH), o.MONTH, 3600, "egress", zeros=True))
    for kind in series.COUNTS:
        if kind != "tcprsts":
            register(f"{kind}_bins", lambda t, kind=kind: series.bins(series.counts(t, kind, MONTH), MONTH, 3600), o.bins(o.count_series(kind, o.MONTH), o.MONTH, 3600))
    register("flowcounts_bins", lambda t: series.bins(series.flow_counts(t, MONTH), MONTH, 3600, zeros=True), o.bins(_month(o.flow_counts()), o.MONTH, 3600, zeros=True))
    register("pps_ignoremac_bins", lambda t: series.bins(series.pps(t, MONTH, macs), MONTH, 3600, "unicast"), o.bins(o.pps(o.MONTH, macs), o.MONTH, 3600, "unicast"))
    register("bps_minmax", lambda t: series.min_max(series.bps(t, MONTH)), o.min_max(o.bps(o.MONTH)))
    register("bps_top", lambda t: series.top(series.bps(t, MONTH), 20), f"SELECT * FROM ({o.bps(o.MONTH)}) ORDER BY value DESC, timestamp LIMIT 20")
    register("pps_top", lambda t: series.top(series.pps(t, MONTH), 20, series.CASTS), f"SELECT * FROM ({o.pps(o.MONTH)}) ORDER BY unknown + broadcast + multicast + unicast DESC, timestamp LIMIT 20")
    register("bps_page", lambda t: series.page(series.bps(t, DAY), 600, 1199, DAY.second_from), f"SELECT * FROM ({o.bps()}) WHERE timestamp BETWEEN {o.DAY[0] + 600} AND {o.DAY[0] + 1199}")


def _filters() -> None:
    day = dict(second_from=o.MONTH[0], second_to=o.MONTH[1])
    cases = {
        "bps_ips": (Conditions(**day, ips=INSIDE), "AND ((src_ip & 4294967232) = 167772160 OR (dst_ip & 4294967232) = 167772160)"),
        "bps_ips_internal": (Conditions(**day, ips=(Network(167772160, 0xFF000000 & 0xFFFFFFFF), Network(3232235776, 0xFFFFFFFE)), include_external=False), "AND (src_ip // 16777216 = 10 OR (src_ip & 4294967294) = 3232235776) AND (dst_ip // 16777216 = 10 OR (dst_ip & 4294967294) = 3232235776)"),
        "bps_ports": (Conditions(**day, ports=((443, 443), (20, 60))), "AND (src_port = 443 OR dst_port = 443 OR src_port BETWEEN 20 AND 60 OR dst_port BETWEEN 20 AND 60)"),
        "bps_protocol": (Conditions(**day, payload_protocol=17), "AND payload_protocol = 17"),
        "bps_l7": (Conditions(**day, l7=2), "AND l7 = 2"),
        "bps_vlan": (Conditions(**day, vlans=(2, 3)), "AND session_id IN (SELECT session_id FROM session_vlan WHERE tag IN (2, 3))"),
        "bps_mpls": (Conditions(**day, mpls=(17,)), "AND session_id IN (SELECT session_id FROM session_mpls WHERE tag = 17)"),
        "bps_tags": (Conditions(**day, tags=("*office",)), "AND (src_ip IN (167772161, 167772162) OR dst_ip IN (167772161, 167772162))"),
        "bps_apps": (Conditions(**day, apps=("www", "mail")), "AND (src_ip IN (3232235776, 3232235779) OR dst_ip IN (3232235776, 3232235779))"),
        "bps_ips6": (Conditions(**day, ips=(Network.parse("2001:db8::/120"),)), o.IN_SIX),
        "bps_userapps": (Conditions(**day, apps=("intranet", "wiki")), o.APPS),
        "bps_userapps6": (Conditions(**day, apps=("six",)), o.APPS6),
        "bps_excluded": (Conditions(**day, excluded=((167772161, None), (3232235776, 167772162))), "AND src_ip <> 167772161 AND dst_ip <> 167772161 AND NOT (least(src_ip, dst_ip) = 167772162 AND greatest(src_ip, dst_ip) = 3232235776)"),
    }
    for name, (where, more) in cases.items():
        register(name, lambda t, where=where: series.bins(series.bps(t, where), where, 3600), o.bins(o.bps(o.MONTH, more), o.MONTH, 3600))
    register("cast_type_counts", lambda t: flows.cast_type_counts(t, MONTH), f"WITH {o.acc(o.MONTH)} SELECT upper({o.CAST}) AS \"cast\", COUNT(*) AS sessions FROM acc GROUP BY 1")
    register("schrodinger_tags", lambda t: flows.schrodinger_tags(t, MONTH), f"WITH {o.acc(o.MONTH)} SELECT DISTINCT 'vlanq' AS kind, tag FROM session_vlan WHERE session_id IN (SELECT session_id FROM acc) UNION ALL SELECT DISTINCT 'mpls', tag FROM session_mpls WHERE session_id IN (SELECT session_id FROM acc)")
    merged = ["session_id", "first_second", "last_second", "status", "l7", "src_port"]
    register("session_tags", lambda t: flows.session_tags(t, MONTH), o.SESSION_TAGS)
    register("sessions_whole", lambda t: whole(t)["sessions"].drop("ether_type", "first_ns", "last_ns", "file_seq"), o.SESSIONS_WHOLE)
    register("sessions_in_files", lambda t: whole_sessions(t["session_records"], t["files"]).drop("ether_type", "first_ns", "last_ns", "file_seq"), o.SESSIONS_IN_FILES)
    register("topn_bytes_source_whole", lambda t: topn.ranking(whole(t), "bytes", "source", MONTH), o.on_whole(o.topn("bytes", "source")))
    register("topn_bytes_service_whole", lambda t: topn.ranking(whole(t), "bytes", "service", MONTH), o.on_whole(o.topn("bytes", "service")))
    register("datastreams_whole", lambda t: streams(whole(t)), o.on_whole(f"WITH {o.acc(o.MONTH)}, {o.fact('f', 'bps', o.MONTH)}, {o.MOVED} SELECT s.session_id AS sessionid, s.src_ip AS client, s.src_port AS clientport, s.dst_ip AS server, s.dst_port AS serverport, mv.up AS ip1toip2, mv.down AS ip2toip1 FROM acc s JOIN mv ON mv.session_id = s.session_id WHERE mv.up + mv.down > 0"))
    register("sessions_merged", lambda t: flows.merge_sessions(t["session_parts"]).select(*merged), o.SESSIONS_MERGED)
    raw = {"packets": "packets", "sessions": "sessions", "bps": "bps", "pps": "pps", "rtts": "rtts", "timeouts": "timeouts", "tcpsyns": "tcp_syns", "tcprsts": "tcp_rsts", "tcpmiscanomalies": "tcp_misc", "tcpretransmissions": "tcp_retransmissions", "tcpdupacks": "tcp_dupacks", "remarks": "remarks"}
    for name, table in raw.items():
        if table == "sessions":
            sql = f"WITH {o.acc(o.MONTH)} SELECT * FROM acc"
        elif table == "remarks":
            sql = o.REMARKS
        else:
            sql = f"WITH {o.acc(o.MONTH)} SELECT * FROM {table} WHERE session_id IN (SELECT session_id FROM acc) AND {'marker_second' if table == 'timeouts' else 'second'} BETWEEN {o.MONTH[0]} AND {o.MONTH[1]}"
        register(f"raw_{name}", lambda t, table=table: flows.raw(t, table, MONTH), sql)


def whole(t: Tables) -> Tables:
    """The tables with sessions from their records by file, as a store gives them."""
    t["sessions"] = whole_sessions(t["session_parts"])
    return t


def streams(t: Tables) -> DataFrame:
    return flows.data_streams(t, MONTH).select("sessionid", "client", "clientport", "server", "serverport", "ip1toip2", "ip2toip1")


def _rankings() -> None:
    for base in topn.BASES:
        for grain in topn.GRAINS:
            register(f"topn_{base}_{grain}", lambda t, base=base, grain=grain: topn.ranking(t, base, grain, MONTH), o.topn(base, grain))
    for grain in topn.GRAINS:
        register(f"topn_latencies_{grain}", lambda t, grain=grain: topn.latencies(t, grain, MONTH), o.latencies(grain))
    register("topn_bytes_source6", lambda t: topn.ranking6(t, "bytes", "src", MONTH), o.SOURCE6)
    part = Conditions(o.MONTH[0] + 17, o.MONTH[1] - 33)
    filtered = Conditions(o.MONTH[0] + 17, o.MONTH[1] - 33, ips=INSIDE, payload_protocol=6, server_ports=((443, 443),))
    for name, where, more in (("", part, ""), ("_filtered", filtered, "AND (src_ip & 4294967232) = 167772160 AND payload_protocol = 6 AND dst_port = 443")):
        for base in ("bytes", "packets"):
            register(f"topn_{base}_with_rollup{name}", lambda t, base=base, where=where: rollup.ranking_with_rollup(t, rollup.per_minute(t, base, "service", MONTH), base, where), o.service_pairs(base, (part.second_from, part.second_to), 100, more))
    register("topn_protocols", lambda t: topn.protocol_split(t, "bytes", MONTH), o.protocol_split())


def _flows() -> None:
    register("datastreams", lambda t: flows.data_streams(t, MONTH), o.streams(o.MONTH))
    register("datastreams_page", lambda t: flows.data_streams_page(flows.data_streams(t, MONTH), 10, 20), f"SELECT * FROM ({o.streams(o.MONTH)}) ORDER BY start, sessionid LIMIT 20 OFFSET 10")
    register("datastreams_summary", lambda t: flows.data_streams_summary(flows.data_streams(t, MONTH)), o.streams_summary(o.MONTH))
    register("datastreams_regex", lambda t: flows.data_streams_matching(flows.data_streams(t, MONTH), t["http_remarks"], "status|POST /|404"), f"SELECT * FROM ({o.streams(o.MONTH)}) WHERE sessionid IN (SELECT session_id FROM (SELECT session_id, string_agg(content, '' ORDER BY file_seq) AS t FROM http_remarks GROUP BY 1) WHERE regexp_matches(t, 'status|POST /|404'))")
    register("payload_parts", lambda t: texts.payload_parts(t["payloads"], 4096).withColumn("payload", F.hex("payload")), o.PAYLOAD_PARTS)
    register("payload_heads", lambda t: texts.payload_heads(t["payloads"]), o.PAYLOAD_HEADS)
    register("services_clients", lambda t: flows.services_clients(t, MONTH), o.CLIENTS)
    register("services", lambda t: flows.services(flows.services_clients(t, MONTH)), o.SERVICES)
    register("macsperip", lambda t: flows.macs_per_ip(t, MONTH), o.MACS)
    for by in ("source", "destination", "iptoservice"):
        register(f"overview_{by}", lambda t, by=by: flows.overview(t, MONTH, by), o.overview(by))
    register("overview_summary", lambda t: flows.overview_summary(flows.overview(t, MONTH, "source"), MONTH), o.OVERVIEW_SUMMARY)
    register("lowhop_records", lambda t: flows.low_hop_records(t, MONTH, 20), o.low_hop(o.MONTH))
    register("lowhop_persecond", lambda t: flows.low_hop_per_second(flows.low_hop_records(t, DAY, 20), DAY), o.LOW_HOP_SECONDS)
    register("lowhop_ranking", lambda t: flows.low_hop_ranking(flows.low_hop_records(t, MONTH, 20)), o.LOW_HOP_RANKING)
    register("icmpwalk_summary", lambda t: flows.icmp_summary(t, MONTH), o.ICMP)
    register("icmpwalk_detail", lambda t: flows.icmp_detail(t, MONTH, 3, 3), o.ICMP_DETAIL)
    register("icmp6walk_summary", lambda t: flows.icmp_summary(t, MONTH, 6), o.ICMP6)
    register("icmp6walk_detail", lambda t: flows.icmp_detail(t, MONTH, 1, 1, 6), o.ICMP6_DETAIL)
    register("microburst", lambda t: flows.microburst(t, MONTH, "ms", 8000), o.BURSTS)
    register("microburst_detail", lambda t: flows.microburst_detail(t, MONTH, "ms", 8000), o.BURST_DETAIL)
    register("packet_hash", lambda t: flows.packet_hash(t, MONTH), o.PACKET_HASH)

    def loss(t: Tables) -> DataFrame:
        near = flows.packet_hash(t, MONTH)
        far = near.where("idx % 5 <> 0").withColumn("timestamp", F.col("timestamp") + F.when(F.col("idx") % 3 == 0, 5000).otherwise(-2000))
        return flows.packet_loss_latency(near, far)

    register("packet_loss_latency", loss, o.LOSS)
    register("packet_report", lambda t: flows.packet_report(loss(t)), f"SELECT session_id AS sessionid, small_to_big AS direction, CAST(coalesce(SUM(CASE WHEN status <> 'LOST' THEN latency END) // nullif(COUNT(CASE WHEN status <> 'LOST' THEN 1 END), 0), 0) AS BIGINT) AS latency, COUNT(CASE WHEN status = 'LOST' THEN 1 END) AS lost FROM ({o.LOSS}) GROUP BY 1, 2 ORDER BY latency DESC, sessionid, direction LIMIT 100")
    register("jitter", lambda t: flows.jitter(t, MONTH), o.JITTER)
    register("sessionaudit", lambda t: flows.session_audit(t, MONTH), o.AUDIT)
    register("sessionaudit_index", lambda t: flows.session_audit_index(t, MONTH), o.AUDIT_INDEX)


_series()
_filters()
_rankings()
_flows()
for _name, _build, _text in [*catalog_apps.entries(), *catalog_stored.entries()]:
    register(_name, _build, _text)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


__all__ = ["oracle_sql", "queries", "register"]
