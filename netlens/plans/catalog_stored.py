"""Catalogue entries that answer from stored rollups, over ranges that do not end on minutes.

A rollup of a table folder is built once in an application, over the whole month, when the first entry asks for it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.operators import rewriting, topn
from netlens.operators.series import bins as binned
from netlens.plans import oracles as o
from netlens.plans import oracles_apps as a
from netlens.plans.conditions import Conditions, Network
from netlens.sources.rollups import RollupStore, store_of
from netlens.sources.tables import Tables

PART = (o.MONTH[0] + 17, o.MONTH[1] - 33)
DAY_PART = (o.DAY[0] + 17, o.DAY[1] - 33)
INSIDE = Network(167772160, 0xFFFFFFC0)
NETWORK6 = Network.parse("2001:db8::/120")

#: Filters with the same condition in SQL on sessions.
FILTERS = {
    "ips": (dict(ips=(INSIDE,)), "AND ((src_ip & 4294967232) = 167772160 OR (dst_ip & 4294967232) = 167772160)"),
    "ips_internal": (dict(ips=(Network(167772160, 0xFF000000), Network(3232235776, 0xFFFFFFFE)), include_external=False), "AND (src_ip // 16777216 = 10 OR (src_ip & 4294967294) = 3232235776) AND (dst_ip // 16777216 = 10 OR (dst_ip & 4294967294) = 3232235776)"),
    "ips6": (dict(ips=(NETWORK6,)), o.IN_SIX),
    "protocol": (dict(payload_protocol=17), "AND payload_protocol = 17"),
    "l7": (dict(l7=2), "AND l7 = 2"),
    "server_ports": (dict(server_ports=((20, 60), (443, 443))), "AND (dst_port BETWEEN 20 AND 60 OR dst_port = 443)"),
    "tag": (dict(tags=("*office",)), "AND (src_ip IN (167772161, 167772162) OR dst_ip IN (167772161, 167772162))"),
    "tag_internal": (dict(tags=("*office", "web"), include_external=False), "AND src_ip IN (167772161, 167772162, 3232235776, 3232235777) AND dst_ip IN (167772161, 167772162, 3232235776, 3232235777)"),
    "app": (dict(apps=("intranet", "wiki")), o.APPS),
    "app6": (dict(apps=("six",)), o.APPS6),
    "excluded": (dict(excluded=((167772161, None), (3232235776, 167772162))), "AND src_ip <> 167772161 AND dst_ip <> 167772161 AND NOT (least(src_ip, dst_ip) = 167772162 AND greatest(src_ip, dst_ip) = 3232235776)"),
    # no stored key has these: answered from facts
    "vlan": (dict(vlans=(2, 3)), "AND session_id IN (SELECT session_id FROM session_vlan WHERE tag IN (2, 3))"),
    "mpls": (dict(mpls=(17,)), "AND session_id IN (SELECT session_id FROM session_mpls WHERE tag = 17)"),
    "ports": (dict(ports=((443, 443), (20, 60))), "AND (src_port = 443 OR dst_port = 443 OR src_port BETWEEN 20 AND 60 OR dst_port BETWEEN 20 AND 60)"),
}


def stored(tables: Tables) -> RollupStore:
    """The rollups of the month of a table folder."""
    return store_of(tables.spark, tables.origin, lambda store, name: rewriting.build(store, tables, o.MONTH[0], o.MONTH[1] + 1, (name,)))


def _within(sql: str, window: tuple[int, int], before: tuple[int, int] = o.MONTH) -> str:
    """SQL text of another range."""
    for old, new in ((before[0], window[0]), (before[1], window[1]), (before[1] + 1, window[1] + 1)):
        sql = sql.replace(str(old), str(new))
    return sql


def _filtered(sql: str, window: tuple[int, int], more: str) -> str:
    return sql.replace(o.acc(window), o.acc(window, more))


def _series6(column: str) -> str:
    return _within(o.SOURCE6, PART).replace("src_ip6 AS ip6", f"{column} AS ip6")


def _every_grain() -> str:
    """All metrics of the pair rollups by grouping sets over all measured rows."""
    month = o.MONTH
    timed = "src_ip AS ip, dst_ip AS ip2, dst_port AS port, direction, payload_protocol AS payloadprotocol, l7, session_id"
    parts = [f"SELECT second // 60 * 60 AS minute, '{m}' AS metric, {timed}, n, 0 AS d FROM {m}_x WHERE n > 0" for m in ("bytes", "packets")]
    parts.append(f"SELECT second // 60 * 60, 'latencies', src_ip, dst_ip, dst_port, CASE WHEN small_to_big = source_is_small THEN 1 ELSE 0 END, payload_protocol, l7, session_id, tail, 1 FROM r WHERE {o.GOOD}")
    ctes = [o.acc(month), o.fact("bf", "bps", month), o.fact("pf", "pps", month), o._both("bytes_x", "bf"), o._both("packets_x", "pf"), o.fact("r", "rtts", month)]
    for base in topn.BASES[2:]:
        kind = "timeoutcounts" if base == "timeouts" else base
        own = o.markers(kind, month).replace("m0", f"{base}_m0").replace("m AS (", f"{base}_m AS (")
        ctes.append(own)
        parts.append(f"SELECT second // 60 * 60, '{base}', {timed}, 1, 0 FROM {base}_m")
    keys = "ip, ip2, port, direction, payloadprotocol, l7, ip6, ip62"
    sums = "CAST(SUM(n) AS BIGINT) AS value, CAST(SUM(d) AS BIGINT) AS d"
    ctes.append(f"z AS ({' UNION ALL '.join(parts)}), zz AS (SELECT z.*, src_ip6 AS ip6, dst_ip6 AS ip62 FROM z LEFT JOIN session_ip6 x ON x.session_id = z.session_id)")
    null = lambda *names: ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in names)
    rest = (("payloadprotocol", "INTEGER"), ("l7", "INTEGER"), ("ip6", "VARCHAR"), ("ip62", "VARCHAR"))
    return f"""WITH {', '.join(ctes)}
SELECT minute, 'service' AS grain, metric, {keys}, {sums} FROM zz GROUP BY minute, metric, {keys}
UNION ALL SELECT minute, 'source', metric, ip, {null(('ip2', 'BIGINT'), ('port', 'INTEGER'))}, direction, {null(*rest)}, {sums} FROM zz GROUP BY minute, metric, ip, direction
UNION ALL SELECT minute, 'destination', metric, {null(('ip', 'BIGINT'))}, ip2, port, direction, {null(*rest)}, {sums} FROM zz GROUP BY minute, metric, ip2, port, direction"""


def entries() -> list[tuple]:
    out: list[tuple] = []

    def series(name: str, metric: str, sql: str, more: str = "", **asked) -> None:
        where = Conditions(*DAY_PART, **asked)
        out.append((name, lambda t: rewriting.per_second(stored(t), t, metric, where), _filtered(sql, DAY_PART, more)))

    series("stored_bps", "bps", o.bps(DAY_PART))
    series("stored_pps", "pps", o.pps(DAY_PART))
    series("stored_averagelatency", "averagelatency", o.latency(DAY_PART))
    series("stored_flowcounts", "flowcounts", _within(o.flow_counts(), DAY_PART, o.DAY))
    for kind in ("timeoutcounts", "tcprsts", "tcpportsreused"):
        series(f"stored_{kind}", kind, o.count_series(kind, DAY_PART))
    for name in ("l7", "tag", "app6", "ips6"):
        series(f"stored_bps_{name}", "bps", o.bps(DAY_PART), FILTERS[name][1], **FILTERS[name][0])
    series("stored_pps_tag", "pps", o.pps(DAY_PART), FILTERS["tag"][1], **FILTERS["tag"][0])
    series("stored_flowcounts_tag", "flowcounts", _within(o.flow_counts(), DAY_PART, o.DAY), FILTERS["tag"][1], **FILTERS["tag"][0])
    series("stored_averagelatency_tag", "averagelatency", o.latency(DAY_PART), FILTERS["tag"][1], **FILTERS["tag"][0])

    part = Conditions(*PART)
    for metric, sql in (("bps", o.bps(PART)), ("averagelatency", o.latency(PART)), ("flowcounts", _within(o.flow_counts(), PART, o.DAY)), ("timeoutcounts", o.count_series("timeoutcounts", PART))):
        out.append((f"stored_{metric}_bins", lambda t, metric=metric: binned(rewriting.per_second(stored(t), t, metric, part), part, 3600), o.bins(sql, PART, 3600)))

    def ranking(base: str, grain: str, name: str = "") -> None:
        asked, more = FILTERS[name] if name else ({}, "")
        where = Conditions(*PART, **asked)
        tail = f"_{name}" if name else ""
        if base == "latencies":
            out.append((f"stored_topn_latencies_{grain}{tail}", lambda t: rewriting.Rewriter(stored(t), t).latencies(grain, where), _filtered(o.latencies(grain, PART), PART, more)))
        else:
            out.append((f"stored_topn_{base}_{grain}{tail}", lambda t: rewriting.Rewriter(stored(t), t).ranking(base, grain, where), _filtered(o.topn(base, grain, PART), PART, more)))

    for grain in topn.GRAINS:
        for base in ("bytes", "latencies"):
            ranking(base, grain)
    for base, grain in (("packets", "source"), ("timeouts", "service"), ("tcprsts", "source"), ("tcpdupacks", "destination"), ("tcpzerowindows", "service"), ("tcpretransmissions", "service"), ("tcpportsreused", "destination"), ("tcpoutoforders", "source")):
        ranking(base, grain)
    for name in FILTERS:
        ranking("bytes", "service", name)
    for base, grain, name in (("bytes", "source", "l7"), ("packets", "destination", "app6"), ("latencies", "service", "l7"), ("latencies", "source", "tag"), ("tcprsts", "service", "ips6")):
        ranking(base, grain, name)

    out.append(("stored_bytes_source6", lambda t: rewriting.ranking6(stored(t), t, "bytes", "src", Conditions(*PART)), _series6("src_ip6")))
    out.append(("stored_packets_destination6", lambda t: rewriting.ranking6(stored(t), t, "packets", "dst", Conditions(*PART)), _series6("dst_ip6").replace(o.fact("f", "bps", PART), o.fact("f", "pps", PART))))
    hits = "SELECT server, status, COUNT(*) AS hits FROM dn GROUP BY 1, 2"
    out.append(("stored_dns", lambda t: rewriting.dns(stored(t), t, Conditions(*PART), ["server", "status"]), f"WITH {_within(a.DNS, PART)} {hits}"))
    out.append(("stored_icmp", lambda t: rewriting.icmp(stored(t), t, Conditions(*PART)), _within(o.ICMP, PART)))
    http = _within(a.TOPN_HTTP, PART).replace("WHERE status >= 400", f"WHERE status >= 400 AND requestat // 1000000000 BETWEEN {PART[0]} AND {PART[1]}")
    out.append(("stored_httperrors", lambda t: rewriting.http_errors(stored(t), t, Conditions(*PART)), http))
    whole = Conditions(*o.MONTH)
    out.append(("rollup_grains", lambda t: rewriting.pairs(t, whole), _every_grain()))
    levels = f"SELECT minute, value AS level FROM (SELECT timestamp + 1 AS minute, value FROM ({_within(o.flow_counts(), o.MONTH, o.DAY)})) WHERE minute % 60 = 0 AND value <> 0 AND minute <= {o.MONTH[1]}"
    out.append(("rollup_flows", lambda t: rewriting.flow_levels(t["sessions"], o.MONTH[0], o.MONTH[1] + 1).where("level <> 0").select("minute", F.col("level")), levels))
    return out


__all__ = ["FILTERS", "entries", "stored"]
