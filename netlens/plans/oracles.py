"""The catalogue's queries as plain DuckDB SQL over the general-purpose tables, written apart from the operators."""

from __future__ import annotations

from netlens.sources.fixtures import duckdb_with

DAY = (1704153600, 1704239999)
MONTH = (1704067200, 1706745599)
NOW = 1704160800


def acc(window: tuple[int, int], more: str = "") -> str:
    return f"acc AS (SELECT * FROM sessions WHERE last_second >= {window[0]} AND first_second <= {window[1]} {more})"


def fact(name: str, table: str, window: tuple[int, int], time: str = "second") -> str:
    """Facts of accepted sessions in time, with the session's columns under s_ names."""
    cols = "s.src_ip, s.dst_ip, s.src_port, s.dst_port, s.source_is_small, s.payload_protocol, s.l7"
    return f"{name} AS (SELECT f.*, {cols} FROM {table} f JOIN acc s ON f.session_id = s.session_id WHERE f.{time} BETWEEN {window[0]} AND {window[1]})"


def dense(window: tuple[int, int], ctes: str, sparse: str, columns: tuple[str, ...] = ("value",)) -> str:
    shown = ", ".join(f"CAST(coalesce(g.{c}, 0) AS BIGINT) AS {c}" for c in columns)
    return f"WITH {ctes}, g AS ({sparse}), calendar AS (SELECT unnest(range({window[0]}, {window[1] + 1})) AS timestamp) SELECT c.timestamp, {shown} FROM calendar c LEFT JOIN g ON g.timestamp = c.timestamp"


MARKERS = {
    "timeoutcounts": ("timeouts", "marker_second", "marker_second <> 0"),
    "tcprsts": ("tcp_rsts", "second", "TRUE"),
    "tcpzerowindows": ("tcp_misc", "second", "tail = 0"),
    "tcpdupacks": ("tcp_dupacks", "second", "TRUE"),
    "tcpretransmissions": ("tcp_retransmissions", "second", "TRUE"),
    "tcpportsreused": ("tcp_misc", "second", "tail = 1"),
    "tcpoutoforders": ("tcp_misc", "second", "tail = 2"),
}
CAST = "CASE WHEN (CASE WHEN source_is_small = 1 THEN dst_ip ELSE src_ip END) = 4294967295 THEN 'broadcast' WHEN (CASE WHEN source_is_small = 1 THEN dst_ip ELSE src_ip END) // 16777216 BETWEEN 224 AND 239 THEN 'multicast' ELSE 'unicast' END"


def markers(kind: str, window: tuple[int, int]) -> str:
    """CTE m: markers of a kind with session columns, a second and the direction from the client."""
    table, time, test = MARKERS[kind]
    if table == "timeouts":
        return f"m AS (SELECT t.session_id, t.src_ip, t.dst_ip, t.dst_port, t.payload_protocol, t.l7, t.marker_second AS second, 1 AS direction FROM timeouts t WHERE t.session_id IN (SELECT session_id FROM acc) AND {test} AND {time} BETWEEN {window[0]} AND {window[1]})"
    return f"{fact('m0', table, window)}, m AS (SELECT *, CASE WHEN small_to_big = source_is_small THEN 1 ELSE 0 END AS direction FROM m0 WHERE {test})"


def bps(window: tuple[int, int] = DAY, more: str = "") -> str:
    return dense(window, f"{acc(window, more)}, {fact('b', 'bps', window)}", "SELECT second AS timestamp, SUM(small_to_big + big_to_small) * 8 AS value FROM b GROUP BY 1")


def count_series(kind: str, window: tuple[int, int] = DAY) -> str:
    return dense(window, f"{acc(window)}, {markers(kind, window)}", "SELECT second AS timestamp, COUNT(*) AS value FROM m GROUP BY 1")


PPS_COLUMNS = ("unknown", "broadcast", "multicast", "unicast")


def pps(window: tuple[int, int] = DAY, macs: tuple[str, ...] = ()) -> str:
    sums = ", ".join(f"SUM(CASE WHEN k = '{c}' THEN n ELSE 0 END) AS {c}" for c in PPS_COLUMNS)
    rows = f"SELECT second AS timestamp, {CAST} AS k, small_to_big + big_to_small AS n FROM p"
    ctes = f"{acc(window)}, {fact('p', 'pps', window)}"
    if macs:
        listed = ", ".join(f"'{m}'" for m in macs)
        ctes += f", {fact('pk', 'packets', window)}"
        rows += f" UNION ALL SELECT second AS timestamp, {CAST} AS k, -1 AS n FROM pk WHERE src_mac IN ({listed}) OR dst_mac IN ({listed})"
    return dense(window, ctes, f"SELECT timestamp, {sums} FROM ({rows}) GROUP BY 1", PPS_COLUMNS)


RTT = "SUM(CASE WHEN small_to_big = source_is_small THEN tail ELSE 0 END) AS n0, SUM(CASE WHEN small_to_big = source_is_small THEN 1 ELSE 0 END) AS d0, SUM(CASE WHEN small_to_big <> source_is_small THEN tail ELSE 0 END) AS n1, SUM(CASE WHEN small_to_big <> source_is_small THEN 1 ELSE 0 END) AS d1"
MEAN = "(CASE WHEN d0 > 0 THEN n0 // d0 ELSE 0 END) + (CASE WHEN d1 > 0 THEN n1 // d1 ELSE 0 END)"
GOOD = "tail >= 0 AND tail < 10000000000"


def latency(window: tuple[int, int] = DAY) -> str:
    return dense(window, f"{acc(window)}, {fact('r', 'rtts', window)}", f"SELECT timestamp, {MEAN} AS value FROM (SELECT second AS timestamp, {RTT} FROM r WHERE {GOOD} GROUP BY 1)")


def flow_counts() -> str:
    return f"WITH {acc(DAY)}, calendar AS (SELECT unnest(range({DAY[0]}, {DAY[1] + 1})) AS timestamp), steps AS (SELECT greatest(first_second, {DAY[0]}) AS t, 1 AS n FROM acc UNION ALL SELECT least(last_second, {DAY[1]}) + 1, -1 FROM acc), d AS (SELECT t, SUM(n) AS n FROM steps GROUP BY 1) SELECT c.timestamp, CAST(SUM(coalesce(d.n, 0)) OVER (ORDER BY c.timestamp) AS BIGINT) AS value FROM calendar c LEFT JOIN d ON d.t = c.timestamp"


BPS2 = ("ingress", "egress", "local", "other")
TO_DST, TO_SRC = "(CASE WHEN source_is_small = 1 THEN small_to_big ELSE big_to_small END)", "(CASE WHEN source_is_small = 1 THEN big_to_small ELSE small_to_big END)"


def bps2(window: tuple[int, int] = DAY) -> str:
    s, d = "(src_ip & 4294967232) = 167772160", "(dst_ip & 4294967232) = 167772160"
    return dense(
        window,
        f"{acc(window)}, {fact('b', 'bps', window)}",
        f"""SELECT second AS timestamp, SUM(CASE WHEN NOT {s} AND {d} THEN {TO_DST} * 8 WHEN {s} AND NOT {d} THEN {TO_SRC} * 8 ELSE 0 END) AS ingress,
        SUM(CASE WHEN {s} AND NOT {d} THEN {TO_DST} * 8 WHEN NOT {s} AND {d} THEN {TO_SRC} * 8 ELSE 0 END) AS egress,
        SUM(CASE WHEN {s} AND {d} THEN (small_to_big + big_to_small) * 8 ELSE 0 END) AS local, SUM(CASE WHEN NOT {s} AND NOT {d} THEN (small_to_big + big_to_small) * 8 ELSE 0 END) AS other FROM b GROUP BY 1""",
        BPS2,
    )


def bpms() -> str:
    return f"WITH {acc(MONTH)}, {fact('p', 'packets', MONTH)}, busiest AS (SELECT 1704067207 AS s), g AS (SELECT ns // 1000000 AS ms, SUM(saved_length) * 8 AS value FROM p WHERE second = (SELECT s FROM busiest) GROUP BY 1) SELECT c.ms, CAST(coalesce(g.value, 0) AS BIGINT) AS value FROM (SELECT unnest(range(0, 1000)) AS ms) c LEFT JOIN g ON g.ms = c.ms"


def bins(series: str, window: tuple[int, int], width: int, column: str = "value", zeros: bool = False) -> str:
    v = column
    low = v if zeros else f"CASE WHEN {v} <> 0 THEN {v} END"
    return f"""SELECT CAST(start AS BIGINT) AS timestamp, COUNT(*) AS containers, CAST(SUM({v}) AS BIGINT) AS total, CAST(MAX({v}) AS BIGINT) AS top,
    CAST(CASE WHEN MAX({v}) > 0 THEN MIN(CASE WHEN {v} = hi THEN timestamp END) ELSE start END AS BIGINT) AS topat,
    CAST(coalesce(MIN({low}), 0) AS BIGINT) AS bottom, CAST(coalesce(MIN(CASE WHEN {v} = lo THEN timestamp END), start) AS BIGINT) AS bottomat
    FROM (SELECT *, MAX({v}) OVER (PARTITION BY start) AS hi, MIN({low}) OVER (PARTITION BY start) AS lo FROM (SELECT *, (timestamp - {window[0]}) // {width} * {width} + {window[0]} AS start FROM ({series}))) GROUP BY start"""


def min_max(series: str) -> str:
    return f"WITH z AS ({series}) SELECT CAST(coalesce((SELECT timestamp FROM z WHERE value > 0 ORDER BY value, timestamp LIMIT 1), 0) AS BIGINT) AS minimum_timestamp, CAST(coalesce((SELECT MIN(value) FROM z WHERE value > 0), 0) AS BIGINT) AS minimum_value, CAST(coalesce((SELECT timestamp FROM z WHERE value > 0 ORDER BY value DESC, timestamp LIMIT 1), 0) AS BIGINT) AS maximum_timestamp, CAST(coalesce((SELECT MAX(value) FROM z WHERE value > 0), 0) AS BIGINT) AS maximum_value"


KEYS = {
    "source": ("src_ip AS ip", ["ip"]),
    "destination": ("dst_ip AS ip, dst_port AS port", ["ip", "port"]),
    "service": ("src_ip AS ip, dst_ip AS ip2, dst_port AS port, direction, payload_protocol AS payloadprotocol", ["ip", "ip2", "port", "direction", "payloadprotocol"]),
}


def _both(name: str, source: str) -> str:
    return f"{name} AS (SELECT *, 1 AS direction, {TO_DST} AS n FROM {source} UNION ALL SELECT *, 0 AS direction, {TO_SRC} AS n FROM {source})"


def topn(base: str, grain: str, window: tuple[int, int] = MONTH, n: int = 100) -> str:
    select, own = KEYS[grain]
    keys = ", ".join(own)
    tail = f"ORDER BY value DESC, {keys} LIMIT {n}"
    if base in ("bytes", "packets"):
        table = "bps" if base == "bytes" else "pps"
        return f"WITH {acc(window)}, {fact('f', table, window)}, {_both('x', 'f')}, g AS (SELECT {keys}, MAX(l7) AS l7, CAST(SUM(n) AS BIGINT) AS value FROM (SELECT {select}, l7, n FROM x WHERE n > 0) GROUP BY {keys}) SELECT {keys}, l7, value, CAST((SELECT SUM(value) FROM g) AS BIGINT) AS value2 FROM g {tail}"
    kind = "timeoutcounts" if base == "timeouts" else base
    ctes = f"{acc(window)}, {markers(kind, window)}, g AS (SELECT {keys}, MAX(l7) AS l7, COUNT(*) AS value FROM (SELECT {select}, l7 FROM m) GROUP BY {keys})"
    if base in ("timeouts", "tcpportsreused"):
        source = "(SELECT *, 1 AS direction FROM acc UNION ALL SELECT *, 0 AS direction FROM acc)" if grain == "service" else "(SELECT *, 1 AS direction FROM acc)"
        ctes += f", o AS (SELECT {keys}, COUNT(*) AS other FROM (SELECT {select} FROM {source}) GROUP BY {keys})"
    else:
        ctes += f", {fact('f', 'pps', window)}, {_both('x', 'f')}, o AS (SELECT {keys}, SUM(n) AS other FROM (SELECT {select}, n FROM x) GROUP BY {keys})"
    base2 = "coalesce(o.other, 0)" + (" + g.value" if base == "timeouts" else "")
    on = " AND ".join(f"g.{k} = o.{k}" for k in own)
    return f"WITH {ctes} SELECT {', '.join('g.' + k for k in own)}, l7, value, CAST(CASE WHEN value > {base2} THEN {base2} + value ELSE {base2} END AS BIGINT) AS value2 FROM g LEFT JOIN o ON {on} ORDER BY value DESC, {', '.join('g.' + k for k in own)} LIMIT {n}"


def latencies(grain: str, window: tuple[int, int] = MONTH) -> str:
    select, own = KEYS[grain]
    keys = ", ".join(own)
    rows = f"r AS (SELECT *, CASE WHEN small_to_big = source_is_small THEN 1 ELSE 0 END AS direction FROM r0 WHERE {GOOD})"
    if grain == "service":
        found = f"SELECT {keys}, SUM(tail) // COUNT(*) AS value FROM (SELECT {select}, tail FROM r) GROUP BY {keys} HAVING SUM(tail) > 0"
    else:
        found = f"SELECT {keys}, {MEAN} AS value FROM (SELECT {keys}, {RTT} FROM (SELECT {select}, small_to_big, source_is_small, tail FROM r) GROUP BY {keys})"
    on = " AND ".join(f"g.{k} = o.{k}" for k in own)
    return f"WITH {acc(window)}, {fact('r0', 'rtts', window)}, {rows}, {fact('f', 'bps', window)}, {_both('x', 'f')}, g AS ({found}), o AS (SELECT {keys}, SUM(n) AS v2 FROM (SELECT {select}, n FROM x) GROUP BY {keys}) SELECT {', '.join('g.' + k for k in own)}, CAST(g.value AS BIGINT) AS value, CAST(coalesce(o.v2, 0) AS BIGINT) AS value2 FROM g LEFT JOIN o ON {on} ORDER BY g.value DESC, {', '.join('g.' + k for k in own)} LIMIT 100"


L7_CASE = "CASE l7 WHEN 1 THEN 'DNS' WHEN 2 THEN 'HTTP' WHEN 4 THEN 'SMTP' WHEN 7 THEN 'TLS' WHEN 11 THEN 'SIP' ELSE 'non-IP' END"


def protocol_split() -> str:
    return f"WITH {acc(MONTH)}, {fact('f', 'bps', MONTH)}, {_both('x', 'f')} SELECT {L7_CASE} AS protocol, CAST(SUM(n) AS BIGINT) AS value FROM x GROUP BY 1"


MOVED = f"mv AS (SELECT session_id, CAST(SUM({TO_DST}) AS BIGINT) AS up, CAST(SUM({TO_SRC}) AS BIGINT) AS down FROM f GROUP BY 1)"


def streams(window: tuple[int, int] = DAY) -> str:
    return f"""WITH {acc(window)}, {fact('f', 'bps', window)}, {MOVED}, {fact('r', 'rtts', window)}, rt AS (SELECT session_id, {MEAN} AS mean FROM (SELECT session_id, {RTT} FROM r WHERE {GOOD} GROUP BY 1)),
    gone AS (SELECT DISTINCT session_id FROM timeouts WHERE marker_second BETWEEN {window[0]} AND {window[1]})
    SELECT s.first_second AS start, s.last_second AS "end", s.src_ip AS client, s.src_port AS clientport, s.dst_ip AS server, s.dst_port AS serverport, s.payload_protocol AS payloadprotocol, s.l7 AS detectedl7, s.session_id AS sessionid,
    mv.up AS ip1toip2, mv.down AS ip2toip1, CAST(CASE WHEN gone.session_id IS NOT NULL THEN -1 ELSE coalesce(rt.mean, -1) END AS BIGINT) AS rtt
    FROM acc s JOIN mv ON mv.session_id = s.session_id LEFT JOIN rt ON rt.session_id = s.session_id LEFT JOIN gone ON gone.session_id = s.session_id WHERE mv.up + mv.down > 0"""


def streams_summary(window: tuple[int, int]) -> str:
    return f"""WITH st AS ({streams(window)}) SELECT COUNT(*) AS sessions, CAST(MIN(ip1toip2 + ip2toip1) AS BIGINT) AS bytes_min, CAST(MAX(ip1toip2 + ip2toip1) AS BIGINT) AS bytes_max, CAST(SUM(ip1toip2 + ip2toip1) // COUNT(*) AS BIGINT) AS bytes_avg,
    CAST(coalesce(MIN(CASE WHEN rtt >= 0 THEN rtt END), 0) AS BIGINT) AS rtt_min, CAST(coalesce(MAX(CASE WHEN rtt >= 0 THEN rtt END), 0) AS BIGINT) AS rtt_max, CAST(coalesce(SUM(CASE WHEN rtt >= 0 THEN rtt END) // COUNT(CASE WHEN rtt >= 0 THEN rtt END), 0) AS BIGINT) AS rtt_avg,
    CAST(SUM(CASE WHEN rtt < 0 THEN 1 ELSE 0 END) AS BIGINT) AS without_rtt FROM st"""


CLIENTS = f"WITH {acc(MONTH)} SELECT dst_ip AS serverip, dst_port AS serverport, payload_protocol AS payloadprotocol, l7 AS l7protocol, src_ip AS client, COUNT(*) AS hits FROM acc WHERE payload_protocol IN (6, 17) GROUP BY 1, 2, 3, 4, 5"
SERVICES = f"SELECT serverip, serverport, payloadprotocol, l7protocol, COUNT(*) AS clients, CAST(SUM(hits) AS BIGINT) AS totalhits FROM ({CLIENTS}) GROUP BY 1, 2, 3, 4"
MACS = f"WITH {acc(MONTH)}, {fact('p', 'packets', MONTH)} SELECT DISTINCT CASE WHEN small_to_big = source_is_small THEN src_ip ELSE dst_ip END AS ip, CASE WHEN small_to_big = source_is_small THEN src_mac ELSE dst_mac END AS mac FROM p"


def overview(by: str) -> str:
    ips = {"source": "src_ip AS ip", "destination": "dst_ip AS ip", "iptoservice": "src_ip AS ip, dst_ip AS ip2"}[by]
    names = "ip, ip2" if by == "iptoservice" else "ip"
    return f"""WITH {acc(MONTH)}, {fact('b', 'bps', MONTH)}, {fact('p', 'pps', MONTH)} SELECT payloadprotocol, port, {names}, CAST(SUM(b) AS BIGINT) AS bytes, CAST(SUM(k) AS BIGINT) AS packets FROM (
    SELECT payload_protocol AS payloadprotocol, dst_port AS port, {ips}, small_to_big + big_to_small AS b, 0 AS k FROM b WHERE payload_protocol IN (6, 17)
    UNION ALL SELECT payload_protocol, dst_port, {ips}, 0, small_to_big + big_to_small FROM p WHERE payload_protocol IN (6, 17)) GROUP BY payloadprotocol, port, {names}"""


OVERVIEW_SUMMARY = f"SELECT payloadprotocol, port, CAST(SUM(bytes) AS BIGINT) AS bytes, CAST(SUM(packets) AS BIGINT) AS packets, COUNT(DISTINCT ip) AS ips, CAST(SUM(bytes) // {MONTH[1] - MONTH[0] + 1} AS BIGINT) AS averagebps, CAST(SUM(packets) // {MONTH[1] - MONTH[0] + 1} AS BIGINT) AS averagepps FROM ({overview('source')}) GROUP BY 1, 2"


def low_hop(window: tuple[int, int]) -> str:
    out = "small_to_big = source_is_small"
    return f"WITH {acc(window)}, {fact('p', 'packets', window)} SELECT second, ns AS nanosecond, hop_limit AS hop, CASE WHEN {out} THEN src_ip ELSE dst_ip END AS source, CASE WHEN {out} THEN dst_ip ELSE src_ip END AS destination, CASE WHEN {out} THEN 1 ELSE 0 END AS fromclient FROM p WHERE hop_limit <= 20"


LOW_HOP_SECONDS = f"WITH g AS (SELECT second AS timestamp, COUNT(*) AS value FROM ({low_hop(DAY)}) GROUP BY 1), calendar AS (SELECT unnest(range({DAY[0]}, {DAY[1] + 1})) AS timestamp) SELECT c.timestamp, CAST(coalesce(g.value, 0) AS BIGINT) AS value FROM calendar c LEFT JOIN g ON g.timestamp = c.timestamp"
LOW_HOP_RANKING = f"SELECT source, destination, COUNT(*) AS hits FROM ({low_hop(MONTH)}) WHERE fromclient = 1 GROUP BY 1, 2 ORDER BY hits DESC, source, destination LIMIT 100"
ICMP = f"WITH {acc(MONTH)} SELECT type, code, s.src_ip AS ip, s.dst_ip AS ip2, COUNT(*) AS count FROM icmp_packets p JOIN acc s ON s.session_id = p.session_id WHERE second BETWEEN {MONTH[0]} AND {MONTH[1]} GROUP BY 1, 2, 3, 4"
ICMP_DETAIL = f"""WITH {acc(MONTH)}, l AS (SELECT session_id, file_seq, CAST(regexp_extract(content, '^ICMP([0-9]+)=', 1) AS BIGINT) AS idx, CAST(regexp_extract(content, '=([0-9]+) ', 1) AS INTEGER) AS proto, regexp_extract(content, ' ([0-9a-f]*)$', 1) AS raw FROM icmp_remarks)
SELECT p.second, p.ns AS nanosecond, s.src_ip AS ip, s.dst_ip AS ip2, p.type, p.code, coalesce(l.proto, 0) AS payloadprotocol, coalesce(substr(raw, 1, 8), '') AS original_ip, coalesce(substr(raw, 9, 8), '') AS original_ip2,
CASE WHEN length(raw) = 24 THEN CAST('0x' || substr(raw, 19, 2) || substr(raw, 17, 2) AS INTEGER) ELSE 0 END AS port, CASE WHEN length(raw) = 24 THEN CAST('0x' || substr(raw, 23, 2) || substr(raw, 21, 2) AS INTEGER) ELSE 0 END AS port2
FROM icmp_packets p JOIN acc s ON s.session_id = p.session_id LEFT JOIN l ON l.session_id = p.session_id AND l.file_seq = p.file_seq AND l.idx = p.idx WHERE p.second BETWEEN {MONTH[0]} AND {MONTH[1]} AND p.type = 3 AND p.code = 3"""
ICMP6 = ICMP.replace("icmp_packets", "icmp6_packets")
ICMP6_DETAIL = f"""WITH {acc(MONTH)}, l AS (SELECT session_id, file_seq, CAST(regexp_extract(content, '^ICMPV6([0-9]+)=', 1) AS BIGINT) AS idx, split_part(content, '=', 2) AS raw FROM icmp6_remarks)
SELECT p.second, p.ns AS nanosecond, s.src_ip AS ip, s.dst_ip AS ip2, p.type, p.code, CASE substr(raw, 66, 1) WHEN 'T' THEN 6 WHEN 'U' THEN 17 ELSE 0 END AS payloadprotocol, coalesce(substr(raw, 1, 32), '') AS original_ip, coalesce(substr(raw, 33, 32), '') AS original_ip2,
CASE WHEN length(raw) = 74 THEN CAST('0x' || substr(raw, 69, 2) || substr(raw, 67, 2) AS INTEGER) ELSE 0 END AS port, CASE WHEN length(raw) = 74 THEN CAST('0x' || substr(raw, 73, 2) || substr(raw, 71, 2) AS INTEGER) ELSE 0 END AS port2
FROM icmp6_packets p JOIN acc s ON s.session_id = p.session_id LEFT JOIN l ON l.session_id = p.session_id AND l.file_seq = p.file_seq AND l.idx = p.idx WHERE p.second BETWEEN {MONTH[0]} AND {MONTH[1]} AND p.type = 1 AND p.code = 1"""
BURSTS = f"WITH {acc(MONTH)}, {fact('p', 'packets', MONTH)} SELECT (second * 1000000000 + ns) // 1000000 * 1000000 AS timestamp, CAST(SUM(saved_length) AS BIGINT) AS bytes FROM p GROUP BY 1 HAVING SUM(saved_length) >= 1000"
BURST_DETAIL = f"""WITH {acc(MONTH)}, {fact('p', 'packets', MONTH)}, t AS (SELECT *, (second * 1000000000 + ns) // 1000000 * 1000000 AS timestamp FROM p), hot AS (SELECT timestamp FROM t GROUP BY 1 HAVING SUM(saved_length) >= 1000)
SELECT timestamp, src_ip AS ip, dst_ip AS ip2, dst_port AS port2, CAST(SUM(CASE WHEN small_to_big = source_is_small THEN saved_length ELSE 0 END) AS BIGINT) AS iptoip2, CAST(SUM(CASE WHEN small_to_big = source_is_small THEN 0 ELSE saved_length END) AS BIGINT) AS ip2toip FROM t WHERE timestamp IN (SELECT timestamp FROM hot) GROUP BY 1, 2, 3, 4"""
HASHED = "session_id, tcp_seq, tcp_ack, saved_length, status, small_to_big"
PACKET_HASH = f"WITH {acc(MONTH, 'AND payload_protocol = 6')}, p AS (SELECT *, second * 1000000000 + ns AS moment FROM packets WHERE session_id IN (SELECT session_id FROM acc)), n AS (SELECT *, row_number() OVER (PARTITION BY file_seq, {HASHED} ORDER BY moment, idx) AS k FROM p) SELECT file_seq, {HASHED}, moment AS timestamp, idx FROM n WHERE k = 1"
LOSS = f"""WITH near AS ({PACKET_HASH}), far AS (SELECT {HASHED}, timestamp + CASE WHEN idx % 3 = 0 THEN 5000 ELSE -2000 END AS t FROM near WHERE idx % 5 <> 0),
d AS (SELECT near.*, CASE WHEN abs(t - timestamp) <= 10000000000 THEN t - timestamp END AS d FROM near LEFT JOIN far ON {' AND '.join(f'near.{c} = far.{c}' for c in HASHED.split(', '))})
SELECT session_id, small_to_big, idx, timestamp, CASE WHEN MIN(CASE WHEN d >= 0 THEN d END) IS NOT NULL THEN 'FORWARD' WHEN MIN(CASE WHEN d < 0 THEN -d END) IS NOT NULL THEN 'REVERSE' ELSE 'LOST' END AS status,
CAST(coalesce(MIN(CASE WHEN d >= 0 THEN d END), MIN(CASE WHEN d < 0 THEN -d END), -1) AS BIGINT) AS latency FROM d GROUP BY file_seq, {HASHED}, timestamp, idx"""
JITTER = f"""WITH {acc(MONTH)}, {fact('r0', 'rtts', MONTH)}, r AS (SELECT *, CASE WHEN small_to_big = source_is_small THEN 0 ELSE 1 END AS side FROM r0 WHERE {GOOD}),
c AS (SELECT session_id, side, abs(tail - lag(tail) OVER (PARTITION BY session_id, side ORDER BY second, ns, tail)) AS v FROM r), m AS (SELECT session_id, side, SUM(v) // COUNT(v) AS mean, COUNT(v) AS n FROM c WHERE v IS NOT NULL GROUP BY 1, 2),
q AS (SELECT m.session_id, m.side, mean, n, CAST(floor(sqrt(CAST(SUM((v - mean) * (v - mean)) // n AS DOUBLE))) AS BIGINT) AS dev FROM m JOIN c ON c.session_id = m.session_id AND c.side = m.side WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4),
w AS (SELECT session_id, CAST(coalesce(MAX(CASE WHEN side = 0 THEN mean END), 0) AS BIGINT) AS jitter, coalesce(MAX(CASE WHEN side = 0 THEN dev END), 0) AS deviation, coalesce(MAX(CASE WHEN side = 0 THEN n END), 0) AS count, CAST(coalesce(MAX(CASE WHEN side = 1 THEN mean END), 0) AS BIGINT) AS jitter2, coalesce(MAX(CASE WHEN side = 1 THEN dev END), 0) AS deviation2, coalesce(MAX(CASE WHEN side = 1 THEN n END), 0) AS count2 FROM q GROUP BY 1),
{fact('f', 'pps', MONTH)}, k AS (SELECT session_id, SUM(small_to_big + big_to_small) AS n FROM f GROUP BY 1)
SELECT w.*, s.src_ip AS clientip, s.src_port AS clientport, s.dst_ip AS serverip, s.dst_port AS serverport, s.payload_protocol AS payloadprotocol, CAST(coalesce(k.n, 0) AS BIGINT) AS totalpackets FROM w JOIN acc s ON s.session_id = w.session_id LEFT JOIN k ON k.session_id = w.session_id"""


_SIDE = "CASE WHEN small_to_big = source_is_small THEN 1 ELSE 0 END AS fromclient"
AUDIT = f"""WITH {acc(MONTH)}, {fact('p0', 'packets', MONTH)}, {fact('e1', 'tcp_dupacks', MONTH)}, {fact('e2', 'tcp_retransmissions', MONTH)}, {fact('e3', 'tcp_misc', MONTH)},
p1 AS (SELECT p0.session_id, second, ns, CAST(saved_length AS BIGINT) AS value, CASE WHEN small_to_big = p0.source_is_small THEN 1 ELSE 0 END AS fromclient, CASE WHEN acc.payload_protocol <> 6 THEN NULL WHEN (p0.status & 18) = 18 THEN 'SYNACK' WHEN (p0.status & 2) <> 0 THEN 'SYN' WHEN (p0.status & 1) <> 0 THEN 'FIN' WHEN (p0.status & 4) <> 0 THEN 'RST' WHEN p0."window" = 0 THEN 'ZEROWINDOW' END AS event,
  acc.payload_protocol = 6 AND (p0.status & 3) <> 0 AND (p0.status & 512) <> 0 AS closed FROM p0 JOIN acc ON acc.session_id = p0.session_id),
ev AS (SELECT session_id, second, ns AS nanosecond, value, fromclient, event FROM p1 WHERE event IS NOT NULL UNION ALL SELECT session_id, second, ns, value, fromclient, 'ZEROWINDOW' FROM p1 WHERE closed
  UNION ALL SELECT session_id, second, ns, 0, {_SIDE}, 'DUPACK' FROM e1 UNION ALL SELECT session_id, second, ns, 0, {_SIDE}, 'RETRANSMISSION' FROM e2 UNION ALL SELECT session_id, second, ns, 0, {_SIDE}, 'OUTOFORDER' FROM e3 WHERE tail = 2
  UNION ALL SELECT session_id, marker_second, marker_ns, 0, -1, 'TIMEOUT' FROM timeouts WHERE marker_second BETWEEN {MONTH[0]} AND {MONTH[1]} AND session_id IN (SELECT session_id FROM acc)),
g AS (SELECT p1.*, (SELECT COUNT(*) FROM ev WHERE ev.session_id = p1.session_id AND (ev.second < p1.second OR (ev.second = p1.second AND ev.nanosecond <= p1.ns))) AS gap FROM p1 WHERE event IS NULL)
SELECT session_id, second, nanosecond, CAST(value AS BIGINT) AS value, fromclient, event FROM ev
UNION ALL SELECT session_id, MIN(second * 1000000000 + ns) // 1000000000, MIN(second * 1000000000 + ns) % 1000000000, CAST(SUM(value) AS BIGINT), fromclient, 'Transmit' FROM g GROUP BY session_id, gap, fromclient HAVING SUM(value) > 0"""
AUDIT_INDEX = f"WITH {acc(MONTH)} SELECT session_id AS sessionid, src_ip AS ip, dst_ip AS ip2, src_port AS port, dst_port AS port2, payload_protocol AS payloadprotocol FROM acc"
SESSIONS_MERGED = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY file_seq) AS k, CASE WHEN (status & 2) <> 0 THEN file_seq END AS synfile, CASE WHEN l7 <> 0 THEN file_seq END AS l7file FROM session_parts),
b AS (SELECT session_id, MIN(first_second) AS first_second, MAX(last_second) AS last_second, CAST(bit_or(status) AS INTEGER) AS status, coalesce(max_by(l7, l7file), 0) AS l7, coalesce(max_by(src_port, synfile), min_by(src_port, k)) AS src_port FROM o GROUP BY 1)
SELECT session_id, first_second, last_second, status, CAST(l7 AS INTEGER) AS l7, src_port FROM b"""

_END = ("src_ip", "dst_ip", "src_port", "dst_port", "source_is_small")
#: Records merged by session, then turned where the source, and not the destination, is a service that another session shows.
WHOLE = f"""parts AS (SELECT *, CASE WHEN (status & 2) <> 0 THEN file_seq END AS synfile, CASE WHEN l7 <> 0 THEN file_seq END AS l7file FROM session_parts),
merged AS (SELECT session_id, {', '.join(f'coalesce(max_by({c}, synfile), min_by({c}, file_seq)) AS {c}' for c in _END)}, MIN(payload_protocol) AS payload_protocol, MIN(first_second) AS first_second, MAX(last_second) AS last_second, CAST(coalesce(max_by(l7, l7file), 0) AS INTEGER) AS l7, CAST(bit_or(status) AS INTEGER) AS status FROM parts GROUP BY 1),
known AS (SELECT DISTINCT dst_ip AS ip, dst_port AS port FROM merged WHERE payload_protocol = 6 AND (status & 2) <> 0),
judged AS (SELECT *, ((status & 2) = 0 OR l7 = 0) AND (src_ip, src_port) IN (SELECT (ip, port) FROM known) AND (dst_ip, dst_port) NOT IN (SELECT (ip, port) FROM known) AS turned FROM merged),
whole_sessions AS (SELECT session_id, CASE WHEN turned THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN turned THEN src_ip ELSE dst_ip END AS dst_ip, CASE WHEN turned THEN dst_port ELSE src_port END AS src_port, CASE WHEN turned THEN src_port ELSE dst_port END AS dst_port,
CASE WHEN turned THEN 1 - source_is_small ELSE source_is_small END AS source_is_small, payload_protocol, first_second, last_second, l7, status FROM judged)"""
SESSIONS_WHOLE = f"WITH {WHOLE} SELECT * FROM whole_sessions"


IN_FILES = "kept_records AS (SELECT r.* FROM session_records r LEFT JOIN files f ON f.file_seq = r.file_seq WHERE f.file_seq IS NULL OR NOT (r.first_second > f.second_to OR r.last_second < f.second_from))"
SESSIONS_IN_FILES = f"WITH {IN_FILES}, {WHOLE.replace('session_parts', 'kept_records')} SELECT * FROM whole_sessions"
#: Payload in parts of 4,096 bytes, as hex digits.
PAYLOAD_PARTS = """WITH w AS (SELECT session_id, small_to_big, string_agg(hex(payload), '' ORDER BY second, ns, idx, hex(payload)) AS t FROM payloads WHERE payload IS NOT NULL GROUP BY 1, 2)
SELECT session_id, small_to_big, k AS part, substr(t, k * 8192 + 1, 8192) AS payload FROM w, unnest(range(0, CAST(greatest(1, (length(t) + 8191) // 8192) AS BIGINT))) AS u(k)"""
PAYLOAD_HEADS = "SELECT session_id, small_to_big, substr(string_agg(hex(payload), '' ORDER BY second, ns, idx, hex(payload)), 1, 200) AS payloadhead FROM payloads WHERE payload IS NOT NULL GROUP BY 1, 2"


def on_whole(sql: str) -> str:
    """A query over the merged and turned sessions."""
    text = sql.replace("FROM sessions ", "FROM whole_sessions ")
    assert text.startswith("WITH ") and text != sql
    return f"WITH {WHOLE}, {text[5:]}"


SIX = ("20010db8000000000000000000000000", "20010db80000000000000000000000ff")
IN_SIX = f"AND session_id IN (SELECT session_id FROM session_ip6 WHERE src_ip6 BETWEEN '{SIX[0]}' AND '{SIX[1]}' OR dst_ip6 BETWEEN '{SIX[0]}' AND '{SIX[1]}')"
SOURCE6 = f"WITH {acc(MONTH)}, {fact('f', 'bps', MONTH)} SELECT src_ip6 AS ip6, CAST(SUM(small_to_big + big_to_small) AS BIGINT) AS value FROM f JOIN session_ip6 x ON x.session_id = f.session_id GROUP BY 1 HAVING SUM(small_to_big + big_to_small) > 0 ORDER BY value DESC, ip6 LIMIT 100"
APPS = "AND (src_ip IN (167772165, 167772166, 3232235780) OR dst_ip IN (167772165, 167772166, 3232235780))"
APPS6 = "AND session_id IN (SELECT session_id FROM session_ip6 WHERE dst_ip6 = '20010db8ffff00000000000000000053')"
SESSION_TAGS = f"WITH {acc(MONTH)} SELECT session_id, 'vlanq' AS kind, tag FROM session_vlan WHERE session_id IN (SELECT session_id FROM acc) UNION ALL SELECT session_id, 'mpls', tag FROM session_mpls WHERE session_id IN (SELECT session_id FROM acc)"
_REMARKS = {"HTTP": ("http_remarks", "content"), "DNS": ("dns_remarks", "content"), "TLS": ("tls_remarks", "content"), "SMTP": ("mail_remarks", "smtp"), "POP3": ("mail_remarks", "pop3"), "IMAP": ("mail_remarks", "imap"), "FTP": ("mail_remarks", "ftp"), "ICMP": ("icmp_remarks", "content"), "ICMPv6": ("icmp6_remarks", "content"), "SIP": ("sip_remarks", "body")}
REMARKS = f"WITH {acc(MONTH)}, al AS (" + " UNION ALL ".join(f"SELECT '{k}' AS protocol, session_id, file_seq, {c} AS content FROM {t}" for k, (t, c) in _REMARKS.items()) + ") SELECT * FROM al WHERE content <> '' AND session_id IN (SELECT session_id FROM acc)"


def service_pairs(base: str, window: tuple[int, int], n: int, more: str = "") -> str:
    """Pairs of client and service by value, plain; ``more`` narrows the facts by session columns."""
    select, own = KEYS["service"]
    keys = ", ".join(own)
    return f"WITH {acc(window)}, {fact('f', 'bps' if base == 'bytes' else 'pps', window)}, {_both('x', 'f')} SELECT {keys}, CAST(SUM(n) AS BIGINT) AS value FROM (SELECT {select}, n FROM x WHERE n > 0 {more}) GROUP BY {keys} ORDER BY value DESC, {keys} LIMIT {n}"
