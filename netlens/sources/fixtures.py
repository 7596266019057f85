"""The logical tables derived from general-purpose tables (events, pages, orders, conversations), as engine-neutral SQL.

The same text runs in Spark and in DuckDB after three substitutions: integer division, microseconds of a timestamp, and
the name of a source.  Operators never see these statements; they work on :class:`netlens.sources.tables.Tables`.
"""

from __future__ import annotations

START = 1704067200  # 2024-01-01T00:00:00Z

_TYPE = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"

#: name -> SELECT over source tables and tables above it
STATEMENTS: dict[str, str] = {
    "e": f"""
SELECT event_id, user_id, sec, us, tc, bytes, value, user_id * 100 + tc * 10 + ((sec - {START}) DIV 604800) AS session_id
FROM (SELECT event_id, user_id, USEC(ts) DIV 1000000 AS sec, USEC(ts) % 1000000 AS us, CAST({_TYPE} AS BIGINT) AS tc,
             CAST(ROUND(value * 100) AS BIGINT) AS bytes, value FROM events) AS x""",
    "sessions": """
SELECT session_id, CAST(167772160 + min(user_id) % 65536 AS BIGINT) AS src_ip,
       CAST(CASE WHEN min(tc) = 4 THEN 151587081 ELSE 3232235776 + min(tc) END AS BIGINT) AS dst_ip,
       CAST(1024 + session_id % 60000 AS INT) AS src_port,
       CAST(CASE min(tc) WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 25 ELSE 5060 END AS INT) AS dst_port,
       CAST(2048 AS INT) AS ether_type, CAST(CASE WHEN min(tc) = 4 THEN 0 ELSE 1 END AS INT) AS source_is_small,
       CAST(CASE WHEN min(tc) IN (2, 4) THEN 17 ELSE 6 END AS INT) AS payload_protocol,
       min(sec) AS first_second, CAST(0 AS BIGINT) AS first_ns, max(sec) AS last_second, CAST(0 AS BIGINT) AS last_ns,
       CAST(CASE min(tc) WHEN 0 THEN 7 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 ELSE 11 END AS INT) AS l7,
       CAST(CASE WHEN min(tc) IN (2, 4) THEN 0 ELSE 2 END AS INT) AS status, CAST(0 AS BIGINT) AS file_seq
FROM e GROUP BY session_id""",
    # one record for each day that a session spans; the start flag and the detected protocol stand in some of them only, and
    # some without the start flag have source and destination the wrong way round
    "session_parts": f"""
SELECT session_id, CASE WHEN turned = 1 THEN server ELSE client END AS src_ip, CASE WHEN turned = 1 THEN client ELSE server END AS dst_ip,
       CASE WHEN turned = 1 THEN server_port ELSE client_port END AS src_port, CASE WHEN turned = 1 THEN client_port ELSE server_port END AS dst_port,
       ether_type, CAST(CASE WHEN turned = 1 THEN 1 - small ELSE small END AS INT) AS source_is_small, payload_protocol, first_second, first_ns, last_second, last_ns, l7, status, file_seq
FROM (SELECT session_id, CAST(167772160 + min(user_id) % 65536 AS BIGINT) AS client,
       CAST(CASE WHEN min(tc) = 4 THEN 151587081 ELSE 3232235776 + min(tc) END AS BIGINT) AS server,
       CAST(1024 + (session_id + (CASE WHEN min(event_id) % 2 = 0 THEN 0 ELSE 7 END)) % 60000 AS INT) AS client_port,
       CAST(CASE min(tc) WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 25 ELSE 5060 END AS INT) AS server_port,
       CAST(2048 AS INT) AS ether_type, CAST(CASE WHEN min(tc) = 4 THEN 0 ELSE 1 END AS INT) AS small,
       CAST(CASE WHEN min(tc) IN (2, 4) THEN 17 ELSE 6 END AS INT) AS payload_protocol, CASE WHEN min(event_id) % 10 = 3 THEN 1 ELSE 0 END AS turned,
       min(sec) AS first_second, CAST(0 AS BIGINT) AS first_ns, max(sec) AS last_second, CAST(0 AS BIGINT) AS last_ns,
       CAST(CASE WHEN min(event_id) % 3 = 0 THEN 0 ELSE 7 - min(tc) END AS INT) AS l7,
       CAST(CASE WHEN min(tc) IN (2, 4) THEN 0 WHEN min(event_id) % 2 = 0 THEN 2 ELSE 16 END AS INT) AS status,
       (sec - {START}) DIV 86400 AS file_seq
FROM e GROUP BY session_id, (sec - {START}) DIV 86400) AS parts""",
    # the days of the records, and records of which some were noted by a clock that was two days off
    "files": f"""
SELECT file_seq, {START} + file_seq * 86400 AS second_from, {START} + file_seq * 86400 + 86399 AS second_to FROM session_parts GROUP BY file_seq""",
    "session_records": """
SELECT session_id, src_ip, dst_ip, src_port, dst_port, ether_type, source_is_small, payload_protocol, CASE WHEN session_id % 6 = 1 AND file_seq % 4 = 1 THEN first_second + 172800 ELSE first_second END AS first_second, first_ns,
       CASE WHEN session_id % 6 = 1 AND file_seq % 4 = 1 THEN last_second + 172800 ELSE last_second END AS last_second, last_ns, l7, status, file_seq
FROM session_parts""",
    "bps": """
SELECT session_id, sec AS second, CASE WHEN event_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE bytes END AS small_to_big,
       CASE WHEN event_id % 3 = 0 THEN bytes ELSE bytes DIV 2 END AS big_to_small FROM e""",
    "pps": """
SELECT session_id, second, small_to_big DIV 64 + 1 AS small_to_big, big_to_small DIV 64 + 1 AS big_to_small FROM bps""",
    "rtts": """
SELECT session_id, sec AS second, us * 1000 AS ns, CAST(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS INT) AS small_to_big,
       CASE WHEN event_id % 97 = 0 THEN CAST(-1 AS BIGINT) WHEN event_id % 101 = 0 THEN CAST(10000000000 AS BIGINT) ELSE bytes * 10000 END AS tail
FROM e WHERE event_id % 2 = 0""",
    "markers": """
SELECT CAST(event_id % 7 AS INT) AS kind, session_id, sec AS second, us * 1000 AS ns, CAST(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS INT) AS small_to_big,
       CASE WHEN event_id % 7 > 3 THEN event_id % 7 - 3 ELSE CAST(0 AS BIGINT) END AS tail
FROM e WHERE tc NOT IN (2, 4) AND event_id % 7 <> 6""",
    "tcp_rsts": "SELECT session_id, second, ns, small_to_big, tail FROM markers WHERE kind = 0",
    "tcp_dupacks": "SELECT session_id, second, ns, small_to_big, tail FROM markers WHERE kind = 1",
    "tcp_retransmissions": "SELECT session_id, second, ns, small_to_big, tail FROM markers WHERE kind = 2",
    "tcp_misc": "SELECT session_id, second, ns, small_to_big, tail FROM markers WHERE kind >= 3",
    "tcp_syns": """
SELECT session_id, sec AS second, us * 1000 AS ns, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS small_to_big, CAST(event_id % 2 AS BIGINT) AS tail
FROM e WHERE tc NOT IN (2, 4) AND event_id % 5 = 0""",
    "timeouts": """
SELECT s.*, e.sec + 72 AS marker_second, e.us * 1000 AS marker_ns FROM e JOIN sessions s ON e.session_id = s.session_id WHERE e.tc = 4 AND e.value > 100""",
    "packets": f"""
SELECT (sec - {START}) DIV 86400 AS file_seq, event_id AS idx, session_id, sec AS second, us * 1000 AS ns, 64 + bytes % 1400 AS saved_length, bytes % 1400 AS payload_size,
       CAST(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS INT) AS small_to_big,
       concat('02000000', lpad(CAST(1000 + user_id % 50 AS VARCHAR(10)), 4, '0')) AS src_mac, concat('0200000100', lpad(CAST(tc AS VARCHAR(10)), 2, '0')) AS dst_mac,
       CAST(event_id % 3 AS INT) AS vlan, CAST(event_id % 255 AS INT) AS hop_limit, event_id % 12 AS tcp_seq, event_id % 4 AS tcp_ack, event_id % 500 AS window, CAST(event_id % 16 AS INT) AS status
FROM e""",
    "session_vlan": "SELECT session_id, CAST(1 + session_id % 5 AS INT) AS tag FROM sessions WHERE session_id % 3 <> 0",
    "session_mpls": "SELECT session_id, CAST(16 + session_id % 4 AS INT) AS tag FROM sessions WHERE session_id % 4 = 1",
    "session_ip6": """
SELECT session_id, concat('20010db8', lpad(CAST(session_id % 1000 AS VARCHAR(10)), 24, '0')) AS src_ip6, concat('20010db8ffff', lpad(CAST(dst_port AS VARCHAR(10)), 20, '0')) AS dst_ip6
FROM sessions WHERE session_id % 5 = 2""",
    "icmp_packets": "SELECT file_seq, idx, session_id, second, ns, tcp_seq AS type, tcp_ack AS code FROM packets WHERE session_id % 4 = 0",
    "icmp_remarks": """
SELECT session_id, file_seq, concat('ICMP', CAST(idx AS VARCHAR(20)), '=17 ', '0a0000', CASE WHEN idx % 2 = 0 THEN '01' ELSE '02' END, 'c0a80001', CASE WHEN idx % 3 = 0 THEN '0035d431' ELSE '' END) AS content
FROM icmp_packets WHERE idx % 5 <> 0""",
    "icmp6_packets": "SELECT file_seq, idx, session_id, second, ns, tcp_seq AS type, tcp_ack AS code FROM packets WHERE session_id % 4 = 1",
    "icmp6_remarks": """
SELECT session_id, file_seq, concat('ICMPV6', CAST(idx AS VARCHAR(20)), '=', lpad(CASE WHEN idx % 2 = 0 THEN '1' ELSE '2' END, 32, '0'), 'fe80', lpad('3', 28, '0'), CHR(9),
       CASE idx % 3 WHEN 0 THEN 'U0035d431' WHEN 1 THEN 'T5000d431' ELSE '' END) AS content
FROM icmp6_packets WHERE idx % 5 <> 0""",
    "web": """
SELECT page_id, (page_id % 100) * 100 + 10 AS session_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
       CASE WHEN regexp_extract(url, '^[a-z]+://[^/]+(/[^ ]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/]+(/[^ ]*)', 1) END AS path,
       CAST(1704067200 + page_id * 60 AS BIGINT) * 1000000000 + page_id AS request_at, (page_id % 7 + 1) * 1000000 AS latency,
       CASE WHEN page_id % 10 = 3 THEN '404' WHEN page_id % 10 = 7 THEN '500' ELSE '200' END AS status
FROM pages""",
    # a request and its response stand in one remark, or, for every fifth page, in two files; every 11th has no response
    "http_remarks": """
SELECT session_id, page_id * 2 AS file_seq, concat('HttpRequest=', CAST(request_at AS VARCHAR(20)), CASE WHEN page_id % 4 = 0 THEN ' POST ' ELSE ' GET ' END, path, CHR(10), 'Raw=', CHR(10), 'Host: ', host, CHR(10), 'User-Agent: ',
       CASE page_id % 5 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120' WHEN 1 THEN 'Mozilla/5.0 (Windows NT 6.1) Firefox/115' WHEN 2 THEN 'Mozilla/5.0 (Mac OS X) Safari/605' WHEN 3 THEN 'Mozilla/5.0 (Linux; Android 14)' ELSE 'curl/8' END, CHR(10),
       CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('Referer: http://site', CAST(page_id % 3 AS VARCHAR(5)), '.example/start', CHR(10)) END, 'HttpEnd=Request', CHR(10),
       CASE WHEN page_id % 5 = 4 OR page_id % 11 = 0 THEN '' ELSE concat('HttpResponse=', CAST(request_at + latency AS VARCHAR(20)), ' ', status, ' X', CHR(10), 'Raw=', CHR(10), 'Server: x', CHR(10), 'HttpEnd=Response', CHR(10)) END) AS content
FROM web
UNION ALL
SELECT session_id, page_id * 2 + 1 AS file_seq, concat('HttpResponse=', CAST(request_at + latency AS VARCHAR(20)), ' ', status, ' X', CHR(10), 'Raw=', CHR(10), 'Server: x', CHR(10), 'HttpEnd=Response', CHR(10)) AS content
FROM web WHERE page_id % 5 = 4 AND page_id % 11 <> 0""",
    "dns_remarks": """
SELECT (page_id % 100) * 100 + 20 + page_id % 4 AS session_id, page_id AS file_seq, concat('DnsQuestion=', host, ',1,1', CHR(10),
       CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('DnsException=AnswerCountZero', CHR(10)) WHEN 2 THEN concat('DnsException=ReadIndexOutOfBound', CHR(10)) WHEN 3 THEN concat('DnsException=MultipleQueries', CHR(10))
       ELSE concat('DnsAnswerRRs=', host, ',1,c0a8', lpad(CAST(1000 + page_id % 100 AS VARCHAR(10)), 4, '0'), ' ', host, ',28,20010db8000000000000000000000001', CHR(10)) END) AS content
FROM web""",
    "mail_remarks": """
SELECT conv_id * 100 + 30 + conv_id % 4 AS session_id, turn AS file_seq,
       concat('SmtpMailFrom=user', CAST(conv_id % 7 AS VARCHAR(10)), '@example.com', CHR(10), 'SmtpRcptTo=a', CAST(turn % 5 AS VARCHAR(10)), '@example.org', CHR(10), CASE WHEN turn % 3 = 0 THEN concat('SmtpError=550 no ', CAST(turn AS VARCHAR(10)), CHR(10)) ELSE '' END) AS smtp,
       concat(CASE WHEN turn % 2 = 0 THEN concat('Pop3Err=-ERR ', CAST(turn AS VARCHAR(10)), CHR(10)) ELSE '' END, 'Pop3Ok=1', CHR(10)) AS pop3,
       concat(CASE WHEN turn % 2 = 0 THEN concat('ImapNo=no ', CAST(turn AS VARCHAR(10)), CHR(10)) ELSE '' END, CASE WHEN turn % 3 = 1 THEN concat('ImapBad=bad', CHR(10)) ELSE '' END, CASE WHEN turn % 4 = 3 THEN concat('ImapAlert=full', CHR(10)) ELSE '' END) AS imap,
       concat('FtpStor=f', CAST(turn AS VARCHAR(10)), '.txt', CHR(10), CASE WHEN turn % 2 = 1 THEN concat('FtpRetr=g', CAST(turn AS VARCHAR(10)), CHR(10)) ELSE '' END, CASE WHEN turn % 3 = 2 THEN concat('FtpDele=h', CHR(10)) ELSE '' END, CASE WHEN turn % 4 = 0 THEN concat('FtpError=530', CHR(10)) ELSE '' END) AS ftp,
       concat('TLSSNI=', CASE WHEN turn % 4 = 3 THEN 'bad_name!' ELSE concat('host', CAST(conv_id % 9 AS VARCHAR(10)), '.example.com') END, CHR(10)) AS tls
FROM conversations""",
    "tls_remarks": "SELECT conv_id * 100 + (conv_id % 4) AS session_id, turn AS file_seq, concat('TLSSNI=', CASE WHEN turn % 4 = 3 THEN 'bad_name!' ELSE concat('host', CAST(conv_id % 9 AS VARCHAR(10)), '.example.com') END, CHR(10)) AS content FROM conversations",
    "sip_remarks": """
SELECT conv_id * 100 + 40 + conv_id % 4 AS session_id, turn AS file_seq, CAST(1704067200 + conv_id * 100 + turn AS BIGINT) * 1000000000 + conv_id AS at, CAST(turn % 2 AS INT) AS direction,
       CASE turn % 4 WHEN 0 THEN 'INVITE sip:b SIP/2.0' WHEN 1 THEN 'SIP/2.0 200 OK' WHEN 2 THEN 'ACK sip:b SIP/2.0' ELSE 'BYE sip:b SIP/2.0' END AS start_line,
       concat('Call-ID: c', CAST(conv_id AS VARCHAR(10)), CHR(10), 'CSeq: ', CAST(turn DIV 2 AS VARCHAR(10)), ' INVITE', CHR(10), 'From: <sip:', CAST(conv_id % 5 AS VARCHAR(10)), '@example.com>;tag=x', CHR(10), 'To: <sip:', CAST(conv_id % 3 AS VARCHAR(10)), '@example.org>', CHR(10),
              CASE WHEN turn % 4 < 2 THEN concat('m=audio ', CAST(CASE WHEN turn % 4 = 0 THEN 1024 + (conv_id * 100 + 40 + conv_id % 4) % 60000 ELSE 5060 END AS VARCHAR(10)), ' RTP/AVP 0', CHR(10)) ELSE '' END) AS body
FROM conversations""",
    "payloads": """
SELECT conv_id * 100 AS session_id, CAST(1704067200 + turn AS BIGINT) AS second, CAST(0 AS BIGINT) AS ns, CAST(turn AS BIGINT) AS idx, CAST(CASE WHEN role = 'user' THEN 1 ELSE 0 END AS INT) AS small_to_big, text AS payload FROM conversations""",
    "probe_results": """
SELECT o_orderkey AS uploadat, concat('0200000000', lpad(CAST(10 + o_custkey % 20 AS VARCHAR(10)), 2, '0')) AS mac, USEC(o_orderdate) DIV 1000000 + o_orderkey % 86400 AS testedat, o_orderpriority AS testname,
       '10.0.0.1' AS sourceip, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE 8 END AS INT) AS result, CAST(o_orderkey % 5 AS INT) AS resultdetail,
       CAST(ROUND(o_totalprice) AS BIGINT) AS rtt, CAST(ROUND(o_totalprice) AS BIGINT) % 1000 - 3 AS bps FROM orders""",
    "paranoia": """
SELECT concat('02000000', lpad(CAST(1000 + o_custkey % 15 AS VARCHAR(10)), 4, '0')) AS mac, USEC(o_orderdate) DIV 1000000 + o_orderkey % 86400 AS testedat, concat('t', CAST(o_orderkey % 6 AS VARCHAR(5))) AS testname, 'web' AS testtemplate,
       CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS INT) AS success, concat('{"steps": ', CAST(o_orderkey % 9 AS VARCHAR(5)), ', "note": "n', CAST(o_orderkey % 3 AS VARCHAR(5)), '"}') AS details FROM orders""",
    "syslog": """
SELECT CAST(1704067200 + conv_id * 100 + turn AS BIGINT) AS receivedat, CAST(conv_id % 4 AS INT) AS facility, CAST(turn % 8 AS INT) AS priority, concat('host', CAST(conv_id % 50 AS VARCHAR(10))) AS hostname,
       concat('10.1.0.', CAST(conv_id % 50 AS VARCHAR(10))) AS hostip, concat('role ', role, ' turn ', CAST(turn AS VARCHAR(10))) AS message, concat('app', CAST(turn % 3 AS VARCHAR(5))) AS syslogtag FROM conversations""",
    "snmptrap": """
SELECT CAST(1704067200 + conv_id * 60 + turn AS BIGINT) AS timestamp, concat('10.2.0.', CAST(conv_id % 20 AS VARCHAR(10))) AS sender, concat('sw', CAST(conv_id % 20 AS VARCHAR(10))) AS hostname, CAST(turn % 6 AS INT) AS traptype,
       concat('1.3.6.', CAST(conv_id % 3 AS VARCHAR(5))) AS enterprisestring, concat('trap ', role) AS message FROM conversations""",
}

#: Small literal tables: (columns, rows).
LITERALS: dict[str, tuple[str, list[tuple]]] = {
    "cidr": (
        "set_name string, ip long, mask long, port int, alias string, ord int",
        [
            ("inside", 167772160, 4294967232, 0, "clients-a", 0),
            ("inside", 167772224, 4294967232, 0, "clients-b", 1),
            ("servers", 3232235776, 4294967295, 443, "secure-web", 2),
            ("servers", 3232235776, 4294967288, 0, "servers", 3),
        ],
    ),
    "cidr6": (
        "set_name string, ip6 string, length int, port int, alias string, ord int",
        [
            ("inside", "20010db8000000000000000000000000", 121, 0, "six-low", 0),
            ("inside", "20010db8000000000000000000000000", 118, 0, "six-mid", 1),
            ("inside", "20010db8000000000000000000000000", 32, 0, "six-all", 2),
            ("servers", "20010db8ffff00000000000000000443", 128, 443, "six-web", 3),
            ("servers", "20010db8ffff00000000000000000000", 48, 0, "six-servers", 4),
        ],
    ),
    "tag_ip": ("tag string, ip_hex string", [("*office", "0a000001"), ("*office", "0a000002"), ("*lab", "0a000003"), ("web", "c0a80100"), ("web", "c0a80101")]),
    "fqdns": ("name string, ip_hex string", [("www.example.com", "c0a80100"), ("cdn.example.com", "c0a80100"), ("mail.example.com", "c0a80103"), ("dns.example.com", "c0a80102")]),
    "user_apps": ("name string, ips string, port int", [("intranet", "0a000005,0a000006", 8080), ("wiki", "c0a80104", 443), ("six", "20010db8ffff00000000000000000053", 0)]),
    "geo": ("ip_from long, ip_to long, country string", [(167772160, 167772191, "KR"), (167772192, 167772223, "US"), (167772224, 167837695, "DE")]),
    "trigger": (
        "tag string, message string, severity int, datasource string, type string, lookback long, threshold long, delta long",
        [("all", "busy", 2, "bps", "over", 3600, 300, 0), ("all", "idle", 1, "bps", "under", 7200, 250, 0), ("all", "rising", 0, "bps", "delta", 3600, 100, 20)],
    ),
}

_SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER"}


def _literal_sql(name: str) -> str:
    columns, rows = LITERALS[name]
    kinds = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({c} AS {_SQL_TYPES[k]}) AS {c}" for c, k in kinds)
    return f"SELECT {casts} FROM (VALUES {values}) AS v({', '.join(c for c, _ in kinds)})"


def duckdb_with(body: str) -> str:
    """``body`` behind the common table expressions of all derived tables, in DuckDB's dialect."""
    parts = [f"{name} AS MATERIALIZED ({_literal_sql(name)})" for name in LITERALS]
    parts += [f"{name} AS MATERIALIZED ({text.replace(' DIV ', ' // ').replace('USEC(', 'epoch_us(')})" for name, text in STATEMENTS.items()]
    needed, todo = [], [body]
    names = [p.split(" ", 1)[0] for p in parts]
    found: set[str] = set()
    import re

    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name, part in zip(names, parts, strict=True):
            if name in words and name not in found:
                found.add(name)
                todo.append(part.split(" AS MATERIALIZED ", 1)[1])
    needed = [p for n, p in zip(names, parts, strict=True) if n in found]
    inner = body.strip()
    if inner.upper().startswith("WITH "):
        return f"WITH {', '.join(needed)}{', ' if needed else ''}{inner[5:]}"
    return (f"WITH {', '.join(needed)} " if needed else "") + inner
