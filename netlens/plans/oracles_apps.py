"""SQL of the application trackers, rollups, events, dashboards and stores."""

from __future__ import annotations

from netlens.plans import oracles as o
from netlens.plans.oracles import GOOD, MEAN, MONTH, MOVED, NOW, RTT, acc, fact

ENDS = "ends AS (SELECT session_id, src_ip AS client, dst_ip AS server, dst_port, first_second FROM acc)"
GONE = f"gone AS (SELECT session_id, COUNT(*) AS gone FROM timeouts WHERE marker_second BETWEEN {MONTH[0]} AND {MONTH[1]} AND session_id IN (SELECT session_id FROM acc) GROUP BY 1)"
RT = f"{fact('r', 'rtts', MONTH)}, rt AS (SELECT *, {MEAN} AS mean FROM (SELECT session_id, {RTT} FROM r WHERE {GOOD} GROUP BY 1))"

DNS = f"""{acc(MONTH, 'AND l7 = 1')}, {ENDS}, {GONE}, {RT}, dn AS (SELECT d.session_id, client, server, first_second, CASE WHEN contains(content, 'DnsAnswerRRs=') THEN 'RESOLVED' WHEN contains(content, 'DnsException=A') THEN 'ZEROANSWER' WHEN contains(content, 'DnsException=R') THEN 'ANSWERBROKEN'
WHEN contains(content, 'DnsException=M') THEN 'MULTIPLEQUERIES' WHEN gone.session_id IS NOT NULL THEN 'TIMEOUT' ELSE 'REQUESTONLY' END AS status, regexp_extract(content, 'DnsQuestion=([^,]*),', 1) AS query, CAST(rt.mean AS BIGINT) AS latency
FROM dns_remarks d JOIN ends ON ends.session_id = d.session_id LEFT JOIN gone ON gone.session_id = d.session_id LEFT JOIN rt ON rt.session_id = d.session_id)"""
DNS_STATS = """CAST(coalesce(MIN(latency), 0) AS BIGINT) AS fastest, CAST(coalesce(MAX(latency), 0) AS BIGINT) AS slowest, CAST(coalesce(SUM(latency) // nullif(COUNT(latency), 0), 0) AS BIGINT) AS average, COUNT(DISTINCT client) AS clientsserved, COUNT(*) AS queriestaken,
COUNT(CASE WHEN status = 'RESOLVED' THEN 1 END) AS resolved, COUNT(CASE WHEN status = 'TIMEOUT' THEN 1 END) AS timeout, COUNT(CASE WHEN status = 'ZEROANSWER' THEN 1 END) AS zeroanswer, COUNT(CASE WHEN status = 'ANSWERBROKEN' THEN 1 END) AS answerbroken, COUNT(CASE WHEN status = 'MULTIPLEQUERIES' THEN 1 END) AS multiplequeries"""
DNS_SERVERS = f"WITH {DNS} SELECT server, {DNS_STATS} FROM dn GROUP BY server"
DNS_PERFORMANCE = f"WITH {DNS} SELECT {DNS_STATS} FROM dn"
DNS_ROWS = f"WITH {DNS} SELECT status, query, client, COUNT(*) AS hits FROM dn GROUP BY 1, 2, 3"


def dns_top(column: str, name: str) -> str:
    return f"WITH {DNS} SELECT {column} AS {name}, COUNT(*) AS hits FROM dn GROUP BY 1 ORDER BY hits DESC, {name} LIMIT 10"


FQDN = "SELECT DISTINCT regexp_extract(a, '^([^,]*),', 1) AS name, regexp_extract(rec, ',(1|28),([0-9a-f]+)$', 2) AS ip_hex FROM (SELECT a, unnest(string_split(a, ' ')) AS rec FROM (SELECT regexp_extract(content, 'DnsAnswerRRs=([^\n]*)', 1) AS a FROM dns_remarks)) WHERE regexp_matches(rec, ',(1|28),[0-9a-f]+$')"

MAIL = f"{acc(MONTH)}, {ENDS}, {fact('f', 'bps', MONTH)}, {MOVED}"


def _n(column: str, key: str) -> str:
    return f"len(regexp_extract_all({column}, '{key}='))"


def mail_pairs(column: str, keys: dict[str, str]) -> str:
    sums = ", ".join(f"CAST(SUM({_n(column, k)}) AS BIGINT) AS \"{v}\"" for k, v in keys.items())
    outer = ", ".join(f"CAST(SUM(\"{v}\") AS BIGINT) AS \"{v}\"" for v in keys.values())
    total = " + ".join(f"SUM(\"{v}\")" for v in keys.values())
    return f"WITH {MAIL}, g AS (SELECT m.session_id, client, server, {sums} FROM mail_remarks m JOIN ends ON ends.session_id = m.session_id GROUP BY 1, 2, 3) SELECT client, server, CAST(coalesce(SUM(up + down), 0) AS BIGINT) AS bytestransferred, {outer}, CAST({total} AS BIGINT) AS errors FROM g LEFT JOIN mv ON mv.session_id = g.session_id GROUP BY 1, 2"


def mail_rankings(pairs: str) -> str:
    by = f"b AS (SELECT client, CAST(SUM(bytestransferred) AS BIGINT) AS x, CAST(SUM(errors) AS BIGINT) AS y FROM ({pairs}) GROUP BY 1)"
    return f"WITH {by} SELECT * FROM (SELECT 'busiest' AS kind, client, x AS value FROM b ORDER BY x DESC, client LIMIT 10) UNION ALL SELECT * FROM (SELECT 'erroneous' AS kind, client, y AS value FROM b ORDER BY y DESC, client LIMIT 10)"


SMTP = f"""WITH {MAIL}, g AS (SELECT m.session_id, client, server, max_by(regexp_extract(smtp, 'SmtpMailFrom=([^\n]*)', 1), file_seq) AS sender, CAST(SUM({_n('smtp', 'SmtpRcptTo')}) AS BIGINT) AS recipients, CAST(SUM({_n('smtp', 'SmtpError')}) AS BIGINT) AS errors
FROM mail_remarks m JOIN ends ON ends.session_id = m.session_id GROUP BY 1, 2, 3) SELECT g.session_id AS sessionid, server AS serverip, sender, recipients, errors, CAST(coalesce(up + down, 0) AS BIGINT) AS bytes FROM g LEFT JOIN mv ON mv.session_id = g.session_id"""


def _list(key: str) -> str:
    return f"coalesce(string_agg(CASE WHEN contains(ftp, '{key}=') THEN regexp_extract(ftp, '{key}=([^\n]*)', 1) END, ',' ORDER BY file_seq), '')"


FTP = f"""WITH {MAIL}, g AS (SELECT m.session_id, client, server, first_second, {_list('FtpStor')} AS stored, {_list('FtpRetr')} AS retrieved, {_list('FtpDele')} AS deleted, CAST(SUM({_n('ftp', 'FtpError')}) AS BIGINT) AS errors
FROM mail_remarks m JOIN ends ON ends.session_id = m.session_id GROUP BY 1, 2, 3, 4) SELECT g.session_id AS sessionid, client AS clientip, server AS serverip, first_second AS "from", stored, retrieved, deleted, errors, CAST(coalesce(up, 0) AS BIGINT) AS clienttoserver, CAST(coalesce(down, 0) AS BIGINT) AS servertoclient FROM g LEFT JOIN mv ON mv.session_id = g.session_id"""

BROWSER = "CASE page_id % 5 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' ELSE 'Others' END"
SYSTEM = "CASE page_id % 5 WHEN 0 THEN 'Windows 10' WHEN 1 THEN 'Windows 7' WHEN 2 THEN 'macOS' WHEN 3 THEN 'Android' ELSE 'Others' END"
# straight from the pages: which requests exist and which were answered
HTTP = f"""{acc(MONTH, 'AND l7 = 2')}, hr AS (SELECT w.session_id AS sessionid, s.src_ip AS client_ip, s.dst_ip AS server_ip, s.dst_port AS server_port, host, CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, path,
CASE WHEN page_id % 3 = 0 THEN '' ELSE 'http://site' || (page_id % 3) || '.example/start' END AS referer, {BROWSER} AS browser, {SYSTEM} AS os, request_at AS requestat,
CASE WHEN page_id % 11 = 0 THEN -1 ELSE request_at + latency END AS responseat, CASE WHEN page_id % 11 = 0 THEN 0 ELSE CAST(w.status AS INTEGER) END AS status FROM web w JOIN acc s ON s.session_id = w.session_id)"""
HTTP_RECORDS = f"WITH {HTTP} SELECT * FROM hr"
HTTP_GEO = f"WITH {HTTP} SELECT hr.*, coalesce(geo.country, '') AS country FROM hr LEFT JOIN geo ON client_ip BETWEEN ip_from AND ip_to"
HTTP_PROFILE = f"WITH z AS ({HTTP_GEO}), k AS (SELECT 'country' AS kind, country AS name FROM z UNION ALL SELECT 'browser', browser FROM z UNION ALL SELECT 'os', os FROM z UNION ALL SELECT 'referer', referer FROM z), c AS (SELECT kind, name, COUNT(*) AS hits FROM k GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY hits DESC, name) AS n FROM c) SELECT kind, name, hits FROM n WHERE n <= 10"
HTTP_PERFORMANCE = f"WITH {HTTP} SELECT method, path, COUNT(*) AS requests, COUNT(CASE WHEN responseat >= 0 THEN 1 END) AS responses, CAST(coalesce(SUM(CASE WHEN responseat >= 0 THEN responseat - requestat END) // nullif(COUNT(CASE WHEN responseat >= 0 THEN 1 END), 0), 0) AS BIGINT) AS meanreqtores, COUNT(CASE WHEN responseat < 0 THEN 1 END) AS noresponses, COUNT(CASE WHEN status BETWEEN 400 AND 499 THEN 1 END) AS clienterrors, COUNT(CASE WHEN status >= 500 THEN 1 END) AS servererrors FROM hr GROUP BY 1, 2"
HTTP_SECONDS = f"WITH {HTTP}, g AS (SELECT requestat // 1000000000 AS timestamp, COUNT(*) AS value FROM hr GROUP BY 1), calendar AS (SELECT unnest(range({MONTH[0]}, {MONTH[1] + 1})) AS timestamp) SELECT c.timestamp, CAST(coalesce(g.value, 0) AS BIGINT) AS value FROM calendar c LEFT JOIN g ON g.timestamp = c.timestamp"
HTTP_ERRORS = f"WITH {HTTP} SELECT CASE WHEN status < 500 THEN 'client' ELSE 'server' END AS side, status, COUNT(*) AS hits FROM hr WHERE status >= 400 AND regexp_matches(path, 'a') GROUP BY 1, 2"
DOTTED = "((server_ip // 16777216) || '.' || (server_ip // 65536 % 256) || '.' || (server_ip // 256 % 256) || '.' || (server_ip % 256))"
HTTP_DESCRIBED = f"WITH {HTTP} SELECT status || host || CASE WHEN server_port = 80 THEN '' ELSE ':' || server_port END || path || ' (' || {DOTTED} || ')' AS description, client_ip AS ip FROM hr WHERE status >= 400"
TOPN_HTTP = f"SELECT description, COUNT(*) AS value FROM ({HTTP_DESCRIBED}) GROUP BY 1 ORDER BY value DESC, description LIMIT 100"
TOPN_HTTP_SOURCES = f"SELECT description, ip, COUNT(*) AS value FROM ({HTTP_DESCRIBED}) GROUP BY 1, 2"
HTTT = f"WITH {HTTP}, rr AS (SELECT *, 'http://' || host || path AS url FROM hr), p AS (SELECT url, arg_min(referer, requestat) AS p FROM rr GROUP BY 1) SELECT client_ip, CASE WHEN p.p = '' THEN rr.url ELSE p.p END AS root, status, requestat, CAST(CASE WHEN responseat >= 0 THEN responseat - requestat ELSE -1 END AS BIGINT) AS latency, host, path, referer FROM rr JOIN p ON p.url = rr.url"

TLS = f"{acc(MONTH, 'AND l7 = 7')}, {ENDS}, sn AS (SELECT t.session_id, client, server, dst_port, first_second, file_seq, regexp_extract(content, 'TLSSNI=([^\n]*)', 1) AS sni FROM tls_remarks t JOIN ends ON ends.session_id = t.session_id), ok AS (SELECT * FROM sn WHERE regexp_full_match(sni, '[A-Za-z0-9.-]+'))"
TLS_TRACKER = f"""WITH {TLS}, u AS (SELECT DISTINCT session_id, sni, client, server FROM ok), {fact('f', 'bps', MONTH)}, {MOVED}, {RT}, {GONE}
SELECT sni, server AS serverip, client AS clientip, COUNT(*) AS sessions, CAST(coalesce(SUM(up), 0) AS BIGINT) AS bytescs, CAST(coalesce(SUM(down), 0) AS BIGINT) AS bytessc, CAST(coalesce(SUM(n0), 0) AS BIGINT) AS rttcssum, CAST(coalesce(SUM(d0), 0) AS BIGINT) AS rttcshits, CAST(coalesce(SUM(n1), 0) AS BIGINT) AS rttscsum, CAST(coalesce(SUM(d1), 0) AS BIGINT) AS rttschits, CAST(coalesce(SUM(gone), 0) AS BIGINT) AS timeouts
FROM u LEFT JOIN mv ON mv.session_id = u.session_id LEFT JOIN rt ON rt.session_id = u.session_id LEFT JOIN gone ON gone.session_id = u.session_id GROUP BY 1, 2, 3"""
TLS_ROWS = f"WITH {TLS} SELECT session_id, first_second AS timestamp, arg_min(client, file_seq) AS client_ip, arg_min(server, file_seq) AS server_ip, arg_min(dst_port, file_seq) AS server_port, arg_min(sni, file_seq) AS sni FROM ok GROUP BY 1, 2"
TLS_DUMP = f"SELECT timestamp, client_ip AS clientip, server_ip AS serverip, server_port AS serverport, sni FROM ({TLS_ROWS}) WHERE timestamp BETWEEN {MONTH[0]} AND {MONTH[1]} ORDER BY timestamp, sni, session_id LIMIT 50 OFFSET 5"

SIP = f"""{acc(MONTH)}, sp AS (SELECT p.session_id, p."at" AS timestamp, CASE WHEN starts_with(start_line, 'SIP/2.0') THEN 'RESPONSE' ELSE string_split(start_line, ' ')[1] END AS type, CASE WHEN starts_with(start_line, 'SIP/2.0') THEN CAST(substr(start_line, 9, 3) AS INTEGER) ELSE 0 END AS code,
regexp_extract(body, 'Call-ID: ([^\n]*)', 1) AS callid, regexp_extract(body, 'CSeq: ([^\n]*)', 1) AS cseq, regexp_extract(body, 'From: ([^\n;]*)', 1) AS sipfrom, regexp_extract(body, 'To: ([^\n;]*)', 1) AS sipto,
CASE WHEN direction = source_is_small THEN src_ip ELSE dst_ip END AS fromip, CASE WHEN direction = source_is_small THEN dst_ip ELSE src_ip END AS toip, regexp_extract(body, 'm=audio ([0-9]+) ', 1) AS media_port
FROM sip_remarks p JOIN acc s ON s.session_id = p.session_id AND l7 = 11)"""
SIP_RTT = "lg AS (SELECT *, lag(type) OVER (PARTITION BY callid, cseq ORDER BY timestamp, type) AS bt, lag(timestamp) OVER (PARTITION BY callid, cseq ORDER BY timestamp, type) AS ba FROM sp WHERE type <> 'ACK'), srt AS (SELECT sipfrom, sipto, callid, cseq, bt AS request, timestamp - ba AS rtt FROM lg WHERE type = 'RESPONSE' AND bt <> 'RESPONSE')"
VOIP_PAIRS = f"WITH {SIP} SELECT DISTINCT sipfrom, sipto FROM sp"
VOIP_RTT = f"WITH {SIP}, {SIP_RTT} SELECT * FROM srt"
VOIP_DETAILS = f"WITH {SIP} SELECT timestamp, callid, sipfrom, sipto, type, code, cseq, fromip, toip FROM sp"
SIP_JITTER = f"""{fact('pk', 'packets', MONTH)}, gp AS (SELECT session_id, small_to_big, second * 1000000000 + ns - lag(second * 1000000000 + ns) OVER (PARTITION BY session_id, small_to_big ORDER BY second * 1000000000 + ns) AS gap FROM pk),
gm AS (SELECT session_id, small_to_big, SUM(gap) // COUNT(gap) AS mean, COUNT(gap) AS n FROM gp WHERE gap IS NOT NULL GROUP BY 1, 2 HAVING COUNT(gap) > 1), gj AS (SELECT gm.session_id, gm.small_to_big, SUM(abs(gap - mean)) // n AS jitter FROM gm JOIN gp ON gp.session_id = gm.session_id AND gp.small_to_big = gm.small_to_big WHERE gap IS NOT NULL GROUP BY 1, 2, n),
md AS (SELECT DISTINCT sipfrom, sipto, callid, fromip AS ip, CAST(media_port AS INTEGER) AS port FROM sp WHERE media_port <> ''), udp AS (SELECT * FROM acc WHERE payload_protocol = 17),
mf AS (SELECT md.*, session_id, 0 AS side FROM md JOIN udp ON dst_ip = ip AND dst_port = port UNION ALL SELECT md.*, session_id, 1 AS side FROM md JOIN udp ON src_ip = ip AND src_port = port),
mb AS (SELECT * FROM mf WHERE side = (SELECT MIN(side) FROM mf m2 WHERE m2.callid = mf.callid AND m2.ip = mf.ip AND m2.port = mf.port)), jt AS (SELECT sipfrom, sipto, callid, ip, port, mb.session_id, CAST(jitter AS BIGINT) AS jitter FROM mb JOIN gj ON gj.session_id = mb.session_id)"""
VOIP_JITTER = f"WITH {SIP}, {SIP_JITTER} SELECT sipfrom, sipto, callid, ip, port, COUNT(*) AS streams, CAST(SUM(jitter) // COUNT(*) AS BIGINT) AS jitter FROM jt GROUP BY 1, 2, 3, 4, 5"
VOIP_SUMMARY = f"""WITH {SIP}, {SIP_RTT}, {SIP_JITTER}, a AS (SELECT sipfrom, sipto, type AS name, COUNT(*) AS requests FROM sp WHERE type <> 'RESPONSE' GROUP BY 1, 2, 3), b AS (SELECT sipfrom, sipto, request AS name, COUNT(*) AS responses FROM srt GROUP BY 1, 2, 3),
c AS (SELECT sipfrom, sipto, SUM(rtt) // COUNT(rtt) AS x FROM srt GROUP BY 1, 2), d AS (SELECT sipfrom, sipto, SUM(jitter) // COUNT(jitter) AS y FROM jt GROUP BY 1, 2)
SELECT a.sipfrom, a.sipto, a.name, requests, coalesce(responses, 0) AS responses, CAST(coalesce(x, 0) AS BIGINT) AS siprtt, CAST(coalesce(y, 0) AS BIGINT) AS rtpjitter FROM a LEFT JOIN b ON b.sipfrom = a.sipfrom AND b.sipto = a.sipto AND b.name = a.name LEFT JOIN c ON c.sipfrom = a.sipfrom AND c.sipto = a.sipto LEFT JOIN d ON d.sipfrom = a.sipfrom AND d.sipto = a.sipto"""

# ---------------------------------------------------------------- rollups



def _marker_cte(kind: str) -> str:
    table, time, test = o.MARKERS[kind]
    return f"{kind}_m AS (SELECT {time} AS second, session_id FROM {table} WHERE {test} AND {time} BETWEEN {MONTH[0]} AND {MONTH[1]} AND session_id IN (SELECT session_id FROM acc))"


ROLLUP_PS = (
    f"WITH {acc(MONTH)}, {fact('b', 'bps', MONTH)}, {fact('p', 'pps', MONTH)}, {fact('r', 'rtts', MONTH)}, "
    + ", ".join(_marker_cte(k) for k in o.MARKERS)
    + f", x AS (SELECT second, 'bps' AS k, (small_to_big + big_to_small) * 8 AS n FROM b UNION ALL SELECT second, 'pps_' || {o.CAST}, small_to_big + big_to_small FROM p"
    + f" UNION ALL SELECT second, CASE WHEN small_to_big = source_is_small THEN 'n0' ELSE 'n1' END, tail FROM r WHERE {GOOD} UNION ALL SELECT second, CASE WHEN small_to_big = source_is_small THEN 'd0' ELSE 'd1' END, 1 FROM r WHERE {GOOD}"
    + "".join(f" UNION ALL SELECT second, '{k}', 1 FROM {k}_m" for k in o.MARKERS)
    + ") SELECT second, "
    + ", ".join(f"CAST(SUM(CASE WHEN k = '{k}' THEN n ELSE 0 END) AS BIGINT) AS {k}" for k in ("bps", "pps_unknown", "pps_broadcast", "pps_multicast", "pps_unicast", "n0", "d0", "n1", "d1", *o.MARKERS))
    + " FROM x GROUP BY second"
)


def pmpi(metric: str, grain: str = "service") -> str:
    select, own = o.KEYS[grain]
    keys = ", ".join(own)
    minute = "second // 60 * 60 AS minute"
    if metric in ("bytes", "packets"):
        table = "bps" if metric == "bytes" else "pps"
        return f"WITH {acc(MONTH)}, {fact('f', table, MONTH)}, {o._both('x', 'f')} SELECT minute, {keys}, CAST(SUM(n) AS BIGINT) AS value FROM (SELECT {minute}, {select}, n FROM x WHERE n > 0) GROUP BY minute, {keys}"
    if metric == "latencies":
        return f"WITH {acc(MONTH)}, {fact('r0', 'rtts', MONTH)}, r AS (SELECT *, CASE WHEN small_to_big = source_is_small THEN 1 ELSE 0 END AS direction FROM r0 WHERE {GOOD}), t AS (SELECT {minute}, {select}, {', '.join(('small_to_big', 'source_is_small', 'tail'))} FROM r) SELECT minute, {keys}, " + ", ".join(f"CAST({x.strip()} AS BIGINT) AS {x.strip()}" for x in ("n0", "d0", "n1", "d1")) + f" FROM (SELECT minute, {keys}, {RTT} FROM t GROUP BY minute, {keys})"
    kind = "timeoutcounts" if metric == "timeouts" else metric
    return f"WITH {acc(MONTH)}, {o.markers(kind, MONTH)} SELECT minute, {keys}, COUNT(*) AS value FROM (SELECT {minute}, {select} FROM m) GROUP BY minute, {keys}"


ROLLUP_HTTP = f"WITH {HTTP} SELECT requestat // 1000000000 // 60 * 60 AS minute, status, host, path, server_ip, server_port, client_ip, COUNT(*) AS hits FROM hr WHERE status >= 400 GROUP BY 1, 2, 3, 4, 5, 6, 7"
ROLLUP_DNS = f"WITH {DNS} SELECT first_second // 60 * 60 AS minute, server, status, query, client, COUNT(*) AS hits FROM dn GROUP BY 1, 2, 3, 4, 5"
ROLLUP_ICMP = f"WITH {acc(MONTH)} SELECT second // 60 * 60 AS minute, type, code, s.src_ip AS ip, s.dst_ip AS ip2, COUNT(*) AS hits FROM icmp_packets p JOIN acc s ON s.session_id = p.session_id WHERE second BETWEEN {MONTH[0]} AND {MONTH[1]} GROUP BY 1, 2, 3, 4, 5"
PS2 = (
    f"WITH {acc(MONTH)}, tg AS (SELECT * FROM (SELECT tag, ip_hex FROM tag_ip UNION ALL SELECT name, unnest(string_split(ips, ',')) FROM user_apps) WHERE length(ip_hex) = 8), sg AS (SELECT tag, md5(string_agg(DISTINCT ip_hex, ',' ORDER BY ip_hex)) AS signature FROM tg GROUP BY 1), si AS (SELECT DISTINCT signature, CAST('0x' || ip_hex AS BIGINT) AS ip FROM tg JOIN sg ON sg.tag = tg.tag), mb AS (SELECT DISTINCT session_id, signature FROM acc JOIN si ON src_ip = ip OR dst_ip = ip), "
    + f"{fact('b', 'bps', MONTH)}, {fact('p', 'pps', MONTH)}, {fact('r', 'rtts', MONTH)}, "
    + ", ".join(_marker_cte(k) for k in o.MARKERS)
    + f", x AS (SELECT session_id, second, 'bps' AS metric, (small_to_big + big_to_small) * 8 AS n FROM b UNION ALL SELECT session_id, second, 'pps_' || {o.CAST}, small_to_big + big_to_small FROM p"
    + f" UNION ALL SELECT session_id, second, CASE WHEN small_to_big = source_is_small THEN 'n0' ELSE 'n1' END, tail FROM r WHERE {GOOD} UNION ALL SELECT session_id, second, CASE WHEN small_to_big = source_is_small THEN 'd0' ELSE 'd1' END, 1 FROM r WHERE {GOOD}"
    + "".join(f" UNION ALL SELECT session_id, second, '{k}', 1 FROM {k}_m" for k in o.MARKERS)
    + ") SELECT signature, metric, second, CAST(SUM(n) AS BIGINT) AS value FROM x JOIN mb ON mb.session_id = x.session_id GROUP BY 1, 2, 3"
)

# ---------------------------------------------------------------- events, dashboards, reports


def events(kind: str, lookback: int, threshold: int, severity: int, message: str, delta: int = 0) -> str:
    fires = {"over": f"mean > {threshold}", "under": f"mean < {threshold}", "delta": f"before // {lookback} > {threshold} AND s * {100 + delta} // 100 > before"}[kind]
    return f"""WITH z AS ({o.bps(MONTH)}), w AS (SELECT (timestamp - {MONTH[0]}) // {lookback} AS k, SUM(value) AS s, COUNT(*) AS n FROM z GROUP BY 1 HAVING COUNT(*) = {lookback}), v AS (SELECT *, s // {lookback} AS mean, lag(s) OVER (ORDER BY k) AS before FROM w)
    SELECT CAST((k + 1) * {lookback} + {MONTH[0]} - 1 AS BIGINT) AS occurredat, {severity} AS severity, 'bps' AS datasource, CAST({lookback} AS BIGINT) AS lookbackwindow, '{kind}' AS type, CAST(mean AS BIGINT) AS value, CAST({threshold} AS BIGINT) AS threshold, 'all' AS tag, '{message}' AS description FROM v WHERE {fires}"""


EVENTS_QUERY = f"SELECT * FROM (SELECT * FROM ({events('over', 3600, 300, 2, 'busy')}) UNION ALL SELECT * FROM ({events('under', 7200, 250, 1, 'idle')})) WHERE severity >= 1 ORDER BY occurredat, description LIMIT 100"
SERVICE = "CASE WHEN dst_ip = 3232235776 AND dst_port = 443 THEN 'secure-web' WHEN (dst_ip & 4294967288) = 3232235776 THEN 'servers' END"
GROUP = "CASE WHEN (src_ip & 4294967232) = 167772160 THEN 'clients-a' WHEN (src_ip & 4294967232) = 167772224 THEN 'clients-b' ELSE '' END"


def _last(seconds: int) -> tuple[int, int]:
    return (NOW - seconds + 1, NOW)


LONG = _last(21600)
SVCD_BPS = f"WITH {acc(_last(600))}, {fact('f', 'bps', _last(600))}, g AS (SELECT {SERVICE} AS service, second AS timestamp, SUM(small_to_big + big_to_small) * 8 AS value FROM f GROUP BY 1, 2), calendar AS (SELECT unnest(range({NOW - 599}, {NOW + 1})) AS timestamp), k AS (SELECT DISTINCT service FROM g WHERE service IS NOT NULL) SELECT k.service, c.timestamp, CAST(coalesce(g.value, 0) AS BIGINT) AS value FROM k CROSS JOIN calendar c LEFT JOIN g ON g.service = k.service AND g.timestamp = c.timestamp"
SVCD_CLIENTS = f"WITH {acc(LONG)}, {fact('f', 'bps', LONG)} SELECT {SERVICE} AS service, {GROUP} AS clientgroup, second AS timestamp, COUNT(DISTINCT src_ip) AS clients FROM f WHERE {SERVICE} IS NOT NULL GROUP BY 1, 2, 3"
_LB = (60, 600, 1800, 3600, 21600)


def _svcd_counter(kind: str) -> str:
    cells = ", ".join(f"COUNT(CASE WHEN second > {NOW - k} THEN 1 END) AS last{k}" for k in _LB)
    return f"SELECT * FROM (WITH {acc(LONG)}, {o.markers(kind, LONG)} SELECT {SERVICE} AS service, {cells}, '{kind}' AS kind FROM m WHERE {SERVICE} IS NOT NULL GROUP BY 1)"


SVCD_COUNTERS = " UNION ALL ".join(_svcd_counter(k) for k in ("timeoutcounts", "tcpretransmissions", "tcpzerowindows"))
SVCD_RTT = (
    f"WITH {acc(LONG)}, {fact('f', 'rtts', LONG)} SELECT {SERVICE} AS service, "
    + ", ".join(f"CAST(coalesce(SUM(CASE WHEN second > {NOW - k} THEN tail END) // nullif(COUNT(CASE WHEN second > {NOW - k} THEN 1 END), 0), 0) AS BIGINT) AS avg{k}, coalesce(MIN(CASE WHEN second > {NOW - k} THEN tail END), 0) AS bottom{k}, coalesce(MAX(CASE WHEN second > {NOW - k} THEN tail END), 0) AS top{k}" for k in _LB)
    + f" FROM f WHERE {GOOD} AND {SERVICE} IS NOT NULL GROUP BY 1"
)


def working_hours(by: str, base: str = "bytes") -> str:
    at = "to_timestamp(second) AT TIME ZONE 'UTC'"
    inside = f"dayofweek({at}) BETWEEN 1 AND 5 AND hour({at}) * 60 + minute({at}) >= 540 AND hour({at}) * 60 + minute({at}) < 1080"
    key = {"days": f"strftime({at}, '%Y-%m-%d')", "services": "(dst_ip // 16777216) || '.' || (dst_ip // 65536 % 256) || '.' || (dst_ip // 256 % 256) || '.' || (dst_ip % 256) || ':' || dst_port", "tags": "tg.tag"}[by]
    join = "" if by != "tags" else "JOIN (SELECT DISTINCT tag, CAST('0x' || ip_hex AS BIGINT) AS tip FROM tag_ip WHERE starts_with(tag, '*')) tg ON tip = src_ip OR tip = dst_ip"
    table = {"bytes": "bps", "bps": "bps", "packets": "pps", "tcprsts": "tcp_rsts"}[base]
    amount = "COUNT(*)" if base == "tcprsts" else "SUM(small_to_big + big_to_small)"
    minutes = f"WITH {acc(MONTH)}, {fact('f', table, MONTH)}, m AS (SELECT {key} AS key, second // 60 * 60 AS minute, {amount} AS value FROM f {join} WHERE {inside} GROUP BY 1, 2)"
    sums = "key, CAST(SUM(value) AS BIGINT) AS value, CAST(MAX(value) AS BIGINT) AS top, arg_max(minute, value * 10000000000 - minute) AS topat"
    if base != "bps":
        return f"{minutes} SELECT {sums} FROM m GROUP BY 1"
    read = f"SELECT strftime({at}, '%Y-%m-%d') AS day, COUNT(DISTINCT second // 60) AS n FROM f WHERE {inside} AND small_to_big + big_to_small > 0 GROUP BY 1"
    n = "(SELECT n FROM rd WHERE day = key)" if by == "days" else "(SELECT SUM(n) FROM rd)"
    return f"{minutes}, rd AS ({read}) SELECT key, CAST(value * 8 // ({n} * 60) AS BIGINT) AS value, CAST(top * 8 // 60 AS BIGINT) AS top, topat FROM (SELECT {sums} FROM m GROUP BY 1)"


PEAK = f"""WITH {acc(MONTH)}, {fact('f', 'bps', MONTH)}, pk AS (SELECT second AS timestamp, SUM(small_to_big + big_to_small) * 8 AS bits FROM f GROUP BY 1 ORDER BY bits DESC, timestamp LIMIT 5), mvd AS (SELECT second AS timestamp, src_ip AS ip, dst_ip AS ip2, SUM(small_to_big + big_to_small) AS bytes FROM f WHERE second IN (SELECT timestamp FROM pk) GROUP BY 1, 2, 3),
fst AS (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY bytes DESC, ip, ip2) AS k FROM mvd), """ + ", ".join(
    f"{k} AS (SELECT src_ip AS ip, dst_ip AS ip2, COUNT(*) AS n FROM {t} JOIN acc ON acc.session_id = {t}.session_id GROUP BY 1, 2)" for k, t in (("q1", "tcp_rsts"), ("q2", "tcp_dupacks"), ("q3", "tcp_retransmissions"))
) + """ SELECT pk.timestamp, CAST(bits AS BIGINT) AS bits, fst.ip, fst.ip2, CAST(bytes AS BIGINT) AS bytes, coalesce(q1.n, 0) AS tcprsts, coalesce(q2.n, 0) AS tcpdupacks, coalesce(q3.n, 0) AS tcpretransmissions FROM pk JOIN fst ON fst.timestamp = pk.timestamp AND fst.k = 1
LEFT JOIN q1 ON q1.ip = fst.ip AND q1.ip2 = fst.ip2 LEFT JOIN q2 ON q2.ip = fst.ip AND q2.ip2 = fst.ip2 LEFT JOIN q3 ON q3.ip = fst.ip AND q3.ip2 = fst.ip2"""
_PAGE = {"tcpzerowindows": "tcp_misc WHERE tail = 0", "tcpretransmissions": "tcp_retransmissions WHERE TRUE", "tcpdupacks": "tcp_dupacks WHERE TRUE", "tcprsts": "tcp_rsts WHERE TRUE", "tcpoutoforders": "tcp_misc WHERE tail = 2"}
TCP_PAGE = (
    f"WITH {acc(MONTH)}, "
    + ", ".join(f"h_{k} AS (SELECT least(src_ip, dst_ip) AS a, greatest(src_ip, dst_ip) AS b, COUNT(*) AS n FROM (SELECT session_id FROM {t}) q JOIN acc ON acc.session_id = q.session_id GROUP BY 1, 2)" for k, t in _PAGE.items())
    + ", firsts AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, ip, ip2, port, direction, value FROM ({o.topn(k, 'service', MONTH, 5)})" for k in _PAGE)
    + ") SELECT kind, ip, ip2, port, direction, value, "
    + ", ".join(f"coalesce(h_{k}.n, 0) AS all_{k}" for k in _PAGE)
    + " FROM firsts "
    + " ".join(f"LEFT JOIN h_{k} ON h_{k}.a = least(ip, ip2) AND h_{k}.b = greatest(ip, ip2)" for k in _PAGE)
)

# ---------------------------------------------------------------- stores

EVER = (0, 4102444799)
#: Probe rows before this second are stored already when the others come in.
SPLIT = 883612800
PROBES = f"SELECT mac, testname, testedat, result, resultdetail, rtt, bps FROM probe_results WHERE testedat BETWEEN {EVER[0]} AND {EVER[1]}"
BIN = 604800
BINNED = f"""WITH x AS (SELECT * FROM probe_results WHERE testedat BETWEEN {EVER[0]} AND {EVER[1]}), an AS (SELECT mac, testname, MIN(testedat) AS anchor, MAX(testedat) AS newest FROM x GROUP BY 1, 2), grid AS (SELECT mac, testname, anchor, unnest(range(0, (newest - anchor) // {BIN} + 1)) AS k FROM an),
g AS (SELECT x.mac, x.testname, (testedat - anchor) // {BIN} AS k, SUM(CASE WHEN result = 8 THEN rtt END) AS rttsum, COUNT(CASE WHEN result = 8 THEN 1 END) AS rttcount, MAX(CASE WHEN result = 8 THEN rtt END) AS rttmax, MIN(CASE WHEN result = 8 THEN rtt END) AS rttmin, arg_min(CASE WHEN result = 8 THEN testedat END, CASE WHEN result = 8 THEN CAST(-rtt AS HUGEINT) * 10000000000 + testedat END) AS tmax, arg_min(CASE WHEN result = 8 THEN testedat END, CASE WHEN result = 8 THEN CAST(rtt AS HUGEINT) * 10000000000 + testedat END) AS tmin, COUNT(CASE WHEN result <> 8 THEN 1 END) AS errors FROM x JOIN an ON an.mac = x.mac AND an.testname = x.testname GROUP BY 1, 2, 3)
SELECT grid.mac, grid.testname, anchor + grid.k * {BIN} AS timestamp, CAST(coalesce(rttsum, 0) AS BIGINT) AS rttsum, coalesce(rttcount, 0) AS rttcount, coalesce(rttmax, 0) AS rttmax, coalesce(tmax, 0) AS timestamprttmax, coalesce(rttmin, 0) AS rttmin, coalesce(tmin, 0) AS timestamprttmin, coalesce(errors, 0) AS errors FROM grid LEFT JOIN g ON g.mac = grid.mac AND g.testname = grid.testname AND g.k = grid.k"""
LATEST = """WITH x AS (SELECT *, CAST(coalesce(SUM(CASE WHEN result = 8 THEN rtt END) OVER w // nullif(COUNT(CASE WHEN result = 8 THEN rtt END) OVER w, 0), 0) AS BIGINT) AS mean, row_number() OVER (PARTITION BY mac, testname ORDER BY testedat DESC, uploadat DESC) AS n FROM probe_results WINDOW w AS (PARTITION BY mac, testname ORDER BY testedat RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)),
y AS (SELECT mac, testname, testedat, result, rtt, mean, CASE WHEN result <> 8 THEN 3 WHEN mean > 300000 THEN 2 WHEN mean > 100000 THEN 1 ELSE 0 END AS status FROM x WHERE n = 1) SELECT *, MAX(status) OVER (PARTITION BY mac) AS devicestatus FROM y"""
RANKING = "SELECT mac, testname, testedat, rtt FROM (SELECT *, row_number() OVER (PARTITION BY mac, testname ORDER BY testedat DESC, uploadat DESC) AS n FROM probe_results WHERE result = 8) WHERE n = 1 ORDER BY rtt DESC, mac, testname LIMIT 100"
INVENTORY = "SELECT mac, testname, COUNT(*) AS count, MIN(testedat) AS oldest, MAX(testedat) AS newest FROM probe_results GROUP BY 1, 2"
INGEST = f"WITH old AS (SELECT mac, testname, MAX(testedat) AS newest FROM probe_results WHERE testedat < {SPLIT} GROUP BY 1, 2) SELECT p.* FROM probe_results p LEFT JOIN old ON old.mac = p.mac AND old.testname = p.testname WHERE p.testedat > coalesce(newest, -1) AND p.testedat <= {EVER[1]} AND NOT (result = 8 AND (rtt < -1 OR bps < -1))"
PARANOIA_LATEST = "SELECT mac, testname, testedat, CAST(json_extract_string(details, '$.steps') AS INTEGER) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY mac, testname ORDER BY testedat DESC, details) AS n FROM paranoia WHERE success = 1) WHERE n = 1"
PARANOIA_RESULTS = f"SELECT mac, testname, testtemplate, COUNT(*) AS count, CAST(SUM(success) AS BIGINT) AS successes, MAX(testedat) AS newest FROM paranoia WHERE testedat BETWEEN {EVER[0]} AND {EVER[1]} GROUP BY 1, 2, 3"
SYSLOG = f"SELECT * FROM syslog WHERE receivedat BETWEEN {MONTH[0]} AND {MONTH[1]} AND contains(message, 'user') AND facility = 1 AND priority <= 4 ORDER BY receivedat DESC, hostname, message LIMIT 100"
SYSLOG_SUMMARY = "SELECT hostname, " + ", ".join(f"COUNT(CASE WHEN priority = {k} THEN 1 END) AS priority{k}" for k in range(5)) + f" FROM syslog WHERE receivedat BETWEEN {MONTH[0]} AND {MONTH[1]} GROUP BY 1"
SNMP = f"SELECT * FROM snmptrap WHERE timestamp BETWEEN {MONTH[0]} AND {MONTH[1]} AND contains(enterprisestring, '6.1') AND traptype = 2 ORDER BY timestamp DESC, sender, message LIMIT 100"
SNMP_SUMMARY = f"SELECT sender, COUNT(CASE WHEN traptype IN (0, 1) THEN 1 END) AS reset, COUNT(CASE WHEN traptype = 2 THEN 1 END) AS linkdown, COUNT(CASE WHEN traptype = 4 THEN 1 END) AS authfail FROM snmptrap WHERE timestamp BETWEEN {MONTH[0]} AND {MONTH[1]} GROUP BY 1"
EDGES = """WITH ed AS (SELECT DISTINCT dst_ip AS ip, dst_port AS port FROM sessions), hx AS (SELECT *, lpad(lower(to_hex(ip)), 8, '0') AS h FROM ed)
SELECT ip, port, CASE WHEN ip = 3232235776 AND port = 443 THEN 'secure-web' WHEN (ip & 4294967288) = 3232235776 THEN 'servers' ELSE '' END AS app, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM tag_ip WHERE ip_hex = h), '') AS tags, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM fqdns WHERE ip_hex = h), '') AS names FROM hx"""
IP_TAGS = "WITH seen AS (SELECT src_ip AS ip FROM sessions UNION SELECT dst_ip FROM sessions) SELECT DISTINCT ip, tag FROM seen JOIN tag_ip ON ip_hex = lpad(lower(to_hex(ip)), 8, '0')"
_LOW6 = "20010db8" + "0" * 22
ALIASES6 = f"SELECT session_id, CASE WHEN src_ip6 BETWEEN '{_LOW6}00' AND '{_LOW6}7f' THEN 'six-low' WHEN src_ip6 BETWEEN '{_LOW6}00' AND '{_LOW6[:-1]}3ff' THEN 'six-mid' WHEN starts_with(src_ip6, '20010db8') THEN 'six-all' ELSE '' END AS alias FROM session_ip6"
EDGES6 = """WITH ed AS (SELECT DISTINCT dst_ip6 AS ip6, dst_port AS port FROM session_ip6 x JOIN sessions s ON s.session_id = x.session_id), nm AS (SELECT name, ip_hex FROM fqdns UNION ALL SELECT name, unnest(string_split(ips, ',')) FROM user_apps)
SELECT ip6, port, CASE WHEN ip6 = '20010db8ffff00000000000000000443' AND port = 443 THEN 'six-web' WHEN starts_with(ip6, '20010db8ffff') THEN 'six-servers' ELSE '' END AS app, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM tag_ip WHERE ip_hex = ip6), '') AS tags, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM nm WHERE ip_hex = ip6), '') AS names FROM ed"""
ALIASES = f"WITH {acc(MONTH)} SELECT session_id, coalesce({GROUP}, '') AS alias FROM acc"
ANOMALY = "WITH v AS (SELECT mac, testname, testedat, rtt FROM probe_results) SELECT mac, COUNT(DISTINCT testname) AS scenarios, COUNT(*) AS \"values\", MIN(testedat) AS start_second, MAX(testedat) AS end_second, MAX(testedat) - MIN(testedat) >= 604800 AS ai_ready FROM v GROUP BY 1"
ANOMALY_THRESHOLD = "SELECT mac, COUNT(CASE WHEN rtt >= 300000 THEN 1 END) AS major, COUNT(CASE WHEN rtt >= 100000 AND rtt < 300000 THEN 1 END) AS minor FROM probe_results GROUP BY 1"
# the minute a session begins in must be in the month, as it is in the rollup
DNS_ANSWER = f"WITH {DNS} SELECT server, status, COUNT(*) AS hits FROM dn WHERE first_second BETWEEN {MONTH[0]} AND {MONTH[1]} GROUP BY 1, 2"
HTTP_REGEX = f"WITH {HTTP} SELECT * FROM hr WHERE browser IN ('Chrome', 'Firefox')"
PROBE_EXPIRE = "SELECT * FROM probe_results WHERE testedat >= (SELECT MAX(testedat) FROM probe_results) - 31536000"
PROBE_LOOKBACK = "SELECT * FROM probe_results WHERE mac = '020000000011' AND testname = '1-URGENT' AND testedat >= (SELECT MAX(testedat) FROM probe_results WHERE mac = '020000000011' AND testname = '1-URGENT') - 31536000"
SMTP_ERRORS = f"WITH {acc(MONTH)}, {ENDS} SELECT client, server, regexp_extract(smtp, 'SmtpError=([^\n]*)', 1) AS text FROM mail_remarks m JOIN ends ON ends.session_id = m.session_id WHERE contains(smtp, 'SmtpError=')"
ICMP_PAGE = f"SELECT * FROM ({o.ICMP}) ORDER BY count DESC, type, code, ip, ip2 LIMIT 100"
PORT_PAGE = f"SELECT * FROM ({o.OVERVIEW_SUMMARY}) ORDER BY bytes DESC, payloadprotocol, port LIMIT 100"
DNS_PAGE = f"SELECT * FROM ({DNS_SERVERS}) ORDER BY queriestaken DESC, server LIMIT 100"


def tcp_page_events(kind: str) -> str:
    select, _ = o.KEYS["service"]
    return f"""WITH {acc(MONTH)}, {o.markers(kind, MONTH)}, rk AS (SELECT ip, ip2, port, direction FROM ({o.topn(kind, 'service', MONTH, 3)})), rw AS (SELECT second, {select} FROM m), nn AS (SELECT rw.ip, rw.ip2, rw.port, rw.direction, second, row_number() OVER (PARTITION BY rw.ip, rw.ip2, rw.port, rw.direction ORDER BY second) AS k FROM rw JOIN rk ON rk.ip = rw.ip AND rk.ip2 = rw.ip2 AND rk.port = rw.port AND rk.direction = rw.direction)
    SELECT '{kind}' AS kind, ip, ip2, port, direction, CAST(k AS INTEGER) AS k, second FROM nn WHERE k <= 5"""
