"""Data model: labels of the numbers in the tables, and the columns of the logical tables."""

from __future__ import annotations

# Fixed values of the data model.
L7 = {0: "", 1: "DNS", 2: "HTTP", 3: "FTP", 4: "SMTP", 5: "IMAP", 6: "POP3", 7: "TLS", 8: "RTP", 9: "RTCP", 10: "RTSP", 11: "SIP"}
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}
ICMP, TCP, UDP, ICMP6 = 1, 6, 17, 58
STATUS_SYN = 2
ZERO_WINDOW, PORTS_REUSED, OUT_OF_ORDER, KEEP_ALIVE = 0, 1, 2, 3
#: A session without an answer for so many seconds has timed out.
TIMEOUT_SECONDS = 72
#: Round trips of ten seconds and more are ignored, and so are negative ones.
RTT_LIMIT = 10_000_000_000
SEVERITIES = {0: "information", 1: "warning", 2: "critical"}
TRIGGER_TYPES = {"over": 0, "under": 1, "delta": 2}
#: Metrics that a trigger may watch.
DATASOURCES = ("bps", "pps", "averagelatency", "timeoutcounts", "tcprsts", "tcpdupacks", "tcpretransmissions", "tcpzerowindows", "tcpportsreused", "tcpoutoforders")

SESSION_COLUMNS = (
    "session_id", "src_ip", "dst_ip", "src_port", "dst_port", "ether_type", "source_is_small", "payload_protocol",
    "first_second", "first_ns", "last_second", "last_ns", "l7", "status", "file_seq",
)
MARKER_COLUMNS = ("session_id", "second", "ns", "small_to_big", "tail")

SESSION_SCHEMA = (
    "session_id long, src_ip long, dst_ip long, src_port int, dst_port int, ether_type int, source_is_small int, payload_protocol int, "
    "first_second long, first_ns long, last_second long, last_ns long, l7 int, status int, file_seq long"
)
TRAFFIC_SCHEMA = "session_id long, second long, small_to_big long, big_to_small long"
MARKER_SCHEMA = "session_id long, second long, ns long, small_to_big int, tail long"
ANOMALY_SCHEMA = (
    "device_mac string, device_alias string, device_ip string, device_responsive boolean, scenario_name string, "
    "threshold struct<major_ns:long,minor_ns:long>, time_range struct<start:string,`end`:string>, "
    "`values` array<struct<timestamp:string,rtt_ns:long,status:array<string>>>"
)
