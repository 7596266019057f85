"""Hand-made cases of the rules that the derived tables don't reach."""

import pytest
from pyspark.sql import functions as F

from netlens import model
from netlens.functions import net
from netlens.operators import dashboard, events, flows, series, stores, trackers
from netlens.operators import rollup, topn
from netlens.plans.conditions import Conditions, Network, Network6, accepted, implied, networks, parse_ports
from netlens.sources.tables import Tables, drop_old_hours, drop_old_rollups, feeds, store, write_json, write_tsv


def tables(spark, **frames):
    def missing(self, name):
        raise KeyError(name)

    out = Tables(spark, missing)
    for name, frame in frames.items():
        out[name] = frame
    return out


def session(id_, src=1, dst=2, sport=1000, dport=80, proto=6, first=0, last=10, l7=0, status=2, seq=0, small=1):
    return (id_, src, dst, sport, dport, 2048, small, proto, first, 0, last, 0, l7, status, seq)


def test_merge_takes_ends_of_the_start_flag(spark):
    parts = spark.createDataFrame([session(1, 9, 8, status=0, first=5, last=6, l7=0), session(1, 1, 2, status=2, first=7, last=8, seq=1, l7=2), session(1, 9, 8, status=1, first=9, last=12, seq=2)], model.SESSION_SCHEMA)
    row = flows.merge_sessions(parts).first()
    assert (row.src_ip, row.dst_ip, row.first_second, row.last_second, row.status, row.l7) == (1, 2, 5, 12, 3, 2)


def test_merge_without_start_flag_takes_the_first_record(spark):
    parts = spark.createDataFrame([session(1, 5, 6, proto=17, status=0, first=9, seq=1), session(1, 3, 4, proto=17, status=0, first=2)], model.SESSION_SCHEMA)
    assert tuple(flows.merge_sessions(parts).select("src_ip", "dst_ip", "first_second").first()) == (3, 4, 2)


def test_direction_is_fixed_and_kept(spark):
    s = spark.createDataFrame([session(1, 7, 3, 443, 50000, status=0), session(2, 3, 7, 50000, 443)], model.SESSION_SCHEMA)
    fixed = {r.session_id: r for r in flows.fix_direction(s, flows.learn_services(s)).collect()}
    assert (fixed[1].src_ip, fixed[1].dst_port, fixed[1].source_is_small) == (3, 443, 0)
    assert fixed[2].src_ip == 3


@pytest.mark.parametrize("tail, counted", [(-1, 0), (0, 1), (9_999_999_999, 1), (10_000_000_000, 0)])
def test_round_trip_limits(spark, tail, counted):
    t = tables(spark, sessions=spark.createDataFrame([session(1)], model.SESSION_SCHEMA), rtts=spark.createDataFrame([(1, 5, 0, 1, tail)], model.MARKER_SCHEMA))
    rows = {r.timestamp: r.value for r in series.average_latency(t, Conditions(0, 10)).collect()}
    assert len(rows) == 11 and rows[5] == (tail if counted else 0)


def test_bins_of_zeros_and_ties(spark):
    s = spark.createDataFrame([(k, {3: 7, 4: 7, 8: 2}.get(k, 0)) for k in range(12)], "timestamp long, value long")
    rows = {r.timestamp: tuple(r)[1:] for r in series.bins(s, Conditions(0, 11), 5).collect()}
    assert rows[0] == (5, 14, 7, 3, 7, 3)
    assert rows[5] == (5, 2, 2, 8, 2, 8)
    assert rows[10] == (2, 0, 0, 10, 0, 10)


def test_bins_with_zeros(spark):
    s = spark.createDataFrame([(0, 4), (1, 0), (2, 0)], "timestamp long, value long")
    assert tuple(series.bins(s, Conditions(0, 2), 3, zeros=True).first())[5:] == (0, 1)


def test_networks():
    with pytest.raises(ValueError):
        Network(0x0A000001, 0xFFFFFF00)
    assert Network.parse("0a00000018") == Network(0x0A000000, 0xFFFFFF00)
    assert networks(["10.0.0.0/8", "10.1.0.0/16", "11.0.0.1"]) == [Network(0x0A000000, 0xFF000000), Network(0x0B000001)]
    assert Network.parse("0.0.0.0/0").mask == 0
    assert parse_ports("80,1000-2000") == ((80, 80), (1000, 2000))


@pytest.mark.parametrize("external, found", [(True, [1, 2]), (False, [2])])
def test_external_transfer(spark, external, found):
    s = spark.createDataFrame([session(1, 0x0A000001, 0x01020304), session(2, 0x0A000001, 0x0A000002), session(3, 1, 2)], model.SESSION_SCHEMA)
    where = Conditions(0, 100, ips=(Network.parse("10.0.0.0/8"),), include_external=external)
    assert sorted(r.session_id for r in accepted(tables(spark, sessions=s), where).collect()) == found


def test_alias_needs_port_or_none(spark):
    cidr = spark.createDataFrame([("x", 0x0A000000, 0xFF000000, 53, "dns", 0), ("x", 0x0A000000, 0xFFFF0000, 0, "lan", 1)], "set_name string, ip long, mask long, port int, alias string, ord int")
    rows = spark.createDataFrame([(0x0A000001, 53), (0x0A000001, 80), (0x0A050001, 80)], "ip long, port int")
    assert {(r.ip, r.port): r.alias for r in dashboard.alias_of(rows, cidr, "ip", "port").collect()} == {(0x0A000001, 53): "dns", (0x0A000001, 80): "lan", (0x0A050001, 80): ""}


def test_http_blocks_across_files(spark):
    request = "HttpRequest=1704067200000000001 GET /a b\nRaw=\nHost:  h.example \nUser-Agent: x\nHttpEnd=Request\n"
    response = "HttpResponse=1704067200000000009 404 Not\nRaw=\nHttpEnd=Response\n"
    remarks = spark.createDataFrame([(1, 0, response + request), (1, 1, response + request), (1, 2, request)], "session_id long, file_seq long, content string")
    t = tables(spark, sessions=spark.createDataFrame([session(1, l7=2)], model.SESSION_SCHEMA), http_remarks=remarks)
    rows = trackers.http_records(t, Conditions(0, 100)).collect()
    assert sorted((r.status, r.responseat) for r in rows) == [(0, -1), (0, -1), (404, 1704067200000000009)]
    assert {(r.host, r.path, r.method) for r in rows} == {("h.example", "/a b", "GET")}
    late = 1704067200000000001 + 72_000_000_000
    assert trackers.http_records(t, Conditions(0, 100), late).count() == 3
    assert trackers.http_records(t, Conditions(0, 100), late - 1).count() == 1


def test_referer_chain_and_loop(spark):
    rows = [("h", "/c", "http://h/b", 3), ("h", "/b", "http://h/a", 2), ("h", "/a", "", 1), ("l", "/1", "http://l/2", 4), ("l", "/2", "http://l/1", 5), ("x", "/y", "http://gone/", 6)]
    records = spark.createDataFrame([(i, 1, h, p, r, 200, at, at + 1) for i, (h, p, r, at) in enumerate(rows)], "sessionid long, client_ip long, host string, path string, referer string, status int, requestat long, responseat long")
    found = {r.host + r.path: r.root for r in trackers.transaction_roots(records).collect()}
    assert found == {"h/c": "http://h/a", "h/b": "http://h/a", "h/a": "http://h/a", "l/1": "http://l/1", "l/2": "http://l/1", "x/y": "http://gone/"}


def test_long_referer_chains_and_loops(spark):
    url = lambda host, k: f"http://{host}/{k:03d}"
    rows = [("chain", k, url("chain", k - 1) if k else "") for k in range(41)]
    rows += [("outside", k, url("outside", k - 1)) for k in range(1, 101)]
    rows += [("loop", k, url("loop", (k - 1) % 30)) for k in range(30)]
    rows += [("entry", k, url("entry", k - 1) if k else url("loop", 17)) for k in range(25)]
    rows += [("self", 0, url("self", 0))]
    records = spark.createDataFrame([(i, 1, h, f"/{k:03d}", r, 200, 1000 - i, 1001 - i) for i, (h, k, r) in enumerate(rows)], "sessionid long, client_ip long, host string, path string, referer string, status int, requestat long, responseat long")
    found = trackers.transaction_roots(records).collect()
    assert len(found) == len(rows)
    assert {(r.host, r.root) for r in found} == {("chain", url("chain", 0)), ("outside", url("outside", 0)), ("loop", url("loop", 0)), ("entry", url("loop", 0)), ("self", url("self", 0))}


def test_icmp_remarks_with_and_without_ports(spark):
    s = spark.createDataFrame([session(1, proto=1)], model.SESSION_SCHEMA)
    packets = spark.createDataFrame([(0, 7, 1, 5, 0, 3, 3), (0, 8, 1, 6, 0, 3, 3), (0, 9, 1, 7, 0, 3, 3)], "file_seq long, idx long, session_id long, second long, ns long, type long, code long")
    remarks = spark.createDataFrame([(1, 0, "ICMP7=17 0a000001c0a800010035d431\nICMP8=1 0a000002c0a80001\n")], "session_id long, file_seq long, content string")
    t = tables(spark, sessions=s, icmp_packets=packets, icmp_remarks=remarks)
    rows = {r.second: r for r in flows.icmp_detail(t, Conditions(0, 100), 3, 3).collect()}
    assert (rows[5].payloadprotocol, rows[5].original_ip, rows[5].port, rows[5].port2) == (17, "0a000001", 0x3500, 0x31D4)
    assert (rows[6].original_ip2, rows[6].port) == ("c0a80001", 0)
    assert (rows[7].payloadprotocol, rows[7].original_ip) == (0, "")
    six = "20010db8" + "0" * 24 + "fe80" + "0" * 28
    t["icmp6_packets"] = packets
    t["icmp6_remarks"] = spark.createDataFrame([(1, 0, f"ICMPV67={six}\tU0035d431\nICMPV68={six}\t\nICMPV69=01010060\t")], "session_id long, file_seq long, content string")
    rows = {r.second: r for r in flows.icmp_detail(t, Conditions(0, 100), 3, 3, 6).collect()}
    assert (rows[5].payloadprotocol, rows[5].original_ip2, rows[5].port, rows[5].port2) == (17, six[32:], 0x3500, 0x31D4)
    assert (rows[6].payloadprotocol, rows[6].original_ip, rows[6].port) == (0, six[:32], 0)
    assert (rows[7].payloadprotocol, rows[7].original_ip) == (0, "")


def test_packet_matching(spark):
    kinds = "file_seq long, session_id long, tcp_seq long, tcp_ack long, saved_length long, status int, small_to_big int, timestamp long, idx long"
    near = spark.createDataFrame([(0, 1, k, 0, 60, 0, 1, 1000, k) for k in range(4)], kinds)
    far = spark.createDataFrame([(0, 1, 0, 0, 60, 0, 1, 1700, 0), (0, 1, 0, 0, 60, 0, 1, 1200, 1), (0, 1, 1, 0, 60, 0, 1, 400, 2), (0, 1, 2, 0, 60, 0, 1, 1000 + 11 * 10**9, 3)], kinds)
    found = {r.idx: (r.status, r.latency) for r in flows.packet_loss_latency(near, far).collect()}
    assert found == {0: ("FORWARD", 200), 1: ("REVERSE", 600), 2: ("LOST", -1), 3: ("LOST", -1)}


def test_rollup_equals_raw(spark):
    s = spark.createDataFrame([session(1, first=0, last=400)], model.SESSION_SCHEMA)
    facts = spark.createDataFrame([(1, k, k, 2 * k) for k in range(0, 400, 7)], model.TRAFFIC_SCHEMA)
    empty = spark.createDataFrame([], model.MARKER_SCHEMA)
    timeouts = spark.createDataFrame([], model.SESSION_SCHEMA + ", marker_second long, marker_ns long")
    t = tables(spark, sessions=s, bps=facts, pps=facts, rtts=empty, timeouts=timeouts, tcp_rsts=empty, tcp_misc=empty, tcp_dupacks=empty, tcp_retransmissions=empty)
    where = Conditions(13, 377)
    both = [sorted(map(tuple, f.collect())) for f in (series.bps(t, where), rollup.series_with_rollup(t, rollup.per_second(t, Conditions(0, 400)), "bps", where))]
    assert both[0] == both[1]


def test_triggers_are_checked():
    with pytest.raises(ValueError, match="datasource"):
        events.Trigger("m", 1, "pop3", "over", 60, 1)
    with pytest.raises(ValueError, match="lookback"):
        events.Trigger("m", 1, "bps", "over", 90, 1)


def test_anomaly_documents(spark):
    good = '{"device_mac":"AA:BB:cc-00-11-22","device_alias":"a","device_ip":"1.2.3.4","device_responsive":true,"scenario_name":"s","threshold":{"major_ns":9,"minor_ns":5},"time_range":{"start":"2024-01-01T00:00:00Z","end":"2024-01-09T00:00:00Z"},"values":[{"timestamp":"2024-01-01T00:00:00Z","rtt_ns":6,"status":["x"]}]}'
    other_key = good.replace("device_mac", "mac_address")
    rows = stores.anomaly_parse(spark.createDataFrame([(good,), (other_key,), ("nothing",)], "document string")).collect()
    assert [r.valid for r in rows] == [True, False, False]
    assert rows[0].mac == "aabbcc001122" and rows[0].ai_ready and rows[1].problem == "no device_mac"


def test_address_texts(spark):
    row = spark.range(1).select(net.ip_to_text(F.lit(3232235777)).alias("t"), net.text_to_ip(F.lit("192.168.1.1")).alias("n"), net.ip_to_hex(F.lit(10)).alias("h"), net.ipv6_to_hex(F.lit("fe80::1")).alias("s"), net.ipv6_to_hex(F.lit("x")).alias("b")).first()
    assert tuple(row) == ("192.168.1.1", 3232235777, "0000000a", "fe80000000000000" + "0000000000000001", None)


def test_store_prunes_and_expires(spark, tmp_path):
    s = spark.createDataFrame([session(1, last=10000)], model.SESSION_SCHEMA)
    t = tables(spark, sessions=s, bps=spark.createDataFrame([(1, 10, 1, 1), (1, 4000, 2, 2), (1, 8000, 4, 4)], model.TRAFFIC_SCHEMA))
    store(t, str(tmp_path), "f", ["sessions", "bps"])
    back = Tables.stored(spark, str(tmp_path), "f", 3600, 7199)
    assert [r.second for r in back["bps"].collect()] == [4000]
    assert "hour" in back["bps"]._jdf.queryExecution().toString()
    assert drop_old_hours(spark, str(tmp_path), "bps", "f", 2) == [0, 1]
    assert Tables.stored(spark, str(tmp_path), "f")["bps"].count() == 1


def test_sinks(spark, tmp_path):
    write_tsv(spark.range(2), f"{tmp_path}/t")
    write_json(spark.range(2), f"{tmp_path}/j")
    assert spark.read.csv(f"{tmp_path}/t", sep="\t", header=True).count() == 2 and spark.read.json(f"{tmp_path}/j").count() == 2


def test_networks_of_version_6():
    six = Network.parse("2001:db8::/32")
    assert six == Network6("20010db8" + "0" * 24, "20010db8" + "f" * 24) and Network.parse("20010db8" + "0" * 24 + "20") == six
    assert Network.parse("20010db8" + "0" * 23 + "1") == Network6("20010db8" + "0" * 23 + "1", "20010db8" + "0" * 23 + "1")
    assert networks(["2001:db8::/32", "2001:db8:1::/48", "10.0.0.0/8"]) == [six, Network(0x0A000000, 0xFF000000)]
    for wrong in ("2001:db8::1/64", "0a0000", "0a00000g"):
        with pytest.raises(ValueError):
            Network.parse(wrong)


@pytest.mark.parametrize("external, found", [(True, [1, 2]), (False, [2])])
def test_external_transfer_of_version_6(spark, external, found):
    s = spark.createDataFrame([session(k, 0, 0) for k in (1, 2, 3, 4)], model.SESSION_SCHEMA)
    six = lambda tail: "20010db8" + tail.rjust(24, "0")
    ends = spark.createDataFrame([(1, six("1"), "fe80" + "0" * 28), (2, six("1"), six("2")), (3, "fe80" + "0" * 28, "fe81" + "0" * 28)], "session_id long, src_ip6 string, dst_ip6 string")
    where = Conditions(0, 100, ips=(Network.parse("2001:db8::/64"),), include_external=external)
    got = accepted(tables(spark, sessions=s, session_ip6=ends), where)
    assert sorted(r.session_id for r in got.collect()) == found and got.columns == s.columns


def test_apps_of_users_and_unknown_ones(spark):
    s = spark.createDataFrame([session(1, 0x0A000005), session(2, 7), session(3, 8)], model.SESSION_SCHEMA)
    t = tables(spark, sessions=s, fqdns=spark.createDataFrame([("www.x", "00000008")], "name string, ip_hex string"), user_apps=spark.createDataFrame([("intranet", "0a000005,0a000006", 80), ("www2", "00000007", 80)], "name string, ips string, port int"))
    assert [r.session_id for r in accepted(t, Conditions(0, 100, apps=("intra",))).collect()] == [1]
    assert sorted(r.session_id for r in accepted(t, Conditions(0, 100, apps=("www",))).collect()) == [2, 3]
    with pytest.raises(ValueError, match="nothing"):
        accepted(t, Conditions(0, 100, apps=("nothing",)))


def test_implied_conditions(spark):
    assert implied(Conditions(5, 9, l7=1), "http") == Conditions(5, 9, l7=2)
    s = spark.createDataFrame([session(1, l7=2), session(2, l7=7)], model.SESSION_SCHEMA)
    request = "HttpRequest=1704067200000000001 GET /a\nRaw=\nHost: h\nUser-Agent: x\nHttpEnd=Request\n"
    t = tables(spark, sessions=s, http_remarks=spark.createDataFrame([(1, 0, request), (2, 0, request)], "session_id long, file_seq long, content string"))
    assert [r.sessionid for r in trackers.http_records(t, Conditions(0, 100)).collect()] == [1]
    assert trackers.http_records(t, Conditions(0, 100), block_pattern="(?i)agent: y").count() == 0


def test_store_of_sessions_in_several_files(spark, tmp_path):
    """Sessions whose records stand in three files, one the wrong way round, give the rows of the whole sessions."""
    whole = [session(1, 100, 7, 1001, 443, first=10, last=9000, l7=7), session(2, 7, 101, 443, 1002, first=3000, last=8000, l7=0, status=0, small=0), session(3, 102, 8, 1003, 53, proto=17, first=50, last=60, l7=1, status=0)]
    turned = session(2, 101, 7, 1002, 443, first=3000, last=8000, l7=0, status=0, small=1)
    parts = []
    for row in whole:
        names = dict(zip(model.SESSION_COLUMNS, row, strict=True))
        step = (names["last_second"] - names["first_second"]) // 3
        for k in range(3):
            own = dict(names, file_seq=k, first_second=names["first_second"] + k * step, last_second=names["last_second"] if k == 2 else names["first_second"] + (k + 1) * step)
            if k != 1:
                own["l7"], own["status"] = 0, own["status"] & ~2
            parts.append(tuple(own[c] for c in model.SESSION_COLUMNS))
    facts = spark.createDataFrame([(i, at, at + i, 2 * i) for i, times in ((1, (10, 4000, 8999)), (2, (3000, 7999)), (3, (55,))) for at in times], model.TRAFFIC_SCHEMA)
    empty = spark.createDataFrame([], model.MARKER_SCHEMA)
    timeouts = spark.createDataFrame([], model.SESSION_SCHEMA + ", marker_second long, marker_ns long")
    sni = spark.createDataFrame([(1, 0, "TLSSNI=a.example\n")], "session_id long, file_seq long, content string")
    rest = dict(bps=facts, pps=facts, rtts=empty, timeouts=timeouts, tls_remarks=sni)
    store(tables(spark, sessions=spark.createDataFrame(parts, model.SESSION_SCHEMA), **rest), str(tmp_path), "f", ["sessions", *rest])
    back = Tables.stored(spark, str(tmp_path), "f")
    right = tables(spark, sessions=spark.createDataFrame([whole[0], turned, whole[2]], model.SESSION_SCHEMA), **rest)
    where = Conditions(0, 9999)
    for query in (series.bps, lambda t, w: topn.ranking(t, "bytes", "service", w), flows.data_streams, trackers.tls_tracker):
        assert sorted(map(repr, query(back, where).collect())) == sorted(map(repr, query(right, where).collect()))
    early = Tables.stored(spark, str(tmp_path), "f", 0, 3599)
    plan = early["sessions"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and sorted(r.session_id for r in early["sessions"].collect()) == [1, 2, 3]
    assert sorted(r.session_id for r in Tables.stored(spark, str(tmp_path), "f", 3600, 9999)["sessions"].collect()) == [1, 2]
    assert [tuple(r) for r in feeds(spark, str(tmp_path)).collect()] == [("f", 0, 10799)]
    gone = drop_old_rollups(spark, str(tmp_path), "f", 1)
    assert gone["bps"] == [0] and gone["sessions"] == [0]


def test_records_with_broken_clocks_are_dropped(spark, tmp_path):
    from netlens.sources.sessions import whole_sessions

    s = spark.createDataFrame([session(1, first=50, last=10), session(2, first=10, last=50)], model.SESSION_SCHEMA)
    assert [r.session_id for r in whole_sessions(s).collect()] == [2]


def test_jitter_of_the_longest_round_trips(spark):
    s = spark.createDataFrame([session(1)], model.SESSION_SCHEMA)
    tails = [0, 9_999_999_999] * 50
    rtts = spark.createDataFrame([(1, k // 10, k, 1, t) for k, t in enumerate(tails)] + [(1, 20, 0, 1, 9_999_999_999)], model.MARKER_SCHEMA)
    t = tables(spark, sessions=s, rtts=rtts, pps=spark.createDataFrame([], model.TRAFFIC_SCHEMA))
    row = flows.jitter(t, Conditions(0, 100)).first()
    changes = [abs(b - a) for a, b in zip([*tails, 9_999_999_999], [*tails, 9_999_999_999][1:], strict=False)]
    mean = sum(changes) // len(changes)
    assert (row.jitter, row["count"]) == (mean, len(changes))
    assert row.deviation == int((sum((x - mean) ** 2 for x in changes) // len(changes)) ** 0.5)


def test_media_of_many_sessions_is_one_row_a_call(spark):
    n = 40
    s = spark.createDataFrame([session(k, 500 + k, 9, 2000 + k, 7000, proto=17, l7=8) for k in range(n)] + [session(900, 1, 9, 5060, 5060, proto=17, l7=11)], model.SESSION_SCHEMA)
    packets = spark.createDataFrame([(k, 1, at, 0) for k in range(n) for at in (1, 2, 4 + k % 3)], "session_id long, small_to_big int, second long, ns long")
    body = "Call-ID: {0}\nCSeq: 1 INVITE\nFrom: <sip:a>\nTo: <sip:b>\nm=audio 7000 RTP/AVP 0\n"
    remarks = spark.createDataFrame([(900, 0, k, 0, "INVITE sip:b SIP/2.0", body.format(f"c{k}")) for k in range(30)], "session_id long, file_seq long, at long, direction int, start_line string, body string")
    t = tables(spark, sessions=s, packets=packets, sip_remarks=remarks)
    where = Conditions(0, 100)
    messages = trackers.sip_messages(t, where)
    rows = trackers.rtp_jitter(messages, t, where).collect()
    assert len(rows) == 30 and {r.streams for r in rows} == {n}
    own = []
    for k in range(n):
        gaps = [10**9, (2 + k % 3) * 10**9]
        mean = sum(gaps) // 2
        own.append(sum(abs(g - mean) for g in gaps) // 2)
    assert {r.jitter for r in rows} == {sum(own) // n}
    summary = trackers.voip_summary(messages, trackers.sip_rtt(messages), trackers.rtp_jitter(messages, t, where)).collect()
    assert {r.rtpjitter for r in summary} == {sum(own) // n}


def test_ranking_with_rollup_equals_raw(spark):
    s = spark.createDataFrame([session(k, 10 + k % 3, 20 + k % 2, dport=80 + k % 2, last=700) for k in range(6)], model.SESSION_SCHEMA)
    facts = spark.createDataFrame([(k % 6, at, at % 7, k) for k, at in enumerate(range(0, 700, 3))], model.TRAFFIC_SCHEMA)
    t = tables(spark, sessions=s, bps=facts)
    for where in (Conditions(13, 601), Conditions(13, 601, ports=((81, 90),), payload_protocol=6), Conditions(100, 150)):
        raw = topn.totals(t, "bytes", "service", where).drop("l7").where("port >= 81" if where.ports else "true")
        mixed = rollup.ranking_with_rollup(t, rollup.per_minute(t, "bytes", "service", Conditions(0, 999)), "bytes", where)
        assert sorted(map(tuple, raw.collect())) == sorted(map(tuple, mixed.collect()))


def test_payload_in_packet_order(spark):
    rows = [(1, 1, 5, 2, 1, bytearray(b"world")), (1, 1, 5, 1, 0, bytearray(b"hello ")), (1, 0, 6, 0, 2, bytearray(b"back")), (2, 1, 1, 1, 3, bytearray(b"no"))]
    packets = spark.createDataFrame(rows, "session_id long, small_to_big int, second long, ns long, idx long, payload binary")
    assert {r.small_to_big: bytes(r.payload) for r in flows.payload_stream(packets, 1).collect()} == {1: b"hello world", 0: b"back"}
