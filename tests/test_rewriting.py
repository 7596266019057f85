"""Answers from stored rollups against answers from facts."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from netlens import model
from netlens.operators import rewriting, rollup, series, topn
from netlens.plans.conditions import Conditions, Network
from netlens.sources.rollups import RollupStore
from netlens.sources.tables import Tables, store

LOW, MIDDLE, HIGH = 0, 1200, 3600
EMPTY = {
    "tag_ip": "tag string, ip_hex string", "fqdns": "name string, ip_hex string", "user_apps": "name string, ips string, port int", "session_vlan": "session_id long, tag int", "session_mpls": "session_id long, tag int",
    "http_remarks": "session_id long, file_seq long, content string", "dns_remarks": "session_id long, file_seq long, content string", "icmp_packets": "file_seq long, idx long, session_id long, second long, ns long, type long, code long",
    "session_ip6": "session_id long, src_ip6 string, dst_ip6 string",
}


@pytest.fixture(scope="module")
def tables(spark):
    """Sessions of an hour, with facts all over them and some timeouts behind their ends."""
    rng = random.Random(8)
    sessions, bps, rtts, rsts, gone, six, vlan = [], [], [], [], [], [], []
    for k in range(120):
        first = rng.randrange(0, 3500)
        last = min(3599, first + rng.choice([0, 5, 70, 900]))
        row = (k, 10 + k % 5, 20 + k % 3, 1000 + k, (80, 443, 53)[k % 3], 2048, k % 2, (6, 17)[k % 2], first, 0, last, 0, (2, 0, 1, 7)[k % 4], 2, 0)
        sessions.append(row)
        for at in {first, last, *(rng.randint(first, last) for _ in range(3))}:
            bps.append((k, at, rng.randrange(0, 500), rng.randrange(0, 500)))
            rtts.append((k, at, 0, rng.randrange(2), rng.choice([-1, 7, 10**6, 10**10])))
            rsts.append((k, at, 0, rng.randrange(2), 0))
        if k % 4 == 0:
            gone.append((*row, last + 72, 0))
        if k % 3 == 0:
            six.append((k, f"20010db8{k % 2:024d}", "fe80" + "0" * 28))
        vlan.append((k, k % 4))
    made = Tables(spark, lambda self, name: spark.createDataFrame([], EMPTY[name]))
    made["sessions"] = spark.createDataFrame(sessions, model.SESSION_SCHEMA).cache()
    for name in ("bps", "pps"):
        made[name] = spark.createDataFrame(bps, model.TRAFFIC_SCHEMA).cache()
    made["rtts"] = spark.createDataFrame(rtts, model.MARKER_SCHEMA).cache()
    for name in ("tcp_rsts", "tcp_misc", "tcp_dupacks", "tcp_retransmissions"):
        made[name] = spark.createDataFrame(rsts, model.MARKER_SCHEMA).cache()
    made["timeouts"] = spark.createDataFrame(gone, model.SESSION_SCHEMA + ", marker_second long, marker_ns long").cache()
    made["session_ip6"] = spark.createDataFrame(six, EMPTY["session_ip6"])
    made["session_vlan"] = spark.createDataFrame(vlan, EMPTY["session_vlan"])
    made["tag_ip"] = spark.createDataFrame([("office", "0000000a"), ("office", "0000000b"), ("six", "20010db8" + "0" * 24)], EMPTY["tag_ip"])
    made["user_apps"] = spark.createDataFrame([("wiki", "00000014", 80)], EMPTY["user_apps"])
    return made


@pytest.fixture(scope="module")
def built(spark, tables, tmp_path_factory):
    """Rollups of two builds; the second continues the first."""
    out = RollupStore(spark, str(tmp_path_factory.mktemp("rollups")), "f")
    names = ("seconds", "flows", "signature_seconds", "signature_flows", "pairs", "icmp")
    rewriting.build(out, tables, LOW, MIDDLE, names)
    rewriting.build(out, tables, MIDDLE, HIGH, names)
    return out


def rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


RANGES = [(13, 3544), (1100, 1333), (3000, 4000)]
ASKED = {
    "none": {}, "ips": dict(ips=(Network(10),)), "inside": dict(ips=(Network(8, 0xFFFFFFF8), Network(20)), include_external=False), "six": dict(ips=(Network.parse("2001:db8::/112"),)), "protocol": dict(payload_protocol=17),
    "l7": dict(l7=2), "vlan": dict(vlans=(1,)), "ports": dict(ports=((443, 443),)), "server_ports": dict(server_ports=((443, 500),)), "tag": dict(tags=("office",)), "tag6": dict(tags=("six",)), "app": dict(apps=("wiki",)),
    "both": dict(tags=("office",), ips=(Network(20),)), "excluded": dict(excluded=((11, None), (10, 21))),
}


@pytest.mark.parametrize("low, high", RANGES)
def test_series_equal_facts(spark, tables, built, low, high):
    where = Conditions(low, high)
    for metric in ("bps", "pps", "averagelatency", "flowcounts", "timeoutcounts", "tcprsts"):
        assert rows(rewriting.per_second(built, tables, metric, where)) == rows(rewriting._raw_series(tables, metric, where)), metric


@pytest.mark.parametrize("name", ASKED)
def test_filters_equal_facts(spark, tables, built, name):
    where = Conditions(13, 3544, **ASKED[name])
    answers = rewriting.Rewriter(built, tables)
    covered = {"both": True, "vlan": False, "ports": False}.get(name, True)
    assert (answers.plan("bytes", where).rollup == "pairs") is covered
    assert rows(answers.ranking("bytes", "service", where)) == rows(topn.ranking(tables, "bytes", "service", where))
    signature = rewriting.plan_series(built, tables, "bps", where).rollup
    assert signature == {"none": "seconds", "tag": "signature_seconds", "tag6": "signature_seconds", "app": "signature_seconds"}.get(name)
    assert rows(rewriting.per_second(built, tables, "bps", where)) == rows(series.bps(tables, where))


@pytest.mark.parametrize("low, high", RANGES)
def test_rankings_equal_facts(spark, tables, built, low, high):
    where, answers = Conditions(low, high), rewriting.Rewriter(built, tables)
    for base, grain in (("timeouts", "service"), ("tcprsts", "source"), ("tcpportsreused", "destination"), ("packets", "destination")):
        assert rows(answers.ranking(base, grain, where)) == rows(topn.ranking(tables, base, grain, where)), base
    grain = topn.GRAINS[low % 3]
    assert rows(answers.latencies(grain, where)) == rows(topn.latencies(tables, grain, where)), grain


def test_old_functions_do_not_drop_conditions(spark, tables):
    seconds, minutes = rollup.per_second(tables, Conditions(0, 3599)), rollup.per_minute(tables, "bytes", "service", Conditions(0, 3599))
    for name in ("l7", "vlan", "tag", "six", "ports", "app"):
        where = Conditions(13, 3544, **ASKED[name])
        assert rows(rollup.series_with_rollup(tables, seconds, "bps", where)) == rows(series.bps(tables, where)), name
        raw = topn.totals(tables, "bytes", "service", where).drop("l7").orderBy(F.desc("value"), *topn.names("service")).limit(100)
        assert rows(rollup.ranking_with_rollup(tables, minutes, "bytes", where)) == rows(raw), name
        with pytest.raises(ValueError, match="key has no"):
            rollup.key_filter(minutes, where)
    with pytest.raises(ValueError, match="whole minutes"):
        rollup.answer(minutes, ["ip"], "hits", Conditions(13, 3544))


def test_plan_reads_stored_files(spark, tables, built):
    where = Conditions(0, 3599, l7=2)
    files = rewriting.Rewriter(built, tables).totals(tables, "bytes", "service", where).inputFiles()
    assert files and all("/pairs/feed=f/hour=0/" in f for f in files)
    assert rewriting.plan(built, tables, "pairs", Conditions(0, 3599, vlans=(1,))).reason == "pairs has no vlans in its key"
    assert rewriting.plan(built, tables, "pairs", Conditions(0, 100)).reason == "less than two stored minutes"
    assert rewriting.plan(built, tables, "dns", Conditions(0, 3599)).reason == "dns has not been built"


def test_facts_of_a_store_are_read_for_head_and_tail_only(spark, tables, tmp_path):
    root = str(tmp_path / "facts")
    moved = Tables(spark, lambda self, name: tables[name])
    moved["sessions"] = spark.createDataFrame([(1, 1, 2, 1000, 80, 2048, 1, 6, 0, 0, 40000, 0, 2, 2, 0)], model.SESSION_SCHEMA)
    moved["bps"] = spark.createDataFrame([(1, at, 3, 4) for at in range(0, 40000, 500)], model.TRAFFIC_SCHEMA)
    store(moved, root, "f", ["bps", "sessions"])
    opened = Tables.stored(spark, root, "f", 30, 39999)
    for name in EMPTY:
        opened[name] = tables[name]
    out = RollupStore(spark, str(tmp_path / "rollups"), "f")
    empty = {n: tables[n].limit(0) for n in ("rtts", "tcp_rsts", "tcp_misc", "tcp_dupacks", "tcp_retransmissions", "timeouts", "pps")}
    for name, table in empty.items():
        opened[name] = moved[name] = table
    rewriting.build(out, moved, 0, 36000, ("pairs",))
    answer = rewriting.Rewriter(out, opened).totals(opened, "bytes", "service", Conditions(30, 39999))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    scans = re.findall(r"FileScan parquet \[session_id[^\n]*small_to_big[^\n]*PartitionFilters: \[([^\]]*)\]", answer._jdf.queryExecution().executedPlan().toString())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    hours = [tuple(map(int, re.findall(r"hour#\d+L? [<>]= (\d+)", s))) for s in scans]
    assert sorted(hours) == [(0, 0), (10, 11)]
    assert rows(answer) == rows(topn.totals(opened, "bytes", "service", Conditions(30, 39999)))


def test_builds_follow_each_other_and_can_be_repeated(spark, tables, tmp_path):
    out = RollupStore(spark, str(tmp_path), "f")
    frame = spark.createDataFrame([(k * 60, k) for k in range(200)], "minute long, n long")
    part = lambda a, b: frame.where(F.col("minute").between(a, b - 1))
    out.build(0, 7200, {"x": (part(0, 7200), "minute")})
    with pytest.raises(ValueError, match="next build begins there"):
        out.build(7260, 9000, {"x": (part(7260, 9000), "minute")})
    with pytest.raises(ValueError, match="whole minutes"):
        out.build(7200, 7230, {"x": (part(0, 60), "minute")})
    # a build that failed before it was noted: its rows are not read, and a repetition replaces them
    noting, out._note = out._note, lambda rows: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        out.build(7200, 10800, {"x": (part(7200, 10800), "minute")})
    out._note = noting
    assert out.covered("x") == (0, 7200) and out.read("x", 0, 12000).count() == 120
    out.build(7200, 10800, {"x": (part(7200, 10800), "minute")})
    assert out.covered("x") == (0, 10800) and sorted(r.n for r in out.read("x", 0, 12000).collect()) == list(range(180))
    assert out.read("x", 3600, 7200).count() == 60
    assert out.expire(1) == {"x": [0]}
    assert out.covered("x") == (3600, 10800) and out.covered("y") is None


def test_signatures_are_backfilled_and_dropped(spark, tables, tmp_path):
    """A new tag is built over the past, a vanished one loses its folders, and no other file is touched."""
    import glob
    import os

    moved = Tables(spark, lambda self, name: tables[name])
    out = RollupStore(spark, str(tmp_path), "f")
    for low, high in ((LOW, MIDDLE), (MIDDLE, HIGH)):
        rewriting.build(out, moved, low, high, rewriting.SIGNED)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/signature_*/**/*.parquet", recursive=True)}
    ask = lambda tag: Conditions(13, 3544, tags=(tag,))
    assert rewriting.maintain_signatures(out, moved) == (set(), set())
    before = files()
    moved["tag_ip"] = spark.createDataFrame([("lab", "0000000c"), ("lab", "0000000e"), ("six", "20010db8" + "0" * 24)], EMPTY["tag_ip"])
    assert rewriting.plan_series(out, moved, "bps", ask("lab")).rollup is None
    new, gone = rewriting.maintain_signatures(out, moved)
    assert len(new) == len(gone) == 1
    after = files()
    assert {f for f in before if f not in after} == {f for f in before if f"signature={next(iter(gone))}" in f} != set()
    assert {f for f in after if f not in before} == {f for f in after if f"signature={next(iter(new))}" in f} != set()
    assert all(after[f] == before[f] for f in after if f in before)
    for metric, name in (("bps", "signature_seconds"), ("flowcounts", "signature_flows")):
        for tag in ("lab", "six"):
            assert rewriting.plan_series(out, moved, metric, ask(tag)).rollup == name
            assert rows(rewriting.per_second(out, moved, metric, ask(tag))) == rows(rewriting._raw_series(moved, metric, ask(tag))), (metric, tag)
    # the old tag comes back: its folders are built anew
    moved["tag_ip"] = tables["tag_ip"]
    assert rewriting.plan_series(out, moved, "bps", ask("office")).rollup is None
    assert rewriting.maintain_signatures(out, moved) == (gone, new)
    assert rows(rewriting.per_second(out, moved, "bps", ask("office"))) == rows(series.bps(moved, ask("office")))


def test_levels_of_parts_add_up(spark, tables):
    s = tables["sessions"]
    whole = rewriting.flow_levels(s, 600, 3000)
    parts = rewriting.flow_levels(s.where("session_id % 3 = 0"), 600, 3000).unionByName(rewriting.flow_levels(s.where("session_id % 3 <> 0"), 600, 3000))
    second = F.col("timestamp").between(600, 2999) & (F.col("value") != 0)
    raw = rows(series.flow_counts(tables, Conditions(600, 2999)).where(second))
    assert rows(rewriting.alive(whole).where(second)) == raw
    assert rows(rewriting.alive(rewriting.merged_levels(parts)).where(second)) == raw
    by = rewriting.flow_levels(s, 600, 3000, ("dst_port",))
    for port in (80, 443, 53):
        own = Tables(spark, lambda self, name: None)
        own["sessions"] = s.where(F.col("dst_port") == port)
        assert rows(rewriting.alive(by.where(F.col("dst_port") == port)).where(second)) == rows(series.flow_counts(own, Conditions(600, 2999)).where(second))


def test_all_grains_in_one_pass(spark, tables):
    where = Conditions(0, 3599)
    every = rewriting.pairs(tables, where).cache()
    for metric in ("bytes", "timeouts", "tcpportsreused", "latencies"):
        for grain in topn.GRAINS:
            found = every.where((F.col("grain") == grain) & (F.col("metric") == metric))
            keys = [F.col("ip2").alias("ip"), "port"] if grain == "destination" else topn.names(grain)
            old = rollup.per_minute(tables, metric, grain, where)
            if metric == "latencies":
                sums = [F.sum(F.when(F.col("direction") == 1, F.col(c)).otherwise(0)).cast("long").alias(f"{n}0") for c, n in (("value", "n"), ("d", "d"))]
                sums += [F.sum(F.when(F.col("direction") == 0, F.col(c)).otherwise(0)).cast("long").alias(f"{n}1") for c, n in (("value", "n"), ("d", "d"))]
            else:
                sums = [F.sum("value").cast("long").alias("value")]
            mine = found.withColumn("k", F.struct(*keys)).groupBy("minute", "k").agg(*sums).select("minute", "k.*", *[s for s in (["n0", "d0", "n1", "d1"] if metric == "latencies" else ["value"])])
            assert rows(mine) == rows(old), (metric, grain)
    every.unpersist()


# ---------------------------------------------------------------- HTTP pairs over minute edges


def http(spark, lines):
    """Tables of one HTTP session for each list of blocks: (second, 'GET' or a status), each block in a file of its own."""
    text = {True: "HttpRequest={at} GET /p{k}\nRaw=\nHost: h\nHttpEnd=Request\n", False: "HttpResponse={at} {code} X\nRaw=\nHttpEnd=Response\n"}
    base, rows_, sessions = 10**9, [], []
    for sid, blocks in enumerate(lines):
        for k, (second, what) in enumerate(blocks):
            at = (base + second) * 10**9
            rows_.append((sid, k, text[what == "GET"].format(at=at, k=k, code=what)))
        sessions.append((sid, 1, 2, 1000, 80, 2048, 1, 6, base + blocks[0][0], 0, base + blocks[-1][0], 0, 2, 2, 0))
    made = Tables(spark, lambda self, name: spark.createDataFrame([], EMPTY[name]))
    made["sessions"] = spark.createDataFrame(sessions, model.SESSION_SCHEMA)
    made["http_remarks"] = spark.createDataFrame(rows_, EMPTY["http_remarks"])
    return made, base


LINES = [
    [(59, "GET"), (61, 404)],  # over a minute edge
    [(5, "GET"), (6, 200), (58, "GET"), (59, "GET"), (62, 500), (63, 501)],  # the first GET at 58 has no answer, 501 no request
    [(50, "GET"), (119, "GET"), (121, "GET"), (122, 503), (170, 404)],  # a whole minute between an open request and a stray response
    [(200, "GET"), (239, 404), (239, "GET"), (300, 410)],
    [(230, "GET"), (245, 404)],
]


def test_pairs_over_minute_edges_count_once(spark, tmp_path):
    tables, base = http(spark, LINES)
    low = base // 60 * 60
    out = RollupStore(spark, str(tmp_path / uuid.uuid4().hex), "f")
    for k in range(5):
        rewriting.build(out, tables, low + 60 * k, low + 60 * (k + 1), ("http_blocks",))

    def plain(first, last):
        want = []
        for sid, blocks in enumerate(LINES):
            for (at, what), (_, code) in zip(blocks[:-1], blocks[1:], strict=True):
                if what == "GET" and code != "GET" and code >= 400 and first <= base + at <= last:
                    want.append((base + at, code))
        return sorted(want)

    for first, last in ((low, low + 359), (base + 3, base + 215), (base + 59, base + 260), (base + 60, base + 240), (base, base + 50)):
        got = rewriting.failed_requests(out, tables, Conditions(first, last)).select((F.col("requestat") / 10**9).cast("long"), "status").collect()
        assert sorted(map(tuple, got)) == plain(first, last), (first, last)
