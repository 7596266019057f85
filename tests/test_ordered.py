"""Ordered scans in blocks of time, the packet match, and stores of rows without a time, against plain code."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens import model
from netlens.operators import flows, trackers
from netlens.plans.conditions import Conditions
from netlens.sources.tables import Tables, store

KINDS = "file_seq long, session_id long, tcp_seq long, tcp_ack long, saved_length long, status int, small_to_big int, timestamp long, idx long"


def test_packet_match_equals_all_pairs(spark):
    rng = random.Random(3)
    window = 1000
    near = [(0, rng.choice([1, 1, 1, 2, None]), rng.randrange(2), 0, 60, 0, 1, rng.randrange(0, 12000), k) for k in range(300)]
    far = [(0, rng.choice([1, 1, 1, 2, None]), rng.randrange(2), 0, 60, 0, 1, rng.randrange(-2000, 14000), k) for k in range(120)]
    far += [(*n[:7], n[7] + rng.choice([0, window, -window, window + 1]), 900 + k) for k, n in enumerate(near[:40])]
    got = {r.idx: (r.status, r.latency) for r in flows.packet_loss_latency(spark.createDataFrame(near, KINDS), spark.createDataFrame(far, KINDS), window).collect()}
    for n in near:
        gaps = [f[7] - n[7] for f in far if f[1:7] == n[1:7] and None not in f[1:7] and abs(f[7] - n[7]) <= window]
        ahead, behind = [g for g in gaps if g >= 0], [-g for g in gaps if g < 0]
        want = ("FORWARD", min(ahead)) if ahead else ("REVERSE", min(behind)) if behind else ("LOST", -1)
        assert got[n[8]] == want, n


def test_equal_packets_do_not_pair_up(spark):
    """3,000 equal packets on both sides give no more rows than there are packets."""
    rows = [(0, 1, 7, 0, 60, 0, 1, k * 1_000_000, k) for k in range(3000)]
    near, far = (spark.createDataFrame(rows, KINDS) for _ in range(2))
    out = flows.packet_loss_latency(near, far)
    assert out.groupBy("status", "latency").count().collect()[0][:3] == ("FORWARD", 0, 3000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join LeftOuter", plan)) == 2 and "block" in plan


def test_ordered_scans_in_blocks_equal_one_window(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(rng.randrange(3), s := rng.randrange(0, 900), rng.randrange(5), k, rng.randrange(4)) for k in range(500)], "k long, second long, ns long, v long, mark int").cache()
    order = ["second", "ns", "v"]
    lag = rows.withColumn("before", F.lag("v").over(W.partitionBy("k").orderBy(*order)))
    mine = flows.lag_in_blocks(rows, ["k"], order, "v", F.col("second"))
    same = lambda a, b: sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect()))
    assert same(lag, mine)
    t = rows.withColumn("t", F.struct("second", "ns"))
    total = t.withColumn("total", F.sum("mark").over(W.partitionBy("k").orderBy("t")))
    assert same(total, flows.running_sum_in_blocks(t, ["k"], "t", "mark", F.col("second")))


def test_jitter_of_one_long_session_is_split_and_exact(spark):
    """Round trips of one session over many minutes, whose squares do not fit 64 bits."""
    rng = random.Random(2)
    tails = [(s, rng.randrange(0, 10**10)) for s in range(0, 6000, 7)]
    t = Tables(spark, lambda self, name: spark.createDataFrame([], model.TRAFFIC_SCHEMA))
    t["sessions"] = spark.createDataFrame([(1, 1, 2, 1000, 80, 2048, 1, 6, 0, 0, 6000, 0, 0, 2, 0)], model.SESSION_SCHEMA)
    t["rtts"] = spark.createDataFrame([(1, s, 0, 1, v) for s, v in tails], model.MARKER_SCHEMA)
    (row,) = flows.jitter(t, Conditions(0, 6000)).collect()
    v = [abs(b[1] - a[1]) for a, b in zip(tails[:-1], tails[1:], strict=True)]
    mean = sum(v) // len(v)
    assert (row.jitter, row["count"], row.deviation) == (mean, len(v), int((sum((x - mean) ** 2 for x in v) // len(v)) ** 0.5))
    plan = flows.jitter(t, Conditions(0, 6000))._jdf.queryExecution().optimizedPlan().toString()
    scans = re.findall(r"Window \[lag\(tail[^\n]*", plan)
    assert scans and all("block" in s for s in scans)


@pytest.mark.parametrize("low, high", [(0, 3599), (3600, 7199), (7200, 10799), (3000, 9000)])
def test_remarks_are_read_by_hours_and_once(spark, tmp_path, low, high):
    spans = {1: (100, 200), 2: (3500, 3700), 3: (3600, 9000), 4: (8000, 8100)}
    t = Tables(spark, lambda self, name: None)
    t["sessions"] = spark.createDataFrame([(k, 1, 2, 1000, 80, 2048, 1, 6, a, 0, b, 0, 2, 2, 0) for k, (a, b) in spans.items()], model.SESSION_SCHEMA)
    t["http_remarks"] = spark.createDataFrame([(k, f, f"HttpRequest={1_700_000_000 + f}000000000 GET /{k}\nHttpEnd=Request\n") for k in spans for f in range(2)], "session_id long, file_seq long, content string")
    t["icmp_packets"] = spark.createDataFrame([(0, k, k, a, 0, 3, 3) for k, (a, _) in spans.items()], "file_seq long, idx long, session_id long, second long, ns long, type long, code long")
    store(t, str(tmp_path), "f", ["sessions", "http_remarks", "icmp_packets"])
    back = Tables.stored(spark, str(tmp_path), "f", low, high)
    hours = range(low // 3600, high // 3600 + 1)
    touching = sorted(k for k, (a, b) in spans.items() if any(a // 3600 <= h <= b // 3600 for h in hours))
    assert sorted((r.session_id, r.file_seq) for r in back["http_remarks"].collect()) == [(k, f) for k in touching for f in range(2)]
    assert sorted(r.session_id for r in back["icmp_packets"].collect()) == sorted(k for k, (a, _) in spans.items() if a // 3600 in hours)
    records = sorted(r.sessionid for r in trackers.http_records(back, Conditions(low, high)).collect())
    assert records == sorted(k for k, (a, b) in spans.items() if b >= low and a <= high for _ in range(2))
    assert Tables.stored(spark, str(tmp_path), "f")["http_remarks"].count() == 8
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = Tables.stored(spark, str(tmp_path), "f", low, high)["http_remarks"]._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(rf"PartitionFilters: \[[^\]]*hour#\d+L? >= {low // 3600}\)[^\]]*hour#\d+L? <= {high // 3600}\)", plan)


def test_aliases_of_version_6_equal_the_first_network_that_holds_them(spark):
    import ipaddress

    from netlens.operators import dashboard

    rng = random.Random(11)
    base = int(ipaddress.IPv6Address("2001:db8::"))
    nets = []
    for k in range(40):
        length = rng.choice([0, 1, 3, 32, 47, 48, 63, 64, 101, 126, 127, 128])
        own = ipaddress.IPv6Network(((base + rng.getrandbits(rng.choice([4, 20, 64, 90]))), length), strict=False)
        nets.append((own, rng.choice([0, 0, 53]), f"n{k}", k))
    ips = [base + rng.getrandbits(rng.choice([3, 20, 64, 90])) for _ in range(150)] + [0, (1 << 128) - 1]
    table = spark.createDataFrame([(n.network_address.packed.hex(), n.prefixlen, p, a, o) for n, p, a, o in nets[5:]], "ip6 string, length int, port int, alias string, ord int")
    rows = spark.createDataFrame([(f"{ip:032x}", rng.choice([53, 80])) for ip in ips] + [(None, 53)], "ip6 string, port int")
    for port in (None, "port"):
        for r in dashboard.alias_of6(rows, table, "ip6", port).collect():
            ok = [a for n, p, a, _ in nets[5:] if r.ip6 and ipaddress.IPv6Address(bytes.fromhex(r.ip6)) in n and (p == 0 or (port and p == r.port))]
            assert r.alias == (ok[0] if ok else ""), r
    assert [r.alias for r in dashboard.alias_of6(rows, table.limit(0), "ip6").distinct().collect()][:1] == [""]


def test_steps_of_root_following_leave_one_table(spark):
    import glob
    import os

    from netlens.sources.rollups import shared_folder

    base = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/netlens/step-*"))
    chain = [("h", f"/{k}", f"http://h/{k - 1}" if k else "", k) for k in range(40)]
    records = spark.createDataFrame([(k, 1, h, p, r, k, k + 1, 200) for h, p, r, k in chain], "sessionid long, client_ip long, host string, path string, referer string, requestat long, responseat long, status int")
    roots = trackers.transaction_roots(records)
    assert {r.root for r in roots.collect()} == {"http://h/0"}
    assert len(set(glob.glob(f"{base}/netlens/step-*")) - before) == 1 and os.path.isdir(base)
