"""Streams that wait for answers, over input that is split into files, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from netlens import model
from netlens.operators import trackers
from netlens.plans.conditions import Conditions
from netlens.sources.tables import Tables
from netlens.streaming import jobs, pairs

BASE = 1_704_067_200


@pytest.fixture
def timers(spark):
    pairs.use_timers(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def files(spark, folder, rows, schema, size):
    """Rows in files of ``size`` rows, in order of time; a stream reads one file a batch."""
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(stream, tmp_path, name):
    query = jobs.run_to_table(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-c")
    query.awaitTermination(300)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(f"{tmp_path}/{name}"), query


def http_remarks(rng):
    """Remarks by time: requests, most answered, some in another file, some never, some by a second request."""
    out, sessions = [], []
    for sid in range(12):
        at, seq = BASE + rng.randrange(100), 0
        first = at
        for k in range(6):
            request = f"HttpRequest={at}000000000 GET /{sid}/{k}\nRaw=\nHost: h{sid}\nUser-Agent: Chrome/1\nHttpEnd=Request\n"
            answer = f"HttpResponse={at + 2}000000000 {rng.choice([200, 404])} X\nRaw=\nHttpEnd=Response\n"
            kind = rng.randrange(4)
            if kind == 0:
                out.append((at, sid, seq, request + answer))
            else:
                out.append((at, sid, seq, request))
                if kind > 1:
                    seq += 1
                    out.append((at + 2, sid, seq, answer))
            seq += 1
            at += rng.choice([3, 30, 200])
        sessions.append((sid, 1, 2, 1000, 80, 2048, 1, 6, first, 0, at, 0, 2, 2, 0))
    # a late session that moves the watermark on
    out.append((BASE + 9000, 99, 0, f"HttpRequest={BASE + 9000}000000000 GET /end\nRaw=\nHttpEnd=Request\n"))
    return [(sid, seq, text) for _, sid, seq, text in sorted(out)], sessions


def test_http_pairs_equal_batch(spark, tmp_path, timers):
    rows, sessions = http_remarks(random.Random(4))
    schema = "session_id long, file_seq long, content string"
    found, _ = finish(pairs.http_pairs(files(spark, f"{tmp_path}/in", rows, schema, 14)), tmp_path, "out")
    t = Tables(spark, lambda self, name: None)
    t["sessions"] = spark.createDataFrame(sessions, model.SESSION_SCHEMA)
    t["http_remarks"] = spark.createDataFrame(rows, schema)
    batch = trackers.http_records(t, Conditions(BASE, BASE + 8000))
    mine = pairs.with_ends(found, t["sessions"])
    order = sorted(batch.columns)
    got, want = (sorted(map(tuple, x.select(*order).collect())) for x in (mine, batch))
    assert got == want and len(want) == 72 and {r.status for r in batch.collect()} == {0, 200, 404}


def test_http_pairs_out_of_order_and_waiting(spark, tmp_path, timers):
    """Blocks of a session come in the wrong order but in time; a request that still waits is not shown."""
    ask = lambda at, p: f"HttpRequest={BASE + at}000000000 GET /{p}\nRaw=\nHttpEnd=Request\n"
    tell = lambda at: f"HttpResponse={BASE + at}000000000 404 X\nRaw=\nHttpEnd=Response\n"
    rows = [(1, 1, tell(12)), (1, 0, ask(10, "a")), (2, 0, ask(15, "b")), (3, 0, ask(100, "c")), (2, 1, ask(101, "d")), (2, 2, tell(103)), (4, 0, ask(250, "e"))]
    found, _ = finish(pairs.http_pairs(files(spark, f"{tmp_path}/in", rows, "session_id long, file_seq long, content string", 1)), tmp_path, "out")
    assert sorted((r.path, r.status) for r in found.collect()) == [("/a", 404), ("/b", 0), ("/c", 0), ("/d", 404)]


def test_dns_questions_equal_batch(spark, tmp_path, timers):
    rng = random.Random(6)
    asked, gone, sessions = [], [], []
    for sid in range(60):
        at = BASE + sid * 7
        tail = rng.choice(["", "DnsAnswerRRs=a,1,0a000001\n", "DnsException=AnswerCountZero\n", ""])
        asked.append((sid, at, 1 + sid % 3, 2, f"DnsQuestion=q{sid % 5},1,1\n{tail}"))
        row = (sid, 1 + sid % 3, 2, 1000, 53, 2048, 1, 17, at, 0, at + 1, 0, 1, 0, 0)
        sessions.append(row)
        if sid % 3 == 0:
            gone += [(*row, at + 72, 0)] * (1 + sid % 2)
    end = (99, BASE + 5000, 1, 2, "DnsQuestion=end,1,1\n")
    remarks = files(spark, f"{tmp_path}/asked", [*asked, end], "session_id long, second long, client long, server long, content string", 13)
    marks = [(g[0], g[-2]) for g in gone] + [(99, BASE + 5001)]
    timeouts = files(spark, f"{tmp_path}/gone", marks, "session_id long, marker_second long", 9)
    found, _ = finish(pairs.dns_minutes(pairs.dns_questions(remarks, timeouts)), tmp_path, "out")
    t = Tables(spark, lambda self, name: None)
    t["sessions"] = spark.createDataFrame(sessions, model.SESSION_SCHEMA)
    t["dns_remarks"] = spark.createDataFrame([(r[0], 0, r[4]) for r in asked], "session_id long, file_seq long, content string")
    t["timeouts"] = spark.createDataFrame(gone, model.SESSION_SCHEMA + ", marker_second long, marker_ns long")
    t["rtts"] = spark.createDataFrame([], model.MARKER_SCHEMA)
    hits = lambda df: sorted(map(tuple, df.groupBy("status", "query", "client").agg(F.sum("hits").alias("hits")).collect()))
    batch = trackers.dns_sessions(t, Conditions(BASE, BASE + 1000)).withColumn("hits", F.lit(1))
    assert hits(found) == hits(batch) and {r.status for r in found.collect()} == {"RESOLVED", "ZEROANSWER", "REQUESTONLY", "TIMEOUT"}


def test_names_are_learned_once_with_a_bounded_state(spark, tmp_path, timers):
    """A pair that comes back long after its state is gone is known from the table."""
    rows = [(BASE + k * 600, f"DnsQuestion=a,1,1\nDnsAnswerRRs=a{k % 4},1,0a00000{k % 4}\n") for k in range(40)]
    stream = files(spark, f"{tmp_path}/in", rows, "second long, content string", 4)
    query = pairs.learn_names(stream, f"{tmp_path}/names", f"{tmp_path}/c", "10 minutes")
    query.awaitTermination(300)
    assert query.exception() is None
    names = spark.read.parquet(f"{tmp_path}/names")
    assert sorted(map(tuple, names.collect())) == [(f"a{k}", f"0a00000{k}") for k in range(4)]
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 8
    again = pairs.names_once(files(spark, f"{tmp_path}/more", [*rows, (BASE + 90000, "DnsAnswerRRs=b,1,0a0000ff\n")], "second long, content string", 50), names)
    found, _ = finish(again, tmp_path, "fresh")
    assert sorted(map(tuple, found.collect())) == [("b", "0a0000ff")]


def test_lookbacks_move_on_with_every_minute(spark, tmp_path, timers):
    from netlens.streaming import lookbacks

    rng = random.Random(1)
    base = BASE // 60 * 60
    rows = sorted((base + rng.choice([rng.randrange(0, 900), rng.randrange(3000, 4000)]), rng.choice("ab"), rng.choice(["x", "y"])) for _ in range(300))
    rows = [(s, k, second) for second, s, k in rows] + [("end", "x", base + 9000)]
    stream = files(spark, f"{tmp_path}/in", rows, "service string, kind string, second long", 40)
    sizes = (60, 600, 1800)
    found, query = finish(lookbacks.service_counters(stream, lookbacks=sizes), tmp_path, "out")
    got = {(r.service, r.kind, r.end): tuple(r)[3:] for r in found.collect()}
    watermark = base + 9000 - 60
    for service in "ab":
        for kind in "xy":
            own = [t for s, k, t in rows if (s, k) == (service, kind)]
            for end in range(min(own) // 60 * 60 + 60, watermark + 1, 60):
                want = tuple(sum(end - k <= t < end for t in own) for k in sizes)
                assert got.get((service, kind, end), (0,) * 3) == want, (service, kind, end)


def test_results_can_be_read_before_the_scan_ends(spark, tmp_path):
    from netlens.streaming import lookbacks

    sessions = spark.createDataFrame([(k, 1, 2, 1000, 443, 2048, 1, 6, 100 + k, 0, 200, 0, 7, 2, 0) for k in range(10)], model.SESSION_SCHEMA)
    schema = "session_id long, file_seq long, content string"
    rows = [(k % 10, k, f"TLSSNI=host{k}.example\n" if k % 4 else "TLSSNI=bad_name!\n") for k in range(30)]
    counts = []
    stream = files(spark, f"{tmp_path}/in", rows, schema, 6)
    query = lookbacks.as_it_comes(stream, lookbacks.tls_rows(sessions), f"{tmp_path}/out", f"{tmp_path}/c", lambda n: counts.append(lookbacks.so_far(spark, f"{tmp_path}/out").count()))
    query.awaitTermination(120)
    assert query.exception() is None and len(counts) == 5 and 0 < counts[0] < counts[-1]
    t = Tables(spark, lambda self, name: None)
    t["sessions"], t["tls_remarks"] = sessions, spark.createDataFrame(rows, schema)
    want = trackers.tls_rows(t, Conditions(0, 1000))
    mine = lookbacks.first_of_session(lookbacks.so_far(spark, f"{tmp_path}/out"))
    assert sorted(map(tuple, mine.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
