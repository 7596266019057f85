"""Streams, run to the end of their input, against the batch operators."""

from pyspark.sql import functions as F

from netlens import model
from netlens.operators import trackers
from netlens.operators.events import Trigger
from netlens.streaming import jobs


def traffic(spark, tmp_path, rows):
    for k in range(0, len(rows), 5):
        spark.createDataFrame(rows[k : k + 5], model.TRAFFIC_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return jobs.traffic_stream(spark, f"{tmp_path}/in", files_per_batch=1)


def finish(stream, tmp_path, name):
    jobs.run_to_table(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-c").awaitTermination(120)
    return stream.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_minutes_equal_batch(spark, tmp_path):
    rows = [(1, k * 13, k, 1) for k in range(60)]
    found = {r.minute: r.value for r in finish(jobs.minute_bits(traffic(spark, tmp_path, rows)), tmp_path, "m").collect()}
    want = {}
    for _, second, a, b in rows:
        want[second // 60 * 60] = want.get(second // 60 * 60, 0) + (a + b) * 8
    complete = {k: v for k, v in want.items() if k + 60 <= rows[-1][1] - 60}
    assert complete and complete.items() <= found.items() and found.items() <= want.items()


def test_names_once(spark, tmp_path):
    text = "DnsQuestion=a.example,1,1\nDnsAnswerRRs=a.example,1,0a000001 a.example,28,20010db8000000000000000000000001 a.example,5,xx\n"
    table = spark.createDataFrame([(1, 0, text), (2, 0, text)], "session_id long, file_seq long, content string")
    for _ in range(2):
        table.coalesce(1).write.mode("append").parquet(f"{tmp_path}/remarks")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/remarks")
    found = finish(jobs.learned_names(stream), tmp_path, "n")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, trackers.fqdn_from_dns(table).collect()))
    assert found.count() == 2


def test_watch_keeps_the_window_before(spark, tmp_path):
    sums = spark.createDataFrame([(60, 6000), (120, 5500), (240, 60)], "end long, sum long")
    sums.orderBy("end").coalesce(1).write.parquet(f"{tmp_path}/sums")
    stream = spark.readStream.schema(sums.schema).parquet(f"{tmp_path}/sums")
    under = finish(jobs.watch(stream, Trigger("low", 1, "bps", "under", 60, 50)), tmp_path, "u")
    assert sorted(r.occurredat for r in under.collect()) == [179, 239]
    delta = finish(jobs.watch(stream, Trigger("up", 1, "bps", "delta", 60, 50, 20)), tmp_path, "d")
    assert [r.occurredat for r in delta.where(F.col("type") == "delta").collect()] == [119]
