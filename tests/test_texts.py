"""Long texts in pieces, records outside their file, retention by age and size, entries of user apps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from netlens import model
from netlens.operators import flows, stores, texts
from netlens.sources.sessions import within_files
from netlens.sources.tables import Tables, drop_old_data, store


@pytest.mark.parametrize(
    ("pattern", "longest"),
    [("status|POST /|404", 6), ("a{2,5}b?", 6), ("(ab|c)\\1", 4), ("", 0), ("a.*b", None), ("^a", None), ("a\\b", None), ("(?=a)b", None), ("x(?<!y)z", None), ("\\p{L}", None), ("[", None), ("a{0,2000000}", None)],
)
def test_longest_match(pattern, longest):
    assert texts.longest_match(pattern) == longest


@pytest.mark.parametrize("pattern", ["abca", "(a|b){3}c", "c{4,7}", "", "aa.cc", "b\nb", "^ab", "ac.*ca"])
def test_pieces_match_as_the_whole_text(spark, pattern):
    """Sessions of many short rows, repeated rows, rows far longer than a piece, empty and null texts."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc\n") for _ in range(n))
    rows = [(s, rng.randrange(0, 300), word(rng.choice([0, 1, 2, 5]))) for s in range(25) for _ in range(rng.randrange(1, 30))]
    rows += rows[::7] + [(90, 1, word(700)), (90, 2, "abc"), (91, 0, ""), (92, 3, None), (93, 0, "x" * 63 + "abca"), (94, None, "ab"), (94, 0, "ca"), (None, 1, "abca")]
    whole = {}
    for s, _, t in sorted(((s, -1 if f is None else f, t or "") for s, f, t in rows if s is not None)):
        whole[s] = whole.get(s, "") + t
    # . of the JVM stops at line ends, as does that of Python
    want = {s for s, t in whole.items() if re.search(pattern, t)}
    df = spark.createDataFrame(rows, "session_id long, file_seq long, content string")
    for size in (1, 7, 64, texts.PIECE):
        assert {r.session_id for r in texts.matching(df.where("session_id IS NOT NULL"), pattern, size).collect()} == want, size


def test_pieces_put_together_are_the_text(spark):
    rows = [(1, k * 37 % 500, f"<{k}>" * (k % 4)) for k in range(200)] + [(2, 0, "y" * 1000), (3, 0, "")]
    df = spark.createDataFrame(rows, "session_id long, file_seq long, content string")
    whole = {s: "".join(t for _, t in sorted((f, t) for x, f, t in rows if x == s)) for s in (1, 2, 3)}
    for size, overlap in ((1, 0), (10, 3), (64, 200)):
        got = {}
        for r in texts.pieces(df, ["session_id"], ["file_seq"], F.col("content"), size, overlap).collect():
            got[r.session_id, r.piece] = r.content
        for s, t in whole.items():
            count = max(1, -(-len(t) // size))
            assert [got.pop((s, k)) for k in range(count)] == [t[k * size : k * size + size + overlap] for k in range(count)]
        assert not got


def test_no_group_of_a_long_session_has_more_than_a_piece(spark):
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("file_seq"), F.lit("0123456789").alias("content"))
    cut = texts.pieces(rows, ["session_id"], ["file_seq"], F.col("content"), 1000, 8)
    assert cut.agg(F.count("*"), F.max(F.length("content"))).collect()[0][:] == (40, 1008)
    assert texts.matching(rows, "98|90123").count() == 1 and texts.matching(rows, "98").count() == 0
    assert flows.data_streams_matching(spark.createDataFrame([(1,), (2,)], "sessionid long"), rows, "901").collect()[0].sessionid == 1


def test_payload_parts_and_heads(spark):
    rng = random.Random(8)
    rows = [(s, rng.randrange(0, 500), rng.randrange(9), k, rng.randrange(2), rng.choice([None, b"", bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40)))])) for s in (1, 2) for k in range(150)]
    df = spark.createDataFrame(rows, "session_id long, second long, ns long, idx long, small_to_big int, payload binary")
    whole = {(s, d): b"".join(r[5] for r in sorted(rows, key=lambda r: r[1:4]) if r[0] == s and r[4] == d and r[5]) for s in (1, 2) for d in (0, 1)}
    parts = sorted(texts.payload_parts(df, 97).collect(), key=lambda r: r.part)
    assert {k: b"".join(bytes(r.payload) for r in parts if (r.session_id, r.small_to_big) == k) for k in whole} == whole
    assert all(len(r.payload) <= 97 for r in parts)
    assert {(r.session_id, r.small_to_big): r.payloadhead for r in texts.payload_heads(df, 50).collect()} == {k: v[:50].hex().upper() for k, v in whole.items()}


def test_records_outside_their_file_are_dropped(spark):
    """A record that ends before its file begins, or begins after it ends, has a broken clock; touching is inside."""
    record = lambda s, first, last, file: (s, 1, 2, 3, 4, 2048, 1, 6, first, 0, last, 0, 0, 2, file)
    parts = spark.createDataFrame([record(1, 50, 150, 1), record(2, 0, 99, 1), record(3, 200, 300, 1), record(4, 199, 300, 1), record(5, 0, 100, 1), record(6, 0, 5, 9), record(7, 0, 5, None)], model.SESSION_SCHEMA)
    files = spark.createDataFrame([(1, 100, 199)], "file_seq long, second_from long, second_to long")
    assert sorted(r.session_id for r in within_files(parts, files).collect()) == [1, 4, 5, 6, 7]  # files without a range keep theirs


def test_a_store_leaves_out_records_outside_their_file(spark, tmp_path):
    t = Tables(spark, lambda self, name: spark.createDataFrame([], model.SESSION_SCHEMA))
    t["sessions"] = spark.createDataFrame([(s, 1, 2, 3, 4, 2048, 1, 6, first, 0, last, 0, 0, 2, 1) for s, first, last in ((1, 3700, 3800), (2, 9000, 9100))], model.SESSION_SCHEMA)
    t["files"] = spark.createDataFrame([(1, 3600, 7199)], "file_seq long, second_from long, second_to long")
    store(t, str(tmp_path), "f", ["sessions", "files"])
    read = lambda **more: sorted(r.session_id for r in Tables.stored(spark, str(tmp_path), "f", 3600, 10800, **more)["sessions"].collect())
    assert read() == [1, 2] and read(files=True) == [1]


def test_retention_by_age_and_by_size(spark, tmp_path):
    rows = [(f, h, h, "x" * 400) for f in ("a", "b") for h in range(1, 6)]
    for name in ("packets", "bps"):
        spark.createDataFrame(rows, "feed string, hour long, second long, t string").repartition(1).write.partitionBy("feed", "hour").parquet(str(tmp_path / name))
    hours = lambda name: {f: sorted(r.hour for r in spark.read.parquet(str(tmp_path / name)).where(F.col("feed") == f).collect()) for f in ("a", "b")}
    assert drop_old_data(spark, str(tmp_path)) == []
    gone = drop_old_data(spark, str(tmp_path), ages={"a": 2})  # packets of a: three hours up to the newest stay
    assert gone == [("a", 1, "packets"), ("a", 2, "packets")]
    assert hours("packets") == {"a": [3, 4, 5], "b": [1, 2, 3, 4, 5]} and hours("bps")["a"] == [1, 2, 3, 4, 5]
    data = [p for p in tmp_path.rglob("*.parquet") if p.is_file()]  # without the file system's own checksums
    one = sum(p.stat().st_size for p in data if p.parent == tmp_path / "bps" / "feed=a" / "hour=1")
    total = sum(p.stat().st_size for p in data)
    gone = drop_old_data(spark, str(tmp_path), max_bytes=total - one - 1, spare=("b",))  # whole hours, the oldest first, never of b
    assert gone == [("a", 1, "bps"), ("a", 2, "bps")]
    gone = drop_old_data(spark, str(tmp_path), max_bytes=0)
    assert {g[:2] for g in gone} == {("a", 3), ("a", 4), ("a", 5), *(("b", h) for h in range(1, 6))}
    assert not (tmp_path / "bps" / "feed=a").exists()  # a feed without an hour is gone
    assert drop_old_data(spark, str(tmp_path), max_bytes=0) == []


def test_entries_of_user_apps(spark):
    rows = [
        (1, "ok", "0a000001,c0a80000f0".replace("f0", "10"), "443"), (2, "", "0a000001", "1"), (3, "x", None, "1"), (4, "y", "0a000001", "http"), (5, "z", "0a000001", "65536"), (6, "u", "0a00001", "1"),
        (7, "bits", "0a00000118", "0"), (8, "long", "0a00000021", "0"), (9, "six", "20010db8000000000000000000000000" + "20", "0"), (10, "six2", "20010db8000000000000000000000001" + "7f", "0"), (11, "all", "0000000000", "0"),
        (12, "twice", "0a000001", "1"), (13, "twice", "0a000002", "2"), (14, None, "0a000001", "1"), (15, "again", "0a000003", "7"), (16, "again", "0a000003", "no"),
    ]
    got = {r.at: r for r in stores.check_apps(spark.createDataFrame(rows, "at long, name string, ips string, port string")).collect()}
    bad = {2: "no name", 3: "no ips", 4: "no port", 5: "no port", 6: "no address", 7: "host bits", 8: "no address", 10: "host bits", 14: "no name", 16: "no port"}
    assert {k: r.problem for k, r in got.items() if r.problem} == bad
    kept = {r.name: (r.ips, r.port) for r in stores.latest_apps(spark.createDataFrame(rows, "at long, name string, ips string, port string")).collect()}
    assert kept == {"ok": ("0a000001,c0a8000010", 443), "six": ("20010db80000000000000000000000" + "0020", 0), "all": ("0000000000", 0), "twice": ("0a000002", 2), "again": ("0a000003", 7)}
