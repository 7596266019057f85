"""Sessions as queries see them: one row each, from records that are spread over files, with the client as source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens import model


def merge_sessions(parts: DataFrame) -> DataFrame:
    """One row for each session of records that are spread over files.

    Times span all records, flags are OR-ed, the last detected protocol wins.  Addresses and ports are those of a record
    with the start flag, the last such in file order, else those of the first record.
    """
    order = F.struct("file_seq", "first_second", "first_ns")
    ends = F.struct("src_ip", "dst_ip", "src_port", "dst_port", "source_is_small")
    syn = F.col("status").bitwiseAND(model.STATUS_SYN) != 0
    out = parts.groupBy("session_id").agg(
        F.min(F.struct("first_second", "first_ns")).alias("first"),
        F.max(F.struct("last_second", "last_ns")).alias("last"),
        F.bit_or("status").cast("int").alias("status"),
        F.coalesce(F.max_by(F.when(F.col("l7") != 0, F.col("l7")), F.when(F.col("l7") != 0, order)), F.lit(0)).alias("l7"),
        F.coalesce(F.max_by(ends, F.when(syn, order)), F.min_by(ends, order)).alias("ends"),
        F.min("ether_type").alias("ether_type"),
        F.min("payload_protocol").alias("payload_protocol"),
        F.min("file_seq").alias("file_seq"),
    )
    return out.select(
        "session_id", "ends.src_ip", "ends.dst_ip", "ends.src_port", "ends.dst_port", "ether_type", "ends.source_is_small", "payload_protocol", F.col("first.first_second"), F.col("first.first_ns"), F.col("last.last_second"), F.col("last.last_ns"), "l7", "status", "file_seq"
    )


def fix_direction(sessions: DataFrame, services: DataFrame) -> DataFrame:
    """Swap source and destination of sessions without a start flag or protocol whose source, but not destination, is a
    known service (ip, port); swapped sessions stay in the result."""
    known = services.select("ip", "port").distinct()
    s = sessions.join(known.select(F.col("ip").alias("a"), F.col("port").alias("b"), F.lit(True).alias("src_known")), (F.col("src_ip") == F.col("a")) & (F.col("src_port") == F.col("b")), "left").drop("a", "b")
    s = s.join(known.select(F.col("ip").alias("a"), F.col("port").alias("b"), F.lit(True).alias("dst_known")), (F.col("dst_ip") == F.col("a")) & (F.col("dst_port") == F.col("b")), "left").drop("a", "b")
    swap = ((F.col("status").bitwiseAND(model.STATUS_SYN) == 0) | (F.col("l7") == 0)) & F.col("src_known").isNotNull() & F.col("dst_known").isNull()
    flip = {"src_ip": "dst_ip", "dst_ip": "src_ip", "src_port": "dst_port", "dst_port": "src_port"}
    new = [F.when(swap, F.col(flip[c])).otherwise(F.col(c)).alias(c) if c in flip else F.when(swap, 1 - F.col(c)).otherwise(F.col(c)).alias(c) if c == "source_is_small" else F.col(c) for c in sessions.columns]
    return s.select(*new)


def learn_services(sessions: DataFrame) -> DataFrame:
    """Known services: the destinations of TCP sessions that show their start flag."""
    return sessions.where((F.col("payload_protocol") == model.TCP) & (F.col("status").bitwiseAND(model.STATUS_SYN) != 0)).select(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")).distinct()


def within_files(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Records that touch the time of their file (file_seq, second_from, second_to): others have a clock that was set while
    they ran.  Records of a file without a range stay.  The list of files is as short as it is to open them."""
    own = files.select(F.col("file_seq").alias("_file"), F.col("second_from").alias("_from"), F.col("second_to").alias("_to"))
    out = parts.join(own, F.col("file_seq") == F.col("_file"), "left")
    outside = (F.col("first_second") > F.col("_to")) | (F.col("last_second") < F.col("_from"))
    return out.where(~F.coalesce(outside, F.lit(False))).select(*parts.columns)


def whole_sessions(parts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Records merged by session and turned to the known services.  A record whose end lies before its begin has a broken
    clock and is dropped, and so is one outside the time of its file where ``files`` are given (:func:`within_files`).  A
    record that is read more than once counts once."""
    parts = parts if files is None else within_files(parts, files)
    merged = merge_sessions(parts.where(F.struct("first_second", "first_ns") <= F.struct("last_second", "last_ns")))
    return fix_direction(merged, learn_services(merged))
