"""Texts and payloads of sessions in pieces of bounded length, however long a session is."""

from __future__ import annotations

import re
import warnings
from re import _constants, _parser  # the widths of a pattern are public nowhere

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens.functions import net

#: Characters of a piece; files, or seconds, of one block of a session in the scan for positions.
PIECE = 1 << 16
BLOCK = 64
#: A pattern with longer matches than this many characters counts as unbounded.
LONGEST = 1 << 20


def _operations(node):
    if isinstance(node, _parser.SubPattern):
        node = node.data
    if isinstance(node, (list, tuple)):
        for part in node:
            yield from _operations(part)
    elif isinstance(node, type(_constants.AT)):
        yield node.name


def longest_match(pattern: str) -> int | None:
    """Characters of the longest match of a pattern.  None: there is no bound, or the pattern looks at what stands beside
    its match (anchors, word boundaries, lookarounds), or has syntax that only the JVM knows."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            parsed = _parser.parse(pattern)
    except (re.error, OverflowError):
        return None
    widest = parsed.getwidth()[1]
    return None if widest > LONGEST or {"AT", "ASSERT", "ASSERT_NOT"} & set(_operations(parsed)) else int(widest)


def placed(rows: DataFrame, keys: list[str], order: list[str], text: Column) -> DataFrame:
    """Rows (keys, t, n, at) with the place ``at`` of their text in the text of their key, in the order of ``order`` and then
    of the text.  Null texts are empty; rows with a null key are left out.

    Lengths are summed inside blocks of the first column of ``order`` (a whole number) and handed on from block to block, so
    the texts of one long session are spread over as many groups as it has blocks."""
    rows = rows.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys))).select(*keys, *order, F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.withColumn("n", F.length("t").cast("long")).withColumn("_block", F.coalesce(net.div(F.col(order[0]), BLOCK).cast("long"), F.lit(-(1 << 60))))
    sums = rows.groupBy(*keys, "_block").agg(F.sum("n").alias("_sum"))
    ahead = F.sum("_sum").over(W.partitionBy(*keys).orderBy("_block")) - F.col("_sum")
    inside = F.sum("n").over(W.partitionBy(*keys, "_block").orderBy(*order, "t").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    out = rows.withColumn("_inside", inside).join(sums.select(*keys, "_block", ahead.alias("_ahead")), [*keys, "_block"])
    return out.select(*keys, "t", "n", (F.col("_inside") + F.col("_ahead")).alias("at"))


def _joined(at: Column, text: Column) -> Column:
    """Texts of a group in the order of their places; empty ones take no room."""
    found = F.array_sort(F.collect_list(F.when(text != "", F.struct(at.alias("at"), text.alias("t")))))
    return F.array_join(F.transform(found, lambda x: x["t"]), "")


def pieces(rows: DataFrame, keys: list[str], order: list[str], text: Column, size: int = PIECE, overlap: int = 0) -> DataFrame:
    """(keys, piece, content): piece k has the characters of a key's text from ``k * size`` on, ``size + overlap`` at most.
    A key with empty texts only has one empty piece."""
    place, n = F.col("at"), F.col("n")
    first = net.div(F.greatest(place - overlap, F.lit(0)), size).cast("long")
    last = net.div(place + F.greatest(n, F.lit(1)) - 1, size).cast("long")

    def cut(k: Column) -> Column:
        begin = F.greatest(place, k * size)
        return F.struct(k.alias("piece"), begin.alias("begin"), F.col("t").substr((begin - place + 1).cast("int"), (k * size + size + overlap - begin).cast("int")).alias("content"))

    # cut inside the array, so that a long text isn't copied once for each of its pieces
    out = placed(rows, keys, order, text).select(*keys, F.explode(F.transform(F.sequence(first, last), cut)).alias("x")).select(*keys, "x.*")
    return out.groupBy(*keys, "piece").agg(_joined(F.col("begin"), F.col("content")).alias("content"))


def matching(texts: DataFrame, pattern: str, size: int = PIECE) -> DataFrame:
    """Sessions (session_id) whose ``content``, put together in file order, matches a pattern.

    Where the longest match is known, pieces that overlap by it are searched, and no session is put together whole.  The
    text of a session stands in one row only for patterns of :func:`longest_match` None."""
    longest = longest_match(pattern)
    if longest is None:
        whole = texts.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_seq", "content"))), lambda x: x["content"]), "").alias("content"))
    else:
        whole = pieces(texts, ["session_id"], ["file_seq"], F.col("content"), max(size, longest), max(longest - 1, 0))
    return whole.where(F.col("content").rlike(pattern)).select("session_id").distinct()


SIDE, PACKETS = ["session_id", "small_to_big"], ["second", "ns", "idx"]


def payload_parts(packets: DataFrame, size: int = 1 << 20) -> DataFrame:
    """Payload of each session and direction in packet order, in parts of ``size`` bytes: (session_id, small_to_big, part,
    payload).  Packets without a payload count for nothing."""
    out = pieces(packets.where("payload IS NOT NULL"), SIDE, PACKETS, F.hex("payload"), 2 * size)
    return out.select(*SIDE, F.col("piece").alias("part"), F.unhex("content").alias("payload"))


def payload_heads(packets: DataFrame, size: int = 100) -> DataFrame:
    """The first bytes of each session and direction as hex digits: (session_id, small_to_big, payloadhead)."""
    begin = placed(packets.where("payload IS NOT NULL"), SIDE, PACKETS, F.hex("payload")).where(F.col("at") < 2 * size)
    return begin.groupBy(*SIDE).agg(F.substring(_joined(F.col("at"), F.substring("t", 1, 2 * size)), 1, 2 * size).alias("payloadhead"))
