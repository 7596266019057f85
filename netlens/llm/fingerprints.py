"""Context-triggered piecewise fingerprints of texts, and their likeness.

A rolling hash of the last ``WINDOW`` bytes triggers a boundary where its low bits are zero, so boundaries depend on the
content around them and come back behind an insertion.  Every chunk gives a 12-bit signature, written as two characters.
A fingerprint holds the signatures at a block size that fits the text's length and at its next two doublings; two
fingerprints are compared by edit distance at the least block size that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import SLICE_BYTES, SpanHash, materialize, partitions, slices

#: Bytes of the rolling window, chunks of a text at the first block size (about), block sizes of a fingerprint.
WINDOW, CHUNKS, LEVELS = 7, 64, 3
#: Rows that are sampled for each range of the order.
SAMPLE = 16

_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PAIRS = np.stack([np.repeat(_DIGITS, 64), np.tile(_DIGITS, 64)], 1)
_ROLL = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_BASE = np.uint32(0x9E3779B1)


def rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes of the own text at every byte; a window that begins before the text is shorter."""
    values = _ROLL[data]
    total, factor = values.copy(), np.uint32(1)
    for back in range(1, WINDOW):
        factor = np.uint32(int(factor) * int(_BASE) & 0xFFFFFFFF)
        total[back:] += values[:-back] * factor
    first, length = offsets[:-1], np.diff(offsets)
    own = np.zeros(len(first), np.uint32)
    for k in range(WINDOW - 1):
        live = length > k
        own[live] = own[live] * _BASE + values[first[live] + k]
        total[first[live] + k] = own[live]
    total ^= total >> np.uint32(16)
    total *= np.uint32(0x85EBCA6B)
    total ^= total >> np.uint32(13)
    total *= np.uint32(0xC2B2AE35)
    return total ^ (total >> np.uint32(16))


def boundaries(triggers: list[int], n: int, block: int) -> list[int]:
    """Ends of the chunks of a text of ``n`` bytes: at triggers, but no chunk under a quarter of the block or over four
    blocks (the last one may be shorter)."""
    least, most, last, out = max(1, block // 4), 4 * block, 0, []
    for at in triggers:
        while at - last > most:
            last += most
            out.append(last)
        if at - last >= least:
            last = at
            out.append(at)
    while n - last > most:
        last += most
        out.append(last)
    if last < n:
        out.append(n)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint ``block:first:second:third`` of every text of a packed array."""
    n = len(offsets) - 1
    if not len(data):
        return ["1" + ":" * LEVELS] * n
    heads, ends, counts, blocks = rolling(data, offsets), [], [], []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        size = high - low
        block = 1
        while block * CHUNKS < size:
            block *= 2
        blocks.append(block)
        own = heads[low:high]
        at = np.flatnonzero((own & np.uint32(block - 1)) == 0)
        own = own[at]
        for level in range(LEVELS):
            width = block << level
            cut = boundaries((at[(own & np.uint32(width - 1)) == 0] + 1).tolist(), size, width)
            ends.append(np.array(cut, np.int64) + low)
            counts.append(len(cut))
    edge = np.concatenate(ends)
    place = np.concatenate([[0], np.cumsum(counts)])
    start = np.empty_like(edge)
    start[1:] = edge[:-1]
    text = np.repeat(offsets[:-1], LEVELS)
    filled = np.flatnonzero(counts)
    start[place[filled]] = text[filled]
    # a chunk's signature covers the window of its boundary too, so chunks of a few bytes say something
    start = np.minimum(start, np.maximum(edge - WINDOW, np.repeat(text, counts)))
    signs = _PAIRS[(SpanHash(data)(start, edge) >> np.uint64(52)).astype(np.int64)].tobytes().decode()
    parts = [signs[2 * a : 2 * b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
    return [f"{block}:" + ":".join(parts[LEVELS * k : LEVELS * (k + 1)]) for k, block in enumerate(blocks)]


def edit_distance(a: list[str], b: list[str]) -> int:
    """Insertions and deletions that make ``b`` of ``a``; one machine word row of the table at a time."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & at.get(x, 0)
        if met:
            row = ((row + met) | (row - met)) & full
    common = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * common


def likeness(one: str, other: str) -> float:
    """1 for equal fingerprints, 0 where nothing is shared or no block size is common; else the kept share of signatures."""
    if one == other:
        return 1.0
    (first, *a), (second, *b) = one.split(":"), other.split(":")
    first, second = int(first).bit_length(), int(second).bit_length()
    block = max(first, second)
    if block - min(first, second) >= LEVELS:
        return 0.0
    x, y = a[block - first], b[block - second]
    if not x or not y:
        return 0.0
    x, y = ([t[i : i + 2] for i in range(0, len(t), 2)] for t in (x, y))
    return 1.0 - edit_distance(x, y) / (len(x) + len(y))


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text is an empty one, rows that repeat each have their row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(fingerprints(data, offsets), pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def _column(name: str, values: list[int]) -> Column:
    """A literal array: one text that is split and cast once, while the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>").alias(name)


def in_descending_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, range, guest) so that each task holds one range of descending ids, in order, and behind it as a
    ``guest`` a copy of the row that begins the next range (of the first range, behind the last).

    The order is by descending id, nulls last, then by a hash of the text, then by place in the table.  Ranges begin at
    sampled rows, so also one id of very many rows is split.  The driver holds ``SAMPLE`` keys of 24 bytes for each range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    last = (1 << 63) - 1
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    k0 = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(last))  # reverses the order without overflow
    rows = rows.select("doc_id", "text", k0.alias("k0"), F.xxhash64("text").alias("k1"), F.monotonically_increasing_id().alias("k2"))
    keys = materialize(rows.select("k0", "k1", "k2"), "fingerprint-keys")
    order = ["k0", "k1", "k2"]
    sample = [tuple(r) for r in keys.orderBy(F.xxhash64("k2"), *order).limit(SAMPLE * partitions(spark)).collect()]
    if not sample:
        return rows.select("doc_id", "text", F.lit(0).alias("range"), F.lit(0).alias("guest"))
    starts = sorted(sample)[::SAMPLE]
    starts[0] = min(starts[0], tuple(keys.orderBy(*order).first()))
    # the number of starts at or before a key, by halving steps
    bounds = F.arrays_zip(*[_column(f"b{k}", [s[k] for s in starts]) for k in range(3)])
    steps = [1 << k for k in reversed(range(len(starts).bit_length()))]
    key = F.struct(F.col("k0").alias("b0"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))

    def step(found: Column, width: Column) -> Column:
        ahead = found + width
        return F.when(F.get(bounds, ahead - 1) <= key, ahead).otherwise(found)

    place = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step) - 1
    dealt = rows.select("doc_id", "text", *order, place.alias("range"), F.lit(0).alias("guest"))
    named = [(*s, (k or len(starts)) - 1) for k, s in enumerate(starts)]
    heads = spark.createDataFrame(named, "k0 long, k1 long, k2 long, range int")
    # equal rows are interchangeable: any of them can stand for the one that begins a range
    unique = rows.join(F.broadcast(heads.select("k0", "k1").distinct()), ["k0", "k1"]).groupBy("k0", "k1").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    guests = unique.join(F.broadcast(heads), ["k0", "k1"]).select("doc_id", "text", *order, "range", F.lit(1).alias("guest"))
    every = dealt.unionByName(guests).repartitionById(len(starts), F.col("range"))
    return every.sortWithinPartitions("range", "guest", *order).select("doc_id", "text", "range", "guest")


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs``.

    ``edited`` is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next row's
    text, in descending order of ids (the last row's next one is the first).  near_edited and near_next are the likeness
    of the fingerprint to those of the edited text and of the next row.

    A null text is an empty one; a null id comes last; rows of one id follow each other by a hash of their texts, and equal
    rows are each other's next; a table of one row is its own next; an empty table gives no rows; other columns are not
    read.  Texts are shuffled once, and a task holds about 1 MB of them, or one longer text, with about 40 bytes for each
    of its bytes.
    """
    rows = in_descending_order(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next one has not come yet
        for batch in batches:
            ids, ranges, guests = (batch.column(c).to_pylist() for c in ("doc_id", "range", "guest"))
            id_type = batch.column("doc_id").type
            for low, high, data, offsets in slices(batch.column("text")):
                own = fingerprints(data, offsets)
                raw, at = data.tobytes(), offsets.tolist()
                texts = [raw[a:b].decode("utf-8", "surrogateescape") for a, b in zip(at[:-1], at[1:], strict=True)]
                line = list(zip(ids[low:high], texts, own, ranges[low:high], guests[low:high], strict=True))
                if held is not None:
                    line.insert(0, held)
                held = line[-1]
                pairs = [(x, y) for x, y in zip(line[:-1], line[1:], strict=True) if not x[4] and x[3] == y[3]]
                if not pairs:
                    continue
                edited = [(x[1][: len(x[1]) - len(x[1]) // 2] + y[1][: len(x[1]) // 2]).encode("utf-8", "surrogateescape") for x, y in pairs]
                made = pa.array(edited, pa.large_binary())
                prints = [f for _, _, d, o in slices(made, SLICE_BYTES) for f in fingerprints(d, o)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x, _ in pairs], id_type),
                        pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                        pa.array(edited, pa.binary()),
                        pa.array([x[2] for x, _ in pairs], pa.string()),
                        pa.array(prints, pa.string()),
                        pa.array([likeness(x[2], f) for (x, _), f in zip(pairs, prints, strict=True)], pa.float64()),
                        pa.array([likeness(x[2], y[2]) for x, y in pairs], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    made = rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited binary, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumn("edited", F.col("edited").cast("string"))
