"""Suffix-array dedup: remove every byte covered by a long string that also starts elsewhere.

A suffix array of a whole corpus would be one global sort.  Strings that can repeat are brought together first, so that
each task sorts the suffixes of a few megabytes:

* every ``report``-byte string picks an anchor, the least-hashed ``gram`` bytes in it.  Equal strings pick equal anchors
  at equal places, so a string can only repeat among the strings of its anchor's hash;
* consecutive starts with one anchor form a context: the bytes from the first start to ``length`` bytes after the last,
  or to the end of the document.  Contexts that are equal as a whole are counted once, with their number;
* the different contexts of an anchor are suffix-sorted together.  Neighbours with ``length`` common bytes repeat and are
  removed; neighbours with ``report`` common bytes, a shorter length, are reported only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import SpanHash, discard, join_counted, materialize, signed, slices

LENGTH, GRAM = 400, 64
#: Bytes of a repeat that is reported, though shorter than what is removed: 50 words take about as many.
REPORT = 280
#: Bytes of contexts that one task sorts, about.
BIN_BYTES = 1 << 20
#: Bytes of texts whose contexts are looked for in one pass, about.
FIND_BYTES = 1 << 19
#: Texts whose contexts, or whose results, a task holds as Python objects at once.
ROWS = 250
#: Different contexts of an anchor beyond which its strings are counted one by one instead of being sorted.
SORTED_CONTEXTS = 50_000
#: Bytes of removal lists that may be broadcast to the texts; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_LOW = np.uint64(0xFFFFFFFF)


def digest(raw: bytes, extra: int = 0) -> bytes:
    """128 bits of BLAKE2b: bytes of equal digests count as equal."""
    return hashlib.blake2b(raw, digest_size=16, salt=extra.to_bytes(8, "little")).digest()


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, more: int = 0) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, end, anchor, anchor hash) of every context of ``length``-byte strings; places
    within documents.  A context goes on for ``more`` bytes behind its last string, or to the end of the document."""
    empty = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.sum():
        return empty, empty, empty, empty, empty, empty
    at = np.arange(len(data) - gram + 1)
    grams = SpanHash(data)(at, at + gram)
    key = (grams & ~_LOW) | at.astype(np.uint64)
    width = length - gram + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.repeat(offsets[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor = (np.minimum(behind[start], ahead[start + width - 1]) & _LOW).astype(np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    low, high, place = start[first], start[last], anchor[first]
    doc = np.searchsorted(offsets, low, "right") - 1
    base = offsets[doc]
    return doc, low - base, high - base, np.minimum(high + length + more, offsets[doc + 1]) - base, place - base, signed(grams[place])


# ---------------------------------------------------------------- two-stage suffix sorting


def _smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next; the last one is not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    if not len(change):
        return np.zeros(n, bool)
    runs = np.append(change, n - 1)
    rises = np.append(text[change + 1] > text[change], False)
    return np.repeat(rises, np.diff(np.concatenate([[-1], runs])))


def _direct_sort(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in order of the first ``depth`` bytes of their suffixes; ``text`` is padded by 2 * depth bytes at least.

    Eight bytes at a time.  Groups of equal suffixes first jump over what all their members share, found by halving
    steps on prefix hashes, so that every round splits every group that it sorts.
    """
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    span = None
    order = places.copy()
    live = np.arange(len(order))  # slots still to be decided
    group = np.zeros(len(order), np.int64)  # of live slots, ascending
    reach = np.zeros(len(order), np.int64)  # bytes known to be equal in their group
    turn = 0
    while len(live):
        own = order[live]
        if turn >= 2:
            span = span or SpanHash(text)
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            counts = np.diff(np.append(heads, len(group)))
            step = 1 << (depth - 1).bit_length()
            while step >= 8:
                hashes = span(own + reach, np.minimum(own + reach + step, len(text)))
                same = np.minimum.reduceat(hashes, heads) == np.maximum.reduceat(hashes, heads)
                reach += step * np.repeat(same, counts)
                step //= 2
                reach = np.minimum(reach, depth)
            open_ = reach < depth
            live, own, group, reach = live[open_], own[open_], group[open_], reach[open_]
            if not len(live):
                break
        chunk = np.ascontiguousarray(words[own + reach]).view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((chunk, group)) if turn else np.argsort(chunk, kind="stable")
        order[live] = own[by]
        chunk, group, reach = chunk[by], group[by], reach[by] + 8
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (chunk[1:] != chunk[:-1])
        single = new & np.append(new[1:], True)
        group = np.cumsum(new)
        tied = ~single & (reach < depth)
        live, group, reach = live[tied], group[tied], reach[tied]
        turn += 1
    return order


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` suffixes (a flag for each place) in order of their first ``depth`` bytes at least.

    Stage one sorts directly only the suffixes that are smaller than their successors.  Stage two scans the buckets of
    first bytes upwards: each suffix met puts its predecessor, if that one is larger than its successor, at the end of
    the larger suffixes of its bucket, which always lies at or after the scan.
    """
    n = len(text)
    small = _smaller_than_successor(text)
    # a larger suffix needs its successor, and so on up to the next smaller one
    place = np.arange(n)
    nearest = np.minimum.accumulate(np.where(small, place, n - 1)[::-1])[::-1]
    covered = np.zeros(n + 1, np.int64)
    want = np.flatnonzero(wanted)
    np.add.at(covered, want, 1)
    np.add.at(covered, nearest[want] + 1, -1)
    needed = np.cumsum(covered[:-1]) > 0
    padded = np.concatenate([text, np.zeros(4 * depth + 16, np.uint8)])
    direct = _direct_sort(padded, np.flatnonzero(needed & small), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced = needed & ~small
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[n - 1]:
        queues[text[n - 1]].append(np.array([n - 1]))  # nothing follows it, so it comes first in its bucket
    out = []

    def predecessors(of: np.ndarray, current: int) -> np.ndarray:
        before = of[of > 0] - 1
        before = before[induced[before]]
        first = text[before]
        own = before[first == current]
        rest = before[first != current]
        if len(rest):
            order = np.argsort(text[rest], kind="stable")
            rest = rest[order]
            values = text[rest]
            cut = np.flatnonzero(values[1:] != values[:-1]) + 1
            for part in np.split(rest, cut):
                queues[text[part[0]]].append(part)
        return own

    for byte in range(256):
        current = np.concatenate(queues[byte]) if queues[byte] else np.zeros(0, np.int64)
        while len(current):
            out.append(current)
            current = predecessors(current, byte)
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            out.append(own)
            predecessors(own, byte)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``limit`` bytes (a multiple of 8); 0 first."""
    padded = np.concatenate([text, np.zeros(limit + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, limit, 8):
        a = np.ascontiguousarray(words[order[live] + at]).view("<u8").ravel()
        b = np.ascontiguousarray(words[order[live - 1] + at]).view("<u8").ravel()
        differ = a ^ b
        equal = differ == 0
        stop = differ[~equal]
        low = stop & (~stop + np.uint64(1))
        out[live[~equal]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[equal]
        if not len(live):
            break
    out[live] = limit
    return out


def repeated_starts(pieces: list[bytes], counts: list[int], report: int, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece and its first ``counts`` starts, the flags of the starts whose ``report``-byte string also starts
    elsewhere among the pieces, and of those whose ``length``-byte string does.  A string never leaves its piece."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(sizes)
    wanted, whole = np.zeros(len(text), bool), np.zeros(len(text), bool)
    for a, b, n in zip(ends - sizes, ends, counts, strict=True):
        wanted[a : a + n] = True
        whole[a : max(a, min(a + n, b - length + 1))] = True
    order = sort_suffixes(text, wanted, length)
    near = common_prefixes(text, order, length)
    found = []
    for least, able in ((report, wanted), (length, whole)):
        group = np.cumsum(near < least) - 1  # runs of starts that share so many bytes
        own = able[order]
        several = np.bincount(group[own], minlength=len(order)) > 1
        marked = np.zeros(len(text), bool)
        marked[order[own & several[group]]] = True
        found.append(marked)
    return [tuple(x[a : a + n] for x in found) for a, n in zip(ends - sizes, counts, strict=True)]


# ---------------------------------------------------------------- the job


def in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def _find(report: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in slices(batch.column("_text"), FIND_BYTES):
                doc, first, last, end, place, anchor = contexts(data, offsets, report, gram, length - report)
                raw, base = data.tobytes(), offsets[doc]
                whole = [digest(raw[a:b], c) for a, b, c in zip((base + first).tolist(), (base + end).tolist(), (place - first).tolist(), strict=True)]
                rows = pa.array(low + doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("_key").take(rows),
                        *[pa.array(x, pa.int64()) for x in (first, last, end, place, anchor)],
                        pa.array(whole, pa.binary()),
                    ],
                    names=["doc_id", "_key", "first", "last", "end", "place", "anchor", "whole"],
                )

    return run


def _cut(length: int):
    """Bytes of the contexts of a text, cut where an anchor has too many of them.  Starts that are equal strings stand at
    equal distances from the anchor, so contexts may be cut by that distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            ids, keys = batch.column("doc_id"), batch.column("_key").to_pylist()
            rows, out = [], []
            for k, (text, wanted) in enumerate(zip(batch.column("_text"), batch.column("wanted"), strict=True)):
                raw = text.as_py().encode()
                for x in wanted.as_py():
                    step = x["step"]
                    edges = sorted({x["first"], x["last"] + 1, *range(x["first"] + (x["place"] - x["first"]) % step, x["last"] + 1, step)})
                    for a, b in zip(edges, edges[1:], strict=False):
                        rows.append(k)
                        out.append((keys[k], x["anchor"], (x["place"] - b) // step, a, b - a, x["n"], raw[a : b - 1 + length]))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "_key", "anchor", "block", "start", "starts", "n", "bytes"]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)

    return run


def _sorted(report: int, length: int):
    """Repeated byte ranges of the contexts of one bin that occur once, of ``report`` bytes (level 0) and of ``length``
    bytes (level 1); the other contexts are there as partners."""

    def run(table: pa.Table) -> pa.Table:
        pieces = table.column("bytes").to_pylist()
        starts, counts = table.column("start").to_pylist(), table.column("n").to_pylist()
        rows, level, low, high = [], [], [], []
        for k, found in enumerate(repeated_starts(pieces, table.column("starts").to_pylist(), report, length)):
            if counts[k] > 1:
                continue
            for own, (flags, size) in enumerate(zip(found, (report, length), strict=True)):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                rows += [k] * (len(edges) // 2)
                level += [own] * (len(edges) // 2)
                low += (starts[k] + edges[::2]).tolist()
                high += (starts[k] + edges[1::2] - 1 + size).tolist()
        take = pa.array(rows, pa.int64())
        return pa.table({"doc_id": table.column("doc_id").take(take), "_key": table.column("_key").take(take), "level": pa.array(level, pa.int32()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    return run


def _strings(report: int, length: int):
    """Each string of a context by itself, of either length: its digest and its place at the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("bytes")):
                raw, start, starts = text.as_py(), batch.column("start")[k].as_py(), batch.column("starts")[k].as_py()
                for level, size in enumerate((report, length)):
                    at = range(max(0, min(starts, len(raw) - size + 1)))
                    rows = pa.array([k] * len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(c).take(rows) for c in ("doc_id", "_key", "anchor", "n")],
                            pa.array([level] * len(at), pa.int32()),
                            pa.array([start + i for i in at], pa.int64()),
                            pa.array([start + i + size for i in at], pa.int64()),
                            pa.array([digest(raw[i : i + size]) for i in at], pa.binary()),
                        ],
                        names=["doc_id", "_key", "anchor", "n", "level", "low", "high", "string"],
                    )

    return run


def _kept(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(what is left, maximal removed runs); ranges may overlap or touch."""
    out, at, runs, end = [], 0, 0, -1
    for low, high in sorted(ranges):
        if low > end:
            runs += 1
            out.append(raw[at:low])
        end = max(end, high)
        at = end
    out.append(raw[at:])
    return b"".join(out), runs


def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, report: int | None = None
) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts anywhere else, in the same document or another.

    Texts are UTF-8 bytes; strings are judged on the input and never cross documents.  Returns id_col, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 (of the remaining bytes), n_repeated, kept (those bytes) and the columns
    in ``keep``.  n_repeated counts the bytes covered by strings of ``report`` bytes that start elsewhere; they are no reason
    to remove anything.  ``report`` lies between ``gram`` and ``length``, which it is by default.

    A null or empty text, or one shorter than ``length``, keeps all it has; rows that repeat whole are each other's copies
    and lose everything from ``length`` bytes on; a null id is an id like any other; an empty table gives no rows.

    An anchor of very many different contexts is cut by the distance between start and anchor, and beyond
    ``SORTED_CONTEXTS`` its strings are counted one by one; joins deal the rows of a frequent anchor over several tasks.
    So no group of copies ever fills a task.
    """
    keep, report = keep or [], length if report is None else report
    if not gram <= report <= length:
        raise ValueError("report must lie between gram and length")
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    kind = dict(source.dtypes)["doc_id"]
    plain = source.select("doc_id", "_key", "_text")
    spread = ["doc_id", "_key", "first"]
    found = materialize(plain.mapInArrow(_find(report, length, gram), f"doc_id {kind}, _key long, first long, last long, end long, place long, anchor long, whole binary"), "suffix-contexts")
    common = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-common")
    shared = materialize(join_counted(found, common, ["anchor"], spread), "suffix-shared")
    discard(found, common)
    counted = materialize(shared.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "_key", "first", "last", "end", "place")).alias("one")), "suffix-counted")

    several = materialize(counted.where("n > 1").select("anchor", "whole", "n"), "suffix-several")
    equal = join_counted(shared, several, ["anchor", "whole"], spread)
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("first").alias("low"), (F.col("last") + report).alias("high")),
        F.struct(F.lit(1).alias("level"), F.col("first").alias("low"), F.least(F.col("last") + length, "end").alias("high")),
    )
    copies = equal.select("doc_id", "_key", F.explode(levels).alias("x")).select("doc_id", "_key", "x.*").where(f"level = 0 OR high - low >= {length}")

    # anchors with several contexts of which one at least occurs once: the sorter decides
    width = (F.col("one.end") - F.col("one.first")).cast("long")
    mixed = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.sum(width).alias("bytes")).where("m > 1 AND least = 1")
    step = F.greatest(F.lit(1), F.floor(F.lit(length) / F.greatest(F.lit(1), F.ceil(F.col("bytes") / BIN_BYTES)))).cast("int")
    many = F.col("m") > SORTED_CONTEXTS
    mixed = materialize(mixed.select("anchor", F.when(many, length).otherwise(step).alias("step"), many.alias("many"), F.col("m").alias("n")), "suffix-mixed")
    chosen = join_counted(counted.select("anchor", "one", F.col("n").alias("copies")), mixed, ["anchor"], ["one"])
    chosen = materialize(chosen.select("one.*", "anchor", F.col("copies").alias("n"), "many", "step"), "suffix-chosen")
    total = chosen.agg(F.coalesce(F.sum(F.col("end") - F.col("first")), F.lit(0))).first()[0]
    bins = max(1, -(-total // BIN_BYTES))

    def fetched(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("anchor", "n", "first", "last", "place", "step")).alias("wanted"))  # as many as the text has anchors
        lists = lists.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "wanted")
        joined = plain.join(lists, plain["doc_id"].eqNullSafe(F.col("_id")) & (plain["_key"] == F.col("_k")))
        return joined.select("doc_id", "_key", "_text", "wanted").mapInArrow(_cut(length), f"doc_id {kind}, _key long, anchor long, block long, start long, starts long, n long, bytes binary")

    pieces = fetched(chosen.where("NOT many")).withColumn("bin", F.pmod(F.xxhash64("anchor", "block"), F.lit(bins)).cast("int"))
    sorted_ = pieces.groupBy("bin").applyInArrow(_sorted(report, length), f"doc_id {kind}, _key long, level int, low long, high long")
    ranges = copies.unionByName(sorted_)
    if chosen.where("many").limit(1).count():
        strings = fetched(chosen.where("many")).mapInArrow(_strings(report, length), f"doc_id {kind}, _key long, anchor long, n long, level int, low long, high long, string binary")
        twice = strings.groupBy("anchor", "level", "string").agg(F.sum("n").alias("c")).where("c > 1").select("anchor", "level", "string")
        ranges = ranges.unionByName(strings.where("n = 1").join(twice, ["anchor", "level", "string"]).select("doc_id", "_key", "level", "low", "high"))

    gone = ranges.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("level", "low", "high")).alias("ranges"))
    gone = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "ranges"), "suffix-ranges")
    discard(shared, counted, several, mixed, chosen)
    weight = gone.agg(F.coalesce(F.sum(F.size("ranges") * 32 + 64), F.lit(0))).first()[0]
    small = F.broadcast(gone) if weight <= BROADCAST_BYTES else gone
    joined = source.join(small, source["doc_id"].eqNullSafe(F.col("_id")) & (source["_key"] == F.col("_k")), "left").drop("_id", "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            texts, own = batch.column("_text").to_pylist(), batch.column("ranges").to_pylist()
            sizes, removed, runs, sums, left, repeated = [], [], [], [], [], []
            for text, cut in zip(texts, own, strict=True):
                raw = (text or "").encode()
                seen, gone = ([(x["low"], x["high"]) for x in cut or [] if x["level"] == k] for k in (0, 1))
                rest, n = _kept(raw, gone) if gone else (raw, 0)
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                runs.append(n)
                sums.append(hashlib.sha256(rest).hexdigest())
                repeated.append(len(raw) - len(_kept(raw, seen)[0]) if seen else 0)
                left.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sums, pa.string()), pa.array(repeated, pa.int64()), pa.array(left, pa.binary()), *[batch.column(f"_keep_{c}") for c in keep]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept", *keep],
            )

    types = dict(source.dtypes)
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary" + "".join(f", `{c}` {types[f'_keep_{c}']}" for c in keep)
    return joined.mapInArrow(run, schema)
