"""Benchmark decontamination: a set of normalised test windows, scanned for in every training text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import ALNUM_WORDS, LOWER, SpanHash, chain, kept_columns, slices, word_spans

#: Words of a window.  An item with fewer words is one window of its own length.
WINDOW = 10
#: Bytes of packed windows (:meth:`Windows.nbytes`) that may be broadcast; a larger test set is joined instead.
BROADCAST_BYTES = 32 << 20
#: Bytes of a packed window beside its text: hash, two places, item.
WINDOW_BYTES = 24


@dataclass
class Windows:
    """The windows of a test set, packed: all items' words in lower case with a space between in one blob, and by length
    the sorted window hashes with each window's place in the blob and its item's place in ``names``."""

    blob: bytes
    names: list[str]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def nbytes(self) -> int:
        return len(self.blob) + sum(x.nbytes for own in self.by_length.values() for x in own)


def build(items: list[tuple], window: int = WINDOW) -> Windows:
    texts = [(text or "").encode() for _, text in items]
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    starts, ends, tokens = word_spans(data, offsets, ALNUM_WORDS)
    names = sorted({str(item) for item, _ in items})
    if not len(starts):
        return Windows(b"", names, {})
    blob = b" ".join(_words(data, starts, ends))
    stop = np.cumsum(ends - starts + 1) - 1
    first = stop - (ends - starts)
    number = {name: k for k, name in enumerate(names)}
    own_item = np.array([number[str(item)] for item, _ in items], np.int32)
    words, item = SpanHash(data)(starts, ends), np.searchsorted(tokens, np.arange(len(starts)), "right") - 1
    sizes = np.minimum(window, np.diff(tokens))
    by_length = {}
    for size in sorted(set(sizes[sizes > 0].tolist())):
        n = len(starts) - size + 1
        k = np.flatnonzero((item[:n] == item[size - 1 :]) & (sizes[item[:n]] == size))
        hashes = chain(*(words[j : j + n] for j in range(size)))[k]
        order = np.argsort(hashes, kind="stable")
        k = k[order]
        by_length[size] = (hashes[order], first[k], stop[k + size - 1], own_item[item[k]])
    return Windows(blob, names, by_length)


def scan(data: np.ndarray, offsets: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """(token starts, token ends, token offsets, hit flags, items by document) of one slice of texts."""
    low = LOWER[data]
    starts, ends, tokens = word_spans(data, offsets, ALNUM_WORDS)
    hit = np.zeros(len(starts), bool)
    items: list[set] = [set() for _ in range(len(offsets) - 1)]
    if not len(starts):
        return starts, ends, tokens, hit, items
    words = SpanHash(low)(starts, ends)
    left = np.searchsorted(tokens, np.arange(len(starts)), "right") - 1  # document of each token
    for size, (keys, first, stop, item) in windows.by_length.items():
        n = len(starts) - size + 1
        if n <= 0:
            continue
        hashes = chain(*(words[k : k + n] for k in range(size)))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        for k in np.flatnonzero((keys[at] == hashes) & (left[:n] == left[size - 1 :])):
            own = b" ".join(_words(low, starts[k : k + size], ends[k : k + size]))
            for j in range(at[k], np.searchsorted(keys, hashes[k], "right")):
                if windows.blob[first[j] : stop[j]] == own:  # the hash only proposes
                    hit[k : k + size] = True
                    items[left[k]].add(windows.names[item[j]])
    return starts, ends, tokens, hit, items


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    if not len(starts):
        return []
    base = int(starts[0])
    raw = data[base : int(ends[-1])].tobytes()
    return [raw[a:b] for a, b in zip((starts - base).tolist(), (ends - base).tolist(), strict=True)]


def _digest(ids: set) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _blank_hits(text: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without its maximal runs of hit words (and what stands between the words of a run)."""
    out, at = [], 0
    k = 0
    while k < len(hit):
        if not hit[k]:
            k += 1
            continue
        last = k
        while last + 1 < len(hit) and hit[last + 1]:
            last += 1
        out.append(text[at : starts[k]])
        at = ends[last]
        k = last + 1
    out.append(text[at:])
    return b"".join(out)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) with ids as text, as both paths name them: 'true' for a boolean, '1.0' for a double, 'null' for none."""
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").alias("text")).where("text is not null")


def _windows_of(benchmark: DataFrame, window: int) -> Windows | None:
    """The packed windows of a test set, none if they are too large to broadcast; their size is known before they are built."""
    own = _items(benchmark)
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + words * WINDOW_BYTES), F.lit(0))).first()[0]
    return build([tuple(r) for r in own.collect()], window) if size <= BROADCAST_BYTES else None


#: Columns of :func:`decontaminate` besides the id.
RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, _force_join: bool = False) -> DataFrame:
    """One row for each row of ``docs``: the words, which of them lie inside an occurrence of a test window, and the text
    without those runs.

    Returns id_col, n_words, n_hit, n_items, items_sha256, contaminated, clean_text and the columns named in ``keep``.

    Up to ``BROADCAST_BYTES`` of packed windows are broadcast and each partition scans its texts alone: no shuffle.  The
    size is measured first.  A larger test set goes to :func:`_decontaminate_by_join`, which joins window hashes and
    broadcasts nothing.  Either way a hash only proposes a hit and the words decide, so the rows are the same.

    A null or empty text has no words and is clean; a null or empty test item has no windows; an item without id is called
    "null"; items that share an id are one; equal items all count; repeated rows each give their row; a column of ``keep``
    that is called like a result gives way to it.
    """
    keep = kept_columns(keep or [], ["doc_id", *RESULTS])
    sets = None if _force_join else _windows_of(benchmark, window)
    if sets is None:
        return _decontaminate_by_join(docs, benchmark, window, id_col, text_col, keep)
    windows = docs.sparkSession.sparkContext.broadcast(sets)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for low, high, data, offsets in slices(texts):
                starts, ends, tokens, hit, items = scan(data, offsets, windows.value)
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit = sums[tokens[1:]] - sums[tokens[:-1]]
                clean = texts.slice(low, high - low).to_pylist()
                for k in np.flatnonzero(n_hit):
                    a, b, base = tokens[k], tokens[k + 1], offsets[k]
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    clean[k] = _blank_hits(raw, starts[a:b] - base, ends[a:b] - base, hit[a:b]).decode("utf-8", "replace")
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(tokens), pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in items], pa.int64()),
                        pa.array([_digest(x) for x in items], pa.string()),
                        pa.array(n_hit > 0, pa.bool_()),
                        pa.array(clean, pa.string()),
                        *[part.column(f"_keep_{c}") for c in keep],
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text", *keep],
                )

    types = dict(source.dtypes)
    schema = f"doc_id {types['doc_id']}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string"
    schema += "".join(f", `{c}` {types[f'_keep_{c}']}" for c in keep)
    return source.mapInArrow(run, schema)


def _window_rows(table: DataFrame, window: int, lengths: list[int] | None) -> DataFrame:
    """(row key, first word, size, hash) of every window; of items: their own lengths, and the words in lower case, with a
    space between; of documents: the given lengths."""
    items = lengths is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("_text"), 1 << 18):
                starts, ends, tokens = word_spans(data, offsets, ALNUM_WORDS)
                if not len(starts):
                    continue
                low_bytes = LOWER[data]
                words = SpanHash(low_bytes)(starts, ends)
                shown = _words(low_bytes, starts, ends) if items else []
                left = np.searchsorted(tokens, np.arange(len(starts)), "right") - 1
                counts = np.diff(tokens)
                for size in range(1, window + 1) if items else lengths:
                    n = len(starts) - size + 1
                    if n <= 0:
                        continue
                    good = left[:n] == left[size - 1 :]
                    if items:
                        good &= np.minimum(window, counts[left[:n]]) == size
                    k = np.flatnonzero(good)
                    hashes = chain(*(words[j : j + n] for j in range(size)))[k]
                    columns = [batch.column("_key").take(pa.array(low + left[k])), pa.array(k - tokens[left[k]], pa.int64()), pa.array(np.full(len(k), size), pa.int32()), pa.array(hashes.view(np.int64))]
                    if items:
                        columns.append(pa.array([b" ".join(shown[j : j + size]) for j in k], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["_key", "first", "size", "hash", "words"][: len(columns)])

    return table.mapInArrow(run, f"_key {dict(table.dtypes)['_key']}, first long, size int, hash long" + (", words binary" if items else ""))


def _decontaminate_by_join(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """The same result for a test set of any size: window hashes of both sides meet in a join, and the positions come back
    to their document with the words of the item's window, which must be the document's.  Rows are told apart by a hash
    of the text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep])
    key = F.sha2(F.coalesce(F.col("_text"), F.lit("")).cast("binary"), 256)
    source = source.withColumn("_key", key)
    items = _window_rows(_items(benchmark).select(F.col("item_id").alias("_key"), F.col("text").alias("_text")), window, None)
    items = items.select(F.col("_key").alias("item"), "size", "hash", "words").distinct()
    lengths = sorted(r[0] for r in items.select("size").distinct().collect())
    texts = source.select("_key", "_text").dropDuplicates(["_key"])
    found = _window_rows(texts, window, lengths or [window]).join(items, ["size", "hash"])
    hits = found.groupBy("_key").agg(
        F.collect_set(F.struct("first", "size", "words")).alias("_hits"),
        F.collect_set(F.struct("words", "item")).alias("_items"),
    )
    joined = source.join(hits, "_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for low, high, data, offsets in slices(texts):
                starts, ends, tokens = word_spans(data, offsets, ALNUM_WORDS)
                part = batch.slice(low, high - low)
                hits, named, clean = part.column("_hits").to_pylist(), part.column("_items").to_pylist(), texts.slice(low, high - low).to_pylist()
                n_hit, ids = [0] * len(hits), [set() for _ in hits]
                for k, own in enumerate(hits):
                    if not own:
                        continue
                    a, b, base = tokens[k], tokens[k + 1], offsets[k]
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    shown = _words(LOWER[data[base : offsets[k + 1]]], starts[a:b] - base, ends[a:b] - base)
                    flags, same = np.zeros(b - a, bool), set()
                    for x in own:
                        span = slice(x["first"], x["first"] + x["size"])
                        if b" ".join(shown[span]) == x["words"]:  # the hash only proposes
                            flags[span] = True
                            same.add(x["words"])
                    if same:
                        n_hit[k], ids[k] = int(flags.sum()), {x["item"] for x in named[k] if x["words"] in same}
                        clean[k] = _blank_hits(raw, starts[a:b] - base, ends[a:b] - base, flags).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(tokens), pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([_digest(x) for x in ids], pa.string()),
                        pa.array([x > 0 for x in n_hit], pa.bool_()),
                        pa.array(clean, pa.string()),
                        *[part.column(f"_keep_{c}") for c in keep],
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text", *keep],
                )

    types = dict(source.dtypes)
    schema = f"doc_id {types['doc_id']}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string"
    schema += "".join(f", `{c}` {types[f'_keep_{c}']}" for c in keep)
    return joined.mapInArrow(run, schema)
