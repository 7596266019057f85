"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import LOWER, SPACE_WORDS, SpanHash, discard, join_counted, kept_columns, materialize, signed, slices, token_hash, word_spans

#: A span is the shortest run of at least so many sentences that has at least so many words.
MIN_SENTENCES, MIN_WORDS = 2, 20
#: Tells the hash of a whole text from that of a span of the same words.
_WHOLE = np.uint64(0x5851F42D4C957F2D)
#: Sentences are cut before the word of least hash of every so many consecutive words, so the cuts lie alike wherever a passage
#: stands.  Then any 3 * (CUT_WORDS - 1) + MIN_WORDS + 1 = 48 words or more that repeat word for word hold a whole span.
CUT_WORDS = 10


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(token starts, token ends, first token of each piece, end token of each piece, document of each piece, whether a
    sentence ends with the piece, whether the words alone end it).

    A sentence ends at a word whose last byte is . ! or ?, before a line break and at the end of the document.  It is cut
    into pieces before the first word of least hash of each window of ``CUT_WORDS`` words; no window spans a . ! or ?.
    Each cut follows from the ``CUT_WORDS`` - 1 words on both sides at most, and two cuts by words are ``CUT_WORDS`` apart at most.
    """
    starts, ends, tokens = word_spans(data, offsets, SPACE_WORDS)
    n = len(starts)
    if not n:
        empty = np.zeros(0, np.int64)
        return starts, ends, empty, empty, empty, empty.astype(bool), empty.astype(bool)
    last = data[ends - 1]
    worded = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    close = tokens[1:]
    worded[close[close > 0] - 1] = True
    final = worded.copy()
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    final[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    if n >= CUT_WORDS:
        sentence = np.cumsum(worded) - worded
        windows = np.lib.stride_tricks.sliding_window_view(SpanHash(LOWER[data])(starts, ends), CUT_WORDS)
        whole = np.flatnonzero(sentence[: n - CUT_WORDS + 1] == sentence[CUT_WORDS - 1 :])
        least = whole + windows[whole].argmin(1)
        worded[least[least > 0] - 1] = True
    stop = np.flatnonzero(final | worded) + 1
    first = np.concatenate([[0], stop[:-1]])
    doc = np.searchsorted(tokens, first, "right") - 1
    return starts, ends, first, stop, doc, final[stop - 1], worded[stop - 1]


def _stops(first: np.ndarray, end: np.ndarray, start: np.ndarray, closing: np.ndarray, min_sentences: int, min_words: int) -> np.ndarray:
    """The last piece of the span from each piece of ``start``, among those that ``closing`` marks; beyond the last without one."""
    marked = np.flatnonzero(closing)
    at = np.maximum(np.searchsorted(end[marked], first[start] + min_words), np.searchsorted(marked, start) + min_sentences - 1)
    return np.concatenate([marked, [len(first)]])[np.minimum(at, len(marked))]


def compact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(words with A-Z in lower case and one space between, where each begins there, where each ends there)."""
    sizes = ends - starts
    last = np.cumsum(sizes + 1) - 1
    first = last - sizes
    out = np.full(int(last[-1]) + 1 if len(last) else 0, ord(" "), np.uint8)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(first, sizes) + place] = LOWER[data[np.repeat(starts, sizes) + place]]
    return out.tobytes(), first, last


def spans(data: np.ndarray, offsets: np.ndarray, min_sentences: int, min_words: int, digests: bool = False) -> tuple[np.ndarray, ...]:
    """(document, first piece in it, last piece in it, hash, 64-bit BLAKE2b if asked for) of every span: from each piece to a
    cut by words, and from each sentence to the end of a sentence.  A document without such a span is one span as a
    whole, whose hashes are of another kind.

    Both hashes cover the words in order with A-Z in lower case; white space does not matter.
    """
    starts, ends, first, end, doc, final, worded = sentences(data, offsets)
    if not len(first):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    words = token_hash(SpanHash(LOWER[data])(starts, ends))
    pieces = np.arange(len(first))
    opening = np.flatnonzero(np.concatenate([[True], final[:-1]]))
    near, far = (_stops(first, end, k, closing, min_sentences, min_words) for k, closing in ((pieces, worded), (opening, final)))
    other = far != near[opening]
    start, stop = np.concatenate([pieces, opening[other]]), np.concatenate([near, far[other]])
    start, stop = start[stop < len(first)], stop[stop < len(first)]
    good = doc[start] == doc[stop]
    start, stop = start[good], stop[good]
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    tail = np.append(head[1:], len(first)) - 1
    bare = ~np.isin(doc[head], doc[start])
    whole = np.concatenate([np.zeros(len(start), bool), np.ones(int(bare.sum()), bool)])
    start, stop = np.concatenate([start, head[bare]]), np.concatenate([stop, tail[bare]])
    origin = np.searchsorted(doc, doc[start])
    hashes, sums = words(first[start], end[stop]) ^ np.where(whole, _WHOLE, np.uint64(0)), start[:0]
    if digests:
        text, low, high = compact(data, starts, ends)
        marks = zip(low[first[start]].tolist(), high[end[stop] - 1].tolist(), whole.tolist(), strict=True)
        sums = np.frombuffer(b"".join([hashlib.blake2b(text[a:b], digest_size=8, person=b"whole" if w else b"span").digest() for a, b, w in marks]), "<i8")
    return doc[start], start - origin, stop - origin, signed(hashes), sums


def _rows(min_sentences: int, min_words: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in slices(batch.column("_text")):
                doc, first, last, hashes, sums = spans(data, offsets, min_sentences, min_words, digests)
                if not digests:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes)], names=["hash"])
                    continue
                rows = pa.array(low + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("_key").take(rows), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(hashes), pa.array(sums, pa.int64())],
                    names=["doc_id", "_key", "first", "last", "hash", "digest"],
                )

    return run


def _removed(texts: pa.Array, hits: list) -> tuple[list, list, list, list]:
    clean = texts.to_pylist()
    counts, removed, runs = [], [], []
    for low, high, data, offsets in slices(texts):
        starts, ends, first, end, doc, _, _ = sentences(data, offsets)
        bounds = np.searchsorted(doc, np.arange(high - low + 1))
        for k in range(high - low):
            a, b = bounds[k], bounds[k + 1]
            counts.append(b - a)
            own = hits[low + k]
            if not own:
                removed.append(0)
                runs.append(0)
                continue
            gone = np.zeros(b - a + 1, np.int64)
            for x in own:
                gone[x["first"]] += 1
                gone[x["last"] + 1] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            raw, base, out, at = data[offsets[k] : offsets[k + 1]].tobytes(), offsets[k], [], 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            for i, j in zip(edges[::2], edges[1::2], strict=True):
                out.append(raw[at : starts[first[a + i]] - base])
                at = starts[first[a + j]] - base if a + j < b else len(raw)
            clean[low + k] = b"".join([*out, raw[at:]]).decode("utf-8", "replace")
            removed.append(int(gone.sum()))
            runs.append(len(edges) // 2)
    return clean, counts, removed, runs


def span_dedup(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Remove the sentences covered by any non-first occurrence of a repeated span, over the whole table.

    Sentences are cut into pieces by content (see :func:`sentences`), and pieces count as sentences.  From every piece
    starts a span: the shortest run of at least ``min_sentences`` pieces with at least ``min_words`` words that ends at a
    cut by words; from every sentence also the shortest such run of whole sentences.  A text too short for any span is
    one span, which meets only other such texts.  Repeated hashes of 64 bits are counted first; spans are equal where a
    second hash of another kind, 64 bits of BLAKE2b over the words, is equal too, and of these the first, by (id, text
    hash, piece), stays.  Where a passage is longer than a span, its overlapping spans cover it but for less than two
    pieces at either edge.

    Returns id_col, n_sentences, n_removed, n_spans (maximal removed runs), clean_text and the columns in ``keep``.

    A null or empty text has no sentences and stays as it is; rows that repeat both id and text are one document and
    come back alike; equal texts under different ids lose all but the first's spans; an empty table gives no rows; a column
    of ``keep`` that is called like a result gives way to it.
    """
    keep = kept_columns(keep or [], ["doc_id", "n_sentences", "n_removed", "n_spans", "clean_text"])
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"),
        F.col(text_col).alias("_text"),
        *[F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep],
    )
    types = dict(source.dtypes)
    hashed = source.select("_text").mapInArrow(_rows(min_sentences, min_words, False), "hash long")
    rows = source.select("doc_id", "_key", "_text").mapInArrow(_rows(min_sentences, min_words, True), f"doc_id {types['doc_id']}, _key long, first int, last int, hash long, digest long")
    place, spread = F.struct("doc_id", "_key", "first"), ["doc_id", "_key", "first"]
    repeated = materialize(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "span-repeated")
    found = materialize(join_counted(rows, repeated, ["hash"], spread), "span-found")
    discard(repeated)
    origins = materialize(found.groupBy("hash", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin")).where("n > 1"), "span-origins")
    hits = join_counted(found, origins, ["hash", "digest"], spread).where(~place.eqNullSafe(F.col("origin")))
    by_doc = hits.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("first", "last")).alias("_hits"))
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_hits")
    joined = source.join(by_doc, source["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left").drop("_id", "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, counts, removed, runs = _removed(batch.column("_text"), batch.column("_hits").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(clean, pa.string()), *[batch.column(f"_keep_{c}") for c in keep]],
                names=["doc_id", "n_sentences", "n_removed", "n_spans", "clean_text", *keep],
            )

    schema = f"doc_id {types['doc_id']}, n_sentences long, n_removed long, n_spans long, clean_text string" + "".join(f", `{c}` {types[f'_keep_{c}']}" for c in keep)
    return joined.mapInArrow(run, schema)
