"""Fill-in-the-middle texts: cut at two drawn units and reordered behind markers.

A unit is a run of ASCII letters or any other single code point.  Whether a byte begins a unit depends on itself and the
byte before it only, so a text is cut into chunks that overlap by one byte, each chunk counts its own units, and a prefix
sum over the chunks tells which chunk owns a cut.  Only the owning chunks are looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import SLICE_BYTES, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk.
CHUNK_BYTES = 1 << 14

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


def _starts(data: np.ndarray, low: int, high: int, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of data[low:high] begin a unit, and which a code point; ``firsts`` are the places where texts begin."""
    point = (data[low:high] & 0xC0) != 0x80
    letter = _LETTER[data[max(low - 1, 0) : high]]
    if not low:
        letter = np.concatenate([np.zeros(1, bool), letter])
    unit = point & ~(letter[1:] & letter[:-1])
    a, b = np.searchsorted(firsts, [low, high])
    unit[firsts[a:b] - low] = True
    return unit, point


class Chunks:
    """The chunks of all texts of one slice, with the numbers of units and code points before each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk_bytes: int = CHUNK_BYTES):
        self.data, self.firsts = data, offsets[:-1][np.diff(offsets) > 0]
        count = -(-np.diff(offsets) // chunk_bytes)
        self.of_text = np.concatenate([[0], np.cumsum(count)])
        nth = np.arange(self.of_text[-1]) - np.repeat(self.of_text[:-1], count)
        self.low = np.repeat(offsets[:-1], count) + nth * chunk_bytes
        self.high = np.minimum(self.low + chunk_bytes, np.repeat(offsets[1:], count))
        self.rescanned = 0
        units, points = np.zeros(len(self.low), np.int64), np.zeros(len(self.low), np.int64)
        i = 0
        while i < len(self.low):
            # chunks that are side by side are searched in one pass, of bounded size however long a text is
            j = max(i + 1, int(np.searchsorted(self.high, self.low[i] + SLICE_BYTES, "right")))
            unit, point = _starts(data, int(self.low[i]), int(self.high[j - 1]), self.firsts)
            at = self.low[i:j] - self.low[i]
            units[i:j], points[i:j] = np.add.reduceat(unit, at, dtype=np.int64), np.add.reduceat(point, at, dtype=np.int64)
            i = j
        self.units = np.concatenate([[0], np.cumsum(units)])
        self.points = np.concatenate([[0], np.cumsum(points)])

    def totals(self) -> np.ndarray:
        """Units of each text."""
        return self.units[self.of_text[1:]] - self.units[self.of_text[:-1]]

    def cut(self, text: int, ranks: tuple[int, int], end: int) -> list[tuple[int, int]]:
        """(byte, code points ahead of it in the text) where the units of the given ranks begin; the rank behind the last
        unit is the end of the text."""
        a, b = self.of_text[text], self.of_text[text + 1]
        base, seen, out = self.points[a], None, []
        for rank in ranks:
            target = self.units[a] + rank
            if target == self.units[b]:
                out.append((end, int(self.points[b] - base)))
                continue
            owner = int(np.searchsorted(self.units, target, "right")) - 1
            if seen is None or seen[0] != owner:
                seen = owner, *_starts(self.data, int(self.low[owner]), int(self.high[owner]), self.firsts)
                self.rescanned += 1
            at = int(np.flatnonzero(seen[1])[target - self.units[owner]])
            out.append((int(self.low[owner]) + at, int(self.points[owner] - base + np.count_nonzero(seen[2][:at]))))
        return out


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    Four draws come from the SHA-256 of ``seed:doc_id``.  The first two choose the units where the prefix and the middle
    end, the third leaves a text plain in 100 - ``plain_from`` of 100 cases, the fourth puts the suffix first (``spm``) in
    ``spm_below`` of 100.  ``n`` counts units; prefix_chars and middle_chars count code points and are null where plain.

    A null text is an empty one; an empty text and one that contains a marker stay plain, so :func:`restore` is exact.  A
    null id is drawn as ``seed:null``; rows that repeat an id draw alike, each for its own text; an empty table gives no
    rows; other columns are not read.  Nothing is shuffled.  A text is held about four times by one task, as bytes: the
    arrays of the search are those of one pass of chunks, not of the text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest.alias("digest"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_draw(F.col("digest"), 3) % 100 >= plain_from)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 4) % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), form.alias("form"), _draw(F.col("digest"), 1).alias("h1"), _draw(F.col("digest"), 2).alias("h2"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column("form").to_pylist()
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for low, high, data, offsets in slices(batch.column("text")):
                chunks = Chunks(data, offsets, chunk_bytes)
                n = chunks.totals()
                first, second = h1[low:high] % (n + 1), h2[low:high] % (n + 1)
                raw = memoryview(data)
                prefix_chars, middle_chars, outputs = [], [], []
                for k, form in enumerate(forms[low:high]):
                    start, end = int(offsets[k]), int(offsets[k + 1])
                    if form == "plain":
                        prefix_chars.append(None)
                        middle_chars.append(None)
                        outputs.append(bytes(raw[start:end]))
                        continue
                    ranks = min(first[k], second[k]), max(first[k], second[k])
                    (a, chars), (b, upto) = chunks.cut(k, ranks, end)
                    prefix_chars.append(chars)
                    middle_chars.append(upto - chars)
                    head, body, tail = raw[start:a], raw[a:b], raw[b:end]
                    outputs.append(b"".join((p, head, s, tail, m, body) if form == "psm" else (s, tail, p, head, m, body)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(n, pa.int64()), pa.array(forms[low:high], pa.string()), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.binary())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    made = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` of.

    A marker neither overlaps itself nor occurs in the text, and its brackets stand at its ends only, so each marker of an
    output occurs once, where it was put.
    """
    def part(marker: str, until: str | None) -> Column:
        rest = F.split_part(output, F.lit(marker), F.lit(2))
        return rest if until is None else F.split_part(rest, F.lit(until), F.lit(1))

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
