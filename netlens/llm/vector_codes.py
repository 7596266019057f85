"""Product codes of vectors: a codebook for each part of the vectors, fitted by Lloyd's rounds with group bounds.

The entries of a codebook are clustered into groups once.  For each vector part and group one lower bound of the distance
to the group's entries is kept; between rounds it falls by the group's largest drift.  Only groups whose bound no longer
clears the distance to the own entry are scanned.  Bounds are floats that are rounded to the safe side; what is scanned is
decided in integers, so ties always go to the lesser index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import join_counted, materialize

#: Integer components stay within this size; larger ones are set to it, so squared distances fit into 64 bits.
LARGEST = 1 << 26
#: Bytes of 64-bit components in one block.
BLOCK_BYTES = 1 << 22
_FAR = np.iinfo(np.int64).max
#: How much bounds are moved to the safe side: far more than the rounding of a few sums and roots.
_SAFE = 1e-12


def part_bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts, equal where ``parts`` divides ``dims``."""
    edges = [k * dims // parts for k in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) as exact integers: a float product where no sum reaches 2^53, else in integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 52:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return np.rint((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        out[:, j] = ((x - entry) ** 2).sum(1)
    return out


def own_squared(x: np.ndarray, entries: np.ndarray, assigned: np.ndarray) -> np.ndarray:
    return ((x - entries[assigned]) ** 2).sum(1)


def group_entries(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Group of each entry: a few rounds of nearest means from seeds that lie far apart.  Any grouping gives right codes; a
    good one gives tight bounds."""
    points = entries.astype(np.float64)
    groups = min(groups, len(points))
    seeds = [0]
    while len(seeds) < groups:
        gap = ((points[:, None] - points[seeds]) ** 2).sum(2).min(1)
        seeds.append(int(gap.argmax()))
    means = points[seeds]
    for _ in range(rounds):
        own = ((points[:, None] - means) ** 2).sum(2).argmin(1)
        means = np.stack([points[own == g].mean(0) if (own == g).any() else means[g] for g in range(groups)])
    return ((points[:, None] - means) ** 2).sum(2).argmin(1)


@dataclass
class Fit:
    """All codebooks so far, [round][part] -> (entries, width), and the groups of each part."""

    bounds: list[tuple[int, int]]
    books: list[list[np.ndarray]]
    groups: list[np.ndarray]

    def assign(self, x: np.ndarray, part: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row of one part under the last codebook.

        The rounds are gone through again from the first: the bounds live in the task and are neither written nor
        shuffled, and a lost task needs only its own rows.  ``seen`` counts the distances that were computed.
        """
        books, group = [b[part] for b in self.books], self.groups[part]
        names = np.unique(group)
        member = [np.flatnonzero(group == g) for g in names]
        place = np.searchsorted(names, group)
        n = len(x)
        rows = np.arange(n)
        dist = squared(x, books[0])
        own = dist.argmin(1)
        best = dist[rows, own]
        dist[rows, own] = _FAR
        lower = np.stack([np.sqrt(dist[:, m].min(1)) for m in member], 1) * (1 - _SAFE)
        upper = np.sqrt(best) * (1 + _SAFE)
        exact = np.ones(n, bool)
        computed = dist.size
        for before, now in zip(books[:-1], books[1:], strict=True):
            drift = np.sqrt(((now - before) ** 2).sum(1)) * (1 + _SAFE)
            lower -= np.array([drift[m].max() for m in member])
            upper += drift[own]
            exact &= drift[own] == 0
            # the own distance is measured only where the carried bound is not enough
            open_ = np.flatnonzero((lower.min(1) <= upper) & ~exact)
            best[open_] = own_squared(x[open_], now, own[open_])
            upper[open_] = np.sqrt(best[open_]) * (1 + _SAFE)
            exact[open_] = True
            computed += len(open_)
            failed = lower <= upper[:, None]
            at = np.flatnonzero(failed.any(1))
            if not len(at):
                continue
            failed, old, line = failed[at], own[at], np.arange(len(at))
            dist = np.full((len(at), len(now)), _FAR, np.int64)
            dist[line, old] = best[at]
            for g, entries in enumerate(member):
                hit = np.flatnonzero(failed[:, g])
                if len(hit):
                    dist[np.ix_(hit, entries)] = squared(x[at[hit]], now[entries])
                    computed += len(hit) * len(entries)
            new = dist.argmin(1)
            best[at] = dist[line, new]
            own[at] = new
            upper[at] = np.sqrt(best[at]) * (1 + _SAFE)
            exact[at] = True
            dist[line, new] = _FAR
            for g, entries in enumerate(member):
                hit = np.flatnonzero(failed[:, g])
                lower[at[hit], g] = np.sqrt(dist[np.ix_(hit, entries)].min(1)) * (1 - _SAFE)
            # an entry that was left counts for the bound of its group again
            left = np.flatnonzero(new != old)
            home = place[old[left]]
            lower[at[left], home] = np.minimum(lower[at[left], home], np.sqrt(dist[left, old[left]]) * (1 - _SAFE))
        rest = np.flatnonzero(~exact)
        best[rest] = own_squared(x[rest], books[-1], own[rest])
        if seen is not None:
            seen["computed"] = seen.get("computed", 0) + computed + len(rest)
            seen["full"] = seen.get("full", 0) + n * len(books[0]) * len(books)
        return own, best


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def _pack(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """Kept vectors as blocks of integers: (n, width, vectors, ids, labels)."""
    kinds = dict(rows.dtypes)
    block = max(1, BLOCK_BYTES // (8 * max(1, dims)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, block):
                batch = whole.slice(low, block)
                vectors = batch.column("vector")
                # lengths before the flat values: a null vector may still cover values in its buffer
                kept = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims
                batch = batch.filter(pa.array(kept))
                flat = batch.column("vector").flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null becomes NaN
                good = np.isfinite(x).all(1)
                batch, x = batch.filter(pa.array(good)), _whole(x[good], scale)
                if not len(x):
                    continue
                kind = next(k for k in (np.int16, np.int32) if np.abs(x).max(initial=0) <= np.iinfo(k).max)
                one = lambda name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), batch.column(name))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int32()), pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary()), one("vec_id"), one("label")],
                    names=["n", "width", "vectors", "ids", "labels"],
                )

    return rows.mapInArrow(run, f"n int, width int, vectors binary, ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>")


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for n, width, raw in zip(batch.column("n"), batch.column("width"), batch.column("vectors"), strict=True):
        yield np.frombuffer(raw.as_buffer(), f"<i{width.as_py()}").reshape(n.as_py(), -1).astype(np.int64)


def encode_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, groups: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, and the final codebook of each part.

    Components become floor(``scale`` * x).  A codebook starts as the parts of the ``entries`` least ids; each round
    assigns every part to its nearest entry (ties to the lesser index) and moves used entries to floor(mean).  The code
    is two hex digits a part, the error the sum of the final squared distances.

    Dropped are null vectors and those with a null or non-finite component, or of another length than the first kept one
    has.  Components beyond ``LARGEST`` count as it.  Fewer vectors than entries make a smaller codebook; ids that repeat
    are entries and rows of their own, in the order of their components; a null id comes last; null labels are labels;
    an empty table gives no rows.  Other columns are not read.

    The vectors are packed once into blocks in the shared folder (2 bytes a component where they fit).  A round reads the
    blocks and returns one sum for each task, part and entry; the driver holds codebooks only: entries x dims numbers.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.where(F.col("vector").isNotNull() & ~F.exists("vector", bad))
    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = kept.orderBy(*order).select(F.size("vector").alias("n")).limit(1).collect()
    if not first:
        return spark.createDataFrame([], schema), []
    dims = first[0]["n"]
    seeds = kept.where(F.size("vector") == dims).orderBy(*order).select("vector").limit(entries).collect()
    start = np.stack([_whole(np.array(r["vector"], np.float64), scale) for r in seeds])
    bounds = part_bounds(dims, parts)
    books = [[start[:, a:b] for a, b in bounds]]
    fit = Fit(bounds, books, [group_entries(book, groups) for book in books[0]])
    blocks = materialize(_pack(rows, dims, scale), "vector-blocks")
    for _ in range(rounds):
        totals = _sums(blocks, fit)
        books.append([_moved(book, totals, p) for p, book in enumerate(books[-1])])
    return _codes(blocks, fit, schema), books[-1]


def _sums(blocks: DataFrame, fit: Fit) -> dict[tuple[int, int, int], tuple[int, int]]:
    """{(part, entry, position): (sum, count)} under the last codebook."""
    given = blocks.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, sums, counts = given.value, {}, {}
        for batch in batches:
            for x in _blocks(batch):
                for p, (a, b) in enumerate(fit.bounds):
                    own, _ = fit.assign(x[:, a:b], p)
                    k = len(fit.books[-1][p])
                    # a block's sums stay far under 2^53, so the product is exact
                    chosen = (own[:, None] == np.arange(k)).astype(np.float64)
                    sums[p] = sums.get(p, 0) + np.rint(chosen.T @ x[:, a:b].astype(np.float64)).astype(np.int64)
                    counts[p] = counts.get(p, 0) + np.bincount(own, minlength=k)
        for p in sums:
            k, width = sums[p].shape
            columns = [np.full(k * width, p), np.repeat(np.arange(k), width), np.tile(np.arange(width), k), sums[p].ravel(), np.repeat(counts[p], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "position", "total", "n"])

    rows = blocks.select("n", "width", "vectors").mapInArrow(run, "part long, entry long, position long, total long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = rows.groupBy("part", "entry", "position").agg(wide("total"), wide("n")).collect()
    return {(r["part"], r["entry"], r["position"]): (int(r["total"]), int(r["n"])) for r in found}


def _moved(book: np.ndarray, totals: dict, part: int) -> np.ndarray:
    out = book.copy()
    for j, i in np.ndindex(*book.shape):
        total, n = totals.get((part, j, i), (0, 0))
        if n:
            out[j, i] = total // n
    return out


def _codes(blocks: DataFrame, fit: Fit, schema: str) -> DataFrame:
    given = blocks.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = given.value
        for batch in batches:
            for k, x in enumerate(_blocks(batch)):
                codes, errors = np.zeros((len(x), len(fit.bounds)), np.uint8), np.zeros(len(x), np.int64)
                for p, (a, b) in enumerate(fit.bounds):
                    own, far = fit.assign(x[:, a:b], p)
                    codes[:, p] = own
                    errors += far
                digits, width = codes.tobytes().hex(), 2 * codes.shape[1]
                text = [digits[i : i + width] for i in range(0, len(digits), width)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(text, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Coded vectors with ``label_error``, the error summed over all rows of an equal label; null labels are one label.

    The codes are written once and read for the sums and the join.  A label of very many rows is dealt over several tasks.
    """
    key = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    rows = materialize(coded.select("*", *key), "vector-codes")
    sums = materialize(rows.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    return join_counted(rows, sums, ["_none", "_label"], ["vec_id", "code"]).select("vec_id", "label", "code", "error", "label_error")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal text, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
