"""Helpers shared by the operators: shared storage, packed text batches, word spans and 64-bit span hashes.

Text reaches Python as Arrow batches.  A batch is viewed as one byte array plus document offsets, so that
tokenising and hashing are a handful of numpy passes over many documents instead of a loop over words.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows of one key in a join beyond which its rows are dealt over several tasks, and the most keys that may be so dealt.
HOT_ROWS, HOT_KEYS = 50_000, 100_000

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.  Only in local mode, as in tests, it may be unset: then it is
    a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="netlens-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def write_shared(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet below the shared folder and return the path; it is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/netlens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back (survives lost executors)."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Write ``df`` to the shared folder in sorted buckets of ``keys`` and read it: joins by these keys do not shuffle it."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/netlens/{table}"
    n = partitions(spark)
    _written.append((spark, path))
    _tables.append((spark, table))
    df.repartition(n, *keys).write.option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for item in [x for x in _written if path.endswith(x[1].split("://")[-1].lstrip("/")) or x[1].endswith(path)]:
                _remove(*item)
                _written.remove(item)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, table in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the JVM may be gone already at interpreter exit
            return
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:
            return


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """For a step whose result is written: gives a :func:`materialize` for the result, and removes all else that was
    written inside at the end, also where the step fails."""
    before, kept = len(_written), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(_written[-1])
        return out

    try:
        yield keep
    finally:
        for item in _written[before:]:
            if item not in kept:
                _remove(*item)
        _written[before:] = kept


def partitions(spark: SparkSession) -> int:
    """Number of reduce-side groups to aim at: what the session's shuffles use."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``rows`` joined by ``keys`` with ``counted``, a written table of one row a key whose ``n`` says how many rows have it.

    Keys of very many rows are dealt over salts by the columns ``spread``, so no task gets all rows of one key.  The limit
    rises with the total, so fewer than ``HOT_KEYS`` keys can lie above it and their list may be broadcast.
    """
    total, most = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if most <= limit:
        return rows.join(counted.drop("n"), keys)
    parts = F.ceil(F.col("n") / limit).cast("int")
    hot = counted.where(F.col("n") > limit).select(*keys, parts.alias("_parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    copies = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def aside(df: DataFrame, own: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with every column but ``own`` under a name that no operator uses, and what gives the names back."""
    names = {c: f"_aside_{k}" for k, c in enumerate(df.columns) if c not in own}
    moved = df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
    return moved, lambda out: out.select(*[F.col(names.get(c, f"`{c}`")).alias(c) for c in df.columns])


def kept_columns(keep: list[str], own: list[str]) -> list[str]:
    """The columns of ``keep`` that go through an operator: those whose names its own results do not have."""
    taken = {c.lower() for c in own}
    return [c for c in keep if c.lower() not in taken]


# ---------------------------------------------------------------- packed text


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    blob = column.buffers()[2]
    data = np.frombuffer(blob, np.uint8) if blob is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; every row is whole."""
    data, offsets = packed(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def byte_table(word: str) -> np.ndarray:
    """Boolean table over byte values for a regex class of single bytes, given as the excluded ranges 'a-b,c-d' in hex."""
    table = np.ones(256, bool)
    for part in word.split(","):
        first, _, last = part.partition("-")
        table[int(first, 16) : int(last or first, 16) + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = byte_table("20,09-0D")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case
ALNUM_WORDS = byte_table("00-2F,3A-60,7B-7F")
ALNUM_WORDS[ord("A") : ord("Z") + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, token offsets by document) of the maximal runs of word bytes; no run crosses documents."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashes

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any byte spans of one array, each in constant time after one prefix sum."""

    def __init__(self, data: np.ndarray):
        forward, self.back = _power(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        values = _BYTES[data] if data.dtype == np.uint8 else data
        np.cumsum(values * forward[: len(data)], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64))


def token_hash(words: np.ndarray) -> SpanHash:
    """Hashes of any runs of consecutive tokens, from the tokens' own hashes."""
    return SpanHash(words | np.uint64(1))


def chain(*parts: np.ndarray) -> np.ndarray:
    """Hash of equally long columns of hashes, in order."""
    total = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + part)
    return total


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the LONG with the same bits."""
    return x.astype(np.uint64).view(np.int64)
