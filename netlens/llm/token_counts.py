"""Token counts by a separator scan of flat, unindexed token files.

A token file is nothing but ids, one after the other, with an end-of-document id behind each document.  It is read in
blocks of equal size that know nothing of documents: each block is searched for the separator with one vectorised
comparison, and a prefix scan over the blocks of a file carries the tokens of a document that began earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens.llm.sentencepiece_codec import MODEL, encode_many, load

#: Tokens of a block, and blocks of a file at most.
BLOCK_TOKENS, FILE_BLOCKS = 1 << 16, 256


def write_blocks(docs: DataFrame, end_id: int, model: str = MODEL, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Flat token files as rows (file, block, tokens): ids of all texts, ``end_id`` behind each, cut every
    ``block_tokens`` ids.  ``closed`` names the documents that end in a block; the scan does not read it."""
    pieces = docs.sparkSession.sparkContext.broadcast(load(model))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block = TaskContext.get().partitionId() << 32, 0
        held: list[np.ndarray] = []
        size, closed = 0, []  # closed: (position of the end in what is held, id)
        id_type = None

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal file, block, held, size, closed
            ids = np.concatenate(held) if held else np.zeros(0, dtype)
            at = 0
            while at + block_tokens <= len(ids) or (final and at < len(ids)):
                part = ids[at : at + block_tokens]
                own = [x for p, x in closed if p < at + len(part)]
                closed = closed[len(own) :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int64()), pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([own], pa.list_(id_type))], names=["file", "block", "tokens", "closed"]
                )
                block += 1
                at += len(part)
            held, size = [ids[at:]], len(ids) - at
            closed = [(p - at, x) for p, x in closed]

        def encoded(texts: pa.Array) -> Iterator[np.ndarray]:
            for low in range(0, len(texts), 500):
                ids, offsets = encode_many(texts.slice(low, 500).to_pylist(), pieces.value)
                yield from (ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("_text")), strict=True):
                own = np.append(ids, end_id).astype(dtype)
                held.append(own)
                size += len(own)
                closed.append((size - 1, doc))
                if size >= block_tokens:
                    # a file ends with a document once it is long enough
                    full = block + size // block_tokens >= FILE_BLOCKS
                    yield from cut(full)
                    if full:
                        file, block = file + 1, 0
        if size:
            yield from cut(True)

    return source.mapInArrow(run, f"file long, block int, tokens binary, closed array<{kind}>")


def read_blocks(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files in any store that Spark reads; a file may have 2 GB at most."""
    step = block_tokens * np.dtype(dtype).itemsize
    whole = spark.read.format("binaryFile").load(path).where("length > 0")
    parts = whole.select(F.col("path").alias("file"), "content", F.posexplode(F.sequence(F.lit(0), F.col("length").cast("int") - 1, F.lit(step))).alias("block", "at"))
    return parts.select("file", "block", F.expr(f"substring(content, at + 1, {step})").alias("tokens"))


def count_tokens(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """(file, doc_no, n_tokens, block, nth) of every document in files given as rows (file, block, tokens).

    doc_no counts the documents of a file from 0; n_tokens leaves the separator out; block and nth say where its end
    stands.  What follows the last separator of a file is a document too, whose nth is null; a document may be empty, a
    file without tokens has none.  Rows may come in any order; a null tokens value is an empty block.  Only lengths are
    shuffled, and the scan holds one file of bounded size at a time.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, inner, tails, counts = [], [], [], []
            for x in batch.column("tokens"):
                ids = np.frombuffer(x.as_py() or b"", dtype)
                at = np.flatnonzero(ids == end_id)
                counts.append(len(at))
                heads.append(int(at[0]) if len(at) else 0)
                inner.append((np.diff(at) - 1).tolist())
                tails.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(counts, pa.int64()), pa.array(heads, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(tails, pa.int64())],
                names=["file", "block", "ends", "head", "inner", "tail"],
            )

    kinds = dict(blocks.dtypes)
    found = blocks.select("file", "block", "tokens").mapInArrow(search, f"file {kinds['file']}, block {kinds['block']}, ends long, head long, inner array<long>, tail long")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # tokens left open by the blocks before: all their tails, less those ahead of the last block that has a separator
    stitched = (
        found.withColumn("tails", F.coalesce(F.sum("tail").over(before), F.lit(0)))
        .withColumn("closed", F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("tails")), ignorenulls=True).over(before), F.lit(0)))
        .withColumn("docs", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("final", F.lead("block").over(order).isNull())
        .withColumn("carry", F.col("tails") - F.col("closed"))
    )
    ended = stitched.where("ends > 0").select(
        "file", "docs", "block", F.posexplode(F.concat(F.array(F.col("head") + F.col("carry")), "inner")).alias("nth", "n_tokens")
    )
    ended = ended.select("file", (F.col("docs") + F.col("nth")).alias("doc_no"), "n_tokens", "block", "nth")
    left = F.col("tail") + F.when(F.col("ends") > 0, 0).otherwise(F.col("carry"))
    open_ = stitched.where(F.col("final") & (left > 0)).select("file", (F.col("docs") + F.col("ends")).alias("doc_no"), left.alias("n_tokens"), "block", F.lit(None).cast("int").alias("nth"))
    return ended.unionByName(open_)


def document_token_counts(docs: DataFrame, end_id: int = 2, model: str = MODEL, dtype: str = "<u2") -> DataFrame:
    """doc_id and n_tokens of every row of ``docs``, counted in the token files that :func:`write_blocks` makes of them.

    A null or empty text has 0 tokens; repeated rows each have their row; an empty table gives no rows.
    """
    from netlens.llm.common import materialize

    blocks = materialize(write_blocks(docs, end_id, model, dtype), "token-files")
    counts = count_tokens(blocks, end_id, dtype)
    names = blocks.select("file", "block", F.posexplode("closed").alias("nth", "doc_id"))
    return counts.join(names, ["file", "block", "nth"]).select("doc_id", "n_tokens", "file", "doc_no")
