"""A corpus from raw documents to token ids, in five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.common import aside, discard, scratch
from netlens.llm.decontamination import decontaminate
from netlens.llm.near_dedup import drop_near_duplicates
from netlens.llm.sentencepiece_codec import encode_documents
from netlens.llm.span_dedup import span_dedup
from netlens.llm.toxicity import learn, score


def _with_text(cleaned: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the text that an operator left and its length."""
    text = F.col("clean_text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _any_columns(stage: Stage) -> Stage:
    """The stage on documents with further columns of any names: they go through it under names that it does not use."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        moved, back = aside(docs, ["doc_id", "text", "n_chars"])
        return back(stage(spark, moved, sf_dir))

    return run


@_any_columns
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score under 0.7; learned from the labels whose crc32(doc_id) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    return score(docs, learn(docs, labels), threshold=0.7).where("predicted = 0").select(*docs.columns)


@_any_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs, shingle=5, num=80, den=100)


@_any_columns
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of spans that stood in an earlier document or place."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    return _with_text(span_dedup(docs, keep=rest), docs.columns)


@_any_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that lie in a window of a benchmark item."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    return _with_text(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=rest), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The learned lexicon, the content cuts of sentences and the Viterbi search are beyond SQL; tests/llm compares the near-duplicate,
#: substring, decontamination and token stages with plain code row by row, and the toxicity stage's matching and held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each result is written and read again, and what a stage wrote besides is
    removed, as is its input once it is used up.

    A null or empty text passes all stages and has no ids; rows that repeat id and text are one document from the second
    stage on; equal texts under several ids leave the least id; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as keep:
            after = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
