"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), n_shards=8)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.decontamination import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("clean_text")


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.span_dedup import span_dedup

    return span_dedup(_table(spark, sf_dir, "documents")).drop("clean_text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.toxicity import learn, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    labels = _table(spark, sf_dir, "labels").where(fold != 1)
    scored = score(docs, learn(docs, labels), threshold=0.7, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_matches")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.topk_search import topk_hamming

    return topk_hamming(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=10)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.lm_scoring import score_corpus

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return score_corpus(_table(spark, sf_dir, "documents"), held_out=crc % 10 == 0, deleted=F.floor(crc / 10) % 8 == 0)


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can give, for comparison."""
    scored = op1_lm_scoring(spark, sf_dir)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.suffix_dedup import REPORT, suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents"), length=400, report=REPORT).drop("kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.token_counts import document_token_counts

    return document_token_counts(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.sentencepiece_codec import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), with_ids=False)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.fingerprints import fingerprint_neighbours

    made = fingerprint_neighbours(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return made.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op11 that SQL can give, for comparison."""
    return op11_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.fill_in_middle import fill_in_middle, restore

    made = fill_in_middle(_table(spark, sf_dir, "documents"), seed=1)
    digest = lambda text, name: F.sha2(text.cast("binary"), 256).alias(name)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output"), "output_sha256"), digest(restore(F.col("output"), F.col("form")), "restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.vector_codes import codebooks_sha256, encode_vectors, with_label_errors

    coded, books = encode_vectors(_table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_toxicity": op3_toxicity,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_sharding": op7_sharding,
        "op8_span_dedup": op8_span_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_topk_search": op10_topk_search,
        "op11_fingerprints": op11_fingerprints,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_vector_codes": op13_vector_codes,
        "lm_base_scores": lm_base_scores,
        "fingerprint_edits": fingerprint_edits,
    }


def oracle_sql() -> dict[str, str]:
    from netlens.llm import oracles

    return {
        "op5_near_dedup": oracles.OP5_SQL,
        "op7_sharding": oracles.OP7_SQL,
        "op9_decontamination": oracles.OP9_SQL,
        "op10_topk_search": oracles.OP10_SQL,
        "op12_fill_in_middle": oracles.OP12_SQL,
        "op13_vector_codes": oracles.OP13_SQL,
        "lm_base_scores": oracles.LM_BASE_SQL,
        "fingerprint_edits": oracles.FINGERPRINT_EDITS_SQL,
    }
