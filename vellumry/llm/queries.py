"""Registered queries of this subpackage, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumry.llm import arrow_out, decontam, lm_score, packing, quality, simhash, token_count, topk, toxicity, url_filter
from vellumry.llm.common import shared_dir, table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each benchmark item: (query_id, rank, doc_id, score)."""
    return topk.topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pseudo-log-likelihood by a network trained on all documents: (doc_id, n_words, score, mean_score)."""
    return lm_score.score(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL with its calibrated log-odds and whether it is kept: (page_id, url, score, keep)."""
    return url_filter.classify(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's batch: (doc_id, n_tokens, bucket, bucket_len, batch, slot)."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score and whether it is toxic: (doc_id, score, toxic)."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score and whether it is kept: (doc_id, score, keep)."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items of which they hold a passage: (doc_id, item_id)."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of near copies, named by its least doc_id: (doc_id, group_id, n_words)."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids as Arrow files in the shared folder; their index: (doc_id, part, n_tokens, file, batch, row, crc32)."""
    return arrow_out.write(table(spark, sf_dir, "documents"), shared_dir(spark, "sequences"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of tokens: (doc_id, n_tokens)."""
    return token_count.count(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_lm_scores": op2_lm_scores,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_simhash_groups": op8_simhash_groups,
    "op9_arrow_sequences": op9_arrow_sequences,
    "op10_token_counts": op10_token_counts,
}

ORACLE: dict[str, str] = {
    "op1_topk_search": topk.sql(),
    "op4_packing": packing.sql(),
}
