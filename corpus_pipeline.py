"""From raw documents to packed batches: each stage works on all that the one before it kept, written as Parquet between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumry.llm import decontam, packing, quality, simhash, toxicity
from vellumry.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose worst sentence is toxic. Null, empty and wordless texts stay, and so do null ids and repeated rows that aren't toxic, each. Where the
    labels are empty or of one kind nothing is learnt and all documents stay. Columns are those of docs, whatever their names."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of low quality; null and blank texts count as such. Null ids and repeated rows are judged each by their text. Where the labels are
    empty or of one kind only null and blank texts go. Columns are those of docs, whatever their names."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id; of rows alike one. Rows with a null doc_id stay, and null or wordless texts are no copies of
    each other: one row of each doc_id stays. Columns are those of docs, whatever their names."""
    return simhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of a benchmark item. Null and wordless texts hold none; null ids and repeated rows are judged each. With an empty
    benchmark all documents stay. Columns are those of docs, whatever their names."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, slot) for every row of docs, null ids and repeated rows each; null and blank texts are one token long."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack_batches),
]

#: Trained classifiers and numpy alignment have no SQL form; the stages are tested against brute force and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, of all documents that the stages before keep. Each stage is written as Parquet to the shared folder and read again; an empty table of
    documents goes through all of them and gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
