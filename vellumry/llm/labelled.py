"""Bounded samples of labelled documents, for the classifiers to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.llm.common import lowest, materialize

#: Characters that a sample's texts may have in all.
TRAIN_CHARS = 1 << 27


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """Whole texts and labels (0 or 1) of at most `rows` labelled documents, those whose doc_id hashes lowest; the same at every run.

    Labels other than 0 and 1, null ids and null texts are left out. A doc_id with several labels counts by the greatest, one with several texts by the one
    that hashes lowest. Documents come in order of their hashes as long as their texts have at most `chars` characters in all, and the first in any case. Both
    bounds cap only what is learnt from; they hold the sample to what one machine can train on.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("id"))
    chosen = lowest(known, "h", rows).orderBy("h", "id").limit(rows)
    own = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    # Of each id one text: the repeats of an id meet in partial aggregates and never on the driver.
    found = materialize(own.groupBy("h", "id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")), "sample")
    upto, total = 0, 0
    sizes = sorted((r.h, r.id, r.n) for r in found.select("h", "id", F.length("text").alias("n")).collect())
    for _, _, n in sizes:
        total += n
        if total > chars and upto:
            break
        upto += 1
    if not sizes:
        return [], []
    h, ident, _ = sizes[upto - 1]
    kept = found.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("id") <= ident))).collect()
    kept.sort(key=lambda r: (r.id, r.text))
    return [r.text for r in kept], [r.y for r in kept]
