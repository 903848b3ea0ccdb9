"""Packing documents into batches of one padded length each, with the least padding.

A document's length is its number of runs of characters other than blank, tab, line feed and carriage return, 1 at least. The histogram of lengths over
all documents goes to the driver (it grows with the number of distinct lengths, not of documents). Dynamic programming over it finds the at most
BUCKETS upper lengths with the least total of padded lengths; of equal choices each boundary is the lowest. Since the cost obeys the quadrangle
inequality, each layer is solved by divide and conquer in m log m steps and the result is exact.

Inside a bucket documents are ordered by doc_id and cut into batches whose padded size fits BUDGET tokens; a document longer than that is a batch
of its own. Ranks are exact without gathering a bucket in one task, however ids are spread: rows are sorted by range partitions of bucket and id, written with their
places, and counts of each partition's buckets, of which there are no more than partitions and buckets, give what lies before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumry.llm.common import materialize

BUCKETS, BUDGET = 12, 65536


def length(text: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0))).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper lengths of at most `buckets` buckets with the least padding for this histogram (distinct lengths, ascending)."""
    m = len(lengths)
    if not m:
        return []
    n, upto = lengths.astype(np.int64), np.cumsum(counts, dtype=np.int64)
    cost = n * upto
    prev = []
    for layer in range(1, min(buckets, m)):
        new, arg = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
        todo = [(layer, m - 1, layer - 1, m - 2)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j - 1, last) + 1)
            c = cost[i] + n[j] * (upto[j] - upto[i])
            k = int(c.argmin())
            new[j], arg[j] = c[k], i[k]
            todo += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]
        cost = new
        prev.append(arg)
    j, cut = m - 1, [m - 1]
    for arg in reversed(prev):
        j = int(arg[j])
        cut.append(j)
    return [int(n[k]) for k in reversed(cut)]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, tokens: Callable[[Column], Column] = length) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, slot) for every row of docs; a batch is known by bucket and batch, both from 0.

    tokens: what counts a text's tokens, as a column; by default length(), which needs no vocabulary. Null and blank texts count as one token. Rows with a null
    doc_id come before the others of their bucket. Rows that repeat an id are each packed, in order of length, then of a hash of the text; rows equal in all that
    may take each other's place, and any number of them is spread over tasks. An empty table gives an empty result. Other columns, whatever their names, are
    not read.
    """
    sized = materialize(docs.select(F.col("doc_id").cast("long"), tokens(F.col("text")).cast("long").alias("n_tokens"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("salt")), "lengths")
    histogram = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram.sort()
    cut = boundaries(np.array([r.n_tokens for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), buckets)
    if not cut:
        return sized.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_len"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    bucket, upper, size = F.lit(len(cut) - 1), F.lit(cut[-1]), F.lit(max(1, budget // cut[-1]))
    for k in range(len(cut) - 2, -1, -1):
        fits = F.col("n_tokens") <= cut[k]
        bucket, upper, size = F.when(fits, k).otherwise(bucket), F.when(fits, cut[k]).otherwise(upper), F.when(fits, max(1, budget // cut[k])).otherwise(size)
    order = [F.asc("bucket"), F.asc_nulls_first("doc_id"), F.asc("n_tokens"), F.asc("h"), F.asc("salt")]
    placed = sized.withColumn("bucket", bucket).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.select("doc_id", "n_tokens", "bucket", F.monotonically_increasing_id().alias("place")), "placed")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part"), "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    start = counts.select("part", F.col("bucket").alias("of"), (F.col("first") - before).alias("start"))
    rank = F.col("place") - F.col("start")
    ranked = placed.join(F.broadcast(start), (part == F.col("part")) & (F.col("bucket") == F.col("of"))).withColumns({"bucket_len": upper.cast("long"), "cap": size})
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(rank / F.col("cap")).alias("batch"), (rank % F.col("cap")).alias("slot"))


def sql(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """DuckDB SQL for pack() over documents that have more distinct lengths than buckets."""
    layers = ["l1 AS (SELECT i, n * upto AS cost, NULL::BIGINT AS prev FROM p)"]
    for k in range(2, buckets + 1):
        layers.append(f"l{k} AS (SELECT b.i AS i, min(x.cost + b.n * (b.upto - a.upto)) AS cost, arg_min(a.i, (x.cost + b.n * (b.upto - a.upto), a.i)) AS prev FROM p b JOIN p a ON a.i < b.i JOIN l{k - 1} x ON x.i = a.i GROUP BY b.i)")
    cuts = [f"c{buckets} AS (SELECT max(i) AS i FROM p)"] + [f"c{k - 1} AS (SELECT prev AS i FROM l{k} WHERE i = (SELECT i FROM c{k}))" for k in range(buckets, 1, -1)]
    union = " UNION ALL ".join(f"SELECT {k - 1} AS bucket, n AS upper_len FROM p WHERE i = (SELECT i FROM c{k})" for k in range(1, buckets + 1))
    return f"""WITH d AS (SELECT doc_id, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')))::BIGINT AS n_tokens FROM documents),
h AS (SELECT n_tokens AS n, count(*) AS c FROM d GROUP BY n_tokens),
p AS (SELECT n, row_number() OVER (ORDER BY n) AS i, (sum(c) OVER (ORDER BY n))::BIGINT AS upto FROM h),
{', '.join(layers)}, {', '.join(cuts)},
u AS ({union}),
v AS (SELECT bucket, upper_len, lag(upper_len, 1, 0) OVER (ORDER BY bucket) AS lower_len FROM u),
r AS (SELECT doc_id, n_tokens, bucket, upper_len, greatest(1, {budget} // upper_len) AS cap, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS r FROM d JOIN v ON n_tokens > lower_len AND n_tokens <= upper_len)
SELECT doc_id, n_tokens, bucket::INTEGER AS bucket, upper_len::BIGINT AS bucket_len, (r // cap)::BIGINT AS batch, (r % cap)::BIGINT AS slot FROM r"""
