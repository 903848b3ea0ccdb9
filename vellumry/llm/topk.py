"""Exact top-k search with an impact-ordered, score-at-a-time index.

Score. BM25 in whole millionths, so that sums don't depend on their order and ties are exact: for each distinct word t of the query that the document
has, floor(0.5 + 1e6 * idf(t) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length))), with idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
N, df and the mean length are those of all documents that have words. Results are ordered by score, then by the lesser doc_id.

Index. Documents are parted into shards of up to SHARD rows, and of about POSTINGS postings. In a shard each word's postings are cut into segments of equal
quantised impact (the document-dependent factor in LEVELS steps, rounded up), the highest first. Each task writes its shards' arrays one behind the other into
a file of its own in the shared folder, and tasks that search read them there, a shard at a time; Spark's rows only say where they lie, so the memory that a
task takes doesn't follow the size of the index.

Search. For each query a shard's segments, over all its words, are processed by descending impact bound. Accumulators hold a lower and an upper bound of
each document's score. Processing stops only on proof: when the sum of the words' highest bounds not yet processed can't lift any document outside
the candidates to the k-th best lower bound (or to the k-th best score of shards searched before in the task). Candidates are scored exactly.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumry.llm import textnum as tn
from vellumry.llm.common import checked, materialize, prepare, shared_dir

K1, B, LEVELS, SHARD, K = 1.2, 0.75, 255, 8192, 10
#: Pairs of document and word after which a shard ends, however few rows it has, and rows whose texts are taken out of Arrow at a time.
POSTINGS, PIECE = 1 << 22, 256
_STEP = (K1 + 1) / LEVELS
#: Candidates up to this many times k are scored exactly at once rather than narrowed further.
SLACK = 8
#: Characters that queries may have in all, since their words are sent to every executor.
MOST_CHARS = 1 << 26
#: A row per shard: its file, and where in it each array of _KINDS begins, and the last one ends.
INDEX = "file string, at array<long>"
_KINDS = {"doc_ids": np.int64, "lengths": np.int32, "terms": np.uint64, "df": np.int32, "segments": np.int32, "impacts": np.uint8, "starts": np.int32, "postings": np.uint16, "tf": np.int32}


def _pieces(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, list]]:
    """Runs of the column's texts, few enough to be held at once, and the row at which each begins."""
    for a in range(0, b.num_rows, PIECE):
        texts = b.column(column).slice(a, PIECE).to_pylist()
        for i, j in tn.chunks(texts):
            yield a + i, texts[i:j]


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for b in batches:
        for _, texts in _pieces(b, 0):
            cp, starts = tn.codepoints(texts)
            word = tn.folded(cp)[1]
            begins = np.flatnonzero(word & ~np.r_[False, word[:-1]])
            n = np.diff(np.searchsorted(begins, starts))
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": [docs], "total": [total]})


def _part(tf, length, mean):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class _Shard:
    """Documents gathered for a shard. Lists are emptied as their arrays are made, so postings are held about twice at most."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.docs, self.counts = [], [], [], [], []
        self.rows = self.postings = 0

    def add(self, ids: np.ndarray, texts: list) -> None:
        h, doc, *_ = tn.words(texts)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
        self.ids.append(ids)
        self.lengths.append(np.bincount(doc, minlength=len(texts)).astype(np.int32))
        self.terms.append(h[at])
        self.docs.append((doc[at] + self.rows).astype(np.uint16))  # SHARD is less than 65,536
        self.counts.append(np.diff(np.r_[at, len(h)]).astype(np.int32))
        self.rows, self.postings = self.rows + len(texts), self.postings + len(at)

    def arrays(self, mean: float) -> dict[str, np.ndarray]:
        def joined(parts: list) -> np.ndarray:
            whole = np.concatenate(parts)
            parts.clear()
            return whole

        lengths, h, doc, tf = map(joined, (self.lengths, self.terms, self.docs, self.counts))
        q = np.empty(len(h), np.uint8)
        for a in range(0, len(h), tn.CHUNK):
            own = slice(a, a + tn.CHUNK)
            q[own] = np.clip(np.ceil(_part(tf[own], lengths[doc[own]], mean) / _STEP), 1, LEVELS)
        order = np.lexsort((LEVELS - q, h))
        h, q = h[order], q[order]
        doc, tf = doc[order], tf[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        seg = np.flatnonzero(new | np.r_[True, q[1:] != q[:-1]]) if len(h) else np.zeros(0, np.int64)
        term = np.flatnonzero(new)
        return {"doc_ids": joined(self.ids), "lengths": lengths, "terms": h[term], "df": np.diff(np.r_[term, len(h)]), "segments": np.r_[np.searchsorted(seg, term), len(seg)], "impacts": q[seg], "starts": np.r_[seg, len(h)], "postings": doc, "tf": tf}


def _shards(mean: float, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    shard = _Shard()
    for b in batches:
        ids = b.column(0).to_numpy()
        for a, texts in _pieces(b, 1):
            for i in range(0, len(texts), SHARD):
                own = texts[i : i + SHARD]
                if shard.rows and (shard.rows + len(own) > SHARD or shard.postings >= POSTINGS):
                    yield shard.arrays(mean)
                    shard = _Shard()
                shard.add(ids[a + i : a + i + len(own)], own)
    if shard.rows:
        yield shard.arrays(mean)


def _written(path: str, mean: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write a task's shards into a file of this attempt's own. What an attempt that failed leaves there no row names."""
    fs, base = pa.fs.FileSystem.from_uri(path)
    context, sink, at = TaskContext.get(), None, 0
    file = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
    for x in _shards(mean, batches):
        if sink is None:
            fs.create_dir(base, recursive=True)
            sink = fs.open_output_stream(f"{base}/{file}")
        begins = [at]
        for c, t in _KINDS.items():
            own = np.ascontiguousarray(x.pop(c), t)
            sink.write(own.data.cast("B") if len(own) else b"")
            at += own.nbytes
            begins.append(at)
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{file}"]), pa.array([begins], pa.list_(pa.int64()))], names=["file", "at"])
    if sink is not None:
        sink.close()


def build(docs: DataFrame) -> tuple[DataFrame, int, float]:
    """The index of all rows of docs with a doc_id, written to the shared folder, the number of documents with words, and their mean length."""
    prepare(docs.sparkSession)
    path = shared_dir(docs.sparkSession, "shards")
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    seen = own.select("text").mapInArrow(_lengths, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    n, mean = int(seen.docs or 0), (seen.total or 0) / max(1, seen.docs or 0)
    return materialize(own.mapInArrow(lambda it: _written(path, mean or 1.0, it), INDEX), "index"), n, mean


def _read(batches: Iterator[pa.RecordBatch], columns: tuple = tuple(_KINDS)) -> Iterator[dict[str, np.ndarray]]:
    """These arrays of each shard that the index's rows name, one shard after the other."""
    for b in batches:
        for row in b.to_pylist():
            fs, path = pa.fs.FileSystem.from_uri(row["file"])
            with fs.open_input_file(path) as f:
                yield {c: np.frombuffer(f.read_at(z - a, a), t) for (c, t), a, z in zip(_KINDS.items(), row["at"], row["at"][1:]) if c in columns}


def _frequencies(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the task's shards have each of the queries' words."""
    words = pickle.loads(shared.value)
    total = np.zeros(len(words), np.int64)
    for x in _read(batches, ("terms", "df")):
        if len(x["terms"]):
            at = np.minimum(np.searchsorted(x["terms"], words), len(x["terms"]) - 1)
            total += np.where(x["terms"][at] == words, x["df"][at], 0)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "df"])


def search_shard(x: dict, terms: np.ndarray, idf: np.ndarray, mean: float, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids and scores of this shard that may be among the k best: all with a score of at least `floor` that belong to the shard's k best."""
    n = len(x["doc_ids"])
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(x["terms"]) or not len(terms):
        return none
    at = np.minimum(np.searchsorted(x["terms"], terms), len(x["terms"]) - 1)
    found = np.flatnonzero(x["terms"][at] == terms)
    if not len(found):
        return none
    at, idf = at[found], idf[found]
    lo, hi = x["segments"][at].astype(np.int64), x["segments"][at + 1].astype(np.int64)
    count = hi - lo
    word = np.repeat(np.arange(len(at)), count)
    seg = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    bound = idf[word] * x["impacts"][seg] * _STEP * 1e6 + 1  # a millionth more than rounding may add
    # What is left after each segment: the sum over words of their next segments' bounds.
    last = np.cumsum(count) - 1
    following = np.r_[bound[1:], 0.0]
    following[last] = 0.0
    total = bound[np.cumsum(count) - count].sum()
    order = np.argsort(-bound, kind="stable")
    word, seg, bound = word[order], seg[order], bound[order]
    least = np.maximum(0, idf[word] * (x["impacts"][seg] - 1.0) * _STEP * 1e6 - 1)
    left = total + np.cumsum(following[order] - bound)
    size = x["starts"][seg + 1] - x["starts"][seg]
    low, high = np.zeros(n), np.zeros(n)
    # Look for the proof after batches of segments that double in postings.
    upto = np.cumsum(size)
    p, goal = 0, max(64, 4 * k)
    while p < len(seg):
        stop = max(p + 1, int(np.searchsorted(upto, goal)))
        goal = max(goal * 2, int(upto[min(stop, len(seg)) - 1]) + 1)
        take = np.arange(p, min(stop, len(seg)))
        m = size[take]
        where = np.repeat(x["starts"][seg[take]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        doc = x["postings"][where]
        low += np.bincount(doc, np.repeat(least[take], m), minlength=n)
        high += np.bincount(doc, np.repeat(bound[take], m), minlength=n)
        p = int(take[-1]) + 1
        best = float(np.partition(low, n - k)[n - k]) if n > k else 0.0
        best = max(best, float(floor))
        if left[p - 1] < best and np.count_nonzero(high + left[p - 1] >= best) <= SLACK * k:
            break
    rest = left[p - 1] if p < len(seg) else 0.0
    mine = np.flatnonzero((high + max(0.0, rest) >= best) & ((high > 0) | (rest >= best)))
    slot = np.full(n, -1)
    slot[mine] = np.arange(len(mine))
    score = np.zeros(len(mine), np.int64)
    for w in range(len(at)):
        a, b = x["starts"][x["segments"][at[w]]], x["starts"][x["segments"][at[w] + 1]]
        s = slot[x["postings"][a:b]]
        ok = np.flatnonzero(s >= 0)
        doc, tf = x["postings"][a:b][ok], x["tf"][a:b][ok].astype(np.float64)
        score[s[ok]] += np.floor(0.5 + 1e6 * idf[w] * _part(tf, x["lengths"][doc], mean)).astype(np.int64)
    ids = x["doc_ids"][mine]
    keep = (score > 0) & (score >= floor)
    ids, score = ids[keep], score[keep]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def _search(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    queries, mean, k = pickle.loads(shared.value)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    for x in _read(batches):
        for q, (_, terms, idf) in enumerate(queries):
            ids, score = best[q]
            more, new = search_shard(x, terms, idf, mean, k, int(score[-1]) if len(score) == k else 0)
            if len(more):
                ids, score = np.r_[ids, more], np.r_[score, new]
                order = np.lexsort((ids, -score))[:k]
                best[q] = ids[order], score[order]
    n = [len(ids) for ids, _ in best]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q[0] for q in queries], n).astype(np.int64)), pa.array(np.concatenate([b[0] for b in best] or [[]]).astype(np.int64)), pa.array(np.concatenate([b[1] for b in best] or [[]]).astype(np.int64))], names=["query_id", "doc_id", "score"])


def search(index: DataFrame, n: int, mean: float, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): for every row of queries (item_id, text) the k best documents that share a word with it.

    The queries' words are broadcast; they grow with the queries, not with the documents. Queries of more than MOST_CHARS characters in all raise a
    ValueError before anything is gathered: search the same index with parts of them. Rows that repeat an item_id are one query of all their
    words; null ids, null texts and texts without words give no rows. Of documents that repeat an id each row counts as a document.
    """
    spark = index.sparkSession
    prepare(spark)
    asked: dict[int, list[str]] = {}
    given = queries.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("q"), "text")
    checked(given, MOST_CHARS, "the table of queries")
    for r in given.collect():
        asked.setdefault(r.q, []).append(r.text)
    own = [(q, np.unique(tn.words(texts)[0])) for q, texts in sorted(asked.items())]
    words = np.unique(np.concatenate([w for _, w in own])) if own else np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast(pickle.dumps(words, protocol=5))
    df = np.zeros(len(words), np.int64)
    for r in index.mapInArrow(lambda it: _frequencies(shared, it), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect():
        df[r.word] = r.df
    idf = np.array([math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in df.tolist()])
    plan = [(q, w, idf[np.searchsorted(words, w)]) for q, w in own]
    sent = spark.sparkContext.broadcast(pickle.dumps((plan, mean or 1.0, k), protocol=5))
    found = index.mapInArrow(lambda it: _search(sent, it), "query_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def topk(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """search() over a new index of docs. An empty table on either side gives an empty result."""
    index, n, mean = build(docs)
    return search(index, n, mean, queries, k)


def sql(k: int = K) -> str:
    """DuckDB SQL for topk() over documents and benchmark."""
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"
    return f"""WITH n AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT row, doc_id, unnest({words}) AS t FROM n),
l AS (SELECT row, count(*) AS len FROM w GROUP BY row),
s AS (SELECT count(*) AS n, sum(len)::DOUBLE / count(*) AS mean FROM l),
q AS (SELECT DISTINCT item_id, unnest({words}) AS t FROM benchmark),
f AS (SELECT row, doc_id, t, count(*) AS tf FROM w WHERE t IN (SELECT t FROM q) GROUP BY row, doc_id, t),
d AS (SELECT t, count(*) AS df FROM f GROUP BY t),
p AS (SELECT f.row, f.doc_id, f.t, floor(0.5 + 1e6::DOUBLE * ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * (f.tf * ({K1 + 1}::DOUBLE) / (f.tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * l.len / s.mean))))::BIGINT AS v FROM f JOIN d USING (t) JOIN l USING (row), s),
r AS (SELECT q.item_id AS query_id, p.row, p.doc_id, sum(p.v)::BIGINT AS score FROM q JOIN p USING (t) GROUP BY q.item_id, p.row, p.doc_id)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {k}"""
