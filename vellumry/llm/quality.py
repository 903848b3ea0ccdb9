"""Document quality by supervised subword embeddings.

Features of a text are its words as they are written (white space parts them; case and marks count) and their character n-grams of N letters,
with the blank at either end as a boundary mark, hashed into BUCKETS; a word that repeats the one before it, but for case, also has the feature
AGAIN. Each bucket has a learned vector of DIM numbers. A document is the average
of its features' vectors; a softmax layer turns it into probabilities of low and high quality. Trained by stochastic gradient descent in numpy.

To score, the layer's two columns are folded into the vectors: a document's log-odds are the average of one number per feature. PRIOR features
of the value that high-quality documents have on average are added, so that texts of a few words are rejected on strong evidence alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumry.llm import labelled
from vellumry.llm import textnum as tn
from vellumry.llm.common import fresh, prepare

#: At most so many labelled documents are learnt from.
TRAIN_ROWS = 4000
BUCKETS, DIM, N, EPOCHS, RATE, HELD_OUT = 1 << 16, 8, (3, 4, 5), 8, 0.5, 0.2
PRIOR = 40
#: How many times rejecting a good document weighs what keeping a bad one does, when the threshold is chosen.
CARE = 5
AGAIN = 0
U = np.uint64
_P = 0x9E3779B97F4A7C15


def features(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place) of words, of repeated words, then of the n-grams of each length; place is that of the word's first character in codepoints(texts), of an
    n-gram's second one: its first may be the mark before the text."""
    cp = np.r_[np.uint32(10), tn.codepoints(texts)[0]]
    space = tn.spaces(cp)
    c = np.where(space, np.uint32(32), cp).astype(U)
    edge = np.flatnonzero(np.diff((~space).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[0::2], edge[1::2]
    yield (tn.hashed_spans(c.astype(np.uint32), begin, end) % U(BUCKETS)).astype(np.int32), begin - 1
    own = tn.hashed_spans(tn.folded(cp)[0], begin, end)
    again = begin[1:][own[1:] == own[:-1]]
    yield np.full(len(again), AGAIN, np.int32), again - 1
    gram = c[:-1] + c[1:] * U(_P) if len(c) > 1 else np.zeros(0, U)
    for n in range(3, max(N) + 1):
        if len(c) < n:
            return
        gram = gram[: len(c) - n + 1] + c[n - 1 :] * U(pow(_P, n - 1, 1 << 64))
        # Inside, no white space; at the ends it marks a word's boundary.
        inner = space[1 : len(c) - n + 2].copy()
        for k in range(2, n - 1):
            inner |= space[k : len(c) - n + 1 + k]
        if n in N:
            at = np.flatnonzero(~inner)
            g = gram[at] * U(0xFF51AFD7ED558CCD)
            yield ((g >> U(40)) % U(BUCKETS)).astype(np.int32), at


def counted(texts: list) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text its distinct buckets, their shares and the number of features."""
    out = []
    for i, j in tn.chunks(texts):
        starts = tn.codepoints(texts[i:j])[1]
        bucket, doc = [], []
        for f, at in features(texts[i:j]):
            bucket.append(f)
            doc.append(np.searchsorted(starts, at, "right") - 1)
        code, n = np.unique(np.concatenate(doc).astype(np.int64) * BUCKETS + np.concatenate(bucket), return_counts=True)
        cut = np.searchsorted(code, np.arange(j - i + 1) * BUCKETS)
        for a, b in zip(cut[:-1], cut[1:]):
            out.append(((code[a:b] % BUCKETS).astype(np.int32), (n[a:b] / max(1, n[a:b].sum())).astype(np.float32), int(n[a:b].sum())))
    return out


def train(texts: list[str], y: list[int], seed: int = 1) -> dict:
    """Per bucket one number, a bias and a threshold for the log-odds of high quality. With labels of one kind alone nothing is rejected."""
    rng = np.random.default_rng(seed)
    docs = [(f, s, n, int(label)) for (f, s, n), label in zip(counted(texts), y) if len(f)]
    kinds = np.bincount([d[3] for d in docs], minlength=2) if docs else np.zeros(2)
    if not kinds.all():
        return {"value": np.zeros(BUCKETS, np.float32), "bias": 0.0, "usual": 0.0, "threshold": float("-inf")}
    held = rng.random(len(docs)) < HELD_OUT
    learnt = [d for d, h in zip(docs, held) if not h] or docs
    learnt_high = [d for d in learnt if d[3]] or [d for d in docs if d[3]]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    layer[:] = rng.uniform(-1, 1, layer.shape)
    rare = kinds.sum() / (2 * kinds)  # both classes weigh the same
    steps, done = EPOCHS * len(learnt), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(learnt)):
            f, s, _, label = learnt[k]
            step = RATE * (1 - done / steps)
            done += 1
            own = vectors[f]
            h = s @ own
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            g = (step * min(4.0, rare[label])) * p
            vectors[f] = own - s[:, None] * (layer @ g)[None] * np.float32(8)  # features' own gradients are small, being averaged
            layer -= np.outer(h, g)
            bias -= g
    value = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)
    model = {"value": value, "bias": float(bias[1] - bias[0]), "threshold": 0.0}
    test = [d for d, h in zip(docs, held) if h] or docs
    model["usual"] = float(np.mean([s @ value[f] for f, s, _, _ in learnt_high]))
    odds = np.array([_shrunk(float(s @ value[f]) * n, n, model) for f, s, n, _ in test])
    model["threshold"] = _threshold(odds, np.array([d[3] for d in test]))
    return model


def _shrunk(total, count, model: dict):
    return (total + PRIOR * model["usual"]) / (count + PRIOR) + model["bias"]


def _threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Midway between the held-out classes if they are apart, else where their error rates, weighed by CARE, are least."""
    if not len(y) or y.min() == y.max():
        return 0.0
    low, high = odds[y == 0].max(), odds[y == 1].min()
    if low < high:
        return float((low + high) / 2)
    cuts = np.unique(odds)
    errors = [(np.mean(odds[y == 0] >= c) + CARE * np.mean(odds[y == 1] < c), abs(c)) for c in cuts]
    return float(cuts[min(range(len(cuts)), key=lambda k: errors[k])])


def scores(texts: list, model: dict) -> np.ndarray:
    """Log-odds of high quality, less the threshold; NaN for texts of white space alone."""
    out = np.full(len(texts), np.nan)
    for i, j in tn.chunks(texts):
        starts = tn.codepoints(texts[i:j])[1]
        total, count = np.zeros(j - i), np.zeros(j - i)
        for f, at in features(texts[i:j]):
            sums = np.r_[0, np.cumsum(model["value"][f], dtype=np.float64)]
            cut = np.searchsorted(at, starts)
            total += sums[cut[1:]] - sums[cut[:-1]]
            count += np.diff(cut)
        some = count > 0
        out[i:j][some] = _shrunk(total[some], count[some], model) - model["threshold"]
    return out


def score_column(docs: DataFrame, labels: DataFrame) -> Column:
    """The score column for docs: below 0 is low quality. Null for null and blank texts. Learns from labelled rows of docs."""
    prepare(docs.sparkSession)
    model = train(*labelled.sample(docs, labels, "quality", TRAIN_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pickle.loads(shared.value)
        for b in batches:
            yield pa.array(scores(b.to_pylist(), own), pa.float64(), from_pandas=True)

    return F.arrow_udf(score, "double")(docs["text"])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, keep) for every row of docs, repeated rows and null ids each. Null and blank texts have a null score and aren't kept."""
    found = docs.select("doc_id", score_column(docs, labels).alias("score"))
    return found.select("doc_id", "score", F.coalesce(F.col("score") >= 0, F.lit(False)).alias("keep"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't of low quality, with the columns they came with; null and blank texts go."""
    name = fresh(docs, "quality")
    return docs.withColumn(name, score_column(docs, labels)).where(F.col(name) >= 0).drop(name)
