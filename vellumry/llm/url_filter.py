"""URL filtering by the ratio of two character language models.

Two variable-order Markov models over bytes, one of accepted and one of rejected URLs, with contexts of up to ORDER bytes and a mark at either end.
Orders are interpolated by Witten-Bell smoothing: with n the uses of a context and t the kinds of bytes seen after it,

    p_k(c | context) = (count(context c) + t * p_{k-1}(c | shorter context)) / (n + t),

an unseen context leaves p_{k-1} as it is, and below order 0 all 256 bytes are alike. A URL's score is the difference of its two log-likelihoods
divided by its length, calibrated to log-odds by a logistic curve fitted on held-out URLs. It is kept if the log-odds aren't below 0.

What is accepted is learnt from the pages themselves, not from their URLs: pages that declare LANGUAGE in their html tag and have at least LEAST_HTML
characters. So the filter can judge URLs that haven't been fetched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.llm.common import lowest, materialize, prepare

#: At most so many labelled pages are learnt from, those whose page_id hashes lowest.
TRAIN_ROWS = 20_000
LANGUAGE, LEAST_HTML, ORDER, HELD_OUT = "en", 800, 6, 0.25
_BEGIN, _END = 2, 3


def _bytes(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All URLs' bytes with marks at either end, the distance of each byte from its beginning, and the URL of each."""
    raw = [bytes([_BEGIN]) + u.encode("utf-8", "surrogatepass") + bytes([_END]) for u in urls]
    size = np.array([len(r) for r in raw], np.int64)
    of = np.repeat(np.arange(len(raw)), size)
    return np.frombuffer(b"".join(raw), np.uint8), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), of


def _grams(b: np.ndarray, order: int) -> np.ndarray:
    """The last order + 1 bytes at each place, as one number; only places at least `order` from a beginning are meaningful."""
    g = np.zeros(len(b), np.uint64)
    for k in range(min(order + 1, len(b))):
        g[k:] |= b[: len(b) - k].astype(np.uint64) << np.uint64(8 * k)
    return g


def fit(urls: list[str], order: int = ORDER) -> list[tuple]:
    """For each order: contexts with their uses and kinds, and grams with their counts, sorted."""
    b, place, _ = _bytes(urls)
    out = []
    for k in range(order + 1):
        gram, count = np.unique(_grams(b, k)[(place >= k) & (place > 0)], return_counts=True)
        context = gram >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(gram) else np.zeros(0, np.int64)
        out.append((context[first], np.add.reduceat(count, first) if len(first) else count, np.diff(np.r_[first, len(gram)]), gram, count))
    return out


def _find(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(want))
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0).astype(np.float64)


def _log_likelihood(b: np.ndarray, place: np.ndarray, model: list[tuple]) -> np.ndarray:
    """Of each byte; 0 for marks of a beginning."""
    p = np.full(len(b), 1 / 256)
    for k, (context, uses, kinds, gram, count) in enumerate(model):
        g = _grams(b, k)
        c, n, t = _find(gram, count, g), _find(context, uses, g >> np.uint64(8)), _find(context, kinds, g >> np.uint64(8))
        some = (place >= k) & (n > 0)
        p = np.where(some, (c + t * p) / np.where(some, n + t, 1), p)
    return np.where(place > 0, np.log(p), 0.0)


def differences(urls: list[str], accepted: list[tuple], rejected: list[tuple]) -> np.ndarray:
    b, place, of = _bytes(urls)
    d = _log_likelihood(b, place, accepted) - _log_likelihood(b, place, rejected)
    return np.bincount(of, d, minlength=len(urls)) / np.maximum(1, np.bincount(of, place > 0, minlength=len(urls)))


def train(urls: list[str], y: list[int], seed: int = 1) -> dict:
    """Both models and the calibration (slope, offset). With URLs of one kind alone everything is kept."""
    order = np.random.default_rng(seed).permutation(len(urls))
    held, kept = order[: int(len(urls) * HELD_OUT)], order[int(len(urls) * HELD_OUT) :]
    label = np.array(y, np.int64)
    models = [fit([urls[k] for k in kept if label[k] == v]) for v in (1, 0)]
    if len(set(label[kept].tolist())) < 2 or len(set(label[held].tolist())) < 2:
        return {"models": models, "slope": 0.0, "offset": 0.0}
    d, t = differences([urls[k] for k in held], *models), label[held]
    slope, offset = 1.0, 0.0
    for _ in range(100):  # Newton's method for the logistic curve, with a slight pull to 0 that keeps it finite
        p = 1 / (1 + np.exp(-np.clip(slope * d + offset, -30, 30)))
        w = p * (1 - p)
        g = np.array([((t - p) * d).sum() - 1e-3 * slope, (t - p).sum() - 1e-3 * offset])
        h = np.array([[(w * d * d).sum() + 1e-3, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return {"models": models, "slope": float(slope), "offset": float(offset)}


def scores(urls: list, model: dict) -> np.ndarray:
    """Calibrated log-odds; NaN for null and empty URLs."""
    out = np.full(len(urls), np.nan)
    some = [k for k, u in enumerate(urls) if u]
    for a in range(0, len(some), 4096):
        part = some[a : a + 4096]
        out[part] = model["slope"] * differences([urls[k] for k in part], *model["models"]) + model["offset"]
    return out


def labelled(pages: DataFrame, rows: int = TRAIN_ROWS, language: str = LANGUAGE) -> tuple[list[str], list[int]]:
    """URLs and whether their pages are accepted, of at most `rows` pages with a page_id, a URL and html, the lowest by a hash of id and URL.

    Pages alike in id, URL and label count once. The html tag is looked for in the whole page.
    """
    declared = F.lower(F.regexp_extract("html", r'(?i)<html[^>]*\slang="?([a-z]+)', 1))
    y = ((declared == language) & (F.length("html") >= LEAST_HTML)).cast("int")
    known = pages.where("page_id IS NOT NULL AND url <> '' AND html IS NOT NULL").select(F.col("page_id").cast("long").alias("id"), "url", y.alias("y"))
    known = materialize(known.withColumn("h", F.xxhash64("id", "url")), "urls")  # html is read once
    # Hashes are counted once each, so that a page that repeats a million times leaves the others their places.
    few = F.broadcast(lowest(known.select("h").distinct(), "h", rows).orderBy("h").limit(rows))
    found = known.join(few, "h", "left_semi").distinct().orderBy("h", "id", "url", "y").limit(rows).collect()
    return [r.url for r in found], [r.y for r in found]


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, score, keep) for every row of pages, repeated rows and null ids each. Null and empty URLs have a null score and aren't kept."""
    prepare(pages.sparkSession)
    model = train(*labelled(pages))
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pickle.loads(shared.value)
        for b in batches:
            yield pa.array(scores(b.to_pylist(), own), pa.float64(), from_pandas=True)

    found = pages.select("page_id", "url", F.arrow_udf(score, "double")("url").alias("score"))
    return found.withColumn("keep", F.coalesce(F.col("score") >= 0, F.lit(False)))
