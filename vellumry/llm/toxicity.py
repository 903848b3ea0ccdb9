"""Toxicity by a counterfactual-regularised classifier.

A document is as toxic as its worst sentence; what lies between two of ENDS is a sentence, whatever its length. A sentence's score is a logistic function of a bias and the weights of its distinct words. A word's
weight is the sum of those of the word and of its beginnings of PREFIXES letters (so inflected forms share what they learn), hashed into BUCKETS.
Labels hold for documents, so each training step takes the document's highest-scoring sentence (multiple-instance learning).

Counterfactuals. A sentence that names a group (IDENTITIES) is scored again with the term swapped for another of the same kind; one that names none is
scored with terms put in. The squared change of the score, times PENALTY, is part of the loss. So terms that happen to be frequent in toxic
sentences gain no weight, and neutral mentions of a group aren't rejected.

The threshold lies midway, in log-odds, between held-out clean and toxic documents if they are apart, else where it makes the fewest errors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumry.llm import labelled
from vellumry.llm import textnum as tn
from vellumry.llm.common import fresh, prepare

#: At most so many labelled documents are learnt from.
TRAIN_ROWS = 6000
BUCKETS, EPOCHS, RATE, DECAY, PENALTY, HELD_OUT = 1 << 18, 6, 0.3, 1e-4, 1.0, 0.2
PREFIXES = (4, 5, 6)
WIDTH = 1 + len(PREFIXES)
#: Labelled documents whose gradients are summed up in one step.
BATCH = 8
#: Where sentences end: full stops, exclamation and question marks of the scripts that have their own, and line ends.
ENDS = ".!?\n\r\u2028\u2029\u2026\u203c\u2047\u2048\u2049\u3002\uff01\uff0e\uff1f\uff61\ufe52\ufe56\ufe57\u0589\u061f\u06d4\u0700\u0701\u0702\u0964\u0965\u104a\u104b\u1362\u1367\u1368\u166e\u1803\u1809\u17d4\u17d5"
#: Terms of one kind can stand for each other in a sentence.
IDENTITIES = {
    "religion": "muslim christian jewish hindu buddhist atheist catholic protestant sikh musulman chrétien juif musulmán cristiano judío moslem christ jude".split(),
    "religions": "muslims christians jews hindus buddhists atheists catholics protestants sikhs musulmans chrétiens juifs musulmanes cristianos judíos moslems christen juden".split(),
    "origin": "african asian european american arab mexican indian chinese african-american latino latina turkish polish black white brown africain asiatique arabe noir blanc negro blanco afrikaner asiate araber türke".split(),
    "gender": "woman man girl boy female male femme homme fille garçon mujer hombre niña niño frau mann mädchen junge".split(),
    "genders": "women men girls boys females males femmes hommes filles garçons mujeres hombres niñas niños frauen männer jungen".split(),
    "orientation": "gay lesbian straight bisexual transgender queer homosexual heterosexual homosexuel lesbienne homosexuell lesbisch lesbiana".split(),
    "ability": "disabled deaf blind autistic handicapé sourd aveugle discapacitado sordo ciego behindert taub".split(),
    "age": "elderly young old teenager âgé jeune anciano joven alt jung".split(),
}


def _identities() -> tuple[np.ndarray, np.ndarray]:
    """Buckets (n, WIDTH) of all identity terms that are one word, and the kind of each."""
    found, kind = [], []
    for k, terms in enumerate(IDENTITIES.values()):
        for t in terms:
            x = sentences([t])[0]
            if len(x) == 1:
                found.append(x[0])
                kind.append(k)
    return np.array(found), np.array(kind)


@lru_cache(maxsize=1)
def _ends() -> np.ndarray:
    """Whether a code point below 65536 ends a sentence; one entry more stands for all others."""
    out = np.zeros(65537, bool)
    out[[ord(c) for c in ENDS]] = True
    return out


def sentences(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (n, WIDTH) of each sentence's distinct words, where each sentence begins among them, and its text. Only sentences with words count.

    A sentence is what lies between two ENDS, however long it is.
    """
    h, doc, begin, end, cp = tn.words(texts)
    if not len(h):
        return np.zeros((0, WIDTH), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = tn.folded(cp)[0]
    # A beginning hashes apart from a word of the same letters; a word no longer than it repeats the word's own bucket.
    parts = [h]
    for n in PREFIXES:
        parts.append(np.where(end - begin > n, tn.hashed_spans(low, begin, np.minimum(begin + n, end)) ^ np.uint64(n), h ^ np.uint64(n)))
    stop = np.cumsum(_ends()[np.minimum(cp, 65536)])[begin]
    of = np.cumsum(np.r_[False, stop[1:] != stop[:-1]])
    order = np.lexsort((h, of))
    keep = order[np.r_[True, (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])]]
    first = np.flatnonzero(np.r_[True, of[keep][1:] != of[keep][:-1]])
    return np.stack([(p[keep] % np.uint64(BUCKETS)).astype(np.int64) for p in parts], axis=1), first, doc[keep][first]


def _sums(weights: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[w].sum(axis=1, dtype=np.float64), first)


def train(texts: list[str], y: list[int], penalty: float = PENALTY, seed: int = 1) -> dict:
    """Weights (float32, BUCKETS), bias and threshold. With no toxic or no clean document the threshold rejects nothing."""
    rng = np.random.default_rng(seed)
    label = np.array(y, np.int64)
    docs = []  # of each text with words: buckets, where sentences begin, label
    for i, j in tn.chunks(texts):
        w, first, doc = sentences(texts[i:j])
        ends = np.r_[first[1:], len(w)]
        for d in np.unique(doc):
            mine = np.flatnonzero(doc == d)
            a = first[mine[0]]
            docs.append((w[a : ends[mine[-1]]].astype(np.int32), first[mine] - a, int(label[i + d])))
    kinds = np.bincount([d[2] for d in docs], minlength=2) if docs else np.zeros(2)
    if not kinds.all():
        return {"weights": np.zeros(BUCKETS, np.float32), "bias": 0.0, "threshold": float("inf")}
    held = rng.random(len(docs)) < HELD_OUT
    learnt = [d for d, h in zip(docs, held) if not h] or docs
    weights, bias = np.zeros(BUCKETS), -2.0
    # What is far more frequent in toxic documents begins with part of its log-odds, else with 0.
    seen, total = np.zeros((2, BUCKETS)), np.zeros(2)
    for w, _, label in learnt:
        seen[label, np.unique(w)] += 1
        total[label] += 1
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    strong = (seen[1] >= 3) & (odds > 2)
    weights[strong] = odds[strong] / WIDTH
    rare = 1 - total / total.sum()  # both classes weigh the same
    terms, kind = _identities()
    # Peers of one kind are neighbours here.
    sort = np.argsort(kind, kind="stable")
    terms, kind = terms[sort], kind[sort]
    begins, size = np.searchsorted(kind, np.arange(len(IDENTITIES))), np.bincount(kind, minlength=len(IDENTITIES))
    term_of = np.full(BUCKETS, -1)
    term_of[terms[:, 0]] = np.arange(len(terms))
    for epoch in range(EPOCHS):
        step = RATE / (1 + epoch)
        hold = min(0.45, step * penalty)
        order = rng.permutation(len(learnt))
        for a in range(0, len(order), BATCH):
            x, own, g, change = _gradient([learnt[n] for n in order[a : a + BATCH]], weights, bias, rare)
            np.subtract.at(weights, x.ravel(), np.repeat(step * g[own] / WIDTH, WIDTH))
            weights[x] *= 1 - step * DECAY
            bias -= step * change
            if penalty:
                # Of each sentence one term that it names, or any: swap it for a peer, and leave it out. Both changes of the score shrink by gradient steps.
                named = term_of[x[:, 0]]
                pick = np.where(named >= 0, rng.random(len(named)), -1.0)
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                one = rng.integers(len(terms), size=len(starts))
                best = np.maximum.reduceat(pick, starts)
                here = np.flatnonzero((pick == best[own]) & (pick >= 0))
                one[own[here]] = named[here]
                other = begins[kind[one]] + rng.integers(size[kind[one]])
                swap = weights[terms[one]].sum(axis=1) - weights[terms[other]].sum(axis=1)
                move, uses = np.zeros(len(terms)), np.zeros(len(terms))
                np.subtract.at(move, one, swap / 2)
                np.add.at(move, other, swap / 2)
                np.subtract.at(move, one, weights[terms[one]].sum(axis=1))
                for t in (one, other):
                    np.add.at(uses, t, 1)
                some = np.flatnonzero(uses)
                # A term that comes k times moves as it would in k steps, not k times as far.
                far = move[some] / uses[some] * (1 - (1 - hold) ** uses[some])
                np.add.at(weights, terms[some].ravel(), np.repeat(far / WIDTH, WIDTH))
    test = [d for d, h in zip(docs, held) if h] or docs
    scored = np.array([_sums(weights, w, first).max() + bias for w, first, _ in test])
    return {"weights": weights.astype(np.float32), "bias": float(bias), "threshold": _threshold(scored, np.array([d[2] for d in test]))}


def _gradient(docs: list[tuple], weights: np.ndarray, bias: float, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The words of each document's worst sentence, the number of its document, and the loss's gradient by the score of each document and by the bias."""
    w = np.concatenate([d[0] for d in docs])
    size = np.array([len(d[0]) for d in docs])
    first = np.concatenate([d[1] + a for d, a in zip(docs, np.cumsum(size) - size)])
    count = np.array([len(d[1]) for d in docs])
    doc, begin = np.repeat(np.arange(len(docs)), count), np.cumsum(count) - count
    score = _sums(weights, w, first)
    worst = np.maximum.reduceat(score, begin)
    _, at = np.unique(np.where(score == worst[doc], doc, len(docs)), return_index=True)
    at = at[: len(docs)]
    ends = np.r_[first[1:], len(w)]
    n = ends[at] - first[at]
    rows = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    label = np.array([d[2] for d in docs])
    g = rare[label] * (1 / (1 + np.exp(-np.clip(bias + worst, -500, 500))) - label)
    return w[rows], np.repeat(np.arange(len(docs)), n), g, float(g.sum())


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    if not len(y) or y.min() == y.max():
        return 0.0
    clean, toxic = score[y == 0].max(), score[y == 1].min()
    if clean < toxic:
        return float((clean + toxic) / 2)
    cuts = np.unique(score)
    errors = [(np.sum((score >= c) & (y == 0)) + np.sum((score < c) & (y == 1)), abs(c)) for c in cuts]
    return float(cuts[min(range(len(cuts)), key=lambda k: errors[k])])


def scores(texts: list, model: dict) -> np.ndarray:
    """The log-odds of each text's worst sentence, less the threshold; NaN for texts without words."""
    out = np.full(len(texts), np.nan, np.float64)
    for i, j in tn.chunks(texts):
        w, first, doc = sentences(texts[i:j])
        if len(first):
            s = _sums(model["weights"], w, first)
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            out[i + doc[at]] = np.maximum.reduceat(s, at) + model["bias"] - model["threshold"]
    return out


def score_column(docs: DataFrame, labels: DataFrame) -> Column:
    """The score column for docs: above 0 is toxic. Null for null, empty and wordless texts. Learns from labelled rows of docs."""
    prepare(docs.sparkSession)
    model = train(*labelled.sample(docs, labels, "toxic", TRAIN_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pickle.loads(shared.value)
        for b in batches:
            yield pa.array(scores(b.to_pylist(), own), pa.float64(), from_pandas=True)

    return F.arrow_udf(score, "double")(docs["text"])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, toxic) for every row of docs, repeated rows and null ids each. Texts without words have a null score and aren't toxic."""
    found = docs.select("doc_id", score_column(docs, labels).alias("score"))
    return found.select("doc_id", "score", F.coalesce(F.col("score") > 0, F.lit(False)).alias("toxic"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't toxic, with the columns they came with; texts without words stay."""
    name = fresh(docs, "toxicity")
    return docs.withColumn(name, score_column(docs, labels)).where(F.col(name).isNull() | (F.col(name) <= 0)).drop(name)
