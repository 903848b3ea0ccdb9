"""Token counts under a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens by the vocabulary's pattern (PATTERN), found on whole batches of code points by the classes of neighbours. The distinct
pre-tokens of a batch are held as one ragged array of symbols. In each round every sequence finds the pair of neighbours with its lowest merge
rank and all sequences merge that pair, wherever it occurs in them, at the same time; sequences with no pair left are done. What survives is
counted, and counts go back to the texts by the pre-tokens' places.

Merging all occurrences of the lowest pair from the left is what the usual one-pair-at-a-time loop does, so counts equal that loop's.
"""

from __future__ import annotations

import base64
import pickle
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.llm import textnum as tn
from vellumry.llm.common import prepare

#: Where the vocabulary lies by default: ranks of byte strings, one "base64 rank" a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokens that Encoder.pieces() finds: contractions, words, numbers and other marks with a blank before them, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a task remembers between batches; when full it starts anew, which changes only the speed.
REMEMBERED = 400_000


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> dict:
    """Tables over token ids: the first id of each byte, and for each mergeable pair (left << 32 | right), sorted, the id it becomes.

    A pair merges exactly if its bytes are a token, so each token gives every split of it into two tokens.
    """
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    pair, to = [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                pair.append(left << 32 | right)
                to.append(rank)
    pair, to = np.array(pair, np.int64), np.array(to, np.int32)
    order = np.argsort(pair)
    return {"single": single, "pair": pair[order], "to": to[order], "slots": _slots(pair[order])}


def _slots(pair: np.ndarray) -> np.ndarray:
    """An open-addressed table of the pairs' places, several times as large as they are many."""
    size = 1 << max(4, int(len(pair) * 4).bit_length())
    slots = np.full(size, -1, np.int32)
    left = np.arange(len(pair), dtype=np.int32)
    at = _slot(pair, size)
    while len(left):
        free = slots[at] < 0
        slots[at[free]] = left[free]
        lost = slots[at] != left
        left, at = left[lost], (at[lost] + 1) % size
    return slots


def _slot(pair: np.ndarray, size: int) -> np.ndarray:
    return (tn.mix(pair.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


_NONE = np.int32(0x7FFFFFFF)


def _ranks(left: np.ndarray, right: np.ndarray, m: dict) -> np.ndarray:
    """The id that each pair becomes, which is also its rank; _NONE if it doesn't merge."""
    pair, slots = left << 32 | right, m["slots"]
    out = np.full(len(pair), _NONE, np.int32)
    if not len(m["pair"]):
        return out
    at, todo = _slot(pair, len(slots)), np.arange(len(pair))
    while len(todo):
        s = slots[at]
        some = s >= 0
        todo, at, s = todo[some], at[some], s[some]
        same = m["pair"][s] == pair[todo]
        out[todo[same]] = m["to"][s[same]]
        todo, at = todo[~same], (at[~same] + 1) % len(slots)
    return out


def merged(raw: bytes, size: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that survive in each pre-token, one after another, and how many each has; raw holds the pre-tokens' bytes, of these sizes."""
    many = len(size)
    sym = m["single"][np.frombuffer(raw, np.uint8)]
    own = np.repeat(np.arange(many), size)
    done_sym, done_own = [], []
    rank = np.full(len(sym), _NONE, np.int32)
    inner = np.flatnonzero(own[1:] == own[:-1])
    rank[inner] = _ranks(sym[inner], sym[inner + 1], m)
    while len(sym):
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        size = np.diff(np.r_[first, len(sym)])
        best = np.minimum.reduceat(rank, first)
        over = np.repeat(best == _NONE, size)
        if over.any():
            done_sym.append(sym[over])
            done_own.append(own[over])
            keep = ~over
            sym, own, rank = sym[keep], own[keep], rank[keep]
            size, best = size[best != _NONE], best[best != _NONE]
            if not len(sym):
                break
        hit = rank == np.repeat(best, size)
        # Overlapping occurrences (the pair of a symbol with itself): from the left, every other one merges.
        clash = np.flatnonzero(hit[1:] & hit[:-1]) + 1
        if len(clash):
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            hit[at[place % 2 == 1]] = False
        sym[hit] = rank[hit]
        keep = np.ones(len(sym), bool)
        keep[np.flatnonzero(hit) + 1] = False
        changed = hit[keep]
        sym, own, rank = sym[keep], own[keep], rank[keep]
        # Only pairs that touch a merged symbol have new ranks.
        touch = changed.copy()
        touch[:-1] |= changed[1:]
        touch = np.flatnonzero(touch)
        rank[touch] = _NONE
        touch = touch[touch < len(sym) - 1]
        touch = touch[own[touch] == own[touch + 1]]
        rank[touch] = _ranks(sym[touch], sym[touch + 1], m)
    sym, own = np.concatenate(done_sym or [sym]), np.concatenate(done_own or [own])
    order = np.argsort(own, kind="stable")
    return sym[order], np.bincount(own, minlength=many)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    kinds = {"L": 1, "N": 2}
    out = np.array([kinds.get(unicodedata.category(chr(i))[0], 3) for i in range(0x110000)], np.uint8)
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return out


def pieces(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every pre-token of PATTERN, and the code points they lie in."""
    cp, starts = tn.codepoints(texts)
    kind = _classes()[cp]
    kind[starts[1:] - 1] = 4  # the line feed that parts texts belongs to none
    n = len(cp)
    before, after = np.r_[np.uint8(4), kind[:-1]], np.r_[kind[1:], np.uint8(4)]
    blank = cp == 32
    # A run begins where the kind changes; its blank before, if any, begins it instead.
    edge = kind != before
    begin = edge & (kind > 0) & (kind < 4)
    led = begin.copy()
    led[1:] &= blank[:-1]
    led[0] = False
    begin &= ~led
    # Of white space before a run, the last character stands alone: a blank leads the run, another is a pre-token.
    white = kind == 0
    last = white & (after != 0) & (after != 4)
    begin |= (white & edge) | last
    # Contractions: an apostrophe on its own, not led by a blank, with one of these behind it.
    mark = np.flatnonzero((cp == 39) & edge & (after == 1) & ~led)
    if len(mark):
        one, two = cp[mark + 1], cp[np.minimum(mark + 2, n - 1)]
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        short = np.isin(one, [ord(c) for c in "stmd"])
        begin[(mark + 1)[short | long]] = False
        for ok, size in ((short, 2), (long, 3)):
            begin[(mark + size)[ok & (kind[np.minimum(mark + size, n - 1)] == 1)]] = True
    start = np.flatnonzero(begin)
    doc = np.searchsorted(starts, start, "right") - 1
    end = np.minimum(np.r_[start[1:], n], starts[doc + 1] - 1)
    return start, end, doc, cp


class Encoder:
    """Token ids of texts; remembers pre-tokens that it has merged."""

    def __init__(self, m: dict):
        self.m = m
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray, cp: np.ndarray) -> None:
        size = end - begin
        at = np.cumsum(size) - size
        c = cp[np.repeat(begin - at, size) + np.arange(size.sum())]
        wide = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        sym, n = merged(c.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.add.reduceat(wide, at), self.m)
        if self.used + len(sym) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(max(len(self.flat), len(sym)), np.int32)]
        self.flat[self.used : self.used + len(sym)] = sym
        place = np.searchsorted(self.known, h)
        self.known = np.insert(self.known, place, h)
        self.at = np.insert(self.at, place, self.used + np.cumsum(n) - n)
        self.n = np.insert(self.n, place, n)
        self.used += len(sym)

    def places(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """For every pre-token, its number among the remembered ones, and its text. Holds until the next call."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, end, doc, cp = pieces(texts)
        h, first, back = np.unique(tn.hashed_spans(cp, begin, end), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != h[inside]
        if new.any():
            self._learn(h[new], begin[first[new]], end[first[new]], cp)
        return np.searchsorted(self.known, h)[back], doc

    def counts(self, texts: list) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, j in tn.chunks(texts):
            place, doc = self.places(texts[i:j])
            out[i:j] = np.bincount(doc, self.n[place], minlength=j - i)
        return out

    def ids(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        place, doc = self.places(texts)
        n = self.n[place]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[np.repeat(self.at[place], n) + step], np.bincount(doc, n, minlength=len(texts)).astype(np.int64)


def count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs, repeated rows and null ids each. Null and empty texts have 0 tokens.

    Strings of special tokens in a text are ordinary text. The vocabulary is read by the driver and broadcast; its size is fixed.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(merges(load(vocabulary)), protocol=5))

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(pickle.loads(shared.value))
        for b in batches:
            yield pa.array(encoder.counts(b.to_pylist()), pa.int64())

    return docs.select("doc_id", F.arrow_udf(counts, "bigint")("text").alias("n_tokens"))
