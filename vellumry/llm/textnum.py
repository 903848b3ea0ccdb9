"""Texts as numpy arrays: batches of documents become code points, words become 64-bit hashes, with no Python object for a word."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
_P, _P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
CHUNK = 1 << 20


#: Every code point, and the planes that hold letters, marks, digits or white space; the others have none.
_ALL, _PLANES = 0x110000, (range(0x40000), range(0xE0000, 0xE1000))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: lower case, whether a letter, mark or digit, whether white space."""
    low, word, space = np.arange(_ALL, dtype=np.uint32), np.zeros(_ALL, bool), np.zeros(_ALL, bool)
    for plane in _PLANES:
        chars = [chr(i) for i in plane]
        own = slice(plane.start, plane.stop)
        low[own] = [ord(c.lower()[0]) for c in chars]
        word[own] = [unicodedata.category(c)[0] in "LMN" for c in chars]
        space[own] = [c.isspace() for c in chars]
    return low, word, space


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * CHUNK
    out = []
    for base in (_P, _P_INV):
        a = np.full(n, base, U)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit keys."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def chunks(texts: list, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters; one text is never cut."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n + 1
    if i < len(texts):
        yield i, len(texts)


def codepoints(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line feed after each, and where each text begins (one more entry for the end). None counts as ''."""
    own = [t or "" for t in texts]
    starts = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in own], out=starts[1:])
    return np.frombuffer(("\n".join(own) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), starts


def folded(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point, and whether it belongs to a word."""
    low, word, _ = _tables()
    return low[cp], word[cp]


def spaces(cp: np.ndarray) -> np.ndarray:
    return _tables()[2][cp]


def hashed_spans(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of codes, by prefix sums of a polynomial, wherever in the array it lies. Spans come in order of their beginnings.

    Codes are taken CHUNK at a time, each time up to a span's beginning, so the tables of powers stay small however long a text is.
    """
    power, inverse = _powers()
    out = np.zeros(len(begin), U)
    a = 0
    while a < len(begin):
        base = int(begin[a])
        b = int(np.searchsorted(begin, base + CHUNK))
        over = np.flatnonzero(end[a:b] - base > len(power))
        b = a + int(over[0]) if len(over) else b
        if b == a:  # a span longer than the tables: Horner's rule over pieces of it gives the same sum
            b, n = a + 1, int(end[a]) - base
            total, scale, step = U(0), U(1), U(pow(_P, len(power), 1 << 64))
            with np.errstate(over="ignore"):
                for x in range(base, base + n, len(power)):
                    piece = codes[x : min(x + len(power), base + n)].astype(U)
                    total += (piece * power[: len(piece)]).sum(dtype=U) * scale
                    scale *= step
            out[a] = total + U(n)
            a = b
            continue
        stop = int(end[a:b].max())
        n = stop - base
        sums = np.zeros(n + 1, U)
        np.cumsum(codes[base:stop].astype(U) * power[:n], out=sums[1:])
        at, to = begin[a:b] - base, end[a:b] - base
        out[a:b] = (sums[to] - sums[at]) * inverse[at] + (to - at).astype(U)
        a = b
    return mix(out)


def words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of all texts: hash of its lower case, number of its text, begin, end; and the code points. Words are maximal runs of letters, marks and digits."""
    cp, starts = codepoints(texts)
    low, word = folded(cp)
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[0::2], edge[1::2]
    return hashed_spans(low, begin, end), np.searchsorted(starts, begin, "right") - 1, begin, end, cp


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    h = words([word])[0]
    return int(h[0]) if len(h) else 0
