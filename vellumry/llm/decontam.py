"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items and documents are normalised (lower case; each run of other characters than letters, marks and digits becomes one blank). A document is
contaminated if a region of it matches, within an edit budget of floor(RATE * length), a passage of an item: any WINDOW successive characters, wherever in the
item they begin, or the whole item if it has fewer than 2 * WINDOW characters. So a copied passage of WINDOW characters or more is found whatever its offset.
Where that budget would leave no q-gram that a region must share (12 to 15 characters) no edit is allowed, and items of fewer than Q characters, which have no
q-gram, are found where a document has them as whole words.

Filter. A region within e edits of a passage of m characters shares at least m - Q + 1 - Q * e of its q-grams, all on diagonals that differ by at
most e, within m + e characters. Hits (document position minus item position) are sorted into diagonal bands of width BAND + e that overlap by e, so one band
of the item holds all hits of the region. The passages of a band whose q-grams meet the bound go on; none is dropped for its number.

Verify. Each passage that is left is aligned with its band by an edit distance confined to the band's diagonals, free at both ends of the document. The
likeliest passage of a band comes first; the others are aligned only where it doesn't match and where its distance leaves them a chance.
The filter works on the low byte of each character, which can only add hits; the alignment compares whole characters.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.llm import textnum as tn
from vellumry.llm.common import checked, fresh, prepare

#: Passages begin STRIDE characters apart: at every one, as a copy may.
Q, RATE, WINDOW, STRIDE, BAND = 8, 1 / 12, 60, 1, 16
#: Characters that a benchmark may have in all, since it is sent to every executor.
MOST_CHARS = 1 << 28
_TABLE = 22


def normalise(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all texts, each ending in a line feed (with a blank before it, unless a word ends the text), and where each begins (and the end)."""
    cp, starts = tn.codepoints(texts)
    low, word = tn.folded(cp)
    low = np.where(word, low, np.uint32(32))
    ends = np.zeros(len(cp), bool)
    ends[starts[1:] - 1] = True
    low[ends] = 10
    before = np.zeros(len(cp), bool)
    before[1:] = word[:-1]
    # Of blanks only the first after a word stays; the line feed at a text's end always does.
    keep = word | ends | before
    at = np.cumsum(keep)
    return low[keep], np.r_[0, at[starts[1:] - 1]]


def windows(items: list[tuple[int, str]]) -> list[dict]:
    """The benchmark's items by class: those with passages of WINDOW characters and those that count as a whole, each with an index of its q-grams; and those too
    short for a q-gram, by their lengths."""
    codes, starts = normalise([t for _, t in items])
    passages, whole, short = ([], [], []), ([], [], []), {}
    for k, (item, _) in enumerate(items):
        text = codes[starts[k] : starts[k + 1] - 1]
        if len(text) and text[-1] == 32:
            text = text[:-1]
        if 0 < len(text) < Q:
            short.setdefault(len(text), {}).setdefault(text.tobytes(), []).append(item)
            continue
        if len(text) >= WINDOW:
            for x, own in zip(passages, (text, item, WINDOW)):
                x.append(own)
        if 0 < len(text) < 2 * WINDOW and len(text) != WINDOW:
            for x, own in zip(whole, (text, item, len(text))):
                x.append(own)
    return [_index(*x) for x in (passages, whole) if x[0]] + [{"length": m, "spelled": own, "keys": np.unique(_spelling(np.stack([np.frombuffer(b, np.uint32) for b in own])))} for m, own in sorted(short.items())]


def _spelling(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    h = np.zeros(len(rows), np.uint64)
    for c in rows.T:
        h = tn.mix(h + c.astype(np.uint64) + np.uint64(1))
    return h


def _spelled(codes: np.ndarray, starts: np.ndarray, short: dict, found: list[set[int]]) -> None:
    """Add to found, by text, the items of this length that stand in it as whole words."""
    m = short["length"]
    gap = (codes == 32) | (codes == 10)
    begin = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    begin = begin[begin + m < len(codes)]
    begin = begin[gap[begin + m]]
    for a in range(0, len(begin), 1 << 18):  # bounded memory
        some = begin[a : a + (1 << 18)]
        rows = codes[some[:, None] + np.arange(m)[None]]
        at = np.flatnonzero(np.isin(_spelling(rows), short["keys"]))
        of = np.searchsorted(starts, some[at], "right") - 1
        for d, row in {(int(d), rows[k].tobytes()) for d, k in zip(of, at)}:
            found[d].update(short["spelled"].get(row, ()))


def _index(text: list[np.ndarray], owner: list[int], size: list[int]) -> dict:
    """Of each text its passages' size, with their edit budget and the q-grams they need; and where in the texts each q-gram is."""
    size = np.array(size, np.int64)
    budget = np.floor(RATE * size).astype(np.int64)
    budget[size - Q + 1 - Q * budget < 1] = 0
    need = size - Q + 1 - Q * budget
    grams, of, at = [], [], []
    for k, w in enumerate(text):
        g = _grams(w)
        grams.append(g)
        of.append(np.full(len(g), k))
        at.append(np.arange(len(g)))
    grams, of, at = np.concatenate(grams), np.concatenate(of), np.concatenate(at)
    order = np.argsort(grams, kind="stable")
    grams, of, at = grams[order], of[order], at[order]
    key, first = np.unique(grams, return_index=True)
    table = np.zeros(1 << _TABLE, bool)
    table[_slot(key)] = True
    longest = max(len(w) for w in text)
    return {"text": text, "owner": np.array(owner, np.int64), "size": size, "budget": budget, "need": need, "longest": longest, "key": key, "first": np.r_[first, len(grams)], "of": of, "at": at, "table": np.packbits(table)}


def _grams(codes: np.ndarray) -> np.ndarray:
    """Q characters' low bytes in one integer, for each position."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = codes.astype(np.uint8)
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:n].astype(np.uint64) | (four[4 : 4 + n].astype(np.uint64) << np.uint64(32))


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE)).astype(np.int64)


def _expand(count: np.ndarray) -> np.ndarray:
    """0..count-1 for each."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _dense(pos: np.ndarray, index: dict) -> np.ndarray:
    """Whether each hit lies among as many hits as some passage needs, within the length that its region may have; others can't count."""
    need, reach = int(index["need"].min()), int((index["size"] + index["budget"]).max())
    ok = np.zeros(len(pos) + 1, np.int64)
    if len(pos) >= need:
        a = np.flatnonzero(pos[need - 1 :] - pos[: len(pos) - need + 1] <= reach)
        np.add.at(ok, a, 1)
        np.add.at(ok, a + need, -1)
    return np.cumsum(ok[:-1]) > 0


def _bands(codes: np.ndarray, index: dict, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages that meet the bound, band by band, the likeliest of each first: text, band number (of the position in codes), beginning in the text, and
    the number of its band."""
    g = _grams(codes)
    pos = np.flatnonzero(table[_slot(g)]) if len(g) else np.zeros(0, np.int64)
    g = g[pos]
    k = np.minimum(np.searchsorted(index["key"], g), len(index["key"]) - 1)
    ok = index["key"][k] == g
    pos, k = pos[ok], k[ok]
    ok = _dense(pos, index)
    pos, k = pos[ok], k[ok]
    count = index["first"][k + 1] - index["first"][k]
    hit = np.repeat(index["first"][k], count) + _expand(count)
    pos, of, at = np.repeat(pos, count), index["of"][hit], index["at"][hit]
    diagonal = pos - at + index["longest"]  # never negative
    band = diagonal // BAND
    # A hit in the first e diagonals of a band also lies in the overlap of the one before.
    again = np.flatnonzero(((diagonal - band * BAND) < index["budget"][of]) & (band > 0))
    code = np.concatenate([of << 40 | band, of[again] << 40 | (band[again] - 1)])
    pos, at = np.concatenate([pos, pos[again]]), np.concatenate([at, at[again]])
    order = np.lexsort((pos, code))
    code, pos, at = code[order], pos[order], at[order]
    # A band goes on if as many hits as its passages need lie within the length that a region may have.
    of = code >> 40
    last = np.arange(len(code)) + index["need"][of] - 1
    end = np.minimum(last, max(len(code) - 1, 0))
    ok = (last < len(code)) & (code[end] == code) & (pos[end] - pos <= index["size"][of] + index["budget"][of])
    some = np.unique(code[ok])
    begin, stop = np.searchsorted(code, some), np.searchsorted(code, some, "right")
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for x, a, b in zip(some, begin, stop):
        own = int(x >> 40)
        m, here = int(index["size"][own]), np.sort(at[a:b])
        start = np.arange(0, len(index["text"][own]) - m + 1, STRIDE)
        n = np.searchsorted(here, start + max(m - Q, 0), "right") - np.searchsorted(here, start)
        start = start[np.argsort(-n, kind="stable")][: int((n >= index["need"][own]).sum())]
        for to, what in zip(out, (own, int(x & ((1 << 40) - 1)), start, len(out[0]))):
            to.append(np.full(len(start), what) if np.isscalar(what) else what)
    return tuple(np.concatenate(x) for x in out)


def _aligned(codes: np.ndarray, win: np.ndarray, budget: int, low: np.ndarray) -> np.ndarray:
    """For each row of win and its offset in low: the least edit distance to a region of codes on diagonals low .. low + BAND + budget."""
    far = np.int16(win.shape[1] + 1)
    first = low - budget  # the path may leave the hits' diagonals by its edits
    width = BAND + 3 * budget + 1
    if not len(codes) or codes[-1] != 10:
        codes = np.r_[codes, np.uint32(10)]
    place = first[:, None] + np.arange(width)[None]
    row = np.where((place >= 0) & (place < len(codes)), 0, far).astype(np.int16)  # nothing of win used: free start anywhere
    span = first[:, None] + np.arange(width + win.shape[1])[None]
    near = codes[np.minimum(np.maximum(span, 0), len(codes) - 1)]
    near[(span < 0) | (near == 10)] = 0xFFFFFFFF  # no match before, across or after texts
    ramp = np.arange(width, dtype=np.int16)
    for i in range(win.shape[1]):
        step = row + (near[:, i : i + width] != win[:, i, None])
        np.minimum(step[:, :-1], row[:, 1:] + np.int16(1), out=step[:, :-1])  # win's character left out
        step -= ramp
        row = np.minimum.accumulate(step, axis=1)  # text's characters left out
        row += ramp
    return row.min(axis=1)


def contaminated(texts: list, indexes: list[dict]) -> list[list[int]]:
    """For each text the sorted items that it contains a passage of."""
    found: list[set[int]] = [set() for _ in texts]
    for i, j in tn.chunks(texts):
        codes, starts = normalise(texts[i:j])
        codes = np.r_[codes, np.full(Q, 10, np.uint32)]
        own: list[set[int]] = [set() for _ in range(i, j)]
        for index in indexes:
            (_spelled if "spelled" in index else _verified)(codes, starts, index, own)
        found[i:j] = own
    return [sorted(f) for f in found]


def _verified(codes: np.ndarray, starts: np.ndarray, index: dict, found: list[set[int]]) -> None:
    """Add to found, by text, the item of each passage that meets the bound and whose alignment stays in the budget."""
    of, band, begin, number = _bands(codes, index, index["bits"])
    first = np.r_[True, number[1:] != number[:-1]][: len(number)]
    owner, edits, base = index["owner"][of[first]], index["budget"][of[first]], band[first] * BAND - index["longest"]
    # The texts that a band touches; where there is but one, and its item is found in it, the band has no more to say.
    long = np.array([len(t) for t in index["text"]], np.int64)[of[first]]
    one = np.searchsorted(starts, np.maximum(0, base - edits), "right") - 1
    two = np.searchsorted(starts, base + BAND + 2 * edits + long, "right") - 1
    place, at = np.cumsum(first) - 1, np.r_[np.flatnonzero(first), len(of)]
    left = np.ones(len(of), bool)
    # Passages a character apart differ in their distance by one at most (their ends may be replaced), save where a band reaches before all texts. So one that
    # lies far beyond the budget rules its neighbours out, and few are aligned where none matches.
    inside = base - 3 * edits - BAND > 0
    for mine in (first, begin % 8 == 0, begin % 4 == 0, begin % 2 == 0, ~first):
        for m in np.unique(index["size"][of[mine]]):
            done = np.array([x == y and k in found[x] for x, y, k in zip(one, two, owner)], bool)
            these = np.flatnonzero(mine & left & (index["size"][of] == m) & ~done[place])
            for s in range(0, len(these), 512):
                k = these[s : s + 512]
                e = int(index["budget"][of[k[0]]])
                low, text = band[k] * BAND - index["longest"] + begin[k], np.stack([index["text"][t][a : a + m] for t, a in zip(of[k], begin[k])])
                far = _aligned(codes, text, e, low).astype(np.int64)
                left[k] = False
                for x in np.flatnonzero((far > e + 1) & inside[place[k]]):
                    near = slice(at[place[k[x]]], at[place[k[x]] + 1])
                    left[near] &= abs(begin[near] - begin[k[x]]) > far[x] - e - 1
                for x in np.flatnonzero(far <= e):
                    # A region never crosses the line feed between texts; of the texts that the band touches, align with each.
                    lo, item = low[x], int(index["owner"][of[k[x]]])
                    a = np.searchsorted(starts, max(0, lo - e), "right") - 1
                    b = min(np.searchsorted(starts, lo + BAND + 2 * e + m, "right") - 1, len(starts) - 2)
                    for d in range(a, b + 1):
                        if item not in found[d] and (a == b or _aligned(codes[starts[d] : starts[d + 1]], text[x : x + 1], e, low[x : x + 1] - starts[d])[0] <= e):
                            found[d].add(item)


def unpacked(blob: bytes) -> list[dict]:
    return [x | {"bits": np.unpackbits(x["table"]).view(bool)} if "table" in x else x for x in pickle.loads(blob)]


def _matches(shared, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    indexes = unpacked(shared.value)
    for b in batches:
        yield pa.array(contaminated(b.to_pylist(), indexes), pa.list_(pa.int64()))


def matches_column(docs: DataFrame, benchmark: DataFrame, most_chars: int = MOST_CHARS):
    """A column for docs: the sorted item_ids that the text contains a passage of; empty for none, and for a null text.

    The benchmark's items are broadcast with their q-grams. They grow with the benchmark alone, never with the documents; a benchmark of more than most_chars
    characters raises a ValueError before anything is gathered: part it and combine the columns.
    """
    prepare(docs.sparkSession)
    own = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    checked(own, most_chars, "the benchmark")
    items = sorted((r.item_id, r.text) for r in own.collect())
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(windows(items), protocol=5))

    def matches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _matches(shared, it)

    return F.arrow_udf(matches, "array<bigint>")(docs["text"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) for every document and benchmark item of which it contains a passage.

    Rows with a null doc_id give a null doc_id; repeated rows give their pair once. Null, empty or wordless texts and items give nothing.
    """
    found = docs.select("doc_id", matches_column(docs, benchmark).alias("items"))
    return found.select("doc_id", F.explode("items").alias("item_id")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no passage of the benchmark, repeated rows each, with the columns they came with. Null texts stay."""
    name = fresh(docs, "items")
    return docs.withColumn(name, matches_column(docs, benchmark)).where(F.size(name) == 0).drop(name)
