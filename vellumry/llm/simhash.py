"""Near-duplicate removal by SimHash and multi-index hashing.

A text's fingerprint has 128 bits: the signs of the sum, over its distinct words, of log(1 + count) times a random vector of +-1 per word. Where the sum is 0,
as it often is for few words, the least of the text's hashed word pairs decides. The same holds for texts of any length.
Two texts are near copies when their fingerprints differ in at most RADIUS bits; groups are the connected components of that relation.

Search. The bits are cut into SEGMENTS parts. Of two fingerprints within RADIUS = 6 * 2 + 5 bits one part at least differs in 2 bits or fewer, so
the balls of radius 1 around both parts share a key. A part of the table holds, for one segment, all keys that begin with the same bits. Each distinct fingerprint
is sent once to the part of its own bits, which enumerates the keys of its ball there, and once for each of the beginning's bits, whose flip leads to another
part. Entries that meet under a key are compared over all 128 bits. Nothing is lost: recall against brute force over the fingerprints is 1.

Exact copies collapse first, so a passage copied a million times is one fingerprint. Under a key of many near copies a search from one entry to those not
yet reached yields a spanning forest instead of all pairs, with the same components. Of a key's many entries that aren't near each other, those that share a
key of a second segment's balls alone are compared. No entry or partner is ever dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumry.llm import textnum as tn
from vellumry.llm.common import fresh, materialize, prepare
from vellumry.llm.components import components

BITS, SEGMENTS, RADIUS = 128, 6, 17
#: Entries of balls that one task holds at a time, and the bits at a segment's beginning that part the table at least.
ENTRIES_A_PART, LEAST_PREFIX = 4_000_000, 5
#: Entries under a key from which on a second segment parts them.
MANY = 65_536
U, MAX = np.uint64, (1 << 64) - 1
_CUTS = [round(i * BITS / SEGMENTS) for i in range(SEGMENTS + 1)]


def fingerprints(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints and the number of words of each text; texts without words get fingerprint 0."""
    out, count = np.zeros((len(texts), 2), U), np.zeros(len(texts), np.int64)
    for i, j in tn.chunks(texts):
        h, doc, *_ = tn.words(texts[i:j])
        if not len(h):
            continue
        n = np.bincount(doc, minlength=j - i)
        count[i:j] = n
        # The least of each text's hashed word pairs; a text of one word has its word.
        pair = np.where(np.r_[doc[1:] == doc[:-1], False], tn.mix(h * U(0x9E3779B97F4A7C15) + np.r_[h[1:], U(0)]), U(MAX))
        least = np.minimum.reduceat(pair, np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]))
        # Distinct words of each text with their counts.
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        weight = np.log1p(np.diff(np.r_[first, len(h)])).astype(np.float32)
        hd, dd = h[first], doc[first]
        begin = np.flatnonzero(np.r_[True, dd[1:] != dd[:-1]])
        for k in range(2):
            salt = U((k + 1) * 0x9E3779B97F4A7C15 & MAX)
            bits = lambda x: np.unpackbits(tn.mix(x + salt).view(np.uint8).reshape(-1, 8), axis=1)  # noqa: E731, B023
            signs = bits(hd)
            total = (bits(least).astype(np.float32) * 2 - 1) * np.float32(0.01)
            for s in range(0, len(begin), 256):  # bounded memory
                a, b = begin[s], begin[s + 256] if s + 256 < len(begin) else len(hd)
                total[s : s + 256] += np.add.reduceat((signs[a:b].astype(np.float32) * 2 - 1) * weight[a:b, None], begin[s : s + 256] - a, axis=0)
            out[i + dd[begin], k] = np.packbits(total > 0, axis=1).view(U).ravel()
    return out, count


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, n = fingerprints(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(fp[:, 0].copy())), pa.array(_signed(fp[:, 1].copy())), pa.array(n), b.column(2)], names=["doc_id", "f0", "f1", "n_words", "hash"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1, n_words, hash of the text) for every row of docs; only doc_id and text are read. A null or wordless text has fingerprint 0 and n_words 0."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash")).mapInArrow(_fingerprint_batches, "doc_id long, f0 long, f1 long, n_words long, hash long")


def _segment(fp: np.ndarray, s: int) -> np.ndarray:
    """The bits of segment s of each fingerprint, as one number."""
    a, b = _CUTS[s], _CUTS[s + 1]
    key = np.zeros(len(fp), U)
    for word in (0, 1):
        lo, hi = max(a, word * 64), min(b, word * 64 + 64)
        if lo < hi:
            key |= ((fp[:, word] >> U(lo - word * 64)) & U((1 << (hi - lo)) - 1)) << U(lo - a)
    return key


def prefix_bits(n: int) -> int:
    """How many bits at a segment's beginning part the table for n distinct fingerprints."""
    width = min(b - a for a, b in zip(_CUTS[:-1], _CUTS[1:]))
    return min(width, max(LEAST_PREFIX, math.ceil(math.log2(max(1, n) * (1 + width) / ENTRIES_A_PART))))


def _blobs(prefix: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part of the table one binary of what is sent there: fingerprints of 16 bytes, then for each a byte that tells how it comes there: 0 by its own
    bits, else 1 + the number of the bit that is flipped."""
    for b in batches:
        for a in range(0, b.num_rows, 8192):
            x = b.slice(a, 8192)
            fp = np.stack([x.column(0).to_numpy().view(U), x.column(1).to_numpy().view(U)], axis=1)
            parts, owns, ways = [], [], []
            for s in range(SEGMENTS):
                width = _CUTS[s + 1] - _CUTS[s]
                head = (_segment(fp, s) >> U(width - prefix)).astype(np.int64)
                for way in range(prefix + 1):
                    parts.append((s << prefix) + (head ^ (1 << (way - 1)) if way else head))
                    owns.append(np.arange(len(fp)))
                    ways.append(np.full(len(fp), width - prefix + way if way else 0, np.uint8))
            part, own, way = np.concatenate(parts), np.concatenate(owns), np.concatenate(ways)
            order = np.argsort(part, kind="stable")
            part, own, way = part[order], own[order], way[order]
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            blobs = [fp[own[y:z]].tobytes() + way[y:z].tobytes() for y, z in zip(at, np.r_[at[1:], len(part)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _entries(fp: np.ndarray, way: np.ndarray, s: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of segment s that these fingerprints have in this part, the fingerprint of each, and 0 for its own bits or 1 + the number of the flipped bit."""
    key, own = _segment(fp, s), np.flatnonzero(way == 0)
    come = np.flatnonzero(way > 0)
    keys, owns, flips = [key[own], key[come] ^ (U(1) << (way[come].astype(U) - U(1)))], [own, come], [np.zeros(len(own), np.uint8), way[come]]
    for bit in range(_CUTS[s + 1] - _CUTS[s] - prefix):
        keys.append(key[own] ^ U(1 << bit))
        owns.append(own)
        flips.append(np.full(len(own), bit + 1, np.uint8))
    return np.concatenate(keys), np.concatenate(owns), np.concatenate(flips)


def _far(fp: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, 0] ^ one[..., 0]) + np.bitwise_count(fp[:, 1] ^ one[..., 1])


def _forest(fp: np.ndarray, members: np.ndarray, tries: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, 2) of a spanning forest of the members' near-copy graph, by a search that compares only with members not yet reached; and, where `tries` searches
    that find nothing end it, the members whose partners aren't all known."""
    left, queue, edges = members, [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        near = _far(fp[left], fp[x]) <= RADIUS
        if near.any():
            found, left = left[near], left[~near]
            edges.append(np.stack([np.full(len(found), x), found], axis=1))
            queue.extend(found)
        elif tries is not None:
            tries -= 1
            if not tries:
                left = np.r_[left, np.array(queue, left.dtype)]
                break
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64), left


def _hooked(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of x and y in label, which leads each member to the least of its component."""
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _by_second_segment(fp: np.ndarray, s: int) -> np.ndarray:
    """Edges (n, 2) of a spanning forest of the near copies among fingerprints that share a key of segment s.

    Of their other segments one differs in RADIUS // (SEGMENTS - 1) = 3 bits or fewer, so a ball of radius 1 around one side meets one of radius 2 around
    the other.
    """
    label = np.arange(len(fp))
    for t in range(SEGMENTS):
        if t == s:
            continue
        key, width = _segment(fp, t).astype(np.int64), _CUTS[t + 1] - _CUTS[t]
        flips = [0] + [1 << i for i in range(width)]
        near = np.concatenate([key ^ f for f in flips])
        # A table from each value of the segment to its entries.
        starts = np.zeros((1 << width) + 1, np.int64)
        np.cumsum(np.bincount(near, minlength=1 << width), out=starts[1:])
        own = np.tile(np.arange(len(fp)), len(flips))[np.argsort(near, kind="stable")]
        for f in flips + [1 << i | 1 << j for i in range(width) for j in range(i)]:
            want = key ^ f
            lo = starts[want]
            n = starts[want + 1] - lo
            upto = np.cumsum(n)
            for a in range(0, int(upto[-1]), 1 << 20):  # bounded memory
                k = np.arange(a, min(a + (1 << 20), int(upto[-1])))
                x = np.searchsorted(upto, k, "right")
                y = own[lo[x] + k - (upto[x] - n[x])]
                some = x < y
                x, y = x[some], y[some]
                close = _far(fp[x], fp[y]) <= RADIUS
                _hooked(label, x[close], y[close])
    some = np.flatnonzero(label != np.arange(len(fp)))
    return np.stack([label[some], some], axis=1)


def _match(fp: np.ndarray, keys: np.ndarray, own: np.ndarray, flip: np.ndarray, s: int) -> np.ndarray:
    """(m, 4) words of two fingerprints each: near copies that meet under a key of segment s, or stand for such in the same component.

    Two that come to a key by the same flip have the same own bits, so they meet under these without flips, too, and here they needn't be compared.
    """
    order = np.argsort(keys, kind="stable")
    keys, own, flip = keys[order], own[order], flip[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(keys)])
    left = np.repeat(at + size, size) - np.arange(len(keys))  # entries from here to the end of the run
    left[np.repeat(size > 32, size)] = 0
    edges = []
    for gap in range(1, 32):  # runs of up to 32 entries: all pairs, by distance within the run
        a = np.flatnonzero(left > gap)
        if not len(a):
            break
        for k in range(0, len(a), 1 << 18):
            x, y = a[k : k + (1 << 18)], a[k : k + (1 << 18)] + gap
            some = (flip[x] != flip[y]) | (flip[x] == 0)
            x, y = own[x[some]], own[y[some]]
            near = _far(fp[x], fp[y]) <= RADIUS
            edges.append(np.stack([x[near], y[near]], axis=1))
    for a, n in zip(at[size > 32], size[size > 32]):
        members, by = own[a : a + n], flip[a : a + n]
        most = int(np.bincount(by)[1:].argmax()) + 1 if by.any() else 0
        crowd = members[by == most]
        if most and 2 * len(crowd) > n:  # most come by one flip: compare only the others with them
            members = members[by != most]
            for x in members:
                near = crowd[_far(fp[crowd], fp[x]) <= RADIUS]
                edges.append(np.stack([np.full(len(near), x), near], axis=1))
        found, rest = _forest(fp, members, 64 if len(members) > MANY else None)
        edges.append(found)
        if len(rest):
            edges.append(rest[_by_second_segment(fp[rest], s)])
    if not edges:
        return np.zeros((0, 4), U)
    e = np.concatenate(edges)
    x, y = fp[e[:, 0]], fp[e[:, 1]]
    swap = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1]))
    return np.unique(np.where(swap[:, None], np.concatenate([y, x], axis=1), np.concatenate([x, y], axis=1)), axis=0)


def _match_parts(prefix: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by part: match each part's entries as soon as they are complete."""
    fps, ways, at = [], [], None

    def out() -> pa.RecordBatch:
        fp, s = np.concatenate(fps), at >> prefix
        e = _match(fp, *_entries(fp, np.concatenate(ways), s, prefix), s)
        return pa.RecordBatch.from_arrays([pa.array(e[:, k].copy().view(np.int64)) for k in range(4)], names=["a0", "a1", "b0", "b1"])

    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if part != at and fps:
                yield out()
                fps, ways = [], []
            at = part
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            n = len(raw) // 17
            fps.append(raw[: n * 16].view(U).reshape(-1, 2).copy())
            ways.append(raw[n * 16 :].copy())
    if fps:
        yield out()


def near_pairs(distinct: DataFrame, n: int) -> DataFrame:
    """(a0, a1, b0, b1): edges between distinct fingerprints (f0, f1) whose components are those of all pairs within RADIUS.

    n: the number of distinct fingerprints; parts grow with it, so that a task's share doesn't.
    """
    prefix = prefix_bits(n)
    blobs = distinct.select("f0", "f1").mapInArrow(lambda it: _blobs(prefix, it), "part int, blob binary")
    placed = blobs.repartitionById(SEGMENTS << prefix, F.col("part")).sortWithinPartitions("part")
    return placed.mapInArrow(lambda it: _match_parts(prefix, it), "a0 long, a1 long, b0 long, b1 long")


def _text_groups(fps: DataFrame) -> DataFrame:
    """(f0, f1, root) for each distinct fingerprint of texts with words: root is the least (doc_id, f0, f1) of its group of near copies.

    A group's node is more than a doc_id, which may have texts of several groups.
    """
    distinct = materialize(fps.where("n_words > 0 AND doc_id IS NOT NULL").groupBy("f0", "f1").agg(F.min("doc_id").alias("first")), "distinct")
    n = distinct.count()
    pairs = materialize(near_pairs(distinct, n), "pairs")
    names = distinct.select("f0", "f1", F.struct("first", "f0", "f1").alias("node"))
    edges = (
        pairs.distinct()
        .join(names.select(F.col("f0").alias("a0"), F.col("f1").alias("a1"), F.col("node").alias("u")), ["a0", "a1"])
        .join(names.select(F.col("f0").alias("b0"), F.col("f1").alias("b1"), F.col("node").alias("v")), ["b0", "b1"])
        .select("u", "v")
    )
    roots = components(edges).withColumnRenamed("node", "member")
    return names.join(roots, F.col("node") == F.col("member"), "left").select("f0", "f1", F.coalesce("root", "node").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, n_words) for every row of docs with a doc_id: group_id is the least doc_id of its group of near copies.

    Null and wordless texts are no copies of each other: their group is their own doc_id. Rows that share a doc_id share a group, so an id with
    unlike texts joins their groups into one. Rows with a null doc_id are left out. An empty table gives an empty result.
    """
    fps = materialize(fingerprint_table(docs), "fingerprints")
    labelled = _text_groups(fps).select("f0", "f1", F.col("root.first").alias("group"))
    found = materialize(
        fps.where("n_words > 0 AND doc_id IS NOT NULL").join(labelled, ["f0", "f1"]).groupBy("doc_id").agg(F.min("group").alias("group_id"), F.max("group").alias("most"), F.max("n_words").alias("n_words")), "found"
    )
    several = found.where("group_id <> most").select("doc_id")
    if not several.isEmpty():
        # Ids with texts of several groups: each links all of them.
        links = fps.where("n_words > 0").join(several, "doc_id").join(labelled, ["f0", "f1"]).select(F.col("doc_id").alias("u"), F.col("group").alias("v"))
        joined = components(links).where("node <> root").select(F.col("node").alias("group_id"), "root")
        found = found.join(joined, "group_id", "left").select("doc_id", F.coalesce("root", "group_id").alias("group_id"), "n_words")
    found = found.select("doc_id", "group_id", "n_words")
    alone = fps.where("n_words = 0 AND doc_id IS NOT NULL").select("doc_id").distinct().join(found, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_words"))
    return found.unionByName(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of near copies one row, of the least doc_id; columns as they came.

    Groups are of texts, whatever their ids: a doc_id with unlike texts may keep a row in each of their groups. Of a group's rows with the least doc_id
    the one with the least hash of its text stays. Rows with a null doc_id are kept, and so are null or wordless texts, one row of each doc_id. Extra
    columns, whatever their names, pass through.
    """
    fps = materialize(fingerprint_table(docs), "fingerprints")
    some = fps.where("doc_id IS NOT NULL")
    worded = some.where("n_words > 0").join(_text_groups(fps), ["f0", "f1"]).groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("least")).select("least.*")
    wordless = some.where("n_words = 0").groupBy("doc_id").agg(F.min("hash").alias("hash"))
    repeats = some.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "hash", F.lit(True).alias("repeated"))
    ident, text_hash, repeated, rank = fresh(docs, "id"), fresh(docs, "hash"), fresh(docs, "repeated"), fresh(docs, "rank")
    stay = worded.unionByName(wordless).join(repeats, ["doc_id", "hash"], "left").select(F.col("doc_id").alias(ident), F.col("hash").alias(text_hash), F.coalesce("repeated", F.lit(False)).alias(repeated))
    stay = materialize(stay, "kept")
    kept = docs.join(stay, (docs["doc_id"].cast("long") == stay[ident]) & (F.xxhash64(docs["text"]) == stay[text_hash]))
    once = kept.where(~F.col(repeated)).select(*(docs[c] for c in docs.columns))
    many = kept.where(repeated).withColumn(rank, F.row_number().over(Window.partitionBy(ident, text_hash).orderBy(ident))).where(F.col(rank) == 1).drop(ident, text_hash, repeated, rank)
    return once.unionByName(many).unionByName(docs.where("doc_id IS NULL"))
