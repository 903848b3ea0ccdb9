"""Masked pseudo-likelihood: how well a bidirectional network predicts each word of a document from the words on both sides.

Vocabulary. Words are counted over the whole corpus. The KNOWN most frequent ones are leaves of their own; all others share BUCKETS hashed leaves, and below
each of these FINE hashed parts whose shares are counted over the corpus, too.

Network. For a place, the vectors of the leaves of the SIDE words before and behind it (the own word is masked) are summed up, with a table per distance, and
go through tanh to three softmaxes that all read this hidden layer. The first has the FREQUENT most frequent words and CLASSES classes of MEMBERS leaves each;
the second, with vectors of its own for each class, has the class's leaves; the third, for words that aren't known, has the bucket's parts, from the log of their
shares on. A word's log-probability is the sum along its path, so the context counts for every word; a document's score is the sum over all its places.

Training. Documents are dealt out to shards by a hash of id and text and sorted by it; how many shards depends on the number of words alone. A hash of word and
place in its document deals the places out to ROUNDS rounds, so every place is masked in exactly one of them. In each round a task trains on each shard's places,
by Adagrad in numpy, from the shared weights, and the shards' weights are averaged by their numbers of places, in order of the shards. So every word of every
document is learnt from once, the driver receives one network per round whatever the number of tasks, and the scores don't depend on how the input is cut.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.llm import textnum as tn
from vellumry.llm.common import materialize, prepare

FREQUENT, MEMBERS, HASHED, FINE, SIDE, HIDDEN = 127, 128, 32, 64, 2, 24
#: Classes of known words and, behind them, HASHED classes of buckets.
CLASSES = 64 + HASHED
KNOWN, BUCKETS = FREQUENT + (CLASSES - HASHED) * MEMBERS, HASHED * MEMBERS
ROUNDS, BATCH, STEP = 2, 8192, 0.1
#: Words that a shard has about, until there are MOST_SHARDS; of more words each has more.
SHARD_WORDS, MOST_SHARDS = 8_000_000, 8192
#: Places whose logits are held at a time, so that they stay in a core's cache, and places scored together, so that each class has many of them.
SLICE, TOGETHER = 512, 1 << 16
#: Rows of one key, beyond which they are added up by themselves, and weights that are stepped at a time.
MANY, AT_ONCE = 40, 1 << 15
#: Context symbols: all leaves, and the edge of the document.
CONTEXTS = KNOWN + BUCKETS + 1
_EDGE = CONTEXTS - 1
#: Where each distance's table begins among the rows of all of them.
_TABLE = (np.arange(2 * SIDE) * CONTEXTS).astype(np.min_scalar_type(2 * SIDE * CONTEXTS))[:, None]
#: Logits of greater size are shifted before they are exponentiated. Sums of exponentials times weights stay within the range of floats, too.
_RANGE = 60


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word hashes, per few batches; the shuffle sums them up."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    for b in batches:
        texts = b.column(0).to_pylist()
        for i, j in tn.chunks(texts):
            h = tn.words(texts[i:j])[0]
            held.append(h)
            size += len(h)
            if size > 4_000_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def vocabulary(docs: DataFrame) -> tuple[dict, int]:
    """Hashes of the known words, the most frequent first, log shares of the first level, of the leaves in their class and of the parts in their bucket; and the
    number of all words."""
    counts = materialize(docs.select("text").mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "h").limit(KNOWN).collect()
    known = np.array([r.h for r in top], np.int64).view(np.uint64)
    often = np.array([r.n for r in top], np.float64)
    total = np.zeros(BUCKETS * FINE)
    parts = counts.groupBy(F.expr(f"h & {BUCKETS * FINE - 1}").cast("int").alias("b")).agg(F.sum("n").alias("n")).toArrow()
    total[parts["b"].to_numpy()] = parts["n"].to_numpy()
    words = int(total.sum())
    np.subtract.at(total, (known & np.uint64(BUCKETS * FINE - 1)).astype(np.int64), often)
    parts = total.reshape(BUCKETS, FINE)
    leaf = np.zeros(KNOWN + BUCKETS)
    leaf[: len(often)], leaf[KNOWN:] = often, parts.sum(axis=1)
    first, member = place_of(np.arange(len(leaf)))
    inner = np.zeros((CLASSES, MEMBERS))
    inner[first[FREQUENT:] - FREQUENT, member[FREQUENT:]] = leaf[FREQUENT:]
    share = lambda n: np.log((n + 0.5) / (n + 0.5).sum(axis=-1, keepdims=True)).astype(np.float32)
    return {"frequent": known, "classes": share(np.bincount(first, leaf, FREQUENT + CLASSES)), "members": share(inner), "parts": share(parts)}, words


def place_of(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each leaf its output on the first level, and its number in its class (of no meaning for the FREQUENT). Known words are dealt out to their classes."""
    k, b = leaf - FREQUENT, leaf - KNOWN
    deal = CLASSES - HASHED
    first = np.where(k < 0, leaf, FREQUENT + np.where(b < 0, k % deal, deal + b // MEMBERS))
    return first, np.where(b < 0, k // deal, b % MEMBERS)


_FIRST, _MEMBER = (x.astype(np.int16) for x in place_of(np.arange(KNOWN + BUCKETS)))
_SHIFT = FINE.bit_length() - 1


def leaves(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol its leaf, and the part of its bucket (of no meaning for known words)."""
    b = sym - KNOWN
    return np.where(b < 0, sym, KNOWN + (b >> _SHIFT)), b & (FINE - 1)


def _slots(known: np.ndarray) -> list[np.ndarray]:
    """Tables of the numbers of known words by the lower bits of their hashes, -1 where there is none; words that share these bits are in different tables."""
    tables, left, low = [], np.arange(len(known)), (known & np.uint64(BUCKETS * FINE - 1)).astype(np.int64)
    while len(left):
        tables.append(np.full(BUCKETS * FINE, -1, np.int32))
        tables[-1][low[left]] = left
        left = left[tables[-1][low[left]] != left]
    return tables


def encode(texts: list, frequent: np.ndarray) -> list[bytes]:
    """Of each text its symbols, uint32: the number of a known word, or KNOWN + bucket * FINE + part."""
    out, tables = [], _slots(frequent)
    for i, j in tn.chunks(texts):
        h, doc, *_ = tn.words(texts[i:j])
        low = (h & np.uint64(BUCKETS * FINE - 1)).astype(np.int64)
        sym = (KNOWN + low).astype(np.uint32)
        for table in tables:
            word = table.take(low)
            at = np.flatnonzero(word >= 0)
            at = at[frequent.take(word[at]) == h[at]]
            sym[at] = word[at]
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        out += [sym[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return out


def _encoded(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, words, hash, and whether the row is the first of its batch with its id and hash: of a row that repeats without end few go on to training."""
    frequent = pickle.loads(shared.value)
    for b in batches:
        seen: set = set()
        first = [not ((k := pair) in seen or seen.add(k)) for pair in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode(b.column(1).to_pylist(), frequent), pa.binary()), b.column(2), pa.array(first, pa.bool_())], names=["doc_id", "words", "h", "first"])


def start(vocab: dict, seed: int = 1) -> dict[str, np.ndarray]:
    """The first network. The last rows of `layer` and `second` are the biases."""
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.3, (2 * SIDE, CONTEXTS, HIDDEN)).astype(np.float32)
    layer = rng.normal(0, 0.1, (HIDDEN, FREQUENT + CLASSES)).astype(np.float32)
    second = rng.normal(0, 0.1, (CLASSES, HIDDEN, MEMBERS)).astype(np.float32)
    return {
        "tables": tables,
        "inner": np.zeros(HIDDEN, np.float32),
        "layer": np.concatenate([layer, vocab["classes"][None].astype(np.float32)]),
        "second": np.concatenate([second, vocab["members"][:, None].astype(np.float32)], axis=1),
        "third": np.zeros((HIDDEN, FINE), np.float32),
    }


_NAMES = ("tables", "inner", "layer", "second", "third")


def _flat(net: dict) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in _NAMES])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, a = {}, 0
    for k in _NAMES:
        out[k] = flat[a : a + like[k].size].reshape(like[k].shape).astype(np.float32)
        a += like[k].size
    return out


def contexts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All documents' symbols, the (n, 2 * SIDE) contexts of their places, the document of each place and its number there."""
    sizes = np.array([len(b) // 4 for b in blobs], np.int64)
    sym = np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(blobs), dtype=np.int32), sizes)
    place = np.arange(len(sym), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    seen = leaves(sym)[0].astype(np.uint16)
    ctx = np.full((len(sym), 2 * SIDE), _EDGE, np.uint16)
    for d in range(1, SIDE + 1):
        near = place[d:] >= d  # whether a place and the one d before it belong to one document
        ctx[d:, SIDE - d] = np.where(near, seen[:-d], _EDGE)
        ctx[:-d, SIDE - 1 + d] = np.where(near, seen[d:], _EDGE)
    return sym, ctx, doc, place


def _reach(weights: np.ndarray) -> np.ndarray:
    """The greatest size that logits of hidden layers (from -1 to 1, and 1 for the bias) may have, of each matrix."""
    return np.abs(weights).sum(axis=-2).max(axis=-1)


def _exp(z: np.ndarray, reach: float) -> np.ndarray:
    """z becomes its exponentials, each row shifted if some might leave the range of floats. Returns the shifts, or zeros."""
    shift = np.zeros(len(z), np.float32)
    if reach > _RANGE:
        shift = z.max(axis=1)
        z -= shift[:, None]
    np.exp(z, out=z)
    return shift


def _hidden(net: dict, ctx: np.ndarray) -> np.ndarray:
    """The hidden layer of each place, and 1 behind it for the biases."""
    out = np.ones((len(ctx), HIDDEN + 1), np.float32)
    for a in range(0, len(ctx), 4 * SLICE):
        own = ctx[a : a + 4 * SLICE]
        h = net["tables"][0].take(own[:, 0], axis=0)
        for d in range(1, ctx.shape[1]):
            h += net["tables"][d].take(own[:, d], axis=0)
        h += net["inner"]
        np.tanh(h, out=out[a : a + 4 * SLICE, :HIDDEN])
    return out


_ONES = np.ones(FREQUENT + CLASSES, np.float32)
_MANY_ONES = np.ones(BATCH, np.float32)


class _Paths:
    """Where the paths of words lead: the first level's outputs; `inner`, the places with a second level, by class; `hashed`, those with a third."""

    def __init__(self, sym: np.ndarray):
        leaf, part = leaves(sym)
        self.first, member = _FIRST.take(leaf), _MEMBER.take(leaf)
        inner = np.flatnonzero(leaf >= FREQUENT)
        cls = (self.first[inner] - FREQUENT).astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        self.inner, cls = inner[order], cls[order]
        self.member = member[self.inner]
        #: Slices of inner that hold whole classes, about SLICE places each, and the runs of one class in each.
        self.blocks = []
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b == a:
                continue
            if self.blocks and b - self.blocks[-1][0] <= SLICE:
                x, _, runs = self.blocks[-1]
                self.blocks[-1] = x, b, [*runs, (k, a, b)]
            else:
                self.blocks.append((a, b, [(k, a, b)]))
        self.hashed = np.flatnonzero(leaf >= KNOWN)
        self.part, self.bucket = part[self.hashed], leaf[self.hashed] - KNOWN


def word_scores(net: dict, vocab: dict, ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """The log-probability of each word in its context."""
    h, path = _hidden(net, ctx), _Paths(sym)
    p = np.empty(len(sym))

    def chosen(z: np.ndarray, target: np.ndarray, reach: float) -> np.ndarray:
        own = z[np.arange(len(z)), target]
        shift = _exp(z, reach)
        return own - shift - np.log(z @ _ONES[: z.shape[1]])

    reach = float(_reach(net["layer"]))
    for x in range(0, len(h), SLICE):
        p[x : x + SLICE] = chosen(h[x : x + SLICE] @ net["layer"], path.first[x : x + SLICE], reach)
    reach, h2, p2 = float(_reach(net["second"]).max()), h.take(path.inner, axis=0), np.empty(len(path.inner))
    for x, y, runs in path.blocks:
        z = np.empty((y - x, MEMBERS), np.float32)
        for c, a, b in runs:
            np.matmul(h2[a:b], net["second"][c], out=z[a - x : b - x])
        p2[x:y] = chosen(z, path.member[x:y], reach)
    p[path.inner] += p2
    reach = float(_reach(net["third"])) - float(vocab["parts"].min())
    for x in range(0, len(path.hashed), SLICE):
        own = path.hashed[x : x + SLICE]
        z = h[own, :HIDDEN] @ net["third"]
        z += vocab["parts"][path.bucket[x : x + SLICE]]
        p[own] += chosen(z, path.part[x : x + SLICE], reach)
    return p


def _groups(blobs: Iterable, limit: int = 1 << 17) -> Iterator[list[bytes]]:
    """Runs of documents of about so many words; a document is never cut."""
    own, size = [], 0
    for b in blobs:
        own.append(b or b"")
        size += len(own[-1]) // 4
        if size >= limit:
            yield own
            own, size = [], 0
    if own:
        yield own


def _unscaled(z: np.ndarray, target: np.ndarray, reach: float) -> np.ndarray:
    """z, logits, become the gradient of each place's loss by them, but for a factor of each row that is returned, (n, 1)."""
    _exp(z, reach)
    total = z @ _ONES[: z.shape[1]]
    z[np.arange(len(target)), target] -= total
    return (1 / total)[:, None]


def _error(z: np.ndarray, target: np.ndarray, reach: float) -> np.ndarray:
    """z, logits, become the gradient of each place's loss by them."""
    z *= _unscaled(z, target, reach)
    return z


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and for each the sum of its rows of values; keys[i] is that of row i % len(values).

    Keys are ordered by how often they occur; their first rows are taken at once, then the second rows of all that have one are added, and so on.
    """
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    count = np.diff(np.r_[begin, len(own)])
    by = np.argsort((len(own) - count).astype(np.min_scalar_type(len(own))), kind="stable")
    begin, count, row = begin[by], count[by], order % len(values)
    more = np.searchsorted(-count, -np.arange(MANY + 1)).tolist()  # the keys that occur more often than 0, 1, ... times
    out, often = values.take(row[begin], axis=0), more[MANY]
    for j, (a, n) in enumerate(zip(begin[:often].tolist(), count[:often].tolist())):
        np.matmul(_MANY_ONES[:n] if n <= BATCH else np.ones(n, np.float32), values.take(row[a : a + n], axis=0), out=out[j])
    for r in range(1, MANY):
        if more[r] <= often:
            break
        out[often : more[r]] += values.take(row[begin[often : more[r]] + r], axis=0)
    return own[begin], out


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """table[rows] = values, each row moved as a whole."""
    whole = np.dtype((np.void, table.shape[1] * table.itemsize))
    table.view(whole).ravel()[rows] = values.view(whole).ravel()


class Trainer:
    """Adagrad over minibatches of masked places."""

    def __init__(self, net: dict, vocab: dict):
        self.net = {k: v.copy() for k, v in net.items()}
        self.vocab = vocab
        self.sums = {k: np.full(v.shape, 1e-6, np.float32) for k, v in net.items()}
        self.places = 0
        self.bounds: dict[str, float] = {}
        self.least = float(vocab["parts"].min())

    def _reach(self, name: str) -> float:
        """At least the greatest _reach() of this matrix. A step moves no weight by more than STEP, so it's only counted anew when it might be beyond _RANGE."""
        bound = self.bounds.get(name, np.inf) + 1.01 * STEP * (HIDDEN + 1)
        if bound > _RANGE:
            bound = float(_reach(self.net[name]).max())
        self.bounds[name] = bound
        return bound

    def _step(self, name: str, grad: np.ndarray, n: int, at: slice = slice(None)) -> None:
        """A step of these weights, those of the first axis `at`."""
        flat = [x[at].reshape(-1) for x in (grad, self.sums[name], self.net[name])]
        for a in range(0, flat[0].size, AT_ONCE):
            g, sums, weights = (x[a : a + AT_ONCE] for x in flat)
            g *= np.float32(1 / n)
            new = g * g
            sums += new
            g *= np.float32(STEP)
            g /= np.sqrt(sums, out=new)
            weights -= g

    def _step_rows(self, rows: np.ndarray, grad: np.ndarray, n: int) -> None:
        """A step of these rows of the tables, counted through all of them."""
        table, sums = (x["tables"].reshape(-1, HIDDEN) for x in (self.net, self.sums))
        for a in range(0, len(rows), AT_ONCE // HIDDEN):
            own, g = rows[a : a + AT_ONCE // HIDDEN].astype(np.intp), grad[a : a + AT_ONCE // HIDDEN]
            g *= np.float32(1 / n)
            now = sums.take(own, axis=0)
            now += g * g
            _put(sums, own, now)
            g *= np.float32(STEP)
            g /= np.sqrt(now, out=now)
            table.take(own, axis=0, out=now, mode="clip")
            now -= g
            _put(table, own, now)

    def learn(self, ctx: np.ndarray, target: np.ndarray) -> None:
        """One pass over these places, a step for each BATCH of them."""
        for a in range(0, len(ctx), BATCH):
            self.step(ctx[a : a + BATCH], target[a : a + BATCH])

    def step(self, c: np.ndarray, t: np.ndarray) -> None:
        net, h, path, n = self.net, _hidden(self.net, c), _Paths(t), len(t)
        back = np.empty((n, HIDDEN), np.float32)
        layer, down = np.zeros_like(net["layer"]), np.ascontiguousarray(net["layer"][:HIDDEN].T)
        reach = self._reach("layer")
        for x in range(0, n, SLICE):
            own = h[x : x + SLICE]
            g = own @ net["layer"]
            scale = _unscaled(g, path.first[x : x + SLICE], reach)
            np.matmul(g, down, out=back[x : x + SLICE])
            back[x : x + SLICE] *= scale
            layer += (own * scale).T @ g
        second, reach, weights = np.zeros_like(net["second"]), self._reach("second"), net["second"]
        h2 = h.take(path.inner, axis=0)
        back2 = np.empty((len(h2), HIDDEN), np.float32)
        for x, y, runs in path.blocks:
            z = np.empty((y - x, MEMBERS), np.float32)
            for k, a, b in runs:
                np.dot(h2[a:b], weights[k], out=z[a - x : b - x])
            g = _error(z, path.member[x:y], reach)
            for k, a, b in runs:
                own = g[a - x : b - x]
                np.dot(own, weights[k, :HIDDEN].T, out=back2[a:b])
                np.dot(h2[a:b].T, own, out=second[k])
            # No other block has these classes.
            self._step("second", second, n, slice(runs[0][0], runs[-1][0] + 1))
        back[path.inner] += back2
        third, reach = np.zeros_like(net["third"]), self._reach("third") - self.least
        for x in range(0, len(path.hashed), SLICE):
            own = path.hashed[x : x + SLICE]
            h3 = h[own, :HIDDEN]
            z = h3 @ net["third"]
            z += self.vocab["parts"][path.bucket[x : x + SLICE]]
            g = _error(z, path.part[x : x + SLICE], reach)
            third += h3.T @ g
            back[own] += g @ net["third"].T
        h = h[:, :HIDDEN]
        back *= 1 - h * h
        for name, grad in (("third", third), ("layer", layer), ("inner", back.sum(axis=0))):
            self._step(name, grad, n)
        self._step_rows(*_summed((c.T + _TABLE).ravel(), back), n)
        self.places += n


def masked(sym: np.ndarray, place: np.ndarray, turn: int) -> np.ndarray:
    """The places masked in this round; each falls to one of the ROUNDS rounds, by a hash of the word and its place in its document."""
    key = tn.mix((place.astype(np.uint64) << np.uint64(20)) + sym.astype(np.uint64))
    return np.flatnonzero(key % np.uint64(ROUNDS) == turn)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Texts of rows sorted by hash and id; of rows alike in both one."""
    last = None
    for b in batches:
        for h, i, words in zip(b.column("h").to_pylist(), b.column("doc_id").to_pylist(), b.column("words").to_pylist()):
            if (h, i) != last:
                yield words
            last = h, i


def _trained(shared, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trainer = Trainer(*pickle.loads(shared.value))
    held, size = [], 0
    for blobs in _groups(_distinct(batches)):
        sym, ctx, _, place = contexts(blobs)
        at = masked(sym, place, turn)
        held.append((ctx[at], sym[at]))
        size += len(at)
        if size >= 8 * BATCH:
            size = _learn(trainer, held, size // BATCH * BATCH)
    if size:
        _learn(trainer, held, size)
    if trainer.places:
        shard = TaskContext.get().partitionId()
        parts = np.array_split(_flat(trainer.net), 16)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([shard] * 16, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([trainer.places] * 16, pa.int64())], names=["part", "shard", "weights", "places"])


def _learn(trainer: Trainer, held: list, n: int) -> int:
    """Learn from the first n places held; the rest stay. So batches are full ones, wherever groups of documents end."""
    ctx, sym = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
    trainer.learn(ctx[:n], sym[:n])
    held[:] = [(ctx[n:], sym[n:])]
    return len(sym) - n


def _averaged(table: pa.Table) -> pa.Table:
    """The mean of the weights, each counted by its places, summed up in order of the shards."""
    table = table.sort_by("shard")
    places = table.column("places").to_numpy()
    total = 0.0
    for w, n in zip(table.column("weights"), places):
        total = total + np.frombuffer(w.as_buffer(), np.float32) * (n / places.sum())
    row = {"part": [table.column("part")[0].as_py()], "shard": [table.column("shard")[0].as_py()], "weights": [total.astype(np.float32).tobytes()], "places": [int(places.sum())]}
    return pa.Table.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("weights", pa.binary()), ("places", pa.int64())]))


_SUMS = "part int, shard int, weights binary, places long"


def train(encoded: DataFrame, vocab: dict, shards: int) -> dict:
    """The network after ROUNDS rounds over all documents of encoded (doc_id, h, words); rows alike in id and hash count once."""
    sc = encoded.sparkSession.sparkContext
    net = start(vocab)
    dealt = encoded.select("h", "doc_id", "words").repartitionById(shards, F.pmod("h", F.lit(shards)).cast("int")).sortWithinPartitions("h", "doc_id")
    for turn in range(ROUNDS):
        shared = sc.broadcast(pickle.dumps((net, vocab), protocol=5))
        local = dealt.mapInArrow(lambda it, s=shared, t=turn: _trained(s, t, it), _SUMS)
        # In two steps of about as many networks each, so that no task adds up all of them.
        salted = local.groupBy("part", (F.col("shard") % max(1, math.isqrt(shards))).alias("salt")).applyInArrow(_averaged, _SUMS)
        parts = salted.groupBy("part").applyInArrow(_averaged, _SUMS).collect()
        if not parts:
            return net
        parts.sort(key=lambda r: r.part)
        net = _shaped(np.concatenate([np.frombuffer(bytes(r.weights), np.float32) for r in parts]), net)
    return net


def log_probabilities(blobs: list[bytes], net: dict, vocab: dict) -> np.ndarray:
    """The sum for each document."""
    out = np.zeros(len(blobs))
    sym, ctx, doc, _ = contexts(blobs)
    for a in range(0, len(sym), TOGETHER):
        own = slice(a, a + TOGETHER)
        out += np.bincount(doc[own], word_scores(net, vocab, ctx[own], sym[own]), minlength=len(blobs))
    return out


def _scored(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    net, vocab = pickle.loads(shared.value)
    for b in batches:
        blobs = b.column(1).to_pylist()
        score = np.concatenate([log_probabilities(g, net, vocab) for g in _groups(blobs)] or [np.zeros(0)])
        n = np.array([len(x or b"") // 4 for x in blobs], np.int64)
        mean = np.where(n > 0, score / np.maximum(n, 1), np.nan)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(score), pa.array(mean, from_pandas=True)], names=["doc_id", "n_words", "score", "mean_score"])


def shards_of(words: int) -> int:
    return max(1, min(MOST_SHARDS, -(-words // SHARD_WORDS)))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, score, mean_score) for every row of docs, repeated rows and null ids each.

    score is the sum of log-probabilities, 0 for null, empty and wordless texts, whose mean is null. Rows alike in id and text are learnt from once and scored
    each; copies under other ids are learnt from each. An empty table gives an empty result. Scores depend on the rows alone, not on how they are cut into files
    and tasks. Other columns, whatever their names, are not read.
    """
    prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    vocab, total = vocabulary(docs)
    frequent = sc.broadcast(pickle.dumps(vocab["frequent"], protocol=5))
    own = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"))
    encoded = materialize(own.mapInArrow(lambda it: _encoded(frequent, it), "doc_id long, words binary, h long, first boolean"), "encoded")
    net = train(encoded.where("first AND words <> X''"), vocab, shards_of(total))
    shared = sc.broadcast(pickle.dumps((net, vocab), protocol=5))
    return encoded.select("doc_id", "words").mapInArrow(lambda it: _scored(shared, it), "doc_id long, n_words long, score double, mean_score double")
