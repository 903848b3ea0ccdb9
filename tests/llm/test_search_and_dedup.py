import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import DOCS, clashing, odd_rows, words
from vellumry.llm import components, decontam, simhash, topk
from vellumry.llm import textnum as tn


def _bm25(docs, queries, k):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    rows = [(i, Counter(split(t))) for i, t in docs if i is not None and split(t)]
    mean, n = sum(sum(c.values()) for _, c in rows) / len(rows), len(rows)
    df = Counter(w for _, c in rows for w in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in rows:
            s = 0
            for w in set(split(text)) & set(c):
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                s += math.floor(0.5 + 1e6 * idf * (c[w] * (topk.K1 + 1) / (c[w] + topk.K1 * (1 - topk.B + topk.B * sum(c.values()) / mean))))
            if s > 0:
                scored.append((-s, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_topk_equals_brute_force_with_ties(spark):
    vocab = words(60, 3)
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(1, 40)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(15)]  # ties
    queries = [(q, " ".join(rng.choice(vocab, 4))) for q in range(25)]
    found = topk.topk(spark.createDataFrame(docs, DOCS), spark.createDataFrame(queries, "item_id long, text string"), 10)
    assert sorted(map(tuple, found.collect())) == _bm25(docs, queries, 10)


def test_topk_odd_rows(spark):
    queries = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "one"), (4, "unseen")], "item_id long, text string")
    found = topk.topk(clashing(spark, odd_rows()), queries, 2).collect()
    # Ids 6 (twice) and 7 have the same text, so the same score; 2 rows are wanted, and the lesser id comes first.
    assert sorted((r.query_id, r.rank, r.doc_id) for r in found) == [(1, 1, 6), (1, 2, 6)] and len({r.score for r in found}) == 1
    three = topk.topk(clashing(spark, odd_rows()), queries, 4).collect()
    assert sorted((r.query_id, r.rank, r.doc_id) for r in three) == [(1, 1, 6), (1, 2, 6), (1, 3, 7)]
    assert topk.topk(spark.createDataFrame([], DOCS), queries).count() == 0
    assert topk.topk(clashing(spark, odd_rows()), queries.where("false")).count() == 0


def test_topk_index_rows_hold_no_postings(spark):
    docs = [(i, " ".join(words(200, i % 50))) for i in range(300)]
    queries = [(q, " ".join(words(3, q))) for q in range(10)]
    index, n, mean = topk.build(spark.createDataFrame(docs, DOCS).coalesce(1))
    # What Spark's readers and Arrow batches hold of a shard is its place, whatever it has of words.
    assert [t for _, t in index.dtypes if t == "binary"] == [] and all(len(str(r)) < 1000 for r in index.collect())
    found = topk.search(index, n, mean, spark.createDataFrame(queries, "item_id long, text string"), 10)
    assert sorted(map(tuple, found.collect())) == _bm25(docs, queries, 10)


def test_topk_shards_end_by_postings(monkeypatch):
    texts = [" ".join(words(200, i)) for i in range(100)]
    batch = pa.record_batch([pa.array(range(100)), pa.array(texts)], names=["doc_id", "text"])
    whole = list(topk._shards(200.0, iter([batch])))
    monkeypatch.setattr(topk, "POSTINGS", 3000)
    monkeypatch.setattr(topk, "PIECE", 8)
    cut = list(topk._shards(200.0, iter([batch.slice(0, 37), batch.slice(37)])))
    assert len(whole) == 1 and len(cut) > 5 and max(len(x["postings"]) for x in cut) < 3000 + 8 * 200
    assert sum(len(x["postings"]) for x in cut) == len(whole[0]["postings"]) and np.concatenate([x["doc_ids"] for x in cut]).tolist() == list(range(100))
    monkeypatch.setattr(topk, "SHARD", 5)
    few = [x["doc_ids"].tolist() for x in topk._shards(200.0, iter([batch.slice(0, 12)]))]
    assert max(map(len, few)) == 5 and sum(few, []) == list(range(12))


def test_letters_of_all_planes_are_words(spark):
    docs = spark.createDataFrame([(1, "𠀀𠀁 𝐀𝐁"), (2, "𠀁 other"), (3, "😀 😀")], DOCS)
    queries = spark.createDataFrame([(1, "𠀀𠀁"), (2, "😀")], "item_id long, text string")
    assert [(r.query_id, r.doc_id) for r in topk.topk(docs, queries).collect()] == [(1, 1)]


def test_queries_beyond_the_bound_raise(spark, monkeypatch):
    monkeypatch.setattr(topk, "MOST_CHARS", 10)
    queries = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    with pytest.raises(ValueError, match="13 characters"):
        topk.topk(clashing(spark, odd_rows()), queries)
    with pytest.raises(ValueError, match="13 characters"):
        decontam.matches_column(clashing(spark, odd_rows()), queries, 10)


def test_span_hashes_do_not_depend_on_their_chunks(monkeypatch):
    text = " ".join(words(3000, 5)) + " " + "x" * 5000 + " " + " ".join(words(300, 5))
    plain = tn.words([text])[0]
    monkeypatch.setattr(tn, "CHUNK", 300)
    tn._powers.cache_clear()
    try:
        assert (tn.words([text])[0] == plain).all() and (tn.words([text])[0][:300] == tn.words(["y " + text])[0][1:301]).all()
    finally:
        monkeypatch.undo()
        tn._powers.cache_clear()


def _distance(a, b):
    return int(np.bitwise_count(a[0] ^ b[0]) + np.bitwise_count(a[1] ^ b[1]))


def test_simhash_groups_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = []
    for g in range(40):
        base = words(120, 100 + g)
        for v in range(1 + g % 5):
            t = list(base)
            for p in rng.integers(0, len(t), 2 * v):
                t[p] = "edit"
            docs.append((len(docs), " ".join(t)))
    docs += [(len(docs) + i, docs[3][1]) for i in range(60)]  # exact copies
    fp, n = simhash.fingerprints([t for _, t in docs])
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if _distance(fp[a], fp[b]) <= simhash.RADIUS:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(docs, DOCS)).collect()}
    assert found == {i: find(i) for i in range(len(docs))}
    assert 40 <= len(set(found.values())) <= 42  # a copy with eight edits in 120 words may lie beyond the radius


def test_simhash_odd_rows(spark):
    rows = odd_rows()
    found = {r.doc_id: r.group_id for r in simhash.groups(clashing(spark, rows)).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    kept = simhash.deduplicate(clashing(spark, rows))
    assert kept.columns == clashing(spark, rows[:1]).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 8]
    assert kept.where("doc_id IS NULL").count() == 1
    empty = spark.createDataFrame([], DOCS)
    assert simhash.groups(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_simhash_ids_that_repeat_with_unlike_texts(spark):
    x, a, b = (" ".join(words(60, seed)) for seed in (31, 32, 33))
    rows = [(2, x), (5, x), (5, a), (7, a), (8, b), (8, None), (9, ""), (9, None), (4, b + " more"), (4, b + " more")]
    found = {r.doc_id: r.group_id for r in simhash.groups(clashing(spark, rows)).collect()}
    assert found == {2: 2, 5: 2, 7: 2, 4: 4, 8: 4, 9: 9}
    # One row of each text stays: no group vanishes with the group of another text of its id.
    kept = [(r.doc_id, r.text) for r in simhash.deduplicate(clashing(spark, rows)).collect()]
    assert sorted(k for k in kept if k[0] != 9) == sorted([(2, x), (5, a), (4, b + " more"), (8, None)], key=lambda k: (k[0], k[1] or ""))
    assert len([k for k in kept if k[0] == 9]) == 1
    # Two texts that both have an id first are two groups of texts, and one of ids.
    rows = [(1, x), (1, a), (2, a)]
    assert {r.doc_id: r.group_id for r in simhash.groups(clashing(spark, rows)).collect()} == {1: 1, 2: 1}
    assert sorted((r.doc_id, r.text) for r in simhash.deduplicate(clashing(spark, rows)).collect()) == sorted([(1, x), (1, a)])


def test_components_of_a_chain_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(3, 3), (1, 0), (100, 101)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def _least_edits(window, text):
    """The least edit distance of window to any region of text."""
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_decontamination_equals_brute_force():
    rng = np.random.default_rng(5)
    items = [(k, " ".join(words(30, 500 + k))) for k in range(4)]
    texts = []
    for k in range(24):
        own = " ".join(words(20, 900 + k))
        passage = list(items[k % 4][1][20 : 20 + 130 + 10 * (k % 3)])
        for p in rng.integers(0, len(passage), k // 2):
            passage[p] = "z"
        texts.append(own + " " + ("".join(passage) if k % 6 else "") + " " + own)
    index = decontam.unpacked(__import__("pickle").dumps(decontam.windows(items)))
    found = decontam.contaminated(texts, index)
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    for text, got in zip(texts, found):
        want = []
        for ident, item in items:
            it = norm(item)
            cuts = [*range(0, len(it) - decontam.WINDOW, decontam.STRIDE), len(it) - decontam.WINDOW]
            if (_least_of_all([it[a : a + decontam.WINDOW] for a in cuts], norm(text)) <= math.floor(decontam.RATE * decontam.WINDOW)).any():
                want.append(ident)
        assert got == want
    assert any(found) and not all(found)


def test_decontamination_finds_passages_at_any_offset():
    # Against brute force over all passages of WINDOW characters, whole short items too; with and without edits.
    rng = np.random.default_rng(8)
    items = [(k, " ".join(words(n, 700 + k))) for k, n in enumerate((30, 28, 15, 9))]
    assert [len(t) > 110 for _, t in items] == [True, True, False, False]
    texts = []
    for k in range(15):
        item = items[k % 4][1]
        n = min(len(item), int(rng.integers(50, 110)))
        a = int(rng.integers(0, len(item) - n + 1))
        passage = list(item[a : a + n])
        for p in rng.integers(0, n, (0, 0, 4, 6, 9)[k % 5]):
            passage[p] = ("", "zz", "z")[p % 3]
        texts.append(" ".join([*words(6, 1000 + k), "".join(passage), *words(6, 1100 + k)]) if k % 7 else "".join(passage))
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    found = decontam.contaminated(texts, decontam.unpacked(__import__("pickle").dumps(decontam.windows(items))))
    for text, got in zip(texts, found):
        want = []
        for ident, item in items:
            it = norm(item)
            passages = {it[a : a + decontam.WINDOW] for a in range(len(it) - decontam.WINDOW + 1)} | ({it} if len(it) < 2 * decontam.WINDOW else set())
            if any(_least_edits(p, norm(text)) <= math.floor(decontam.RATE * len(p)) for p in passages):
                want.append(ident)
        assert got == want
    assert 5 < sum(map(bool, found)) < 15
    # Verbatim passages of 60 characters, at each offset of a long item.
    item = items[0][1]
    cut = [item[a : a + 60] for a in range(len(item) - 59)]
    cut = [c for c in cut if c == norm(c)]
    assert decontam.contaminated(["before " + c + " after" for c in cut], decontam.unpacked(__import__("pickle").dumps(decontam.windows(items)))) == [[0]] * len(cut)


def test_decontamination_odd_rows(spark):
    passage = " ".join(words(40, 77))
    rows = [*odd_rows(), (20, "before " + passage + " after"), (20, "before " + passage + " after")]
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (None, passage)], "item_id long, text string")
    docs = clashing(spark, rows)
    assert [tuple(r) for r in decontam.leaks(docs, bench).collect()] == [(20, 1)]
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows())
    assert decontam.leaks(docs, bench.where("false")).count() == 0
    assert decontam.leaks(docs.where("false"), bench).count() == 0


def _least_of_all(passages, text):
    """_least_edits() of passages of one length, as whole matrices."""
    codes = np.array([ord(c) for c in text], np.int64)
    rows = np.array([[ord(c) for c in p] for p in passages], np.int64)
    ramp, prev = np.arange(len(codes) + 1), np.zeros((len(rows), len(codes) + 1), np.int64)
    for i in range(rows.shape[1]):
        cur = np.full_like(prev, i + 1)
        cur[:, 1:] = np.minimum(prev[:, :-1] + (rows[:, i, None] != codes), prev[:, 1:] + 1)
        prev = np.minimum.accumulate(cur - ramp, axis=1) + ramp
    return prev.min(axis=1)


def test_least_of_all_is_the_plain_distance():
    assert _least_of_all(["abcd", "xbcd", "zzzz"], "aabd bcd").tolist() == [_least_edits(p, "aabd bcd") for p in ("abcd", "xbcd", "zzzz")]


def test_decontamination_of_short_items_equals_brute_force():
    rng = np.random.default_rng(11)
    items, texts = [], []
    for k in range(32):
        m = int(rng.integers(1, 300)) if k % 2 else int(rng.integers(1, 40))
        item = re.sub(r" +", " ", " ".join(words(60, 2000 + k))[:m]).strip() or "q"
        items.append((k, item))
        a = int(rng.integers(0, max(1, len(item) - 70)))
        passage = list(item[a : a + 75] if len(item) >= 120 else item)
        for p in rng.integers(0, len(passage), (0, 1, 2, 0, 3)[k % 5] if len(passage) > 5 else 0):
            passage[p] = ("z", "")[p % 2]
        texts.append(" ".join([*words(4, 3000 + k), "".join(passage), *words(4, 3100 + k)]) if k % 3 else "".join(passage))
    texts += ["abcd abc", "abcabc", None, "", "ABC!"]
    items += [(100, "abc"), (101, "answers"), (102, "a b"), (103, "the answer is"), (104, "seventeen letters")]
    texts += ["with answers", "answers", "a b", "ya b", "a bc", "the answerx is", "so the answer is yes", "seventeen lettxrs of it", "seventeen letters", "sxventeen lettxrs"]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    found = decontam.contaminated(texts, decontam.unpacked(__import__("pickle").dumps(decontam.windows(items))))
    for text, got in zip(texts, found):
        want = []
        for ident, item in items:
            it, own = norm(item), norm(text)
            if len(it) < decontam.Q:
                hit = f" {it} " in f" {own} "
            else:
                budget = lambda p: (e if len(p) - 7 - 8 * e >= 1 else 0) if (e := math.floor(decontam.RATE * len(p))) else 0
                passages = {it[a : a + decontam.WINDOW] for a in range(len(it) - decontam.WINDOW + 1)} | ({it} if len(it) < 2 * decontam.WINDOW else set())
                hit = any((_least_of_all([p for p in passages if len(p) == n], own) <= budget("x" * n)).any() for n in {len(p) for p in passages})
            if hit:
                want.append(ident)
        assert got == want, text
    assert sum(map(bool, found)) > 20


@pytest.mark.parametrize("n", [0, 1, 33])
def test_forest_reaches_all(n):
    fp = np.zeros((n, 2), np.uint64)
    assert len(simhash._forest(fp, np.arange(n))[0]) == max(0, n - 1)


def _flipped(rng, fp, n):
    x = fp.copy()
    for b in rng.choice(128, n, replace=False):
        x[b // 64] ^= np.uint64(1) << np.uint64(int(b) % 64)
    return x


def _roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(int(a)), find(int(b))))
        root[y] = x
    return [find(k) for k in range(n)]


def _all_near(fp):
    return [(a, a + 1 + int(b)) for a in range(len(fp)) for b in np.flatnonzero(simhash._far(fp[a + 1 :], fp[a]) <= simhash.RADIUS)]


@pytest.mark.parametrize("prefix", [5, 9])
def test_table_of_balls_finds_all_pairs(prefix):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (500, 2), dtype=np.int64).view(np.uint64)
    fp = np.unique(np.concatenate([base, [_flipped(rng, base[rng.integers(500)], int(rng.integers(3, 25))) for _ in range(700)]]), axis=0)
    batch = pa.RecordBatch.from_arrays([pa.array(fp[:, k].copy().view(np.int64)) for k in range(2)], names=["f0", "f1"])
    blobs = pa.Table.from_batches(simhash._blobs(prefix, iter([batch]))).sort_by("part").combine_chunks()
    at = {tuple(x): k for k, x in enumerate(fp.tolist())}
    edges = [(at[a, b], at[c, d]) for out in simhash._match_parts(prefix, iter(blobs.to_batches())) for a, b, c, d in zip(*(x.to_numpy().view(np.uint64).tolist() for x in out.columns))]
    assert _roots(len(fp), edges) == _roots(len(fp), _all_near(fp))


def test_crowded_keys_lose_nothing(monkeypatch):
    # Many under one key of segment 0, most of them far from each other, and fewer one flip away.
    monkeypatch.setattr(simhash, "MANY", 300)
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 2**63, (900, 2), dtype=np.int64).view(np.uint64)
    fp = np.concatenate([fp, [_flipped(rng, fp[rng.integers(900)], int(rng.integers(3, 20))) for _ in range(200)]])
    low = np.uint64((1 << 21) - 1)
    fp[:, 0] = (fp[:, 0] & ~low) | np.where(np.arange(len(fp)) % 10 == 0, np.uint64(12345 ^ 8), np.uint64(12345))
    fp = np.unique(fp, axis=0)
    at = {tuple(x): k for k, x in enumerate(fp.tolist())}
    want = _roots(len(fp), _all_near(fp))
    assert _roots(len(fp), [(int(a), int(b)) for a, b in simhash._by_second_segment(fp, 0)]) == want
    found = simhash._match(fp, *simhash._entries(fp, np.zeros(len(fp), np.uint8), 0, 5), 0)
    assert _roots(len(fp), [(at[a, b], at[c, d]) for a, b, c, d in found.tolist()]) == want != list(range(len(fp)))


def test_short_texts_have_fingerprints_of_their_own():
    texts = ["one", "two", "one two", "two one", "one three", "alpha beta gamma", "alpha beta gamma delta", "beta gamma"]
    fp, n = simhash.fingerprints(texts)
    assert n.tolist() == [1, 1, 2, 2, 2, 3, 4, 2]
    assert min(_distance(fp[a], fp[b]) for a in range(len(texts)) for b in range(a)) > simhash.RADIUS
    assert (simhash.fingerprints([None, "", texts[2]])[0][2] == fp[2]).all()
