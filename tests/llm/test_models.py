import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import DOCS, clashing, odd_rows, words
from vellumry.llm import labelled, lm_score, quality, toxicity, url_filter
from vellumry.llm import textnum as tn

LABELS = "doc_id long, quality int, toxic int"


def _sentences(bad: bool, n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    plain, ugly, group = words(40, 9), ["vile", "scum", "trash"], ["women", "men", "muslim", "christian", "gay"]
    out = []
    for _ in range(n):
        w = list(rng.choice(plain, 12))
        if rng.random() < (0.8 if bad else 0.3):
            w.insert(3, rng.choice(group))  # the terms are more frequent in toxic texts
        if bad:
            w.insert(int(rng.integers(12)), rng.choice(ugly))
        out.append(" ".join(w) + ".")
    return out


def test_toxicity_on_held_out_sentences_and_neutral_mentions():
    texts = _sentences(False, 300, 1) + _sentences(True, 120, 2)
    model = toxicity.train(texts, [0] * 300 + [1] * 120)
    assert (toxicity.scores(_sentences(True, 100, 3), model) > 0).mean() > 0.97
    assert (toxicity.scores(_sentences(False, 100, 4), model) > 0).mean() < 0.03
    neutral = [f"the {g} met here today." for g in ("women", "men", "muslim", "christian", "gay")]
    assert (toxicity.scores(neutral, model) <= 0).all()
    free = toxicity.train(texts, [0] * 300 + [1] * 120, penalty=0)
    swing = lambda m: np.ptp(toxicity.scores([f"we saw {g} there" for g in ("women", "men")], m)) + abs(np.subtract(*toxicity.scores(["we saw women there", "we saw there"], m)))
    assert swing(model) < swing(free)


def test_classifiers_without_labels_keep_everything(spark):
    docs, none = clashing(spark, odd_rows()), spark.createDataFrame([], LABELS)
    assert toxicity.reject_toxic(docs, none).count() == len(odd_rows())
    kept = quality.keep_quality(docs, none)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [4, 5, 6, 6, 7, 8]
    rows = toxicity.classify(docs, none).collect()
    assert len(rows) == len(odd_rows()) and not any(r.toxic for r in rows) and {r.doc_id for r in rows if r.score is None} == {1, 2, 3, 4}
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.classify(empty, none).count() == quality.classify(empty, none).count() == 0


def test_odd_labels(spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, None, None), (None, 1, 1), (7, 5, 5)], LABELS)
    docs = clashing(spark, odd_rows())
    assert quality.classify(docs, labels).count() == toxicity.classify(docs, labels).count() == len(odd_rows())


def test_quality_on_held_out_texts():
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(words(80, 5), 60)) for _ in range(200)]
    junk = ["buy buy now now $$$ click click " * 6 + t[:60] for t in good[:80]]
    model = quality.train(good[:150] + junk[:60], [1] * 150 + [0] * 60)
    assert (quality.scores(good[150:], model) >= 0).mean() > 0.95 and (quality.scores(junk[60:], model) < 0).mean() > 0.95
    assert np.isnan(quality.scores(["", None, " \n"], model)).all()


def _witten_bell(urls, order):
    """log-likelihood of a byte by dictionaries, one context length after another."""
    uses, kinds, counts = Counter(), {}, Counter()
    for u in urls:
        b = b"\x02" + u.encode() + b"\x03"
        for at in range(1, len(b)):
            for k in range(min(order, at) + 1):
                context = b[at - k : at]
                uses[context] += 1
                counts[context, b[at]] += 1
                kinds.setdefault(context, set()).add(b[at])

    def p(b, at, k):
        below = p(b, at, k - 1) if k >= 0 else None
        if k < 0:
            return 1 / 256
        context = b[at - k : at]
        n = uses[context]
        return below if not n or k > at else (counts[context, b[at]] + len(kinds[context]) * below) / (n + len(kinds[context]))

    return lambda b, at: p(b, at, order)


def test_url_models_equal_a_version_by_dictionaries():
    urls = [f"http://{w}.org/{v}" for w, v in zip(words(30, 1), words(30, 2))] + ["http://ü.de/straße"]
    model, plain = url_filter.fit(urls), _witten_bell(urls, url_filter.ORDER)
    for u in [*urls[:4], "http://ü.de/x", "unlike anything!", "a", "x" * 3000]:
        b, place, _ = url_filter._bytes([u])
        raw = b"\x02" + u.encode() + b"\x03"
        want = [0.0] + [math.log(plain(raw, at)) for at in range(1, len(raw))]
        assert np.allclose(url_filter._log_likelihood(b, place, model), want, rtol=1e-9)
    other = url_filter.fit([f"ftp://{w}" for w in words(20, 3)])
    d = url_filter.differences(["http://a.org/b", "ftp://qq"], model, other)
    b, place, _ = url_filter._bytes(["http://a.org/b"])
    assert np.isclose(d[0], (url_filter._log_likelihood(b, place, model) - url_filter._log_likelihood(b, place, other)).sum() / 15)


def test_url_models_sum_to_one_and_separate():
    model = url_filter.fit(["http://a.b/c", "http://a.b/d", "http://a.b/"])
    for begin in ("", "h", "http://a.b/", "zz"):  # known and unknown contexts, at the beginning and inside
        raw = np.array([[url_filter._BEGIN, *begin.encode(), c] for c in range(256)], np.uint8)
        n = raw.shape[1]
        ll = url_filter._log_likelihood(raw.ravel(), np.tile(np.arange(n), 256), model).reshape(256, n)
        assert abs(np.exp(ll[:, -1]).sum() - 1) < 1e-12
    good, bad = [f"https://news.example.org/{w}/story" for w in words(200, 1)], [f"http://casino-win.biz/?ref={w}&x=1" for w in words(200, 2)]
    m = url_filter.train(good[:150] + bad[:150], [1] * 150 + [0] * 150)
    assert (url_filter.scores(good[150:], m) >= 0).all() and (url_filter.scores(bad[150:], m) < 0).all()


def test_url_sample_is_bounded_by_what_counts(spark):
    page = lambda i, tag: (i, f"http://x.org/{i}", "<!-- " + "licence " * 900 + f"--><html lang={tag}>" + "w " * 600)
    rows = [page(i, "en" if i % 2 else "de") for i in range(60)] + [page(1, "en")] * 100 + [(500 + i, None, "x") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    urls, y = url_filter.labelled(pages, 50)
    assert len(urls) == len(set(urls)) == 50 and 0 < sum(y) < 50
    # The tag lies behind 7,000 characters; the label is right all the same.
    assert all(t == int(u.rsplit("/", 1)[1]) % 2 for u, t in zip(urls, y))
    every = url_filter.labelled(pages, 1000)
    assert len(every[0]) == 60


def test_training_samples_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a" * 10)] * 50 + [(1, "b" * 10)] + [(i, "c" * 10) for i in range(2, 30)] + [(None, "d")], DOCS).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 30)], LABELS)
    texts, y = labelled.sample(docs, labels, "toxic", 20)
    assert len(texts) == len(y) == 20
    texts, y = labelled.sample(docs, labels, "toxic", 100)
    assert len(texts) == 29 and sum(y) == 15
    assert len(labelled.sample(docs, labels, "toxic", 100, chars=55)[0]) == 5
    assert len(labelled.sample(docs, labels, "toxic", 100, chars=1)[0]) == 1
    assert labelled.sample(docs.where("false"), labels, "toxic", 100) == ([], [])


def test_toxicity_scores_equal_a_loop_over_words():
    rng = np.random.default_rng(4)
    model = {"weights": rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), "bias": -1.5, "threshold": 0.25}
    long = " ".join(words(500, 6))
    texts = ["One two, one TWO three. Four five! Six?\nseven", "no end", "你好世界。再见朋友！真的？", "नमस्ते दुनिया। फिर मिलेंगे", "", None, "?!", long, long + ". " + long, "élan vital… déjà vu"]
    bucket = lambda h, n: (tn.word_hash(h) ^ n) % toxicity.BUCKETS
    for text, got in zip(texts, toxicity.scores(texts, model)):
        best = None
        for sentence in re.split("[" + re.escape(toxicity.ENDS) + "]", (text or "").lower()):
            own = set(re.findall(r"(?:[^\W_]|[\u0300-\u036f\u0900-\u094d])+", sentence))
            if own:
                value = sum(float(model["weights"][bucket(w, 0)]) + sum(float(model["weights"][bucket(w[:n], n)]) for n in toxicity.PREFIXES) for w in own)
                best = value if best is None else max(best, value)
        assert np.isnan(got) if best is None else abs(got - (best + model["bias"] - model["threshold"])) < 1e-6
    assert len(toxicity.sentences(["你好世界。再见朋友！真的？"])[1]) == 3


def test_quality_scores_equal_a_loop_over_features():
    rng = np.random.default_rng(5)
    model = {"value": rng.normal(0, 1, quality.BUCKETS).astype(np.float32), "bias": 0.3, "usual": 0.1, "threshold": -0.2}

    def span(chars):
        return int(tn.hashed_spans(np.array([ord(c) for c in chars], np.uint32), np.array([0]), np.array([len(chars)]))[0]) % quality.BUCKETS

    def gram(chars):
        total = sum(ord(c) * pow(quality._P, k, 1 << 64) for k, c in enumerate(chars)) % (1 << 64)
        return (total * 0xFF51AFD7ED558CCD % (1 << 64) >> 40) % quality.BUCKETS

    texts = ["One two two TWO three", " lead\tand tail ", "a", "ab", "", None, " \n", "naïve straße 北京", " ".join(words(200, 8))]
    for text, got in zip(texts, quality.scores(texts, model)):
        own = (text or "").split()
        found = [span(w) for w in own] + [quality.AGAIN for a, b in zip(own, own[1:]) if a.lower() == b.lower()]
        flat = "".join(" " if c.isspace() else c for c in " " + (text or "") + " ")
        for n in quality.N:
            found += [gram(flat[a : a + n]) for a in range(len(flat) - n + 1) if " " not in flat[a + 1 : a + n - 1]]
        if not own:
            assert np.isnan(got)
            continue
        want = (sum(float(model["value"][f]) for f in found) + quality.PRIOR * model["usual"]) / (len(found) + quality.PRIOR) + model["bias"] - model["threshold"]
        assert abs(got - want) < 1e-5


def test_url_filter_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a", "<html lang=en>" + "w " * 600, 1.0), (2, None, None, None), (3, "", "<html lang=de>", 2.0), (None, "http://y.org", "", 0.0), (1, "http://x.org/a", "<html lang=en>" + "w " * 600, 1.0)], "page_id long, url string, html string, score double")
    rows = url_filter.classify(pages).collect()
    assert len(rows) == 5 and [r.keep for r in rows if not r.url] == [False, False]
    assert url_filter.classify(pages.where("false")).count() == 0


def _encoded(spark, texts, vocab):
    rows = [(i, k * 7919, bytearray(b)) for k, (i, b) in enumerate(enumerate(lm_score.encode(texts, vocab["frequent"])))]
    return spark.createDataFrame(rows, "doc_id long, h long, words binary")


def _plain_score(text, net, vocab):
    """A document's log-probability, word by word and level by level, without arrays of words."""
    known = {int(h): k for k, h in enumerate(vocab["frequent"])}
    size, L = lm_score.BUCKETS * lm_score.FINE, lm_score
    hashes = [int(h) for h in tn.words([text])[0]]
    seen = [known[h] if h in known else L.KNOWN + h % size // L.FINE for h in hashes]
    softmax = lambda z, k: z[k] - math.log(sum(math.exp(v) for v in z))
    total = 0.0
    for at, h in enumerate(hashes):
        x = net["inner"].astype(float)
        for d, place in enumerate([at - 2, at - 1, at + 1, at + 2]):
            x = x + net["tables"][d][seen[place] if 0 <= place < len(seen) else L._EDGE]
        x = np.r_[np.tanh(x), 1.0]
        leaf = seen[at]
        if leaf < L.FREQUENT:
            total += softmax(x @ net["layer"], leaf)
            continue
        k = leaf - L.KNOWN
        cls, member = ((leaf - L.FREQUENT) % (L.CLASSES - L.HASHED), (leaf - L.FREQUENT) // (L.CLASSES - L.HASHED)) if k < 0 else (L.CLASSES - L.HASHED + k // L.MEMBERS, k % L.MEMBERS)
        total += softmax(x @ net["layer"], L.FREQUENT + cls) + softmax(x @ net["second"][cls], member)
        if k >= 0:
            total += softmax(x[:-1] @ net["third"] + vocab["parts"][k], h % size % L.FINE)
    return total


def test_lm_scores_equal_a_loop_over_words_and_prefer_order(spark):
    cycle = words(12, 1)
    texts = [" ".join(cycle[(k + j) % 12] for j in range(50)) for k in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)
    vocab, n = lm_score.vocabulary(docs)
    assert n == 150_000
    net = lm_score.start(vocab)
    blobs = lm_score.encode(texts[:5], vocab["frequent"])
    before = lm_score.log_probabilities(blobs, net, vocab).sum()
    # Trained, texts in order are likelier than before, and than the same words shuffled.
    rng = np.random.default_rng(0)
    shuffled = lm_score.encode([" ".join(rng.permutation(t.split())) for t in texts[:5]], vocab["frequent"])
    trained = lm_score.train(_encoded(spark, texts, vocab), vocab, 1)
    after = lm_score.log_probabilities(blobs, trained, vocab).sum()
    assert after > before and after > lm_score.log_probabilities(shuffled, trained, vocab).sum() + 10
    odd = [texts[0], "unseen words here " + texts[1], "one", "", " ".join(words(300, 3)), "x " * 100]
    trained["third"] = rng.normal(0, 0.3, trained["third"].shape).astype(np.float32)
    for scale in (1, 40):  # with the greater weights logits leave the range that needs no shift
        wide = {k: v * np.float32(scale) for k, v in trained.items()}
        got = lm_score.log_probabilities(lm_score.encode(odd, vocab["frequent"]), wide, vocab)
        assert np.allclose(got, [_plain_score(t, wide, vocab) for t in odd], rtol=1e-5, atol=1e-3)


def test_lm_step_follows_the_gradient():
    # The first step of Adagrad moves each weight by STEP against the sign of the loss's gradient, as differences of the loss give it.
    rng = np.random.default_rng(3)
    vocab = {"classes": np.zeros(lm_score.FREQUENT + lm_score.CLASSES, np.float32), "members": np.zeros((lm_score.CLASSES, lm_score.MEMBERS), np.float32), "parts": np.zeros((lm_score.BUCKETS, lm_score.FINE), np.float32)}
    net = lm_score.start(vocab)
    net["third"] = rng.normal(0, 0.3, net["third"].shape).astype(np.float32)
    sym = np.array([5, 5, lm_score.FREQUENT + 7, lm_score.KNOWN + 70, lm_score.KNOWN + 71, 9])
    ctx = rng.integers(0, 50, (len(sym), 4)).astype(np.uint16)
    trainer = lm_score.Trainer(net, vocab)
    trainer.learn(ctx, sym)
    loss = lambda n: -lm_score.word_scores(n, vocab, ctx, sym).mean()
    picks = {"inner": (3,), "layer": (2, 5), "second": (int(lm_score.place_of(np.array([lm_score.FREQUENT + 7]))[0][0]) - lm_score.FREQUENT, 4, 0), "third": (1, 6), "tables": (0, int(ctx[0, 0]), 2)}
    for name, at in picks.items():
        moved, wide = {k: v.astype(np.float64).copy() for k, v in net.items()}, 1e-4
        moved[name][at] += wide
        up = loss(moved)
        moved[name][at] -= 2 * wide
        slope = (up - loss(moved)) / (2 * wide)
        change = float(trainer.net[name][at] - net[name][at])
        want = -lm_score.STEP * slope / math.sqrt(1e-6 + slope * slope)
        assert abs(change - want) < 0.02 * abs(want) + 1e-4, name


def test_lm_encodes_known_words_that_share_their_lower_bits(monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKETS", 1)
    monkeypatch.setattr(lm_score, "FINE", 16)
    text = " ".join(words(300, 9))
    h = tn.words([text])[0]
    known = np.unique(h)[::3]
    number = {int(x): k for k, x in enumerate(known)}
    assert len(lm_score._slots(known)) > 3
    got = np.frombuffer(lm_score.encode([text], known)[0], np.uint32).tolist()
    assert got == [number.get(int(x), lm_score.KNOWN + int(x) % 16) for x in h] and lm_score._slots(known[:0]) == []


def test_lm_rows_are_added_up_by_key():
    rng = np.random.default_rng(4)
    values = rng.normal(size=(9000, lm_score.HIDDEN)).astype(np.float32)
    for keys in (rng.zipf(1.3, 36_000) % 5000, np.full(9000, 7), np.arange(9000)[::-1], rng.integers(0, 300, 18_000), np.array([3])):
        rows, sums = lm_score._summed(keys.astype(np.uint16), values[: min(len(keys), 9000)])
        plain = np.zeros((9000, lm_score.HIDDEN))
        np.add.at(plain, keys, values[np.arange(len(keys)) % min(len(keys), 9000)].astype(float))
        assert sorted(rows.tolist()) == np.unique(keys).tolist() and np.allclose(sums, plain[rows], atol=2e-3, rtol=1e-4)


@pytest.mark.parametrize("scale", [1, 30])  # with the greater weights logits leave the range that needs no shift
def test_lm_gradients_equal_plain_softmaxes(scale):
    rng, L = np.random.default_rng(8), lm_score
    draw = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1])).astype(np.float32)
    vocab = {"classes": draw(L.FREQUENT + L.CLASSES), "members": draw(L.CLASSES, L.MEMBERS), "parts": draw(L.BUCKETS, L.FINE)}
    net = {k: v * np.float32(scale if k != "tables" else 1) for k, v in L.start(vocab).items()}
    net["third"] = rng.normal(0, 0.3, net["third"].shape).astype(np.float32)
    # Frequent and known words, hashed ones, and one class of more than SLICE places.
    sym = np.r_[rng.integers(0, L.KNOWN + L.BUCKETS * L.FINE, 700), rng.integers(0, L.KNOWN, 500), np.full(L.SLICE + 90, L.FREQUENT + 5)]
    blocks = L._Paths(sym).blocks
    classes = [k for _, _, runs in blocks for k, _, _ in runs]
    assert len(classes) == len(set(classes)) and [x for x, _, _ in blocks] == [0, *(y for _, y, _ in blocks)][:-1]
    ctx = rng.integers(0, 60, (len(sym), 2 * L.SIDE)).astype(np.uint16)
    want = {k: np.zeros(v.shape) for k, v in net.items()}
    for c, s in zip(ctx, sym):
        h = np.r_[np.tanh(sum(net["tables"][d][k].astype(float) for d, k in enumerate(c)) + net["inner"]), 1.0]
        leaf, part = (int(x) for x in L.leaves(np.array(s)))
        first, member = (int(x) for x in L.place_of(np.array(leaf)))
        back = np.zeros(L.HIDDEN + 1)
        levels = [("layer", (), net["layer"], 0, first)]
        levels += [("second", first - L.FREQUENT, net["second"][first - L.FREQUENT], 0, member)] if leaf >= L.FREQUENT else []
        levels += [("third", (), np.r_[net["third"], vocab["parts"][leaf - L.KNOWN][None]], 1, part)] if leaf >= L.KNOWN else []
        for name, at, w, fixed, target in levels:
            z = h @ w.astype(float)
            g = np.exp(z - z.max())
            g /= g.sum()
            g[target] -= 1
            want[name][at] += np.outer(h, g)[: len(h) - fixed]
            back += w.astype(float) @ g
        back = back[:-1] * (1 - h[:-1] ** 2)
        want["inner"] += back
        for d, k in enumerate(c):
            want["tables"][d, k] += back
    trainer = L.Trainer(net, vocab)
    trainer.step(ctx, sym)
    for name, g in want.items():
        assert np.allclose(np.sqrt(np.maximum(trainer.sums[name] - 1e-6, 0)), np.abs(g / len(sym)), rtol=2e-3, atol=2e-5 * scale), name


def test_lm_counts_the_reach_of_its_weights_seldom(monkeypatch):
    counted, plain = [], lm_score._reach
    monkeypatch.setattr(lm_score, "_reach", lambda w: counted.append(w.shape) or plain(w))
    rng = np.random.default_rng(5)
    vocab = {"classes": np.zeros(lm_score.FREQUENT + lm_score.CLASSES, np.float32), "members": np.zeros((lm_score.CLASSES, lm_score.MEMBERS), np.float32), "parts": np.zeros((lm_score.BUCKETS, lm_score.FINE), np.float32)}
    trainer = lm_score.Trainer(lm_score.start(vocab), vocab)
    for _ in range(30):
        before = {k: plain(trainer.net[k]).max() for k in ("layer", "second", "third")}
        trainer.step(rng.integers(0, 50, (64, 4)).astype(np.uint16), rng.integers(0, lm_score.KNOWN + 9000, 64))
        assert all(trainer.bounds[k] > before[k] - 1e-4 for k in before)
    assert len(counted) <= 3 * 4


def test_lm_odd_rows(spark):
    rows = lm_score.score(clashing(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    assert {r.doc_id for r in rows if r.mean_score is None} == {1, 2, 3, 4} and all(r.score <= 0 for r in rows)
    assert next(r.n_words for r in rows if r.doc_id == 5) == 30_000
    assert lm_score.score(spark.createDataFrame([], DOCS)).count() == 0


def test_lm_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_WORDS", 4000)
    rows = [(i, " ".join(words(40, i % 170))) for i in range(300)] + [(7, "a row that repeats")] * 400 + [(None, "no id here")] * 3
    docs = spark.createDataFrame(rows, DOCS)
    one = sorted(((r.doc_id or -1), r.n_words, r.score) for r in lm_score.score(docs.coalesce(1)).collect())
    other = sorted(((r.doc_id or -1), r.n_words, r.score) for r in lm_score.score(docs.orderBy(F.desc("doc_id")).repartition(7)).collect())
    assert len(one) == len(rows) and np.allclose(np.array(one), np.array(other), rtol=1e-6) and lm_score.shards_of(14_000) == 4


def test_lm_masks_every_place_once():
    texts = ["one two three", "four", " ".join(words(500, 4))]
    sym, _, doc, place = lm_score.contexts(lm_score.encode(texts, np.zeros(0, np.uint64)))
    turns = [lm_score.masked(sym, place, turn) for turn in range(lm_score.ROUNDS)]
    assert sorted(np.concatenate(turns)) == list(range(504)) and min(map(len, turns)) > 200
    # Where a document lies in a batch makes no difference.
    alone = lm_score.contexts(lm_score.encode(texts[2:], np.zeros(0, np.uint64)))
    assert (lm_score.masked(alone[0], alone[3], 0) + 4).tolist() == [k for k in turns[0] if doc[k] == 2]


def test_lm_predicts_words_beyond_the_most_frequent_from_context(spark):
    # 400 pairs of words, all alike frequent and most of them beyond the first level: only the partner tells which word follows.
    rng = np.random.default_rng(6)
    pairs = [(f"left{k}", f"right{k}") for k in range(400)]
    texts = [" ".join(" ".join(pairs[k]) for k in rng.integers(0, 400, 20)) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)
    vocab, _ = lm_score.vocabulary(docs)
    net = lm_score.train(_encoded(spark, texts, vocab), vocab, 1)
    score = lambda t: lm_score.log_probabilities(lm_score.encode(t, vocab["frequent"]), net, vocab)
    right, wrong = [f"{a} {b}" for a, b in pairs], [f"{a} {pairs[k - 1][1]}" for k, (a, _) in enumerate(pairs)]
    rare = [k for k, (a, b) in enumerate(pairs) if min(np.frombuffer(lm_score.encode([f"{a} {b}"], vocab["frequent"])[0], np.uint32)) >= lm_score.FREQUENT]
    gain = (score(right) - score(wrong))[rare]
    assert len(rare) > 250 and (gain > 0).mean() > 0.9
    # A nonsense word is less likely than any of the corpus in its place.
    assert score(["left7 zzgrmpf"])[0] < score(["left7 right7"])[0] - 2


def test_lm_levels_sum_to_one():
    rng = np.random.default_rng(1)
    draw = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1])).astype(np.float32)
    vocab = {"classes": draw(lm_score.FREQUENT + lm_score.CLASSES), "members": draw(lm_score.CLASSES, lm_score.MEMBERS), "parts": draw(lm_score.BUCKETS, lm_score.FINE)}
    net = lm_score.start(vocab)
    net["third"] = rng.normal(0, 0.3, net["third"].shape).astype(np.float32)
    every = np.arange(lm_score.KNOWN + lm_score.BUCKETS * lm_score.FINE)
    total = sum(np.exp(lm_score.word_scores(net, vocab, np.tile([[3, 500, 9000, 12]], (len(s), 1)), s)).sum() for s in np.array_split(every, 40))
    assert abs(total - 1) < 1e-3
