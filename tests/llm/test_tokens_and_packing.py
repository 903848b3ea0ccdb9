import base64
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tests.llm.common import DOCS, clashing, odd_rows
from vellumry.llm import arrow_out, packing, token_count
from vellumry.llm.common import shared_dir


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_count.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=token_count.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return token_count.Encoder(token_count.merges(token_count.load()))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_tokenizer(known, encoder, text):
    text = text.encode("utf-8", "replace").decode()
    ids, n = encoder.ids([text])
    assert ids.tolist() == known.encode_ordinary(text) and n[0] == len(ids) == encoder.counts([text])[0]


def test_counts_over_a_table(spark, known):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: len(known.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_count.count(docs).collect()} == want


def test_counts_of_odd_rows(spark, known):
    got = sorted(((r.doc_id or -1), r.n_tokens) for r in token_count.count(clashing(spark, odd_rows())).collect())
    assert got == sorted(((i or -1), len(known.encode_ordinary(t or ""))) for i, t in odd_rows())
    assert token_count.count(spark.createDataFrame([], DOCS)).count() == 0


def _least_padding(lengths, counts, buckets):
    best = {0: 0}  # boundary index -> padded size
    m = len(lengths)
    for _ in range(min(buckets, m)):
        nxt = {}
        for i, c in best.items():
            for j in range(i + 1, m + 1):
                v = c + int(lengths[j - 1]) * int(sum(counts[i:j]))
                if v < nxt.get(j, 1 << 62):
                    nxt[j] = v
        best = nxt | ({m: best[m]} if m in best and best[m] <= nxt.get(m, 1 << 62) else {})
    return best[m]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 200), st.integers(1, 50), min_size=1, max_size=14), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, buckets):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[k] for k in lengths.tolist()])
    cut = packing.boundaries(lengths, counts, buckets)
    padded = sum(int(c) * min(b for b in cut if b >= n) for n, c in zip(lengths.tolist(), counts))
    assert len(cut) <= buckets and padded == _least_padding(lengths, counts, buckets)


def test_packing_fills_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, 4, 2048).collect()
    assert len(rows) == docs.count()
    by: dict = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        by.setdefault((r.bucket, r.batch), []).append(r)
    last = {b: max(k for x, k in by if x == b) for b, _ in by}
    for (b, k), own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) * own[0].bucket_len <= 2048 or len(own) == 1
        assert k == last[b] or len(own) == max(1, 2048 // own[0].bucket_len)


def test_packing_odd_rows(spark):
    rows = packing.pack(clashing(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows()) and len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_of_sparse_repeated_and_missing_ids(spark):
    # Ids far apart, a third of all rows alike in all, and null ids: ranks are exact, as a sort of all rows gives them.
    rows = [(i * 1_000_003_777 - 10**12, " ".join(["w"] * (1 + i % 37))) for i in range(3000)] + [(7, "one two three")] * 2000 + [(None, "a b")] * 500
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = packing.pack(docs, 5, 256).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.bucket, []).append(r)
    for own in by.values():
        size = max(1, 256 // own[0].bucket_len)
        own.sort(key=lambda r: (r.batch, r.slot))
        assert [(r.batch, r.slot) for r in own] == [(k // size, k % size) for k in range(len(own))]
        order = [(r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in own]
        assert order == sorted(order)


def test_packing_by_another_count(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "abc"), (2, "a b c d"), (3, None)], DOCS)
    rows = packing.pack(docs, tokens=lambda t: F.coalesce(F.length(t), F.lit(1))).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {1: 3, 2: 7, 3: 1}


def test_arrow_files_are_written_once_and_whole(spark):
    import os

    docs = spark.createDataFrame([(i, "some words to write") for i in range(100)], DOCS).repartition(4)
    path = shared_dir(spark, "t")
    index = arrow_out.write(docs, path, length=16, rows=8)
    files = {f: os.stat(f"{path[7:]}/{f}").st_mtime_ns for f in os.listdir(path[7:])}
    assert len(files) == 4 and len(index.limit(3).collect()) == 3 and index.count() == 100
    assert files == {f: os.stat(f"{path[7:]}/{f}").st_mtime_ns for f in os.listdir(path[7:])}


def test_arrow_files_round_trip(spark, known):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = shared_dir(spark, "t")
    index = arrow_out.write(docs, path, length=64, rows=32).collect()
    files = {f: arrow_out.Sequences(f"{path[7:]}/{f}") for f in {r.file for r in index}}
    assert sum(map(len, files.values())) == len(index)
    text = {r.doc_id: known.encode_ordinary(r.text) for r in docs.collect()}
    got: dict = {}
    for r in sorted(index, key=lambda r: (r.doc_id, r.part)):
        ids, mask = files[r.file][r.batch * 32 + r.row]
        assert len(ids) == 64 == len(mask) and zlib.crc32(ids.tobytes()) == r.crc32 and not ids.flags.owndata
        assert sum(mask.to_pylist()) == r.n_tokens
        got.setdefault(r.doc_id, []).extend(ids[: r.n_tokens].tolist())
    for i, ids in text.items():
        if ids:
            assert [x for x in got[i] if x != arrow_out.END] == ids


def test_arrow_odd_rows(spark):
    index = arrow_out.write(clashing(spark, odd_rows()), shared_dir(spark, "t")).collect()
    assert {r.doc_id for r in index} == {None, 3, 4, 5, 6, 7, 8}
    assert arrow_out.write(spark.createDataFrame([], DOCS), shared_dir(spark, "t")).count() == 0
