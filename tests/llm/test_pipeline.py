import corpus_pipeline
from tests.conftest import SF
from tests.llm.common import clashing, odd_rows, words
from vellumry.llm import toxicity
from vellumry.llm.common import materialize, table


def test_stages_keep_columns_and_take_effect(spark):
    docs = first = table(spark, SF, "documents")
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"t-{name}")
        assert docs.columns == first.columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    bad = [i for i, r in labels.items() if r.toxic == 1 or r.quality == 0]
    assert sum(i in kept for i in bad) <= 0.15 * len(bad)  # few labels to learn from at this size
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == kept


def test_empty_documents_go_through(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def _site(spark, tmp_path, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    # Null ids, null, empty, blank, wordless and very long texts, repeated rows, ties; columns that clash; no labels; a benchmark with odd items.
    passage = " ".join(words(40, 77))
    rows = [*odd_rows(), (20, "before " + passage + " after"), (20, "before " + passage + " after")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, passage), (2, None), (None, passage), (3, "")], "item_id long, text string")
    sf = _site(spark, tmp_path, clashing(spark, rows), labels, bench)
    docs = table(spark, sf, "documents")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, sf), f"odd-{name}")
        assert after.columns == docs.columns
        docs, left[name] = after, sorted((r.doc_id or -1) for r in after.collect())
    assert left["toxicity"] == [-1, 1, 2, 3, 4, 5, 6, 6, 7, 8, 20, 20]  # nothing is learnt, nothing goes
    assert left["quality_classifier"] == [-1, 4, 5, 6, 6, 7, 8, 20, 20]  # null and blank texts go
    assert left["simhash_near_dedup"] == [-1, 4, 5, 6, 8, 20]  # one of each group of copies
    assert left["benchmark_decontamination"] == [-1, 4, 5, 6, 8]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted((r.doc_id or -1) for r in packed) == left["benchmark_decontamination"] and next(r.n_tokens for r in packed if r.doc_id == 5) == 30_000
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=str) == sorted(map(tuple, packed), key=str)


def test_empty_benchmark_and_labels_of_one_kind(spark, tmp_path):
    texts = [" ".join(words(30, 300 + k)) for k in range(12)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    sf = _site(spark, tmp_path, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels, spark.createDataFrame([], "item_id long, text string"))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == list(range(12))
    assert toxicity.train(texts, [0] * 12)["threshold"] == float("inf")
