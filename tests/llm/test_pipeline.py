from collections import Counter

import corpus_pipeline
from cases import DOCS, documents, low, words
from test_near_dup import brute

DATA = "/root/testdata/sf0.001"


def test_stages_on_their_own_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dup", "decontaminate", "packing"]
    before, frame = docs.collect(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, DATA).write.parquet(f"file://{tmp_path}/{name}")
        frame = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert frame.columns == docs.columns
        after = frame.collect()
        assert Counter(after) <= Counter(before)
        if name == "exact_dedup":
            assert sorted(low(r.text) for r in after) == sorted({low(r.text) for r in before})
        if name == "near_dup":
            near, group = brute([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {min(before[m].doc_id for m in g) for g in group.values()}
        if name == "decontaminate":
            windows = {tuple(w[i : i + 10]) for w in map(words, bench) for i in range(max(1, len(w) - 9)) if w}
            sizes = {len(w) for w in windows}
            dirty = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
            assert {r.doc_id for r in after} == {r.doc_id for r in before if not dirty(words(r.text))}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before}


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    frame = spark.createDataFrame(documents(), DOCS)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, DATA).write.parquet(f"file://{tmp_path}/{name}")
        frame = spark.read.parquet(f"file://{tmp_path}/{name}")
    assert frame.count() > 0


def test_without_labels_and_benchmark(spark, tmp_path):
    """Nothing is rejected and nothing is dirty, so what is left follows from copies alone."""
    sf = f"file://{tmp_path}"
    rows = documents()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    distinct = {}
    for r in rows:
        distinct[low(r[1])] = max(distinct.get(low(r[1]), -1), -1 if r[0] is None else r[0])
    once = [(i if i >= 0 else None, t) for t, i in distinct.items()]
    _, group = brute(once)
    classes = {min(g) for g in group.values()}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert len({(r.doc_id, r.ids_crc32) for r in packed if r.start + r.length and r.piece == 0}) == len(classes)


def test_the_quality_stage_keeps_what_the_query_accepts(spark):
    """The first stage against the operator's own scores, row by row; the last against the ids of every text."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    from sluice.llm import packing, quality

    want = {r.doc_id for r in quality.op4_quality(spark, DATA).collect() if r.predicted == 1}
    kept = corpus_pipeline.quality_stage(spark, docs, DATA)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    import public_tokenizers

    path, got = public_tokenizers.path("byte_bpe_50k.json"), {}
    for r in corpus_pipeline.packing_stage(spark, docs, DATA).orderBy("doc_id", "piece").collect():
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert got == {r.doc_id: packing.encode(path, r.text or "").astype("<u4").tobytes() + bytes(4) for r in docs.collect()}
