import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import DOCS, documents, words
from sluice.llm import common, langid, quality, toxicity

DATA = "/root/testdata/sf0.01"


def fold(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_folds_follow_the_id(spark):
    df = spark.range(50).select("id", common.held_out(F.col("id"), 5, 0).alias("h"))
    assert {r.id: r.h for r in df.collect()} == {i: fold(i, 5) == 0 for i in range(50)}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_quality_on_held_out_documents(spark, labels):
    rows = quality.op4_quality(spark, DATA).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    held = [(r.score, labels[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(held) > 0.9
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.9


def test_toxicity_on_held_out_documents(spark, labels):
    rows = toxicity.op7_toxicity(spark, DATA).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.9
    assert all(fold(e.doc_id, 5) != 0 for r in rows for e in r.evidence)


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = langid.op9_language_id(spark, DATA).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean(held) > 0.98


def test_sample_is_bounded_in_bytes(spark):
    sample = spark.createDataFrame([(i, i % 2, "x" * (10 * i)) for i in range(40)], "doc_id long, label int, text string")
    assert quality.within_bytes(sample, 10_000).count() == 40
    got = quality.within_bytes(sample, 3000).collect()
    size = sum(len(r.text) for r in got)
    assert 3000 - 390 < size <= 3000 and got == quality.within_bytes(sample, 3000).collect()


def test_a_very_long_text_takes_no_place_from_others(spark):
    long = [(-i, i % 2, "y" * 5000) for i in range(1, 9)]
    sample = spark.createDataFrame([*long, *((i, i % 2, "x" * 100) for i in range(20))], "doc_id long, label int, text string")
    got = quality.within_bytes(sample, 7000).collect()
    assert sorted(r.doc_id for r in got) == list(range(20))
    # Of a label that has long texts only, the shortest that the bound allows.
    only = spark.createDataFrame([(1, 0, "x" * 9000), (2, 0, "x" * 3000), (3, 1, "x")], "doc_id long, label int, text string")
    assert sorted(r.doc_id for r in quality.within_bytes(only, 7000).collect()) == [2, 3]


def test_gradient_equals_differences():
    """Every kind of weight, against the change of the loss when it is moved a little."""
    rng = np.random.default_rng(4)
    net = {k: v.astype(np.float64) + 0.01 * rng.normal(size=v.shape) for k, v in quality.init(3).items()}
    text = np.frombuffer("a text with some wörds, twice over: a text with some wörds".encode(), np.uint8)

    def loss(net):
        p = 1 / (1 + np.exp(-quality.head(net, quality.pool(net, text)[0])))
        return -0.7 * np.log(p)

    g = {k: np.zeros_like(v) for k, v in net.items()}
    quality.add_gradient(g, net, text, 1.0, 0.7)
    for k, own in g.items():
        flat = own.reshape(-1)
        for at in [*np.argsort(-np.abs(flat))[:6].tolist(), int(np.argmin(np.abs(flat)))]:
            moved = []
            for step in (1e-3, -1e-3):
                other = {n: v.copy() for n, v in net.items()}
                other[k].reshape(-1)[at] += step
                moved.append(loss(other))
            assert abs((moved[0] - moved[1]) / 2e-3 - flat[at]) < 0.02 * max(abs(flat[at]), np.abs(flat).max()) + 1e-4, (k, at)


def test_more_than_two_hundred_languages(spark, monkeypatch):
    """Each language has letters of its own; a family's classifier learns from a share of the others only."""
    monkeypatch.setattr(langid, "REST", 24)
    rows = [(i, f"l{i % 205:03d}", " ".join(chr(0x4E00 + 97 * (i % 205)) * 2 + chr(0x4E01 + 97 * (i % 205)) for _ in range(5 + i // 205))) for i in range(410)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs)
    assert len(model["langs"]) == 205 and len(model["svm"]) == 205
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i] == lang for i, lang, _ in rows]) > 0.95


def test_network_scores_alone_as_together():
    rng = random.Random(1)
    texts = [b"", b"x", b"abc" * 7, bytes(rng.randrange(256) for _ in range(5000)), "é日本".encode() * 100, b"y" * 300_000, b"last"]
    net = quality.init()
    off = np.cumsum([0, *(len(t) for t in texts)])
    got = quality.score_texts(net, np.frombuffer(b"".join(texts), np.uint8), off)
    for t, s in zip(texts, got):
        best = np.full(quality.FILTERS, -np.inf)
        b = quality.blocks_of(np.frombuffer(t, np.uint8))
        for k in range(len(b) - quality.BLOCKS + 1):
            best = np.maximum(best, net["embed"][b[k : k + quality.BLOCKS]].reshape(-1) @ net["filters"])
        assert abs(s - 1 / (1 + np.exp(-quality.head(net, best)))) < 1e-4


def test_network_gradient_moves_the_loss_down():
    texts = [b"good plain text " * 5] * 8 + [b"bad&&& $$$ text " * 5] * 8
    net = quality.fit(texts, np.array([1] * 8 + [0] * 8), 0.5)
    off = np.cumsum([0, *(len(t) for t in texts)])
    s = quality.score_texts(net, np.frombuffer(b"".join(texts), np.uint8), off)
    assert s[:8].min() > 0.8 and s[8:].max() < 0.2


def index(seed=0, n=1500, terms=40):
    rng = np.random.default_rng(seed)
    keep = np.sort(rng.integers(0, 1 << 63, terms, dtype=np.uint64))
    rows = []
    for i in range(n):
        at = np.sort(rng.choice(terms, rng.integers(0, 6), replace=False))
        rows.append((i, int(rng.random() < 0.4), at, rng.integers(1, 5, len(at)).astype(float)))
    return toxicity.BlockMaxIndex(keep, 1 + rng.random(terms), rows, {0: 1.0, 1: 0.5}), rng


@pytest.mark.parametrize("seed", range(5))
def test_block_max_search_is_exact(seed):
    idx, rng = index(seed)
    for _ in range(60):
        at = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        q = idx.query(at, rng.integers(1, 4, len(at)).astype(float))
        near, cos = idx.search(at, q)
        every = q @ idx.matrix[at]
        order = [i for i in np.lexsort((np.arange(len(every)), -every)) if every[i] > 0][: toxicity.NEIGHBOURS]
        assert np.allclose(cos, every[order], atol=1e-5)
        assert np.allclose(sorted(every[near]), sorted(every[order]), atol=1e-5)


def test_every_word_of_the_examples_is_indexed(spark):
    common_words = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"{common_words} bad{i % 3}" if i % 2 else f"{common_words} only{i}") for i in range(40)] + [(90, "only6 new"), (91, "w7"), (92, "new")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    idx = toxicity.train(docs, labels)
    assert len(idx.keep) == 300 + 3 + 20 and (idx.idf > 0).all()
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, idx).collect()}
    assert [e.doc_id for e in got[90].evidence] == [6] and len(got[91].evidence) == toxicity.NEIGHBOURS
    assert got[92].evidence == [] and got[92].score == idx.without


def test_neighbours_are_the_nearest_over_all_words(spark, labels):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    idx = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    text = {r.doc_id: Counter(words(r.text)) for r in docs.collect()}
    own = {i: text[i] for i, r in labels.items() if r.toxic is not None and text[i]}
    df, toxic = Counter(w for t in own.values() for w in t), Counter(w for i, t in own.items() if labels[i].toxic for w in t)
    total = [r.toxic for r in labels.values() if r.toxic is not None]
    names = sorted(df)
    value, unseen = toxicity.term_weights(np.array([df[w] for w in names]), np.array([toxic[w] for w in names]), sum(total), len(total) - sum(total))
    value = dict(zip(names, value))

    def unit(t):
        v = {w: (1 + np.log(n)) * value.get(w, unseen) for w, n in t.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    units = {i: unit(t) for i, t in own.items()}
    assert len(idx.keep) == len(names)
    for r in toxicity.score_toxicity(docs.where("doc_id % 50 = 7"), idx).collect():
        q = unit(text[r.doc_id])
        every = sorted((sum(x * u.get(w, 0) for w, x in q.items()) for u in units.values()), reverse=True)
        assert np.allclose([e.cosine for e in r.evidence], [c for c in every if c > 0][: toxicity.NEIGHBOURS], atol=1e-5)


def test_calibration_rises():
    idx, _ = index(3)
    idx.calibrate()
    s = [idx.score(v) for v in np.linspace(0, 1, 50)]
    assert all(a <= b + 1e-12 for a, b in zip(s, s[1:])) and 0 <= s[0] <= s[-1] <= 1


def plain_decision(model, x):
    """Language and score of one vector, classifier by classifier."""

    def sure(task):
        w, b, s = model["svm"][task]
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, (float(x @ w) + b) * s))))

    families = model["families"]
    share = {f: sure(f"family:{f}") if len(families) > 1 else 1.0 for f in families}
    total = sum(share.values())
    best = max(families, key=lambda f: share[f])
    own = families[best]
    wins, odds = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            q = sure(f"pair:{a}:{b}")
            wins[a if q > 0.5 else b] += 1
            odds[a] += q
            odds[b] += 1 - q
    pick = max(own, key=lambda c: wins[c] + odds[c] / len(own))
    return pick, share[best] / total * (odds[pick] / (len(own) - 1) if len(own) > 1 else 1)


@pytest.mark.parametrize("families", [{"a": ["x"]}, {"a": ["x", "y", "z"]}, {"a": ["x", "y", "z"], "b": ["u"], "c": ["v", "w"]}])
def test_decision_equals_a_plain_loop(families):
    rng = np.random.default_rng(3)
    tasks = [f"family:{f}" for f in families] if len(families) > 1 else []
    tasks += [f"pair:{a}:{b}" for own in families.values() for i, a in enumerate(own) for b in own[i + 1 :]]
    model = {"langs": sorted(sum(families.values(), [])), "families": families, "svm": {k: (rng.normal(size=16).astype(np.float32), float(rng.normal()), 1.5) for k in tasks}}
    x = rng.normal(size=(60, 16)).astype(np.float32)
    langs, scores = langid.decide(model, x)
    for k in range(60):
        lang, score = plain_decision(model, x[k])
        assert langs[k] == lang and abs(scores[k] - score) < 1e-4


def test_svm_separates_and_uses_both_classes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 10)).astype(np.float32)
    y = np.where(x[:, 3] > 0.8, 1.0, -1.0)
    w, b, s = langid.train_svm(x, y)
    assert np.mean(np.sign(x @ w + b) == y) > 0.95 and s > 0


def test_languages_without_family_and_single_language(spark):
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("zzz qqq xxx", "tlh")] * 8)]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got)
    one = docs.where("lang = 'en'")
    assert {r.lang_pred for r in langid.identify(docs, langid.train(one)).collect()} == {"en"}


def test_awkward_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(documents(), DOCS).withColumn("score", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("evidence", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (none, few):
        assert quality.score_quality(docs, quality.train(docs, lab)).count() == len(documents())
        assert toxicity.score_toxicity(docs, toxicity.train(docs, lab)).count() == len(documents())
    out = quality.drop_rejected(docs, None)
    assert out.columns == docs.columns and out.count() == len(documents())
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    text = {r[0]: r[1] for r in documents()}
    assert all((r.lang_pred == "und" and r.score == 0) == (not any(c.isalpha() for c in text[i] or "")) for i, r in got.items() if i is not None)
    empty = spark.createDataFrame([], DOCS)
    assert quality.score_quality(empty, quality.init()).count() == 0
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.train(empty, few)).count() == 0


def test_postings_have_the_largest_weight_of_each_block():
    idx, _ = index(1)
    cube = idx.matrix.reshape(len(idx.keep), -1, toxicity.BLOCK)
    most = np.zeros(cube.shape[:2], np.float32)
    for t in range(len(idx.keep)):
        most[t, idx.block[idx.first[t] : idx.first[t + 1]]] = idx.most[idx.first[t] : idx.first[t + 1]]
    assert np.array_equal(most, cube.max(2)) and len(idx.example) == np.count_nonzero(cube)
