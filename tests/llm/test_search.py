import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sluice.llm import search

WORD = re.compile(search.TERM)


def terms_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    """Every document against every item."""
    tfs = [(i, Counter(terms_of(t))) for i, t in docs]
    full = [(i, c, sum(c.values())) for i, c in tfs if c]
    n_docs, total = len(full), sum(n for _, _, n in full)
    df = Counter(t for _, c, _ in full for t in c)
    own = {}
    for item, text in items:
        own.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in own.items():
        found = []
        for i, c, n in full:
            m = 100 - 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def run(spark, docs, items, k=50, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in search.search(d, q, k, **more).collect())


def corpus(rng, n, words=300):
    vocab = [f"w{i}" for i in range(words)] + ["Ünï", "中文", "x" * 40, "x" * 39 + "y"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    return [" ".join(rng.choices(vocab, weights, k=rng.randint(0, 80))) for _ in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(2)
    docs = list(enumerate(corpus(rng, 900)))
    items = [(i, t) for i, t in enumerate(corpus(rng, 25))]
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


def test_many_shards_and_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    docs = list(enumerate(corpus(rng, 400)))
    items = [(i, t) for i, t in enumerate(corpus(rng, 12))]
    monkeypatch.setattr(search, "SHARD_POSTINGS", 200)
    monkeypatch.setattr(search, "FIRST_RUN", 3)
    assert run(spark, docs, items, 5, block_bytes=600) == brute(docs, items, 5)


def test_odd_rows(spark):
    docs = [(None, "a b"), (None, "a b"), (5, None), (6, ""), (7, "A, b! c"), (7, "A, b! c"), (8, "!?"), (9, "z " * 30000 + "a"), (10, "d é"), (3, "a b")]
    items = [(1, "A a b"), (1, "c"), (None, "z"), (2, None), (3, ""), (4, "q"), (5, "É é")]
    assert run(spark, docs, items, 3) == brute(docs, items, 3)
    assert run(spark, docs, items) == brute(docs, items, 50)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == Counter()


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "x", 0)], "doc_id long, text string, score long, item_id string, term int")
    items = spark.createDataFrame([("i", "a", 3, 4)], "item_id string, text string, doc_id long, rank int")
    assert [(r.item_id, r.rank, r.doc_id) for r in search.search(docs, items).collect()] == [("i", 1, 1)]
    docs = docs.unionByName(docs.withColumn("text", docs.text.substr(3, 1)).withColumn("doc_id", docs.doc_id + 1))
    assert [(r.item_id, r.rank, r.doc_id) for r in search.search(docs, items).collect()] == [("i", 1, 1)]


def test_pivots_skip_what_cannot_win():
    """Documents of weak terms alone are never scored once the heap is full of better ones."""
    n = 20000
    rows = np.r_[np.arange(60), np.arange(n)]
    numbers = np.r_[np.zeros(60, np.int64), np.ones(n, np.int64)]
    shard = search.Shard(np.full(n, 10), rows, numbers, np.ones(len(rows), np.int64), np.array([9000, 1]), n, 10 * n)
    seen = []
    held, search._held = search._held, lambda docs, wanted: seen.append(len(wanted)) or held(docs, wanted)
    try:
        docs, scores = shard.top([0, 1], 50)
    finally:
        search._held = held
    assert docs.tolist() == list(range(50)) and len(set(scores.tolist())) == 1 and sum(seen) < 2000


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = search.op11_search(spark, f"/root/testdata/{sf}")
    want = con.sql(search.OP11_SQL)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
