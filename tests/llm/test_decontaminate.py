import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cases import DOCS, documents, prose, words
from sluice.llm import decontaminate as D


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item) if item is not None else "null")
    out = Counter()
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    found |= own
        out[r[0], len(w), len(hit), tuple(sorted(found))] += 1
    return out


def planted():
    import random

    rng = random.Random(9)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(10, "Short item HERE"), (11, ""), (12, None), (13, "!!"), (2, prose(rng, 12)), (None, prose(rng, 15))]
    rows = documents()
    rows += [(500 + i, f"{prose(rng, 20)} {' '.join(words(items[i][1])[5:20]).upper()} -- {prose(rng, 9)}", None, None, None) for i in range(4)]
    rows += [(600, "x short... item, here short item here", None, None, None), (601, items[0][1] + " " + items[1][1], None, None, None), (602, " ".join(words(items[3][1])[:9]), None, None, None), (603, items[-1][1] * 2, None, None, None)]
    return rows, items


@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_equals_brute_force(spark, limit):
    rows, items = planted()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(docs, bench, carry=("doc_id", "text"), block_bytes=limit).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute(rows, items)
    # Spans are where the words are.
    text = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        if r.doc_id is not None:
            assert sum(len(words(text[r.doc_id][s.start : s.end].decode())) for s in r.spans) == r.n_hit


def test_removal_of_documents_and_spans(spark):
    rows, items = planted()
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)).withColumn("n_hit", F.lit(5))
    bench = spark.createDataFrame(items, "item_id long, text string")
    dirty = {k[0] for k in brute(rows, items) if k[2]}
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in dirty)
    cut = D.decontaminate(docs, bench, "spans").collect()
    assert next(r.text for r in cut if r.doc_id == 600) == "x "  # two windows side by side are one span
    hits = brute(rows, items)
    clean = Counter((r[0], r[1]) for r in rows if not any(k[2] for k in hits if k[0] == r[0] and k[1] == len(words(r[1]))))
    assert not clean - Counter((r.doc_id, r.text) for r in cut)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(documents()[:5], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, bench).count() == 5
    assert D.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(planted()[1], "item_id long, text string")).count() == 0


def test_empty_item_list_hashes_as_empty_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_several_blocks_give_the_spans_of_one(spark):
    """Windows that adjoin or overlap, of items in different blocks, make one span."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "none of them"), (3, None), (4, "x, " + " - ".join(words[5:35]) + "!"), (5, " ".join(words[:12]))], "doc_id long, text string")
    items = [(i, " ".join(words[a:b])) for i, (a, b) in enumerate([(0, 10), (10, 20), (15, 27), (40, 50), (58, 60), (20, 30)])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.n_words, r.n_hit, tuple(map(tuple, r.spans)), tuple(r.items)) for r in rows)
    one, many = (key(D.contamination(docs, bench, block_bytes=limit).collect()) for limit in (1 << 20, 40))
    assert one == many and one[0][2] > 30


def test_a_long_item_goes_in_ranges(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(4000)}" for _ in range(900))
    words_ = text.split()
    docs = spark.createDataFrame([(i, " ".join(words_[a : a + 40])) for i, a in enumerate(range(0, 860, 23))] + [(99, " ".join(words_[5:14])), (100, None)], "doc_id long, text string")
    items = spark.createDataFrame([("long", text), ("short", "w1 w2"), ("none", None)], "item_id string, text string")
    run = lambda limit: sorted((r.doc_id, r.n_words, r.n_hit, str(r.spans), r["items"]) for r in D.contamination(docs, items, block_bytes=limit).collect())
    assert run(200) == run(1 << 20) and sum(r[2] > 0 for r in run(200)) == 38
