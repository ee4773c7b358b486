from collections import Counter

import pytest
from pyspark.sql import functions as F

from cases import DOCS, documents, words
from sluice.llm import near_dup


def brute(rows, n=5, threshold=0.8):
    """{row index: (class members, links)} by comparing all pairs."""
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    near = {i: {j for j in range(len(rows)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])} for i in range(len(rows))}
    seen, group = set(), {}
    for i in near:
        if i in seen:
            continue
        stack, members = [i], set()
        while stack:
            u = stack.pop()
            if u not in members:
                members.add(u)
                stack += near[u]
        seen |= members
        for m in members:
            group[m] = members
    return near, group


def check(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    near, group = brute(rows)
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[m][0] for m in group[i] if rows[m][0] is not None]
        want[r[0], min(ids) if ids else None, len(near[i])] += 1
    got = near_dup.ngram_jaccard_join(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    return got


def test_equals_brute_force(spark):
    check(spark, documents())


def test_generated_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = check(spark, rows)
    kept = [r for r in got if r.keep_first]
    assert len(kept) == len({r.class_id for r in got})


def chain(n):
    """Near copies in a row: each differs from the next a little, and from far ones wholly."""
    return [(i, " ".join(f"w{k}" for k in range(6 * i, 6 * i + 120)), None, None, None) for i in range(n)]


@pytest.mark.parametrize("tile", [7, 2])
def test_small_tiles_give_the_same(spark, monkeypatch, tile):
    """A large cluster of different texts is compared tile by tile, or bucket by bucket."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 3 * i], f"x{i}", *base[3 * i + 1 :]]), None, None, None) for i in range(60)]
    rows += [(1000 + r[0], *r[1:]) for r in chain(70)]
    monkeypatch.setattr(near_dup, "TILE_SETS", tile)
    check(spark, rows)


def test_tiles_of_a_long_chain_grow_with_its_length(spark, monkeypatch):
    """Sets of a chain share buckets with few others, so what is compared is linear."""
    monkeypatch.setattr(near_dup, "TILE_SETS", 4)
    counts = []
    for n in (150, 300):
        rows = spark.range(n).select(
            F.col("id").alias("sid"), F.col("id").cast("string").cast("binary").alias("set_key"), F.lit(1).cast("long").alias("size"), F.lit(100).cast("long").alias("n_grams"), F.col("id").alias("first_id"),
            F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: ((F.col("id") + k % 3) / 3).cast("long") * 100 + k).alias("bands"), F.lit(0).cast("long").alias("root"))
        counts.append(near_dup.tiles_of(rows, 24).count())
    assert counts[1] <= 2.1 * counts[0] and counts[0] <= 150 * 24


def test_generated_table_of_a_thousand_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], DOCS)
    assert near_dup.ngram_jaccard_join(docs).count() == 0
    extra = spark.createDataFrame(documents()[:10], DOCS).withColumn("bands", F.lit(1)).withColumn("set_key", F.lit(2)).withColumn("_row", F.lit(3))
    assert near_dup.ngram_jaccard_join(extra).count() == 10


def test_band_choice_reaches_recall():
    b, r = near_dup.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 128


def test_links_do_not_depend_on_the_size_of_a_cluster(spark, monkeypatch):
    """The same pairs are linked whether a cluster is compared whole or bucket by bucket; with few bands, many pairs share none."""
    docs = spark.createDataFrame(chain(60) + documents(3), DOCS)
    run = lambda: sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in near_dup.ngram_jaccard_join(docs, threshold=0.5, recall=0.4).collect())
    whole = run()
    monkeypatch.setattr(near_dup, "TILE_SETS", 2)
    assert run() == whole and any(n for _, _, n in whole)
