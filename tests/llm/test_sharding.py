from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cases import DOCS, documents
from sluice.llm import sharding


def check(spark, rows, n_shards, **kw):
    docs = spark.createDataFrame(rows, DOCS)
    out = sharding.shard(docs, n_shards, **kw)
    assert out.columns == [*docs.columns, "size", "shard", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    by = defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 8 and 0 <= r.shard < n_shards
        by[r.shard].append(r)
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    return by, got


def test_shards_are_near_equal_in_bytes(spark):
    rows = [(i, f"{i % 900} " * (1 + i % 7), None, None, None) for i in range(3000)]
    by, got = check(spark, rows, 24)
    sizes = [sum(r.size for r in by[s]) for s in range(24)]
    mean = sum(sizes) / 24
    assert max(abs(x - mean) for x in sizes) <= 0.002 * mean + 2 * max(r.size for r in got)


def test_a_group_of_a_third_is_cut_only_where_it_must(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"text number {i}", None, None, None) for i in range(3000)]
    by, got = check(spark, rows, 8)
    sizes = [sum(r.size for r in by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8 + 60
    held = {r.shard for r in got if r.text == "the same text again"}
    assert len(held) <= 4


def sorted_list_version(rows, n_shards):
    """(h, t) -> shard and the rank in it, from one sorted list: each cut is at the nearer edge of a group of equal texts, or of a row where the group is too large."""
    rows = sorted(rows)
    total, largest = sum(r[2] for r in rows), max(r[2] for r in rows)
    whole = max(sharding.GROUP_TOLERANCE * total / n_shards, largest)

    def edges(key):
        out, at = [(key(rows[0]), 0)], 0
        for k, r in enumerate(rows):
            at += r[2]
            if k + 1 == len(rows) or key(rows[k + 1]) != key(r):
                out.append((key(rows[k + 1]) if k + 1 < len(rows) else (1 << 63, 0), at))
        return out

    cuts = []
    for i in range(1, n_shards):
        want = total * i / n_shards
        for key in (lambda r: (r[0], -(1 << 63)), lambda r: r[:2]):
            e = edges(key)
            k = max(k for k in range(len(e) - 1) if e[k][1] <= want)
            lo, hi = e[k], e[k + 1]
            if hi[1] - lo[1] <= whole or sum(r[0] == lo[0][0] for r in rows) <= 1:
                break
        cuts.append(lo[0] if want - lo[1] <= hi[1] - want else hi[0])
    shards = [sum(r[:2] >= c for c in cuts) for r in rows]
    return {r[:2]: (s, k - shards.index(s)) for k, (r, s) in enumerate(zip(rows, shards, strict=True))}


@pytest.mark.parametrize("n_shards", [3, 24])
def test_shards_and_slots_equal_the_sorted_list_version(spark, n_shards):
    rows = [(i, "hot text " * 3 if i % 3 == 0 else f"{i // 2 % 400} " * (1 + i // 2 % 9), None, None, None) for i in range(1800)]
    docs = spark.createDataFrame(rows, DOCS)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id", F.xxhash64("text")).alias("t"), (F.octet_length("text") + 8).alias("s")).collect()
    want = sorted_list_version([(r.h, r.t, r.s) for r in keyed], n_shards)
    want = {r.doc_id: want[r.h, r.t] for r in keyed}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, n_shards, tolerance=0.0).collect()} == want


def test_only_groups_beyond_the_tolerance_are_cut(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard(docs).select("text", "size", "shard").collect()
    whole = max(max(r.size for r in got), sharding.GROUP_TOLERANCE * sum(r.size for r in got) / 24)
    by = defaultdict(list)
    for r in got:
        by[r.text or ""].append(r)
    for v in by.values():
        assert len({r.shard for r in v}) == 1 or sum(r.size for r in v) > whole


def test_repeated_rows_of_a_third_are_cut(spark):
    """Rows equal in id and text, null ids too, are numbered where one shard can't hold them."""
    rows = [(None if i % 2 else 7, "the same row again", None, None, None) for i in range(1000)] + [(i, f"text {i} of the rest", None, None, None) for i in range(1000)]
    by, got = check(spark, rows, 8)
    sizes = [sum(r.size for r in by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + 2 * max(r.size for r in got)


@pytest.mark.parametrize("cell", [4 << 20, 500])
def test_awkward_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_BYTES", cell)
    check(spark, documents(), 5)


def test_empty_one_row_and_clashing_columns(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    check(spark, documents()[:1], 24)
    extra = spark.createDataFrame(documents()[:9], DOCS).withColumn("slot", F.lit("mine")).withColumn("_h", F.lit(1))
    assert sharding.shard(extra, 3).count() == 9


def test_splitters_count_exactly(spark):
    keys = spark.range(500).select((F.col("id") % 50).alias("h"), F.col("id").alias("t"), F.lit(1).cast("long").alias("size"))
    splitters, n, _ = sharding.find_splitters(keys, 4, 0.0)
    rows = sorted((i % 50, i) for i in range(500))
    assert n == 500 and [sum(r < s for r in rows) for s in splitters] == [125, 250, 375]
