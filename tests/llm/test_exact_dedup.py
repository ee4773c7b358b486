import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cases import DOCS, documents, low
from sluice.llm import exact_dedup


def brute(rows, keep):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[low(r[1])].append(i)
    out = []
    for text, own in groups.items():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        for i in own:
            out.append((rows[i][0], best, len(own), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out), len(groups)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_equals_brute_force(spark, keep):
    rows = documents()
    want, n = brute(rows, keep)
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS).repartition(13), keep).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == n
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_every_level_of_the_tree_merges(spark):
    rows = [(i, f"text {i % 3}", None, None, None) for i in range(200)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS).repartition(70), "largest").where("kept").collect()
    assert sorted((r.doc_id, r.group_size) for r in got) == [(197, 66), (198, 67), (199, 67)]


def test_drop_copies_keeps_columns_and_one_row_each(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("x")).withColumn("run", F.lit(1))
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(low(r.text) for r in out.collect()) == sorted({low(r[1]) for r in rows})


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_dedup(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def test_main_path_has_no_python(spark):
    df = exact_dedup.exact_dedup(spark.createDataFrame(documents(), DOCS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
