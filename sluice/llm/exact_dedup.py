"""Exact duplicates by a tree-merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep_rows, materialise, table

#: Runs merged into one at each level of the tree.
FAN_IN = 8


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: its id, digest, second hash, length and run.

    The run is the partition that read the document. Written once, so that
    neither the texts nor the layout are looked at again.
    """
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.sha2(F.col("t"), 256).alias("text_sha256"),
        F.struct(F.xxhash64("t").alias("h"), F.octet_length("t").alias("n")).alias("proof"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return materialise(rows.select("doc_id", F.unhex("text_sha256").alias("digest"), "proof", "run", "_row"), "digests")


def tree_merge(rows: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """Merge all runs, level by level, to one row per distinct text: survivor and count.

    At each level the runs whose numbers agree above the lowest log2(fan_in)
    bits exchange entries by digest and are merged; an entry that survives is the
    best identifier of its text so far. A text's entries meet only if digest,
    second hash and length all agree. Every run is already one row per text
    before it moves, so a text that fills a third of the corpus sends one row
    per run. All levels are hash exchanges on (run, digest): no task holds a
    whole run, let alone the root.

    Spark does the merging: the entries of a level arrive sorted by (run, digest), as its
    sort aggregate wants them, and that aggregate goes through the sorted runs once. A
    fan-in of eight needs a third of a binary tree's rounds, and each round exchanges
    all distinct digests.
    """
    best = F.min if keep == "smallest" else F.max
    # Rows with an id win over rows without, then the id decides, then the row.
    has = F.col("doc_id").isNotNull()
    rank = has if keep == "largest" else ~has
    entry = F.struct(rank.alias("r"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    runs = rows.groupBy("run", "digest", "proof").agg(best(entry).alias("best"), F.count(F.lit(1)).alias("size"))
    n = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while n > 1:
        n = -(-n // fan_in)
        level = runs.withColumn("run", F.floor(F.col("run") / fan_in)) if n > 1 else runs.withColumn("run", F.lit(0))
        runs = level.groupBy("run", "digest", "proof").agg(best("best").alias("best"), F.sum("size").alias("size"))
    return runs.select("digest", "proof", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("size").alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose texts are identical after lower-casing A-Z.

    Returns a row per document row: doc_id, keep_id, group_size, kept,
    text_sha256. Null text counts as empty, and empty texts are one group. Of
    rows that share the surviving id (repeated rows) one is kept; rows with a
    null id survive only where no row of the group has one. An empty table
    gives an empty result; other columns are ignored. The survivor table joins
    back on the digest as a plain equi-join, whose hot groups adaptive
    execution splits.
    """
    rows = digest_runs(docs, id_col, text_col)
    merged = tree_merge(rows, keep)
    many = merged.where("group_size > 1")
    joined = rows.join(many, ["digest", "proof"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_row", "_row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs with one row of each group of equal texts; columns stay as they are."""
    verdict = exact_dedup(docs, keep).select("doc_id", "text_sha256", "kept")
    digest = F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)
    return keep_rows(docs, {"doc_id": F.col("doc_id"), "text_sha256": digest}, verdict)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its group; the largest doc_id of equal texts stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
