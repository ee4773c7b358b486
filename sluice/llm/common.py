"""Shared helpers: the shared folder, materialised tables, Arrow columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark whatever the store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and values that depend on task layout (generated ids) are fixed by it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, column: str, n: int, codec: str = "snappy") -> DataFrame:
    """Write df in n buckets by a column and read it back, so that a join with rows dealt to n partitions by that column moves none of it.

    Where a task holds one value of the column, it writes one file.
    """
    spark = df.sparkSession
    called = f"sluice_{name}_{uuid.uuid4().hex}"
    try:
        df.write.option("compression", codec).option("path", f"{shared_dir(spark)}/sluice/{called}").bucketBy(n, column).saveAsTable(called)
        got = spark.table(called)
        got.schema  # noqa: B018  resolved now: only the catalogue's entry goes, not the files
        return got
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {called}")


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others, whatever they are called, can't clash."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Add a generated id; materialise before using it on both sides of a join."""
    return df.withColumn(name, F.monotonically_increasing_id())


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def held_out(doc_id, mod: int, remainder: int):
    """Fold of a document: crc32 of doc_id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder


#: Keys of dropped rows are broadcast up to this many; beyond, they are joined by shuffle.
BROADCAST_KEYS = 1 << 19


def _null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str, small: bool) -> DataFrame:
    right = right.select(*(F.col(n).alias(f"_r{i}") for i, n in enumerate(names)))
    on = [F.col(n).eqNullSafe(F.col(f"_r{i}")) for i, n in enumerate(names)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(F.broadcast(right) if small else right, cond, how)


def keep_rows(docs: DataFrame, keys: dict, verdict: DataFrame) -> DataFrame:
    """Rows of docs that a verdict keeps; keys are expressions over docs by the names of the verdict's key columns.

    The verdict has a row per document row, with its keys and kept. Rows that agree in
    all keys can't be told apart: if any is kept, one of them stays.
    """
    names = list(keys)
    per = materialise(verdict.groupBy(*names).agg(F.max("kept").alias("any"), F.count("*").alias("n")).where("NOT any OR n > 1"), "verdict")
    gone, twice = per.where("NOT any"), per.where("any AND n > 1")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    marked = docs.withColumns({f"_key_{n}": e for n, e in keys.items()}).toDF(*inner, *names)
    small = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rest = _null_safe(marked, gone, names, "left_anti", small)
    if not twice.isEmpty():
        once = _null_safe(rest, twice, names, "left_semi", False).dropDuplicates(names)
        rest = _null_safe(rest, twice, names, "left_anti", False).unionByName(once)
    return rest.select(*inner).toDF(*docs.columns)
