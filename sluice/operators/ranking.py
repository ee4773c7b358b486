"""Choosing rows by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with rank; Spark limits each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def nth(df: DataFrame, parent: str, position: str, n: int) -> DataFrame:
    """The n-th child of each parent."""
    return top_k(df, parent, n, F.col(position)).where(F.col("rank") == n).drop("rank")


def cascade(rules: DataFrame, element: str, specificity: str, order: str) -> DataFrame:
    """The rule that wins for each element: the most specific, of equals the latest."""
    row = F.struct(specificity, order, *(c for c in rules.columns if c not in (specificity, order)))
    return rules.groupBy(element).agg(F.max(row).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in rules.columns))
