"""Weighted samples and linear discriminants, from what can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def steady(key: Column) -> Column:
    """A number within (0, 1) that a whole key always has: its multiple of a large odd number, in 32 bits."""
    return (key % 2147483648 * 2654435761 % 4294967296 + 0.5) / 4294967296.0


def weighted_sample(df: DataFrame, zone: str, weight: Column, key: str, take: Column, most: int) -> DataFrame:
    """So many rows of each zone, without replacement, with chances that follow weight: those of the smallest exponential keys -ln(u) / weight.

    u follows from key, so that a sample is the same whatever the partitions. Keys are
    independent of all other rows, so the best of parts hold the best of the whole, and the group limit of most (no
    less than any take) reaches below the shuffle. Rows whose weight isn't above 0 are never taken.
    """
    rows = df.where(weight > 0).withColumn("_k", -F.log(steady(F.col(key))) / weight)
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(zone).orderBy("_k", key))).where(F.col("_n") <= most)
    return best.where(F.col("_n") <= take).drop("_k", "_n")


def discriminants(df: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """A linear discriminant of two features for each label: its score is b0 + b1 x + b2 y, and the label of the highest one is the likeliest.

    One grouped pass gives counts, sums and products of each label, which merge; the pooled
    covariance is inverted by hand. Rows with a null are left out.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    g = df.dropna(subset=[label, x, y]).groupBy(label).agg(F.count("*").alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.covar_pop(a, b).alias("vxy"))
    every = Window.partitionBy(F.lit(1))  # a row a label
    n, total, labels = F.col("n"), F.sum("n").over(every), F.count("*").over(every)
    pooled = lambda c: F.sum(n * F.col(c)).over(every) / (total - labels)
    g = g.withColumns({"sx": pooled("vx"), "sy": pooled("vy"), "sxy": pooled("vxy"), "prior": F.log(n / total)})
    det = F.col("sx") * F.col("sy") - F.col("sxy") * F.col("sxy")
    g = g.withColumns({"b1": (F.col("sy") * F.col("mx") - F.col("sxy") * F.col("my")) / det, "b2": (F.col("sx") * F.col("my") - F.col("sxy") * F.col("mx")) / det})
    return g.select(label, "n", (F.col("prior") - (F.col("b1") * F.col("mx") + F.col("b2") * F.col("my")) / 2).alias("b0"), "b1", "b2")
