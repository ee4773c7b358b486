"""Field analytics on any keyed series: our own semantics, from common practice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import folds


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 0: NDVI of near infrared and red, NDRE of near infrared and red edge."""
    return F.try_divide(a - b, a + b)


def soil_adjusted(a: Column, b: Column, factor: float = 0.5) -> Column:
    """SAVI: (a - b) / (a + b + L) * (1 + L)."""
    return F.try_divide(a - b, a + b + factor) * (1 + factor)


def anomalies(df: DataFrame, zone: str, value: str, limit: float) -> DataFrame:
    """Rows whose z-score within their zone exceeds limit either way; zones are joined back by their statistics."""
    stats = df.groupBy(zone).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    z = F.try_divide(F.col(value) - F.col("mean"), F.col("sd"))
    return df.join(stats, zone).withColumn("z", z).where(F.abs("z") > limit)


def zones_by_share(df: DataFrame, value: str, width: float, shares: dict[str, float]) -> DataFrame:
    """df with zone: names by cumulative share of rows, the highest values first.

    Values are counted in bins of width, and a bin goes whole to the zone in which
    its first row falls; only the bins, which are few, are put in order.
    """
    binned = df.withColumn("_bin", F.floor(F.col(value) / width))
    counts = binned.groupBy("_bin").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    share = counts.select("_bin", (F.coalesce(F.sum("n").over(before), F.lit(0)) / F.sum("n").over(every)).alias("share"))
    names, total, zone = list(shares), sum(shares.values()), F.lit(list(shares)[-1])
    for n in reversed(names[:-1]):
        total -= shares[names[names.index(n) + 1]]
        zone = F.when(F.col("share") < total, n).otherwise(zone)
    return binned.join(share, "_bin").withColumn("zone", zone).drop("_bin", "share")


def gaps(df: DataFrame, row: str, order: tuple[str, ...], position: str, limit: float) -> DataFrame:
    """Stretches between neighbours of a row that are longer than limit: where, and how long. order starts with a time, by whose days a row is divided."""
    near = folds.with_neighbours(df, row, order, position, 0, 1)
    return near.withColumn("gap", F.get("_after", F.lit(0))["v"] - F.col(position)).where(F.col("gap") > limit).drop("_before", "_after", "_rank")


def nearby(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (x, y) and others (ox, oy) at most radius apart, with their distance: an equi-join on cells of that width, each of the others standing in nine."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    spread = others.withColumn("_dx", near).withColumn("_dy", near).withColumns({"_cx": cell("ox") + F.col("_dx"), "_cy": cell("oy") + F.col("_dy")}).drop("_dx", "_dy")
    distance = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    return points.withColumns({"_cx": cell("x"), "_cy": cell("y")}).join(spread, ["_cx", "_cy"]).withColumn("distance", distance).where(F.col("distance") <= radius).drop("_cx", "_cy")


def within_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs of points (x, y) and boxes (x0, y0, x1, y1; lower edges belong to them): an equi-join on cells, a box standing in each that it meets."""
    edge = lambda c: F.floor(F.col(c) / cell)
    spread = boxes.withColumn("_cx", F.explode(F.sequence(edge("x0"), edge("x1")))).withColumn("_cy", F.explode(F.sequence(edge("y0"), edge("y1"))))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return points.withColumns({"_cx": edge("x"), "_cy": edge("y")}).join(spread, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def take_until(df: DataFrame, value: str, cost: str, tie: str, budget: int, width: int) -> DataFrame:
    """The rows of highest value whose costs together stay within a budget.

    Running sums go over bins of the value, then over the counted values of the bins that the
    budget reaches, and then over the rows of one value at a time: a bin is no single task.
    Costs are not negative.
    """
    binned = df.withColumn("_bin", F.floor(F.col(value) / width))
    sums = binned.groupBy("_bin", F.col(value).alias("_value")).agg(F.sum(cost).alias("c"))

    def before(by, *within):
        order = Window.partitionBy(*within).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("c").over(order), F.lit(0))

    bins = sums.groupBy("_bin").agg(F.sum("c").alias("c")).select("_bin", before("_bin").alias("_at")).where(F.col("_at") <= budget)
    values = sums.join(bins, "_bin").select("_value", (F.col("_at") + before("_value", "_bin")).alias("_start")).where(F.col("_start") <= budget)
    inside = Window.partitionBy("_value").orderBy(tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.join(values, F.col(value) == F.col("_value")).withColumn("spent", F.sum(cost).over(inside) + F.col("_start"))
    return rows.where(F.col("spent") <= budget).drop("_value", "_start")


def polygon_area(xs: Column, ys: Column) -> Column:
    """Area by the shoelace formula over arrays of vertices in order."""
    turn = F.concat(F.slice(ys, 2, F.size(ys)), F.slice(ys, 1, 1))
    turn_x = F.concat(F.slice(xs, 2, F.size(xs)), F.slice(xs, 1, 1))
    products = F.zip_with(F.zip_with(xs, turn, lambda a, b: a * b), F.zip_with(turn_x, ys, lambda a, b: a * b), lambda a, b: a - b)
    return F.abs(F.aggregate(products, F.lit(0.0), lambda s, x: s + x)) / 2


def polygon_perimeter(xs: Column, ys: Column) -> Column:
    """Length of the closed line through vertices in order."""
    ahead = lambda c: F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))
    steps = F.zip_with(F.zip_with(xs, ahead(xs), lambda a, b: (a - b) * (a - b)), F.zip_with(ys, ahead(ys), lambda a, b: (a - b) * (a - b)), lambda a, b: F.sqrt(a + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
