"""The k nearest samples of every point, by cells that follow how dense the samples are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.sources.tables import written

#: Levels of cells at most; each halves a cell's width.
MAX_LEVELS = 24


def _cell(c: Column, low: float, size: float, level: Column | int) -> Column:
    """The cell of a coordinate, of 2**level along the map."""
    n = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))
    return F.least(F.floor((c - low) / size * n), n - 1).cast("long")


def _around(radius: int) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1))))


def k_nearest(points: DataFrame, samples: DataFrame, k: int, point_id: str, sample_id: str) -> DataFrame:
    """(point_id, sample columns, squared distance d2, rank) of the k samples nearest to each point; all of them if fewer.

    points has point_id, x, y; samples has sample_id, ox, oy and others. Equal distances
    go by sample_id. Rows with a null coordinate are left out.

    A point looks at the finest level of cells whose three by three around it hold k samples.
    The k-th of these is certain if it is no farther than a cell is wide; other
    points then look at all cells within the distance of their k-th, which is less than three
    cells, so one widening is always enough. The work follows the number of points, since a finer
    level always stands ready where samples are dense.
    """
    points = points.select(point_id, "x", "y").dropna()
    samples = samples.dropna(subset=["ox", "oy"])
    box = points.select("x", "y").unionByName(samples.select(F.col("ox").alias("x"), F.col("oy").alias("y"))).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    n = samples.count()
    x0, y0 = (box[0] or 0.0), (box[1] or 0.0)
    size = max((box[2] or 0.0) - x0, (box[3] or 0.0) - y0, 1e-9) * (1 + 1e-9)
    levels = min(MAX_LEVELS, max(0, math.ceil(math.log(max(1, n / k), 4)) + 3))
    fine = lambda x, y: {"fx": _cell(F.col(x), x0, size, levels), "fy": _cell(F.col(y), y0, size, levels)}
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), levels - F.col("level"))).cast("long")

    counts = samples.withColumns(fine("ox", "oy")).groupBy("fx", "fy").agg(F.count("*").alias("n"))
    cells = counts.select("fx", "fy", "n", every).groupBy("level", up("fx").alias("cx"), up("fy").alias("cy")).agg(F.sum("n").alias("n"))
    spread = cells.withColumn("d", _around(1)).groupBy("level", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy")).agg(F.sum("n").alias("n"))
    enough = spread.where(F.col("n") >= k).select("level", "cx", "cy")
    placed = points.withColumns(fine("x", "y"))
    own = placed.select("fx", "fy").distinct().select("fx", "fy", every).withColumns({"cx": up("fx"), "cy": up("fy")}).join(enough, ["level", "cx", "cy"], "left_semi")
    finest = own.groupBy("fx", "fy").agg(F.max("level").alias("level"))
    looking = written(placed.join(finest, ["fx", "fy"], "left").select(point_id, "x", "y", F.coalesce("level", F.lit(0)).alias("level")), "looking")
    used = sorted(r.level for r in looking.select("level").distinct().collect())  # no more than there are levels
    standing = samples.withColumn("level", F.explode(F.array(*(F.lit(v) for v in used or [0]))))
    standing = standing.withColumns({"cx": _cell(F.col("ox"), x0, size, F.col("level")), "cy": _cell(F.col("oy"), y0, size, F.col("level"))})
    width = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    order = Window.partitionBy(point_id).orderBy("d2", sample_id)

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    here = {"cx": _cell(F.col("x"), x0, size, F.col("level")), "cy": _cell(F.col("y"), y0, size, F.col("level"))}
    near = looking.withColumns(here).withColumn("d", _around(1)).withColumns({"cx": F.col("cx") + F.col("d.dx"), "cy": F.col("cy") + F.col("d.dy")}).drop("d")
    first = written(ranked(near.join(standing, ["level", "cx", "cy"]).withColumn("d2", d2)).drop("cx", "cy"), "near")
    # Who can't be certain: the k-th, or a lack of k, reaches beyond the cells seen, and there are others.
    reach = looking.join(first.groupBy(point_id).agg(F.max("d2").alias("far"), F.count("*").alias("n")), point_id, "left")
    unsure = reach.where((F.col("level") > 0) & (F.sqrt("far") > width)).select(point_id, "x", "y", "level", F.sqrt("far").alias("far"))
    lower, upper = (lambda c, low: _cell(F.greatest(F.col(c) - F.col("far"), F.lit(low)), low, size, F.col("level"))), (lambda c, low: _cell(F.least(F.col(c) + F.col("far"), F.lit(low + size)), low, size, F.col("level")))
    wide = unsure.withColumn("cx", F.explode(F.sequence(lower("x", x0), upper("x", x0)))).withColumn("cy", F.explode(F.sequence(lower("y", y0), upper("y", y0)))).drop("far")
    second = ranked(wide.join(standing, ["level", "cx", "cy"]).withColumn("d2", d2)).drop("cx", "cy")
    out = first.join(unsure.select(point_id), point_id, "left_anti").unionByName(second)
    return out.drop("x", "y", "level")


def inverse_distance(near: DataFrame, point_id: str, value: str) -> DataFrame:
    """(point_id, estimate, n): the mean of the near samples' values, each weighted by 1 / (d2 + 1)."""
    w = 1 / (F.col("d2") + 1)
    return near.groupBy(point_id).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("estimate"), F.count("*").alias("n"))
