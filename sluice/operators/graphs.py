"""Work over links: sums down pointers, and what can be reached."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.tables import written


def upstream_sums(nodes: DataFrame, key: str, to: str, values: list[str]) -> DataFrame:
    """nodes (key, to, values) with values summed over all nodes that lead to each, itself too.

    to is where a node leads, null at an end; there are no cycles. Pointers are doubled:
    after round r a node has the sums of what is less than 2**r steps
    away, and points 2**r steps on, so rounds are as the logarithm of the longest way.
    """
    state = written(nodes.select(key, F.col(to).alias("_to"), *values), "upstream")
    while not (live := state.where("_to IS NOT NULL")).isEmpty():
        add = live.groupBy(F.col("_to").alias(key)).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        on = state.where("_to IS NOT NULL").select(F.col(key).alias("_to"), F.col("_to").alias("_next"))
        moved = live.join(on, "_to", "left").select(key, F.col("_next").alias("_to"), *values)
        now = moved.unionByName(state.where("_to IS NULL")).join(add, key, "left")
        state = written(now.select(key, "_to", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)), "upstream")
    return state.drop("_to")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, hops) of what edges (src, dst) reach from start (node), start itself at 0.

    Each round takes one step from the nodes that the round before has found, and keeps
    those not yet met; it ends when there are none, so rounds are the greatest number of hops.
    """
    links = written(edges.select("src", "dst").dropna().distinct(), "links")
    frontier = written(start.select("node").dropna().distinct().withColumn("hops", F.lit(0)), "frontier")
    found = [frontier]
    while not frontier.isEmpty():
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        met = reduce(DataFrame.unionByName, found).select("node")
        frontier = written(step.join(met, "node", "left_anti").withColumn("hops", F.lit(len(found))), "frontier")
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)


def steepest_descent(cells: DataFrame) -> DataFrame:
    """cells (cx, cy, h) with to_x, to_y: the neighbour of eight that lies steepest below, null in a hollow.

    h is whole; slopes are compared as squares, drop over distance, which are whole too. Equal
    ones go by cy, then cx. A cell gives its height to its neighbours in one grouping, not in eight joins.
    """
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    give = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in around)))
    told = cells.select("cx", "cy", "h", give.alias("d")).select((F.col("cx") - F.col("d.dx")).alias("tx"), (F.col("cy") - F.col("d.dy")).alias("ty"), "cx", "cy", "h", ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("own"))
    other = F.struct((F.col("h")).alias("h"), "cx", "cy")
    met = told.groupBy("tx", "ty").agg(F.max(F.when(F.col("own"), F.col("h"))).alias("h"), F.collect_list(F.when(~F.col("own"), other)).alias("o")).where("h IS NOT NULL")
    low = F.filter("o", lambda o: o["h"] < F.col("h"))
    slope = lambda o: (F.col("h") - o["h"]) * (F.col("h") - o["h"]) * F.when((o["cx"] == F.col("tx")) | (o["cy"] == F.col("ty")), 2).otherwise(1)
    best = F.array_max(F.transform(low, lambda o: F.struct(slope(o).alias("s"), (-o["cy"]).alias("y"), (-o["cx"]).alias("x"))))
    return met.withColumn("best", best).select(F.col("tx").alias("cx"), F.col("ty").alias("cy"), "h", (-F.col("best.x")).alias("to_x"), (-F.col("best.y")).alias("to_y"))
