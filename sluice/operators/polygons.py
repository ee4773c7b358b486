"""Polygons with holes: read from text, measured, and joined to points by covering cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rings(text: Column) -> Column:
    """The rings of a WKT polygon, outer one first: arrays of vertices (x, y), the last one equal to the first as text has it."""
    number = lambda pair, k: F.split(F.trim(pair), r"\s+")[k].cast("double")
    inside = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.transform(inside, lambda r: F.transform(F.split(r, ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))))


def edges(ring_list: Column) -> Column:
    """All edges of rings, from (ax, ay) to (bx, by); a ring that isn't closed is closed."""
    follow = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    pair = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return F.filter(F.flatten(F.transform(ring_list, lambda r: F.zip_with(r, follow(r), pair))), lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))


def _ring_area(ring: Column) -> Column:
    follow = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, follow, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def area(ring_list: Column) -> Column:
    """Area within the first ring and outside the others, by the shoelace formula."""
    return F.aggregate(F.transform(ring_list, lambda r, i: F.when(i == 0, _ring_area(r)).otherwise(-_ring_area(r))), F.lit(0.0), lambda s, v: s + v)


def perimeter(edge_list: Column) -> Column:
    """Length of all edges, those of holes too."""
    length = lambda e: F.sqrt((e["bx"] - e["ax"]) * (e["bx"] - e["ax"]) + (e["by"] - e["ay"]) * (e["by"] - e["ay"]))
    return F.aggregate(F.transform(edge_list, length), F.lit(0.0), lambda s, v: s + v)


def holds(edge_list: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right crosses an odd number of edges: inside the outer ring and no hole."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.size(F.filter(edge_list, crosses)) % 2 == 1


def covering_cells(polygons: DataFrame, cell: float) -> DataFrame:
    """Each polygon's cells: cx, cy, and the edges that a point of the cell has to be tested against; none where the cell lies wholly inside.

    polygons has edges and columns to carry. A cell is inside if no edge's bounding box
    meets it and its centre is. A test needs only the edges at the cell's height that do not end to the left of it.
    """
    low = lambda a, b: F.array_min(F.transform("edges", lambda e: F.least(e[a], e[b])))
    high = lambda a, b: F.array_max(F.transform("edges", lambda e: F.greatest(e[a], e[b])))
    span = lambda a, b: F.explode(F.sequence(F.floor(low(a, b) / cell), F.floor(high(a, b) / cell)))
    names = [c for c in polygons.columns if c != "edges"]
    cells = polygons.where(F.size("edges") > 0).withColumn("cx", span("ax", "bx")).withColumn("cy", span("ay", "by"))
    x0, y0 = F.col("cx") * F.lit(cell), F.col("cy") * F.lit(cell)
    x1, y1 = x0 + cell, y0 + cell
    level = lambda e: (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ay"], e["by"]) >= y0) & (F.greatest(e["ax"], e["bx"]) >= x0)
    meets = F.exists("edges", lambda e: level(e) & (F.least(e["ax"], e["bx"]) <= x1))
    inside = holds(F.col("edges"), x0 + cell / 2, y0 + cell / 2)
    found = cells.withColumns({"meets": meets, "inside": inside}).where("meets OR inside")
    return found.select(*names, "cx", "cy", F.when(F.col("meets"), F.filter("edges", level)).alias("near"))


def within(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs of points (x, y) and polygons that hold them: an equi-join on cells; only points in cells that an edge meets are tested."""
    at = lambda c: F.floor(F.col(c) / cell)
    pairs = points.withColumns({"cx": at("x"), "cy": at("y")}).join(covering_cells(polygons, cell), ["cx", "cy"])
    return pairs.where(F.col("near").isNull() | holds(F.col("near"), F.col("x"), F.col("y"))).drop("cx", "cy", "near")
