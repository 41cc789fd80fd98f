"""Objects in many polygons: each polygon is covered with cells, and objects meet cells by equality.

A polygon takes square cells of the power of two (of a degree) that puts at most ``SIDE`` of them along its longer
side.  Cells that an edge touches are border cells; of the others in a row all between two border cells are alike, so
one of them tells whether they are inside.  An object in an inner cell is inside; only objects in border cells are
held against the ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import inside

#: Cells along a polygon's longer side at most.
SIDE = 32
#: Finest and coarsest level: cells of 2^-level degrees.
FINEST, COARSEST = 24, -8
#: Slack, in squared degrees, within which an edge counts as touching a cell.
SLACK = 1e-15


def _scale() -> Column:
    return F.pow(F.lit(2.0), F.col("level"))


def _levels(areas: DataFrame, area: str, ring: str) -> DataFrame:
    """Polygons of three points or more with their level."""
    of = lambda c: F.transform(F.col(ring), lambda p: p[c].cast("double"))
    width = F.greatest(F.array_max(of("lon")) - F.array_min(of("lon")), F.array_max(of("lat")) - F.array_min(of("lat")))
    level = F.when(width > 0, F.floor(F.log2((SIDE - 1) / width))).otherwise(FINEST)
    whole = F.col(ring).isNotNull() & (F.size(ring) >= 3) & ~F.exists(ring, lambda p: p["lon"].isNull() | p["lat"].isNull())
    return areas.where(whole).select(F.col(area).alias("area_id"), F.col(ring).alias("ring"), F.greatest(F.lit(COARSEST), F.least(F.lit(FINEST), level)).cast("int").alias("level"))


def cover(areas: DataFrame, area: str = "area_id", ring: str = "ring") -> DataFrame:
    """Cells of each polygon: (area_id, level, cx, cy, whole); ``whole`` cells lie inside, the others touch an edge.

    Polygons with fewer than three points or a null in the ring have no cells.
    """
    given = _levels(areas, area, ring)
    nexts = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    edges = given.select("area_id", "level", F.explode(F.arrays_zip(F.col("ring").alias("a"), nexts.alias("b"))).alias("e"))
    edges = edges.select("area_id", "level", *[(F.col(f"e.{p}.{c}").cast("double") * _scale()).alias(f"{p}{c[1]}") for p in "ab" for c in ("lon", "lat")])
    # ao, aa: lon and lat of the edge's ends, in cells
    run = lambda x, y: F.sequence(F.floor(F.least(x, y)), F.floor(F.greatest(x, y)))
    laid = edges.withColumn("cx", F.explode(run(F.col("ao"), F.col("bo")))).withColumn("cy", F.explode(run(F.col("aa"), F.col("ba"))))
    side = lambda i, j: (F.col("bo") - F.col("ao")) * (F.col("cy") + j - F.col("aa")) - (F.col("ba") - F.col("aa")) * (F.col("cx") + i - F.col("ao"))
    corners = [side(i, j) for i in (0, 1) for j in (0, 1)]
    touched = (F.least(*corners) <= SLACK * F.pow(_scale(), 2)) & (F.greatest(*corners) >= -SLACK * F.pow(_scale(), 2))
    border = laid.where(touched).select("area_id", "level", "cx", "cy").distinct()
    row = Window.partitionBy("area_id", "level", "cy").orderBy("cx")
    gaps = border.withColumn("upto", F.lead("cx").over(row) - 1).where(F.col("upto") > F.col("cx")).select("area_id", "level", (F.col("cx") + 1).alias("cx"), "upto", "cy")
    middle = lambda c: (F.col(c) + 0.5) / _scale()
    filled = gaps.join(given.select("area_id", "ring"), "area_id").where(inside(middle("cx"), middle("cy"), F.col("ring")))
    filled = filled.select("area_id", "level", F.explode(F.sequence("cx", "upto")).alias("cx"), "cy", F.lit(True).alias("whole"))
    return filled.unionByName(border.withColumn("whole", F.lit(False)))


def in_areas(objects: DataFrame, areas: DataFrame, area: str = "area_id", ring: str = "ring", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Every object with every area that its point lies in: area_id and the object's columns.

    ``area`` must be unique.  An object is laid out once for each level that some polygon has (``FINEST`` less ``COARSEST``
    at most), never once a polygon.  Objects without a place lie in none.
    """
    given = _levels(areas, area, ring)
    levels = F.array(*[F.lit(r["level"]) for r in given.select("level").distinct().orderBy("level").collect()]).cast("array<int>")  # 33 at most
    own = [F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(objects.columns)]
    spots = objects.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"), *own)
    spots = spots.withColumn("level", F.explode(levels)).withColumns({"cx": F.floor(F.col("x") * _scale()), "cy": F.floor(F.col("y") * _scale())})
    met = spots.join(cover(areas, area, ring), ["level", "cx", "cy"])
    names = [F.col(f"_o{i}").alias(c) for i, c in enumerate(objects.columns) if c != "area_id"]
    sure = met.where("whole").select("area_id", *names)
    open_ = met.where("not whole").join(given.select("area_id", "ring"), "area_id").where(inside(F.col("x"), F.col("y"), F.col("ring")))
    return sure.unionByName(open_.select("area_id", *names))


def areas_summary(objects: DataFrame, areas: DataFrame, area: str = "area_id", ring: str = "ring") -> DataFrame:
    """By area and kind: objects inside, their lengths, and how many are at high risk."""
    hit = in_areas(objects, areas, area, ring)
    return hit.groupBy("area_id", "kind").agg(F.count("*").alias("objects"), F.sum("length_m").alias("length_m"), F.count_distinct(F.when(F.col("level") == "high", F.col("object_id"))).alias("high"))
