"""Linear references, points and areas as column expressions and equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points in degrees."""
    rad = lambda c: F.radians(c)
    h = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def line_length(points: Column) -> Column:
    """Metres along an array of (lon, lat)."""
    legs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(legs, F.lit(0.0), lambda s, x: s + x))


def linear_reference(sections: DataFrame) -> DataFrame:
    """Interval of each section in metres, the axis' length and the order of parts, by (collector, prefix)."""
    axis = Window.partitionBy("collector", "prefix")
    return sections.withColumns({
        "from_m": F.col("picket") * 10, "to_m": F.col("picket") * 10 + 10,
        "axis_m": F.max("picket").over(axis) * 10 + 10, "part": F.dense_rank().over(axis.orderBy("picket")),
    })


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of (lon, lat), by counting the edges that a ray crosses."""
    nexts = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("a"), nexts.alias("b"))
    def crosses(e):
        a, b = e["a"], e["b"]
        x = a["lon"] + (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"])
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < x), F.lit(False))

    return F.aggregate(edges, F.lit(False), lambda s, e: s != crosses(e))


def snap(points: DataFrame, objects: DataFrame, radius_m: float, key: str = "point_id", crowd: int = 16) -> DataFrame:
    """Nearest object in service within the radius of each point, the smallest id of equals.

    Points of one place are asked once, objects of one place are its smallest id.  Space is cut into cells no smaller
    than a step; an object is laid into its 3 x 3 cells and the join is on the cell, so every object within the step
    is met.  Steps double from one at which a cell holds some ``crowd`` places up to the radius, and a place that has
    found its object within a step is not asked again.  Longitude cells widen with latitude, up to 80 degrees.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    cells = lambda lon, lat, s: (F.floor(F.col(lon) / (s / 0.1736)), F.floor(F.col(lat) / s))  # noqa: E731  cos 80
    spots = objects.where("in_service and lon is not null and lat is not null").groupBy(F.col("lon").alias("olon"), F.col("lat").alias("olat")).agg(F.min("object_id").alias("object_id"))
    step = radius_m / 111_195.0
    held = spots.groupBy(*cells("olon", "olat", step)).count().agg(F.max("count")).first()[0] or 0
    halvings = min(20, max(0, math.ceil(math.log(max(held, 1) / crowd, 4))))
    asked = points.select("lon", "lat").where("lon is not null and lat is not null").distinct().withColumn("found", F.lit(None).cast("struct<metres:double,object_id:" + dict(spots.dtypes)["object_id"] + ">"))
    for k in reversed(range(halvings + 1)):
        part, reach = step / 2**k, radius_m / 2**k
        cx, cy = cells("olon", "olat", part)
        laid = spots.select("*", cx.alias("x"), cy.alias("y"), around.alias("s")).select("olon", "olat", "object_id", (F.col("x") + F.col("s.i")).alias("cx"), (F.col("y") + F.col("s.j")).alias("cy"))
        cx, cy = cells("lon", "lat", part)
        # places that are settled go on under keys of their own, which no cell has
        done, apart = F.col("found").isNotNull(), F.xxhash64("lon", "lat")
        now = asked.select("*", F.when(done, apart).otherwise(cx).alias("cx"), F.when(done, F.lit(2**62)).otherwise(cy).alias("cy")).join(laid, ["cx", "cy"], "left")
        metres = haversine(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat"))
        met = F.when(metres <= reach, F.struct(metres.alias("metres"), F.col("object_id").alias("object_id")))
        asked = now.groupBy("lon", "lat").agg(F.min(F.coalesce("found", met)).alias("found"))
    best = asked.where("found is not null").select("lon", "lat", F.col("found.object_id").alias("object_id"), F.col("found.metres").alias("metres"))
    return points.join(best, ["lon", "lat"], "left").select(*points.columns, "object_id", "metres")


def area_summary(objects: DataFrame, ring: Column) -> DataFrame:
    """By kind: objects whose point is inside, their lengths, and how many are at high risk."""
    hit = objects.where(inside(F.col("lon"), F.col("lat"), ring))
    return hit.groupBy("kind").agg(F.count("*").alias("objects"), F.sum("length_m").alias("length_m"), F.count_distinct(F.when(F.col("level") == "high", F.col("object_id"))).alias("high"))


def layer_colour(active: Column, level: Column) -> Column:
    return F.when(~active, "grey").when(level == "high", "red").when(level == "watch", "yellow").when(level == "normal", "green").otherwise("grey")


def _pair(p: Column, sep: str) -> Column:
    return F.concat(F.format_string("%.9f", p["lon"].cast("double")), F.lit(sep), F.format_string("%.9f", p["lat"].cast("double")))


def wkt(points: Column) -> Column:
    inner = F.array_join(F.transform(points, lambda p: _pair(p, " ")), ", ")
    return F.when(F.size(points) == 1, F.concat(F.lit("POINT("), inner, F.lit(")"))).otherwise(F.concat(F.lit("LINESTRING("), inner, F.lit(")")))


def geojson(points: Column) -> Column:
    each = F.transform(points, lambda p: F.concat(F.lit("["), _pair(p, ","), F.lit("]")))
    line = F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join(each, ","), F.lit("]}"))
    return F.when(F.size(points) == 1, F.concat(F.lit('{"type":"Point","coordinates":'), F.get(each, 0), F.lit("}"))).otherwise(line)


def dense_neighbours(points: DataFrame, group: str, position: str, step: float) -> DataFrame:
    """Groups in which two neighbours stand closer than ``step``."""
    w = Window.partitionBy(group).orderBy(position)
    gap = F.col(position) - F.lag(position).over(w)
    return points.withColumn("_g", gap).groupBy(group).agg(F.coalesce(F.bool_or(F.col("_g") < step), F.lit(False)).alias("dense"))
