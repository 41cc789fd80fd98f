"""Cell covers against the plain ray cast, and table functions against the library's operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import areas as G
from episodica.operators import metrics as M
from episodica.operators import risk as R
from episodica.plans import table_functions


def plain_inside(x, y, ring):
    out = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            out = not out
    return out


@pytest.fixture(scope="module")
def polygons():
    """200 polygons: stars of many sizes, thin slivers, rectangles along cell borders, bow ties."""
    rng, out = random.Random(6), []
    for k in range(200):
        x, y, size = 37 + rng.random(), 55 + rng.random(), 10 ** rng.uniform(-4, 0)
        if k % 10 == 0:  # edges on cell borders
            s = 2.0 ** -rng.randrange(3, 9)
            x, y = math.floor(x / s) * s, math.floor(y / s) * s
            ring = [(x, y), (x + 3 * s, y), (x + 3 * s, y + 2 * s), (x, y + 2 * s)]
        elif k % 10 == 1:
            ring = [(x, y), (x + size, y + size), (x + size, y + size + 1e-7), (x, y + 1e-7)]
        elif k % 10 == 2:
            ring = [(x, y), (x + size, y + size), (x + size, y), (x, y + size)]
        else:
            n = rng.randrange(3, 40)
            ring = [(x + size * rng.uniform(0.2, 1) * math.cos(2 * math.pi * i / n), y + size * rng.uniform(0.2, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        out.append((k, ring))
    return out


def test_areas_equal_brute_force(spark, polygons):
    rng = random.Random(7)
    points = [(i, 36.5 + 2 * rng.random(), 54.5 + 2 * rng.random()) for i in range(400)]
    # points at corners, on edges and beside small polygons
    for k, ring in polygons:
        (ax, ay), (bx, by) = ring[0], ring[1]
        points += [(len(points), ax, ay), (len(points) + 1, (ax + bx) / 2, (ay + by) / 2), (len(points) + 2, ring[0][0] * 0.5 + ring[len(ring) // 2][0] * 0.5, ring[0][1] * 0.5 + ring[len(ring) // 2][1] * 0.5)]
    objects = spark.createDataFrame([*points, (10**6, None, 55.0), (10**6 + 1, 37.0, None)], "object_id long, lon double, lat double").withColumn("level", F.lit("high")).withColumn("cx", F.lit("x"))
    areas = spark.createDataFrame([*[(k, [tuple(p) for p in r]) for k, r in polygons], (900, []), (901, [(1.0, 2.0), (3.0, 4.0)]), (902, None)], "area_id int, ring array<struct<lon:double,lat:double>>")
    got = {(r.area_id, r.object_id) for r in G.in_areas(objects, areas).collect()}
    want = {(k, i) for k, ring in polygons for i, x, y in points if plain_inside(x, y, ring)}
    assert got == want and len(want) > 400
    assert G.in_areas(objects, areas).columns == ["area_id", *objects.columns]
    assert G.in_areas(objects, areas.limit(0)).collect() == []


def test_cover_stays_small_and_decides_most(spark):
    """A large polygon: a bounded number of cells, and most objects inside are settled without the ring."""
    ring = [(37 + 3 * math.cos(i / 50), 55 + 3 * math.sin(i / 50)) for i in range(314)]
    areas = spark.createDataFrame([(1, ring)], "area_id int, ring array<struct<lon:double,lat:double>>")
    cells = G.cover(areas).collect()
    assert len(cells) <= (G.SIDE + 1) ** 2 and sum(c.whole for c in cells) > 3 * sum(not c.whole for c in cells)
    assert len({(c.cx, c.cy) for c in cells}) == len(cells)


@pytest.fixture(scope="module")
def functions(spark):
    rng = random.Random(3)
    rows = [(k, k % 3, rng.randrange(10**12), rng.random()) for k in range(400)]
    spark.createDataFrame(rows, "journal_id long, key int, at_us long, probability double").createOrReplaceTempView("decisions_t")
    events = [(rng.choice(["a", "b", "c"]), rng.randrange(40) * 3_600_000_000 * 6, rng.random() < 0.3) for _ in range(200)]
    spark.createDataFrame(events, "object_id string, at_us long, failure boolean").createOrReplaceTempView("alerts_t")
    readings = [(k, k % 5, k % 4, 1_704_067_200_000_000 + k * 60_000_000, "ok", float(k) if k % 3 else None) for k in range(100)]
    j = spark.createDataFrame(readings, "journal_id long, channel_id long, section_id long, at long, value_text string, value_num double").withColumn("read_time", F.timestamp_micros("at"))
    j.createOrReplaceTempView("readings_t")
    table_functions.register_functions(spark, "readings_t")


def test_policy_function_equals_the_operator(spark, functions):
    got = spark.sql("SELECT * FROM write_policy(TABLE(decisions_t), 0.5, 600)")
    want = R.write_policy(spark.table("decisions_t").withColumn("t", F.timestamp_micros("at_us")), "key", "t", "probability", {"threshold": 0.5, "heartbeat_min": 600.0})
    want = want.select("key", F.unix_micros("t").alias("at_us"), "probability", "risk_class", "reason")
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_match_function_equals_the_operator(spark, functions):
    low, span = 24 * 3_600_000_000, 48 * 3_600_000_000
    view = spark.table("alerts_t").withColumn("at_us", F.when(F.col("failure"), F.col("at_us")).otherwise(F.col("at_us") + low))
    view.createOrReplaceTempView("shifted_t")
    got = spark.sql(f"SELECT * FROM match_alerts(TABLE(shifted_t), {span})")
    sides = [spark.table("alerts_t").where(F.col("failure") == f).select("object_id", F.timestamp_micros("at_us").alias("t")) for f in (False, True)]
    want = M.match_alerts(*sides, low_hours=24, high_hours=72).drop("leads")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_sql_functions_are_inlined(spark, functions):
    got = spark.sql("SELECT journal_id FROM section_rows(2, TIMESTAMP '2024-01-01 00:10:00', TIMESTAMP '2024-01-01 00:30:00')")
    assert sorted(r[0] for r in got.collect()) == [10, 14, 18, 22, 26]
    assert "section_rows" not in got._jdf.queryExecution().optimizedPlan().toString()
    last = {r.channel_id: r.value_num for r in spark.sql("SELECT * FROM last_numbers(TIMESTAMP '2024-01-01 01:00:00')").collect()}
    assert last == {c: max(float(k) for k in range(61) if k % 5 == c and k % 3) for c in range(5)}


def test_functions_say_what_a_table_lacks(spark, functions):
    with pytest.raises(Exception, match="the table lacks read_time"):
        spark.sql("SELECT * FROM episodes(TABLE(SELECT 1 AS channel_id, 2 AS journal_id), array('x'))").collect()
