"""What the findings of round 3 were about, each on a case small enough to check by hand or brute force."""

import random

import duckdb
from pyspark.sql import functions as F

from episodica.functions import geo
from episodica.operators import anomaly, labels
from episodica.operators import metrics as M
from episodica.operators import permits as PM
from episodica.queries import REGISTRY, scale


def test_curve_goes_up_to_all_rows(spark, sf, monkeypatch):
    """the numbers of alerts went up to 400 000, which the SQL does not know."""
    assert M.alert_counts(2_000_000, most=None)[-1] == 2_000_000 and len(M.alert_counts(2_000_000, most=None)) == 60
    # a small limit in place of the large one shows whether the query still has any
    plain = M.alert_counts
    monkeypatch.setattr(M, "alert_counts", lambda n, steps=60, least=20, most=30: plain(n, steps, least, most))
    rows, _ = scale.alert_rows(spark, sf)
    assert scale.m15_matched(spark, sf).agg(F.max("alerts")).first()[0] == rows.count() > 300


def test_equal_masses_are_equal(spark):
    """F2: 0.1 + 0.2 is more than 0.3 only in doubles; the first of equal classes is the top one."""
    signals = spark.createDataFrame([("e", "b", "s1", 0.1), ("e", "b", "s2", 0.2), ("e", "a", "s3", 0.3)], "entity string, class string, source string, p double")
    weights = spark.createDataFrame([("s1", 1.0), ("s2", 1.0), ("s3", 1.0)], "source string, weight double")
    assert anomaly.fuse_signals(signals, weights).first()["class"] == "a"


def test_fusion_hangs_on_no_order_of_rows(spark, tmp_path):
    """the mean of these discounts is a tie at the fifth decimal, which a sum of doubles misses."""
    discounts = [9, 8, 4, 5, 5, 5, 1, 4, 3, 9, 7, 2, 9, 8, 1, 5]
    rows = [(1, 1, "A", x / 100) for x in discounts] + [(2, 1, "A", x / 100) for x in sorted(discounts)] + [(2, 3, "N", None)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_returnflag string, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.entity: r.confidence for r in REGISTRY["r30_signal_fusion"].run(spark, str(tmp_path)).collect()}
    assert got == {"1": 0.5313, "2": 0.5313}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'; CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    assert dict(con.execute(f"SELECT entity, confidence FROM ({REGISTRY['r30_signal_fusion'].sql})").fetchall()) == got


def test_twenty_index_rows_a_fingerprint(spark):
    """op4: the index had 66 rows a fingerprint, which went over the disk twice."""
    from episodica.llm import simhash

    fps = spark.range(50).select(F.xxhash64("id").alias("fp"))
    assert simhash._index(fps).count() == 50 * 20
    # three bits in any three blocks leave three blocks alike
    assert all(any(not (1 << a | 1 << b | 1 << c) & m for m in simhash.KEPT) for a in range(64) for b in range(a) for c in range(b))


def test_snap_asks_a_place_once(spark):
    """copies of a place met each other pair by pair; crowded cells go by smaller steps first, with the same rows."""
    rng = random.Random(3)
    place = lambda n: [(37 + rng.random() / 50, 55 + rng.random() / 100) for _ in range(n)]
    objects = [(i, *p, i % 5 != 0) for i, p in enumerate(place(300) + [(37.005, 55.005)] * 40)]
    points = [(i, *p) for i, p in enumerate(place(60) + [(37.005, 55.0051)] * 40)] + [(200, None, 55.0), (201, 37.5, 55.5)]
    p, o = spark.createDataFrame(points, "point_id long, lon double, lat double"), spark.createDataFrame(objects, "object_id long, lon double, lat double, in_service boolean")
    pairs = p.crossJoin(o.where("in_service").select("object_id", F.col("lon").alias("x"), F.col("lat").alias("y"))).withColumn("m", geo.haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))).where("m <= 500")
    want = {r.point_id: r.b.object_id for r in pairs.groupBy("point_id").agg(F.min(F.struct("m", "object_id")).alias("b")).collect()}
    for crowd in (1, 16, 1000):
        got = {r.point_id: r.object_id for r in geo.snap(p, o, 500, crowd=crowd).collect()}
        assert len(got) == 102 and {k: v for k, v in got.items() if v is not None} == want
    assert want[60] == 301  # the smallest in service of forty at one place


def test_no_sliding_frame_counts_trailing_events(spark):
    """a sliding frame counts anew for each row, and a neighbourhood stood in one task."""
    rng = random.Random(4)
    T = 1_704_067_200_000_000
    asks = [(i, rng.choice(["a", "b", None]), T + rng.randrange(40) * 43_200_000_000) for i in range(80)]
    events = [(rng.choice(["a", "c", None]), T + rng.randrange(40) * 43_200_000_000) for _ in range(90)]
    a = spark.createDataFrame(asks, "id long, k string, us long").withColumn("t", F.timestamp_micros("us"))
    e = spark.createDataFrame(events, "k string, us long").select("k", F.timestamp_micros("us").alias("s"))
    out = labels.trailing_counts(a, e, "k", "t", "s", {"n2": 2, "n9": 9})
    got = {r.id: (r.n2, r.n9) for r in out.collect()}
    count = lambda k, t, n: sum(k is not None and x == k and t - n * 86_400_000_000 < s <= t for x, s in events)
    assert got == {i: (count(k, t, 2), count(k, t, 9)) for i, k, t in asks} and any(x for x, _ in got.values())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "-172799999999" not in plan and "_piece" in plan


def test_events_meet_no_permits(spark):
    """F8: each event was joined with all permits of its place and day."""
    rng = random.Random(8)
    T, M = 1_704_067_200_000_000, 60_000_000
    permits = []
    for i in range(120):
        a = T + rng.randrange(3000) * M
        permits.append((i, rng.choice([1, 2, None]), rng.choice([1, 2, 3, None]), rng.choice(["welding", "gas", "electric", None]), a, a + rng.randrange(-30, 300) * M, rng.choice([0, 1, 3, None])))
    events = [(i, rng.choice([1, 2, 3, 4, None]), T + rng.randrange(4500) * M) for i in range(150)]
    p = spark.createDataFrame(permits, "permit_id long, location_id int, adjacent_location_id int, work_type string, a long, b long, crew int").withColumns({"actual_from": F.timestamp_micros("a"), "actual_to": F.timestamp_micros("b")})
    e = spark.createDataFrame(events, "event_id long, location_id int, us long").withColumn("t", F.timestamp_micros("us"))
    out = PM.permit_features(e, p)
    assert "_day" not in out._jdf.queryExecution().analyzed().toString()
    for r in out.collect():
        _, at, t = events[r.event_id]
        met = [(own, w, max(0, (t - b) / M), 1 if crew is None else crew) for _, l, n, w, a, b, crew in permits for own, x in ((True, l), (False, n)) if at is not None and x == at and a <= t and max(0, (t - b) / M) <= 1440]
        own = [m[1:] for m in met if m[0]]
        now = [m for m in own if m[1] == 0]
        want = (any(m[0] == "welding" for m in now), any(m[0] == "welding" and m[1] <= 30 for m in own), any(m[0] == "welding" and m[1] <= 240 for m in own), any(m[1] == "welding" and m[2] == 0 for m in met if not m[0]),
                bool(now), any(m[0] == "gas" for m in now), len(now), sum(m[2] for m in now), min((m[1] for m in own), default=None))
        assert (r.hot_now, r.hot_30m, r.hot_4h, r.hot_adjacent, r.any_now, r.gas_now, r.permits_now, r.crew_now, r.minutes_since) == want


def test_keys_of_late_streams_share_their_state(spark, sf):
    """each key had several calls between Python and the JVM in every batch; now a bucket of keys has them."""
    from episodica.streaming import settled

    assert settled.BUCKETS == 1024
    stream = spark.readStream.schema("channel_id long, read_time timestamp, journal_id long, value_text string").parquet("/tmp")
    plan = settled.late_episodes(stream, ("error",))._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan
