"""Run summaries on hot channels, pushed ranges, bounded listings and recursion, against the plain operators and by their plans."""

import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from episodica.operators import episodes as E
from episodica.operators import joins as J
from episodica.operators import listing as Q
from episodica.operators import rollup as A
from episodica.operators import summaries as S
from episodica.queries.base import stamp
from episodica.queries.domain import shared_folder

START, HOUR = 1_704_067_200_000_000, 3_600_000_000


def random_journal(spark, seed, rows, channels, hours, step):
    rng = random.Random(seed)
    made = [(k, START + rng.randrange(hours * HOUR // step) * step, rng.choice(channels), rng.choice([1, 2]), rng.choice(["error", "error", "error", "alarm", "ok"])) for k in range(rows)]
    made += rng.choices(made, k=rows // 10)  # exact duplicates
    return spark.createDataFrame(made, "journal_id long, at long, channel_id long, section_id int, value_text string").withColumn("read_time", F.timestamp_micros("at")).drop("at").repartition(4)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("hours,step", [(1, HOUR), (6, HOUR // 4), (24, HOUR // 60), (1000, HOUR)])
def test_episodes_by_pieces_equal_episodes(spark, hours, step):
    """Ties in time, runs over many pieces, empty pieces, one piece for all."""
    j = random_journal(spark, hours, 900, [1, 1, 1, 1, 1, 2, 3], 300, step)
    predicates = {"a": F.col("value_text") == "error", "b": F.col("value_text").isin("error", "alarm"), "never": F.lit(False)}
    columns = ["predicate", "channel_id", "section_id", "started_at", "ended_at", "rows_cnt", "fault_value", "closed_by"]
    want = rows(E.episodes(j, predicates), columns)
    assert rows(S.episodes_by_pieces(j, predicates, piece=S.piece_of("read_time", hours)), columns) == want and want
    cut = stamp("2024-01-04")
    assert rows(S.episodes_by_pieces(j, predicates, piece=S.piece_of("read_time", hours), ts_to=cut), columns) == rows(E.episodes(j, predicates, ts_to=cut), columns)


def test_incidents_by_pieces_equal_incidents(spark):
    rng = random.Random(3)
    made = [(rng.choice(["a", "a", "a", "b", None]), START + rng.randrange(400) * HOUR // 4) for _ in range(500)]
    events = spark.createDataFrame(made, "grp string, at long").withColumn("t", F.timestamp_micros("at"))
    columns = ["grp", "first_at", "last_at", "events"]
    for minutes in (0, 15, 45, 600):
        for hours in (1, 5, 24):
            assert rows(S.merge_incidents_by_pieces(events, "grp", "t", minutes, S.piece_of("t", hours)), columns) == rows(E.merge_incidents(events, "grp", "t", minutes), columns)


def test_empty_journal(spark):
    j = random_journal(spark, 1, 30, [1], 3, HOUR).limit(0)
    assert S.episodes_by_pieces(j, {"a": F.lit(True)}).collect() == []


def test_a_hot_channel_is_spread(spark):
    """Nine of ten rows in one channel: no task holds over twice the median, as pieces are dealt, not channels."""
    j = spark.range(90_000).select(F.lit(1).alias("channel_id"), F.timestamp_micros(F.lit(START) + F.col("id") * 30_000_000).alias("read_time")).unionByName(
        spark.range(10_000).select((F.col("id") % 50 + 2).cast("int").alias("channel_id"), F.timestamp_micros(F.lit(START) + F.col("id") * 270_000_000).alias("read_time")))
    dealt = j.withColumn("_piece", S.piece_of("read_time", 1)).repartition(8, "channel_id", "_piece").groupBy(F.spark_partition_id()).count().collect()
    sizes = [r["count"] for r in dealt]
    assert len(sizes) == 8 and max(sizes) < 2 * statistics.median(sizes)
    plan = S.episodes_by_pieces(j.withColumns({"journal_id": F.monotonically_increasing_id(), "value_text": F.lit("x"), "section_id": F.lit(1)}), {"a": F.lit(True)})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # windows without the piece stand over summaries of pieces and over border runs alone
    assert any("_piece" in w for w in windows)


@pytest.fixture(scope="module")
def by_day(spark):
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    j = random_journal(spark, 9, 3000, [1, 2, 3, 4, 5], 24 * 40, HOUR // 60)
    j.dropDuplicates(["journal_id"]).withColumn("day", F.to_date("read_time")).repartition("day").write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def scans(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "20000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_exact_counts_read_the_cut_days_alone(spark, by_day):
    at = stamp("2024-02-05 13:20:00")
    days = A.channel_daily(by_day, F.lit(False), F.lit(False))
    raw = A.exact_counts(spark.createDataFrame([], "channel_id long, day date, total long"), by_day, "channel_id", at, (3, 10), partition="day")
    (scan,) = scans(raw)
    assert "PartitionFilters: []" not in scan and "2024-02-05" in scan and "2024-01-26" in scan and "PushedFilters: [Or(" in scan
    got = A.exact_counts(days, by_day, "channel_id", at, (3, 10), partition="day")
    inside = lambda n: F.count_if((F.col("read_time") > F.timestamp_add("DAY", F.lit(-n), at)) & (F.col("read_time") <= at))
    want = by_day.groupBy("channel_id").agg(inside(3).alias("last_3"), inside(10).alias("last_10"))
    assert rows(got, ["channel_id", "last_3", "last_10"]) == rows(want, ["channel_id", "last_3", "last_10"])
    # without a day column the time's own statistics serve
    plain = A.exact_counts(spark.createDataFrame([], "channel_id long, day date, total long"), by_day.drop("day"), "channel_id", at, (3,))
    assert "PushedFilters: [Or(" in scans(plain)[0]


def test_bounded_listing_prunes_both_inputs(spark, by_day):
    external = spark.createDataFrame([(START + 24 * HOUR * 8, 1, "x", 1), (START + 24 * HOUR * 8, 2, "y", 2), (START, 3, "z", 1)], "at_us long, source_id long, text string, section_id int")
    external = external.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")
    ask = {"alarm": F.col("value_text") == "error", "normal": F.col("value_text") == "ok", "first": "2024-01-08 00:00:00", "last": "2024-01-15 00:00:00"}
    got = Q.technical_events(by_day, external, section_id=1, partition="day", **ask)
    found = scans(got)
    assert len(found) >= 3 and all("2024-01-08" in s and "2024-01-14" in s and "PartitionFilters: []" not in s and "GreaterThanOrEqual(read_time" in s for s in found)
    j = [r for r in by_day.collect() if "2024-01-08" <= str(r.read_time) < "2024-01-15"]
    alarms = [r for r in j if r.value_text == "error" and r.section_id == 1]
    calm = set()
    for a in alarms:
        later = sorted((r.read_time, r.journal_id) for r in j if r.value_text == "ok" and r.channel_id == a.channel_id and r.read_time > a.read_time)
        calm |= {later[0]} if later else set()
    events = {(r.kind, r.source_id) for r in got.collect()}
    assert events == {("alarm", a.journal_id) for a in alarms} | {("normal", i) for _, i in calm} | {("external", 1)}
    assert {r.kind for r in Q.technical_events(by_day, external, kind="alarm", **ask).collect()} == {"alarm"}
    assert len(scans(Q.technical_events(by_day, external, kinds=["external"], **ask))) == 0
    for first, last in (("2024-01-01", "2024-02-02"), ("2024-01-05", "2024-01-05")):
        with pytest.raises(ValueError, match="range"):
            Q.technical_events(by_day, external, **(ask | {"first": first, "last": last}))


def test_recursive_paths_build_without_a_job(spark):
    tree = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (9, 8, "lost")], "object_id long, parent_id long, name string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    out = J.recursive_paths(tree)
    assert not tracker.getJobIdsForGroup("building")
    assert {(r.path, r.level) for r in out.collect()} == {("r", 1), ("r/a", 2), ("r/a/b", 3)}
    cycle = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (2, 3, "a"), (3, 2, "b")], "object_id long, parent_id long, name string")
    with pytest.raises(Exception, match="deeper than 5 levels or has a cycle"):
        J.recursive_paths(cycle, depth=5).collect()


def test_weibull_by_newton_equals_plain(spark):
    """Many groups at once, a group with most lives, a null group, equal lives, too few failures, odd rows."""
    import numpy as np

    from episodica.operators import reliability as B

    rng = np.random.default_rng(4)
    made = [("hot", float(t), int(f)) for t, f in zip(rng.weibull(1.3, 3000) * 9, rng.random(3000) < 0.6)]
    made += [(g, float(t), int(f)) for g, beta in (("a", 0.4), ("b", 6.0), (None, 2.0), ("", 3.0)) for t, f in zip(rng.weibull(beta, 200) * 5 + 1e-6, rng.random(200) < 0.8)]
    made += [("same", 2.0, 1)] * 5 + [("one", 3.0, 1), ("one", 4.0, 0), ("none", 5.0, 0), ("a", 0.0, 1), ("a", None, 1), ("a", -1.0, 1)]
    got = {r.grp: r for r in B.weibull(spark.createDataFrame(made, "grp string, ttf double, failed int").repartition(4)).collect()}
    assert set(got) == {"hot", "a", "b", None, "", "same", "one", "none"}
    for g in ("hot", "a", "b", None, ""):
        t, f = (np.array(x) for x in zip(*[(t, f) for k, t, f in made if k == g and t is not None and t > 0]))
        logs, b = np.log(t / t.max()), 1.0
        slope = lambda b: (np.exp(b * logs) * logs).sum() / np.exp(b * logs).sum() - 1 / b - logs[f == 1].mean()  # noqa: B023, E731
        lo, hi = 0.01, 50.0
        for _ in range(100):
            lo, hi = (b, hi) if slope(b := (lo + hi) / 2) < 0 else (lo, b)
        eta = t.max() * (np.exp(b * logs).sum() / f.sum()) ** (1 / b)
        assert got[g].beta == pytest.approx(b, rel=1e-9) and got[g].eta == pytest.approx(eta, rel=1e-9) and (got[g].n, got[g].failures) == (len(t), f.sum())
    assert got["same"].beta == 20.0 and got["one"].beta is None and got["none"].eta is None and got["none"].failures == 0


def test_orders_against_works_and_collectors(spark):
    from episodica.operators import quality as D

    orders = spark.createDataFrame([("w:1",), ("w:2",), ("w:3",), (None,)], "source_key string")
    works = spark.createDataFrame([("w:1",), ("w:3",), ("w:3",), (None,), ("w:9",)], "source_key string")
    assert {tuple(r) for r in D.works_not_one(orders, works).collect()} == {("w:2", 0), ("w:3", 2), (None, 0)}
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    stamped = lambda rows, c: spark.createDataFrame(rows, f"k string, t string").select(F.col("k").alias(c[0]), F.col("t").cast("timestamp").alias(c[1]))  # noqa: E731, F541
    warnings = stamped([("p1", at(5)), ("p2", at(5)), ("p3", at(5)), ("p4", at(5)), ("lost", at(5))], ("prefix", "opened_at"))
    bridge = spark.createDataFrame([("p1", "a"), ("p1", "a"), ("p2", "b"), ("p3", "c"), ("p4", "d")], "prefix string, collector string")
    made = stamped([("a", at(1)), ("a", at(5)), ("b", at(4)), ("d", at(9))], ("collector", "created_at"))
    assert {r.collector for r in D.collectors_without_order(warnings, bridge, made).collect()} == {"b", "c", None}


def test_risk_matrix(spark):
    from episodica.operators import anomaly as N

    rows = spark.createDataFrame([(1.0, 1.0), (4.0, 4.0), (2.0, 2.0), (3.0, 3.0), (4.0, 2.0), (None, 2.0), (0.0, 1.0), (0.5, 0.5)], "pof double, cof double")
    got = [(r.risk, r["rank"], r.zone, r.inspect_months) for r in N.risk_matrix(rows).collect()]
    # 36 / 16 = 2.25: halves go to the even digit
    assert got == [(1.0, 1, "green", 36.0), (16.0, 4, "red", 2.2), (4.0, 1, "green", 9.0), (9.0, 3, "orange", 4.0), (8.0, 2, "yellow", 4.5), (None, None, None, None), (0.0, 1, "green", None), (0.25, 1, "green", 60.0)]
