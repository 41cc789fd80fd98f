"""Rules against worked examples and plain Python: fusion, trends, write policy, snapping, live orders, status changes, year scans."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from episodica.operators import anomaly, quality, reliability, risk
from episodica.queries import REGISTRY
from episodica.sources import journal as sources
from episodica.streaming.live import policy_step

T0 = datetime(2024, 1, 1)


def test_fusion_counts_sources_that_point_to_the_top_class(spark):
    signals = spark.createDataFrame([("e", "s1", "a", 0.4), ("e", "s1", "b", 0.3), ("e", "s2", "a", 0.45), ("e", "s3", "b", 0.2)], "entity string, source string, class string, p double")
    weights = spark.createDataFrame([("s1", 0.6), ("s2", 0.5), ("s3", 0.4), ("s4", 1.0)], "source string, weight double")
    r = anomaly.fuse_signals(signals, weights).first()
    assert (r["class"], r.agreement, round(r.score, 2), round(r.confidence, 3), r.verdict, r.missing) == ("a", 2, 0.31, 0.465, "auto", ["s4"])
    assert anomaly.fuse_signals(signals, weights, auto=0.5).first().verdict == "human_review"
    assert anomaly.fuse_signals(signals, weights, least=3).first().verdict == "low_confidence"


def test_later_rows_do_not_change_a_trend(spark):
    rows = [("x", "k", T0 + timedelta(hours=h), v) for h, v in enumerate([0.0, 0.1, 0.2, 1.2])] + [("y", "k", T0 + timedelta(hours=h), 0.0) for h in range(4)]
    frame = lambda r: spark.createDataFrame(r, "element string, kind string, t timestamp, temp double")
    flags = lambda r: {(x.element, x.t): x.trend for x in anomaly.trend_finding(frame(r)).collect()}
    now = flags(rows)
    assert now[("x", T0 + timedelta(hours=3))] == "warn" and list(now.values()).count("warn") == 1
    later = flags(rows + [("x", "k", T0 + timedelta(hours=4), 50.0), ("y", "k", T0 + timedelta(hours=4), 90.0)])
    assert all(later[k] == v for k, v in now.items())


def test_peer_median_equals_plain_median(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", f"g{g}", float(rng.choice([1, 2, 3, 9, 20]))) for g in range(6) for i in range(g + 1)]
    out = anomaly.peer_finding(spark.createDataFrame(rows, "element string, grp string, temp double"), ["grp"]).collect()
    for r in out:
        others = sorted(t for e, g, t in rows if g == r.grp and e != r.element)
        n = len(others)
        want = None if n < 2 else r.temp - (others[(n - 1) // 2] + others[n // 2]) / 2
        assert (r.delta is None and want is None) or abs(r.delta - want) < 1e-9


def test_write_policy_equals_the_streaming_step(spark):
    rng = random.Random(5)
    policy = risk.POLICY | {"heartbeat_min": 14.0}
    rows = [(k, T0 + timedelta(minutes=7 * i), round(0.8 + rng.choice([-0.3, -0.021, -0.01, 0.0, 0.01, 0.021, 0.1]), 3)) for k in range(5) for i in range(40)]
    out = risk.write_policy(spark.createDataFrame(rows, "k int, t timestamp, p double"), "k", "t", "p", policy).collect()
    for k in range(5):
        state = None
        for r in sorted((r for r in out if r.k == k), key=lambda r: r.t):
            state, cls, why = policy_step(state, int((r.t - datetime(1970, 1, 1)).total_seconds() * 1e6), r.p, policy)
            assert (r.risk_class, r.reason) == (cls, why)
    assert {r.reason for r in out} == {"first", "change", "heartbeat", None}


def test_full_and_warning_reasons(spark):
    rows = spark.createDataFrame([(1, T0 + timedelta(minutes=i), 0.5, i == 2) for i in range(4)], "k int, t timestamp, p double, w boolean")
    reasons = lambda **kw: [r.reason for r in risk.write_policy(rows, "k", "t", "p", **kw).orderBy("t").collect()]
    assert reasons() == ["first", None, None, None] and reasons(warned="w") == ["first", None, "warning", None] and reasons(full_log=True, warned="w") == ["full"] * 4


def test_rule_weights_must_total_100(spark):
    rules = spark.createDataFrame([("a", 60.0), ("b", 40.0)], "rule string, weight double")
    fired = spark.createDataFrame([("e", "a"), ("f", "b"), ("f", "a")], "entity string, rule string")
    assert {r.entity: (r.percent, r.hits, r.misses) for r in anomaly.compliance(rules, fired).collect()} == {"e": (60.0, ["a"], ["b"]), "f": (100.0, ["a", "b"], [])}
    with pytest.raises(Exception, match="rule weights total"):
        anomaly.compliance(rules.where("rule = 'a'"), fired).collect()


def test_snap_equals_brute_force(spark, sf):
    """Every fiftieth customer by brute force; the query itself takes all of them."""
    out = {r.point_id: r.metres for r in REGISTRY["x2_snap"].run(spark, sf).collect()}
    customers = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    spots = [(37.0 + (k * 37 % 1000) / 5000, 55.0 + (k * 91 % 1000) / 9000) for k in (r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()) if k % 5]
    assert set(out) == set(customers)
    for c in customers:
        lon, lat = 37.0 + (c * 53 % 1000) / 5000, 55.0 + (c * 17 % 1000) / 9000
        metres = [2 * 6371008.8 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2))) for x, y in spots]
        near = [m for m in metres if m <= 500]
        assert (out[c] is None) == (not near) and (not near or abs(out[c] - min(near)) < 0.02)


def test_year_scan_reads_only_the_folders_of_its_bounds(spark, tmp_path):
    rows = spark.createDataFrame([(i, datetime(2020 + i % 4, 5, 1 + i % 20)) for i in range(80)], "ev int, ts timestamp").withColumn("year", F.year("ts"))
    rows.write.partitionBy("year").parquet(str(tmp_path / "j"))
    out = sources.read_years(spark, str(tmp_path / "j"), "2021-05-03", "2022-05-11")
    assert out.count() == rows.where("ts >= '2021-05-03' and ts <= '2022-05-11'").count() > 0
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_mean_life_of_a_fit(spark):
    rng = random.Random(1)
    lives = spark.createDataFrame([("g", rng.weibullvariate(10.0, 2.0), 1) for _ in range(4000)], "grp string, ttf double, failed int")
    r = reliability.weibull(lives).first()
    assert abs(r.beta - 2) < 0.1 and abs(r.eta - 10) < 0.3 and abs(r.mean_life - 10 * math.gamma(1.5)) < 0.3


def test_orders_per_warning(spark):
    warnings = spark.createDataFrame([("w1",), ("w2",), ("w3",)], "warning_key string")
    orders = spark.createDataFrame([("w1:1",), ("w1:2",), ("w3:9",)], "source_key string")
    assert {(r.warning_key, r.orders) for r in quality.order_counts(warnings, orders, 1).collect()} == {("w1", 2), ("w2", 0)}
