"""Alert matching, threshold curves and cards against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from episodica.operators import joins, listing, metrics, quality

T0 = datetime(2024, 1, 1)


def plain_match(alerts, failures, low, high):
    """tp, fn, fp, dup and leads: each failure in order takes the latest unused alert in its window."""
    fits = lambda a, f: low <= f - a and (high is None or f - a <= high)
    used, leads = set(), []
    for f in sorted(failures):
        free = [(a, -i) for i, a in enumerate(alerts) if i not in used and fits(a, f)]
        if free:
            a, i = max(free)
            used.add(-i)
            leads.append(float(f - a))
    seen = sum(any(fits(a, f) for f in failures) for a in alerts)
    return len(leads), len(failures) - len(leads), len(alerts) - seen, seen - len(leads), leads


@pytest.mark.parametrize(("low", "high"), [(24, 72), (0, 10), (5, None)])
def test_matching_equals_plain_matching(spark, low, high):
    rng = random.Random(low)
    sides = {o: ([rng.randrange(300) for _ in range(rng.randrange(40))], [rng.randrange(300) for _ in range(rng.randrange(25))]) for o in range(30)}
    frame = lambda side: spark.createDataFrame([(o, T0 + timedelta(hours=h)) for o, s in sides.items() for h in s[side]], "object_id int, t timestamp")
    got = {r.object_id: r for r in metrics.match_alerts(frame(0), frame(1), low_hours=low, high_hours=high).collect()}
    assert set(got) == {o for o, (a, f) in sides.items() if a or f}
    for o, r in got.items():
        assert (r.tp, r.fn, r.fp, r.dup, r.leads) == plain_match(*sides[o], low, high)
        assert (r.alerts, r.failures) == tuple(map(len, sides[o]))


def test_matching_of_nothing_and_of_rows_without_object(spark):
    none = spark.createDataFrame([], "object_id string, t timestamp")
    assert metrics.match_alerts(none, none).count() == 0
    lost = spark.createDataFrame([(None, T0), ("a", T0)], "object_id string, t timestamp")
    assert [(r.object_id, r.alerts, r.fp) for r in metrics.match_alerts(lost, none).collect()] == [("a", 1, 1)]


@pytest.mark.parametrize("values", [20, 5000])
def test_threshold_curve_equals_plain_ranking(spark, values):
    rng = random.Random(values)
    rows = [(float(rng.randrange(values)), rng.randrange(2)) for _ in range(3000)]
    wanted = (1, 7, 100, 1500, 3000, 3001)
    got = {r.wanted: r for r in metrics.threshold_curve(spark.createDataFrame(rows, "score double, label int"), wanted).collect()}
    assert sorted(got) == [1, 7, 100, 1500, 3000]
    down = sorted((s for s, _ in rows), reverse=True)
    for n, r in got.items():
        last = down[n - 1]
        lower = max((s for s in down if s < last), default=None)
        assert r.threshold == (last if lower is None else (last + lower) / 2)
        assert r.alerts == sum(s >= last for s in down) and r.tp == sum(y for s, y in rows if s >= last)
        one = metrics.threshold_for(spark.createDataFrame(rows, "score double, label int"), n).first() if n in (7, 3000) else r
        assert (one.threshold, one.alerts) == (r.threshold, r.alerts)


def test_cards_of_empty_tables(spark):
    obs = spark.createDataFrame([], "observed_at timestamp, is_forecast boolean, fetched_at timestamp, temp_c double")
    r = listing.last_observation(obs, F.lit("2024-01-01").cast("timestamp"), ["observed_at", "temp_c"]).first()
    assert (r.observed_at, r.fetched_at, r.stale) == (None, None, True)
    orders = spark.createDataFrame([], "order_id long, object_id long, due_at timestamp, reason string, forecast_id long")
    ids = spark.createDataFrame([], "order_id long, forecast_id long")
    assert quality.completeness(orders, ids, ids).first().ok is False
    full = spark.createDataFrame([(1, 2, T0, "why", 3)], orders.schema)
    assert quality.completeness(full, spark.createDataFrame([(1, 3)], ids.schema), spark.createDataFrame([(1, 3)], ids.schema)).first().ok is True


def test_a_repeated_mapping_fans_out_once(spark):
    alerts = spark.createDataFrame([(1, "p"), (2, "q")], "id int, prefix string")
    mapping = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("q", None)], "prefix string, collector string")
    assert sorted((r.id, r.collector) for r in joins.fan_out(alerts, mapping, "prefix", "collector").collect()) == [(1, "a"), (1, "b")]
