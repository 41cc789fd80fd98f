"""The matched curve of one pass against matching anew at each threshold."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import metrics as M

HOUR = 3_600_000_000
SHAPE = "channel_id string, at long, score double"


def frame(spark, rows, shape=SHAPE):
    return spark.createDataFrame(rows, shape).withColumn("t", F.timestamp_micros("at"))


@pytest.mark.parametrize("seed", [1, 2])
def test_curve_equals_matching_anew(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("aaabc"), rng.randrange(300) * HOUR, rng.choice([rng.random(), round(rng.random(), 1)])) for _ in range(250)]
    failures = [(rng.choice("aaabd"), rng.randrange(300) * HOUR, None) for _ in range(60)]
    scores, fails = frame(spark, [*rows, (None, 1, 0.5), ("a", None, 0.5), ("a", 5, None)]), frame(spark, [*failures, (None, 5, None)])
    got = {r.threshold: r for r in M.matched_curve(scores, fails, low_seconds=3600, high_hours=30).collect()}
    assert len(got) > 20 and max(r.alerts for r in got.values()) == 250
    # a fresh matching for some thresholds, and the plain rule for all
    for threshold, r in got.items():
        alerts = sorted((k, t) for k, t, s in rows if s >= threshold)
        tp = fp = 0
        for k in "abcd":
            own, free = sorted(t for c, t in alerts if c == k), None
            free = list(own)
            fs = sorted(t for c, t, _ in failures if c == k)
            for f in fs:
                fit = [t for t in free if HOUR <= f - t <= 30 * HOUR]
                if fit:
                    free.remove(max(fit))
                    tp += 1
            fp += sum(not any(HOUR <= f - t <= 30 * HOUR for f in fs) for t in own)
        assert (r.alerts, r.tp, r.fn, r.fp, r.dup) == (len(alerts), tp, len(failures) - tp, fp, len(alerts) - fp - tp)
    some = sorted(got)[:: len(got) // 3]
    for threshold in some:
        m = M.match_alerts(scores.where((F.col("score") >= threshold) & F.col("t").isNotNull()), fails, key="channel_id", low_hours=1, high_hours=30)
        total = m.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "dup")]).first()
        assert (got[threshold].tp, got[threshold].fp, got[threshold].dup) == (total.tp, total.fp, total.dup)
    high, watch = M.choose_thresholds(spark.createDataFrame(list(got.values()))).first()
    rule = sorted(got.values(), key=lambda r: -r.threshold)
    best = max(rule, key=lambda r: (r.f1, r.precision, -r.alerts))
    assert high == best.threshold
    assert watch == min((r for r in rule if r.threshold <= high), key=lambda r: abs(r.alerts - 10 * best.alerts)).threshold


def test_numbers_of_alerts():
    counts = M.alert_counts(10**9)
    assert counts[0] == 20 and counts[-1] == 400_000 and len(counts) == 60 and M.alert_counts(5) == (5,) and M.alert_counts(0) == ()


def test_no_alerts_or_no_failures(spark):
    none, fails = frame(spark, []), frame(spark, [("a", 5, None)])
    assert [(r.alerts, r.tp, r.fn, r.fp) for r in M.matched_curve(none, fails).collect()] in ([], [(0, 0, 1, 0)])
    r = M.matched_curve(frame(spark, [("a", 5, 0.5)]), frame(spark, [])).first()
    assert (r.alerts, r.tp, r.fn, r.fp, r.f1) == (1, 0, 0, 1, 0.0)
