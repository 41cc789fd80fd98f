"""Hand-made situations with known answers."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from episodica.functions import clean, geo
from episodica.operators import anomaly as N
from episodica.operators import episodes as E
from episodica.operators import joins as J
from episodica.operators import labels as L
from episodica.operators import metrics as M
from episodica.operators import reliability as B
from episodica.operators import risk as R
from episodica.sources import journal as S
from episodica.streaming import live as T

T0 = datetime(2026, 1, 1)


def at(hours=0.0, **more):
    return T0 + timedelta(hours=hours, **more)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rejects_by_reason(spark):
    head = "journal_id string, channel_id string, day string, time string, is_alarm string, value string"
    rows = [
        ("1", "7", "2026-01-01", "10:00:00", "t", "25,40"), ("ид_события", "ид_канала_данных", "дата", None, None, None), ("2", "7", "2026-01-02", None, "", "Норма"), ("3", None, None, None, None, None),
        ("x", "7", "2026-01-01", "10:00:00", "f", "1"), ("4", "7", "01.02.2026", "10:00:00", "f", "1"), ("5", "7", "2026-01-01", "10:00:00", "perhaps", "1"),
    ]
    out = S.validate(spark.createDataFrame(rows, head))
    assert {r.reject: r.rows for r in S.reject_counts(out).collect()} == {"repeated header": 1, "short row": 1, "id is no number": 1, "time not parsed": 1, "flag not parsed": 1}
    good = {r.journal_id: r for r in S.good_rows(out).collect()}
    assert good[1].value_num == 25.4 and good[1].read_time == datetime(2026, 1, 1, 7) and good[2].value_num is None and good[2].read_time == datetime(2026, 1, 1, 21)


def test_headers(spark):
    assert S.map_headers(["Ид_События", "ид_канала_данных", "Дата", "", "Unnamed: 4"]) == {"Ид_События": "journal_id", "ид_канала_данных": "channel_id", "Дата": "day"}
    for bad in (["ид_события", "дата"], ["ид_события", "ид_канала_данных", "дата", "colour"]):
        with pytest.raises(ValueError):
            S.map_headers(bad)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ид_события,ид_канала_данных,дата,время,тревожное,значение_датчика\n1,7,2026-01-01,10:00:00,t,5\n2,7,2026-01-01,11:00:00,да,Норма\n")
    rows = S.validate(S.read_csv(spark, f"file://{tmp_path}/*.csv"))
    assert [(r.journal_id, r.is_alarm, r.value_text) for r in rows.orderBy("journal_id").collect()] == [(1, True, "5"), (2, True, "Норма")]
    report = S.load_report(rows).first()
    assert (report.planned, report.loaded, report.failed) == (2, 2, 0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\x01b", None), (2, None, 1.5)], "id int, s string, x double")
    S.write_xml(df, f"file://{tmp_path}/x", "row")
    assert spark.read.format("xml").option("rowTag", "row").load(f"file://{tmp_path}/x").where("s = 'ab'").count() == 1
    S.write_sorted(df, f"file://{tmp_path}/p", ["id"])
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 2
    assert S.as_json(df).where("json like '%\"x\":null%'").count() == 1


@pytest.mark.parametrize("text,want", [("25,40", 25.4), ("Норма", None), ("", None), ("01.01.1970 03:00:00", None), ("nan", None), ("inf", None), ("1_0", None), ("1d", None), (" -3.5e2 ", -350.0), (None, None)])
def test_numbers(spark, text, want):
    assert one(spark, clean.parse_number(F.lit(text).cast("string"))).asDict().popitem()[1] == want


@pytest.mark.parametrize("name,picket,metres", [("КД АВ ПК106 ур.3", 106, 1060.0), ("ПК588-ПК591", 588, 5880.0), ("пк 8", 8, 80.0), ("ПК176+6,5", 176, 1766.5), ("ОД АВ 185+5", 185, None), ("ДД каб.201+201А", None, None)])
def test_places(spark, name, picket, metres):
    r = one(spark, clean.picket_of(F.lit(name)).alias("p"), clean.linear_metres(F.lit(name)).alias("m"))
    assert (r.p, r.m) == (picket, metres)


def test_location_kinds(spark):
    cases = [("847-11.1.", "ПК1", None, "section"), ("15-11.1.4096.4095.", "Шкаф", None, "zone"), ("1-2.", "[Охранная зонаКоллектор", "controlHouse", "zone"), ("1-2.", "Дверь", "controlHouse", "building"), ("1-2.", "Дверь", None, "unknown")]
    for tag, name, kind, want in cases:
        assert one(spark, clean.location_kind(F.lit(tag), F.lit(name), F.lit(kind).cast("string")).alias("k")).k == want


def test_kind_names(spark):
    kinds = spark.createDataFrame([("Датчик ЗАТОПЛЕНИЯ",)], "kind string")
    rows = spark.createDataFrame([("  Датчик   затоплениЯ ",), ("ДAтчик зATOплEния",), ("другое",)], "x string")
    assert [r.k for r in clean.canonical_kind(rows, "x", kinds, "kind", "k").collect()].count("Датчик ЗАТОПЛЕНИЯ") == 2


@pytest.mark.parametrize("text,want", [("0", "valid"), ("15", "valid"), ("-0.1", "negative"), ("15.1", "above"), ("NaN", "nonfinite"), ("Норма", "text")])
def test_methane(spark, text, want):
    assert one(spark, clean.methane_quality(F.lit(text)).alias("q")).q == want


def journal(spark, rows):
    return spark.createDataFrame([(i, at(h), c, 1, w) for i, (c, h, w) in enumerate(rows)], "journal_id long, read_time timestamp, channel_id int, section_id int, value_text string")


def fold(rows, words, end):
    """Plain fold with the same rule."""
    out = []
    for c in sorted({r[0] for r in rows}):
        start = None
        for _, h, w in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            if w in words and start is None:
                start = (h, w)
            elif w not in words and start is not None:
                out.append((c, start[0], h, start[1], w))
                start = None
        if start is not None:
            out.append((c, start[0], None, start[1], None))
    return sorted(x for x in out if (end if x[2] is None else x[2]) - x[1] > 1)


def test_episodes(spark):
    rows = [(1, 0, "bad"), (1, 1, "worse"), (1, 3, "ok"), (1, 4, "bad"), (1, 5, "ok"), (2, 0, "bad"), (3, 0, "ok"), (3, 2, "bad"), (3, 3.5, "0.5"), (4, 1, "ok"), (4, 0, "bad"), (5, 0, "bad"), (5, 0.5, "ok"), (5, 0.6, "bad"), (5, 0.7, "ok")]
    random.Random(3).shuffle(rows)
    found = E.episodes(journal(spark, rows), {"w": F.col("value_text").isin("bad", "worse")})
    found = E.long_episodes(found, F.lit(at(10)), F.lit(3600)).collect()
    hours = lambda t: None if t is None else (t - T0).total_seconds() / 3600
    got = sorted((r.channel_id, hours(r.started_at), hours(r.ended_at), r.fault_value, r.closed_by) for r in found)
    assert got == fold(rows, ("bad", "worse"), 10) and (5, 0.0) not in {g[:2] for g in got}


def test_random_episodes_equal_the_fold(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(6), h / 7, rng.choice(["ok", "bad", "worse", "1"])) for h in range(400)]
    found = E.long_episodes(E.episodes(journal(spark, rows), {"w": F.col("value_text").isin("bad", "worse")}), F.lit(at(58)), F.lit(3600)).collect()
    assert sorted((r.channel_id, round((r.started_at - T0).total_seconds())) for r in found) == sorted((c, round(s * 3600)) for c, s, *_ in fold(rows, ("bad", "worse"), 58))


def test_duplicate_rows_do_not_stretch_episodes(spark):
    j = journal(spark, [(1, 0, "bad"), (1, 0.1, "ok"), (1, 9, "ok")])
    found = E.episodes(j.unionByName(j), {"w": F.col("value_text") == "bad"}).collect()
    assert len(found) == 1 and found[0].rows_cnt == 1 and found[0].ended_at == at(0.1)


def test_incidents(spark):
    def count(rows, minutes=10):
        df = spark.createDataFrame([(g, at(h)) for g, h in rows], "g string, t timestamp")
        return E.merge_incidents(df, "g", "t", minutes).count()

    assert count([("a", 0)] * 25) == 1
    assert count([("a", 0), ("b", 0)]) == 2
    assert count([("a", i / 10) for i in range(4)]) == 1
    assert count([("a", 0), ("a", 0.5)]) == 2
    assert count([("a", 0), ("a", 1 / 6)]) == 1  # ten minutes exactly
    keys = spark.createDataFrame([(None, 1), (None, 2), (7, 3)], "node int, ch int").select(E.group_key(F.col("node"), F.col("ch")).alias("k"))
    assert {r.k for r in keys.collect()} == {"ch:1", "ch:2", "obj:7"}


def match_fold(alerts, failures, low, high):
    """Plain greedy matching."""
    used, seen, leads = set(), set(), []
    fn = 0
    for o, f in sorted(failures, key=lambda x: x[1]):
        fit = [(a, i) for i, (p, a) in enumerate(alerts) if p == o and low <= f - a and (high is None or f - a <= high)]
        seen |= {i for _, i in fit}
        fit = [x for x in fit if x[1] not in used]
        if not fit:
            fn += 1
            continue
        a, i = max(fit, key=lambda x: x[0])
        used.add(i)
        leads.append(f - a)
    return len(leads), fn, len(alerts) - len(seen), len(seen) - len(used), sorted(leads)


def matched(spark, alerts, failures, low, high):
    df = lambda x: spark.createDataFrame([(o, at(h)) for o, h in x], "object_id string, t timestamp")
    return M.match_alerts(df(alerts), df(failures), low_hours=low, high_hours=high)


def test_alert_matching(spark):
    rng = random.Random(2)
    alerts = [(f"o{rng.randrange(5)}", float(h)) for h in rng.sample(range(400), 60)]
    failures = [(f"o{rng.randrange(6)}", float(h)) for h in rng.sample(range(400), 40)]
    for low, high in ((24, None), (24, 72), (0, 48)):
        got = matched(spark, alerts, failures, low, high)
        s = M.summarise(got, object_days=2000).first()
        tp, fn, fp, dup, leads = match_fold(alerts, failures, low, high)
        assert (s.tp, s.fn, s.fp, s.dup) == (tp, fn, fp, dup) and s.alerts == tp + fp + dup
        assert abs(s.median_lead - median(leads)) < 1e-6 and abs(s.false_per_1000 - fp / 2) < 1e-9


def test_matching_takes_the_latest_alert(spark):
    s = M.summarise(matched(spark, [("a", 0), ("a", 24), ("b", 0), ("c", 5)], [("a", 72), ("b", 10), ("d", 9)], 24, None), object_days=2000).first()
    assert (s.tp, s.fn, s.fp, s.dup, s.median_lead, s.false_per_1000) == (1, 2, 2, 1, 48.0, 1.0)


def test_verdict_is_strict(spark):
    s = spark.createDataFrame([(0.7, 0.6, 36.0, 0.2), (0.7001, 0.6, 36.0, 0.2), (0.9, 0.6, 36.0, 0.333)], "precision double, recall double, median_lead double, under_24h double")
    assert [r.passed for r in M.verdict(s, 0).collect()] == [False, True, False]
    assert [r.passed for r in M.verdict(s, 24).collect()] == [False, True, True]


def test_recency(spark):
    f = spark.createDataFrame([(1, at(0), False, None), (2, at(0, seconds=-1), False, None), (3, at(-5), True, "plan")], "channel_id int, started_at timestamp, planned boolean, plan_text string")
    c = spark.createDataFrame([(1,), (2,), (3,)], "channel_id int")
    out = {r.channel_id: r for r in R.recency_rule(c, f, F.lit(at(1)), [(0, 24, 0.6), (24, None, 0.1)]).collect()}
    assert out[1].level_real == "normal" and out[2].level_real == "high" and out[3].level_real == "normal"
    assert [(x.kind, x.weight) for x in out[3].reasons] == [("plan", 0.0)]


def test_section_fold(spark):
    s = spark.createDataFrame([(1, 10, 0.019, "high"), (2, 10, 0.075, "watch"), (3, 10, 0.07, "watch"), (4, 10, 0.06, "watch"), (5, 10, 0.05, "watch")], "channel_id int, section_id int, score double, level string")
    out = {r.section_id: r for r in R.fold_sections(s, spark.createDataFrame([(10,), (11,)], "section_id int")).collect()}
    assert (out[10].channel_id, out[10].level, out[10].shown, out[10].more) == (1, "high", [1, 2, 3], 2)
    assert (out[11].score, out[11].level, out[11].more) == (0.0, "normal", 0)


def test_spread_and_ranks(spark):
    f = spark.createDataFrame([(i, 1, 0.8) for i in range(4)] + [(8, 2, 0.1), (9, 2, 0.2)], "section_id int, object_id int, probability double")
    w = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.15), (3, 0.1), (8, 0.5), (9, 0.5)], "section_id int, weight double")
    out = {r.section_id: r.spread for r in R.spread(f, w).collect()}
    assert abs(sum(out[i] for i in range(4)) - 0.8) < 1e-12 and (out[8], out[9]) == (0.1, 0.2)
    r = spark.createDataFrame([(1, "normal", 0.1, "gas"), (2, "normal", 0.9, "fire"), (3, "normal", 0.5, None), (4, "high", 0.01, None), (5, "normal", 0.5, "gas")], "section_id int, level string, probability double, system string").withColumn("run", F.lit(1))
    assert [x.section_id for x in R.risk_ranks(r, ["run"]).orderBy("risk_rank").collect()] == [4, 2, 5, 3, 1]


def test_write_policy_equals_its_stream_step(spark):
    rng = random.Random(4)
    rows = [(k, at(minutes=4 * i), min(1.0, max(0.0, 0.8 + rng.gauss(0, 0.03)))) for k in "ab" for i in range(80)]
    rows += [("c", at(minutes=4 * i), 0.1) for i in range(40)]
    got = R.write_policy(spark.createDataFrame(rows, "k string, t timestamp, p double"), "k", "t", "p").collect()
    want = []
    for k in "abc":
        state = None
        for _, t, p in (r for r in rows if r[0] == k):
            state, cls, why = T.policy_step(state, int((t - datetime(1970, 1, 1)).total_seconds() * 1e6), p, R.POLICY)
            want.append((k, t, cls, why))
    assert sorted((r.k, r.t, r.risk_class, str(r.reason)) for r in got) == sorted((k, t, c, str(w)) for k, t, c, w in want)
    assert {r.reason for r in got} == {"first", "change", "heartbeat", None}


def test_thinning(spark):
    rows = spark.createDataFrame([("a", at(h)) for h in (0, 0.5, 1, 1.2, 2.5)], "k string, t timestamp")
    assert sorted((r.t - T0).total_seconds() / 3600 for r in L.thin_repeats(rows, "k", "t", 60).collect()) == [0, 1, 2.5]


def test_horizon_edges(spark):
    m = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(10))], "k string, moment timestamp")
    e = spark.createDataFrame([("a", at(10))], "k string, t timestamp")
    out = {(r.moment - T0).total_seconds() / 3600: r.label for r in L.horizon_labels(m, e, "k", "t", 9).collect()}
    assert out == {0.0: 0, 1.0: 1, 10.0: 0}


def test_reliability(spark):
    rows = [("g", t, 1) for t in (300.0, 500.0, 700.0, 900.0, 1100.0)] + [("g", 1200.0, 0)] * 5
    lives = spark.createDataFrame(rows, "grp string, ttf double, failed int")
    fit = B.weibull(lives).first()

    def slope(b):
        import math

        s = [(t / 1200) ** b for _, t, _ in rows]
        return sum(x * math.log(t / 1200) for x, (_, t, _) in zip(s, rows)) / sum(s) - 1 / b - sum(math.log(t / 1200) for _, t, f in rows if f) / 5

    assert abs(slope(fit.beta)) < 1e-9 and abs(fit.eta - 1200 * (sum((t / 1200) ** fit.beta for _, t, _ in rows) / 5) ** (1 / fit.beta)) < 1e-6
    km = B.kaplan_meier(lives).orderBy("t").collect()
    assert [round(r.survival, 6) for r in km] == [0.9, 0.8, 0.7, 0.6, 0.5] and len(km) == 5
    chatter = spark.createDataFrame([("g", t, 1) for t in (1.0, 1.0, 1.0, 400.0)], "grp string, ttf double, failed int")
    assert B.predictability(chatter).first().k < 0


def test_outliers(spark):
    values = [560, 561, 560, 0, 562, 563, 700, 564, 564, 564, 564, 565]
    rows = spark.createDataFrame([("s", i, str(v)) for i, v in enumerate(values)] + [("z", 0, "560"), ("z", 1, "words"), ("z", 2, "600")], "sensor string, t long, value string")
    out = N.outlier_labels(rows, 534.5, 621.9, 20, 3)
    assert [r.label for r in out.where("sensor = 's'").orderBy("t").collect()] == [0, 0, 0, 1, 0, 0, 1, 3, 3, 3, 3, 0]
    assert [r.label for r in out.where("sensor = 'z'").orderBy("t").collect()] == [0, 4, 2]


def test_findings(spark):
    for temp, side, point, want in ((60.0, "high", 80.0, "none"), (73.0, "high", 80.0, "warn"), (81.0, "high", 80.0, "alarm"), (2.0, "low", 3.0, "alarm")):
        assert one(spark, N.absolute_finding(F.lit(temp), F.lit(point), side).alias("f")).f == want


def test_majority_takes_the_smallest_of_equals(spark):
    rows = spark.createDataFrame([("k", "b"), ("k", "b"), ("k", "a"), ("k", "a"), ("k", "c"), ("k", None)], "k string, v string")
    r = J.majority(rows, "k", "v").first()
    assert (r.v, r.n, r.lost) == ("a", 2, 3)


def test_tree_cycle_is_an_error(spark):
    tree = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b")], "object_id long, parent_id long, name string")
    assert {r.path for r in J.tree_paths(tree).collect()} == {"r", "r/a", "r/a/b"}
    with pytest.raises(ValueError):
        J.tree_paths(tree, depth=1)


def test_registry_faults(spark):
    c = spark.createDataFrame([(1, 10), (1, 10), (2, 99)], "channel_id int, section_id int")
    s = spark.createDataFrame([(10, 5)], "section_id int, collector_id int")
    k = spark.createDataFrame([(6, "x")], "collector_id int, name string")
    assert {(r.problem, r.id) for r in J.registry(c, s, k)[1].collect()} == {("repeated channel", "1"), ("channel without section", "99"), ("section without collector", "5")}


def test_geometry_text(spark):
    line = F.array(F.struct(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat")), F.struct(F.lit(1.5).alias("lon"), F.lit(2.5).alias("lat")))
    r = one(spark, geo.wkt(line).alias("w"), geo.geojson(line).alias("g"), geo.line_length(line).alias("m"))
    assert r.w == "LINESTRING(1.000000000 2.000000000, 1.500000000 2.500000000)" and r.g.startswith('{"type":"LineString"') and 78_000 < r.m < 79_000


def test_order_selection(spark):
    rows = [(1, None, None, "A", 0.98), (2, None, None, None, 0.98), (3, 7, 0.6, "B", 0.5), (4, 7, 0.4, "B", 0.49), (5, 8, 1.0, "C", 0.5)]
    s = spark.createDataFrame(rows, "section_id int, object_id int, weight double, criticality string, probability double")
    assert sorted(r.section_id for r in R.select_for_orders(s, {"A": 0.97, "B": 0.98, "C": 0.99}).collect()) == [1, 3]


def test_fitted_logistic_recovers_coefficients(spark):
    import math

    rng = random.Random(9)
    rows = [(x := rng.gauss(0, 2), y := rng.gauss(1, 1), int(rng.random() < 1 / (1 + math.exp(-(0.8 * x - 0.5 * y + 0.3))))) for _ in range(4000)]
    w, b = R.fit_logistic(spark.createDataFrame(rows, "x double, y double, label int"), ["x", "y"], c=100.0)
    assert abs(w["x"] - 0.8) < 0.12 and abs(w["y"] + 0.5) < 0.12 and abs(b - 0.3) < 0.15


def test_ingest_batch_is_idempotent(spark, tmp_path):
    chans = spark.createDataFrame([(1, 5)], "channel_id int, section_id int")
    rows = spark.createDataFrame([(1, at(0), 1), (1, at(0), 1), (2, at(1), 1), (3, at(1), 9)], "journal_id long, read_time timestamp, channel_id int")
    put = T.ingest_batches(chans, f"file://{tmp_path}/t", f"file://{tmp_path}/r")
    for batch in (0, 0, 1):
        put(rows, batch)
    got = {r.batch_id: (r.received, r.accepted, r.unknown, r.duplicates) for r in spark.read.parquet(f"file://{tmp_path}/r").collect()}
    assert got == {0: (4, 2, 1, 1), 1: (4, 0, 1, 3)} and spark.read.parquet(f"file://{tmp_path}/t").count() == 2
