"""The flagship run, the section feature vector and the remaining single operators as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import anomaly as N
from ..operators import features as FV
from ..operators import labels as L
from ..operators import listing as Q
from ..operators import metrics as M
from ..operators import quality as D
from ..operators import risk as R
from ..operators import rollup as A
from ..operators.episodes import fault_rules
from ..plans.run import Settings, forecast_run
from .base import END, channels, journal, query, stamp, table, us
from .decisions import RECENCY, SCORES, TABLE, alerts_and_failures, matched, recency, scores, section_weights
from .journal import rule_episodes


def run(spark, sf):
    rules = spark.createDataFrame([(f"kind{i}", "error", 3600) for i in range(3)], "sensor_kind string, fault_value string, min_seconds int")
    plans = channels(spark, sf).where("channel_id % 2 = 0").select("channel_id", F.lit("sure").alias("match"), F.lit("2024-01-10").cast("date").alias("dismantle_from"), F.lit("2024-01-12").cast("date").alias("return_to"))
    w = section_weights(spark, sf).where("section_id % 4 = 0").select("section_id", "object_id", "weight")
    w = channels(spark, sf).select("section_id").distinct().join(w, "section_id", "left").withColumn("criticality", F.element_at(F.array(*map(F.lit, "ABC")), (F.col("section_id") % 3 + 1).cast("int")))
    return forecast_run(journal(spark, sf), channels(spark, sf), fault_rules(rules, rules), plans, w, stamp("2024-01-13 12:00:00"), Settings(tuple(TABLE)))


@query("forecast_run")
def flagship(spark, sf):
    return run(spark, sf)["sections"].drop("as_of", "shown")


@query("r21_order_selection")
def r21(spark, sf):
    return run(spark, sf)["orders"].select("section_id", "object_id", "probability", "source_key", us("due_at").alias("due"))


def features(spark, sf):
    at, rows, chans = stamp("2024-01-28 12:00:00"), journal(spark, sf), channels(spark, sf)
    rows = rows.where(F.col("read_time") <= at)
    age = F.datediff(F.to_date(at), F.to_date("read_time"))
    counts = rows.groupBy("section_id").agg(
        *[F.count_if(age < n).alias(f"readings_{n}d") for n in (1, 7, 30, 365)], *[F.count_if((age < n) & F.col("is_alarm")).alias(f"alarms_{n}d") for n in (7, 365)], F.max(F.to_date("read_time")).alias("last_day")
    )
    counters = FV.channel_counters(rows, at, F.col("value_text") == "error", F.col("value_text") == "purchase")
    gaps = A.gap_statistics(rows, recent_from=stamp("2024-01-21 12:00:00")).select("channel_id", "median_gap", "max_gap", "long_share")
    freeze = A.frozen(rows.where(F.col("read_time") > stamp("2024-01-21 12:00:00")))
    failures = rule_episodes(spark, sf).select("channel_id", "section_id", "started_at")
    return FV.section_features(counts, counters, gaps, freeze, chans, failures, at, 28)


@query("w9_section_features", """
, r AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-28 12:00:00') - epoch_us(read_time)) / 8.64e10 AS age FROM j WHERE read_time <= TIMESTAMP '2024-01-28 12:00:00'),
k AS (SELECT channel_id, any_value(section_id) AS section_id, count(*) FILTER (age < 7) AS n7, count(*) FILTER (age < 30) AS n30, count(*) FILTER (age >= 7 AND age < 63) AS n8w, count(*) FILTER (age < 7 AND value_text = 'error') AS ch, count(*) FILTER (age < 7 AND value_text = 'purchase') AS un FROM r GROUP BY 1),
w AS (SELECT section_id, max(ch)::DOUBLE AS chatter_7d, round(max(un / nullif(n7, 0)), 6) AS undefined_share_7d, round(min(n7 / nullif(n8w / 8, 0)), 6) AS rate_ratio_7d FROM k GROUP BY 1),
s AS (SELECT section_id, count(*) FILTER (DATE '2024-01-28' - read_time::DATE < 7)::DOUBLE AS readings_7d, count(*) FILTER (DATE '2024-01-28' - read_time::DATE < 7 AND is_alarm)::DOUBLE AS alarms_7d FROM r GROUP BY 1),
f AS (SELECT DISTINCT section_id FROM ep WHERE started_at <= TIMESTAMP '2024-01-28 12:00:00' AND started_at > TIMESTAMP '2024-01-28 12:00:00' - INTERVAL 30 DAY)
SELECT section_id, readings_7d, alarms_7d, chatter_7d, undefined_share_7d, rate_ratio_7d, CASE WHEN section_id IN (SELECT section_id FROM f) THEN 1.0 ELSE 0.0 END::DOUBLE AS failed_30d FROM s JOIN w USING (section_id)""")
def w9(spark, sf):
    out = features(spark, sf)
    return out.select("section_id", "readings_7d", "alarms_7d", "chatter_7d", *[F.round(c, 6).alias(c) for c in ("undefined_share_7d", "rate_ratio_7d")], "failed_30d")


@query("w9_all_features")
def w9_all(spark, sf):
    return features(spark, sf)


@query("d4_nesting", "SELECT 0::BIGINT AS broken")
def d4(spark, sf):
    bad = D.nesting_broken(features(spark, sf), ["readings_1d", "readings_7d", "readings_30d", "readings_365d"], ["silent_share_30d", "undefined_share_7d", "long_gap_share_7d"])
    return bad.agg(F.count("*").alias("broken"))


@query("d5_section_mismatch", "SELECT count(*) AS n FROM events WHERE user_id % 20 <> user_id % 10")
def d5(spark, sf):
    dim = channels(spark, sf).select("channel_id", (F.col("channel_id") % 10).alias("section_id"))
    return D.mismatched(journal(spark, sf), dim, "channel_id", "section_id").agg(F.count("*").alias("n"))


@query("r2_precursor_rule", f""", {RECENCY}, p AS (SELECT channel_id, min(epoch_us(read_time)) AS p FROM j WHERE value_text = 'purchase' AND read_time <= TIMESTAMP '2024-01-13 12:00:00' AND read_time > TIMESTAMP '2024-01-08 12:00:00' GROUP BY 1),
z AS (SELECT rs.channel_id, score, level, CASE WHEN channel_id % 3 <> 0 AND p IS NOT NULL THEN CASE WHEN (p + 432000000000 - epoch_us(TIMESTAMP '2024-01-13 12:00:00')) / 1e6 <= 86400 THEN 'due' ELSE 'pending' END END AS st FROM rs LEFT JOIN p USING (channel_id))
SELECT channel_id, round((1 - (1 - score) * (1 - CASE st WHEN 'due' THEN 0.7 WHEN 'pending' THEN 0.2 ELSE 0.0 END)) - score, 6) AS score_synth, CASE WHEN st = 'due' OR level = 'high' THEN 'high' WHEN st = 'pending' OR level = 'watch' THEN 'watch' ELSE 'normal' END AS level_full FROM z""")
def r2(spark, sf):
    rows = recency(spark, sf).withColumn("t", stamp("2024-01-13 12:00:00")).withColumn("passport", F.col("channel_id") % 3 != 0)
    pre = journal(spark, sf).where("value_text = 'purchase'").select("channel_id", F.col("read_time").alias("t_precursor"))
    out = R.precursor_rule(L.pending_precursor(rows, pre, "channel_id", "t", 5), "due_seconds", 24, 0.7, 0.2, "passport")
    return out.select("channel_id", F.round("score_synth", 6).alias("score_synth"), "level_full")


@query("r3_reasons", f""", {RECENCY} SELECT channel_id, 'last failure ' || printf('%.0f', hours) || ' h ago' AS text, score AS weight, 'real' AS kind FROM rs WHERE hours IS NOT NULL
UNION ALL SELECT channel_id, 'planned work', 0.0, 'plan' FROM rs WHERE plan""")
def r3(spark, sf):
    return recency(spark, sf).select("channel_id", F.explode("reasons").alias("r")).select("channel_id", "r.text", "r.weight", "r.kind")


COEF = {"n": 0.2, "n_bad": 0.9, "n_alarm": -0.4}


@query("r4_logistic_score", """
, x AS (SELECT channel_id, count(*) AS n, count(*) FILTER (value_text = 'error') AS n_bad, count(*) FILTER (is_alarm) AS n_alarm FROM j WHERE read_time >= TIMESTAMP '2024-01-28' GROUP BY 1)
SELECT channel_id, round(1 / (1 + exp(-(-2.0 + 0.2 * n + 0.9 * n_bad - 0.4 * n_alarm))), 6) AS probability FROM x""")
def r4(spark, sf):
    rows = journal(spark, sf).where(F.col("read_time") >= stamp("2024-01-28")).groupBy("channel_id").agg(F.count("*").alias("n"), F.count_if(F.col("value_text") == "error").alias("n_bad"), F.count_if("is_alarm").alias("n_alarm"))
    out = R.logistic_score(rows, COEF, -2.0, {"activity": ["n"], "failures": ["n_bad"], "alarms": ["n_alarm"]})
    return out.select("channel_id", F.round("probability", 6).alias("probability"))


@query("r5_contributions", """
, x AS (SELECT channel_id, count(*) AS n, count(*) FILTER (value_text = 'error') AS n_bad FROM j WHERE read_time >= TIMESTAMP '2024-01-28' GROUP BY 1), p AS (SELECT *, 1 / (1 + exp(-(-2.0 + 0.2 * n + 0.9 * n_bad))) - 1 / (1 + exp(2.0)) AS d FROM x)
SELECT channel_id, 'activity' AS text, round(d * 0.2 * n / (0.2 * n + 0.9 * n_bad), 6) AS weight FROM p UNION ALL SELECT channel_id, 'failures', round(d * 0.9 * n_bad / (0.2 * n + 0.9 * n_bad), 6) FROM p WHERE n_bad > 0""")
def r5(spark, sf):
    rows = journal(spark, sf).where(F.col("read_time") >= stamp("2024-01-28")).groupBy("channel_id").agg(F.count("*").alias("n"), F.count_if(F.col("value_text") == "error").alias("n_bad"))
    out = R.logistic_score(rows, {"n": 0.2, "n_bad": 0.9}, -2.0, {"activity": ["n"], "failures": ["n_bad"]})
    return out.select("channel_id", F.explode("contributions").alias("c")).select("channel_id", "c.text", F.round("c.weight", 6).alias("weight"))


@query("r6_fitted_coefficients")
def r6(spark, sf):
    rows = journal(spark, sf).groupBy("channel_id", F.to_date("read_time").alias("day")).agg(F.count("*").cast("double").alias("n"), F.count_if("is_alarm").cast("double").alias("n_alarm"), (F.count_if(F.col("value_text") == "error") > 0).cast("int").alias("label"))
    weights, bias = R.fit_logistic(rows, ["n", "n_alarm"])
    return spark.createDataFrame([*weights.items(), ("bias", bias)], "name string, weight double").select("name", F.round("weight", 3).alias("weight"))


@query("r10_base_rate", f", {SCORES} SELECT count(*) AS rows, round(avg(label), 6) AS base FROM sc")
def r10(spark, sf):
    return scores(spark, sf).agg(F.count("*").alias("rows"), F.round(F.avg("label"), 6).alias("base"))


@query("r11_ensemble", """
, m AS (SELECT event_id, [0.1 + (event_id % 7) / 10, 0.2 + (event_id % 5) / 10, 0.3 + (event_id % 3) / 10] AS s, 0.05 + (event_id % 9) / 10 AS o, event_id % 2 = 0 AS r FROM events), q AS (SELECT *, list_sort(s)[2] AS md FROM m),
z AS (SELECT *, CASE WHEN r THEN 0.7 * ln(md / (1 - md)) + 0.3 * ln(o / (1 - o)) ELSE ln(md / (1 - md)) END AS z FROM q) SELECT event_id, round(1 / (1 + exp(-(CASE WHEN r THEN 0.9 * z - 0.1 ELSE 1.1 * z + 0.2 END))), 6) AS probability FROM z""")
def r11(spark, sf):
    e = F.col("event_id")
    m = table(spark, sf, "events").select(e, F.array(0.1 + (e % 7) / 10, 0.2 + (e % 5) / 10, 0.3 + (e % 3) / 10).alias("s"), (0.05 + (e % 9) / 10).alias("o"))
    out = R.finish_ensemble(m, "s", (0.7, 0.3), "o", e % 2 == 0, {True: (0.9, -0.1), False: (1.1, 0.2)})
    return out.select("event_id", F.round("probability", 6).alias("probability"))


@query("r12_top_factors", """
, w AS (SELECT channel_id, value_text AS text, round(value_num - 50, 3) AS weight FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY abs(weight) DESC, text, weight) AS place FROM w)
SELECT channel_id, text, weight FROM r WHERE place <= 3""")
def r12(spark, sf):
    f = F.array_sort(F.collect_list(F.struct(F.col("value_text").alias("text"), F.round(F.col("value_num") - 50, 3).alias("weight"), F.lit("x").alias("kind"))))
    return journal(spark, sf).groupBy("channel_id").agg(f.alias("f")).select("channel_id", F.explode(R.top_factors(F.col("f"), 3)).alias("t")).select("channel_id", "t.text", "t.weight")


@query("r14_prefix_fold", "SELECT 'col' || (user_id % 5) AS collector, max(value) AS p, bool_or(event_type = 'signup') AS warning FROM events GROUP BY 1")
def r14(spark, sf):
    f = journal(spark, sf).select((F.col("channel_id") % 25).alias("prefix"), F.col("value_num").alias("p"), F.col("is_alarm").alias("warning"))
    mapping = f.select("prefix").distinct().withColumn("collector", F.concat(F.lit("col"), F.col("prefix") % 5))
    return R.fold_prefixes(f, mapping)[0].select("collector", "p", "warning")


@query("r15_opened_warnings", """SELECT prefix, epoch_us(t) AS t, epoch_us(t) + 86400000000 AS expires, min(src) AS source FROM (SELECT user_id % 25 AS prefix, date_trunc('hour', ts) AS t, 0 AS src FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-29'
UNION ALL SELECT user_id % 25, date_trunc('hour', ts), 1 FROM events WHERE event_type = 'signup' AND date_trunc('hour', ts) > TIMESTAMP '2024-01-27') GROUP BY 1, 2""")
def r15(spark, sf):
    a = journal(spark, sf).where("is_alarm").select((F.col("channel_id") % 25).alias("prefix"), "read_time", F.date_trunc("hour", "read_time").alias("t"))
    out = R.opened_warnings(a.where(F.col("read_time") >= stamp("2024-01-29")), a, stamp("2024-01-27"), 24)
    return out.select("prefix", us("t").alias("t"), us("expires_at").alias("expires"), "source")


@query("r20_snapshot", "SELECT o_custkey, max(o_orderkey) FILTER (o_orderkey % 2 = 0) IS NULL AS is_stale, coalesce(max(o_orderkey) FILTER (o_orderkey % 2 = 0), max(o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def r20(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    last = lambda df: df.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return R.replace_snapshot(last(o.where("o_orderkey % 2 = 1")), last(o.where("o_orderkey % 2 = 0")), "o_custkey")


@query("r25_daily_keys", "SELECT 'sensor:' || (user_id % 20) || ':' || strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS key, count(*) AS n FROM events GROUP BY 1")
def r25(spark, sf):
    return journal(spark, sf).groupBy(R.daily_key(F.col("section_id"), F.col("read_time"), "Europe/Moscow").alias("key")).agg(F.count("*").alias("n"))


@query("r28_explanations")
def r28(spark, sf):
    f = F.collect_list(F.struct(F.col("value_text").alias("factor"), F.col("value_num").alias("value"), (F.col("value_num") - 50).alias("weight")))
    rows = journal(spark, sf).groupBy(F.col("channel_id").alias("entity")).agg(f.alias("factors"))
    families = spark.createDataFrame([("error", "faults", 1.0, "faults at {}"), ("purchase", "faults", 1.0, "losses at {}"), ("view", "views", -1.0, "few views: {}")], "factor string, family string, danger double, template string")
    return R.explain(rows, "factors", families).select("entity", F.array_join("texts", "; ").alias("text"))


@query("r29_compliance", """
, r AS (SELECT * FROM (VALUES ('click', 40.0), ('error', 35.0), ('purchase', 25.0)) v(rule, weight)), e AS (SELECT DISTINCT channel_id AS entity FROM j WHERE read_time >= TIMESTAMP '2024-01-30'), h AS (SELECT DISTINCT channel_id AS entity, value_text AS rule FROM j WHERE read_time >= TIMESTAMP '2024-01-30')
SELECT e.entity, sum(CASE WHEN h.rule IS NOT NULL THEN weight ELSE 0 END)::DOUBLE AS percent FROM e CROSS JOIN r LEFT JOIN h ON h.entity = e.entity AND h.rule = r.rule GROUP BY 1""")
def r29(spark, sf):
    rules = spark.createDataFrame([("click", 40.0), ("error", 35.0), ("purchase", 25.0)], "rule string, weight double")
    fired = journal(spark, sf).where(F.col("read_time") >= stamp("2024-01-30")).select(F.col("channel_id").alias("entity"), F.col("value_text").alias("rule"))
    return N.compliance(rules, fired).select("entity", "percent")


@query("r34_r38_findings", "SELECT CASE WHEN value >= 90 OR value <= 3 THEN 'alarm' WHEN value >= 81 THEN 'warn' ELSE 'none' END AS finding, count(*) AS n FROM events GROUP BY 1")
def r34(spark, sf):
    v = F.col("value_num")
    worst = N.worst_finding(N.absolute_finding(v, F.lit(90.0)), N.absolute_finding(v, F.lit(3.0), "low"))
    return journal(spark, sf).groupBy(worst.alias("finding")).agg(F.count("*").alias("n"))


@query("m8_collector_alerts", """SELECT 'col' || (user_id % 5) AS collector, strftime(ts, '%Y-%m-%d') AS as_of, max(value) AS probability FROM events GROUP BY 1, 2 HAVING max(value) > 90""")
def m8(spark, sf):
    f = journal(spark, sf).select("section_id", F.date_format("read_time", "yyyy-MM-dd").alias("as_of"), F.col("value_num").alias("probability"))
    return M.section_to_collector(f, channels(spark, sf).select("section_id", "collector").distinct(), 90.0)


@query("m7_target_decomposition")
def m7(spark, sf):
    """The metric against three targets: episodes, incidents merged over 10 and over 60 minutes."""
    from ..operators.episodes import merge_incidents

    a, f = alerts_and_failures(spark, sf)
    out = None
    for name, minutes in (("episodes", None), ("merged_10", 10), ("merged_60", 60)):
        target = f if minutes is None else merge_incidents(f, "object_id", "t", minutes).select("object_id", F.col("first_at").alias("t"))
        s = M.summarise(M.match_alerts(a, target, low_hours=24, high_hours=168)).withColumn("target", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


@query("m15_threshold_curve", f""", {SCORES}, g AS (SELECT score, count(*) AS c, sum(label) AS h FROM sc GROUP BY 1), t AS (SELECT score, c, sum(c) OVER o AS through, sum(h) OVER o AS hits, sum(h) OVER () AS p FROM g WINDOW o AS (ORDER BY score DESC)),
x AS (SELECT n, through, hits, p, hits / through AS pr, hits / p AS rc FROM t, (VALUES (25), (50), (100), (200), (400)) v(n) WHERE n <= through AND n > through - c)
SELECT n AS wanted, through::BIGINT AS alerts, hits::BIGINT AS tp, p::BIGINT AS positives, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1 FROM x""")
def m15(spark, sf):
    """precision, recall and F1 at the thresholds of a geometric grid of alert counts."""
    out = M.threshold_curve(scores(spark, sf), (25, 50, 100, 200, 400))
    return out.select("wanted", "alerts", "tp", "positives", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("m16_share_later")
def m16(spark, sf):
    return M.share_later(matched(spark, sf), 48)


@query("a19_a20_base_rates", f", {SCORES} SELECT CASE WHEN day < DATE '2024-01-15' THEN 'train' ELSE 'test' END AS split, count(*) AS rows, sum(label)::BIGINT AS positives FROM sc GROUP BY 1")
def a20(spark, sf):
    s = scores(spark, sf).withColumn("split", F.when(F.col("day") < F.lit("2024-01-15").cast("date"), "train").otherwise("test"))
    return s.groupBy("split").agg(F.count("*").alias("rows"), F.sum("label").alias("positives"))


@query("a22_data_status", "SELECT epoch_us(max(ts)) AS edge, count(DISTINCT user_id) AS channels, (DATE '2024-02-05' - max(ts)::DATE)::INT AS lag_days FROM events")
def a22(spark, sf):
    return journal(spark, sf).agg(F.max(us("read_time")).alias("edge"), F.count_distinct("channel_id").alias("channels"), F.datediff(F.lit("2024-02-05").cast("date"), F.to_date(F.max("read_time"))).alias("lag_days"))


@query("a23_equipment_card", "SELECT s_suppkey AS item_id, count(l_orderkey) FILTER (l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1997-01-01') AS notifications, epoch_us(max(l_shipdate) FILTER (l_returnflag = 'R')) AS last_repair FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def a23(spark, sf):
    items = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_id"), F.lit("1990-01-01").cast("date").alias("in_service"), F.lit(20).alias("life_years"))
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("item_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_shipdate").cast("timestamp").alias("done_at"), "l_returnflag")
    out = Q.equipment_card(items, li, li.where("l_returnflag = 'R'"), stamp("1997-01-01"))
    return out.select("item_id", "notifications", us("last_repair").alias("last_repair"))


@query("w8_ratios", """
, d AS (SELECT section_id, epoch_us(read_time) // 86400000000 AS day, count(*) AS n, count(DISTINCT channel_id) AS act FROM j GROUP BY 1, 2),
t AS (SELECT section_id, count(DISTINCT channel_id) AS total FROM j GROUP BY 1),
a AS (SELECT d.section_id, d.day, count(DISTINCT j.channel_id) AS a7 FROM d JOIN j ON j.section_id = d.section_id AND epoch_us(j.read_time) // 86400000000 BETWEEN d.day - 6 AND d.day GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY section_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS n7, sum(n) OVER (PARTITION BY section_id ORDER BY day RANGE BETWEEN 27 PRECEDING AND CURRENT ROW) AS n28, sum(n) OVER (PARTITION BY section_id ORDER BY day RANGE BETWEEN 364 PRECEDING AND CURRENT ROW) AS n365 FROM d)
SELECT section_id, day, round(act / total, 6) AS act_share_1d, round(a7 / total, 6) AS act_share_7d, round(52.0 * n7 / n365, 6) AS rate_7d, round(13.0 * n28 / n365, 6) AS rate_28d FROM s JOIN t USING (section_id) JOIN a USING (section_id, day)""")
def w8(spark, sf):
    rows = journal(spark, sf).withColumn("day", F.floor(us("read_time") / 86_400_000_000))
    days = rows.groupBy("section_id", "day").agg(F.count("*").alias("n"), F.count_distinct("channel_id").alias("n_active_ch"))
    total = rows.groupBy("section_id").agg(F.count_distinct("channel_id").alias("n_ch_total"))
    seen = rows.select("section_id", "channel_id", F.explode(F.sequence("day", F.col("day") + 6)).alias("day")).groupBy("section_id", "day").agg(F.count_distinct("channel_id").alias("act_ch_7d"))
    w = Window.partitionBy("section_id").orderBy("day")
    days = days.withColumns({f"n_rows_{k}d": F.sum("n").over(w.rangeBetween(1 - k, 0)) for k in (7, 28, 365)})
    out = FV.activity_ratios(days.join(total, "section_id").join(seen, ["section_id", "day"]))
    return out.select("section_id", "day", *[F.round(c, 6).alias(c) for c in ("act_share_1d", "act_share_7d", "rate_7d", "rate_28d")])


@query("w11_passport", "SELECT s_suppkey, least(2.0, (s_suppkey * 40) / 365.25 / nullif(s_suppkey % 6, 0)) AS life_share, ((s_suppkey % 200) / 90.0 > 1)::INT AS overdue FROM supplier")
def w11(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey").cast("int")
    day = F.lit("2024-01-31").cast("date")
    rows = s.select("s_suppkey", day.alias("at"), F.date_sub(day, k * 40).alias("in_service"), (k % 6).alias("life_years"), F.date_sub(day, k % 200).alias("last_check"))
    return L.passport_features(rows, "at", "in_service", "life_years", "last_check", 90).select("s_suppkey", "life_share", "overdue")


@query("w11_precursor_bins", """SELECT a.journal_id, count(b.journal_id) FILTER (b.read_time > a.read_time - INTERVAL 1 DAY) AS pre_0_1, count(b.journal_id) FILTER (b.read_time <= a.read_time - INTERVAL 1 DAY AND b.read_time > a.read_time - INTERVAL 2 DAY) AS pre_1_2
FROM j a LEFT JOIN j b ON b.channel_id = a.channel_id AND b.value_text = 'purchase' AND b.read_time <= a.read_time AND b.read_time > a.read_time - INTERVAL 2 DAY WHERE a.value_text = 'error' GROUP BY 1""")
def w11b(spark, sf):
    rows = journal(spark, sf)
    pre = rows.where("value_text = 'purchase'").select("channel_id", F.col("read_time").alias("t_precursor"))
    out = L.precursor_bins(rows.where("value_text = 'error'").select("journal_id", "channel_id", "read_time"), pre.withColumnRenamed("t_precursor", "t_precursor"), "channel_id", "read_time")
    return out.select("journal_id", "pre_0_1", "pre_1_2")


@query("q7_risk_and_explanation", "SELECT channel_id, round(arg_max(value_num, (read_time, journal_id)), 6) AS current, arg_max(value_text, (read_time, journal_id)) FILTER (value_text <> 'view') AS explanation FROM j GROUP BY 1")
def q7(spark, sf):
    at = F.struct("read_time", "journal_id")
    return journal(spark, sf).groupBy("channel_id").agg(F.round(F.max_by("value_num", at), 6).alias("current"), F.max_by("value_text", F.when(F.col("value_text") != "view", at)).alias("explanation"))


@query("q9_risk_page", f", {RECENCY} SELECT channel_id, level, score FROM rs ORDER BY CASE level WHEN 'high' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END DESC, score DESC, channel_id LIMIT 25")
def q9(spark, sf):
    rows = recency(spark, sf).select("channel_id", F.col("level_real").alias("level"), F.col("score_real").alias("score"))
    return Q.page(rows, [R.level_rank(F.col("level")).desc(), F.col("score").desc(), F.col("channel_id")], 25)


@query("q12_notifications", "SELECT o_orderkey, o_orderstatus = 'F' AS acked, c_acctbal AS current FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1%' AND o_orderstatus <> 'F'")
def q12(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") != "F"))
    return o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", (F.col("o_orderstatus") == "F").alias("acked"), F.col("c_acctbal").alias("current"))


@query("q17_latest_weather", "SELECT epoch_us(max(ts)) AS at, round(arg_max(value, (ts, event_id)), 6) AS value, max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 1 HOUR AS stale FROM events")
def q17(spark, sf):
    rows = journal(spark, sf)
    return rows.agg(F.max(us("read_time")).alias("at"), F.round(F.max_by("value_num", F.struct("read_time", "journal_id")), 6).alias("value"), (F.max("read_time") < stamp("2024-01-31 23:00:00")).alias("stale"))


@query("j5_prefix_collector", "SELECT prefix, collector, n, (t - n)::BIGINT AS lost FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, collector) AS k, sum(n) OVER (PARTITION BY prefix) AS t FROM (SELECT user_id % 7 AS prefix, 'col' || (user_id % 5) AS collector, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k = 1")
def j5(spark, sf):
    from ..operators import joins as J

    return J.majority(journal(spark, sf).select((F.col("channel_id") % 7).alias("prefix"), F.concat(F.lit("col"), F.col("channel_id") % 5).alias("collector")), "prefix", "collector")


@query("j18_open_permits", "SELECT DISTINCT user_id % 20 AS section_id FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL 2 HOUR >= TIMESTAMP '2024-01-15'")
def j18(spark, sf):
    from ..operators.permits import open_permits

    p = journal(spark, sf).select("section_id", F.col("read_time").alias("valid_from"), F.timestamp_add("HOUR", F.lit(2), "read_time").alias("valid_to"))
    return open_permits(p, stamp("2024-01-15"))


@query("j20_alert_fan_out", "SELECT 'col' || (user_id % 5) AS collector, count(*) AS alerts FROM events WHERE event_type = 'signup' GROUP BY 1")
def j20(spark, sf):
    from ..operators import joins as J

    a = J.fan_out(journal(spark, sf).where("is_alarm"), channels(spark, sf), "channel_id", "collector")
    return a.groupBy("collector").agg(F.count("*").alias("alerts"))


@query("p1_flags", "SELECT event_type IN ('click', 'view') AS flag, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def p1(spark, sf):
    word = F.when(F.col("value_text").isin("click", "view"), " ДА ").when(F.col("value_text") == "error", "False").otherwise("maybe")
    return journal(spark, sf).groupBy(clean.parse_flag(word).alias("flag")).agg(F.count("*").alias("n")).where("flag is not null")


@query("p3_moments", "SELECT event_id, epoch_us(date_trunc('second', ts)) - 10800000000 AS us FROM events")
def p3(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", us(clean.parse_moment(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))).alias("us"))


@query("p5_p9_places", "SELECT c_custkey, 'col' || (c_custkey % 7) AS collector, (c_custkey % 300)::INT AS picket, 'col' || (c_custkey % 7) || ':' || (c_custkey % 300) AS section, (c_custkey % 300) * 10 + (c_custkey % 10) + 0.5 AS metres FROM customer")
def p5(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k, F.concat(F.lit("col"), k % 7, F.lit("-11.1.131.")).alias("tag"), F.concat(F.lit("КД АВ ПК"), k % 300, F.lit("+"), k % 10, F.lit(",5 ур.3")).alias("name"))
    return rows.select("c_custkey", clean.collector_of(F.col("tag")).alias("collector"), clean.picket_of(F.col("name")).alias("picket"), clean.section_key(F.col("tag"), F.col("name")).alias("section"), clean.linear_metres(F.col("name")).alias("metres"))


@query("d12_hung_runs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_shipdate < TIMESTAMP '1996-01-01'")
def d12(spark, sf):
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("started_at"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("finished_at"))
    return D.hung_runs(r, stamp("1996-01-02"), 86400).select("l_orderkey", "l_linenumber")


@query("d17_completeness", "SELECT count(*) AS orders, count(c_custkey) AS located, count(*) FILTER (o_orderpriority IS NOT NULL) AS with_priority FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'")
def d17(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.count("*").alias("orders"), F.count("c_custkey").alias("located"), F.count("o_orderpriority").alias("with_priority"))


@query("m13_timeline", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, (sum(count(*)) OVER (ORDER BY strftime(ts, '%Y-%m-%d')))::BIGINT AS through FROM events GROUP BY 1")
def m13(spark, sf):
    days = journal(spark, sf).groupBy(F.date_format("read_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("through", F.sum("n").over(Window.orderBy("day")))


@query("t8_silence", f"SELECT 'ch' || channel_id AS source, epoch_us(TIMESTAMP '{END}') - max(epoch_us(read_time)) > 43200000000 AS lagging FROM j GROUP BY 1")
def t8(spark, sf):
    from ..streaming.live import silence

    last = journal(spark, sf).groupBy(F.concat(F.lit("ch"), "channel_id").alias("source")).agg(F.max("read_time").alias("last_at"))
    return silence(last, stamp(END), last.select("source", F.lit(43200).alias("norm_seconds"))).select("source", "lagging")
