"""Queries over labels, alerts, risk, publishing and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import quality as D
from ..operators import risk as R
from .base import END, channels, journal, query, stamp, table, us
from .journal import CHANDAY, INCIDENTS, chanday, incidents, rule_episodes


@query("j4_majority_section", """
, n AS (SELECT section_id, value_text, count(*) AS n FROM j GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY n DESC, value_text) AS k, sum(n) OVER (PARTITION BY section_id) AS t FROM n)
SELECT section_id, value_text, n, (t - n)::BIGINT AS lost FROM r WHERE k = 1""")
def j4(spark, sf):
    return J.majority(journal(spark, sf), "section_id", "value_text")


@query("j3_tree_parents", "SELECT c_custkey, n_name AS up_1, r_name AS up_2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j3(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    key = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    tree = r.select(key("r", F.col("r_regionkey")).alias("object_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    tree = tree.unionByName(n.select(key("n", F.col("n_nationkey")).alias("object_id"), key("r", F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name")))
    tree = tree.unionByName(c.select(key("c", F.col("c_custkey")).alias("object_id"), key("n", F.col("c_nationkey")).alias("parent_id"), F.col("c_name").alias("name")))
    up = J.tree_parents(tree).where(F.col("object_id").startswith("c"))
    names = tree.select("object_id", "name")
    out = up.join(names.select(F.col("object_id").alias("up_1"), F.col("name").alias("a")), "up_1").join(names.select(F.col("object_id").alias("up_2"), F.col("name").alias("b")), "up_2")
    return out.select(F.substring("object_id", 2, 20).cast("long").alias("c_custkey"), F.col("a").alias("up_1"), F.col("b").alias("up_2"))


@query("j7_tree_paths", "SELECT r_name || '/' || n_name AS path, 2 AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 1 FROM region")
def j7(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    tree = r.select((F.col("r_regionkey") + 1000).cast("long").alias("object_id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    tree = tree.unionByName(n.select(F.col("n_nationkey").cast("long").alias("object_id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.col("n_name").alias("name")))
    return J.recursive_paths(tree).select("path", "level")


@query("j6_tree_listing", "SELECT r_name AS collector, n_name AS node, count(*) AS channels, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j6(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return J.tree_listing(rows, "r_name", "n_name", "c_mktsegment").toDF("collector", "node", "channels", "segments")


@query("j9_as_of_previous", "SELECT channel_id, epoch_us(max(read_time)) AS last_us, arg_max(value_text, (read_time, journal_id)) AS value_text FROM j WHERE read_time <= TIMESTAMP '2024-01-15' GROUP BY 1")
def j9(spark, sf):
    rows = journal(spark, sf).withColumn("at", F.struct("read_time", "journal_id")).where(F.col("read_time") <= stamp("2024-01-15"))
    return J.as_of(rows, "channel_id", "at", F.struct(stamp("2024-01-16"), F.lit(0).cast("long")), ["value_text"]).select("channel_id", us("at.read_time").alias("last_us"), "value_text")


@query("j12_events_ahead", f""", {CHANDAY}, e AS (SELECT cd.channel_id, cd.day, count(*) AS k FROM cd JOIN ep ON ep.channel_id = cd.channel_id AND (epoch_us(started_at) - epoch_us((day + 1)::TIMESTAMP)) / 3.6e9 BETWEEN 24 AND 168 GROUP BY 1, 2)
SELECT cd.channel_id, strftime(day, '%Y-%m-%d') AS day, coalesce(k, 0) AS events FROM cd LEFT JOIN e USING (channel_id, day)""")
def j12(spark, sf):
    days = chanday(spark, sf).select("channel_id", "day")
    return J.events_ahead(days, rule_episodes(spark, sf).select("channel_id", "started_at"), "channel_id", "day", "started_at", 24, 168).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("j13_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j13(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j14_semi", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j14(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").agg(F.count("*").alias("n"))


@query("j15_reconcile", """
, a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT coalesce(a.month, b.month) AS month, coalesce(a.n, 0) AS actual, coalesce(b.n, 0) AS expected, coalesce(a.n, 0) = coalesce(b.n, 0) AS ok FROM a FULL JOIN b USING (month)""")
def j15(spark, sf):
    from ..operators.episodes import reconcile

    o = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    count = lambda df: df.groupBy("month").agg(F.count("*").alias("n"))
    return reconcile(count(o.where("o_orderstatus = 'F'")), count(o.where(F.col("o_orderpriority").startswith("1"))), "month", "n")


@query("j17_scope", "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS s FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 OR n_nationkey = 3")
def j17(spark, sf):
    n = table(spark, sf, "nation")
    tree = n.select(F.col("n_nationkey").cast("long").alias("object_id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"))
    scope = spark.createDataFrame([(1001,), (3,)], "object_id long")
    rows = table(spark, sf, "customer").withColumn("object_id", F.col("c_nationkey").cast("long"))
    return J.in_scope(rows, scope, tree).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s"))


@query("j11_planned", "SELECT channel_id, epoch_us(started_at) AS started, started_at::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AND channel_id % 2 = 0 AS planned FROM ep")
def j11(spark, sf):
    plans = channels(spark, sf).where("channel_id % 2 = 0").select("channel_id", F.lit("sure").alias("match"), F.lit("2024-01-10").cast("date").alias("dismantle_from"), F.lit("2024-01-12").cast("date").alias("return_to"))
    return J.in_plan(rule_episodes(spark, sf), plans, ["channel_id"], "started_at").select("channel_id", us("started_at").alias("started"), "planned")


MOMENTS = """mo AS (SELECT collector, (day + 1)::TIMESTAMP AS moment, 'tick' AS kind FROM (SELECT DISTINCT collector, day FROM cd JOIN c USING (channel_id))
UNION ALL SELECT collector, first_at + INTERVAL 1 HOUR, 'rearm' FROM inc)"""


def all_moments(spark, sf):
    days = chanday(spark, sf).join(channels(spark, sf).select("channel_id", "collector"), "channel_id").select("collector", "day").distinct()
    return L.moments(days, incidents(spark, sf), "collector")


@query("g4_moments", f", {CHANDAY}, {INCIDENTS}, {MOMENTS} SELECT collector, kind, epoch_us(moment) AS at FROM mo")
def g4(spark, sf):
    return all_moments(spark, sf).select("collector", "kind", us("moment").alias("at"))


@query("g6_horizon_labels", f", {CHANDAY}, {INCIDENTS}, {MOMENTS} SELECT collector, kind, epoch_us(moment) AS at, CASE WHEN EXISTS (SELECT 1 FROM inc WHERE inc.collector = mo.collector AND first_at > moment AND first_at <= moment + INTERVAL 6 HOUR) THEN 1 ELSE 0 END AS label FROM mo")
def g6(spark, sf):
    return L.horizon_labels(all_moments(spark, sf), incidents(spark, sf).select("collector", "first_at"), "collector", "first_at", 6).select("collector", "kind", us("moment").alias("at"), "label")


@query("g3_day_labels", f""", {CHANDAY}, e AS (SELECT cd.channel_id, cd.day, count(*) AS k FROM cd JOIN ep ON ep.channel_id = cd.channel_id AND (epoch_us(started_at) - epoch_us((day + 1)::TIMESTAMP)) / 3.6e9 BETWEEN 24 AND 168 GROUP BY 1, 2)
SELECT cd.channel_id, strftime(day, '%Y-%m-%d') AS day, (day::TIMESTAMP + INTERVAL 192 HOUR) > TIMESTAMP '2024-01-31' AS censored, CASE WHEN coalesce(k, 0) > 0 THEN 1 WHEN (day::TIMESTAMP + INTERVAL 192 HOUR) <= TIMESTAMP '2024-01-31' THEN 0 END AS label FROM cd LEFT JOIN e USING (channel_id, day)""")
def g3(spark, sf):
    counted = J.events_ahead(chanday(spark, sf).select("channel_id", "day"), rule_episodes(spark, sf).select("channel_id", "started_at"), "channel_id", "day", "started_at", 24, 168)
    return L.day_labels(counted, "day", stamp(END)).select("channel_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "censored", "label")


@query("g5_censored", "SELECT channel_id, epoch_us(started_at) AS started, epoch_us(coalesce(ended_at, TIMESTAMP '2024-01-31')) AS ended, ended_at IS NULL AS censored FROM ep")
def g5(spark, sf):
    return L.censored(rule_episodes(spark, sf), stamp(END)).select("channel_id", us("started_at").alias("started"), us("ended_at").alias("ended"), "censored")


@query("g7_time_split", "SELECT CASE WHEN read_time < TIMESTAMP '2024-01-15' THEN 'train' WHEN read_time < TIMESTAMP '2024-01-22' THEN 'valid' WHEN read_time < TIMESTAMP '2024-01-29' THEN 'test' END AS split, count(*) AS n FROM j GROUP BY 1")
def g7(spark, sf):
    return journal(spark, sf).groupBy(L.time_split(F.col("read_time"), "2024-01-15", "2024-01-22", "2024-01-29").alias("split")).agg(F.count("*").alias("n"))


@query("g8_thin_negatives", "SELECT journal_id, CASE WHEN value_text = 'error' THEN 1.0 ELSE 4.0 END AS weight FROM j WHERE value_text = 'error' OR ('0x' || substr(md5(journal_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 < 0.25")
def g8(spark, sf):
    rows = journal(spark, sf).withColumn("label", (F.col("value_text") == "error").cast("int"))
    return L.thin_negatives(rows, "label", 0.25, "journal_id").select("journal_id", "weight")


@query("g9_one_hot", "SELECT channel_id, (sensor_kind IS NOT DISTINCT FROM 'kind0')::INT AS is_kind0, (sensor_kind IS NOT DISTINCT FROM 'kind1')::INT AS is_kind1 FROM c")
def g9(spark, sf):
    return L.one_hot(channels(spark, sf), "sensor_kind", ["kind0", "kind1"]).select("channel_id", "is_kind0", "is_kind1")


@query("w10_history_features", """
, t AS (SELECT channel_id, picket, TIMESTAMP '2024-01-25' AS t FROM c),
h AS (SELECT t.channel_id, t.picket, (epoch_us(t.t) - epoch_us(max(started_at) FILTER (started_at <= t.t))) / 3.6e9 AS hours, count(*) FILTER (started_at > t.t - INTERVAL 7 DAY AND started_at <= t.t) AS n7, count(*) FILTER (started_at > t.t - INTERVAL 30 DAY AND started_at <= t.t) AS n30 FROM t LEFT JOIN ep USING (channel_id) GROUP BY t.channel_id, t.picket, t.t),
p AS (SELECT picket, sum(n7) AS np FROM h GROUP BY 1)
SELECT channel_id, coalesce((hours < 24)::INT, 0) AS fresh, round(coalesce(exp(-hours / 24), 0), 6) AS decay_1, round(ln(1 + n7), 6) AS log_7, round(ln(1 + n30), 6) AS log_30, (np - n7)::BIGINT AS near_picket_7d FROM h JOIN p USING (picket)""")
def w10(spark, sf):
    rows = channels(spark, sf).select("channel_id").withColumn("t", stamp("2024-01-25"))
    near = channels(spark, sf).select("channel_id", "picket", "collector")
    out = L.history_features(rows, rule_episodes(spark, sf).select("channel_id", "started_at"), near)
    return out.select("channel_id", "fresh", F.round("decay_1", 6).alias("decay_1"), F.round("log_7", 6).alias("log_7"), F.round("log_30", 6).alias("log_30"), "near_picket_7d")


@query("w12_hours_since_failure", """SELECT a.journal_id, round((epoch_us(a.read_time) - epoch_us(max(ep.started_at))) / 3.6e9, 6) AS hours FROM j a LEFT JOIN ep ON ep.channel_id = a.channel_id AND ep.started_at <= a.read_time WHERE a.value_text = 'signup' GROUP BY a.journal_id, a.read_time""")
def w12(spark, sf):
    rows = journal(spark, sf).where("is_alarm").select("journal_id", "channel_id", "read_time")
    out = L.last_event_hours(rows, rule_episodes(spark, sf).select("channel_id", F.col("started_at")), "channel_id", "read_time", "started_at")
    return out.select("journal_id", F.round("hours", 6).alias("hours"))


@query("w13_trailing_failures", "SELECT a.journal_id, count(ep.started_at) AS n FROM j a LEFT JOIN ep ON ep.channel_id = a.channel_id AND ep.started_at <= a.read_time AND ep.started_at > a.read_time - INTERVAL 5 DAY WHERE a.value_text = 'signup' GROUP BY 1")
def w13(spark, sf):
    rows = journal(spark, sf).where("is_alarm").select("journal_id", "channel_id", "read_time")
    return L.trailing_counts(rows, rule_episodes(spark, sf).select("channel_id", "started_at"), "channel_id", "read_time", "started_at", {"n": 5}).select("journal_id", "n")


@query("w14_pending_precursor", """SELECT a.journal_id, epoch_us(min(b.read_time)) AS precursor, round(min((epoch_us(b.read_time) + 5 * 86400000000 - epoch_us(a.read_time)) / 1e6), 3) AS due FROM j a LEFT JOIN j b ON b.channel_id = a.channel_id AND b.value_text = 'purchase' AND b.read_time <= a.read_time AND b.read_time > a.read_time - INTERVAL 5 DAY WHERE a.value_text = 'error' GROUP BY 1""")
def w14(spark, sf):
    rows = journal(spark, sf)
    pre = rows.where("value_text = 'purchase'").select("channel_id", F.col("read_time").alias("t_precursor"))
    out = L.pending_precursor(rows.where("value_text = 'error'").select("journal_id", "channel_id", "read_time"), pre, "channel_id", "read_time", 5)
    return out.select("journal_id", us("precursor_at").alias("precursor"), F.round("due_seconds", 3).alias("due"))


@query("w15_duplicates_beyond", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k > 5")
def w15(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").withColumn("k", F.row_number().over(w)).where("k > 5").select("o_orderkey")


@query("w16_thinned_alerts", """
, al AS (SELECT DISTINCT channel_id, epoch_us(read_time) AS t FROM j WHERE is_alarm)
SELECT channel_id, count(*) AS kept FROM (SELECT channel_id, t, list_reduce(list_prepend([-1000000000000000]::BIGINT[], (SELECT list([x.t]::BIGINT[] ORDER BY x.t) FROM al x WHERE x.channel_id = al.channel_id AND x.t <= al.t)), lambda a, b: CASE WHEN b[1] - a[len(a)] >= 172800000000 THEN list_append(a, b[1]) ELSE a END) AS k FROM al) WHERE k[len(k)] = t GROUP BY 1""")
def w16(spark, sf):
    return L.thin_repeats(journal(spark, sf).where("is_alarm"), "channel_id", "read_time", 2880).groupBy("channel_id").agg(F.count("*").alias("kept"))


@query("w17_shortest_gap", "SELECT channel_id, round(min(g), 3) AS shortest_gap FROM (SELECT channel_id, (epoch_us(read_time) - epoch_us(lag(read_time) OVER (PARTITION BY channel_id ORDER BY read_time))) / 6e7 AS g FROM j) GROUP BY 1")
def w17(spark, sf):
    return L.gap_share(journal(spark, sf), "channel_id", "read_time").select("channel_id", F.round("shortest_gap", 3).alias("shortest_gap"))


def alerts_and_failures(spark, sf):
    rows = journal(spark, sf).withColumnRenamed("channel_id", "object_id")
    return rows.where("is_alarm").select("object_id", F.col("read_time").alias("t")), rule_episodes(spark, sf).select(F.col("channel_id").alias("object_id"), F.col("started_at").alias("t"))


def matched(spark, sf):
    a, f = alerts_and_failures(spark, sf)
    return M.match_alerts(a, f, low_hours=24, high_hours=168)


@query("m2_false_alerts", """
, a AS (SELECT channel_id, read_time AS t FROM j WHERE is_alarm), o AS (SELECT channel_id FROM a UNION SELECT channel_id FROM ep),
s AS (SELECT a.channel_id, count(*) AS alerts, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ep WHERE ep.channel_id = a.channel_id AND epoch_us(started_at) - epoch_us(a.t) BETWEEN 86400000000 AND 604800000000)) AS fp FROM a GROUP BY 1)
SELECT o.channel_id AS object_id, coalesce(alerts, 0) AS alerts, coalesce(fp, 0) AS fp FROM o LEFT JOIN s USING (channel_id)""")
def m2(spark, sf):
    return matched(spark, sf).select("object_id", F.col("alerts").cast("long").alias("alerts"), F.col("fp").cast("long").alias("fp"))


@query("m3_metric_summary")
def m3(spark, sf):
    return M.verdict(M.summarise(matched(spark, sf), object_days=30 * 150), 24)


@query("m5_lead_histogram")
def m5(spark, sf):
    return M.lead_histogram(matched(spark, sf), [24, 36, 48, 72, 120])


@query("m6_identity", "SELECT count(*) AS n FROM (SELECT 1 WHERE false)")
def m6(spark, sf):
    """Objects whose alerts are not tp + fp + dup, or failures not tp + fn: none."""
    return matched(spark, sf).where("alerts <> tp + fp + dup or failures <> tp + fn or dup < 0").agg(F.count("*").alias("n"))


@query("m12_policy_impact")
def m12(spark, sf):
    a, f = alerts_and_failures(spark, sf)
    thin = L.thin_repeats(a, "object_id", "t", 2880)
    parts = [M.summarise(M.match_alerts(x, f, low_hours=24, high_hours=168)).withColumn("policy", F.lit(n)) for n, x in (("before", a), ("after", thin))]
    return parts[0].unionByName(parts[1])


def scores(spark, sf):
    """Channel-day scores: the day's share of bad rows, a future failure as label."""
    days = chanday(spark, sf).select("channel_id", "day", (F.col("n_bad") / F.col("n")).alias("score"))
    counted = J.events_ahead(days, rule_episodes(spark, sf).select("channel_id", "started_at"), "channel_id", "day", "started_at", 0, 24)
    return counted.withColumn("label", (F.col("events") > 0).cast("int"))


SCORES = f"""{CHANDAY}, sc AS (SELECT cd.channel_id, cd.day, n_bad / n AS score, CASE WHEN EXISTS (SELECT 1 FROM ep WHERE ep.channel_id = cd.channel_id AND (epoch_us(started_at) - epoch_us((day + 1)::TIMESTAMP)) / 3.6e9 BETWEEN 0 AND 24) THEN 1 ELSE 0 END AS label FROM cd)"""


@query("m14_precision_at", f""", {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, channel_id) AS r FROM sc)
SELECT k, count(*) FILTER (r <= k) AS selected, count(*) FILTER (r <= k AND label = 1) AS positives, round(count(*) FILTER (r <= k AND label = 1) / count(*) FILTER (r <= k), 6) AS precision, round(count(*) FILTER (r <= k AND label = 1) / sum(label), 6) AS row_recall
FROM r, (VALUES (5), (10), (20)) v(k) GROUP BY k""")
def m14(spark, sf):
    out = M.precision_at(scores(spark, sf), (5, 10, 20), snapshot="day")
    return out.select("k", "selected", "positives", F.round("precision", 6).alias("precision"), F.round("row_recall", 6).alias("row_recall"))


@query("m11_tie_threshold", f""", {SCORES}, g AS (SELECT score, count(*) AS c FROM sc GROUP BY 1), t AS (SELECT score, sum(c) OVER (ORDER BY score DESC) AS through, lead(score) OVER (ORDER BY score DESC) AS lower FROM g)
SELECT round(coalesce((score + lower) / 2, score), 6) AS threshold, through::BIGINT AS alerts FROM t WHERE through >= 200 ORDER BY through LIMIT 1""")
def m11(spark, sf):
    return M.threshold_for(scores(spark, sf), 200).select(F.round("threshold", 6).alias("threshold"), "alerts")


@query("r7_bucket_table", """
, h AS (SELECT a.journal_id, a.value_text = 'error' AS bad, (epoch_us(a.read_time) - epoch_us(max(ep.started_at))) / 3.6e9 AS hours FROM j a LEFT JOIN ep ON ep.channel_id = a.channel_id AND ep.started_at <= a.read_time GROUP BY 1, 2, a.read_time)
SELECT CASE WHEN hours < 6 THEN 0 WHEN hours < 24 THEN 1 WHEN hours < 72 THEN 2 ELSE 3 END AS bucket, count(*) AS rows, round(avg(bad::INT), 6) AS score FROM h WHERE hours IS NOT NULL GROUP BY 1""")
def r7(spark, sf):
    rows = journal(spark, sf).withColumn("bad", (F.col("value_text") == "error").cast("int")).select("journal_id", "channel_id", "read_time", "bad")
    out = L.last_event_hours(rows, rule_episodes(spark, sf).select("channel_id", "started_at"), "channel_id", "read_time", "started_at")
    return R.bucket_table(out, "hours", "bad", [0, 6, 24, 72]).select("bucket", "rows", F.round("score", 6).alias("score"))


TABLE = [(0, 24, 0.6), (24, 72, 0.3), (72, None, 0.05)]


def recency(spark, sf):
    plans = channels(spark, sf).where("channel_id % 2 = 0").select("channel_id", F.lit("sure").alias("match"), F.lit("2024-01-10").cast("date").alias("dismantle_from"), F.lit("2024-01-12").cast("date").alias("return_to"))
    f = J.in_plan(rule_episodes(spark, sf), plans, ["channel_id"], "started_at").select("channel_id", "started_at", "planned", F.lit("planned work").alias("plan_text"))
    return R.recency_rule(channels(spark, sf), f, stamp("2024-01-13 12:00:00"), TABLE)


RECENCY = """rr AS (SELECT c.channel_id, (epoch_us(TIMESTAMP '2024-01-13 12:00:00') - epoch_us(max(started_at) FILTER (epoch_us(started_at) <= epoch_us(TIMESTAMP '2024-01-13 12:00:00') - 3601000000 AND NOT (started_at::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AND c.channel_id % 2 = 0)))) / 3.6e9 AS hours,
count(*) FILTER (epoch_us(started_at) <= epoch_us(TIMESTAMP '2024-01-13 12:00:00') - 3601000000 AND started_at::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AND c.channel_id % 2 = 0) > 0 AS plan FROM c LEFT JOIN ep USING (channel_id) GROUP BY 1),
rs AS (SELECT *, CASE WHEN hours < 24 THEN 0.6 WHEN hours < 72 THEN 0.3 ELSE 0.05 END::DOUBLE AS score, CASE WHEN hours < 24 THEN 'high' WHEN hours < 72 THEN 'watch' ELSE 'normal' END AS level FROM rr)"""


@query("r1_recency_rule", f", {RECENCY} SELECT channel_id, round(hours, 6) AS hours, score AS score_real, level AS level_real, (hours IS NOT NULL)::INT + plan::INT AS reasons FROM rs")
def r1(spark, sf):
    return recency(spark, sf).select("channel_id", F.round("hours", 6).alias("hours"), "score_real", "level_real", F.size("reasons").alias("reasons"))


@query("r13_section_fold", f""", {RECENCY}, x AS (SELECT rs.*, c.section_id, row_number() OVER (PARTITION BY c.section_id ORDER BY CASE level WHEN 'high' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END DESC, score DESC, channel_id) AS k FROM rs JOIN c USING (channel_id))
SELECT section_id, max(channel_id) FILTER (k = 1) AS channel_id, max(score) FILTER (k = 1) AS score, max(level) FILTER (k = 1) AS level, greatest(0, count(*) FILTER (level <> 'normal') - 3)::INT AS more FROM x GROUP BY 1""")
def r13(spark, sf):
    s = recency(spark, sf).join(channels(spark, sf).select("channel_id", "section_id"), "channel_id").select("channel_id", "section_id", F.col("score_real").alias("score"), F.col("level_real").alias("level"))
    return R.fold_sections(s, channels(spark, sf)).select("section_id", "channel_id", "score", "level", "more")


@query("a15_risk_summary", f", {RECENCY} SELECT level, count(*) AS n, round(sum(score), 6) AS score FROM rs GROUP BY 1")
def a15(spark, sf):
    return recency(spark, sf).groupBy(F.col("level_real").alias("level")).agg(F.count("*").alias("n"), F.round(F.sum("score_real"), 6).alias("score"))


@query("a17_section_weights", """
, f AS (SELECT s.section_id, s.section_id % 5 AS object_id, count(ep.started_at) AS n FROM (SELECT DISTINCT section_id FROM c) s LEFT JOIN ep ON ep.section_id = s.section_id GROUP BY 1)
SELECT section_id, object_id, round((n + 0.5) / (sum(n) OVER (PARTITION BY object_id) + 0.5 * count(*) OVER (PARTITION BY object_id)), 6) AS weight FROM f""")
def a17(spark, sf):
    return section_weights(spark, sf).select("section_id", "object_id", F.round("weight", 6).alias("weight"))


def section_weights(spark, sf, alpha=0.5):
    n = rule_episodes(spark, sf).groupBy("section_id").agg(F.count("*").alias("n"))
    s = channels(spark, sf).select("section_id").distinct().withColumn("object_id", F.col("section_id") % 5).join(n, "section_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("object_id")
    return s.withColumn("weight", (F.col("n") + alpha) / (F.sum("n").over(w) + alpha * F.count("*").over(w)))


@query("d3_weights_sum", "SELECT count(*) AS broken FROM (SELECT 1 WHERE false)")
def d3(spark, sf):
    return D.sums_off(section_weights(spark, sf), "object_id", "weight").agg(F.count("*").alias("broken"))


@query("a18_alpha_sensitivity", """
, f AS (SELECT s.section_id, s.section_id % 5 AS object_id, count(ep.started_at) AS n FROM (SELECT DISTINCT section_id FROM c) s LEFT JOIN ep ON ep.section_id = s.section_id GROUP BY 1),
w AS (SELECT a, (n + a) / (sum(n) OVER (PARTITION BY a, object_id) + a * count(*) OVER (PARTITION BY a, object_id)) AS weight FROM f, (VALUES (0.5), (1.0), (5.0)) v(a)) SELECT a::DOUBLE AS alpha, round(max(weight), 6) AS max_share FROM w GROUP BY 1""")
def a18(spark, sf):
    n = section_weights(spark, sf).select("section_id", "object_id", "n").withColumn("alpha", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(5.0))))
    w = Window.partitionBy("alpha", "object_id")
    return n.withColumn("weight", (F.col("n") + F.col("alpha")) / (F.sum("n").over(w) + F.col("alpha") * F.count("*").over(w))).groupBy("alpha").agg(F.round(F.max("weight"), 6).alias("max_share"))


@query("r16_spread", """
, f AS (SELECT s.section_id, s.section_id % 5 AS object_id, count(ep.started_at) AS n FROM (SELECT DISTINCT section_id FROM c) s LEFT JOIN ep ON ep.section_id = s.section_id GROUP BY 1),
w AS (SELECT *, (n + 0.5) / (sum(n) OVER (PARTITION BY object_id) + 0.5 * count(*) OVER (PARTITION BY object_id)) AS weight, CASE WHEN object_id = 0 THEN 0.1 + section_id / 100 WHEN section_id = 4 THEN 0.3 ELSE 0.8 END AS p FROM f),
v AS (SELECT *, max(p) OVER o - min(p) OVER o > 1e-9 AS apart, avg(p) OVER o AS m, sum(weight) OVER o AS t FROM w WHERE section_id % 10 <> 4 WINDOW o AS (PARTITION BY object_id))
SELECT section_id, round(CASE WHEN apart THEN p ELSE m * weight / t END, 6) AS spread FROM v""")
def r16(spark, sf):
    """Section 4 differs from its object's others but has no weight: they are spread all the same."""
    w = section_weights(spark, sf)
    p = w.select("section_id", "object_id", F.when(F.col("object_id") == 0, 0.1 + F.col("section_id") / 100).when(F.col("section_id") == 4, 0.3).otherwise(0.8).alias("probability"))
    return R.spread(p, w.where("section_id % 10 <> 4")).select("section_id", F.round("spread", 6).alias("spread"))


@query("r17_risk_rank", f""", {RECENCY} SELECT channel_id AS section_id, row_number() OVER (ORDER BY CASE level WHEN 'high' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END DESC, score DESC, CASE system_kind WHEN 'gas' THEN 1 WHEN 'fire' THEN 2 WHEN 'security' THEN 3 ELSE 4 END, channel_id) AS risk_rank FROM rs JOIN c USING (channel_id)""")
def r17(spark, sf):
    rows = recency(spark, sf).join(channels(spark, sf).select("channel_id", "system_kind"), "channel_id")
    rows = rows.select(F.lit(1).alias("run_id"), F.col("channel_id").alias("section_id"), F.col("level_real").alias("level"), F.col("score_real").alias("probability"), F.col("system_kind").alias("system"))
    return R.risk_ranks(rows, ["run_id"]).select("section_id", F.col("risk_rank").cast("long").alias("risk_rank"))


@query("r18_r19_write_policy")
def r19(spark, sf):
    rows = journal(spark, sf).select("channel_id", "read_time", (F.col("value_num") / 100).alias("probability"))
    return R.write_policy(rows, "channel_id", "read_time", "probability", {"threshold": 0.5, "heartbeat_min": 1440.0})


@query("r22_worst_sections", """
, f AS (SELECT section_id, count(*) AS n FROM ep GROUP BY 1) SELECT section_id, k AS place FROM (SELECT section_id, row_number() OVER (PARTITION BY section_id % 5 ORDER BY n DESC, section_id) AS k FROM f) WHERE k <= 2""")
def r22(spark, sf):
    n = rule_episodes(spark, sf).groupBy("section_id").agg(F.count("*").alias("weight")).withColumn("collector", F.col("section_id") % 5)
    return R.heaviest_sections(n, 2).select("section_id", F.col("place").cast("long").alias("place"))


@query("r23_r24_orders", """
, w AS (SELECT DISTINCT 'col' || (user_id % 5) AS prefix, date_trunc('hour', ts) AS t FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-29'),
f AS (SELECT section_id, 'col' || (section_id % 5) AS prefix, count(*) AS n FROM ep GROUP BY 1), tp AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, section_id) AS k FROM f),
o AS (SELECT w.prefix, t, section_id, 'warn:' || w.prefix || ':' || strftime(t, '%Y-%m-%dT%H:%M:%S') || ':' || section_id AS source_key FROM w JOIN tp ON tp.prefix = w.prefix AND k <= 2 WHERE section_id <> 7),
z AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY t DESC, source_key) AS r, count(*) OVER (PARTITION BY section_id) AS n FROM o)
SELECT source_key, (n - 1)::INT AS superseded FROM z WHERE r = 1""")
def r24(spark, sf):
    e = journal(spark, sf).where("is_alarm").where(F.col("read_time") >= stamp("2024-01-29"))
    warnings = e.select(F.concat(F.lit("col"), F.col("channel_id") % 5).alias("prefix"), F.date_trunc("hour", "read_time").alias("t")).distinct()
    weights = rule_episodes(spark, sf).groupBy("section_id").agg(F.count("*").alias("weight")).withColumn("prefix", F.concat(F.lit("col"), F.col("section_id") % 5))
    orders = R.orders_for_warnings(warnings, weights, 2)
    none = spark.createDataFrame([], "source_key string")
    live = spark.createDataFrame([(7,)], "section_id long")
    return R.apply_selections(orders, none, live).select("source_key", F.size("superseded").alias("superseded"))


@query("r26_due", "SELECT o_orderkey, epoch_us(o_orderdate) + (least(CASE o_orderpriority[1] WHEN '1' THEN 4.5 WHEN '2' THEN 24 ELSE 96 END, 72) * 3.6e9)::BIGINT AS due FROM orders")
def r26(spark, sf):
    o = table(spark, sf, "orders")
    hours = F.when(F.substring("o_orderpriority", 1, 1) == "1", 4.5).when(F.substring("o_orderpriority", 1, 1) == "2", 24.0).otherwise(96.0)
    return o.select("o_orderkey", us(R.due_at(F.col("o_orderdate"), hours, 72)).alias("due"))


@query("r27_first_wins", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1")
def r27(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return R.insert_new(o.where("o_custkey % 3 = 0"), o, "o_custkey", ["o_orderkey"])


@query("d10_dead_zone", f", {SCORES} SELECT count(*) FILTER (abs(score - 0.5) < 0.1) AS inside, max(score) FILTER (score <= 0.4) AS below, min(score) FILTER (score >= 0.6) AS above FROM sc")
def d10(spark, sf):
    return D.near_threshold(scores(spark, sf), 0.5, 0.1)


@query("d13_uncovered", """SELECT DISTINCT section_id FROM c WHERE section_id NOT IN (SELECT o_orderkey % 20 FROM orders WHERE o_orderpriority LIKE '1%') AND section_id % 7 <> 0 AND section_id <> 3""")
def d13(spark, sf):
    s = channels(spark, sf).select("section_id").distinct()
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select((F.col("o_orderkey") % 20).alias("section_id"))
    return D.uncovered(s, o, s.where("section_id % 7 = 0"), s.where("section_id = 3"))
