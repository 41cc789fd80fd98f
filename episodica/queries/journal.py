"""Queries over the journal: cleaning, episodes, rollups, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import episodes as E
from ..operators import joins as J
from ..operators import quality as D
from ..operators import rollup as A
from .base import END, channels, journal, query, stamp, table, us

RULE_EPISODES = "SELECT channel_id, section_id, epoch_us(started_at) AS started, epoch_us(ended_at) AS ended, rows_cnt, fault_value, closed_by FROM ep"


def rule_episodes(spark, sf):
    """Episodes of 'error' longer than an hour, by the rule table and the universal rule."""
    rows = [(f"kind{i}", "error", 3600) for i in range(3)]
    rules = spark.createDataFrame(rows, "sensor_kind string, fault_value string, min_seconds int")
    chans = channels(spark, sf)
    rules = E.fault_rules(rules, rules)
    marked = E.mark_bad(journal(spark, sf), chans, rules)
    return E.long_episodes(E.episodes(marked, {"rule": F.col("bad")}), stamp(END), F.lit(3600))


def shown(ep):
    return ep.select("channel_id", "section_id", us("started_at").alias("started"), us("ended_at").alias("ended"), F.col("rows_cnt").cast("long").alias("rows_cnt"), "fault_value", "closed_by")


@query("e1_rule_episodes", RULE_EPISODES)
def e1(spark, sf):
    return shown(rule_episodes(spark, sf))


@query("e2_vocabulary_episodes", """
, n2 AS (SELECT *, value_text IN ('error', 'purchase') AS b2, lag(value_text IN ('error', 'purchase')) OVER w AS p2, lead(read_time) OVER w AS nt2 FROM j WINDOW w AS (PARTITION BY channel_id ORDER BY read_time, journal_id)),
g2 AS (SELECT *, sum(CASE WHEN NOT coalesce(p2, false) THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id ROWS UNBOUNDED PRECEDING) AS run FROM n2 WHERE b2)
SELECT channel_id, epoch_us(min(read_time)) AS started, (list(epoch_us(nt2) ORDER BY read_time DESC, journal_id DESC))[1] AS ended, count(*) AS rows_cnt, arg_min(value_text, (read_time, journal_id)) AS fault_value
FROM g2 GROUP BY channel_id, run""")
def e2(spark, sf):
    ep = E.episodes(journal(spark, sf), {"words": F.col("value_text").isin("error", "purchase")})
    return ep.select("channel_id", us("started_at").alias("started"), us("ended_at").alias("ended"), F.col("rows_cnt").cast("long").alias("rows_cnt"), "fault_value")


@query("e3_multi_predicate", """
, m AS (SELECT *, lead(read_time) OVER w AS nt, lag(value_text) OVER w AS pv FROM j WHERE read_time <= TIMESTAMP '2024-01-20' WINDOW w AS (PARTITION BY channel_id ORDER BY read_time, journal_id)),
x AS (SELECT 'error' AS predicate, *, sum(CASE WHEN coalesce(pv, '') <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id ROWS UNBOUNDED PRECEDING) AS run FROM m WHERE value_text = 'error'
      UNION ALL
      SELECT 'alarm', *, sum(CASE WHEN coalesce(pv, '') <> 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id ROWS UNBOUNDED PRECEDING) FROM m WHERE value_text = 'signup')
SELECT predicate, channel_id, epoch_us(min(read_time)) AS started, CASE WHEN count(nt) = count(*) THEN epoch_us(max(nt)) END AS ended, count(*) AS rows_cnt FROM x GROUP BY predicate, channel_id, run""")
def e3(spark, sf):
    ep = E.episodes(journal(spark, sf), {"error": F.col("value_text") == "error", "alarm": F.col("is_alarm")}, ts_to=stamp("2024-01-20"))
    return ep.select("predicate", "channel_id", us("started_at").alias("started"), us("ended_at").alias("ended"), F.col("rows_cnt").cast("long").alias("rows_cnt"))


@query("e4_failure_definition", """
SELECT channel_id, epoch_us(started_at) AS started FROM ep0 WHERE epoch_us(ended_at) - epoch_us(started_at) > 7200000000 AND closed_by IN ('view', 'click')
UNION ALL SELECT channel_id, epoch_us(started_at) FROM ep0 WHERE epoch_us(coalesce(ended_at, TIMESTAMP '2024-01-31')) - epoch_us(started_at) > 86400000000""")
def e4(spark, sf):
    ep = E.episodes(journal(spark, sf), {"error": F.col("value_text") == "error"})
    parts = [{"predicate": "error", "hours": 2, "close_in": ("view", "click"), "keep_open": False}, {"predicate": "error", "hours": 24}]
    return E.define_failures(ep, parts, stamp(END)).select("channel_id", us("started_at").alias("started"))


@query("e5_bursts", """
, s AS (SELECT channel_id, started_at, row_number() OVER (PARTITION BY channel_id, started_at::DATE ORDER BY started_at) AS k FROM ep0 WHERE ended_at IS NOT NULL AND epoch_us(ended_at) - epoch_us(started_at) <= 28800000000)
SELECT channel_id, epoch_us(started_at) AS started FROM s WHERE k = 2""")
def e5(spark, sf):
    ep = E.episodes(journal(spark, sf), {"error": F.col("value_text") == "error"})
    return E.bursts(ep, 2, 28800).select("channel_id", us("started_at").alias("started"))


INCIDENTS = """
i0 AS (SELECT c.collector, started_at, CASE WHEN epoch_us(started_at) - epoch_us(lag(started_at) OVER w) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM ep JOIN c USING (channel_id) WINDOW w AS (PARTITION BY c.collector ORDER BY started_at)),
i1 AS (SELECT *, sum(fresh) OVER (PARTITION BY collector ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS run FROM i0),
inc AS (SELECT collector, min(started_at) AS first_at, max(started_at) AS last_at, count(*) AS events FROM i1 GROUP BY collector, run)"""


def incidents(spark, sf):
    ep = rule_episodes(spark, sf).select("channel_id", "started_at").join(channels(spark, sf).select("channel_id", "collector"), "channel_id")
    return E.merge_incidents(ep, "collector", "started_at", 60)


@query("e7_incidents", f", {INCIDENTS} SELECT collector, epoch_us(first_at) AS first_us, epoch_us(last_at) AS last_us, events FROM inc")
def e7(spark, sf):
    return incidents(spark, sf).select("collector", us("first_at").alias("first_us"), us("last_at").alias("last_us"), "events")


@query("e8_group_keys", "SELECT coalesce('obj:' || nullif(user_id % 5, 0), 'ch:' || user_id) AS grp, count(*) AS n FROM events GROUP BY 1")
def e8(spark, sf):
    e = table(spark, sf, "events")
    node = F.nullif(F.col("user_id") % 5, F.lit(0))
    return e.groupBy(E.group_key(node, F.col("user_id")).alias("grp")).agg(F.count("*").alias("n"))


@query("e9_sealed", "SELECT channel_id, epoch_us(started_at) AS started, CASE WHEN ended_at <= TIMESTAMP '2024-01-15' THEN epoch_us(ended_at) END AS ended FROM ep WHERE started_at <= TIMESTAMP '2024-01-15'")
def e9(spark, sf):
    return E.seal(rule_episodes(spark, sf), stamp("2024-01-15")).select("channel_id", us("started_at").alias("started"), us("ended_at").alias("ended"))


@query("e11_confirmed", "SELECT channel_id, count(*) AS n FROM ep WHERE epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(started_at) >= 3601000000 GROUP BY channel_id")
def e11(spark, sf):
    return rule_episodes(spark, sf).where(E.confirmed(F.col("started_at"), stamp("2024-01-15 12:00:00"))).groupBy("channel_id").agg(F.count("*").alias("n"))


@query("e12_diagnostics", "SELECT fault_value, count(*) AS episodes, count(DISTINCT channel_id) AS channels, count(*) FILTER (ended_at IS NULL) AS open FROM ep GROUP BY fault_value")
def e12(spark, sf):
    return E.episode_diagnostics(rule_episodes(spark, sf), ["fault_value"])


@query("e13_chart_episodes", """SELECT channel_id, epoch_us(started_at) AS started, epoch_us(least(coalesce(ended_at, TIMESTAMP '2024-01-12'), TIMESTAMP '2024-01-12')) AS shown FROM ep
WHERE started_at >= TIMESTAMP '2024-01-10' AND started_at < TIMESTAMP '2024-01-12' AND epoch_us(least(coalesce(ended_at, TIMESTAMP '2024-01-12'), TIMESTAMP '2024-01-12')) - epoch_us(started_at) > 3600000000""")
def e13(spark, sf):
    return E.chart_episodes(rule_episodes(spark, sf), stamp("2024-01-10"), stamp("2024-01-12")).select("channel_id", us("started_at").alias("started"), us("shown_until").alias("shown"))


@query("e14_collapsed_repeats", """
, s AS (SELECT *, CASE WHEN value_text IS DISTINCT FROM lag(value_text) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f FROM j WINDOW w AS (PARTITION BY channel_id ORDER BY read_time, journal_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT channel_id, min(value_text) AS value_text, arg_min(journal_id, (read_time, journal_id)) AS first_id, count(*) AS repeats FROM r GROUP BY channel_id, run""")
def e14(spark, sf):
    return E.collapse_repeats(journal(spark, sf), "channel_id", ["read_time", "journal_id"], ["value_text"]).select("channel_id", "value_text", F.col("journal_id").alias("first_id"), "repeats")


@query("j10_outage_overlap", """SELECT channel_id, epoch_us(started_at) AS started, started_at < TIMESTAMP '2024-01-11 06:00:00' AND TIMESTAMP '2024-01-10 00:00:00' < coalesce(ended_at, TIMESTAMP '2024-01-31') AS spans FROM ep""")
def j10(spark, sf):
    gaps = spark.createDataFrame([("2024-01-10 00:00:00", "2024-01-11 06:00:00", "export_gap"), ("2024-01-20 00:00:00", "2024-01-22 00:00:00", "vendor_migration")], "a string, b string, reason string")
    gaps = gaps.select(F.col("a").cast("timestamp").alias("started_at"), F.col("b").cast("timestamp").alias("ended_at"), "reason")
    return E.spans_outage(rule_episodes(spark, sf), gaps, stamp(END)).select("channel_id", us("started_at").alias("started"), F.col("spans_outage").alias("spans"))


CARD = """SELECT c.channel_id, count(ep.started_at) AS failures, epoch_us(max(ep.started_at)) AS last_us, round(avg((epoch_us(ep.ended_at) - epoch_us(ep.started_at)) / 3.6e9), 6) AS mean_hours
FROM c LEFT JOIN ep USING (channel_id) GROUP BY c.channel_id"""


@query("entry_failure_card", CARD)
def a13(spark, sf):
    """Failure card of every channel: count, last start and mean hours of closed episodes, zero rows included."""
    hours = (us("ended_at") - us("started_at")) / 3.6e9
    ep = rule_episodes(spark, sf).groupBy("channel_id").agg(F.count("*").alias("failures"), F.max(us("started_at")).alias("last_us"), F.round(F.avg(hours), 6).alias("mean_hours"))
    return channels(spark, sf).select("channel_id").join(ep, "channel_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))


@query("a14_failure_history", "SELECT channel_id, epoch_us(started_at) AS started, round((epoch_us(ended_at) - epoch_us(started_at)) / 3.6e9, 6) AS hours, row_number() OVER (PARTITION BY channel_id ORDER BY started_at DESC) AS place FROM ep")
def a14(spark, sf):
    from pyspark.sql import Window

    ep = rule_episodes(spark, sf)
    place = F.row_number().over(Window.partitionBy("channel_id").orderBy(F.col("started_at").desc())).cast("long")
    return ep.select("channel_id", us("started_at").alias("started"), F.round((us("ended_at") - us("started_at")) / 3.6e9, 6).alias("hours"), place.alias("place"))


@query("a1_section_daily", """
, l AS (SELECT section_id, count(*) AS listed FROM c GROUP BY section_id)
SELECT j.section_id, strftime(read_time, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (is_alarm) AS alarms, count(*) FILTER (is_alarm AND system_kind = 'gas') AS alarms_gas, count(*) FILTER (is_alarm AND system_kind = 'fire') AS alarms_fire,
count(DISTINCT j.channel_id) AS active, greatest(0, max(listed) - count(DISTINCT j.channel_id)) AS silent, max(value_num) AS max_value
FROM j JOIN c USING (channel_id) JOIN l ON l.section_id = j.section_id GROUP BY 1, 2""")
def a1(spark, sf):
    out = A.section_daily(journal(spark, sf), channels(spark, sf), ["gas", "fire"])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a2_channel_daily", "SELECT channel_id, strftime(read_time, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (value_text = 'error') AS faults, count(*) FILTER (value_text = 'purchase') AS undefined, max(epoch_us(read_time)) AS last_us FROM j GROUP BY 1, 2")
def a2(spark, sf):
    out = A.channel_daily(journal(spark, sf), F.col("value_text") == "error", F.col("value_text") == "purchase")
    return out.select("channel_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "faults", "undefined", us("last_read").alias("last_us"))


CHANDAY = """cd AS (SELECT channel_id, read_time::DATE AS day, count(*) AS n, count(*) FILTER (value_text = 'error') AS n_bad, count(*) FILTER (is_alarm) AS n_alarm, count(DISTINCT value_text) AS n_values, count(value_num) AS n_numeric,
arg_max(value_num, (read_time, journal_id)) FILTER (value_num IS NOT NULL) AS last_number FROM j GROUP BY 1, 2)"""


def chanday(spark, sf):
    return A.channel_day(journal(spark, sf), {"bad": F.col("value_text") == "error", "alarm": F.col("is_alarm")})


@query("a3_channel_day", f", {CHANDAY} SELECT channel_id, strftime(day, '%Y-%m-%d') AS day, n, n_bad, n_alarm, n_values, n_numeric, last_number FROM cd")
def a3(spark, sf):
    return chanday(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a4_prefix_day", f""", {CHANDAY}, l AS (SELECT collector, count(*) AS listed FROM c GROUP BY 1)
SELECT c.collector AS prefix, strftime(day, '%Y-%m-%d') AS day, sum(n)::BIGINT AS n, count(*) AS active, count(*) FILTER (n_bad > 0) AS channels_bad, sum(n_bad)::BIGINT AS n_bad, sum(n_alarm)::BIGINT AS n_alarm, max(listed) AS listed
FROM cd JOIN c USING (channel_id) JOIN l USING (collector) GROUP BY 1, 2""")
def a4(spark, sf):
    prefixes = channels(spark, sf).select("channel_id", F.col("collector").alias("prefix"))
    return A.prefix_day(chanday(spark, sf), prefixes, ["n_bad", "n_alarm"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a5_calendar", f""", {CHANDAY}, d AS (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day),
f AS (SELECT d.day, coalesce(sum(n), 0)::BIGINT AS rows FROM d LEFT JOIN cd USING (day) GROUP BY d.day),
m AS (SELECT year(day) AS y, quantile_cont(rows, 0.5) AS med FROM f GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, rows, rows < 0.1 * med AS outage, CASE WHEN rows < 0.1 * med AND day < DATE '2024-01-20' THEN NULL WHEN day < DATE '2024-01-20' THEN 'train' ELSE 'test' END AS split FROM f JOIN m ON m.y = year(day)""")
def a5(spark, sf):
    split = F.when(F.col("day") < F.lit("2024-01-20").cast("date"), "train").otherwise("test")
    return A.calendar(chanday(spark, sf), "2023-12-25", "2024-02-05", split).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a9_window_counts", f""", {CHANDAY} SELECT channel_id, sum(CASE WHEN DATE '2024-01-25' - day BETWEEN 0 AND 0 THEN n ELSE 0 END)::BIGINT AS last_1, sum(CASE WHEN DATE '2024-01-25' - day BETWEEN 0 AND 6 THEN n ELSE 0 END)::BIGINT AS last_7,
sum(CASE WHEN DATE '2024-01-25' - day BETWEEN 0 AND 29 THEN n ELSE 0 END)::BIGINT AS last_30, strftime(max(day), '%Y-%m-%d') AS last_day FROM cd WHERE day <= DATE '2024-01-25' GROUP BY 1""")
def a9(spark, sf):
    out = A.window_counts(chanday(spark, sf), "channel_id", F.lit("2024-01-25").cast("date"), "n", (1, 7, 30))
    return out.withColumn("last_day", F.date_format("last_day", "yyyy-MM-dd"))


@query("a10_exact_counts", """SELECT channel_id, count(*) FILTER (read_time > TIMESTAMP '2024-01-25 09:30:00' - INTERVAL 7 DAY AND read_time <= TIMESTAMP '2024-01-25 09:30:00') AS last_7,
count(*) FILTER (read_time > TIMESTAMP '2024-01-25 09:30:00' - INTERVAL 20 DAY AND read_time <= TIMESTAMP '2024-01-25 09:30:00') AS last_20 FROM j WHERE read_time >= TIMESTAMP '2024-01-01' GROUP BY 1""")
def a10(spark, sf):
    rows = journal(spark, sf)
    days = A.channel_daily(rows, F.lit(False), F.lit(False))
    return A.exact_counts(days, rows, "channel_id", stamp("2024-01-25 09:30:00"), (7, 20))


@query("a11_gap_statistics", """
, g AS (SELECT channel_id, (epoch_us(read_time) - epoch_us(lag(read_time) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id))) / 1e6 AS gap FROM j),
p AS (SELECT channel_id, count(gap) AS gaps, quantile_cont(gap, 0.5) AS m, quantile_cont(gap, 0.95) AS p95, max(gap) AS mx FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT p.channel_id, any_value(gaps) AS gaps, round(any_value(m), 3) AS median_gap, round(any_value(p95), 3) AS p95_gap, round(any_value(mx), 3) AS max_gap,
CASE WHEN any_value(gaps) >= 20 THEN round(count(*) FILTER (gap > p95) / any_value(gaps), 6) END AS long_share FROM p JOIN g USING (channel_id) WHERE gap IS NOT NULL GROUP BY 1""")
def a11(spark, sf):
    out = A.gap_statistics(journal(spark, sf))
    return out.select("channel_id", "gaps", *[F.round(c, 3).alias(c) for c in ("median_gap", "p95_gap", "max_gap")], F.round("long_share", 6).alias("long_share"))


@query("a12_failures_by_section", "SELECT section_id, count(*) AS n FROM ep WHERE started_at > TIMESTAMP '2024-01-01' AND started_at <= TIMESTAMP '2024-01-31' GROUP BY 1")
def a12(spark, sf):
    return rule_episodes(spark, sf).where((F.col("started_at") > stamp("2024-01-01")) & (F.col("started_at") <= stamp("2024-01-31"))).groupBy("section_id").agg(F.count("*").alias("n"))


@query("w3_frozen", """
, s AS (SELECT channel_id, round(value_num) = round(lag(value_num) OVER w) AND round(value_num) = round(lag(value_num, 2) OVER w) AS same FROM j WINDOW w AS (PARTITION BY channel_id ORDER BY read_time, journal_id))
SELECT channel_id, CASE WHEN count(*) > 2 THEN coalesce(bool_or(same), false) END AS frozen FROM s GROUP BY 1""")
def w3(spark, sf):
    return A.frozen(journal(spark, sf).withColumn("value_num", F.round("value_num")))


GRID = f"""{CHANDAY}, sp AS (SELECT channel_id, min(day) AS a FROM cd GROUP BY 1),
gd AS (SELECT sp.channel_id, unnest(generate_series(a, DATE '2024-02-10', INTERVAL 1 DAY))::DATE AS day FROM sp),
gg AS (SELECT gd.channel_id, gd.day, coalesce(n, 0) AS n, coalesce(n_bad, 0) AS n_bad, gd.day - max(CASE WHEN n IS NOT NULL THEN gd.day END) OVER (PARTITION BY gd.channel_id ORDER BY gd.day) AS dsr
       FROM gd LEFT JOIN cd USING (channel_id, day)),
gx AS (SELECT * FROM gg WHERE dsr <= 10)"""


def grid(spark, sf):
    days = chanday(spark, sf).select("channel_id", "day", "n", "n_bad")
    return A.dense_grid(days, "channel_id", ["n", "n_bad"], last=F.lit("2024-02-10").cast("date"), alive_within=10)


@query("g1_dense_grid", f", {GRID} SELECT channel_id, strftime(day, '%Y-%m-%d') AS day, n, n_bad, dsr::INT AS days_since_record FROM gx")
def g1(spark, sf):
    return grid(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("w4_calendar_sums", f""", {GRID} SELECT channel_id, strftime(day, '%Y-%m-%d') AS day, (sum(n) OVER (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))::BIGINT AS n_7,
(sum(n) OVER (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW))::BIGINT AS n_28 FROM gx""")
def w4(spark, sf):
    return A.calendar_sums(grid(spark, sf), "channel_id", ["n"], (7, 28)).select("channel_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_7", "n_28")


@query("w5_days_since_bad", f", {GRID} SELECT channel_id, strftime(day, '%Y-%m-%d') AS day, (day - max(CASE WHEN n_bad > 0 THEN day END) OVER (PARTITION BY channel_id ORDER BY day))::INT AS since_bad FROM gx")
def w5(spark, sf):
    return A.days_since(grid(spark, sf), "channel_id", F.col("n_bad") > 0, "since_bad").select("channel_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "since_bad")


@query("w6_channel_health", f""", {GRID}, q AS (SELECT *, sum(n) OVER (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS n7, sum(n) OVER (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW) AS n365,
day - max(CASE WHEN n_bad > 0 THEN day END) OVER (PARTITION BY channel_id ORDER BY day) AS sb FROM gx)
SELECT channel_id % 5 AS grp, strftime(day, '%Y-%m-%d') AS day, count(*) AS alive, count(*) FILTER (52 * n7 < 0.3 * n365) AS dying, max(sb)::INT AS max_since_bad, max(dsr)::INT AS max_since_record FROM q GROUP BY 1, 2""")
def w6(spark, sf):
    g = grid(spark, sf).withColumn("grp", (F.col("channel_id") % 5).cast("long"))
    return A.channel_health(g, "channel_id", "grp").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("w7_active_seven_days", f""", {CHANDAY}, x AS (SELECT channel_id, unnest(generate_series(day, day + 6, INTERVAL 1 DAY))::DATE AS day FROM cd)
SELECT channel_id % 5 AS grp, strftime(day, '%Y-%m-%d') AS day, count(DISTINCT channel_id) AS active FROM x GROUP BY 1, 2""")
def w7(spark, sf):
    days = chanday(spark, sf).withColumn("grp", (F.col("channel_id") % 5).cast("long"))
    return A.active_over_days(days, "channel_id", "grp").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a6_methane_daily", """
, m AS (SELECT read_time::DATE AS day, channel_id, (value_num / 20 - 0.5) AS x FROM j)
SELECT strftime(day, '%Y-%m-%d') AS day, channel_id, count(*) AS n, count(*) FILTER (x >= 0 AND x <= 15) AS n_valid, count(*) FILTER (x < 0) AS n_negative, count(*) FILTER (x > 15) AS n_above,
round(avg(CASE WHEN x >= 0 AND x <= 15 THEN x END), 6) AS mean, count(*) FILTER (x >= 1 AND x <= 15) AS n_high, strftime(day + 1, '%Y-%m-%d') AS available_at FROM m GROUP BY m.day, channel_id""")
def a6(spark, sf):
    rows = journal(spark, sf).withColumn("x", F.col("value_num") / 20 - 0.5).withColumn("day", F.to_date("read_time"))
    text = F.format_string("%.12f", "x")
    out = A.methane_daily(rows, clean.methane_quality(text), F.col("x"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "channel_id", "n", "n_valid", "n_negative", "n_above", F.round("mean", 6).alias("mean"), "n_high", F.date_format("available_at", "yyyy-MM-dd").alias("available_at"))


@query("a7_calibration_days", """
, m AS (SELECT read_time::DATE AS day, channel_id, (value_num / 20 - 0.5) AS x FROM j),
h AS (SELECT day FROM m WHERE x >= 1 AND x <= 15 GROUP BY day HAVING count(DISTINCT channel_id) >= 10)
SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT channel_id) AS channels, day IN (SELECT day FROM h) AS calibration FROM m GROUP BY day""")
def a7(spark, sf):
    rows = journal(spark, sf).withColumn("x", F.col("value_num") / 20 - 0.5).withColumn("day", F.to_date("read_time"))
    marked = A.calibration_days(A.methane_daily(rows, clean.methane_quality(F.format_string("%.12f", "x")), F.col("x")))
    return marked.groupBy("day").agg(F.count("*").alias("channels"), F.bool_or("calibration").alias("calibration")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("d1_overlapping", "SELECT channel_id, epoch_us(started_at) AS started FROM (SELECT *, lead(started_at) OVER (PARTITION BY section_id ORDER BY started_at) AS nx FROM ep) WHERE nx IS NOT NULL AND (ended_at IS NULL OR nx < ended_at)")
def d1(spark, sf):
    return D.overlapping(rule_episodes(spark, sf), "section_id").select("channel_id", us("started_at").alias("started"))


@query("d2_bad_episodes", "SELECT count(*) AS bad FROM ep WHERE ended_at IS NOT NULL AND (closed_by = fault_value OR epoch_us(ended_at) - epoch_us(started_at) <= 7200000000)")
def d2(spark, sf):
    return D.bad_episodes(rule_episodes(spark, sf), 7200).agg(F.count("*").alias("bad"))


@query("d6_missing_months", "SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(min(date_trunc('month', o_orderdate)), max(date_trunc('month', o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders WHERE month(o_orderdate) <> 5) WHERE m NOT IN (SELECT date_trunc('month', o_orderdate) FROM orders WHERE month(o_orderdate) <> 5)")
def d6(spark, sf):
    o = table(spark, sf, "orders").where(F.month("o_orderdate") != 5)
    return D.missing_months(o, "o_orderdate").select(F.date_format("month", "yyyy-MM").alias("month"))


@query("d7_coverage_days", f", {CHANDAY} SELECT count(DISTINCT day) AS days_a, count(DISTINCT CASE WHEN n_bad > 0 THEN day END) AS days_b, count(DISTINCT CASE WHEN n_bad > 0 THEN day END) AS common, true AS ok FROM cd")
def d7(spark, sf):
    days = chanday(spark, sf)
    return D.coverage_days(days, days.where("n_bad > 0"))


@query("d11_schedule_gaps", """
, g AS (SELECT section_id, read_time, journal_id, (epoch_us(read_time) - epoch_us(lag(read_time) OVER (PARTITION BY section_id ORDER BY read_time))) / 1e6 AS gap FROM j),
s AS (SELECT *, greatest(quantile_cont(gap, 0.5) OVER (PARTITION BY section_id ORDER BY read_time ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), quantile_cont(gap, 0.5) OVER (PARTITION BY section_id ORDER BY read_time ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) AS step FROM g)
SELECT section_id, epoch_us(read_time) AS at, round(gap, 3) AS gap, round(step, 3) AS step FROM s WHERE gap > 1.5 * step""")
def d11(spark, sf):
    return D.schedule_gaps(journal(spark, sf).select("section_id", "read_time"), "section_id", "read_time").select("section_id", us("read_time").alias("at"), F.round("gap", 3).alias("gap"), F.round("step", 3).alias("step"))


TECH = """nx AS (SELECT a.journal_id, a.channel_id, a.read_time, (SELECT min((b.read_time, b.journal_id)) FROM j b WHERE b.channel_id = a.channel_id AND b.value_text <> 'error' AND b.read_time > a.read_time AND b.read_time <= a.read_time + INTERVAL 2 DAY) AS n FROM j a WHERE a.value_text = 'error')"""


@query("j8_next_normal", """
, l AS (SELECT a.journal_id, min(epoch_us(b.read_time)) AS next_us FROM j a JOIN j b ON b.channel_id = a.channel_id AND b.value_text <> 'error' AND b.read_time > a.read_time AND b.read_time <= a.read_time + INTERVAL 2 DAY WHERE a.value_text = 'error' GROUP BY 1)
SELECT a.journal_id, l.next_us, min(b.journal_id) AS next_id FROM j a LEFT JOIN l USING (journal_id) LEFT JOIN j b ON b.channel_id = a.channel_id AND epoch_us(b.read_time) = l.next_us AND b.value_text <> 'error' WHERE a.value_text = 'error' GROUP BY 1, 2""")
def j8(spark, sf):
    rows = journal(spark, sf)
    out = J.next_event(rows.where("value_text = 'error'"), rows.where("value_text <> 'error'"), "channel_id", "read_time", "journal_id", 2 * 86400 * 1_000_000)
    return out.select("journal_id", us("next_time").alias("next_us"), "next_id")


@query("p10_value_categories", "SELECT CASE value_text WHEN 'error' THEN 'fault' WHEN 'purchase' THEN 'loss' WHEN 'view' THEN 'normal' ELSE 'unknown' END AS category, count(*) AS n FROM j GROUP BY 1")
def p10(spark, sf):
    words = {"fault": ("error",), "loss": ("purchase",), "normal": ("view",)}
    return journal(spark, sf).groupBy(clean.value_category(F.col("value_text"), words).alias("category")).agg(F.count("*").alias("n"))


@query("p11_unknown_values", "SELECT value_text AS value, count(*) AS rows FROM j WHERE value_text NOT IN ('error', 'purchase', 'view') GROUP BY 1")
def p11(spark, sf):
    return clean.unknown_values(journal(spark, sf), "value_text", {"fault": ("error",), "loss": ("purchase",), "normal": ("view",)})


@query("p2_numbers", "SELECT journal_id, round(value_num, 2) AS x, value_text LIKE 'e%' AS bad FROM j")
def p2(spark, sf):
    rows = journal(spark, sf).withColumn("text", F.replace(F.format_string("%.2f", F.round("value_num", 2)), F.lit("."), F.lit(",")))
    return rows.select("journal_id", clean.parse_number(F.col("text")).alias("x"), F.col("value_text").startswith("e").alias("bad"))


@query("p17_window_filter", "SELECT channel_id, count(*) AS n FROM j WHERE read_time >= TIMESTAMP '2024-01-05' - INTERVAL 3 HOUR AND read_time < TIMESTAMP '2024-01-08' - INTERVAL 3 HOUR GROUP BY 1")
def p17(spark, sf):
    keep = clean.in_window(F.col("read_time"), "2024-01-05", "2024-01-07", "Europe/Moscow")
    return journal(spark, sf).where(keep).groupBy("channel_id").agg(F.count("*").alias("n"))


@query("p13_state_kinds", "SELECT CASE WHEN value_text LIKE '%err%' THEN 'fault' WHEN value_text LIKE '%purch%' THEN 'off' WHEN value_text LIKE '%i%' THEN 'ok' ELSE 'other' END AS kind, count(*) AS n FROM j GROUP BY 1")
def p13(spark, sf):
    return journal(spark, sf).groupBy(clean.state_kind(F.col("value_text"), ("err",), ("purch",), ("i",)).alias("kind")).agg(F.count("*").alias("n"))


@query("p14_criticality", "SELECT section_id, CASE WHEN bool_or(system_kind = 'gas') THEN 'A' WHEN bool_or(system_kind = 'fire') THEN 'B' ELSE 'C' END AS criticality FROM c GROUP BY 1")
def p14(spark, sf):
    return clean.criticality_class(channels(spark, sf), ["section_id"], "system_kind", ("gas",), ("fire",))


@query("p15_setpoints", "SELECT value_text, count(*) FILTER (CASE value_text WHEN 'error' THEN value_num >= 50 WHEN 'view' THEN value_num < 10 ELSE value_num > 90 OR value_num < 5 END) AS broken FROM j GROUP BY 1")
def p15(spark, sf):
    points = [("error", None, 50.0, "above_bad", True), ("view", 10.0, None, "below_bad", False)] + [(w, 5.0, 90.0, "normal_range", False) for w in ("click", "purchase", "signup")]
    rules = spark.createDataFrame(points, "value_text string, low double, high double, direction string, inclusive boolean")
    state = clean.setpoint_state(F.col("value_num"), F.col("low"), F.col("high"), F.col("direction"), F.col("inclusive"))
    return journal(spark, sf).join(rules, "value_text").groupBy("value_text").agg(F.count_if(state).alias("broken"))


@query("p16_gas_scale", "SELECT CASE WHEN value_num IS NULL THEN 'none' WHEN value_num < 20 THEN 'below' WHEN value_num > 60 THEN 'above' ELSE 'between' END AS zone, count(*) AS n, round(sum(greatest(0.0, least(100.0, value_num / 80 * 100))), 3) AS position, count(*) FILTER (value_num > 80 OR value_num < 0) AS off FROM j GROUP BY 1")
def p16(spark, sf):
    rows = journal(spark, sf).select(*clean.gas_scale(F.col("value_num"), F.lit(20.0), F.lit(60.0), F.lit(80.0)))
    return rows.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.sum("position"), 3).alias("position"), F.count("off_scale").alias("off"))


@query("q16_last_number", "SELECT channel_id, round(arg_max(value_num, (read_time, journal_id)), 6) AS last_number FROM j WHERE value_num IS NOT NULL GROUP BY 1")
def q16(spark, sf):
    return journal(spark, sf).where("value_num is not null").groupBy("channel_id").agg(F.round(F.max_by("value_num", F.struct("read_time", "journal_id")), 6).alias("last_number"))
