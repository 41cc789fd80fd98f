"""Queries over rule tuning, order and mapping checks, and SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import tuning as U
from ..plans import sql_text
from ..streaming import live as T
from .base import channels, journal, query, stamp, table, us
from .domain import drain, reading_stream
from .journal import rule_episodes

AGED = """ag AS (SELECT a.journal_id, (a.value_text = 'error')::INT AS label, (epoch_us(a.read_time) - epoch_us(max(ep.started_at))) / 3.6e9 AS hours FROM j a LEFT JOIN ep ON ep.channel_id = a.channel_id AND ep.started_at <= a.read_time GROUP BY 1, 2, a.read_time),
gr2 AS (SELECT h, count(*) FILTER (hours < h) AS a, count(*) FILTER (hours < h AND label = 1) AS t, (SELECT sum(label) FROM ag) AS p FROM ag, (VALUES (6.0), (24.0), (72.0), (168.0)) v(h) GROUP BY h),
fs AS (SELECT h, a, t, t / a AS pr, t / p AS rc FROM gr2)"""


def aged(spark, sf):
    rows = journal(spark, sf).withColumn("label", (F.col("value_text") == "error").cast("int")).select("journal_id", "channel_id", "read_time", "label")
    return L.last_event_hours(rows, rule_episodes(spark, sf).select("channel_id", "started_at"), "channel_id", "read_time", "started_at")


@query("r8_threshold_grid", f", {AGED} SELECT h AS rule, a AS alerts, t AS tp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / (pr + rc), 6) AS f1, round(5 * pr * rc / (4 * pr + rc), 6) AS f2 FROM fs")
def r8(spark, sf):
    out = U.rule_grid(aged(spark, sf), U.recency_rules("hours", (6, 24, 72, 168)), "label")
    return out.select(F.col("rule").cast("double").alias("rule"), "alerts", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "f2")])


@query("r8_chosen_levels")
def r8b(spark, sf):
    return U.choose_levels(aged(spark, sf), "hours", "label", (6, 24, 72, 168))


@query("r9_rule_family")
def r9(spark, sf):
    rows = L.trailing_counts(aged(spark, sf), rule_episodes(spark, sf).select("channel_id", "started_at"), "channel_id", "read_time", "started_at", {"n3": 3, "n7": 7})
    return U.rule_family(rows, "hours", {3: "n3", 7: "n7"}, "label", (6, 24, 72), (1, 2, 3))


@query("m9_silent_windows", "SELECT name FROM (VALUES ('before', TIMESTAMP '2023-01-01', TIMESTAMP '2023-02-01'), ('during', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06'), ('after', TIMESTAMP '2025-01-01', TIMESTAMP '2025-02-01')) v(name, low, high) WHERE high <= (SELECT min(ts) FROM events) OR low > (SELECT max(ts) FROM events)")
def m9(spark, sf):
    w = [("before", "2023-01-01", "2023-02-01"), ("during", "2024-01-05", "2024-01-06"), ("after", "2025-01-01", "2025-02-01")]
    windows = spark.createDataFrame(w, "name string, low string, high string").select("name", F.col("low").cast("timestamp").alias("low"), F.col("high").cast("timestamp").alias("high"))
    return U.silent_windows(journal(spark, sf), windows, "read_time").select("name")


@query("d14_uncovered_warnings", """
, w AS (SELECT DISTINCT 'w:' || user_id AS warning_key, user_id FROM events), o AS (SELECT DISTINCT 'w:' || user_id AS warning_key FROM events WHERE event_type = 'error' AND value > 97)
SELECT warning_key, user_id % 20 < 10 AND (user_id + 1) % 20 < 10 AS lawful FROM w WHERE warning_key NOT IN (SELECT warning_key FROM o)""")
def d14(spark, sf):
    key = F.concat(F.lit("w:"), "channel_id")
    rows = journal(spark, sf)
    warnings = rows.select(key.alias("warning_key")).distinct()
    orders = rows.where("value_text = 'error' and value_num > 97").select(F.concat_ws(":", key, "section_id").alias("source_key"))
    selections = rows.select("channel_id").distinct().select(key.alias("warning_key"), F.explode(F.array(F.col("channel_id") % 20, (F.col("channel_id") + 1) % 20)).alias("section_id"))
    return U.uncovered_warnings(warnings, orders, selections, channels(spark, sf).where("section_id < 10"))


@query("d16_mapping_comparison", "SELECT 'file only' AS problem, c_custkey::VARCHAR AS key, (c_nationkey + 1)::VARCHAR AS value FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'dimension only', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 11 = 0 UNION ALL SELECT 'malformed', c_custkey::VARCHAR, NULL FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 10 <> 0")
def d16(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    file_rows = c.select("k", F.when(F.col("k") % 10 == 0, F.col("v") + 1).when(F.col("k") % 11 != 0, F.col("v")).alias("v"))
    return U.compare_mapping(file_rows, c, "k", "v")


@query("u2_episodes_by_sql_text", "SELECT channel_id, epoch_us(started_at) AS started, epoch_us(ended_at) AS ended, rows_cnt, closed_by FROM ep0")
def u2(spark, sf):
    view = f"journal_{uuid.uuid4().hex}"
    sql_text.register(spark, {view: journal(spark, sf)})
    return spark.sql(sql_text.episodes_sql(view, "value_text = 'error'")).select("channel_id", us("started_at").alias("started"), us("ended_at").alias("ended"), "rows_cnt", "closed_by")


@query("u2_incidents_by_sql_text", """
, s AS (SELECT section_id, read_time, CASE WHEN epoch_us(read_time) - epoch_us(lag(read_time) OVER (PARTITION BY section_id ORDER BY read_time)) <= 600000000 THEN 0 ELSE 1 END AS f FROM j WHERE is_alarm), r AS (SELECT *, sum(f) OVER (PARTITION BY section_id ORDER BY read_time ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT section_id AS grp, epoch_us(min(read_time)) AS first_us, count(*) AS events FROM r GROUP BY section_id, run""")
def u2b(spark, sf):
    view = f"alarms_{uuid.uuid4().hex}"
    sql_text.register(spark, {view: journal(spark, sf).where("is_alarm")})
    return spark.sql(sql_text.incidents_sql(view, "section_id", "read_time", 10)).select("grp", us("first_at").alias("first_us"), "events")


@query("q13_audit_log", "SELECT event_id FROM events WHERE user_id IN (1, 2) AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def q13(spark, sf):
    rows = journal(spark, sf)
    return rows.where(F.col("channel_id").isin(1, 2) & (F.col("read_time") >= stamp("2024-01-10")) & (F.col("read_time") < stamp("2024-01-20"))).select(F.col("journal_id").alias("event_id"))


@query("t2_external_events", "SELECT min(event_id) AS source_id, event_type AS kind FROM events WHERE event_type IN ('error', 'signup') AND user_id % 20 < 15 GROUP BY event_id, event_type")
def t2(spark, sf):
    """External events of two kinds whose section exists, once by source id."""
    s = reading_stream(spark, sf).select(F.col("journal_id").alias("source_id"), "section_id", "read_time", F.col("value_text").alias("kind"))
    return drain(T.accept_external(s, channels(spark, sf).where("section_id < 15"), ("error", "signup"), "60 days").select("source_id", "kind"))


@query("t4_new_alerts", "SELECT event_id AS journal_id FROM events WHERE event_type = 'signup' AND user_id % 20 IN (1, 2, 3)")
def t4(spark, sf):
    return drain(T.new_alerts(reading_stream(spark, sf).where("is_alarm"), [1, 2, 3]).select("journal_id"))
