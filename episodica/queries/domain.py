"""Queries over listings, reliability, anomalies, permits, geometry, sources and streams."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean, geo, scalar
from ..operators import anomaly as N
from ..operators import listing as Q
from ..operators import permits as PM
from ..operators import quality as D
from ..operators import reliability as B
from ..operators import risk as R
from ..operators import rollup as A
from ..sources import journal as S
from ..streaming import live as T
from .base import END, channels, journal, query, stamp, table, us
from .journal import rule_episodes


@query("q1_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def q1(spark, sf):
    return Q.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 2)


@query("q2_technical_events", """
, al AS (SELECT * FROM j WHERE value_text = 'error' AND read_time >= TIMESTAMP '2024-01-10' AND read_time < TIMESTAMP '2024-01-20'),
nn AS (SELECT a.journal_id, a.section_id, a.channel_id, min(epoch_us(b.read_time)) AS us FROM al a JOIN j b ON b.channel_id = a.channel_id AND b.value_text <> 'error' AND b.read_time > a.read_time AND b.read_time <= a.read_time + INTERVAL 31 DAY GROUP BY 1, 2, 3),
x AS (SELECT epoch_us(read_time) AS at, 'alarm' AS kind, journal_id AS source_id, channel_id FROM al
      UNION ALL SELECT DISTINCT us, 'normal', (SELECT min(journal_id) FROM j b WHERE b.channel_id = nn.channel_id AND epoch_us(b.read_time) = us AND value_text <> 'error'), channel_id FROM nn
      UNION ALL SELECT epoch_us(o_orderdate), 'external', o_orderkey, NULL FROM orders)
SELECT * FROM x""")
def q2(spark, sf):
    rows = journal(spark, sf)
    window = (F.col("read_time") >= stamp("2024-01-10")) & (F.col("read_time") < stamp("2024-01-20"))
    external = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("text"))
    out = Q.technical_events(rows, external, alarm=(F.col("value_text") == "error") & window, normal=F.col("value_text") != "error")
    return out.select(us("at").alias("at"), "kind", "source_id", "channel_id")


@query("q3_kinds", "SELECT DISTINCT value_text AS kind FROM j UNION SELECT 'external'")
def q3(spark, sf):
    return journal(spark, sf).select(F.col("value_text").alias("kind")).union(spark.range(1).select(F.lit("external"))).distinct()


@query("q4_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def q4(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select("o_custkey"))


@query("q4_table_equality", "SELECT 0::BIGINT AS differing")
def q4b(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return D.differs(o, o.repartition(3)).agg(F.count("*").alias("differing"))


@query("q5_union_all", "SELECT part, count(*) AS n FROM (SELECT 'F' AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'high' FROM orders WHERE o_totalprice > 100000) GROUP BY 1")
def q5(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select(F.lit("F").alias("part")).unionByName(o.where("o_totalprice > 100000").select(F.lit("high").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@query("q6_latest_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def q6(spark, sf):
    return Q.latest_per_key(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("q8_last_n", "SELECT channel_id, journal_id FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY read_time DESC, journal_id DESC) AS k FROM j) WHERE k <= 3")
def q8(spark, sf):
    return Q.last_n(journal(spark, sf), "channel_id", ["read_time", "journal_id"], 3).select("channel_id", "journal_id")


@query("q10_order_list", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus IN ('O', 'P') AND o_orderpriority LIKE '1%'")
def q10(spark, sf):
    o = table(spark, sf, "orders")
    keep = clean.in_window(F.col("o_orderdate").cast("timestamp"), "1995-01-01", "1995-12-31")
    return o.where(keep & F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").startswith("1")).select("o_orderkey")


@query("q11_order_detail", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ') AS reasons, count(*) AS n FROM orders GROUP BY 1")
def q11(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("reasons"), F.count("*").alias("n"))


@query("q14_reading_window", "SELECT journal_id FROM j WHERE channel_id = 3 AND read_time >= TIMESTAMP '2024-01-05' AND read_time < TIMESTAMP '2024-01-11'")
def q14(spark, sf):
    return Q.reading_window(journal(spark, sf), "channel_id", 3, "2024-01-05", "2024-01-10").select("journal_id")


@query("q15_default_window", "SELECT strftime(max(read_time)::DATE - 6, '%Y-%m-%d') AS from_day, strftime(max(read_time), '%Y-%m-%d') AS to_day FROM j")
def q15(spark, sf):
    return Q.default_window(journal(spark, sf)).select(F.date_format("from_day", "yyyy-MM-dd").alias("from_day"), F.date_format("to_day", "yyyy-MM-dd").alias("to_day"))


@query("q19_dense_neighbours", "SELECT section_id, coalesce(bool_or(g < 30), false) AS dense FROM (SELECT section_id, (epoch_us(read_time) - epoch_us(lag(read_time) OVER (PARTITION BY section_id ORDER BY read_time))) / 1e6 AS g FROM j) GROUP BY 1")
def q19(spark, sf):
    return geo.dense_neighbours(journal(spark, sf).withColumn("p", us("read_time") / 1e6), "section_id", "p", 30)


@query("q18_array_filter", "SELECT collector, count(*) AS n FROM (SELECT collector, section_id, list(DISTINCT system_kind) AS kinds FROM c GROUP BY 1, 2) WHERE list_contains(kinds, 'gas') GROUP BY 1")
def q18(spark, sf):
    s = channels(spark, sf).groupBy("collector", "section_id").agg(F.collect_set("system_kind").alias("kinds"))
    return s.where(F.array_contains("kinds", "gas")).groupBy("collector").agg(F.count("*").alias("n"))


@query("a16_outcome_summary", """
, f AS (SELECT doc_id AS forecast_id FROM documents), o AS (SELECT doc_id AS forecast_id, CASE WHEN toxic = 1 THEN 'confirmed' WHEN quality = 0 THEN 'rejected' ELSE 'unclear' END AS code FROM labels)
SELECT count(*) AS total, count(*) FILTER (code = 'confirmed') AS confirmed, count(*) FILTER (code = 'rejected') AS rejected, 0::BIGINT AS prevented, count(*) FILTER (code = 'unclear') AS unclear, count(*) FILTER (code IS NULL) AS open FROM f LEFT JOIN o USING (forecast_id)""")
def a16(spark, sf):
    code = F.when(F.col("toxic") == 1, "confirmed").when(F.col("quality") == 0, "rejected").otherwise("unclear")
    outcomes = table(spark, sf, "labels").select(F.col("doc_id").alias("forecast_id"), code.alias("outcome_code"), F.lit(1).alias("decided_at"), F.col("doc_id").alias("outcome_id"))
    return Q.outcome_summary(table(spark, sf, "documents").select(F.col("doc_id").alias("forecast_id")), outcomes)


@query("a21_freshness", "SELECT 'events' AS source, round((epoch_us(TIMESTAMP '2024-02-01') - max(epoch_us(ts))) / 1e6, 3) AS lag_seconds, (epoch_us(TIMESTAMP '2024-02-01') - max(epoch_us(ts))) / 1e6 > 3600 AS lagging FROM events UNION ALL SELECT 'orders', round((epoch_us(TIMESTAMP '2024-02-01') - max(epoch_us(o_orderdate))) / 1e6, 3), (epoch_us(TIMESTAMP '2024-02-01') - max(epoch_us(o_orderdate))) / 1e6 > 1e12 FROM orders")
def a21(spark, sf):
    t = {"events": journal(spark, sf).select(F.col("read_time").alias("at")), "orders": table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))}
    return Q.freshness(t, stamp("2024-02-01"), {"events": 3600, "orders": 1e12}).select("source", F.round("lag_seconds", 3).alias("lag_seconds"), "lagging")


@query("a24_weighted_mean", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) AS mean FROM lineitem GROUP BY 1")
def a24(spark, sf):
    return N.weighted_mean(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").withColumn("mean", F.round("mean", 3))


@query("a25_group_scoring", "SELECT l_shipdate::DATE::VARCHAR AS day, sum(l_linenumber * 2 * (l_quantity > 25)::INT)::BIGINT AS score, sum(l_linenumber * 2)::BIGINT AS ceiling, ceil(sum(l_linenumber * 2 * (l_quantity > 25)::INT) / sum(l_linenumber * 2) * 100 - 1e-9) / 100 AS coverage FROM lineitem GROUP BY 1")
def a25(spark, sf):
    marks = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_linenumber").alias("priority"), F.lit(2).alias("significance"), (F.col("l_quantity") > 25).cast("int").alias("mark"), F.lit(1).alias("max_mark"), F.lit(False).alias("mandatory"), F.col("l_returnflag").alias("criterion"))
    return N.group_scoring(marks, ["day"]).select("day", F.col("score").cast("long").alias("score"), F.col("ceiling").cast("long").alias("ceiling"), "coverage")


@query("a26_groups_in_order", "SELECT system_kind, min(channel_id) AS first_key, list_sort(list(channel_id)) AS keys FROM c GROUP BY 1")
def a26(spark, sf):
    return Q.grouped_in_order(channels(spark, sf), "system_kind", "channel_id")


PERMITS = """pm AS (SELECT o_orderkey AS permit_id, o_custkey % 20 AS location_id, (o_custkey + 1) % 20 AS adjacent, CASE o_orderstatus WHEN 'F' THEN 'welding' WHEN 'O' THEN 'gas' ELSE 'electric' END AS work_type,
TIMESTAMP '2024-01-01' + to_seconds(o_orderkey % 2592000) AS a, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey % 2592000) + INTERVAL 8 HOUR AS b, (o_orderkey % 4)::INT AS crew FROM orders)"""


def permits(spark, sf):
    o = table(spark, sf, "orders")
    start = F.timestamp_micros((F.unix_micros(stamp("2024-01-01")) + (F.col("o_orderkey") % 2592000) * 1_000_000))
    kind = F.when(F.col("o_orderstatus") == "F", "welding").when(F.col("o_orderstatus") == "O", "gas").otherwise("electric")
    p = o.select(F.col("o_orderkey").alias("permit_id"), (F.col("o_custkey") % 20).alias("location_id"), ((F.col("o_custkey") + 1) % 20).alias("adjacent_location_id"), kind.alias("work_type"), start.alias("actual_from"), (F.col("o_orderkey") % 4).cast("int").alias("crew"))
    return p.withColumn("actual_to", F.timestamp_add("HOUR", F.lit(8), "actual_from"))


@query("a27_hotwork_load", f""", {PERMITS} SELECT location_id, count(*) AS permits, round(sum(greatest(0, (epoch_us(least(b, TIMESTAMP '2024-01-02')) - epoch_us(greatest(a, TIMESTAMP '2024-01-01 01:00:00'))) / 1e6) / 3600 * greatest(crew, 1)), 3) AS man_hours, count(*) FILTER (work_type = 'welding') AS welding FROM pm WHERE a < TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-01 01:00:00' < b GROUP BY 1""")
def a27(spark, sf):
    return PM.hotwork_load(permits(spark, sf), stamp("2024-01-01 01:00:00"), stamp("2024-01-02")).select("location_id", "permits", F.round("man_hours", 3).alias("man_hours"), "welding")


@query("r40_permit_features", f""", {PERMITS}, ev AS (SELECT event_id, user_id % 20 AS location_id, ts AS t FROM events WHERE ts < TIMESTAMP '2024-01-02'),
m AS (SELECT ev.event_id, pm.*, ev.location_id = pm.location_id AS own, greatest(0, (epoch_us(t) - epoch_us(b)) / 6e7) AS since FROM ev JOIN pm ON (pm.location_id = ev.location_id OR pm.adjacent = ev.location_id) AND a <= t AND (epoch_us(t) - epoch_us(b)) / 6e7 <= 1440)
SELECT ev.event_id, coalesce(bool_or(own AND work_type = 'welding' AND since = 0), false) AS hot_now, coalesce(bool_or(own AND work_type = 'welding' AND since <= 240), false) AS hot_4h, coalesce(bool_or(NOT own AND work_type = 'welding' AND since = 0), false) AS hot_adjacent,
count(*) FILTER (own AND since = 0) AS permits_now, coalesce(sum(crew) FILTER (own AND since = 0), 0)::BIGINT AS crew_now FROM ev LEFT JOIN m USING (event_id) GROUP BY 1""")
def r40(spark, sf):
    e = table(spark, sf, "events").where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).select("event_id", (F.col("user_id") % 20).alias("location_id"), F.col("ts").cast("timestamp").alias("t"))
    return PM.permit_features(e, permits(spark, sf)).select("event_id", "hot_now", "hot_4h", "hot_adjacent", "permits_now", F.col("crew_now").cast("long").alias("crew_now"))


@query("r41_actual_windows", "SELECT l_orderkey AS permit_id, epoch_us(coalesce(min(l_shipdate) FILTER (l_returnflag = 'A'), any_value(o_orderdate))) AS began, epoch_us(coalesce(max(l_shipdate) FILTER (l_returnflag = 'R'), any_value(o_orderdate) + INTERVAL 8 HOUR)) AS ended FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def r41(spark, sf):
    log = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("permit_id"), F.when(F.col("l_returnflag") == "A", "in work").when(F.col("l_returnflag") == "R", "done").alias("to_status"), F.col("l_shipdate").cast("timestamp").alias("changed_at"))
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("permit_id"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.timestamp_add("HOUR", F.lit(8), F.col("o_orderdate").cast("timestamp")).alias("valid_to"))
    p = p.join(log.select("permit_id").distinct(), "permit_id", "left_semi")
    return PM.actual_windows(p, log).select("permit_id", us("actual_from").alias("began"), us("actual_to").alias("ended"))


def lives(spark, sf):
    f = rule_episodes(spark, sf).join(channels(spark, sf).select("channel_id", F.col("collector").alias("grp")), "channel_id")
    return B.lifetimes(f.select("grp", "channel_id", "started_at"), "channel_id", "started_at", stamp(END)).join(channels(spark, sf).select("channel_id", F.col("collector").alias("grp")), "channel_id").select("grp", "ttf", "failed")


LIVES = "lv AS (SELECT collector AS grp, (epoch_us(coalesce(nx, TIMESTAMP '2024-01-31')) - epoch_us(started_at)) / 8.64e10 AS ttf, (nx IS NOT NULL)::INT AS failed FROM (SELECT channel_id, started_at, lead(started_at) OVER (PARTITION BY channel_id ORDER BY started_at) AS nx FROM ep) JOIN c USING (channel_id))"


@query("b1_kaplan_meier", f""", {LIVES}, a AS (SELECT grp, ttf AS t, sum(failed) AS d, count(*) AS n FROM lv WHERE ttf > 0 GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY t DESC) AS at_risk FROM a)
SELECT grp, round(t, 4) AS t, at_risk::BIGINT AS at_risk, d::BIGINT AS events, round(product(1 - d / at_risk) OVER (PARTITION BY grp ORDER BY t), 6) AS survival FROM r WHERE d > 0""")
def b1(spark, sf):
    return B.kaplan_meier(lives(spark, sf)).select("grp", F.round("t", 4).alias("t"), "at_risk", "events", F.round("survival", 6).alias("survival"))


@query("b3_weibull")
def b3(spark, sf):
    return B.weibull(lives(spark, sf))


@query("b5_predictability", f", {LIVES} SELECT grp, count(*) AS failures, round((1 - pow(stddev_pop(ttf) / avg(ttf), 2)) / (1 + pow(stddev_pop(ttf) / avg(ttf), 2)), 6) AS k FROM lv WHERE failed = 1 AND ttf > 0 GROUP BY 1")
def b5(spark, sf):
    return B.predictability(lives(spark, sf)).withColumn("k", F.round("k", 6))


@query("b6_life_verdict")
def b6(spark, sf):
    rows = lives(spark, sf)
    return B.life_verdict(B.weibull(rows), B.predictability(rows))


@query("b8_expected_hazard", "SELECT s_suppkey, round(1 - exp(-(CASE WHEN s_suppkey % 3 = 0 THEN 2.0 ELSE 1.0 END) * (pow((s_suppkey + 1) / 300.0, 1.5) - pow(s_suppkey / 300.0, 1.5))), 6) AS hazard FROM supplier")
def b8(spark, sf):
    d = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("age_days"), (F.col("s_suppkey") % 3 == 0).alias("overdue"))
    return B.expected_hazard(d, 1.5, 300.0).select("s_suppkey", F.round("hazard", 6).alias("hazard"))


@query("r33_outlier_labels", """
, s AS (SELECT channel_id, journal_id, read_time, CASE WHEN value_text = 'signup' THEN NULL ELSE round(value_num) END AS x FROM j),
b AS (SELECT *, last_value(CASE WHEN x BETWEEN 5 AND 90 THEN x END IGNORE NULLS) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base, CASE WHEN x IS DISTINCT FROM lag(x) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id) OR row_number() OVER (PARTITION BY channel_id ORDER BY read_time, journal_id) = 1 AND x IS NOT NULL THEN 1 ELSE 0 END AS fresh FROM s),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id ROWS UNBOUNDED PRECEDING) AS run FROM b), l AS (SELECT *, count(*) OVER (PARTITION BY channel_id, run) AS len FROM r)
SELECT journal_id, CASE WHEN x IS NULL THEN 4 WHEN x NOT BETWEEN 5 AND 90 THEN 1 WHEN len >= 2 THEN 3 WHEN abs(x - base) > 40 THEN 2 ELSE 0 END AS label FROM l""")
def r33(spark, sf):
    rows = journal(spark, sf).select("journal_id", F.col("channel_id").alias("sensor"), F.struct("read_time", "journal_id").alias("t"), F.when(F.col("value_text") == "signup", "word").otherwise(F.round("value_num").cast("string")).alias("value"))
    return N.outlier_labels(rows, 5, 90, 40, 2).select("journal_id", "label")


@query("r35_band", "SELECT journal_id, CASE WHEN z >= 1.7 THEN 'alarm' WHEN z >= 1.5 THEN 'warn' ELSE 'none' END AS band FROM (SELECT journal_id, CASE WHEN count(value_num) OVER w >= 10 AND stddev_pop(value_num) OVER w > 0 THEN abs(value_num - avg(value_num) OVER w) / stddev_pop(value_num) OVER w END AS z FROM j WINDOW w AS (PARTITION BY channel_id, value_text))")
def r35(spark, sf):
    t = journal(spark, sf).select("journal_id", F.col("channel_id").alias("element"), F.col("value_text").alias("condition"), F.col("value_num").alias("temp"))
    return N.band_finding(t, warn=1.5, alarm=1.7).select("journal_id", "band")


@query("r36_peers", """
, t AS (SELECT channel_id AS e, strftime(read_time, '%Y-%m-%d') AS day, collector, round(avg(value_num), 6) AS temp FROM j JOIN c USING (channel_id) GROUP BY 1, 2, 3)
SELECT a.e AS element, a.day, CASE WHEN count(b.temp) >= 2 AND a.temp - quantile_cont(b.temp, 0.5) >= 10 THEN 'alarm' WHEN count(b.temp) >= 2 AND a.temp - quantile_cont(b.temp, 0.5) >= 5 THEN 'warn' ELSE 'none' END AS peers FROM t a LEFT JOIN t b ON b.day = a.day AND b.collector = a.collector AND b.e <> a.e GROUP BY a.e, a.day, a.temp""")
def r36(spark, sf):
    t = journal(spark, sf).join(channels(spark, sf).select("channel_id", "collector"), "channel_id").groupBy(F.col("channel_id").alias("element"), F.date_format("read_time", "yyyy-MM-dd").alias("day"), "collector").agg(F.round(F.avg("value_num"), 6).alias("temp"))
    return N.peer_finding(t, ["day", "collector"]).select("element", "day", "peers")


@query("r37_trend", """
, t AS (SELECT journal_id, j.channel_id AS e, system_kind AS kind, read_time, value_num AS x, epoch_us(read_time) // 86400000000 AS b FROM j JOIN c USING (channel_id)),
q AS (SELECT *, (x - lag(x) OVER w) / nullif((epoch_us(read_time) - epoch_us(lag(read_time) OVER w)) / 3.6e9, 0) AS rate FROM t WINDOW w AS (PARTITION BY e ORDER BY read_time, journal_id)),
r AS (SELECT *, avg(rate) OVER (PARTITION BY e ORDER BY read_time, journal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past,
      (sum(rate) OVER (PARTITION BY kind, b) - coalesce(sum(rate) OVER (PARTITION BY kind, b, e), 0)) / nullif(count(rate) OVER (PARTITION BY kind, b) - count(rate) OVER (PARTITION BY kind, b, e), 0) AS peer FROM q)
SELECT journal_id, CASE WHEN rate >= 0.2 AND (coalesce(peer > 0 AND rate >= 2 * peer, false) OR coalesce(past > 0 AND rate >= 2 * past, false)) THEN 'warn' ELSE 'none' END AS trend FROM r""")
def r37(spark, sf):
    t = journal(spark, sf).join(channels(spark, sf).select("channel_id", F.col("system_kind").alias("kind")), "channel_id").select("journal_id", F.col("channel_id").alias("element"), "kind", F.col("read_time").alias("t"), F.col("value_num").alias("temp"))
    return N.trend_finding(t, peer_seconds=86_400, tie="journal_id").select("journal_id", "trend")


@query("r30_signal_fusion", """
, s AS (SELECT l_suppkey::VARCHAR AS entity, l_returnflag AS class, 's' || l_linenumber AS source, 1.0::DOUBLE / min(l_linenumber) AS weight,
              (20 * (sum(l_discount::DECIMAL(18, 4)) * 10000)::BIGINT + count(l_discount)) // (2 * count(l_discount)) / 10000::DOUBLE AS p FROM lineitem GROUP BY 1, 2, 3),
own AS (SELECT entity, source, max(weight) AS weight, arg_min(class, (-p, class)) AS best FROM s GROUP BY 1, 2),
m AS (SELECT entity, class, sum(weight * p) AS mass FROM s GROUP BY 1, 2),
t AS (SELECT entity, arg_min(class, (round(-mass, 9), class)) AS class, max(mass) AS confidence FROM m GROUP BY 1),
o AS (SELECT t.entity, t.class, t.confidence, sum(own.weight) AS coverage, count(*) FILTER (own.best = t.class) AS agreement, 7 - count(*) AS n_missing FROM t JOIN own USING (entity) GROUP BY 1, 2, 3)
SELECT entity, class, round(confidence / coverage, 6) AS score, round(confidence, 6) AS confidence, agreement, round(coverage, 6) AS coverage, n_missing,
       CASE WHEN round(confidence, 9) < 1.2 THEN 'human_review' WHEN agreement < 3 THEN 'low_confidence' ELSE 'auto' END AS verdict FROM o""")
def r30(spark, sf):
    """p is ten times the mean discount to four decimals, half up, from exact sums: averages of doubles end by the order of their rows."""
    n = F.col("l_linenumber")
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("entity"), F.col("l_returnflag").alias("class"), F.concat(F.lit("s"), n).alias("source"))
    s = s.agg((F.sum(F.col("l_discount").cast("decimal(18,4)")) * 10_000).cast("long").alias("total"), F.count("l_discount").alias("rows"))
    s = s.select("entity", "class", "source", (F.expr("(20 * total + `rows`) div (2 * `rows`)") / 10_000.0).alias("p"))
    w = table(spark, sf, "lineitem").select("l_linenumber").distinct().select(F.concat(F.lit("s"), n).alias("source"), (1.0 / n).alias("weight"))
    r = lambda c: F.round(c, 6).alias(c)
    return N.fuse_signals(s, w, auto=1.2, least=3).select("entity", "class", r("score"), r("confidence"), "agreement", r("coverage"), F.size("missing").cast("long").alias("n_missing"), "verdict")


@query("r31_monotonicity", "SELECT 0::BIGINT AS violations")
def r31(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("entity"), F.col("l_returnflag").alias("class"), F.concat(F.lit("s"), F.col("l_linenumber")).alias("source")).agg((F.avg("l_discount") * 10).alias("p"))
    w = table(spark, sf, "lineitem").select("l_linenumber").distinct().select(F.concat(F.lit("s"), F.col("l_linenumber")).alias("source"), (1.0 / F.col("l_linenumber")).alias("weight"))
    return N.monotonicity_violations(s, w).agg(F.count("*").alias("violations"))


@query("r32_criticality", "SELECT o_custkey::VARCHAR AS entity, round(sum((o_orderkey % 4 + 1) * o_totalprice) / sum(o_totalprice), 6) AS score, CASE WHEN sum((o_orderkey % 4 + 1) * o_totalprice) / sum(o_totalprice) > 3.25 THEN 'I' WHEN sum((o_orderkey % 4 + 1) * o_totalprice) / sum(o_totalprice) > 2.5 THEN 'II' WHEN sum((o_orderkey % 4 + 1) * o_totalprice) / sum(o_totalprice) > 1.75 THEN 'III' ELSE 'IV' END AS category FROM orders GROUP BY o_custkey")
def r32(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("entity"), (F.col("o_orderkey") % 4 + 1).alias("value"), F.col("o_totalprice").alias("weight"))
    return N.criticality(f).withColumn("score", F.round("score", 6))


@query("r39_payback", """
, f AS (SELECT o_custkey AS project, year(o_orderdate) AS y, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_totalprice) AS flow FROM orders GROUP BY 1, 2), c2 AS (SELECT *, sum(flow) OVER (PARTITION BY project ORDER BY y) AS cum FROM f), l AS (SELECT *, lag(cum) OVER (PARTITION BY project ORDER BY y) AS b, lag(y) OVER (PARTITION BY project ORDER BY y) AS py FROM c2)
SELECT project, round(min(CASE WHEN b < 0 AND cum >= 0 THEN py + (-b) / flow END), 4) AS payback FROM l GROUP BY 1""")
def r39(spark, sf):
    f = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project"), F.year("o_orderdate").alias("year")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))).alias("flow"))
    return N.payback(f).select("project", F.round("payback", 4).alias("payback"))


@query("x1_linear_reference", "SELECT DISTINCT collector, picket, picket * 10 AS from_m, picket * 10 + 10 AS to_m, max(picket) OVER (PARTITION BY collector) * 10 + 10 AS axis_m FROM c")
def x1(spark, sf):
    s = channels(spark, sf).select("collector", "picket").distinct().withColumn("prefix", F.lit("p"))
    return geo.linear_reference(s).select("collector", "picket", "from_m", "to_m", "axis_m")


def spots(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("object_id"), (37.0 + (F.col("s_suppkey") * 37 % 1000) / 5000).alias("lon"), (55.0 + (F.col("s_suppkey") * 91 % 1000) / 9000).alias("lat"), (F.col("s_suppkey") % 5 != 0).alias("in_service"), F.concat(F.lit("k"), F.col("s_suppkey") % 3).alias("kind"), F.when(F.col("s_suppkey") % 4 == 0, "high").otherwise("normal").alias("level"), (F.col("s_suppkey") * 1.5).alias("length_m"))


@query("x2_snap")
def x2(spark, sf):
    """Every customer against all places in service; SQL would be the product of both tables, so the tests have the brute force."""
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("point_id"), (37.0 + (F.col("c_custkey") * 53 % 1000) / 5000).alias("lon"), (55.0 + (F.col("c_custkey") * 17 % 1000) / 9000).alias("lat"))
    return geo.snap(p, spots(spark, sf), 500).select("point_id", F.round("metres", 2).alias("metres"))


@query("x3_area_summary", "SELECT 'k' || (s_suppkey % 3) AS kind, count(*) AS objects, sum(s_suppkey * 1.5)::DOUBLE AS length_m, count(*) FILTER (s_suppkey % 4 = 0) AS high FROM supplier WHERE (s_suppkey * 37 % 1000) / 5000 BETWEEN 0.0501 AND 0.1501 AND (s_suppkey * 91 % 1000) / 9000 BETWEEN 0.02003 AND 0.08003 GROUP BY 1")
def x3(spark, sf):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((37.0501, 55.02003), (37.1501, 55.02003), (37.1501, 55.08003), (37.0501, 55.08003))])
    return geo.area_summary(spots(spark, sf), ring)


@query("x5_wkt", "SELECT s_suppkey AS object_id, 'POINT(' || printf('%.9f', 37.0 + (s_suppkey * 37 % 1000) / 5000) || ' ' || printf('%.9f', 55.0 + (s_suppkey * 91 % 1000) / 9000) || ')' AS wkt FROM supplier")
def x5(spark, sf):
    return spots(spark, sf).select("object_id", geo.wkt(F.array(F.struct("lon", "lat"))).alias("wkt"))


@query("x4_layer_colours", "SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'grey' WHEN s_suppkey % 4 = 0 THEN 'red' ELSE 'green' END AS colour, count(*) AS n FROM supplier GROUP BY 1")
def x4(spark, sf):
    return spots(spark, sf).groupBy(geo.layer_colour(F.col("in_service"), F.col("level")).alias("colour")).agg(F.count("*").alias("n"))


@query("s4_idempotent_load", "SELECT count(*) AS planned, count(*) FILTER (event_id % 3 <> 0) AS loaded, count(*) FILTER (event_id % 3 = 0) AS skipped FROM events")
def s4(spark, sf):
    rows = journal(spark, sf).drop("section_id")
    return S.load_new(rows, rows.where("journal_id % 3 = 0"), channels(spark, sf))[2]


@query("s4_stub_channels", "SELECT DISTINCT user_id AS channel_id, true AS is_stub, false AS is_active FROM events WHERE user_id % 4 = 1")
def s4b(spark, sf):
    return S.load_new(journal(spark, sf).drop("section_id"), journal(spark, sf).limit(0), channels(spark, sf).where("channel_id % 4 <> 1"))[1]


@query("s5_control_totals", "SELECT 'events' AS \"check\", 1000::BIGINT AS expected, count(*) AS actual, count(*) = 1000 AS ok FROM events UNION ALL SELECT 'orphans', 0, 0, true")
def s5(spark, sf):
    e = table(spark, sf, "events")
    return S.control_totals({"events": e, "orphans": e.where("user_id is null")}, {"events": 1000, "orphans": 0})


@query("s2_validation", "SELECT CASE WHEN event_id % 5 = 0 THEN 'id is no number' WHEN event_id % 7 = 0 THEN 'time not parsed' ELSE 'good' END AS reject, count(*) AS rows FROM events GROUP BY 1")
def s2(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(F.when(F.col("event_id") % 5 == 0, "x1").otherwise(F.col("event_id").cast("string")).alias("journal_id"), F.col("user_id").cast("string").alias("channel_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_id") % 7 == 0, "25h").otherwise(F.date_format("ts", "HH:mm:ss")).alias("time"), F.lit("t").alias("is_alarm"), F.col("value").cast("string").alias("value"))
    return S.validate(raw).groupBy(F.coalesce("reject", F.lit("good")).alias("reject")).agg(F.count("*").alias("rows"))


@query("s7_json_rows", "SELECT count(*) AS n, sum((n_regionkey::VARCHAR = '1')::INT)::BIGINT AS ones FROM nation")
def s7(spark, sf):
    j = S.as_json(table(spark, sf, "nation"))
    return j.agg(F.count("*").alias("n"), F.sum((F.get_json_object("json", "$.n_regionkey") == "1").cast("int")).alias("ones"))


@query("s8_weather_upsert", "SELECT o_custkey AS source, epoch_us(o_orderdate) AS at, max(o_orderkey) AS fetched FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' GROUP BY 1, 2")
def s8(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderdate").cast("timestamp").alias("observed_at"), F.lit(False).alias("is_forecast"), F.col("o_orderkey").alias("fetched_at"))
    out = S.latest_weather(o.where((F.col("fetched_at") % 2 == 0) & (F.col("observed_at") <= stamp("1996-01-01"))), o.where("fetched_at % 2 = 1"), stamp("1996-01-01"))
    return out.select("source", us("observed_at").alias("at"), F.col("fetched_at").alias("fetched"))


@query("s9_missing_hours", "SELECT epoch_us(h) AS hour FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10 23:00:00', INTERVAL 1 HOUR)) AS h) WHERE h NOT IN (SELECT date_trunc('hour', ts) FROM events)")
def s9(spark, sf):
    return S.missing_hours(journal(spark, sf), stamp("2024-01-01"), 10, "read_time").select(us("hour").alias("hour"))


@query("s10_section_directory", "SELECT section_id, min(collector) AS collector, coalesce(list_sort(list(DISTINCT sensor_kind) FILTER (sensor_kind IS NOT NULL)), []) AS kinds FROM c GROUP BY 1")
def s10(spark, sf):
    return S.section_directory(channels(spark, sf)).select("section_id", "collector", "kinds")


@query("d8_causality", "SELECT 0::BIGINT AS differing, (SELECT count(DISTINCT user_id) FROM events WHERE ts < TIMESTAMP '2024-01-16')::BIGINT AS compared")
def d8(spark, sf):
    """Features of a day are the same with and without the rows after it, for every channel seen by then."""
    rows = journal(spark, sf)
    features = lambda r: A.window_counts(A.channel_day(r, {"bad": F.col("value_text") == "error"}), "channel_id", F.lit("2024-01-15").cast("date"), "n_bad", (1, 7))
    known = features(rows.where(F.col("read_time") < stamp("2024-01-16")))
    every = features(rows).join(known.select("channel_id"), "channel_id", "left_semi")
    differing = D.differs(every, known).agg(F.count("*").alias("differing"))
    return differing.join(F.broadcast(known.agg(F.count("*").alias("compared"))))  # a row each


@query("t9_bad_transitions", """
, s AS (SELECT journal_id, lag(value_text) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id) AS f, value_text AS t FROM j) SELECT journal_id FROM s WHERE NOT (f IS NULL OR (f = 'view' AND t = 'click') OR (f = 'click' AND t = 'purchase') OR f = t)""")
def t9(spark, sf):
    words = ["view", "click", "purchase", "signup", "error"]
    allowed = [(None, w) for w in words] + [(w, w) for w in words] + [("view", "click"), ("click", "purchase")]
    log = journal(spark, sf).withColumn("status", F.col("value_text")).withColumn("at", F.struct("read_time", "journal_id"))
    return D.bad_transitions(log, spark.createDataFrame(allowed, "from_status string, to_status string"), "channel_id", "at").select("journal_id")


def shared_folder(spark) -> str:
    """The cluster's checkpoint folder; a folder of this machine only where all tasks run on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-shared-")
    return base.rstrip("/")


@contextmanager
def rocksdb(spark):
    """State that transformWithState asks for, for the streams started inside; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, had) if had else spark.conf.unset(name)


def drain(stream, schema_mode: str = "append"):
    """Run a stream over what there is and return what it wrote, from the shared checkpoint folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    with rocksdb(spark):
        if schema_mode == "append":
            writer.outputMode("append").format("parquet").option("path", f"{path}/out").start().awaitTermination()
        else:
            writer.outputMode(schema_mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def reading_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return e.select(F.col("event_id").alias("journal_id"), F.col("ts").cast("timestamp").alias("read_time"), F.col("user_id").alias("channel_id"), (F.col("user_id") % 20).alias("section_id"), (F.col("event_type") == "signup").alias("is_alarm"), F.col("event_type").alias("value_text"), F.col("value").alias("value_num"))


@query("t1_accepted_readings", "SELECT known, count(*) AS n FROM (SELECT user_id % 4 <> 1 AS known FROM events) GROUP BY 1")
def t1(spark, sf):
    out = drain(T.accept_readings(reading_stream(spark, sf), channels(spark, sf).where("channel_id % 4 <> 1"), "60 days").select("journal_id", "known"))
    return out.groupBy("known").agg(F.count("*").alias("n"))


@query("t3_daily_rollup", "SELECT section_id, strftime(read_time, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (is_alarm) AS alarms, max(value_num) AS max_value FROM j GROUP BY 1, 2")
def t3(spark, sf):
    return drain(T.daily_rollup(reading_stream(spark, sf)), "complete").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("t5_live_episodes", "SELECT channel_id, epoch_us(started_at) AS started, epoch_us(ended_at) AS ended, rows_cnt, closed_by FROM ep0 WHERE ended_at IS NOT NULL")
def t5(spark, sf):
    out = drain(T.live_episodes(reading_stream(spark, sf), ("error",)))
    return out.select("channel_id", F.col("started_us").alias("started"), F.col("ended_us").alias("ended"), "rows_cnt", "closed_by")


@query("t5_incident_sessions", """
, s AS (SELECT section_id, read_time, CASE WHEN epoch_us(read_time) - epoch_us(lag(read_time) OVER (PARTITION BY section_id ORDER BY read_time)) <= 3600000000 THEN 0 ELSE 1 END AS f FROM j WHERE value_text = 'error'), r AS (SELECT *, sum(f) OVER (PARTITION BY section_id ORDER BY read_time ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT section_id, epoch_us(min(read_time)) AS first_us, count(*) AS events FROM r GROUP BY section_id, run""")
def t5b(spark, sf):
    s = T.incident_sessions(reading_stream(spark, sf).where("value_text = 'error'"), "section_id", "read_time", 60)
    return drain(s, "complete").select("section_id", us("first_at").alias("first_us"), "events")


@query("t6_live_policy")
def t6(spark, sf):
    s = reading_stream(spark, sf).select(F.col("channel_id").cast("string").alias("key"), us("read_time").alias("t_us"), (F.col("value_num") / 100).alias("probability"))
    return drain(T.live_policy(s, R.POLICY | {"threshold": 0.5, "heartbeat_min": 1440.0}))


@query("t7_status_changes", """
, s AS (SELECT channel_id, value_text, lag(value_text) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id) AS p, epoch_us(read_time) // 86400000000 AS d, lag(epoch_us(read_time) // 86400000000) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id) AS pd FROM j) SELECT channel_id AS order_id, count(*) AS changes FROM s WHERE p IS DISTINCT FROM value_text OR pd IS DISTINCT FROM d GROUP BY 1""")
def t7(spark, sf):
    """Batch form on the same rule: a change of status or day."""
    w = Window.partitionBy("channel_id").orderBy("read_time", "journal_id")
    rows = journal(spark, sf).withColumn("d", F.floor(us("read_time") / 86_400_000_000))
    changed = ~F.col("value_text").eqNullSafe(F.lag("value_text").over(w)) | ~F.col("d").eqNullSafe(F.lag("d").over(w))
    return rows.withColumn("c", changed).where("c").groupBy(F.col("channel_id").alias("order_id")).agg(F.count("*").alias("changes"))


@query("f3_gamma", "SELECT s_suppkey, round(gamma(1.0 + (s_suppkey % 50) / 10.0), 6) AS g FROM supplier")
def f3(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(scalar.gamma(1.0 + (F.col("s_suppkey") % 50) / 10.0), 6).alias("g"))
