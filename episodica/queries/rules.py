"""Queries over weights, settings, live orders, registries, curves, scores and status streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import metrics as M
from ..operators import quality as D
from ..operators import reliability as B
from ..operators import risk as R
from ..operators import rollup as A
from ..sources import journal as S
from ..streaming import live as T
from .base import channels, journal, query, stamp, table, us
from .decisions import section_weights
from .domain import LIVES, drain, lives, reading_stream
from .journal import rule_episodes

SECTIONS = ", s AS (SELECT DISTINCT section_id, section_id % 5 AS object_id FROM c), n AS (SELECT section_id, count(*) FILTER (started_at >= TIMESTAMP '2024-01-05' AND started_at < TIMESTAMP '2024-01-21') AS n, count(*) AS al FROM ep GROUP BY 1), e AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(al, 0) AS al FROM s LEFT JOIN n USING (section_id))"


def weights_by_setting(spark, sf):
    settings = table(spark, sf, "region").select(F.when(F.col("r_regionkey") == 2, "forecast_weight_alpha").otherwise(F.col("r_name")).alias("key"), (F.col("r_regionkey") + 0.5).alias("value"))
    sections = channels(spark, sf).select("section_id").distinct().withColumn("object_id", F.col("section_id") % 5)
    return R.section_weight(sections, rule_episodes(spark, sf), settings, F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))


@query("j16_scalar_setting", f"""{SECTIONS} SELECT section_id, object_id, n AS episodes_cnt, al - n AS excluded_cnt, count(*) OVER o AS sections_cnt, round((n + 2.5) / (sum(n) OVER o + 2.5 * count(*) OVER o), 6) AS weight FROM e WINDOW o AS (PARTITION BY object_id)""")
def j16(spark, sf):
    """The smoothing comes from a one-row setting joined to every section."""
    return weights_by_setting(spark, sf).withColumn("weight", F.round("weight", 6))


@query("a18_sensitivity_range", f"""{SECTIONS}, w AS (SELECT a, (n + a) / (sum(n) OVER o + a * count(*) OVER o) AS x FROM e, (VALUES (0.5), (1.0), (5.0)) v(a) WINDOW o AS (PARTITION BY a, object_id)) SELECT a::DOUBLE AS alpha, round(max(x), 6) AS max_share, round(min(x), 6) AS min_share FROM w GROUP BY 1""")
def a18_range(spark, sf):
    out = R.alpha_sensitivity(weights_by_setting(spark, sf), (0.5, 1.0, 5.0))
    return out.select("alpha", F.round("max_share", 6).alias("max_share"), F.round("min_share", 6).alias("min_share"))


@query("j19_live_orders", "SELECT DISTINCT o_custkey AS section_id FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate + INTERVAL 100 DAY > TIMESTAMP '1996-06-01'")
def j19(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "IN_PROCESS").otherwise("CLOSED")
    due = F.timestamp_micros(us("o_orderdate") + 100 * 86_400_000_000)
    return R.live_orders(table(spark, sf, "orders").select(F.col("o_custkey").alias("section_id"), status.alias("status"), due.alias("due_at")), stamp("1996-06-01"))


@query("d9_registry_pairs", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey % 5 = 4)::BIGINT AS places, (SELECT count(*) FROM supplier)::BIGINT AS listed, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 0)::BIGINT AS without_place, (SELECT count(*) FROM customer WHERE c_nationkey % 5 = 4) = (SELECT count(*) FROM supplier) AND (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 0) = 0 AS ok")
def d9(spark, sf):
    places = table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("hierarchy_level"))
    return D.registry_pairs(places, table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 10 != 0, F.col("s_suppkey")).alias("func_location_id")))


@query("m10_recall_ceiling", """
, f AS (SELECT channel_id, epoch_us(started_at) AS t FROM ep), m AS (SELECT channel_id, epoch_us(read_time) AS t FROM j WHERE value_text = 'click'),
x AS (SELECT f.channel_id, f.t, count(m.t) > 0 AS ok FROM f LEFT JOIN m ON m.channel_id = f.channel_id AND m.t < f.t AND m.t >= f.t - 48 * 3600000000 GROUP BY 1, 2)
SELECT count(*) AS failures, count(*) FILTER (ok) AS reachable, count(*) FILTER (ok) / count(*) AS ceiling FROM x""")
def m10(spark, sf):
    moments = journal(spark, sf).where("value_text = 'click'").select("channel_id", F.col("read_time").alias("t"))
    return M.recall_ceiling(moments, rule_episodes(spark, sf).select("channel_id", F.col("started_at").alias("t")), 48)


@query("b2_survival_at", f""", {LIVES}, a AS (SELECT grp, ttf AS t, sum(failed) AS d, count(*) AS n FROM lv WHERE ttf > 0 GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY t DESC) AS at_risk FROM a),
k AS (SELECT grp, t, product(1 - d / at_risk) OVER (PARTITION BY grp ORDER BY t) AS s FROM r WHERE d > 0)
SELECT g.grp, m.t::DOUBLE AS t, round(coalesce(min(k.s), 1.0), 6) AS survival FROM (SELECT DISTINCT grp FROM lv) g CROSS JOIN (VALUES (0.5), (2.0), (7.0), (20.0)) m(t) LEFT JOIN k ON k.grp = g.grp AND k.t <= m.t GROUP BY 1, 2""")
def b2(spark, sf):
    rows = lives(spark, sf)
    moments = rows.select("grp").distinct().withColumn("t", F.explode(F.array(*map(F.lit, (0.5, 2.0, 7.0, 20.0)))))
    return B.survival_at(B.kaplan_meier(rows), moments).withColumn("survival", F.round("survival", 6))


@query("d15_order_counts", "SELECT c_custkey AS warning_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) = 0 OR count(o_orderkey) > 12")
def d15(spark, sf):
    key = lambda c: F.concat(F.lit("warn:"), F.col(c))
    orders = table(spark, sf, "orders").select(F.concat_ws(":", key("o_custkey"), "o_orderkey").alias("source_key"))
    out = D.order_counts(table(spark, sf, "customer").select(key("c_custkey").alias("warning_key")), orders, 12)
    return out.select(F.regexp_extract("warning_key", "[0-9]+$", 0).cast("long").alias("warning_key"))


@query("g2_grid_to_the_data_end", """
, d AS (SELECT channel_id, min(read_time)::DATE AS a FROM j GROUP BY 1), g AS (SELECT channel_id, unnest(generate_series(a, DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day FROM d), n AS (SELECT channel_id, read_time::DATE AS day, count(*) AS n FROM j GROUP BY 1, 2)
SELECT channel_id, count(*) AS days, coalesce(sum(n), 0)::BIGINT AS n_total FROM g LEFT JOIN n USING (channel_id, day) GROUP BY 1""")
def g2(spark, sf):
    days = journal(spark, sf).groupBy("channel_id", F.to_date("read_time").alias("day")).agg(F.count("*").alias("n_total"))
    grid = A.dense_grid(days, "channel_id", ["n_total"], last=F.lit("2024-01-31").cast("date"))
    return grid.groupBy("channel_id").agg(F.count("*").alias("days"), F.sum("n_total").alias("n_total"))


@query("j21_registry_faults", "SELECT DISTINCT 'section without collector' AS problem, n_regionkey::VARCHAR AS id FROM nation WHERE n_regionkey = 4 AND n_nationkey % 9 <> 5 UNION ALL SELECT DISTINCT 'channel without section', c_nationkey::VARCHAR FROM customer WHERE c_nationkey % 9 = 5")
def j21(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("channel_id"), F.col("c_nationkey").alias("section_id"))
    n = table(spark, sf, "nation").where("n_nationkey % 9 <> 5").select(F.col("n_nationkey").alias("section_id"), F.col("n_regionkey").alias("collector_id"))
    r = table(spark, sf, "region").where("r_regionkey <> 4").select(F.col("r_regionkey").alias("collector_id"))
    return J.registry(c, n, r)[1].where("problem like '%without%'").select("problem", "id")


@query("t7_status_changes_live", """
, s AS (SELECT channel_id, value_text, epoch_us(read_time) AS t, lag(value_text) OVER w AS p, lag(epoch_us(read_time)) OVER w AS q FROM j WINDOW w AS (PARTITION BY channel_id ORDER BY read_time, value_text))
SELECT channel_id AS order_id, value_text AS status, t AS at_us FROM s WHERE value_text IS DISTINCT FROM p OR t IS DISTINCT FROM q""")
def t7_live(spark, sf):
    """Structured Streaming with a state row per order: a status is put out only where it or its time is new."""
    return drain(T.status_changes(reading_stream(spark, sf).select(F.col("channel_id").alias("order_id"), F.col("value_text").alias("status"), us("read_time").alias("at_us"))))


@query("f6_unpack_hours", "SELECT o_orderkey AS row, epoch_us(o_orderdate::DATE::TIMESTAMP) + h * 3600000000 AS at_us, o_orderkey::DOUBLE + v AS temperature FROM orders, (VALUES (0, 0.5), (1, NULL)) x(h, v)")
def f6(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    body = F.format_string('{"time": ["%sT00:00", "%sT01:00"], "temperature": [%s, null]}', day, day, (F.col("o_orderkey") + 0.5).cast("string"))
    out = S.unpack_hours(table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), body.alias("body")), "body", ["temperature"])
    return out.select("row", us("observed_at").alias("at_us"), "temperature")
