"""Second ways to rows of other queries, for hot channels, partitioned journals and bounded ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import anomaly as N
from ..operators import areas
from ..operators import episodes as E
from ..operators import listing as Q
from ..operators import metrics as M
from ..operators import quality as D
from ..operators import reliability as B
from ..operators import risk as R
from ..operators import rollup as A
from ..operators import summaries as S
from ..plans import table_functions
from .base import END, channels, journal, query, query_like, stamp, table, us
from .decisions import SCORES, scores
from .domain import shared_folder, spots
from .journal import rule_episodes, shown


def rule_episodes_by_pieces(spark, sf):
    rows = [(f"kind{i}", "error", 3600) for i in range(3)]
    rules = spark.createDataFrame(rows, "sensor_kind string, fault_value string, min_seconds int")
    marked = E.mark_bad(journal(spark, sf), channels(spark, sf), E.fault_rules(rules, rules))
    return E.long_episodes(S.episodes_by_pieces(marked, {"rule": F.col("bad")}), stamp(END), F.lit(3600))


@query_like("e1_by_pieces", "e1_rule_episodes")
def e1_by_pieces(spark, sf):
    return shown(rule_episodes_by_pieces(spark, sf))


@query_like("e3_by_pieces", "e3_multi_predicate")
def e3_by_pieces(spark, sf):
    """Pieces of six hours: many runs cross several of them."""
    predicates = {"error": F.col("value_text") == "error", "alarm": F.col("is_alarm")}
    ep = S.episodes_by_pieces(journal(spark, sf), predicates, piece=S.piece_of("read_time", 6), ts_to=stamp("2024-01-20"))
    return ep.select("predicate", "channel_id", us("started_at").alias("started"), us("ended_at").alias("ended"), F.col("rows_cnt").cast("long").alias("rows_cnt"))


@query_like("e7_by_pieces", "e7_incidents")
def e7_by_pieces(spark, sf):
    ep = rule_episodes_by_pieces(spark, sf).select("channel_id", "started_at").join(channels(spark, sf).select("channel_id", "collector"), "channel_id")
    out = S.merge_incidents_by_pieces(ep, "collector", "started_at", 60)
    return out.select("collector", us("first_at").alias("first_us"), us("last_at").alias("last_us"), "events")


@query("e7_fleet_incidents", """
, i0 AS (SELECT 1 AS grp, read_time, CASE WHEN epoch_us(read_time) - epoch_us(lag(read_time) OVER (ORDER BY read_time)) <= 600000000 THEN 0 ELSE 1 END AS fresh FROM j WHERE value_text = 'error'),
i1 AS (SELECT *, sum(fresh) OVER (ORDER BY read_time ROWS UNBOUNDED PRECEDING) AS run FROM i0)
SELECT epoch_us(min(read_time)) AS first_us, epoch_us(max(read_time)) AS last_us, count(*) AS events FROM i1 GROUP BY run""")
def e7_fleet(spark, sf):
    """Incidents of the whole fleet as one group, which no task holds whole."""
    rows = journal(spark, sf).where("value_text = 'error'").select(F.lit(1).alias("grp"), "read_time")
    out = S.merge_incidents_by_pieces(rows, "grp", "read_time", 10, S.piece_of("read_time", 6))
    return out.select(us("first_at").alias("first_us"), us("last_at").alias("last_us"), "events")


def partitioned_journal(spark, sf):
    """The journal written by day, as a cluster would keep it."""
    path = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    journal(spark, sf).withColumn("day", F.to_date("read_time")).repartition("day").write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


@query_like("a10_partitioned_counts", "a10_exact_counts")
def a10_partitioned(spark, sf):
    """Whole days from the rollup, cut days from their partitions alone."""
    rows = partitioned_journal(spark, sf)
    days = A.channel_daily(rows, F.lit(False), F.lit(False))
    out = A.exact_counts(days, rows, "channel_id", stamp("2024-01-25 09:30:00"), (7, 20), partition="day")
    # the query's SQL lists every channel, with zeros where it has no row in the spans
    known = rows.select("channel_id").distinct()
    return known.join(out, "channel_id", "left").select("channel_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("last_7", "last_20")])


@query("q2_bounded_events", """
, r AS (SELECT * FROM j WHERE read_time >= TIMESTAMP '2024-01-10' AND read_time < TIMESTAMP '2024-01-20'),
al AS (SELECT * FROM r WHERE value_text = 'error' AND section_id = 7),
nn AS (SELECT a.journal_id AS alarm_id, a.section_id, b.channel_id, b.journal_id, b.read_time, b.value_text, row_number() OVER (PARTITION BY a.journal_id ORDER BY b.read_time, b.journal_id) AS place
       FROM al a JOIN r b ON b.channel_id = a.channel_id AND b.value_text <> 'error' AND b.read_time > a.read_time)
SELECT epoch_us(read_time) AS at, 'alarm' AS kind, journal_id AS source_id, channel_id, section_id, value_text AS text FROM al
UNION ALL SELECT DISTINCT epoch_us(read_time), 'normal', journal_id, channel_id, section_id, value_text FROM nn WHERE place = 1
UNION ALL SELECT epoch_us(o_orderdate), 'external', o_orderkey, NULL, 7, o_orderpriority FROM orders WHERE o_orderkey % 20 = 7 AND o_orderdate >= TIMESTAMP '2024-01-10' AND o_orderdate < TIMESTAMP '2024-01-20'""")
def q2_bounded(spark, sf):
    """A section's events of ten days, from a journal kept by day."""
    o = table(spark, sf, "orders")
    external = o.select(F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 20).alias("section_id"))
    out = Q.technical_events(
        partitioned_journal(spark, sf), external, alarm=F.col("value_text") == "error", normal=F.col("value_text") != "error",
        section_id=7, first="2024-01-10 00:00:00", last="2024-01-20 00:00:00", partition="day",
    )
    return out.select(us("at").alias("at"), "kind", "source_id", "channel_id", "section_id", "text")


def hexagons(spark, sf):
    """A six-sided area around every tenth supplier's place."""
    s = spots(spark, sf).where("object_id % 10 = 0")
    corners = [(1.0, 0.0), (0.5, 0.9), (-0.5, 0.8), (-1.1, 0.1), (-0.4, -0.7), (0.6, -0.8)]
    size = 0.002 + (F.col("object_id") % 7) * 0.004
    ring = F.array(*[F.struct((F.col("lon") + x * size).alias("lon"), (F.col("lat") + y * size).alias("lat")) for x, y in corners])
    return s.select(F.col("object_id").alias("area_id"), ring.alias("ring"))


HEX = """
o AS (SELECT s_suppkey AS object_id, 37.0 + (s_suppkey * 37 % 1000) / 5000 AS lon, 55.0 + (s_suppkey * 91 % 1000) / 9000 AS lat, 'k' || (s_suppkey % 3) AS kind, s_suppkey % 4 = 0 AS high, s_suppkey * 1.5 AS length_m FROM supplier),
p AS (SELECT object_id AS area_id, lon, lat, 0.002 + (object_id % 7) * 0.004 AS size FROM o WHERE object_id % 10 = 0),
k AS (SELECT * FROM (VALUES (0, 1.0, 0.0, 0.5, 0.9), (1, 0.5, 0.9, -0.5, 0.8), (2, -0.5, 0.8, -1.1, 0.1), (3, -1.1, 0.1, -0.4, -0.7), (4, -0.4, -0.7, 0.6, -0.8), (5, 0.6, -0.8, 1.0, 0.0)) t(i, ax, ay, ex, ey)),
e AS (SELECT area_id, lon + ax * size AS alon, lat + ay * size AS alat, lon + ex * size AS blon, lat + ey * size AS blat FROM p, k),
h AS (SELECT area_id, object_id FROM o JOIN e ON abs(o.lat - e.alat) < 0.1 AND ((alat > o.lat) <> (blat > o.lat)) AND o.lon < alon + (o.lat - alat) / (blat - alat) * (blon - alon) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


@query("x3_many_areas", f""", {HEX}
SELECT area_id, kind, count(*) AS objects, sum(length_m)::DOUBLE AS length_m, count(*) FILTER (high) AS high FROM h JOIN o USING (object_id) GROUP BY 1, 2""")
def x3_many(spark, sf):
    return areas.areas_summary(spots(spark, sf), hexagons(spark, sf))


@query_like("u2_episodes_function", "u2_episodes_by_sql_text")
def u2_function(spark, sf):
    """The same episodes by a table function over a whole table."""
    table_functions.register_functions(spark)
    view = f"journal_{uuid.uuid4().hex}"
    journal(spark, sf).createOrReplaceTempView(view)
    out = spark.sql(f"SELECT * FROM episodes(TABLE({view}), array('error'))")
    return out.select("channel_id", us("started_at").alias("started"), us("ended_at").alias("ended"), "rows_cnt", "closed_by")


@query("u2_section_rows", "SELECT journal_id, epoch_us(read_time) AS at, channel_id, value_text FROM j WHERE section_id = 3 AND read_time >= TIMESTAMP '2024-01-05' AND read_time < TIMESTAMP '2024-01-12'")
def u2_section(spark, sf):
    """A SQL function of a section and a range, inlined into the query that calls it."""
    view = f"journal_{uuid.uuid4().hex}"
    journal(spark, sf).createOrReplaceTempView(view)
    table_functions.register_functions(spark, view)
    return spark.sql("SELECT journal_id, unix_micros(read_time) AS at, channel_id, value_text FROM section_rows(3, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12')")


def alert_rows(spark, sf):
    """Channel-days as alerts at the day's end, and the failures that they should foretell."""
    rows = scores(spark, sf).select("channel_id", F.timestamp_add("DAY", F.lit(1), F.col("day").cast("timestamp")).alias("t"), "score")
    return rows, rule_episodes(spark, sf).select("channel_id", F.col("started_at").alias("t"))


@query("m15_matched_curve", f""", {SCORES},
n AS (SELECT count(*) AS n FROM sc),
w AS (SELECT DISTINCT floor(least(20, n) * pow(n / least(20, n), i / 59.0) + 1e-9)::BIGINT AS wanted FROM n, range(60) r(i) UNION SELECT n FROM n),
g AS (SELECT score, count(*) AS c FROM sc GROUP BY 1), t AS (SELECT score, c, sum(c) OVER (ORDER BY score DESC) AS through FROM g),
x AS (SELECT DISTINCT score, through FROM t JOIN w ON wanted <= through AND wanted > through - c),
k AS (SELECT sc.score, EXISTS (SELECT 1 FROM ep WHERE ep.channel_id = sc.channel_id AND epoch_us(started_at) - epoch_us((day + 1)::TIMESTAMP) BETWEEN 1000000 AND 604800000000) AS near FROM sc)
SELECT through::BIGINT AS alerts, (SELECT count(*) FROM k WHERE k.score >= x.score AND NOT near) AS fp, (SELECT count(*) FROM ep) AS failures FROM x""")
def m15_matched(spark, sf):
    """Alerts, false ones and failures at sixty numbers of alerts up to all rows; what the matching takes is tested against matching anew."""
    rows, failures = alert_rows(spark, sf)
    return M.matched_curve(rows, failures, most=None).select("alerts", "fp", (F.col("tp") + F.col("fn")).alias("failures"))


@query("m15_chosen_levels")
def m15_chosen(spark, sf):
    """High by best F1 of the matching, watch by ten times its alerts."""
    return M.choose_thresholds(M.matched_curve(*alert_rows(spark, sf)))


@query("d15_works_not_one", "SELECT o_orderkey, count(l_orderkey) AS works FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1 HAVING count(l_orderkey) <> 1")
def d15_works(spark, sf):
    """Orders with other than one returned line, as works of an order."""
    works = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_key"))
    return D.works_not_one(table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_key")), works).select(F.col("source_key").alias("o_orderkey"), "works")


@query("d15_collectors_without_order", """
, w AS (SELECT user_id % 40 AS prefix, max(ts) AS opened_at FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT DISTINCT user_id % 40 AS prefix, user_id % 8 AS collector FROM events),
o AS (SELECT user_id % 8 AS collector, max(ts) AS last FROM events WHERE event_type = 'purchase' AND user_id % 8 <> 3 GROUP BY 1)
SELECT DISTINCT collector FROM w LEFT JOIN b USING (prefix) LEFT JOIN o USING (collector) WHERE last IS NULL OR last < opened_at""")
def d15_collectors(spark, sf):
    j = journal(spark, sf)
    prefix, collector = (F.col("channel_id") % 40).alias("prefix"), (F.col("channel_id") % 8).alias("collector")
    warnings = j.where("is_alarm").groupBy(prefix).agg(F.max("read_time").alias("opened_at"))
    orders = j.where("value_text = 'purchase'").select(collector, F.col("read_time").alias("created_at")).where("collector <> 3")
    return D.collectors_without_order(warnings, j.select(prefix, collector), orders)


@query("r32_risk_matrix", """
, x AS (SELECT p_partkey, 1 + p_partkey % 31 / 10.0 AS pof, 1 + p_partkey % 7 / 2.0 AS cof FROM part), r AS (SELECT *, (pof * cof)::DOUBLE AS risk FROM x)
SELECT p_partkey, round(risk, 6) AS risk, CASE WHEN risk > 12 THEN 4 WHEN risk > 8 THEN 3 WHEN risk > 4 THEN 2 ELSE 1 END AS rank, CASE WHEN risk > 12 THEN 'red' WHEN risk > 8 THEN 'orange' WHEN risk > 4 THEN 'yellow' ELSE 'green' END AS zone,
greatest(1.0, least(60.0, round_even(36 / risk, 1)))::DOUBLE AS inspect_months FROM r""")
def r32_matrix(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", (1 + F.col("p_partkey") % 31 / 10.0).alias("pof"), (1 + F.col("p_partkey") % 7 / 2.0).alias("cof"))
    return N.risk_matrix(parts).select("p_partkey", F.round("risk", 6).alias("risk"), "rank", "zone", "inspect_months")


@query("r28_explained", """
, w AS (SELECT channel_id AS entity, value_text, value_num, CASE value_text WHEN 'view' THEN 'views' ELSE 'faults' END AS family, CASE value_text WHEN 'error' THEN 'faults' WHEN 'purchase' THEN 'losses' ELSE 'few views' END AS word
        FROM j WHERE value_text IN ('error', 'purchase') AND value_num > 50 OR value_text = 'view' AND value_num < 50),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY entity, family ORDER BY abs(value_num - 50) DESC, value_text) = 1),
t AS (SELECT entity, list(word ORDER BY abs(value_num - 50) DESC, value_text) AS words FROM b GROUP BY 1)
SELECT e.entity, coalesce(array_to_string(words, '; '), 'no notable factor') AS words FROM (SELECT DISTINCT channel_id AS entity FROM j) e LEFT JOIN t USING (entity)""")
def r28_explained(spark, sf):
    """Which factors explain a channel, in order, without their numbers."""
    f = F.collect_list(F.struct(F.col("value_text").alias("factor"), F.col("value_num").alias("value"), (F.col("value_num") - 50).alias("weight")))
    rows = journal(spark, sf).groupBy(F.col("channel_id").alias("entity")).agg(f.alias("factors"))
    families = spark.createDataFrame([("error", "faults", 1.0, "faults"), ("purchase", "faults", 1.0, "losses"), ("view", "views", -1.0, "few views")], "factor string, family string, danger double, template string")
    return R.explain(rows, "factors", families).select("entity", F.array_join("texts", "; ").alias("words"))


@query("b6_verdict_of_fits", """
SELECT s_suppkey AS grp, CASE WHEN s_suppkey % 11 / 5.0 - 1 < 0 THEN 'chatter' WHEN s_suppkey % 23 / 10.0 < 0.9 THEN 'early' WHEN s_suppkey % 23 / 10.0 <= 1.1 THEN 'random' ELSE 'wear' END AS verdict,
       s_suppkey % 11 / 5.0 - 1 >= 0.5 AND s_suppkey % 23 / 10.0 > 1.1 AS by_age FROM supplier""")
def b6_given(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grp"), (F.col("s_suppkey") % 23 / 10.0).alias("beta"), (F.col("s_suppkey") % 11 / 5.0 - 1).alias("k"))
    return B.life_verdict(s.select("grp", "beta"), s.select("grp", "k")).select("grp", "verdict", "by_age")
