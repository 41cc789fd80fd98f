"""Queries over cards, orders, notices, logs and statuses, files and their audit, and ingestion by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clean, scalar
from ..operators import joins as J
from ..operators import listing as Q
from ..operators import metrics as M
from ..operators import quality as D
from ..operators import reliability as B
from ..sources import journal as S
from ..streaming import live as T
from .base import channels, journal, query, stamp, table, us
from .decisions import SCORES, scores
from .domain import reading_stream, shared_folder
from .journal import INCIDENTS, incidents, rule_episodes

DAY_US = 86_400_000_000


@query("j6_node_sections", "SELECT collector, 'node' || (channel_id % 3) AS node, count(*) AS channels, list_sort(list(DISTINCT section_id)) AS sections FROM c GROUP BY 1, 2")
def j6(spark, sf):
    return J.tree_listing(channels(spark, sf).withColumn("node", F.concat(F.lit("node"), F.col("channel_id") % 3)))


@query("j20_prefix_fan_out", "SELECT event_id AS journal_id, 'col' || (c_nationkey % 5) AS collector FROM events JOIN customer ON c_mktsegment = ['BUILDING', 'FURNITURE', 'MACHINERY'][(user_id % 3 + 1)::INT] WHERE event_type = 'signup' GROUP BY 1, 2")
def j20(spark, sf):
    """An alert of a prefix goes to each of the prefix's collectors once."""
    prefix = F.element_at(F.array(*map(F.lit, ("BUILDING", "FURNITURE", "MACHINERY"))), (F.col("channel_id") % 3 + 1).cast("int"))
    mapping = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("prefix"), F.concat(F.lit("col"), F.col("c_nationkey") % 5).alias("collector"))
    alerts = journal(spark, sf).where("is_alarm").select("journal_id", prefix.alias("prefix"))
    return J.fan_out(alerts, mapping, "prefix", "collector").select("journal_id", "collector")


@query("q7_written_explanation", "SELECT o_custkey AS section_id, max(o_orderkey) AS run_id, epoch_us(arg_max(o_orderdate, o_orderkey)) AS computed_us, arg_max(o_totalprice, o_orderkey) AS probability, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS explanation FROM orders GROUP BY 1")
def q7(spark, sf):
    """The explanation comes from the section's last written forecast, which may be older than the current run."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("section_id"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("probability"), "o_orderdate", "o_orderstatus", F.col("o_orderpriority").alias("explanation"))
    current = o.groupBy("section_id").agg(F.max("run_id").alias("run_id"), F.max_by("probability", "run_id").alias("probability"))
    out = Q.risk_card(current, o.select("run_id", F.col("o_orderdate").alias("started_at")), o.where("o_orderstatus = 'F'"), columns=("explanation",))
    return out.select("section_id", "run_id", us("started_at").alias("computed_us"), "probability", "explanation")


@query("q11_order_card", """
, r AS (SELECT section_id, string_agg(DISTINCT system_kind, ', ' ORDER BY system_kind) FILTER ((section_id % 3 = 0 AND system_kind IN ('fire', 'gas')) OR (section_id % 3 = 1 AND system_kind IN ('security', 'fire'))) AS reason FROM c GROUP BY 1),
h AS (SELECT l_orderkey, string_agg(n || ':' || s, ',' ORDER BY n, s) AS history FROM (SELECT l_orderkey, l_linenumber AS n, l_linestatus AS s FROM lineitem) GROUP BY 1)
SELECT o_orderkey AS order_id, reason AS criticality_reason, coalesce(history, '') AS history FROM orders LEFT JOIN r ON r.section_id = o_custkey % 20 LEFT JOIN h ON l_orderkey = o_orderkey""")
def q11(spark, sf):
    sections = channels(spark, sf).select("section_id").distinct().withColumn("criticality", F.element_at(F.array(*map(F.lit, "ABC")), (F.col("section_id") % 3 + 1).cast("int")))
    reasons = Q.criticality_reasons(sections, channels(spark, sf), {"A": ("fire", "gas"), "B": ("security", "fire")})
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 20).alias("section_id"))
    log = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("at"), F.col("l_linestatus").alias("status"))
    text = F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["at"].cast("string"), h["status"])), ",")
    return Q.order_detail(orders, reasons, log).select("order_id", "criticality_reason", text.alias("history"))


@query("q12_notification_list", "SELECT o_orderkey AS id, o_totalprice AS probability, c_acctbal AS current_probability FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 WHERE o_orderpriority LIKE '1%' AND o_orderstatus <> 'F' AND o_custkey % 10 <= 3")
def q12(spark, sf):
    o = table(spark, sf, "orders")
    source = F.when(F.col("o_orderpriority").startswith("1"), "forecast").otherwise("hand")
    notices = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("section_id"), F.col("o_orderkey").alias("forecast_id"), source.alias("source_system"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("acked_at"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("section_id"), F.col("c_acctbal").alias("probability"))
    out = Q.notifications(notices, o.select(F.col("o_orderkey").alias("forecast_id"), F.col("o_totalprice").alias("probability")), c.where("section_id % 2 = 0"), acked=False, scope=c.where("section_id % 10 <= 3"))
    return out.select("id", "probability", "current_probability")


@query("q13_audit_by_login", "SELECT event_id AS action_id, 'u' || c_nationkey AS login FROM events JOIN customer ON c_custkey = user_id WHERE c_nationkey = 2 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def q13(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("u"), "c_nationkey").alias("login"))
    actions = table(spark, sf, "events").select(F.col("event_id").alias("action_id"), F.col("ts").cast("timestamp").alias("occurred_at"), "user_id")
    return Q.audit_log(actions, users, time_from=stamp("2024-01-05"), time_to=stamp("2024-01-20"), login="u2").select("action_id", "login")


@query("q17_weather_status", "SELECT epoch_us(arg_max(ts, (ts, event_id)) FILTER (event_type <> 'click')) AS observed_us, arg_max(value, (ts, event_id)) FILTER (event_type <> 'click') AS temp_c, max(epoch_us(ts)) - 600000000 AS fetched_us, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - (max(epoch_us(ts)) - 600000000) > 3600000000 AS stale FROM events")
def q17(spark, sf):
    rows = journal(spark, sf).select("journal_id", F.col("read_time").alias("observed_at"), (F.col("value_text") == "click").alias("is_forecast"), F.timestamp_micros(us("read_time") - 600_000_000).alias("fetched_at"), F.col("value_num").alias("temp_c"))
    out = Q.last_observation(rows, stamp("2024-01-31"), ["observed_at", "temp_c"], ("observed_at", "journal_id"))
    return out.select(us("observed_at").alias("observed_us"), "temp_c", us("fetched_at").alias("fetched_us"), "stale")


def nation_runs(spark, sf):
    """One run a nation: its moment, start, end (every fifth is not done) and sections scored."""
    n = F.col("n_nationkey")
    at = us(stamp("2024-01-05")) + (n % 7) * DAY_US
    started = at + 3_600_000_000
    return table(spark, sf, "nation").select(
        n.alias("run_id"), F.timestamp_micros(at).alias("as_of"), F.timestamp_micros(started).alias("started_at"), F.when(n % 5 != 0, F.timestamp_micros(started + n * 60_000_000)).alias("finished_at"),
        F.when(n % 5 != 0, "done").otherwise("failed").alias("status"), (n % 11).alias("objects_scored"),
    )


@query("a22_run_status", """
, r AS (SELECT n_nationkey, epoch_us(TIMESTAMP '2024-01-05') + (n_nationkey % 7) * 86400000000 AS moment FROM nation), x AS (SELECT max(moment) AS moment, count(*) FILTER (c_acctbal >= 0) AS scored FROM customer LEFT JOIN r ON n_nationkey = c_nationkey)
SELECT (SELECT max(epoch_us(ts)) FROM events) AS edge_us, moment AS as_of_us, moment + 3600000000 AS computed_us, round((moment - (SELECT max(epoch_us(ts)) FROM events)) / 8.64e10, 6) AS lag_days, scored, (SELECT count(*) FROM supplier) AS total FROM x""")
def a22(spark, sf):
    current = table(spark, sf, "customer").select(F.col("c_custkey").alias("section_id"), F.col("c_nationkey").alias("run_id"), (F.col("c_acctbal") < 0).alias("is_stale"))
    out = Q.data_status(journal(spark, sf).agg(F.max("read_time").alias("data_edge")), current, nation_runs(spark, sf), table(spark, sf, "supplier"))
    return out.select(us("data_edge").alias("edge_us"), us("as_of").alias("as_of_us"), us("computed_at").alias("computed_us"), F.round("lag_days", 6).alias("lag_days"), "scored", "total")


@query("m13_run_line", """
, r AS (SELECT n_nationkey AS k, epoch_us(TIMESTAMP '2024-01-05') + (n_nationkey % 7) * 86400000000 AS moment FROM nation WHERE n_nationkey % 5 <> 0 ORDER BY n_nationkey % 11 = (SELECT count(*) FROM region) DESC, n_nationkey DESC LIMIT 1)
SELECT k::BIGINT AS run_id, k * 60.0::DOUBLE AS seconds, (SELECT count(*) FROM events WHERE epoch_us(ts) <= moment AND epoch_us(ts) > moment - 3 * 86400000000) AS readings,
(SELECT count(*) FROM (SELECT DISTINCT section_id, read_time::DATE AS day FROM j) WHERE epoch_us(day::TIMESTAMP) <= moment AND epoch_us(day::TIMESTAMP) > moment - 3 * 86400000000) AS rollup_rows, (k % 11)::BIGINT AS objects_scored, (SELECT count(*) FROM region) AS sections_total FROM r""")
def m13(spark, sf):
    daily = journal(spark, sf).select("section_id", F.to_date("read_time").alias("day")).distinct()
    out = Q.run_line(nation_runs(spark, sf), journal(spark, sf), daily, table(spark, sf, "region"), 3)
    return out.select(F.col("run_id").cast("long").alias("run_id"), "seconds", "readings", "rollup_rows", F.col("objects_scored").cast("long").alias("objects_scored"), "sections_total")


@query("a20_definition_counters", f""", {SCORES}, {INCIDENTS}, s AS (SELECT * FROM (VALUES ('train', DATE '2024-01-01', DATE '2024-01-14'), ('test', DATE '2024-01-15', DATE '2024-01-25'), ('later', DATE '2025-01-01', DATE '2025-01-02')) v(split, a, b)),
f AS (SELECT split, count(*) AS n FROM s JOIN ep ON started_at::DATE BETWEEN a AND b GROUP BY 1), i AS (SELECT split, count(*) AS n FROM s JOIN inc ON first_at::DATE BETWEEN a AND b GROUP BY 1), d AS (SELECT split, count(*) AS n, sum(label)::BIGINT AS p FROM s JOIN sc ON day BETWEEN a AND b GROUP BY 1)
SELECT split, coalesce(f.n, 0) AS failures, coalesce(i.n, 0) AS incidents, coalesce(d.n, 0) AS days, coalesce(p, 0) AS positives, round(p / d.n, 6) AS base_rate FROM s LEFT JOIN f USING (split) LEFT JOIN i USING (split) LEFT JOIN d USING (split)""")
def a20(spark, sf):
    splits = spark.createDataFrame([("train", "2024-01-01", "2024-01-14"), ("test", "2024-01-15", "2024-01-25"), ("later", "2025-01-01", "2025-01-02")], "split string, a string, b string")
    splits = splits.select("split", F.to_date("a").alias("first_day"), F.to_date("b").alias("last_day"))
    out = M.definition_counters(rule_episodes(spark, sf).select(F.col("started_at").alias("t")), incidents(spark, sf).select(F.col("first_at").alias("t")), scores(spark, sf).select("day", F.col("label").alias("y")), splits)
    return out.withColumn("base_rate", F.round("base_rate", 6))


@query("d17_order_completeness", """
, w AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), x AS (SELECT count(*) AS orders, count(*) FILTER (o_custkey % 10 <> 0) AS with_object, count(*) FILTER (o_orderstatus <> 'P') AS with_due, count(*) FILTER (o_orderpriority NOT LIKE '5%') AS with_reason,
count(w.l_orderkey) AS with_work, count(c_custkey) AS linked, count(DISTINCT c_custkey) AS forecasts FROM orders LEFT JOIN w ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = 0) SELECT *, false AS ok FROM x""")
def d17(spark, sf):
    o = F.col("o_custkey")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.when(o % 10 != 0, o).alias("object_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("due_at"),
        F.when(F.col("o_orderpriority").startswith("5"), "  ").otherwise(F.col("o_orderpriority")).alias("reason"), o.alias("forecast_id"),
    )
    works = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id"))
    return D.completeness(orders, works, table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("forecast_id")))


#: Column names of a raw file; the fifth part of ids, flags and times below is written badly on purpose.
RAW = ("ИД записи журнала", "ИД канала данных", "Дата записи", "Время", "Тревожное", "Текущее значение")


def raw_files(spark, sf):
    """The events as two CSV files with the journal's own headers, in the shared folder."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    cells = (
        F.when(k % 10 == 3, F.concat(F.lit("x"), k)).otherwise(k.cast("string")), F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"),
        F.when(k % 10 == 6, "25h").otherwise(F.date_format("ts", "HH:mm:ss")), F.when(k % 10 == 7, "maybe").when(F.col("event_type") == "signup", "да").otherwise("нет"), F.col("value").cast("string"),
    )
    path = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    part = F.concat(F.lit("f"), (F.col("user_id") % 2).cast("string"))
    e.select(*[c.alias(n) for c, n in zip(cells, RAW)], part.alias("part")).write.partitionBy("part").option("header", True).csv(path)
    rows = S.read_csv(spark, [f"{path}/part=f0", f"{path}/part=f1"])
    return rows.withColumn("file", F.regexp_extract("file", "part=(f[01])", 1))


REJECT = "CASE WHEN event_id % 10 = 3 THEN 'id is no number' WHEN event_id % 10 = 6 THEN 'time not parsed' WHEN event_id % 10 = 7 THEN 'flag not parsed' END"


@query("s1_header_synonyms", f"SELECT 'f' || (user_id % 2) AS file, event_id AS journal_id, epoch_us(date_trunc('second', ts)) - 10800000000 AS at_us, user_id::INT AS channel_id, event_type = 'signup' AS is_alarm FROM events WHERE {REJECT} IS NULL")
def s1(spark, sf):
    """CSV files with synonyms in their headers, read as text, validated and parsed."""
    good = S.good_rows(S.validate(raw_files(spark, sf)))
    return good.select("file", "journal_id", us("read_time").alias("at_us"), "channel_id", "is_alarm")


@query("a8_file_audit", f"SELECT 'f' || (user_id % 2) AS file, count(*) AS planned, count(*) FILTER ({REJECT} IS NULL) AS loaded, count({REJECT}) AS failed, strftime(min((ts - INTERVAL 3 HOUR)::DATE) FILTER (event_id % 10 <> 6), '%Y-%m-%d') AS first_day, strftime(max((ts - INTERVAL 3 HOUR)::DATE) FILTER (event_id % 10 <> 6), '%Y-%m-%d') AS last_day FROM events GROUP BY 1")
def a8(spark, sf):
    out = S.load_report(S.validate(raw_files(spark, sf)))
    return out.select("file", "planned", "loaded", "failed", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"))


@query("a8_invalid_channels", f"SELECT 'f' || (user_id % 2) AS file, user_id::INT AS channel_id, {REJECT} AS reject, count(*) AS rows FROM events WHERE event_id % 10 IN (6, 7) GROUP BY 1, 2, 3")
def a8b(spark, sf):
    return S.invalid_channels(S.validate(raw_files(spark, sf)))


@query("s3_year_scan", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate <= TIMESTAMP '1997-06-30' GROUP BY 1")
def s3(spark, sf):
    """Folders by year: those outside the bounds are not listed, rows are cut by pushed-down filters."""
    path = f"{shared_folder(spark)}/years-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey").withColumn("year", F.year("ts"))
    o.repartition("year").write.partitionBy("year").parquet(path)
    return S.read_years(spark, path, "1995-03-01", "1997-06-30").groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("s6_sorted_sink", "SELECT o_custkey, o_orderkey FROM orders")
def s6(spark, sf):
    path = f"{shared_folder(spark)}/sorted-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    S.write_sorted(o, path, ["o_custkey", "o_orderkey"])
    return spark.read.schema(o.schema).parquet(path)


@query("p4_kind_names", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'Пожарный датчик' END AS kind FROM customer")
def p4(spark, sf):
    """Names with stray spaces, Latin look-alikes and capitals meet the dictionary's spelling; others get null."""
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, " пожарный  датчик ").when(k == 1, "ПOЖAPHЫЙ ДATЧИK").when(k == 2, "Пожарный датчик").otherwise("Иной")
    kinds = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("Пожарный датчик").alias("name"))
    return clean.canonical_kind(table(spark, sf, "customer").select("c_custkey", name.alias("raw")), "raw", kinds, "name", "kind").select("c_custkey", "kind")


@query("m4_verdict", "SELECT s_suppkey, s_suppkey % 10 > 7 AS precision_ok, s_suppkey % 7 > 4 AS recall_ok, (s_suppkey % 40 >= 24) AND s_suppkey % 5 <= 1 AS lead_ok, s_suppkey % 10 > 7 AND s_suppkey % 7 > 4 AND s_suppkey % 40 >= 24 AND s_suppkey % 5 <= 1 AS passed FROM supplier")
def m4(spark, sf):
    """Strictly above both minima; lead is judged as the horizon of 12 hours leaves it open."""
    s = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select("s_suppkey", (s % 10 / 10).alias("precision"), (s % 7 / 8).alias("recall"), (s % 40).cast("double").alias("median_lead"), (s % 5 / 5).alias("under_24h"))
    return M.verdict(rows, 12).select("s_suppkey", "precision_ok", "recall_ok", "lead_ok", "passed")


@query("b4_conditional_failure", "SELECT s_suppkey, round(1 - exp(pow((s_suppkey % 300) / 200.0, 1.5) - pow((s_suppkey % 300 + 30) / 200.0, 1.5)), 6) AS p_fail FROM supplier")
def b4(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 300).alias("age"), F.lit(30).alias("ahead"), F.lit(1.5).alias("beta"), F.lit(200.0).alias("eta"))
    return B.conditional_failure(rows, "age", "ahead").select("s_suppkey", F.round("p_fail", 6).alias("p_fail"))


@query("f8_hash_uniform", "SELECT o_orderkey, round(('0x' || substr(md5(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0, 9) AS u FROM orders")
def f8(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(scalar.hash_uniform(F.col("o_orderkey"), F.col("o_custkey")), 9).alias("u"))


@query("f2_local_days", "SELECT strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def f2(spark, sf):
    return journal(spark, sf).groupBy(F.date_format(scalar.local_day(F.col("read_time"), "Europe/Moscow"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("t1_batch_counters", "SELECT count(*) + count(*) FILTER (event_id % 10 = 0) AS received, count(*) FILTER (user_id % 4 <> 1) AS accepted, count(*) FILTER (user_id % 4 = 1) + count(*) FILTER (user_id % 4 = 1 AND event_id % 10 = 0) AS unknown, count(*) FILTER (user_id % 4 <> 1 AND event_id % 10 = 0) AS duplicates FROM events")
def t1(spark, sf):
    """Readings by micro-batch into a target by day, each tenth sent twice; the counters of all batches are added up."""
    path = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    sent = reading_stream(spark, sf).withColumn("copy", F.explode(F.when(F.col("journal_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    put = T.ingest_batches(channels(spark, sf).where("channel_id % 4 <> 1").select("channel_id"), f"{path}/target", f"{path}/report")
    sent.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    names = ("received", "accepted", "unknown", "duplicates")
    return spark.read.parquet(f"{path}/report").agg(*[F.sum(c).alias(c) for c in names])
