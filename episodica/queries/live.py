"""Queries over streams with late rows, timers and maintained tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import risk as R
from ..operators import rollup as A
from ..streaming import maintain as M
from ..streaming import settled as L
from .base import channels, journal, query, us
from .domain import reading_stream, rocksdb, shared_folder

#: Microseconds: rows of the arrival streams come up to a day late, the watermark waits two.
DAY = 86_400_000_000
BATCHES = 3


def arrivals(spark, sf):
    """The journal with ``batch``, the run in which a row arrives: by its time and a lateness of up to a day, drawn from its id."""
    late = F.pmod(F.xxhash64("journal_id"), F.lit(DAY))
    first = F.lit("2024-01-01").cast("timestamp")
    return journal(spark, sf).withColumn("batch", F.least(F.lit(BATCHES - 1), F.greatest(F.lit(0), F.floor((us("read_time") + late - us(first)) / (10 * DAY)))).cast("int"))


def run_arrivals(spark, sf, build):
    """Feed the arrivals to ``build(stream)`` one batch after the other, each by a stream that goes on from the last one's checkpoint."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = arrivals(spark, sf)
    with rocksdb(spark):
        for k in range(BATCHES):
            rows.where(F.col("batch") == k).drop("batch").write.mode("append").parquet(f"{path}/in")
            stream = build(spark.readStream.schema(rows.drop("batch").schema).parquet(f"{path}/in"))
            stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{path}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


#: The last watermark: two days before the latest row, in whole milliseconds.
MARK = "m AS (SELECT (epoch_us(max(read_time)) // 1000 - 172800000) * 1000 AS mark FROM j)"


@query("t5_late_episodes", f"""
, {MARK}
SELECT channel_id, epoch_us(started_at) AS started, epoch_us(ended_at) AS ended, rows_cnt, fault_value, closed_by FROM ep0, m WHERE ended_at IS NOT NULL AND epoch_us(ended_at) <= mark""")
def t5_late(spark, sf):
    out = run_arrivals(spark, sf, lambda s: L.late_episodes(s, ("error",)))
    return out.select("channel_id", F.col("started_us").alias("started"), F.col("ended_us").alias("ended"), "rows_cnt", "fault_value", "closed_by")


@query("t6_live_heartbeats")
def t6_heartbeats(spark, sf):
    """Decisions of every channel with heartbeats twice a day, whether rows come or not."""
    build = lambda s: L.live_heartbeats(s.select(F.col("channel_id").alias("key"), "read_time", "journal_id", (F.col("value_num") / 100).alias("probability")), R.POLICY | {"threshold": 0.5, "heartbeat_min": 720.0}, forget_min=2 * 1440.0)
    return run_arrivals(spark, sf, build)


@query("t8_silence_alerts", f"""
, {MARK},
g AS (SELECT channel_id, epoch_us(read_time) AS t, lead(epoch_us(read_time)) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id) AS nt,
             CASE WHEN channel_id % 3 <> 0 THEN 86400000000 END AS norm FROM j),
e AS (SELECT 'silent' AS event, channel_id, t + norm + 1 AS at_us, t AS last_us FROM g WHERE norm IS NOT NULL AND (nt IS NULL OR nt > t + norm + 1)
      UNION ALL SELECT 'back', channel_id, nt, t FROM g WHERE nt > t + norm + 1 AND nt <= t + 172800000000
      UNION ALL SELECT 'gone', channel_id, t + 172800000000, t FROM g WHERE nt IS NULL OR nt > t + 172800000000)
SELECT channel_id::VARCHAR AS source, event, at_us, last_us FROM e, m WHERE at_us <= mark""")
def t8_alerts(spark, sf):
    norms = channels(spark, sf).where("channel_id % 3 <> 0").select(F.col("channel_id").alias("source"), F.lit(86_400).alias("norm_seconds"))
    return run_arrivals(spark, sf, lambda s: L.silence_alerts(s, "channel_id", norms, forget="2 days"))


@query("t3_maintained_rollup", "SELECT channel_id, strftime(read_time, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (value_text = 'error') AS faults, max(epoch_us(read_time)) AS last_us FROM j GROUP BY 1, 2")
def t3_maintained(spark, sf):
    """A channel's days, kept by batches of late rows: the second and third batch change days of the first."""
    path = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    rows = arrivals(spark, sf)
    put = M.maintained_rollup(f"{path}/raw", f"{path}/days", lambda r: A.channel_daily(r, F.col("value_text") == "error", F.col("value_text") == "purchase"))
    for k in range(BATCHES):
        # the stream of a batch and a run of it again, as after a failure
        for _ in range(2 if k == 1 else 1):
            put(rows.where(F.col("batch") == k).drop("batch"), k)
    out = spark.read.parquet(f"{path}/days")
    return out.select("channel_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "faults", us("last_read").alias("last_us"))


@query("t3_rollup_stream", "SELECT section_id, strftime(read_time, '%Y-%m-%d') AS day, count(*) AS total FROM j GROUP BY 1, 2")
def t3_stream(spark, sf):
    """The same kept by foreachBatch over the reading stream."""
    path = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    put = M.maintained_rollup(f"{path}/raw", f"{path}/days", lambda r: r.groupBy("section_id", "day").agg(F.count("*").alias("total")))
    reading_stream(spark, sf).writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/days").select("section_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "total")
