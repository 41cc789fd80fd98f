"""Registry of queries, and the driver's tables in the library's shapes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under a name, with the SQL that returns the same rows."""

    def put(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, f"WITH {COMMON} {sql.strip()}" if sql else None)
        return run

    return put


def query_like(name: str, other: str):
    """Register another way to the rows of a query: it must return what the other query's SQL returns."""

    def put(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, REGISTRY[other].sql)
        return run

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def journal(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a journal: error is the fault word, purchase the undefined one, signup an alarm."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("journal_id"), F.col("ts").cast("timestamp").alias("read_time"), F.col("user_id").alias("channel_id"), (F.col("user_id") % 20).alias("section_id"),
        (F.col("event_type") == "signup").alias("is_alarm"), F.col("event_type").alias("value_text"), F.col("value").alias("value_num"),
    )


def channels(spark: SparkSession, sf: str) -> DataFrame:
    """Channels of the journal: kind and system by number, every seventh without kind; section, collector and picket."""
    ids = table(spark, sf, "events").select(F.col("user_id").alias("channel_id")).distinct()
    c = F.col("channel_id")
    return ids.select(
        c, F.when(c % 7 != 0, F.concat(F.lit("kind"), c % 3)).alias("sensor_kind"), F.element_at(F.array(*map(F.lit, ("gas", "fire", "security", "flood"))), (c % 4 + 1).cast("int")).alias("system_kind"),
        (c % 20).alias("section_id"), (c % 5).alias("object_id"), F.concat(F.lit("col"), c % 5).alias("collector"), (c % 11).alias("picket"),
    )


def us(col: str | Column) -> Column:
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


END = "2024-01-31 00:00:00"

#: SQL of the same shapes, in front of every oracle query.
COMMON = """
j AS (SELECT event_id AS journal_id, ts AS read_time, user_id AS channel_id, user_id % 20 AS section_id, event_type = 'signup' AS is_alarm,
             event_type AS value_text, value AS value_num FROM events),
c AS (SELECT DISTINCT user_id AS channel_id, CASE WHEN user_id % 7 <> 0 THEN 'kind' || (user_id % 3) END AS sensor_kind,
             (['gas', 'fire', 'security', 'flood'])[(user_id % 4 + 1)::INT] AS system_kind, user_id % 20 AS section_id, user_id % 5 AS object_id,
             'col' || (user_id % 5) AS collector, user_id % 11 AS picket FROM events),
nb AS (SELECT *, value_text = 'error' AS bad, lag(value_text = 'error') OVER w AS pb, lead(read_time) OVER w AS nt, lead(value_text) OVER w AS nv
       FROM j WINDOW w AS (PARTITION BY channel_id ORDER BY read_time, journal_id)),
gr AS (SELECT *, sum(CASE WHEN NOT coalesce(pb, false) THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id ROWS UNBOUNDED PRECEDING) AS run FROM nb WHERE bad),
ep0 AS (SELECT channel_id, min(read_time) AS started_at, count(*) AS rows_cnt, arg_min(section_id, (read_time, journal_id)) AS section_id,
               arg_min(value_text, (read_time, journal_id)) AS fault_value,
               max(CASE WHEN nt IS NULL THEN 1 ELSE 0 END) AS is_open,
               (list(nt ORDER BY read_time DESC, journal_id DESC))[1] AS ended_at, (list(nv ORDER BY read_time DESC, journal_id DESC))[1] AS closed_by
        FROM gr GROUP BY channel_id, run),
ep AS (SELECT * EXCLUDE (is_open) FROM ep0 WHERE epoch_us(coalesce(ended_at, TIMESTAMP '2024-01-31 00:00:00')) - epoch_us(started_at) > 3600000000)
"""
