"""Parameterised table functions as Spark SQL text, for users who work over temp views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def episodes_sql(view: str, predicate: str) -> str:
    """Episodes of a predicate over a journal view: channel_id, started_at, ended_at, rows_cnt, fault_value, closed_by."""
    return f"""
    WITH near AS (
      SELECT *, ({predicate}) AS bad, lag({predicate}) OVER w AS bad_before, lead(read_time) OVER w AS next_time, lead(value_text) OVER w AS next_value
      FROM {view} WINDOW w AS (PARTITION BY channel_id ORDER BY read_time, journal_id)),
    runs AS (
      SELECT *, sum(CASE WHEN coalesce(bad_before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY channel_id ORDER BY read_time, journal_id ROWS UNBOUNDED PRECEDING) AS run
      FROM near WHERE bad)
    SELECT channel_id, min(read_time) AS started_at, max_by(next_time, struct(read_time, journal_id)) AS ended_at, count(*) AS rows_cnt,
           min_by(value_text, struct(read_time, journal_id)) AS fault_value, max_by(next_value, struct(read_time, journal_id)) AS closed_by
    FROM runs GROUP BY channel_id, run"""


def incidents_sql(view: str, group: str, time: str, minutes: int) -> str:
    """Incidents of a view of events: group, first_at, last_at, events; a gap of exactly ``minutes`` still merges."""
    return f"""
    WITH gaps AS (SELECT {group} AS grp, {time} AS t, CASE WHEN unix_micros({time}) - unix_micros(lag({time}) OVER (PARTITION BY {group} ORDER BY {time})) <= {minutes} * 60000000L THEN 0 ELSE 1 END AS fresh FROM {view}),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM gaps)
    SELECT grp, min(t) AS first_at, max(t) AS last_at, count(*) AS events FROM runs GROUP BY grp, run"""
