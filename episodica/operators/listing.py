"""Journal pages, latest-per-key tables and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import between
from .joins import in_scope, next_event


def page(rows: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """One page in an order that must be complete (end it with an id)."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


#: Days that a bounded listing of technical events may span.
MOST_DAYS = 31


def technical_events(
    journal: DataFrame, external: DataFrame, *, alarm: Column, normal: Column, within_days: int = 31, kinds: list[str] | None = None, kind: str | None = None,
    text: str | None = None, section_id: int | None = None, scope: DataFrame | None = None, tree: DataFrame | None = None,
    first: str | None = None, last: str | None = None, time: str = "read_time", partition: str | None = None,
) -> DataFrame:
    """Alarms, the first normal reading after each, and external events: (at, kind, source_id, channel_id, section_id, text), filtered.

    ``first`` and ``last`` (moments as text, the end excluded, at most ``MOST_DAYS`` apart) bound all three sources: the
    journal is read from that range alone, by literal ranges on its time and on ``partition``, its day column, and a
    normal reading counts if it comes before ``last``.  ``section_id`` filters alarms before the look-ahead; normal
    readings are then those of the channels with such alarms (a normal reading is of its alarm's channel, whatever
    section stands on it).  Kinds that are not asked for are not looked up, and filters that are None are not in the
    plan at all.
    """
    if (first is None) != (last is None):
        raise ValueError("first and last go together")
    rows = journal
    if first is not None:
        low, high = (F.lit(m).cast("timestamp") for m in (first, last))
        days = (pd.Timestamp(last) - pd.Timestamp(first)).total_seconds() / 86400
        if not 0 < days <= MOST_DAYS:
            raise ValueError(f"the range must be of at most {MOST_DAYS} days and not empty")
        rows = rows.where(between(time, low, high, partition))
        external = external.where((F.col("at") >= low) & (F.col("at") < high))
    alarms = rows.where(alarm)
    if section_id is not None:
        alarms, external = (df.where(F.col("section_id") == section_id) if "section_id" in df.columns else df.where(F.lit(False)) for df in (alarms, external))
    wanted = {k for k in ("alarm", "normal", "external") if (not kinds or k in kinds) and kind in (None, k)}
    parts = []
    if "alarm" in wanted:
        parts.append(alarms.select(F.col(time).alias("at"), F.lit("alarm").alias("kind"), F.col("journal_id").alias("source_id"), "channel_id", "section_id", F.col("value_text").alias("text")))
    if "normal" in wanted:
        calm = rows.where(normal)
        if section_id is not None:
            calm = calm.join(alarms.select("channel_id").distinct(), "channel_id", "left_semi")
        after = next_event(alarms.select("channel_id", "section_id", time, "journal_id"), calm, "channel_id", time, "journal_id", within_days * 86400 * 1_000_000, ("value_text",))
        after = after.where("next_id is not null").select(F.col("next_time").alias("at"), F.lit("normal").alias("kind"), F.col("next_id").alias("source_id"), "channel_id", "section_id", F.col("next_value_text").alias("text"))
        parts.append(after.distinct())
    if "external" in wanted:
        parts.append(external.withColumn("kind", F.lit("external")))
    if not parts:
        raise ValueError("no kind of event is asked for")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    if text:
        rows = rows.where(F.col("text").ilike(f"%{text}%"))
    return in_scope(rows, scope, tree) if scope is not None else rows


def default_window(journal: DataFrame, days: int = 7) -> DataFrame:
    """(from_day, to_day): the week that ends with the last reading."""
    return journal.agg(F.to_date(F.max("read_time")).alias("to_day")).select(F.date_sub("to_day", days - 1).alias("from_day"), "to_day")


def reading_window(journal: DataFrame, key: str, value, from_day: str, to_day: str) -> DataFrame:
    """Readings of one entity, both days whole."""
    day = F.to_date("read_time")
    return journal.where((F.col(key) == value) & (day >= F.lit(from_day).cast("date")) & (day <= F.lit(to_day).cast("date")))


def outcome_summary(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Latest outcome of each forecast in five disjoint buckets that add up to the total."""
    last = latest_per_key(outcomes, ["forecast_id"], ["decided_at", "outcome_id"]).select("forecast_id", "outcome_code")
    rows = forecasts.select("forecast_id").join(last, "forecast_id", "left")
    code = F.col("outcome_code")
    known = ("confirmed", "rejected", "prevented", "unclear")
    return rows.agg(F.count("*").alias("total"), *[F.count_if(code == k).alias(k) for k in known], F.count_if(code.isNull() | ~code.isin(*known)).alias("open"))


def freshness(tables: dict[str, DataFrame], at: Column, norm_seconds: dict[str, float]) -> DataFrame:
    """(source, last_at, lag_seconds, lagging) of tables with a column ``at``; a table without rows lags."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.max("at").alias("last_at")).withColumns({"source": F.lit(name), "norm": F.lit(float(norm_seconds[name]))})
        out = row if out is None else out.unionByName(row)
    lag = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 1e6
    return out.withColumn("lag_seconds", lag).select("source", "last_at", "lag_seconds", (F.col("lag_seconds").isNull() | (F.col("lag_seconds") > F.col("norm"))).alias("lagging"))


def equipment_card(items: DataFrame, notifications: DataFrame, repairs: DataFrame, at: Column) -> DataFrame:
    """Age in years, wear (age over life), notifications of a year and last repair of each item."""
    year = notifications.where((F.col("at") > F.add_months(at, -12)) & (F.col("at") <= at)).groupBy("item_id").agg(F.count("*").alias("notifications"))
    last = repairs.groupBy("item_id").agg(F.max("done_at").alias("last_repair"))
    age = F.months_between(at, "in_service") / 12
    out = items.join(year, "item_id", "left").join(last, "item_id", "left")
    return out.withColumns({"age": age, "wear": age / F.nullif("life_years", F.lit(0)), "notifications": F.coalesce("notifications", F.lit(0))})


def grouped_in_order(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Groups in the order in which they first appear by key, with their keys in order."""
    return rows.groupBy(group).agg(F.min(key).alias("first_key"), F.array_sort(F.collect_list(key)).alias("keys"))


def risk_card(current: DataFrame, runs: DataFrame, written: DataFrame, key: str = "section_id", columns: tuple[str, ...] = ("direction", "explanation")) -> DataFrame:
    """Current risk with its run, and ``columns`` of the last forecast that was written for the entity.

    A forecast is written where it changed, so its run may be older than the current one; entities without any keep nulls.
    """
    last = written.groupBy(key).agg(*[F.max_by(c, "run_id").alias(c) for c in columns])
    return current.join(runs, "run_id").join(last, key, "left")


def criticality_reasons(sections: DataFrame, channels: DataFrame, systems: dict[str, tuple[str, ...]], between: str = ", ") -> DataFrame:
    """(section_id, criticality_reason): the section's distinct systems, in order, that its class names in ``systems``; null where there are none."""
    named = F.lit(None).cast("array<string>")
    for code, kinds in systems.items():
        named = F.when(F.col("criticality") == code, F.array(*map(F.lit, kinds))).otherwise(named)
    both = sections.select("section_id", named.alias("_k")).join(channels.select("section_id", "system_kind").distinct(), "section_id", "left")
    kept = F.collect_set(F.when(F.array_contains("_k", F.col("system_kind")), F.col("system_kind")))
    return both.groupBy("section_id").agg(F.nullif(F.array_join(F.array_sort(kept), between), F.lit("")).alias("criticality_reason"))


def order_detail(orders: DataFrame, reasons: DataFrame, log: DataFrame, key: str = "order_id") -> DataFrame:
    """Orders with their section's reason and ``history``: (at, status) in order of time; an order without log has an empty one."""
    history = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "status"))).alias("history"))
    return orders.join(reasons, "section_id", "left").join(history, key, "left").withColumn("history", F.coalesce("history", F.array()))


def notifications(notices: DataFrame, forecasts: DataFrame, current: DataFrame, *, acked: bool | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Notices of forecasts: the probability that raised each and the section's current one (null where none), newest id first on a page.

    ``acked`` keeps read or unread ones, ``scope`` those of its sections.
    """
    rows = notices.where("source_system = 'forecast'").withColumn("is_acked", F.col("acked_at").isNotNull())
    if acked is not None:
        rows = rows.where(F.col("is_acked") == acked)
    if scope is not None:
        rows = rows.join(scope.select("section_id").distinct(), "section_id", "left_semi")
    rows = rows.join(forecasts.select("forecast_id", "probability"), "forecast_id")
    return rows.join(current.select("section_id", F.col("probability").alias("current_probability")), "section_id", "left")


def audit_log(actions: DataFrame, users: DataFrame, *, time_from: Column | None = None, time_to: Column | None = None, login: str | None = None) -> DataFrame:
    """Actions with their user's login, null for unknown users; both bounds are inclusive, and filters that are None are not in the plan."""
    rows = actions
    if time_from is not None:
        rows = rows.where(F.col("occurred_at") >= time_from)
    if time_to is not None:
        rows = rows.where(F.col("occurred_at") <= time_to)
    rows = rows.join(users.select("user_id", "login"), "user_id", "left")
    return rows.where(F.col("login") == login) if login is not None else rows


def last_observation(rows: DataFrame, at: Column, columns: list[str], order: tuple[str, ...] = ("observed_at",), seconds_norm: float = 3600) -> DataFrame:
    """One row: the latest observation that is no forecast, the last fetch of any row, and ``stale``: that fetch is older than the norm, or there is none."""
    seen = F.when(~F.col("is_forecast"), F.struct(*order))
    out = rows.agg(F.max("fetched_at").alias("fetched_at"), F.max_by(F.struct(*columns), seen).alias("_o"))
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 1e6
    return out.select(*[F.col(f"_o.{c}").alias(c) for c in columns], "fetched_at", F.coalesce(age > seconds_norm, F.lit(True)).alias("stale"))


def data_status(edge: DataFrame, current: DataFrame, runs: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: data_edge, as_of, computed_at, lag_days, scored and total sections; ``edge`` holds the one value data_edge."""
    last = current.join(runs.select("run_id", "as_of", "started_at"), "run_id", "left").agg(F.max("as_of").alias("as_of"), F.max("started_at").alias("computed_at"), F.count_if(~F.col("is_stale")).alias("scored"))
    every = sections.agg(F.count("*").alias("total"))
    lag = (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("data_edge").cast("timestamp"))) / 8.64e10
    return edge.select("data_edge").join(F.broadcast(last)).join(F.broadcast(every)).withColumn("lag_days", lag)  # a row each


def run_line(runs: DataFrame, readings: DataFrame, daily: DataFrame, sections: DataFrame, days: int = 365) -> DataFrame:
    """One row for the last finished run: its seconds, readings and rollup rows of the ``days`` up to its moment, sections scored and in all.

    A run over all sections goes before a later one over some; without a finished run there is no row.
    """
    every = sections.agg(F.count("*").alias("sections_total"))
    done = runs.where("status = 'done' and finished_at is not null").join(F.broadcast(every))
    order = F.struct(F.coalesce(F.col("objects_scored") == F.col("sections_total"), F.lit(False)), F.col("run_id"))
    last = done.groupBy("sections_total").agg(F.max_by(F.struct("run_id", "as_of", "started_at", "finished_at", "objects_scored"), order).alias("r")).select("r.*", "sections_total")
    at = F.unix_micros(F.col("as_of").cast("timestamp"))
    t, day = F.unix_micros(F.col("read_time").cast("timestamp")), F.to_date("as_of")
    one = F.broadcast(last.select("as_of"))  # a single row
    inside = readings.select("read_time").join(one, (t <= at) & (t > at - days * 86_400_000_000)).agg(F.count("*").alias("readings"))
    rolled = daily.select("day").join(one, (F.col("day") <= day) & (F.col("day") > F.date_sub(day, days))).agg(F.count("*").alias("rollup_rows"))
    took = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return last.join(F.broadcast(inside)).join(F.broadcast(rolled)).withColumn("seconds", took)
