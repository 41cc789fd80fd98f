"""Failure episodes, incidents and other runs of rows (gaps and islands).

Rows are always ordered by (time, id).  One window over the channel serves every predicate: neighbours are
looked up once, good rows then fall away, and only rows in or beside a failure are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import overlap, seconds


def _order(channel: str, time: str, row_id: str):
    return Window.partitionBy(channel).orderBy(time, row_id)


def fault_rules(rules: DataFrame, kinds: DataFrame) -> DataFrame:
    """(sensor_kind, fault_value, min_seconds), and null kind for values that are faults of every kind."""
    n = kinds.select("sensor_kind").distinct().count()
    universal = rules.groupBy("fault_value").agg(F.max("min_seconds").alias("min_seconds"), F.count_distinct("sensor_kind").alias("kinds")).where(F.col("kinds") == n)
    named = rules.select("sensor_kind", "fault_value", "min_seconds")
    return named.unionByName(universal.select(F.lit(None).cast("string").alias("sensor_kind"), "fault_value", "min_seconds"))


def mark_bad(journal: DataFrame, channels: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``bad`` and ``min_seconds`` by (kind, value); a channel without kind takes the universal rule.

    Channels and rules are dimension tables; Spark broadcasts them if their size allows and shuffles if not.
    """
    typed = journal.join(channels.select("channel_id", "sensor_kind"), "channel_id", "left")
    rule = rules.select(F.coalesce("sensor_kind", F.lit("")).alias("_kind"), F.col("fault_value").alias("_value"), "min_seconds")
    on = (F.coalesce(typed["sensor_kind"], F.lit("")) == rule["_kind"]) & (typed["value_text"] == rule["_value"])
    return typed.join(rule, on, "left").withColumn("bad", F.col("min_seconds").isNotNull()).drop("_kind", "_value")


def episodes(
    journal: DataFrame,
    predicates: dict[str, Column],
    *,
    channel: str = "channel_id",
    time: str = "read_time",
    row_id: str = "journal_id",
    value: str = "value_text",
    section: str | None = "section_id",
    ts_to: Column | None = None,
) -> DataFrame:
    """Runs of rows for which a predicate holds: one row per (predicate, channel, run).

    Returns predicate, channel, section_id, started_at, ended_at, rows_cnt, fault_value, closed_by.  A run
    opens at its first bad row, with its value and section, and closes at the first later other row; a run
    without one is open, with null end.  Exact duplicates are dropped first.  ``ts_to`` reads the journal up to
    that moment.
    """
    keep = [channel, time, row_id, value] + ([section] if section else [])
    rows = journal if ts_to is None else journal.where(F.col(time) <= ts_to)
    rows = rows.select(*keep, *[F.coalesce(p, F.lit(False)).alias(f"_b_{n}") for n, p in predicates.items()]).dropDuplicates([channel, time, row_id, value])
    w = _order(channel, time, row_id)
    flags = [f"_b_{n}" for n in predicates]
    rows = rows.withColumns({"_next": F.lead(time).over(w), "_next_value": F.lead(value).over(w)} | {f"_s{f}": F.col(f) & ~F.coalesce(F.lag(f).over(w), F.lit(False)) for f in flags})
    some = F.greatest(*[F.col(f) for f in flags]) if len(flags) > 1 else F.col(flags[0])
    rows = rows.where(some)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_r{f}": F.sum(F.col(f"_s{f}").cast("int")).over(run) for f in flags})
    each = F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(f"_b_{n}").alias("bad"), F.col(f"_r_b_{n}").alias("run")) for n in predicates])
    rows = rows.withColumn("_e", F.explode(F.filter(each, lambda e: e["bad"])))
    at = F.struct(time, row_id)
    first = [F.min_by(value, at).alias("fault_value")] + ([F.min_by(section, at).alias("section_id")] if section else [])
    out = rows.groupBy(F.col("_e.predicate").alias("predicate"), channel, F.col("_e.run").alias("run")).agg(
        F.min(time).alias("started_at"),
        F.max_by("_next", at).alias("ended_at"),
        F.count("*").cast("int").alias("rows_cnt"),
        *first,
        F.max_by("_next_value", at).alias("closed_by"),
    )
    return out.drop("run")


def long_episodes(found: DataFrame, archive_end: Column, min_seconds: Column) -> DataFrame:
    """Episodes strictly longer than ``min_seconds``; open ones are measured to the archive's end and stay open."""
    return found.where(seconds(F.coalesce("ended_at", archive_end), F.col("started_at")) > min_seconds)


def spans_outage(found: DataFrame, outages: DataFrame, archive_end: Column, reason: str = "export_gap") -> DataFrame:
    """Add ``spans_outage``: the episode shares a moment with an outage of that reason (half-open intervals).

    Outages are few; they are laid out by day, so the join is an equality and never a product.
    """
    days = lambda s, e: F.explode(F.sequence(F.to_date(s), F.to_date(e)))
    gaps = outages.where(F.col("reason") == reason).select(F.col("started_at").alias("_gs"), F.col("ended_at").alias("_ge"))
    gaps = gaps.withColumn("_day", days(F.col("_gs"), F.col("_ge")))
    numbered = found.withColumn("_end", F.coalesce("ended_at", archive_end))
    key = F.struct("channel_id", "started_at")
    laid = numbered.select(key.alias("_k"), F.col("started_at").alias("_s"), F.col("_end").alias("_e"))
    laid = laid.withColumn("_day", days(F.col("_s"), F.greatest(F.col("_s"), F.col("_e"))))
    hit = laid.join(gaps, "_day").where(overlap(F.col("_s"), F.col("_e"), F.col("_gs"), F.col("_ge"))).select("_k").distinct().withColumn("_hit", F.lit(True))
    return numbered.withColumn("_k", key).join(hit, "_k", "left").withColumn("spans_outage", F.coalesce("_hit", F.lit(False))).drop("_k", "_hit", "_end")


def define_failures(found: DataFrame, parts: list[dict], data_end: Column) -> DataFrame:
    """Failures of one definition: the union of parts, each a filter over episodes.

    A part has predicate, hours, and optionally close_in, close_not_in, keep_open and where (a Column).
    """
    out = None
    for p in parts:
        rows = found.where(F.col("predicate") == p["predicate"])
        length = seconds(F.coalesce("ended_at", data_end), F.col("started_at"))
        rows = rows.where(length > p.get("hours", 0) * 3600)
        if not p.get("keep_open", True):
            rows = rows.where(F.col("ended_at").isNotNull())
        if p.get("close_in"):
            rows = rows.where(F.col("closed_by").isin(*p["close_in"]))
        if p.get("close_not_in"):
            rows = rows.where(F.col("closed_by").isNull() | ~F.col("closed_by").isin(*p["close_not_in"]))
        if p.get("where") is not None:
            rows = rows.where(p["where"])
        out = rows if out is None else out.unionByName(rows)
    return out


def bursts(found: DataFrame, k: int, max_seconds: float, channel: str = "channel_id") -> DataFrame:
    """Start of the k-th short closed episode of a channel in a calendar day."""
    short = found.where(F.col("ended_at").isNotNull() & (seconds(F.col("ended_at"), F.col("started_at")) <= max_seconds))
    day = F.to_date("started_at")
    place = F.row_number().over(Window.partitionBy(channel, day).orderBy("started_at"))
    return short.withColumn("place", place).where(F.col("place") == k).select(channel, "started_at", day.alias("day"))


def group_key(node: Column, channel: Column) -> Column:
    """The node's group, or the channel's own: channels without node never share a group."""
    return F.coalesce(F.concat(F.lit("obj:"), node.cast("string")), F.concat(F.lit("ch:"), channel.cast("string")))


def merge_incidents(events: DataFrame, group: str, time: str, minutes: float) -> DataFrame:
    """Events within ``minutes`` (inclusive) of the one before in their group are one incident: (group, first_at, last_at, events)."""
    w = Window.partitionBy(group).orderBy(time)
    fresh = F.coalesce((seconds(F.col(time), F.lag(time).over(w)) > minutes * 60).cast("int"), F.lit(1))
    run = F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.withColumn("_fresh", fresh).withColumn("_run", run)
    return rows.groupBy(group, "_run").agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count("*").alias("events")).drop("_run")


def seal(found: DataFrame, at: Column) -> DataFrame:
    """Episodes as known at a seal: later starts go, later ends are not known yet."""
    end = F.when(F.col("ended_at") <= at, F.col("ended_at"))
    return found.where(F.col("started_at") <= at).withColumn("ended_at", end)


def confirmed(start: Column, at: Column, confirm_seconds: int = 3601) -> Column:
    """A failure is confirmed once start + confirm_seconds <= at."""
    return F.coalesce(seconds(at, start) >= confirm_seconds, F.lit(False))


def episode_diagnostics(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    return found.groupBy(*(by or [])).agg(
        F.count("*").alias("episodes"),
        F.count_distinct("channel_id").alias("channels"),
        F.count_if(F.col("ended_at").isNull()).alias("open"),
    )


def reconcile(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of a value by key: (key, actual, expected, ok); what one side lacks counts as 0."""
    a, e = actual.select(key, F.col(value).alias("actual")), expected.select(key, F.col(value).alias("expected"))
    both = a.join(e, key, "full_outer").select(key, F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.withColumn("ok", F.col("actual") == F.col("expected"))


def chart_episodes(found: DataFrame, low: Column, high: Column, min_seconds: float = 3600) -> DataFrame:
    """Episodes that start within a chart's window, cut at its end, longer than the minimum."""
    end = F.least(F.coalesce("ended_at", high), high)
    rows = found.where((F.col("started_at") >= low) & (F.col("started_at") < high)).withColumn("shown_until", end)
    return rows.where(seconds(F.col("shown_until"), F.col("started_at")) > min_seconds)


def collapse_repeats(rows: DataFrame, key: str, order: list[str], same: list[str]) -> DataFrame:
    """Neighbouring rows equal in ``same`` become one: its first row and the number of repeats."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = ~F.lit(True)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    fresh = ((F.row_number().over(w) == 1) | changed).cast("int")
    run = F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_fresh", fresh).withColumn("_run", run)
    at = F.struct(*order)
    firsts = [F.min_by(c, at).alias(c) for c in [*order, *same]]
    return rows.groupBy(key, "_run").agg(*firsts, F.count("*").alias("repeats")).drop("_run")
