"""Daily rollups, counters with exact edges, grids and calendar windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import on_days
from ..functions.scalar import seconds


def section_daily(journal: DataFrame, channels: DataFrame, systems: list[str]) -> DataFrame:
    """Rows, alarms, alarms by system, active and silent channels and the highest value, by section and day."""
    listed = channels.where("section_id is not null").groupBy("section_id").agg(F.count("*").alias("listed"))
    typed = journal.join(channels.select("channel_id", "system_kind"), "channel_id", "left")
    by = [F.count_if(F.col("is_alarm") & (F.col("system_kind") == s)).alias(f"alarms_{s}") for s in systems]
    out = typed.where("section_id is not null").groupBy("section_id", F.to_date("read_time").alias("day")).agg(
        F.count("*").alias("total"), F.count_if("is_alarm").alias("alarms"), *by,
        F.count_distinct("channel_id").alias("active"), F.max("value_num").alias("max_value"),
    )
    silent = F.greatest(F.lit(0), F.coalesce("listed", F.lit(0)) - F.col("active"))
    return out.join(listed, "section_id", "left").withColumn("silent", silent).drop("listed")


def channel_daily(journal: DataFrame, bad: Column, undefined: Column) -> DataFrame:
    return journal.groupBy("channel_id", F.to_date("read_time").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(bad).alias("faults"), F.count_if(undefined).alias("undefined"), F.max("read_time").alias("last_read")
    )


def channel_day(journal: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Counters of a channel's day: rows, each flag, distinct values, numeric rows and the last number by (time, id)."""
    at = F.struct("read_time", "journal_id")
    number = F.col("value_num")
    return journal.groupBy("channel_id", F.to_date("read_time").alias("day")).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in flags.items()],
        F.count_distinct("value_text").alias("n_values"), F.count_if(number.isNotNull()).alias("n_numeric"),
        F.max_by(number, F.when(number.isNotNull(), at)).alias("last_number"),
    )


def prefix_day(channel_days: DataFrame, prefixes: DataFrame, counters: list[str]) -> DataFrame:
    """A channel-day table one level up: rows, active channels, channels with any bad row, summed counters, listed channels."""
    listed = prefixes.groupBy("prefix").agg(F.count("*").alias("listed"))
    out = channel_days.join(prefixes.select("channel_id", "prefix"), "channel_id").groupBy("prefix", "day").agg(
        F.sum("n").alias("n"), F.count("*").alias("active"), F.count_if(F.col("n_bad") > 0).alias("channels_bad"), *[F.sum(c).alias(c) for c in counters]
    )
    return out.join(listed, "prefix", "left")


def calendar(days: DataFrame, first: str, last: str, split: Column, share: float = 0.1) -> DataFrame:
    """Every day from first to last: fleet rows, outage (below a share of its year's median), split; outages leave train."""
    every = days.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    fleet = days.groupBy("day").agg(F.sum("n").alias("rows"))
    full = every.join(fleet, "day", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    median = full.groupBy(F.year("day").alias("_year")).agg(F.percentile("rows", F.lit(0.5)).alias("_median"))
    out = full.withColumn("_year", F.year("day")).join(median, "_year").withColumn("outage", F.col("rows") < share * F.col("_median"))
    label = F.when(F.col("outage") & (split == "train"), F.lit(None).cast("string")).otherwise(split)
    return out.withColumn("split", label).drop("_year", "_median")


def window_counts(days: DataFrame, key: str, at: Column, value: str, spans: tuple[int, ...]) -> DataFrame:
    """Sums of a daily value over the last n days ending at ``at`` (inclusive), and the last day seen."""
    age = F.datediff(at, F.col("day"))
    sums = [F.sum(F.when(age.between(0, n - 1), F.col(value)).otherwise(0)).alias(f"last_{n}") for n in spans]
    return days.where(age >= 0).groupBy(key).agg(*sums, F.max("day").alias("last_day"))


def exact_counts(days: DataFrame, journal: DataFrame, key: str, at: Column, spans: tuple[int, ...], time: str = "read_time", value: str = "total", partition: str | None = None) -> DataFrame:
    """Rows in (at - n days, at] for each n: whole days from the rollup, the cut days at both ends from raw rows.

    ``at`` is a timestamp literal.  Of the journal only the cut days are read: they are literal ranges on ``time``,
    which the files' statistics answer, and on ``partition``, the journal's day column, where there is one.
    """
    edge = lambda n: F.to_timestamp(at - F.expr(f"INTERVAL {n} DAYS"))
    whole = [F.sum(F.when((F.col("day") > F.to_date(edge(n))) & (F.col("day") < F.to_date(at)), F.col(value)).otherwise(0)).alias(f"last_{n}") for n in spans]
    from_days = days.where((F.col("day") > F.to_date(edge(max(spans)))) & (F.col("day") < F.to_date(at))).groupBy(key).agg(*whole)
    moment = F.col(time)
    raw = journal.where(on_days(time, [F.to_date(at), *[F.to_date(edge(n)) for n in spans]], partition))
    own = lambda n: on_days(time, [F.to_date(edge(n)), F.to_date(at)])
    parts = [F.count_if((moment > edge(n)) & (moment <= at) & own(n)).alias(f"last_{n}") for n in spans]
    from_rows = raw.groupBy(key).agg(*parts)
    return from_days.unionByName(from_rows).groupBy(key).agg(*[F.sum(f"last_{n}").alias(f"last_{n}") for n in spans])


def gap_statistics(journal: DataFrame, key: str = "channel_id", time: str = "read_time", row_id: str = "journal_id", least: int = 20, recent_from: Column | None = None) -> DataFrame:
    """Gaps between a channel's rows: count, median (0 is null), p95, longest recent one, share above p95 (null below ``least``)."""
    w = Window.partitionBy(key).orderBy(time, row_id)
    gaps = journal.withColumn("gap", seconds(F.col(time), F.lag(time).over(w))).where("gap is not null")
    recent = F.col(time) >= recent_from if recent_from is not None else F.lit(True)
    out = gaps.groupBy(key).agg(
        F.count("*").alias("gaps"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.percentile("gap", F.lit(0.95)).alias("p95_gap"),
        F.max(F.when(recent, F.col("gap"))).alias("max_gap"),
    )
    # the same partitioning by key serves both: long gaps are counted, not collected
    long_ = gaps.join(out.select(key, "p95_gap"), key).groupBy(key).agg(F.count_if(F.col("gap") > F.col("p95_gap")).alias("_long"))
    out = out.join(long_, key, "left").withColumn("long_share", F.when(F.col("gaps") >= least, F.col("_long") / F.col("gaps")))
    return out.withColumn("median_gap", F.nullif("median_gap", F.lit(0.0))).drop("_long")


def frozen(journal: DataFrame, key: str = "channel_id", time: str = "read_time", row_id: str = "journal_id", value: str = "value_num") -> DataFrame:
    """Whether three values in a row were equal; null with fewer than two gaps."""
    w = Window.partitionBy(key).orderBy(time, row_id)
    same = (F.col(value) == F.lag(value, 1).over(w)) & (F.col(value) == F.lag(value, 2).over(w))
    rows = journal.select(key, same.alias("same"))
    return rows.groupBy(key).agg(F.when(F.count("*") > 2, F.coalesce(F.bool_or("same"), F.lit(False))).alias("frozen"))


def dense_grid(days: DataFrame, key: str, counters: list[str], tail: int = 364, last: Column | None = None, alive_within: int = 365) -> DataFrame:
    """Every day of a key from its first to its last + ``tail`` (or to ``last``), counters zero-filled; days out of reach of a record go."""
    end = last if last is not None else F.date_add(F.max("day"), tail)
    spans = days.groupBy(key).agg(F.min("day").alias("_from"), end.alias("_to"))
    grid = spans.select(key, F.explode(F.sequence("_from", "_to")).alias("day")).join(days, [key, "day"], "left")
    w = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col(counters[0]).isNotNull(), F.col("day")), ignorenulls=True).over(w)
    out = grid.withColumn("days_since_record", F.datediff("day", seen))
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counters})
    return out.where(F.col("days_since_record") <= alive_within)


def calendar_sums(grid: DataFrame, key: str, values: list[str], spans: tuple[int, ...]) -> DataFrame:
    """Sums over the last n calendar days ending at each day, whatever days are missing."""
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    out = grid.withColumn("_d", number)
    w = Window.partitionBy(key).orderBy("_d")
    sums = {f"{v}_{n}": F.sum(v).over(w.rangeBetween(-(n - 1), 0)) for v in values for n in spans}
    return out.withColumns(sums).drop("_d")


def days_since(grid: DataFrame, key: str, condition: Column, into: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.withColumn(into, F.datediff("day", F.last(F.when(condition, F.col("day")), ignorenulls=True).over(w)))


def channel_health(grid: DataFrame, key: str, group: str) -> DataFrame:
    """By group and day: alive channels, dying ones (a week below 0.3 of the year's pace), longest since a bad row and since a record."""
    sums = days_since(calendar_sums(grid, key, ["n"], (7, 365)), key, F.col("n_bad") > 0, "since_bad")
    dying = 52 * F.col("n_7") < 0.3 * F.col("n_365")
    return sums.groupBy(group, "day").agg(F.count("*").alias("alive"), F.count_if(dying).alias("dying"), F.max("since_bad").alias("max_since_bad"), F.max("days_since_record").alias("max_since_record"))


def active_over_days(days: DataFrame, key: str, group: str, span: int = 7) -> DataFrame:
    """Distinct keys seen by a group over the trailing days: each record counts for the days it reaches."""
    reach = F.explode(F.sequence("day", F.date_add("day", span - 1)))
    return days.select(group, key, reach.alias("day")).groupBy(group, "day").agg(F.count_distinct(key).alias("active"))


def methane_daily(rows: DataFrame, quality: Column, number: Column) -> DataFrame:
    """A channel's methane day: rows by quality, mean, highest, rows of 1 or more, and the day it may be used from."""
    valid = F.when(quality == "valid", number)
    counts = [F.count_if(quality == q).alias(f"n_{q}") for q in ("valid", "negative", "above", "nonfinite", "text")]
    out = rows.groupBy("day", "channel_id").agg(F.count("*").alias("n"), *counts, F.avg(valid).alias("mean"), F.max(valid).alias("max"), F.count_if(valid >= 1).alias("n_high"))
    return out.withColumn("available_at", F.date_add("day", 1))


def calibration_days(methane: DataFrame, least: int = 10) -> DataFrame:
    """Mark the days on which at least so many channels reached 1: ``calibration``."""
    days = methane.where("n_high > 0").groupBy("day").agg(F.count_distinct("channel_id").alias("_n")).where(F.col("_n") >= least)
    return methane.join(days.select("day", F.lit(True).alias("calibration")), "day", "left").withColumn("calibration", F.coalesce("calibration", F.lit(False)))
