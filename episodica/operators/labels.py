"""Labels, decision moments and history features that never look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running
from ..functions.scalar import hash_uniform, seconds


def censored(failures: DataFrame, data_end: Column) -> DataFrame:
    """Failures with open ends closed at the data's end and marked."""
    return failures.withColumn("censored", F.col("ended_at").isNull()).withColumn("ended_at", F.coalesce("ended_at", data_end))


def day_labels(counted: DataFrame, day: str, data_end: Column, high_hours: int = 168) -> DataFrame:
    """label (an event ahead), null and censored where the horizon passes the data's end without one."""
    horizon = F.timestamp_add("HOUR", F.lit(24 + high_hours), F.col(day).cast("timestamp"))
    known = horizon <= data_end.cast("timestamp")
    return counted.withColumn("censored", ~known).withColumn("label", F.when(F.col("events") > 0, 1).when(known, 0))


def moments(days: DataFrame, incidents: DataFrame, key: str, confirm_hours: int = 1) -> DataFrame:
    """(key, moment, kind, feature_day): a tick at the end of each day, a rearm an hour after each incident."""
    tick = days.select(key, F.timestamp_add("DAY", F.lit(1), F.col("day").cast("timestamp")).alias("moment"), F.lit("tick").alias("kind"), F.col("day").alias("feature_day"))
    at = F.timestamp_add("HOUR", F.lit(confirm_hours), F.col("first_at").cast("timestamp"))
    rearm = incidents.select(key, at.alias("moment"), F.lit("rearm").alias("kind"), F.date_sub(F.to_date(at), 1).alias("feature_day"))
    return tick.unionByName(rearm)


def horizon_labels(moments_: DataFrame, events: DataFrame, key: str, event_time: str, hours: float) -> DataFrame:
    """label 1 if an event falls in (moment, moment + hours]; an event exactly at the moment does not count."""
    at = F.unix_micros(F.col("moment").cast("timestamp"))
    stacked = moments_.withColumn("_us", at).unionByName(
        events.select(key, F.unix_micros(F.col(event_time).cast("timestamp")).alias("_us"), F.lit(1).alias("_event")), allowMissingColumns=True
    )
    if "_event" not in stacked.columns:
        return moments_.withColumn("label", F.lit(0))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(1, int(hours * 3.6e9))
    return stacked.withColumn("label", F.coalesce(F.max("_event").over(w), F.lit(0))).where("_event is null").drop("_event", "_us")


def counts_at(pairs: DataFrame, events: DataFrame, key: str, event_time: str, days: dict[str, int]) -> DataFrame:
    """(key, _t, counts) of distinct (key, _t in microseconds): events of the key in (_t - n days, _t], the running count at _t less that at _t - n days."""
    spans = {name: int(n * 86400e6) for name, n in days.items()}
    asked = pairs.select(key, "_t", F.explode(F.array(*[F.lit(x).cast("long") for x in sorted({0, *spans.values()})])).alias("_span")).withColumn("_us", F.col("_t") - F.col("_span"))
    marks = events.where(F.col(key).isNotNull() & F.col(event_time).isNotNull()).select(key, F.unix_micros(F.col(event_time).cast("timestamp")).alias("_us"), F.lit(1).alias("_n"))
    found = asked.join(running(asked.select(key, "_us").distinct(), marks, key, ("_n",)), [key, "_us"])
    at = lambda span: F.max(F.when(F.col("_span") == span, F.col("_n")))
    return found.groupBy(key, "_t").agg(*[(at(0) - at(x)).alias(name) for name, x in spans.items()])


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col("_t").isNotNull()).select(key, "_t").distinct()


def trailing_counts(rows: DataFrame, events: DataFrame, key: str, time: str, event_time: str, days: dict[str, int]) -> DataFrame:
    """Events of the key in (t - n days, t] for each n; each (key, t) is asked once, however many rows have it."""
    known = rows.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    out = known.join(counts_at(_pairs(known, key), events, key, event_time, days), [key, "_t"], "left")
    return out.select(*rows.columns, *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in days])


def last_event_hours(rows: DataFrame, events: DataFrame, key: str, time: str, event_time: str, into: str = "hours") -> DataFrame:
    """Hours since the latest event of the key at or before t, null without one."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    stacked = rows.withColumn("_us", us).withColumn("_event", F.lit(None).cast("bigint"))
    e = F.unix_micros(F.col(event_time).cast("timestamp"))
    stacked = stacked.unionByName(events.select(key, e.alias("_us"), e.alias("_event"), F.lit(True).alias("_is")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    return stacked.withColumn(into, (F.col("_us") - F.max("_event").over(w)) / 3.6e9).where("_is is null").drop("_event", "_us", "_is")


def history_features(rows: DataFrame, failures: DataFrame, near: DataFrame, *, key: str = "channel_id", time: str = "t", start: str = "started_at") -> DataFrame:
    """fresh, decays and log counts of the channel's failures, and its neighbours' counts over 7 days without its own.

    ``near`` has (channel_id, picket, collector).
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    known = rows.withColumn("_t", at)
    counts = counts_at(_pairs(known, key), failures, key, start, {"_n7": 7, "_n30": 30, "_n90": 90})
    out = last_event_hours(rows, failures, key, time, start, "_hours").withColumn("_t", at).join(counts, [key, "_t"], "left").join(near, key, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_n7", "_n30", "_n90")})
    for group in ("picket", "collector"):
        # a neighbourhood is asked once for each moment, however many channels it has
        there = near.select(key, group)
        around = counts_at(_pairs(known.join(there, key), group), failures.select(key, start).join(there, key), group, start, {f"_{group}": 7})
        out = out.join(around, [group, "_t"], "left")
        out = out.withColumn(f"near_{group}_7d", F.when(F.col(group).isNull(), 0).otherwise(F.coalesce(f"_{group}", F.lit(0)) - F.col("_n7"))).drop(f"_{group}")
    days = F.col("_hours") / 24
    out = out.withColumns({
        "fresh": F.coalesce((F.col("_hours") < 24).cast("int"), F.lit(0)),
        "decay_1": F.coalesce(F.exp(-days), F.lit(0.0)), "decay_30": F.coalesce(F.exp(-days / 30), F.lit(0.0)),
        "log_7": F.log1p("_n7"), "log_30": F.log1p("_n30"), "log_90": F.log1p("_n90"),
    })
    return out.drop("_t", "_hours", "_n7", "_n30", "_n90")


def passport_features(rows: DataFrame, at: str, in_service: str, life_years: str, last_check: str, check_days: int) -> DataFrame:
    """Share of life used (at most 2), share of the check interval (at most 3) and whether the check is overdue."""
    age = F.datediff(at, in_service) / 365.25
    ratio = F.datediff(at, last_check) / F.lit(float(check_days))
    return rows.withColumns({"life_share": F.least(F.lit(2.0), age / F.nullif(life_years, F.lit(0))), "check_ratio": F.least(F.lit(3.0), ratio), "overdue": (ratio > 1).cast("int")})


def precursor_bins(rows: DataFrame, precursors: DataFrame, key: str, time: str) -> DataFrame:
    """Precursors of the key by age in days: [0,1), [1,2), [2,3), [3,5)."""
    cum = trailing_counts(rows, precursors, key, time, "t_precursor", {"_1": 1, "_2": 2, "_3": 3, "_5": 5})
    return cum.withColumns({"pre_0_1": F.col("_1"), "pre_1_2": F.col("_2") - F.col("_1"), "pre_2_3": F.col("_3") - F.col("_2"), "pre_3_5": F.col("_5") - F.col("_3")}).drop("_1", "_2", "_3", "_5")


def pending_precursor(rows: DataFrame, precursors: DataFrame, key: str, time: str, pf_days: float) -> DataFrame:
    """Earliest precursor p <= t < p + pf: ``precursor_at`` and ``due_seconds``."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    p = F.unix_micros(F.col("t_precursor").cast("timestamp"))
    stacked = rows.withColumn("_us", us).unionByName(precursors.select(key, p.alias("_us"), p.alias("_p")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-int(pf_days * 86400e6) + 1, 0)
    out = stacked.withColumn("_first", F.min("_p").over(w)).where("_p is null")
    due = (F.col("_first") + int(pf_days * 86400e6) - F.col("_us")) / 1e6
    return out.withColumns({"precursor_at": F.timestamp_micros("_first"), "due_seconds": due}).drop("_p", "_us", "_first")


def time_split(moment: Column, train_to: str, valid_to: str, test_to: str) -> Column:
    at = moment.cast("timestamp")
    return F.when(at < F.lit(train_to).cast("timestamp"), "train").when(at < F.lit(valid_to).cast("timestamp"), "valid").when(at < F.lit(test_to).cast("timestamp"), "test")


def thin_negatives(rows: DataFrame, label: str, share: float, *keys: str) -> DataFrame:
    """All positives and a fixed share of negatives by a hash of the keys, with the weights that undo it."""
    keep = (F.col(label) == 1) | (hash_uniform(*[F.col(k) for k in keys]) < share)
    return rows.where(keep).withColumn("weight", F.when(F.col(label) == 1, 1.0).otherwise(1.0 / share))


def one_hot(rows: DataFrame, col: str, values: list[str], prefix: str = "is_") -> DataFrame:
    return rows.withColumns({f"{prefix}{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values})


def gap_share(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Shortest gap between repeats of a key, in minutes."""
    w = Window.partitionBy(key).orderBy(time)
    return rows.withColumn("_g", seconds(F.col(time), F.lag(time).over(w)) / 60).groupBy(key).agg(F.min("_g").alias("shortest_gap"))


def thin_repeats(rows: DataFrame, key: str, time: str, minutes: float) -> DataFrame:
    """Keep a key's first alert and those at least ``minutes`` after the last one kept: a fold over its sorted times.

    Alerts of one key are few by nature (they are raised per decision), so a key's times fit an array.
    """
    step = int(minutes * 60e6)
    times = rows.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_us")).groupBy(key).agg(F.array_sort(F.collect_set("_us")).alias("_all"))
    start = F.array().cast("array<bigint>")
    kept = F.aggregate("_all", start, lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) >= step), F.array_append(a, t)).otherwise(a))
    return times.select(key, F.explode(kept).alias("_us")).select(key, F.timestamp_micros("_us").alias(time))
