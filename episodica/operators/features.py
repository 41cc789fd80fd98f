"""The section feature vector: 22 features with nulls kept, folded from channels by the worst one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import seconds

NAMES = (
    "readings_1d", "readings_7d", "readings_30d", "readings_365d", "alarms_7d", "alarms_365d", "days_since_reading", "channels", "silent_share_30d", "chatter_7d", "failed_30d", "freeze_3",
    "undefined_share_7d", "rate_ratio_7d", "rate_ratio_year", "gap_to_median", "long_gap_share_7d", "silence_normalized", "collector_failed_7d", "collector_chatter_7d", "season_sin", "season_cos",
)


def channel_counters(journal: DataFrame, at: Column, bad: Column, undefined: Column) -> DataFrame:
    """Rows of the last 7, 30, 56 (of the 63 before the week), 365 days, bad and undefined ones of the week, last reading."""
    age = seconds(at, F.col("read_time")) / 86400
    rows = journal.where(age >= 0)
    n = lambda c: F.count_if(c)
    return rows.groupBy("channel_id").agg(
        n(age < 7).alias("n7"), n(age < 30).alias("n30"), n((age >= 7) & (age < 63)).alias("n8w"), n(age < 365).alias("n365"),
        n((age < 7) & bad).alias("chatter7"), n((age < 7) & undefined).alias("undefined7"), F.max("read_time").alias("last_read"),
    )


def section_features(section_counts: DataFrame, counters: DataFrame, gaps: DataFrame, freeze: DataFrame, channels: DataFrame, failures: DataFrame | None, at: Column, day_of_year: int) -> DataFrame:
    """One row per section: ``section_id`` and the features by name.

    section_counts: section_id, readings_1d .. alarms_365d, last_day.  gaps: channel_id, median_gap,
    max_gap (7 days), gaps (7 days), long_share.  failures None means that none were computed, which is not
    the same as none: its features are null.  Sums and joins are on small per-channel tables.
    """
    c = counters.join(channels.select("channel_id", "section_id", "collector"), "channel_id").join(gaps, "channel_id", "left").join(freeze, "channel_id", "left")
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    pause = seconds(at, F.col("last_read"))
    c = c.withColumns({
        "u": share(F.col("undefined7"), F.col("n7")), "r7": share(F.col("n7"), F.col("n8w") / 8), "ry": share(F.col("n7"), F.col("n365") / 52),
        "gm": F.col("max_gap") / F.col("median_gap"), "sn": pause / F.col("median_gap"),
    })
    worst = c.groupBy("section_id").agg(
        F.min("collector").alias("collector"), F.count_if(F.col("n30") > 0).alias("_wrote"), F.max("chatter7").alias("chatter_7d"), F.max(F.col("frozen").cast("double")).alias("freeze_3"), F.max("u").alias("undefined_share_7d"),
        F.min("r7").alias("rate_ratio_7d"), F.min("ry").alias("rate_ratio_year"), F.max("gm").alias("gap_to_median"), F.max("long_share").alias("long_gap_share_7d"), F.max("sn").alias("silence_normalized"),
    )
    by_collector = c.groupBy("collector").agg(F.sum("chatter7").alias("collector_chatter_7d")).where("collector is not null")
    listed = channels.where("section_id is not null").groupBy("section_id").agg(F.count("*").alias("channels"))
    every = section_counts.select("section_id").unionByName(listed.select("section_id")).unionByName(worst.select("section_id")).where("section_id is not null").distinct()
    out = every.join(section_counts, "section_id", "left").join(worst, "section_id", "left").join(listed, "section_id", "left").join(by_collector, "collector", "left")
    if failures is None:
        out = out.withColumns({"failed_30d": F.lit(None).cast("double"), "collector_failed_7d": F.lit(None).cast("double")})
    else:
        age = seconds(at, F.col("started_at")) / 86400
        recent = failures.where((age >= 0) & (age < 30))
        f30 = recent.groupBy("section_id").agg(F.lit(1.0).alias("failed_30d"))
        f7 = recent.where(age < 7).join(channels.select("channel_id", "collector"), "channel_id").where("collector is not null").groupBy("collector").agg(F.lit(1.0).alias("collector_failed_7d"))
        out = out.join(f30, "section_id", "left").join(f7, "collector", "left").withColumns({"failed_30d": F.coalesce("failed_30d", F.lit(0.0)), "collector_failed_7d": F.coalesce("collector_failed_7d", F.lit(0.0))})
    zero = {n: F.coalesce(F.col(n), F.lit(0)).cast("double") for n in ("readings_1d", "readings_7d", "readings_30d", "readings_365d", "alarms_7d", "alarms_365d")}
    turn = 2 * math.pi * day_of_year / 365.25
    silent = share(F.greatest(F.lit(0), F.col("channels") - F.coalesce("_wrote", F.lit(0))), F.col("channels"))
    out = out.withColumns(zero | {"days_since_reading": F.datediff(F.to_date(at), F.col("last_day")).cast("double"), "silent_share_30d": silent, "season_sin": F.lit(math.sin(turn)), "season_cos": F.lit(math.cos(turn))})
    return out.select("section_id", *[F.col(n).cast("double").alias(n) for n in NAMES])


def activity_ratios(days: DataFrame) -> DataFrame:
    """The four shares of a prefix-day: channels active on the day and in the week over all, and the pace of a week and of four weeks over the year's.

    ``days`` has n_active_ch, act_ch_7d, n_ch_total and rows of 7, 28 and 365 days; an empty base gives null.
    """
    share = lambda a, b, times=1.0: times * F.col(a) / F.nullif(F.col(b), F.lit(0))
    return days.withColumns({
        "act_share_1d": share("n_active_ch", "n_ch_total"), "act_share_7d": share("act_ch_7d", "n_ch_total"),
        "rate_7d": share("n_rows_7d", "n_rows_365d", 52.0), "rate_28d": share("n_rows_28d", "n_rows_365d", 13.0),
    })
