"""Work permits: actual windows, load of hot work, features around an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import running
from ..functions.scalar import clip_seconds, overlap

#: Permits of a location are many, so its pieces are short.
PIECE_US = 900_000_000


def actual_windows(permits: DataFrame, log: DataFrame) -> DataFrame:
    """Start of work and its end by status, else as planned; an extension moves the planned end."""
    marks = log.groupBy("permit_id").agg(
        F.min(F.when(F.col("to_status") == "in work", F.col("changed_at"))).alias("began"), F.max(F.when(F.col("to_status") == "done", F.col("changed_at"))).alias("ended")
    )
    out = permits.join(marks, "permit_id", "left")
    planned_end = F.greatest("valid_to", F.col("extended_to")) if "extended_to" in permits.columns else F.col("valid_to")
    return out.withColumns({"actual_from": F.coalesce("began", "valid_from"), "actual_to": F.coalesce("ended", planned_end)}).drop("began", "ended")


def hotwork_load(permits: DataFrame, low: Column, high: Column, by: str = "location_id") -> DataFrame:
    """Permits, man-hours within the window (crew of one at least), welding jobs and days since the last one."""
    hours = clip_seconds(F.col("actual_from"), F.col("actual_to"), low, high) / 3600 * F.greatest(F.coalesce("crew", F.lit(1)), F.lit(1))
    hit = permits.where(overlap(F.col("actual_from"), F.col("actual_to"), low, high))
    return hit.groupBy(by).agg(F.count("*").alias("permits"), F.sum(hours).alias("man_hours"), F.count_if(F.col("work_type") == "welding").alias("welding"), (F.datediff(F.to_date(high), F.to_date(F.max("actual_to")))).alias("days_since"))


def permit_features(events: DataFrame, permits: DataFrame, *, hot: tuple[str, ...] = ("welding", "cutting"), days: int = 1) -> DataFrame:
    """Work around each (event_id, location_id, t): hot work now, within 30 minutes and 4 hours, next door, by type, crews.

    No event meets a permit: a permit adds one to a running count of its own and its adjacent location where it
    begins and takes it off the microsecond after its end (and half an hour and four hours later), and an event reads the
    counts at its moment.  Permits that no event can see are left out before.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    minute = 60_000_000
    known = events.select("event_id", "location_id", us("t").alias("_us")).where("location_id is not null and _us is not null")
    seen = known.agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))  # one row
    p = permits.select("location_id", "adjacent_location_id", "work_type", F.coalesce("crew", F.lit(1)).cast("long").alias("crew"), us("actual_from").alias("a"), us("actual_to").alias("b"))
    p = p.join(F.broadcast(seen)).where(F.col("a").isNotNull() & (F.col("a") <= F.col("_last")) & (F.col("b") >= F.col("_first") - days * 1440 * minute))
    fire = F.coalesce(F.col("work_type").isin(*hot), F.lit(False))
    counts = ("hot_now", "hot_30m", "hot_4h", "hot_adjacent", "now", "gas_now", "excavation_now", "electric_now", "crew_now")
    kinds = ("gas", "excavation", "electric")

    def spans(own: bool) -> list[tuple[int, dict]]:
        """Minutes that an interval is longer than its permit, and what each counts."""
        if not own:
            return [(0, {"hot_adjacent": fire})]
        kind = {f"{k}_now": F.coalesce(F.col("work_type") == k, F.lit(False)) for k in kinds}
        # what is hours past counts within the days alone
        return [(0, {"hot_now": fire, "now": F.lit(True), "crew_now": F.col("crew"), **kind}), (min(30, days * 1440), {"hot_30m": fire}), (min(240, days * 1440), {"hot_4h": fire})]

    def marks(own: bool) -> DataFrame:
        each = []
        for longer, what in spans(own):
            end = F.col("b") + longer * minute
            for at, sign in ((F.col("a"), 1), (end + 1, -1)):
                value = [(what[c].cast("long") * sign if c in what else F.lit(None).cast("long")).alias(c) for c in counts]
                # an interval that ends before it begins holds no moment
                each.append(F.when(F.col("a") <= end, F.struct(at.alias("_us"), *value, F.lit(None).cast("long").alias("until"))))
        if own:
            each.append(F.struct(F.col("a").alias("_us"), *[F.lit(None).cast("long").alias(c) for c in counts], F.col("b").alias("until")))
        laid = p.select(F.col("location_id" if own else "adjacent_location_id").alias("location_id"), "_last", F.explode(F.array(*each)).alias("m")).where("location_id is not null and m is not null")
        return laid.select("location_id", "_last", "m.*").where("_us <= _last").drop("_last")

    both = marks(True).unionByName(marks(False))
    found = running(known.select("location_id", "_us").distinct(), both, "location_id", counts, ("until",), PIECE_US)
    met = known.join(found, ["location_id", "_us"])
    since = F.when(F.col("until").isNotNull(), F.greatest(F.lit(0.0), (F.col("_us") - F.col("until")) / 6e7))
    out = met.groupBy("event_id").agg(
        *[F.bool_or(F.col(c) > 0).alias(c) for c in ("hot_now", "hot_30m", "hot_4h", "hot_adjacent")], F.bool_or(F.col("now") > 0).alias("any_now"),
        *[F.bool_or(F.col(f"{k}_now") > 0).alias(f"{k}_now") for k in kinds],
        F.sum("now").alias("permits_now"), F.sum(F.when(F.col("now") > 0, F.col("crew_now"))).alias("crew_now"), F.min(F.when(since <= days * 1440, since)).alias("minutes_since"),
    )
    flags = ["hot_now", "hot_30m", "hot_4h", "hot_adjacent", "any_now", "gas_now", "excavation_now", "electric_now"]
    full = events.select("event_id").join(out, "event_id", "left")
    return full.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {c: F.coalesce(c, F.lit(0)) for c in ("permits_now", "crew_now")})


def open_permits(permits: DataFrame, at: Column) -> DataFrame:
    return permits.where((F.col("valid_from") <= at) & (F.col("valid_to") >= at)).select("section_id").distinct()
