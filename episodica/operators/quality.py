"""Table-level checks: each returns the offending rows, or one row of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import seconds


def overlapping(intervals: DataFrame, key: str, start: str = "started_at", end: str = "ended_at") -> DataFrame:
    """Intervals that a later one of their key starts within; an open end overlaps whatever follows."""
    w = Window.partitionBy(key).orderBy(start)
    later = F.lead(start).over(w)
    return intervals.withColumn("_n", later).where(F.col("_n").isNotNull() & (F.col(end).isNull() | (F.col("_n") < F.col(end)))).drop("_n")


def bad_episodes(found: DataFrame, min_seconds: float) -> DataFrame:
    closed = F.col("ended_at").isNotNull()
    same = closed & (F.col("closed_by") == F.col("fault_value"))
    return found.where(same | (closed & (seconds(F.col("ended_at"), F.col("started_at")) <= min_seconds)))


def sums_off(rows: DataFrame, by: str, value: str, want: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    return rows.groupBy(by).agg(F.sum(value).alias("total")).where(F.abs(F.col("total") - want) > tolerance)


def nesting_broken(rows: DataFrame, ordered: list[str], shares: list[str]) -> DataFrame:
    """Rows whose window counts do not nest, or whose shares leave [0, 1]."""
    broken = F.lit(False)
    for a, b in zip(ordered, ordered[1:]):
        broken = broken | (F.col(a) > F.col(b))
    for s in shares:
        broken = broken | F.coalesce(~F.col(s).between(0, 1), F.lit(False))
    return rows.where(broken)


def mismatched(fact: DataFrame, dimension: DataFrame, key: str, col: str) -> DataFrame:
    return fact.join(dimension.select(key, F.col(col).alias("_d")), key).where(~F.col(col).eqNullSafe(F.col("_d"))).drop("_d")


def missing_months(rows: DataFrame, day: str) -> DataFrame:
    """Months between the first and the last without rows."""
    have = rows.select(F.trunc(day, "month").alias("month")).distinct()
    every = have.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return every.select(F.to_date("month").alias("month")).join(have, "month", "left_anti")


def coverage_days(a: DataFrame, b: DataFrame, day: str = "day") -> DataFrame:
    """Distinct days on each side and in common; ``ok`` needs both to have some."""
    x, y = a.select(day).distinct().withColumn("_a", F.lit(1)), b.select(day).distinct().withColumn("_b", F.lit(1))
    out = x.join(y, day, "full_outer").agg(F.count("_a").alias("days_a"), F.count("_b").alias("days_b"), F.count(F.when(F.col("_a") == F.col("_b"), 1)).alias("common"))
    return out.withColumn("ok", (F.col("days_a") > 0) & (F.col("days_b") > 0))


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side: two tables are equal when there are none (repeats count)."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def near_threshold(scores: DataFrame, threshold: float, hysteresis: float, score: str = "score") -> DataFrame:
    """How many stand within the dead zone, and the nearest outside on either side."""
    s = F.col(score)
    return scores.agg(F.count_if(F.abs(s - threshold) < hysteresis).alias("inside"), F.max(F.when(s <= threshold - hysteresis, s)).alias("below"), F.min(F.when(s >= threshold + hysteresis, s)).alias("above"))


def schedule_gaps(runs: DataFrame, key: str, time: str, factor: float = 1.5, around: int = 6) -> DataFrame:
    """Intervals longer than ``factor`` local steps; the step is the larger median of up to six intervals on either side."""
    w = Window.partitionBy(key).orderBy(time)
    rows = runs.withColumn("gap", seconds(F.col(time), F.lag(time).over(w)))
    rows = rows.withColumns({"_b": F.array_sort(F.collect_list("gap").over(w.rowsBetween(-around, -1))), "_a": F.array_sort(F.collect_list("gap").over(w.rowsBetween(1, around)))})
    median = lambda c: F.when(F.size(c) > 0, (F.get(c, F.floor((F.size(c) - 1) / 2).cast("int")) + F.get(c, F.floor(F.size(c) / 2).cast("int"))) / 2)
    return rows.withColumn("step", F.greatest(median(F.col("_b")), median(F.col("_a")))).where(F.col("gap") > factor * F.col("step")).drop("_a", "_b")


def hung_runs(runs: DataFrame, at: Column, interval_seconds: float) -> DataFrame:
    return runs.where(F.col("finished_at").isNull() & (seconds(at, F.col("started_at")) > interval_seconds))


def uncovered(entities: DataFrame, own: DataFrame, live: DataFrame, permitted: DataFrame, key: str = "section_id") -> DataFrame:
    """High entities with neither an order of the run, nor a live order, nor an open permit."""
    out = entities
    for other in (own, live, permitted):
        out = out.join(other.select(key), key, "left_anti")
    return out


def order_counts(warnings: DataFrame, orders: DataFrame, top: int) -> DataFrame:
    """Warnings with no order or more than ``top``; ``source_key`` starts with the warning's own key."""
    n = orders.select(F.regexp_extract("source_key", r"^(.*):[^:]*$", 1).alias("warning_key")).groupBy("warning_key").agg(F.count("*").alias("orders"))
    out = warnings.join(n, "warning_key", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    return out.where((F.col("orders") < 1) | (F.col("orders") > top))


def works_not_one(orders: DataFrame, works: DataFrame, key: str = "source_key") -> DataFrame:
    """Orders whose number of works is not exactly one: (key, works); one without any was put in, but never given out."""
    n = works.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("works"))
    out = orders.select(key).join(n, key, "left").withColumn("works", F.coalesce("works", F.lit(0)))
    return out.where(F.col("works") != 1)


def collectors_without_order(warnings: DataFrame, bridge: DataFrame, orders: DataFrame) -> DataFrame:
    """Collectors under a warning (prefix, opened_at) without an order (collector, created_at) since it was opened.

    ``bridge`` maps prefix to collector; a warning whose prefix it lacks stands under a null collector.  Only the last
    order of a collector counts, so each side is one row a key before they meet.
    """
    last = orders.groupBy("collector").agg(F.max("created_at").alias("_last"))
    placed = warnings.join(bridge.select("prefix", "collector").distinct(), "prefix", "left").join(last, "collector", "left")
    return placed.where(F.col("_last").isNull() | (F.col("_last") < F.col("opened_at"))).select("collector").distinct()


def bad_transitions(log: DataFrame, allowed: DataFrame, key: str, time: str) -> DataFrame:
    """Status changes that the transition table does not hold; the first status of a key starts from null."""
    w = Window.partitionBy(key).orderBy(time)
    steps = log.withColumn("from_status", F.lag("status").over(w))
    ok = allowed.select(F.col("from_status").alias("_f"), F.col("to_status").alias("_t"))
    return steps.join(ok, steps["from_status"].eqNullSafe(ok["_f"]) & (steps["status"] == ok["_t"]), "left_anti")


def registry_pairs(places: DataFrame, xref: DataFrame, level: int = 4) -> DataFrame:
    """(places, listed, without_place, ok): places of the section level against sections listed, and those listed without a place."""
    a = places.where(F.col("hierarchy_level") == level).agg(F.count("*").alias("places"))
    b = xref.agg(F.count("*").alias("listed"), F.count_if(F.col("func_location_id").isNull()).alias("without_place"))
    return a.join(F.broadcast(b)).withColumn("ok", (F.col("places") == F.col("listed")) & (F.col("without_place") == 0))  # a row each


def completeness(orders: DataFrame, works: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row of counts: orders, with object, due time, reason (not blank), work kind, a forecast that exists, and distinct forecasts; ``ok`` if none lacks any."""
    rows = orders.join(works.select("order_id", F.lit(True).alias("_w")).distinct(), "order_id", "left")
    rows = rows.join(forecasts.select("forecast_id", F.lit(True).alias("_f")).distinct(), "forecast_id", "left")
    out = rows.agg(
        F.count("*").alias("orders"), F.count("object_id").alias("with_object"), F.count("due_at").alias("with_due"), F.count_if(F.trim(F.coalesce("reason", F.lit(""))) != "").alias("with_reason"),
        F.count("_w").alias("with_work"), F.count("_f").alias("linked"), F.count_distinct(F.when(F.col("_f"), F.col("forecast_id"))).alias("forecasts"),
    )
    full = [F.col(c) == F.col("orders") for c in ("with_object", "with_due", "with_reason", "with_work", "linked")]
    ok = F.col("orders") > 0
    for c in full:
        ok = ok & c
    return out.withColumn("ok", ok)
