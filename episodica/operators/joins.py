"""Mappings, as-of and range joins without theta shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(rows: DataFrame, key: str, target: str, count: Column | None = None) -> DataFrame:
    """(key, target, n, lost): the most frequent target of a key, the smallest of equals; ``lost`` counts the others."""
    counts = rows.where(F.col(target).isNotNull()).groupBy(key, target).agg((count if count is not None else F.count("*")).alias("n"))
    best = counts.groupBy(key).agg(F.min_by(F.struct(target, "n"), F.struct(-F.col("n"), F.col(target))).alias("b"), F.sum("n").alias("total"))
    return best.select(key, F.col(f"b.{target}").alias(target), F.col("b.n").alias("n"), (F.col("total") - F.col("b.n")).alias("lost"))


def tree_parents(tree: DataFrame, key: str = "object_id", parent: str = "parent_id", levels: int = 2) -> DataFrame:
    """(object_id, up_1 .. up_n): ancestors by fixed-depth self-joins of a small dimension."""
    out = tree.select(F.col(key), F.col(parent).alias("up_1"))
    for n in range(2, levels + 1):
        step = tree.select(F.col(key).alias(f"up_{n - 1}"), F.col(parent).alias(f"up_{n}"))
        out = out.join(step, f"up_{n - 1}", "left")
    return out.select(key, *[f"up_{n}" for n in range(1, levels + 1)])


def tree_paths(tree: DataFrame, key: str = "object_id", parent: str = "parent_id", name: str = "name", depth: int = 16) -> DataFrame:
    """(object_id, path, level) from the root, by an iterative join to a fixed point; a cycle or too deep a tree is an error."""
    level = tree.where(F.col(parent).isNull()).select(F.col(key), F.col(name).cast("string").alias("path"), F.lit(1).alias("level"))
    out = level
    for n in range(2, depth + 2):
        level = tree.join(level.select(F.col(key).alias(parent), F.col("path").alias("_up")), parent).select(F.col(key), F.concat_ws("/", "_up", name).alias("path"), F.lit(n).alias("level"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the tree is deeper than {depth} levels or has a cycle")


def recursive_paths(tree: DataFrame, key: str = "object_id", parent: str = "parent_id", name: str = "name", depth: int = 16) -> DataFrame:
    """``tree_paths`` as one recursive query: no job runs while the plan is built, and each level is computed once.

    A tree deeper than ``depth``, or one with a cycle below a root, is an error when the plan runs.  Rows that no
    root leads to (a cycle without a root, an unknown parent) have no path and no row.
    """
    q = lambda c: f"`{c}`"
    return tree.sparkSession.sql(
        f"""WITH RECURSIVE up ({q(key)}, path, level) AS (
          SELECT {q(key)}, CAST({q(name)} AS STRING), 1 FROM {{tree}} WHERE {q(parent)} IS NULL
          UNION ALL
          SELECT t.{q(key)}, CASE WHEN up.level < {int(depth)} THEN concat_ws('/', up.path, t.{q(name)}) ELSE raise_error('the tree is deeper than {int(depth)} levels or has a cycle') END, up.level + 1
          FROM {{tree}} t JOIN up ON t.{q(parent)} = up.{q(key)})
        SELECT * FROM up""",
        tree=tree.select(key, parent, name),
    )


def next_event(left: DataFrame, right: DataFrame, key: str, time: str, row_id: str, within_us: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each left row the first right row of its key strictly later: left columns, next_time, next_id and next_ of ``carry``.

    One shuffle by key: both sides are stacked and a range frame over microseconds looks ahead; of equal
    times the smallest id.  Nothing is joined by inequality.
    """
    found = right.select(key, time, F.struct(time, row_id, *carry).alias("_r"), F.lit(False).alias("_left"))
    both = left.withColumn("_left", F.lit(True)).unionByName(found, allowMissingColumns=True)
    both = both.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    ahead = Window.partitionBy(key).orderBy("_us").rangeBetween(1, within_us or Window.unboundedFollowing)
    out = both.withColumn("_n", F.min("_r").over(ahead)).where("_left")
    return out.select(*left.columns, F.col(f"_n.{time}").alias("next_time"), F.col(f"_n.{row_id}").alias("next_id"), *[F.col(f"_n.{c}").alias(f"next_{c}") for c in carry])


def latest_before(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """For each left row the latest right row of its key at or before it (columns prefixed); one shuffle by key."""
    r = right.select(F.col(key), F.col(time), F.struct(time, *columns).alias("_r"))
    both = left.withColumn("_left", F.lit(True)).unionByName(r.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_p", F.max("_r").over(w)).where("_left")
    return out.select(*left.columns, *[F.col(f"_p.{c}").alias(f"{prefix}{c}") for c in [time, *columns]])


def as_of(rows: DataFrame, key: str, time: str, at: Column, columns: list[str]) -> DataFrame:
    """The latest row of each key with time <= ``at``."""
    return rows.where(F.col(time) <= at).groupBy(key).agg(F.max(time).alias(time), *[F.max_by(c, time).alias(c) for c in columns])


def events_ahead(entities: DataFrame, events: DataFrame, key: str, day: str, event_time: str, low_hours: int, high_hours: int) -> DataFrame:
    """Entity-days with the number of events within [day end + low, day end + high]: every event is laid out on the days that may see it."""
    first = F.date_sub(F.to_date(event_time), high_hours // 24 + 1)
    laid = events.select(key, F.col(event_time).alias("_t"), F.explode(F.sequence(first, F.to_date(event_time))).alias(day))
    end = F.timestamp_add("DAY", F.lit(1), F.col(day).cast("timestamp"))
    ahead = (F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(end)) / 3.6e9
    counted = laid.where((ahead >= low_hours) & (ahead <= high_hours)).groupBy(key, day).agg(F.count("*").alias("events"))
    return entities.join(counted, [key, day], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def in_plan(events: DataFrame, plans: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Mark events inside a planned window of their keys, both days whole: ``planned``."""
    sure = plans.where("match = 'sure'").select(*keys, F.explode(F.sequence("dismantle_from", "return_to")).alias("_day")).distinct().withColumn("planned", F.lit(True))
    return events.withColumn("_day", F.to_date(time)).join(sure, [*keys, "_day"], "left").withColumn("planned", F.coalesce("planned", F.lit(False))).drop("_day")


def in_scope(rows: DataFrame, scope: DataFrame | None, tree: DataFrame, key: str = "object_id") -> DataFrame:
    """Rows whose object, or its parent, is in the user's scope; None sees all."""
    if scope is None:
        return rows
    seen = tree.select(F.col("object_id").alias(key), F.explode(F.array("object_id", "parent_id")).alias("_o"))
    seen = seen.join(scope.select(F.col("object_id").alias("_o")), "_o", "left_semi").select(key).distinct()
    return rows.join(seen, key, "left_semi")


def registry(channels: DataFrame, sections: DataFrame, collectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channel -> section -> collector, and its faults: (problem, id) for repeated and orphan ids."""
    repeated = lambda df, c, p: df.groupBy(c).count().where("count > 1").select(F.lit(p).alias("problem"), F.col(c).cast("string").alias("id"))
    orphan = lambda a, b, c, p: a.where(F.col(c).isNotNull()).join(b, c, "left_anti").select(F.lit(p).alias("problem"), F.col(c).cast("string").alias("id")).distinct()
    faults = repeated(channels, "channel_id", "repeated channel").unionByName(repeated(sections, "section_id", "repeated section"))
    faults = faults.unionByName(orphan(channels, sections, "section_id", "channel without section")).unionByName(orphan(sections, collectors, "collector_id", "section without collector"))
    return channels.join(sections, "section_id", "left").join(collectors, "collector_id", "left"), faults


def tree_listing(channels: DataFrame, collector: str = "collector", node: str = "node", section: str = "section_id") -> DataFrame:
    """(collector, node, channels, sections): channels of each node and its distinct sections in order; a section stands under every node where it has a channel."""
    return channels.groupBy(collector, node).agg(F.count("*").alias("channels"), F.array_sort(F.collect_set(section)).alias("sections"))


def fan_out(alerts: DataFrame, mapping: DataFrame, key: str, target: str) -> DataFrame:
    """One row for each alert and each distinct ``target`` of its key; alerts whose key maps to nothing fall away."""
    return alerts.join(mapping.select(key, target).where(F.col(target).isNotNull()).distinct(), key)
