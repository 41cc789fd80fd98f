"""Episodes and incidents by mergeable run summaries: no task ever holds a channel's whole history.

A channel's rows are cut into pieces of time (an hour, a day).  Inside a piece runs are found as always, by a window
over (channel, piece), so a channel with most of the rows is spread over its pieces.  A piece is then summed up by its
first row and by whether it begins and ends inside a run.  Summaries merge by neighbourhood alone: a run at a piece's
end goes on if the next piece begins inside one.  Only runs at the borders of pieces, two a piece at most, take part
in that merge; all others are final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import seconds


def piece_of(time: str, hours: int = 24) -> Column:
    """Number of the piece a moment lies in."""
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (hours * 3_600_000_000))


def _chains(parts: DataFrame, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Merge parts that follow one another, by ``aggregates`` that keep the parts' column names.

    ``_on``: the part goes on in the next piece; ``_follows``: it goes on from the piece before; ``_at``: its place in
    order.  Parts with neither are final and see no window.
    """
    order = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = parts.where(F.col("_on") | F.col("_follows")).withColumn("_chain", F.sum((~F.col("_follows")).cast("int")).over(order))
    merged = linked.groupBy(*by, "_chain").agg(*aggregates).drop("_chain")
    return parts.where(~F.col("_on") & ~F.col("_follows")).select(*merged.columns).unionByName(merged)


def episodes_by_pieces(
    journal: DataFrame, predicates: dict[str, Column], *, piece: Column | None = None, channel: str = "channel_id", time: str = "read_time", row_id: str = "journal_id", value: str = "value_text", section: str | None = "section_id", ts_to: Column | None = None
) -> DataFrame:
    """The same rows as ``episodes.episodes``, for journals in which one channel may hold most rows.

    ``piece`` numbers the pieces in order of time (default: days); more pieces mean smaller tasks.
    """
    keep = [channel, time, row_id, value, *([section] if section else [])]
    rows = journal if ts_to is None else journal.where(F.col(time) <= ts_to)
    names = list(predicates)
    rows = rows.select(*keep, (piece if piece is not None else piece_of(time)).alias("_piece"), *[F.coalesce(p, F.lit(False)).alias(f"_b_{n}") for n, p in predicates.items()])
    # duplicates lie in one piece: one shuffle by (channel, piece) serves them, the window and the piece's summary
    rows = rows.repartition(channel, "_piece").dropDuplicates([channel, "_piece", time, row_id, value])
    w = Window.partitionBy(channel, "_piece").orderBy(time, row_id)
    rows = rows.withColumns({"_next": F.lead(F.struct(F.col(time).alias("at"), F.col(value).alias("value"))).over(w), "_place": F.row_number().over(w)} | {f"_s_{n}": F.col(f"_b_{n}") & ~F.coalesce(F.lag(f"_b_{n}").over(w), F.lit(False)) for n in names})

    at = F.struct(time, row_id)
    # a piece's first and last row say all that its neighbours ask
    head, tail = F.col("_place") == 1, F.col("_next").isNull()
    flags = [F.bool_or(head & F.col(f"_b_{n}")).alias(f"_head_{n}") for n in names] + [F.bool_or(tail & F.col(f"_b_{n}")).alias(f"_tail_{n}") for n in names]
    sums = rows.where(head | tail).groupBy(channel, "_piece").agg(F.max(F.when(head, F.struct(F.col(time).alias("at"), F.col(value).alias("value")))).alias("_first"), *flags)
    beside = Window.partitionBy(channel).orderBy("_piece")
    sums = sums.select(
        F.col(channel).alias("_c"), F.col("_piece").alias("_p"), F.lead("_first").over(beside).alias("_after"),
        *[F.coalesce(F.lead(f"_head_{n}").over(beside), F.lit(False)).alias(f"_on_{n}") for n in names], *[F.coalesce(F.lag(f"_tail_{n}").over(beside), F.lit(False)).alias(f"_was_{n}") for n in names],
    )

    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(f"_b_{n}").alias("bad"), F.sum(F.col(f"_s_{n}").cast("int")).over(run).alias("run")) for n in names])
    bad = rows.withColumn("_all", each).withColumn("_e", F.explode(F.filter("_all", lambda e: e["bad"])))
    firsts = [F.min_by(value, at).alias("fault_value"), *([F.min_by(section, at).alias("section_id")] if section else [])]
    parts = bad.groupBy(F.col("_e.predicate").alias("predicate"), channel, "_piece", F.col("_e.run").alias("_run")).agg(
        F.min(time).alias("started_at"), F.max_by("_next", at).alias("_closes"), F.count("*").alias("rows_cnt"), *firsts, F.min("_place").alias("_place")
    )
    parts = parts.join(sums, (parts[channel] == sums["_c"]) & (parts["_piece"] == sums["_p"]))
    of = lambda prefix: F.coalesce(*[F.when(F.col("predicate") == n, F.col(f"{prefix}{n}")) for n in names])
    parts = parts.withColumns({
        "_on": F.col("_closes").isNull() & of("_on_"), "_follows": (F.col("_place") == 1) & of("_was_"), "_at": F.struct("_piece", "_place"),
        "_end": F.coalesce("_closes", F.when(~of("_on_"), F.col("_after"))),
    })
    kept = [F.min("started_at").alias("started_at"), F.max_by("_end", "_at").alias("_end"), F.sum("rows_cnt").alias("rows_cnt"), *[F.min_by(c, "_at").alias(c) for c in ("fault_value", *(["section_id"] if section else []))]]
    out = _chains(parts, ["predicate", channel], kept)
    return out.select(
        "predicate", channel, "started_at", F.col("_end.at").alias("ended_at"), F.col("rows_cnt").cast("int").alias("rows_cnt"), "fault_value", *(["section_id"] if section else []), F.col("_end.value").alias("closed_by")
    )


def merge_incidents_by_pieces(events: DataFrame, group: str, time: str, minutes: float, piece: Column | None = None) -> DataFrame:
    """The same rows as ``episodes.merge_incidents``, for groups that may hold most events."""
    rows = events.select(group, time, (piece if piece is not None else piece_of(time)).alias("_piece"))
    w = Window.partitionBy(group, "_piece").orderBy(time)
    far = lambda later, earlier: seconds(later, earlier) > minutes * 60
    rows = rows.withColumn("_fresh", F.coalesce(far(F.col(time), F.lag(time).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = rows.groupBy(group, "_piece", "_run").agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count("*").alias("events"))
    sums = parts.groupBy(group, "_piece").agg(F.min("first_at").alias("_low"), F.max("last_at").alias("_high"))
    beside = Window.partitionBy(group).orderBy("_piece")
    sums = sums.select(F.col(group).alias("_c"), F.col("_piece").alias("_p"), "_low", "_high", F.lead("_low").over(beside).alias("_later"), F.lag("_high").over(beside).alias("_earlier"))
    parts = parts.join(sums, parts[group].eqNullSafe(sums["_c"]) & (parts["_piece"] == sums["_p"]))
    goes_on = F.coalesce((F.col("last_at") == F.col("_high")) & ~far(F.col("_later"), F.col("last_at")), F.lit(False))
    follows = F.coalesce((F.col("first_at") == F.col("_low")) & ~far(F.col("first_at"), F.col("_earlier")), F.lit(False))
    parts = parts.select(group, "first_at", "last_at", "events", goes_on.alias("_on"), follows.alias("_follows"), F.col("first_at").alias("_at"))
    kept = [F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("events").alias("events")]
    return _chains(parts, [group], kept)
