"""The scheduled forecast run as one lazy plan: episodes, risk, ranks, snapshot and orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import joins as J
from ..operators import risk as R


@dataclass(frozen=True)
class Settings:
    table: tuple[tuple[float, float | None, float], ...]
    min_seconds: int = 3600
    thresholds: tuple[tuple[str, float], ...] = (("A", 0.3), ("B", 0.5), ("C", 0.6))
    zone: str = "Europe/Moscow"


def forecast_run(journal: DataFrame, channels: DataFrame, rules: DataFrame, plans: DataFrame, weights: DataFrame, at: Column, settings: Settings) -> dict[str, DataFrame]:
    """sensors, sections (ranked) and orders of one run at a moment; nothing runs until a result is written.

    Only readings up to the moment count, so a run can be repeated for any past moment with the same result.
    """
    seen = journal.where(F.col("read_time") <= at)
    marked = E.mark_bad(seen, channels, rules)
    long_ = E.long_episodes(E.episodes(marked, {"rule": F.col("bad")}), at, F.lit(settings.min_seconds))
    failures = J.in_plan(long_, plans, ["channel_id"], "started_at").select("channel_id", "started_at", "planned", F.lit("planned work").alias("plan_text"))
    sensors = R.recency_rule(channels, failures, at, list(settings.table))
    placed = sensors.join(channels.select("channel_id", "section_id", "system_kind"), "channel_id").select("channel_id", "section_id", "system_kind", F.col("score_real").alias("score"), F.col("level_real").alias("level"))
    sections = R.fold_sections(placed, channels.where("section_id is not null"))
    system = placed.groupBy("section_id").agg(F.min(F.array_position(F.array(*[F.lit(s) for s in R.SYSTEM_ORDER]), F.col("system_kind"))).alias("_s"))
    named = sections.join(system, "section_id", "left").withColumn("system", F.get(F.array(*[F.lit(s) for s in R.SYSTEM_ORDER]), (F.col("_s") - 1).cast("int"))).drop("_s")
    ranked = R.risk_ranks(named.withColumnRenamed("score", "probability").withColumn("as_of", at), ["as_of"])
    risky = ranked.join(weights, "section_id", "left").select("section_id", "object_id", "weight", "criticality", "probability")
    chosen = R.select_for_orders(risky, dict(settings.thresholds))
    orders = chosen.withColumn("source_key", R.daily_key(F.col("section_id"), at, settings.zone)).withColumn("due_at", R.due_at(at, F.lit(24.0), 72))
    return {"sensors": sensors, "sections": ranked, "orders": orders}
