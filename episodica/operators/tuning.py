"""Choice of rule thresholds over a grid, and guards on what a run has put out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import f_beta, safe_ratio


def rule_grid(rows: DataFrame, rules: dict[str, Column], label: str) -> DataFrame:
    """(rule, alerts, tp, precision, recall, f1, f2) of every candidate rule in one pass over the rows."""
    sums = [s for k, c in rules.items() for s in (F.count_if(c).alias(f"{k}|a"), F.count_if(c & (F.col(label) == 1)).alias(f"{k}|t"))]
    one = rows.agg(*sums, F.count_if(F.col(label) == 1).alias("positives"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}|a`").alias("alerts"), F.col(f"`{k}|t`").alias("tp")) for k in rules])).alias("r")
    out = one.select("positives", each).select("positives", "r.*")
    out = out.withColumns({"precision": safe_ratio(F.col("tp"), F.col("alerts")), "recall": safe_ratio(F.col("tp"), F.col("positives"))})
    return out.withColumns({"f1": f_beta(F.col("precision"), F.col("recall")), "f2": f_beta(F.col("precision"), F.col("recall"), 2)}).drop("positives")


def recency_rules(hours: str, grid: tuple[float, ...]) -> dict[str, Column]:
    return {f"{h:g}": F.coalesce(F.col(hours) < h, F.lit(False)) for h in grid}


def choose_levels(rows: DataFrame, hours: str, label: str, grid: tuple[float, ...]) -> DataFrame:
    """(high, watch): the limit of best F1, and the one of best F2 above it; the smaller of equals."""
    scored = rule_grid(rows, recency_rules(hours, grid), label).withColumn("h", F.col("rule").cast("double"))
    high = scored.agg(F.max_by("h", F.struct("f1", -F.col("h"))).alias("high"))
    rest = scored.join(F.broadcast(high)).where("h > high")  # one row
    return rest.groupBy("high").agg(F.max_by("h", F.struct("f2", -F.col("h"))).alias("watch"))


def rule_family(rows: DataFrame, hours: str, counts: dict[int, str], label: str, grid: tuple[float, ...], least: tuple[int, ...]) -> DataFrame:
    """Recency rules, K-in-W rules and their ORs: best F1, and best precision with recall of at least 0.1."""
    rules = {f"recency {k}": c for k, c in recency_rules(hours, grid).items()}
    rules |= {f"{k} in {w}": F.col(c) >= k for w, c in counts.items() for k in least}
    pairs = [(a, b) for a in rules if a.startswith("recency") for b in rules if " in " in b]
    rules |= {f"{a} or {b}": rules[a] | rules[b] for a, b in pairs}
    scored = rule_grid(rows, rules, label)
    return scored.agg(F.max_by("rule", F.struct("f1", "rule")).alias("best_f1"), F.max_by("rule", F.struct(F.when(F.col("recall") >= 0.1, F.col("precision")), "rule")).alias("best_precision"))


def silent_windows(outputs: DataFrame, windows: DataFrame, time: str) -> DataFrame:
    """Windows (name, low, high) in which nothing was put out: a metric over them would count nothing as good."""
    marks = outputs.agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    return windows.join(F.broadcast(marks)).where(F.col("_a").isNull() | (F.col("_b") < F.col("low")) | (F.col("_a") >= F.col("high"))).drop("_a", "_b")


def uncovered_warnings(warnings: DataFrame, orders: DataFrame, selections: DataFrame, live: DataFrame) -> DataFrame:
    """Warnings (warning_key) without an order, with ``lawful``: each section of the frozen selection has a live order."""
    keys = orders.select(F.regexp_extract("source_key", r"^(.*):[^:]*$", 1).alias("warning_key")).distinct()
    bare = warnings.join(keys, "warning_key", "left_anti")
    mark = live.select("section_id").distinct().withColumn("_l", F.lit(True))
    covered = selections.join(mark, "section_id", "left").groupBy("warning_key").agg(F.bool_and(F.coalesce("_l", F.lit(False))).alias("lawful"))
    return bare.join(covered, "warning_key", "left").withColumn("lawful", F.coalesce("lawful", F.lit(False)))


def compare_mapping(file_rows: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """(problem, key, value) of a mapping file against a dimension: malformed rows, repeats, and what one side alone has."""
    good = file_rows.where(F.col(key).isNotNull() & F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))
    pick = lambda df, p: df.select(F.lit(p).alias("problem"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    bad = file_rows.where(F.col(key).isNull() | F.col(value).isNull() | (F.trim(F.col(value).cast("string")) == ""))
    repeats = good.groupBy(key, value).count().where("count > 1")
    once, dim = good.select(key, value).distinct(), dimension.select(key, value).distinct()
    return pick(bad, "malformed").unionByName(pick(repeats, "repeated")).unionByName(pick(once.exceptAll(dim), "file only")).unionByName(pick(dim.exceptAll(once), "dimension only"))
