"""Risk rules, ranks, spread, write policy and orders."""

from __future__ import annotations

import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# task functions travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANK = {"normal": 0, "watch": 1, "high": 2}
#: Fixed order of systems for equal risk.
SYSTEM_ORDER = ("gas", "fire", "security")


def level_rank(level: Column) -> Column:
    out = F.when(level == "normal", 0)
    for name in ("watch", "high"):
        out = out.when(level == name, RANK[name])
    return out


def bucket_score(hours: Column, table: list[tuple[float, float | None, float]]) -> Column:
    """Score of the bucket [from, to) that holds the hours; the last bucket for null and beyond."""
    out = F.lit(table[-1][2])
    for low, high, score in reversed(table):
        out = F.when((hours >= low) & (F.lit(True) if high is None else hours < high), F.lit(score)).otherwise(out)
    return F.when(hours.isNull(), F.lit(table[-1][2])).otherwise(out)


def level_by(value: Column, high: float, watch: float) -> Column:
    return F.when(value < high, "high").when(value < watch, "watch").otherwise("normal")


def recency_rule(channels: DataFrame, failures: DataFrame, at: Column, table: list[tuple[float, float | None, float]], high_h: float = 24, watch_h: float = 72, confirm_seconds: int = 3601) -> DataFrame:
    """Hours since the last confirmed failure outside planned windows, its score, level and reasons.

    ``failures`` has channel_id, started_at, planned and plan_text.  Planned failures leave a reason of weight 0.
    """
    known = failures.where((F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) >= confirm_seconds * 1_000_000)
    folded = known.groupBy("channel_id").agg(F.max(F.when(~F.col("planned"), F.col("started_at"))).alias("last"), F.array_sort(F.collect_set(F.when(F.col("planned"), F.col("plan_text")))).alias("plans"))
    out = channels.select("channel_id").join(folded, "channel_id", "left")
    hours = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 3.6e9
    out = out.withColumn("hours", hours).withColumn("score_real", F.round(bucket_score(F.col("hours"), table), 6))
    out = out.withColumn("level_real", F.when(F.col("hours").isNull(), "normal").otherwise(level_by(F.col("hours"), high_h, watch_h)))
    real = F.when(F.col("hours").isNotNull(), F.array(reason(F.format_string("last failure %.0f h ago", "hours"), F.col("score_real"), "real"))).otherwise(F.array().cast(REASONS))
    plans = F.transform(F.coalesce("plans", F.array().cast("array<string>")), lambda t: reason(t, F.lit(0.0), "plan"))
    return out.withColumn("reasons", sort_reasons(F.concat(real, plans))).drop("plans")


REASONS = "array<struct<text:string,weight:double,kind:string>>"


def reason(text: Column, weight: Column, kind: str) -> Column:
    return F.struct(text.alias("text"), weight.cast("double").alias("weight"), F.lit(kind).alias("kind"))


def sort_reasons(reasons: Column) -> Column:
    """By weight, highest first; equal weights keep their text order."""
    keyed = F.transform(reasons, lambda r: F.struct((-r["weight"]).alias("w"), r["text"].alias("t"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda k: k["r"])


def precursor_rule(rows: DataFrame, due_seconds: str, horizon_h: float, score_due: float, score_pending: float, has_passport: str) -> DataFrame:
    """Combine with a pending precursor: due within the horizon is high, later is watch; score 1 - (1 - a)(1 - b)."""
    state = F.when(F.col(has_passport) & F.col(due_seconds).isNotNull(), F.when(F.col(due_seconds) <= horizon_h * 3600, "due").otherwise("pending"))
    p = F.when(state == "due", score_due).when(state == "pending", score_pending).otherwise(0.0)
    full = 1 - (1 - F.col("score_real")) * (1 - p)
    level = F.when(state == "due", "high").when(state == "pending", "watch").otherwise("normal")
    out = rows.withColumns({"score_synth": F.round(full - F.col("score_real"), 6), "_l": level})
    return out.withColumn("level_full", F.when(level_rank(F.col("_l")) > level_rank(F.col("level_real")), F.col("_l")).otherwise(F.col("level_real"))).drop("_l")


def logistic_score(rows: DataFrame, weights: dict[str, float], bias: float, groups: dict[str, list[str]], gate: Column | None = None, offset: Column | None = None) -> DataFrame:
    """Probability, and the positive groups' shares of what it has above the bias alone (``contributions``)."""
    z = F.lit(bias) + (offset if offset is not None else F.lit(0.0))
    for c, w in weights.items():
        z = z + F.coalesce(F.col(c), F.lit(0)) * w
    p, p0 = 1 / (1 + F.exp(-z)), 1 / (1 + F.exp(-F.lit(bias)))
    parts = F.array(*[F.struct(F.lit(g).alias("text"), sum((F.coalesce(F.col(c), F.lit(0)) * weights[c] for c in cs), F.lit(0.0)).alias("logit")) for g, cs in groups.items()])
    positive = F.filter(parts, lambda x: x["logit"] > 0)
    out = rows.withColumn("_p", F.when(gate, p).otherwise(F.lit(0.0)) if gate is not None else p).withColumn("_g", positive)
    total = F.aggregate("_g", F.lit(0.0), lambda a, x: a + x["logit"])
    share = F.transform("_g", lambda x: F.struct(x["text"].alias("text"), (F.greatest(F.col("_p") - p0, F.lit(0.0)) * x["logit"] / total).alias("weight"), F.lit("model").alias("kind")))
    return out.withColumn("probability", F.col("_p")).withColumn("contributions", sort_reasons(share)).drop("_p", "_g")


def fit_logistic(rows: DataFrame, features: list[str], label: str = "label", weight: str | None = None, c: float = 1.0) -> tuple[dict[str, float], float]:
    """Coefficients on the given scale of an L2 logistic fit on standardised columns."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features], (F.sum(weight) if weight else F.count("*")).alias("w")).first()
    scale = {f: stats[f"s_{f}"] or 1.0 for f in features}
    scaled = rows.select(F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).alias("weight"), *[((F.col(f) - stats[f"m_{f}"]) / scale[f]).alias(f) for f in features])
    model = LogisticRegression(weightCol="weight", standardization=False, regParam=1.0 / (c * float(stats["w"])), maxIter=200, tol=1e-9).fit(VectorAssembler(inputCols=features, outputCol="features").transform(scaled))
    coefficients = {f: float(model.coefficients[i]) / scale[f] for i, f in enumerate(features)}
    return coefficients, float(model.intercept) - sum(coefficients[f] * stats[f"m_{f}"] for f in features)


def bucket_table(rows: DataFrame, hours: str, label: str, edges: list[float]) -> DataFrame:
    """(bucket, from_h, to_h, rows, score): how often the label holds by bucket of hours."""
    b = F.lit(len(edges) - 1)
    for i in reversed(range(len(edges) - 1)):
        b = F.when(F.col(hours) < edges[i + 1], i).otherwise(b)
    low, high = F.array(*[F.lit(float(e)) for e in edges]), F.array(*[F.lit(float(e)) for e in edges[1:]], F.lit(None).cast("double"))
    out = rows.where(F.col(hours).isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("rows"), F.avg(F.col(label).cast("double")).alias("score"))
    return out.select("bucket", F.get(low, "bucket").alias("from_h"), F.get(high, "bucket").alias("to_h"), "rows", "score")


def finish_ensemble(rows: DataFrame, scores: str, weights: tuple[float, float], other: str, is_rearm: Column, platt: dict[bool, tuple[float, float]]) -> DataFrame:
    """Median of the members, for rearm blended with another score in logits, then a Platt scale by kind."""
    s = F.array_sort(F.col(scores))
    n = F.size(s)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    logit = lambda p: F.log(F.greatest(F.lit(1e-9), p) / F.greatest(F.lit(1e-9), 1 - p))
    z = F.when(is_rearm, weights[0] * logit(median) + weights[1] * logit(F.col(other))).otherwise(logit(median))
    a, b = (F.when(is_rearm, platt[True][i]).otherwise(platt[False][i]) for i in (0, 1))
    return rows.withColumn("probability", 1 / (1 + F.exp(-(a * z + b))))


def top_factors(factors: Column, n: int) -> Column:
    """The n entries of largest absolute weight."""
    keyed = F.transform(factors, lambda r: F.struct((-F.abs(r["weight"])).alias("w"), r["text"].alias("t"), r.alias("r")))
    return F.slice(F.transform(F.array_sort(keyed), lambda k: k["r"]), 1, n)


def fold_sections(sensors: DataFrame, sections: DataFrame, reasons: int = 3) -> DataFrame:
    """Section risk: its worst sensor by (level, score, id), up to three risky ones and how many remain; empty sections are normal with 0."""
    order = F.struct(-level_rank(F.col("level")), -F.col("score"), F.col("channel_id"))
    entry = F.struct(order.alias("o"), "channel_id", "score", "level")
    risky = F.array_sort(F.collect_list(F.when(F.col("level") != "normal", entry)))
    best = sensors.groupBy("section_id").agg(F.min_by(F.struct("channel_id", "score", "level"), order).alias("w"), risky.alias("r"))
    out = sections.select("section_id").distinct().join(best, "section_id", "left")
    return out.select(
        "section_id", F.col("w.channel_id").alias("channel_id"), F.coalesce("w.score", F.lit(0.0)).alias("score"), F.coalesce("w.level", F.lit("normal")).alias("level"),
        F.transform(F.slice(F.coalesce("r", F.array()), 1, reasons), lambda e: e["channel_id"]).alias("shown"),
        F.greatest(F.lit(0), F.coalesce(F.size("r"), F.lit(0)) - reasons).alias("more"),
    )


def fold_prefixes(forecasts: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collector risk from prefixes (highest p, OR of warnings), and prefixes no collector knows."""
    known = forecasts.join(mapping.select("prefix", "collector").distinct(), "prefix")
    out = known.groupBy("collector").agg(F.max("p").alias("p"), F.max_by("prefix", F.struct("p", "prefix")).alias("prefix"), F.bool_or("warning").alias("warning"))
    return out, forecasts.join(mapping, "prefix", "left_anti").select("prefix").distinct()


def opened_warnings(current: DataFrame, logged: DataFrame, cut: Column, horizon_h: float) -> DataFrame:
    """Warnings of the run and those logged after the cut, once by (prefix, time), the run's first; each with its expiry."""
    both = current.select("prefix", "t", F.lit(0).alias("source")).unionByName(logged.where(F.col("t") > cut).select("prefix", "t", F.lit(1).alias("source")))
    out = both.groupBy("prefix", "t").agg(F.min("source").alias("source"))
    return out.withColumn("expires_at", F.timestamp_micros(F.unix_micros(F.col("t").cast("timestamp")) + int(horizon_h * 3.6e9)))


def spread(forecasts: DataFrame, weights: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """An object's probability over its sections by weight: the mean of its sections, shared by their weights, which add up to one again.

    Sections without weight are left out of everything.  Where the probabilities of an object's other sections
    differ, they stay as they are.
    """
    joined = forecasts.join(weights.select("section_id", "weight").where("weight is not null"), "section_id")
    w = Window.partitionBy("object_id")
    distinct = F.max("probability").over(w) - F.min("probability").over(w) > tolerance
    out = joined.withColumns({"_distinct": distinct, "_sum": F.sum("weight").over(w), "_mean": F.avg("probability").over(w)})
    share = F.when(F.col("_distinct"), F.col("probability")).when(F.col("_sum") > 0, F.col("_mean") * F.col("weight") / F.col("_sum"))
    return out.withColumn("spread", share).where(F.col("spread").isNotNull()).drop("_distinct", "_sum", "_mean")


def scalar_setting(settings: DataFrame, key: str, default: float) -> DataFrame:
    """One row with the value of a setting (column named like the key), or its default."""
    return settings.agg(F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(default)).alias(key))


def section_weight(sections: DataFrame, episodes: DataFrame, settings: DataFrame, first_day: Column, last_day: Column, alpha_key: str = "forecast_weight_alpha") -> DataFrame:
    """Laplace-smoothed share of each section in the episodes of its object: (episodes + a) / (all + a * sections).

    ``sections`` has section_id and object_id, ``episodes`` section_id and started_at; those outside the days
    are counted as excluded.  The smoothing a is a setting, 1 where it is not set.
    """
    day = F.to_date("started_at")
    inside = day.between(first_day, last_day)
    n = episodes.where("section_id is not null").groupBy("section_id").agg(F.count_if(inside).alias("episodes_cnt"), F.count_if(~inside).alias("excluded_cnt"))
    out = sections.join(n, "section_id", "left").join(F.broadcast(scalar_setting(settings, alpha_key, 1.0)))  # one row
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("episodes_cnt", "excluded_cnt")}
    w = Window.partitionBy("object_id")
    out = out.withColumns(zero).withColumns({"sections_cnt": F.count("*").over(w), "_all": F.sum("episodes_cnt").over(w)})
    weight = (F.col("episodes_cnt") + F.col(alpha_key)) / (F.col("_all") + F.col(alpha_key) * F.col("sections_cnt"))
    return out.withColumn("weight", weight).drop("_all", alpha_key)


def alpha_sensitivity(counts: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """(alpha, max_share, min_share): the largest and smallest weight of a section under each smoothing; ``counts`` has object_id and episodes_cnt."""
    each = counts.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    w = Window.partitionBy("alpha", "object_id")
    weight = (F.col("episodes_cnt") + F.col("alpha")) / (F.sum("episodes_cnt").over(w) + F.col("alpha") * F.count("*").over(w))
    return each.withColumn("weight", weight).groupBy("alpha").agg(F.max("weight").alias("max_share"), F.min("weight").alias("min_share"))


def live_orders(orders: DataFrame, at: Column, statuses: tuple[str, ...] = ("OPEN", "IN_PROCESS")) -> DataFrame:
    """Sections with an open order that is not due yet, of whatever origin; they silence new orders."""
    return orders.where(F.col("status").isin(*statuses) & (F.col("due_at") > at) & F.col("section_id").isNotNull()).select("section_id").distinct()


def risk_ranks(rows: DataFrame, run: list[str]) -> DataFrame:
    """Rank in a run by level, probability, importance of the system and id.

    A run's sections are a dimension; the rank is one window per run.
    """
    system = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SYSTEM_ORDER]), F.col("system")), F.lit(0))
    importance = F.when(system == 0, len(SYSTEM_ORDER) + 1).otherwise(system)
    w = Window.partitionBy(*run).orderBy(level_rank(F.col("level")).desc(), F.col("probability").desc(), importance, "section_id")
    return rows.withColumn("risk_rank", F.row_number().over(w))


POLICY = {"deadband": 0.02, "heartbeat_min": 60.0, "hysteresis": 0.02, "hold_min": 10.0, "threshold": 0.80}


def policy_row(state: tuple | None, t: float, p: float, wanted: bool, c: dict, full_log: bool = False) -> tuple[tuple, str, str | None]:
    """One decision of a key: state is (class, since, logged probability, logged at); returns it with the class and the reason to log."""
    cls, since, logged, logged_at = state or (None, None, None, None)
    new = "high" if p >= c["threshold"] + c["hysteresis"] else "normal" if p <= c["threshold"] - c["hysteresis"] else cls or "normal"
    if cls is not None and new != cls and (t - since) / 6e7 < c["hold_min"]:
        new = cls
    changed = cls is not None and new != cls
    if cls is None or changed:
        since = t
    if full_log:
        why = "full"
    elif logged_at is None:
        why = "first"
    elif abs(p - logged) >= c["deadband"] or changed:
        why = "change"
    elif (t - logged_at) / 6e7 >= c["heartbeat_min"]:
        why = "heartbeat"
    else:
        why = "warning" if wanted else None
    return (new, since, p if why else logged, t if why else logged_at), new, why


def write_policy(rows: DataFrame, key: str, time: str, probability: str, policy: dict | None = None, *, full_log: bool = False, warned: str | None = None) -> DataFrame:
    """Class with hysteresis and hold, and why each row is logged: full, first, change, heartbeat, warning, or null for skipped.

    Reasons are tried in this order.  ``full_log`` logs every row; ``warned`` names a boolean column of rows that
    an order of this run refers to, which are logged whatever the dead band says.  The dead band counts from the
    last row written.  Rows are dealt by key and sorted in their partitions; a task goes through them once and holds
    the state of one key, four values, however many rows the key has.  The streaming twin keeps the same state.
    """
    c, kinds = POLICY | (policy or {}), dict(rows.dtypes)
    marked = F.coalesce(F.col(warned), F.lit(False)) if warned else F.lit(False)
    each = rows.select(F.col(key), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(probability).cast("double").alias("p"), marked.alias("w"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, state, none = None, None, float("nan")
        for batch in batches:
            out = []
            for k, t, p, w in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if k != held:
                    held, state = k, None
                state, cls, why = policy_row(state, none if t is None else t, none if p is None else p, w, c, full_log)
                out.append((cls, why))
            added = [pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else ([], []))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], names=[*batch.schema.names[:3], "cls", "reason"])

    dealt = each.repartition(key).sortWithinPartitions(key, F.col("t").asc_nulls_last(), F.col("p").asc_nulls_last())
    out = dealt.mapInArrow(run, f"`{key}` {kinds[key]}, t bigint, p double, cls string, reason string")
    return out.select(key, F.timestamp_micros("t").alias(time), F.col("p").alias(probability), F.col("cls").alias("risk_class"), "reason")


def replace_snapshot(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The current table after a run: fresh rows, and older ones of keys the run left out, marked stale."""
    kept = current.drop("is_stale").join(fresh.select(key), key, "left_anti").withColumn("is_stale", F.lit(True))
    return fresh.withColumn("is_stale", F.lit(False)).unionByName(kept, allowMissingColumns=True)


def select_for_orders(sections: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Sections over the threshold of their criticality class (unknown: the strictest); in object mode the sum of shares decides and the heaviest section stands for the object."""
    limit = F.lit(max(thresholds.values()))
    for k, v in thresholds.items():
        limit = F.when(F.col("criticality") == k, v).otherwise(limit)
    with_limit = sections.withColumn("_limit", limit)
    single = with_limit.where("object_id is null or weight is null").where(F.col("probability") >= F.col("_limit")).select("section_id", "object_id", "probability")
    grouped = with_limit.where("object_id is not null and weight is not null").groupBy("object_id").agg(
        F.sum("probability").alias("probability"), F.max_by("section_id", F.struct("weight", -F.col("section_id"))).alias("section_id"), F.max_by("_limit", F.struct("weight", -F.col("section_id"))).alias("_limit")
    )
    return single.unionByName(grouped.where(F.col("probability") >= F.col("_limit")).select("section_id", "object_id", "probability"))


def heaviest_sections(weights: DataFrame, n: int, group: str = "collector") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col("weight").desc(), "section_id")
    return weights.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def orders_for_warnings(warnings: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """One order for each of the top sections of a warning's prefix, with its key and the warning's route."""
    top = heaviest_sections(weights, n, "prefix")
    routes = top.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "section_id"))), lambda s: s["section_id"]).alias("route"))
    out = warnings.join(top.select("prefix", "section_id", "place"), "prefix").join(routes, "prefix")
    key = F.concat_ws(":", F.lit("warn"), "prefix", F.date_format(F.col("t").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), "section_id")
    return out.withColumn("source_key", key)


def apply_selections(orders: DataFrame, existing: DataFrame, live: DataFrame) -> DataFrame:
    """Of openings that want one section the latest wins and lists the others; known keys and sections with live orders are left out."""
    fresh = orders.join(existing.select("source_key"), "source_key", "left_anti").join(live.select("section_id"), "section_id", "left_anti")
    w = Window.partitionBy("section_id").orderBy(F.col("t").desc(), "source_key")
    rest = fresh.withColumn("_r", F.row_number().over(w))
    others = F.array_sort(F.collect_list(F.when(F.col("_r") > 1, F.col("source_key"))).over(Window.partitionBy("section_id")))
    return rest.withColumn("superseded", others).where("_r = 1").drop("_r")


def daily_key(section: Column, moment: Column, zone: str) -> Column:
    return F.concat_ws(":", F.lit("sensor"), section, F.to_date(F.from_utc_timestamp(moment.cast("timestamp"), zone)))


def due_at(detected: Column, norm_hours: Column, cap_hours: float) -> Column:
    return F.timestamp_micros(F.unix_micros(detected.cast("timestamp")) + (F.least(norm_hours, F.lit(cap_hours)) * 3.6e9).cast("long"))


def insert_new(existing: DataFrame, fresh: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``fresh`` whose key is new, the first of equals."""
    w = Window.partitionBy(key).orderBy(*order)
    once = fresh.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return once.join(existing.select(key), key, "left_anti")


def explain(rows: DataFrame, factors: str, families: DataFrame, silence: Column | None = None, n: int = 3) -> DataFrame:
    """Up to n dangerous factors, one per family, as text from templates; a fallback text where there is none.

    ``families`` has (factor, family, danger, template): danger is the sign that is bad, and the template takes the number.
    """
    each = rows.select("entity", F.explode(factors).alias("f")).select("entity", "f.factor", "f.value", "f.weight")
    named = each.join(families, "factor").where(F.signum("weight") == F.col("danger"))
    by_family = Window.partitionBy("entity", "family").orderBy(F.abs("weight").desc(), "factor")
    best = named.withColumn("_r", F.row_number().over(by_family)).where("_r = 1")
    text = F.replace(F.col("template"), F.lit("{}"), F.format_string("%.1f", F.col("value").cast("double")))
    out = best.groupBy("entity").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("w"), "factor", text.alias("text")))), 1, n).alias("e"))
    full = rows.select("entity").distinct().join(out, "entity", "left")
    texts = F.transform(F.coalesce("e", F.array()), lambda x: x["text"])
    return full.select("entity", F.when(F.size(texts) > 0, texts).otherwise(F.array(silence if silence is not None else F.lit("no notable factor"))).alias("texts"))
