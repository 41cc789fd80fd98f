"""Evaluation of alerts against failures."""

from __future__ import annotations

from collections import deque
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return safe_ratio((1 + b) * precision * recall, b * precision + recall)


def match_alerts(alerts: DataFrame, failures: DataFrame, *, key: str = "object_id", time: str = "t", low_hours: float = 24, high_hours: float | None = None) -> DataFrame:
    """One row per object: alerts, failures, tp, fn, fp, dup and the lead hours of its matches.

    Failures in order of time each take the latest unused alert whose lead is within [low, high].  Alerts in
    no failure's window are false; those in one but unused are repeats.  One shuffle by object; a task goes
    through its rows in order once and holds no more than the alerts that a later failure may still take.
    Rows without object are left out.
    """
    low = int(max(low_hours, 0) * 3.6e9)
    span = int(high_hours * 3.6e9) - low if high_hours else None
    # an alert counts from the moment on which its lead is long enough
    rows = lambda df, shift, failure: df.where(F.col(key).isNotNull()).select(key, (F.unix_micros(F.col(time).cast("timestamp")) + shift).alias("at"), F.lit(failure).alias("failure"))
    both = rows(alerts, low, False).unionByName(rows(failures, 0, True))
    names = ["alerts", "failures", "tp", "fn", "fp", "dup", "leads"]

    def match(frames):
        held, n, ready, fresh = None, [], deque(), []

        def row():
            n_alerts, n_failures, false, leads = n
            false += len(fresh)
            return held, n_alerts, n_failures, len(leads), n_failures - len(leads), false, n_alerts - false - len(leads), leads

        for frame in frames:
            out = []
            for k, at, failure in zip(frame[key], frame["at"], frame["failure"]):
                if k != held:
                    if held is not None:
                        out.append(row())
                    held, n, ready, fresh = k, [0, 0, 0, []], deque(), []
                if not failure:
                    n[0] += 1
                    ready.append(at)
                    fresh.append(at)
                    continue
                n[1] += 1
                if span is not None:
                    n[2] += sum(x < at - span for x in fresh)
                    while ready and ready[0] < at - span:
                        ready.popleft()
                fresh = []
                if ready:
                    n[3].append((at - ready.pop() + low) / 3.6e9)
            yield pd.DataFrame(out, columns=[key, *names])
        if held is not None:
            yield pd.DataFrame([row()], columns=[key, *names])

    dealt = both.repartition(key).sortWithinPartitions(key, "at", "failure")
    return dealt.mapInPandas(match, f"`{key}` {dict(both.dtypes)[key]}, " + ", ".join(f"{c} int" for c in names[:-1]) + ", leads array<double>")


def summarise(matched: DataFrame, by: list[str] | None = None, object_days: float | None = None) -> DataFrame:
    """Totals, precision, recall, F1, lead statistics and, if asked, false alarms per 1000 object-days."""
    leads = F.flatten(F.collect_list("leads"))
    out = matched.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in ("alerts", "failures", "tp", "fp", "fn", "dup")])
    each = matched.select(*(by or []), F.explode("leads").alias("lead")).groupBy(*(by or [])).agg(
        F.percentile("lead", F.lit(0.5)).alias("median_lead"), F.min("lead").alias("min_lead"), F.avg((F.col("lead") < 24).cast("double")).alias("under_24h")
    )
    out = out.join(each, by, "left") if by else out.join(each, F.lit(True), "left")
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumns({"precision": p, "recall": r}).withColumn("f1", f_beta(F.col("precision"), F.col("recall")))
    return out.withColumn("false_per_1000", F.col("fp") / object_days * 1000) if object_days else out


def verdict(summary: DataFrame, horizon_hours: float, min_precision: float = 0.7, min_recall: float = 0.5, min_lead: float = 24, max_under: float = 0.2) -> DataFrame:
    """Strictly above both minima; lead is judged only where the horizon leaves it open."""
    lead = F.lit(None).cast("boolean") if horizon_hours >= min_lead else (F.coalesce("median_lead", F.lit(0.0)) >= min_lead) & F.coalesce(F.col("under_24h") <= max_under, F.lit(False))
    out = summary.withColumns({"precision_ok": F.col("precision") > min_precision, "recall_ok": F.col("recall") > min_recall, "lead_ok": lead})
    return out.withColumn("passed", F.col("precision_ok") & F.col("recall_ok") & F.coalesce("lead_ok", F.lit(True)))


def lead_histogram(matched: DataFrame, edges: list[float]) -> DataFrame:
    """Leads by uneven bucket [edge, next); the last is open."""
    lead = F.col("lead")
    bucket = F.lit(len(edges) - 1)
    for i in reversed(range(len(edges) - 1)):
        bucket = F.when(lead < edges[i + 1], i).otherwise(bucket)
    return matched.select(F.explode("leads").alias("lead")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def top_alerts(scores: DataFrame, k: int, snapshot: str = "as_of", score: str = "score", row_id: str = "channel_id") -> DataFrame:
    """The k highest of each snapshot, ties by id."""
    w = Window.partitionBy(snapshot).orderBy(F.col(score).desc(), row_id)
    return scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def precision_at(scores: DataFrame, ks: tuple[int, ...], label: str = "label", snapshot: str = "as_of", score: str = "score", row_id: str = "channel_id") -> DataFrame:
    """(k, selected, positives, precision, row_recall) over all snapshots."""
    w = Window.partitionBy(snapshot).orderBy(F.col(score).desc(), row_id)
    ranked = scores.withColumn("_r", F.row_number().over(w)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    inside = F.col("_r") <= F.col("k")
    out = ranked.groupBy("k").agg(F.count_if(inside).alias("selected"), F.count_if(inside & (F.col(label) == 1)).alias("positives"), F.sum(label).alias("all_positives"))
    return out.select("k", "selected", "positives", safe_ratio(F.col("positives"), F.col("selected")).alias("precision"), safe_ratio(F.col("positives"), F.col("all_positives")).alias("row_recall"))


def _through(scores: DataFrame, score: str, label: str | None, parts: int = 256) -> DataFrame:
    """(score, c, hit, through, hits, lower): rows and positives of each distinct score, from the highest down, and the next lower score.

    Scores are dealt by quantiles; only the sums of at most ``parts`` + 1 ranges are put in one order.
    """
    hit = F.sum(F.col(label).cast("long")) if label else F.lit(0).cast("long")
    counts = scores.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("c"), hit.alias("hit"))
    edges = counts.agg(F.percentile_approx(score, [i / parts for i in range(1, parts)], 10 * parts).alias("_e"))  # one row
    dealt = counts.join(F.broadcast(edges)).withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col(score)))).drop("_e")
    order = Window.orderBy(F.col("_b").desc())  # the ranges alone
    sums = dealt.groupBy("_b").agg(F.sum("c").alias("_c"), F.sum("hit").alias("_h"), F.max(score).alias("_m"))
    sums = sums.select("_b", (F.sum("_c").over(order) - F.col("_c")).alias("_above"), (F.sum("_h").over(order) - F.col("_h")).alias("_hits"), F.lead("_m").over(order).alias("_below"))
    down = Window.partitionBy("_b").orderBy(F.col(score).desc())
    rows = dealt.join(F.broadcast(sums), "_b")
    return rows.select(score, "c", "hit", (F.col("_above") + F.sum("c").over(down)).alias("through"), (F.col("_hits") + F.sum("hit").over(down)).alias("hits"), F.coalesce(F.lead(score).over(down), "_below").alias("lower"))


def threshold_for(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The threshold that alerts about n rows without cutting a group of ties: the middle between the last kept and the next lower score."""
    cut = _through(scores, score, None).where((F.col("through") >= n) & (F.col("through") - F.col("c") < n))
    return cut.select(F.coalesce((F.col(score) + F.col("lower")) / 2, F.col(score)).alias("threshold"), F.col("through").alias("alerts"))


def threshold_curve(scores: DataFrame, wanted: tuple[int, ...], score: str = "score", label: str = "label") -> DataFrame:
    """(wanted, threshold, alerts, tp, positives, precision, recall, f1) at the thresholds for several numbers of alerts, in one pass; a number beyond all rows gives no row."""
    n = F.filter(F.array(*map(F.lit, wanted)), lambda x: (x <= F.col("through")) & (x > F.col("through") - F.col("c")))
    cuts = _through(scores, score, label).withColumn("wanted", F.explode(n))
    every = scores.agg(F.sum(F.col(label).cast("long")).alias("positives"))
    out = cuts.join(F.broadcast(every)).select("wanted", F.coalesce((F.col(score) + F.col("lower")) / 2, F.col(score)).alias("threshold"), F.col("through").alias("alerts"), F.col("hits").alias("tp"), "positives")
    out = out.withColumns({"precision": safe_ratio(F.col("tp"), F.col("alerts")), "recall": safe_ratio(F.col("tp"), F.col("positives"))})
    return out.withColumn("f1", f_beta(F.col("precision"), F.col("recall")))


def alert_counts(n: int, steps: int = 60, least: int = 20, most: int | None = 400_000) -> tuple[int, ...]:
    """Numbers of alerts, geometrically spaced from ``least`` to ``most`` or all rows; without ``most`` to all rows."""
    top = n if most is None else min(n, most)
    if top < 1:
        return ()
    low = min(least, top)
    return tuple(sorted({int(low * (top / low) ** (i / (steps - 1)) + 1e-9) for i in range(steps)} | {top}))


def matched_curve(scores: DataFrame, failures: DataFrame, *, key: str = "channel_id", time: str = "t", score: str = "score", low_seconds: float = 1, high_hours: float = 168, wanted: tuple[int, ...] | None = None, most: int | None = 400_000) -> DataFrame:
    """(threshold, alerts, tp, fn, fp, dup, precision, recall, f1) of alerts matched to failures, at thresholds for several numbers of alerts.

    Without ``wanted`` the numbers are those of ``alert_counts``, up to ``most``; without that, up to all rows.

    A row is an alert at a threshold that its score reaches; matching is ``match_alerts``, each threshold for itself.
    Thresholds are few, so one pass over an object's rows in order does all of them: an alert that no failure has
    taken carries a bit for each threshold that still may use it, and a failure takes, from the latest alert back,
    the bits that it lacks.  An alert's window does not hang on the threshold, so false alerts add up by level.
    A task puts out sums, a row a threshold.  Ties of a score are never cut.
    """
    scored = scores.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(score).isNotNull())
    wanted = alert_counts(scored.count(), most=most) if wanted is None else wanted
    cuts = threshold_for_each(scored, wanted, score)
    levels = sorted({r["threshold"] for r in cuts.collect()}, reverse=True)  # as many as numbers wanted
    low, span = int(low_seconds * 1e6), int(high_hours * 3.6e9) - int(low_seconds * 1e6)
    rows = lambda df, shift, level: df.select(key, (F.unix_micros(F.col(time).cast("timestamp")) + shift).alias("at"), level.alias("level"))
    level = F.size(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<double>"), lambda x: x > F.col(score)))
    alerts = rows(scored, low, level).where(F.col("level") < len(levels))
    both = alerts.unionByName(rows(failures.where(F.col(key).isNotNull() & F.col(time).isNotNull()), 0, F.lit(-1)))
    every = (1 << len(levels)) - 1

    def match(batches):
        held, ready, fresh, n_failures = None, [], [], 0
        alerts, false, taken = [0] * len(levels), [0] * len(levels), {}
        for batch in batches:
            for k, at, of in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != held:
                    for _, x in fresh:
                        false[x] += 1
                    held, ready, fresh = k, [], []
                if of >= 0:
                    alerts[of] += 1
                    ready.append([at, every >> of << of])  # thresholds at and below the alert's own
                    fresh.append((at, of))
                    continue
                n_failures += 1
                for x, y in fresh:
                    false[y] += x < at - span
                fresh, need = [], every
                ready = [a for a in ready if a[0] >= at - span and a[1]]
                for a in reversed(ready):
                    got = need & a[1]
                    a[1] ^= got
                    need ^= got
                    if not need:
                        break
                if got := every ^ need:
                    taken[got] = taken.get(got, 0) + 1
        for _, x in fresh:
            false[x] += 1
        hits = [sum(n for bits, n in taken.items() if bits >> i & 1) for i in range(len(levels))]
        columns = [list(range(len(levels))), list(accumulate(alerts)), list(accumulate(false)), hits, [n_failures] * len(levels)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "alerts", "fp", "tp", "failures"])

    if not levels:
        levels, every = [0.0], 1  # no alerts: the empty threshold's row alone
    dealt = both.repartition(key).sortWithinPartitions(key, "at", F.col("level") == -1)
    sums = dealt.mapInArrow(match, "place bigint, alerts bigint, fp bigint, tp bigint, failures bigint").groupBy("place").agg(*[F.sum(c).alias(c) for c in ("alerts", "fp", "tp", "failures")])
    out = sums.withColumn("threshold", F.get(F.array(*[F.lit(x) for x in levels]).cast("array<double>"), F.col("place")))
    out = out.withColumns({"fn": F.col("failures") - F.col("tp"), "dup": F.col("alerts") - F.col("fp") - F.col("tp")})
    out = out.withColumns({"precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_ratio(F.col("tp"), F.col("failures"))})
    return out.withColumn("f1", f_beta(F.col("precision"), F.col("recall"))).select("threshold", "alerts", "tp", "fn", "fp", "dup", "precision", "recall", "f1")


def threshold_for_each(scores: DataFrame, wanted: tuple[int, ...], score: str = "score") -> DataFrame:
    """``threshold_for`` for several numbers of alerts at once: (wanted, threshold, alerts)."""
    n = F.filter(F.array(*map(F.lit, wanted)).cast("array<long>"), lambda x: (x <= F.col("through")) & (x > F.col("through") - F.col("c")))
    cuts = _through(scores, score, None).withColumn("wanted", F.explode(n))
    return cuts.select("wanted", F.coalesce((F.col(score) + F.col("lower")) / 2, F.col(score)).cast("double").alias("threshold"), F.col("through").alias("alerts"))


def choose_thresholds(curve: DataFrame, times: int = 10) -> DataFrame:
    """(high, watch) of a matched curve: best F1 (then precision, then fewer alerts, then the higher threshold), and among thresholds no higher the one whose alerts come closest to ``times`` as many (the higher of equals)."""
    best = F.struct("f1", "precision", -F.col("alerts"), "threshold")
    high = curve.agg(F.max_by("threshold", best).alias("high"), F.max_by("alerts", best).alias("_n"))
    rest = curve.join(F.broadcast(high)).where(F.col("threshold") <= F.col("high"))  # one row
    return rest.groupBy("high").agg(F.min_by("threshold", F.struct(F.abs(F.col("alerts") - times * F.col("_n")), -F.col("threshold"))).alias("watch"))


def share_later(matched: DataFrame, hours: float) -> DataFrame:
    """Share of caught failures whose lead is strictly longer than the reaction time."""
    return matched.select(F.explode("leads").alias("lead")).agg(F.avg((F.col("lead") > hours).cast("double")).alias("share"))


def section_to_collector(forecasts: DataFrame, mapping: DataFrame, threshold: float) -> DataFrame:
    """Highest section probability of a collector and snapshot, above the threshold."""
    best = forecasts.join(mapping.select("section_id", "collector"), "section_id").groupBy("collector", "as_of").agg(F.max("probability").alias("probability"))
    return best.where(F.col("probability") > threshold)


def recall_ceiling(moments: DataFrame, failures: DataFrame, hours: float, key: str = "channel_id", time: str = "t") -> DataFrame:
    """(failures, reachable, ceiling): failures with a decision moment of their channel at most ``hours`` before them, and their share."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    both = moments.select(key, at.alias("t"), at.alias("m"), F.lit(0).alias("f")).unionByName(failures.select(key, at.alias("t"), F.lit(None).cast("long").alias("m"), F.lit(1).alias("f")))
    before = Window.partitionBy(key).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.col("t") - F.max("m").over(before) <= int(hours * 3.6e9), F.lit(False))
    seen = both.withColumn("ok", reached).where("f = 1")
    return seen.agg(F.count("*").alias("failures"), F.count_if("ok").alias("reachable")).withColumn("ceiling", safe_ratio(F.col("reachable"), F.col("failures")))


def definition_counters(failures: DataFrame, incidents: DataFrame, days: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, failures, incidents, days, positives, base_rate) of a failure definition.

    ``splits`` holds (split, first_day, last_day), both whole, and lays its own days out; failures and incidents
    start at ``t``, entity-days have ``day`` and the label ``y``.  A split without entity-days has no base rate.
    """
    calendar = splits.select("split", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    starts = lambda df, name: df.select(F.to_date("t").alias("day")).join(calendar, "day").groupBy("split").agg(F.count("*").alias(name))
    rows = days.join(calendar, "day").groupBy("split").agg(F.count("*").alias("days"), F.sum(F.col("y").cast("long")).alias("positives"))
    out = splits.select("split")
    for part in (starts(failures, "failures"), starts(incidents, "incidents"), rows):
        out = out.join(part, "split", "left")
    return out.fillna(0, ["failures", "incidents", "days", "positives"]).withColumn("base_rate", F.col("positives") / F.nullif("days", F.lit(0)))
