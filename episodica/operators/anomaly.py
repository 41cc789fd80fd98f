"""Sensor anomalies, signal fusion, criticality and payback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import parse_number


def outlier_labels(series: DataFrame, low: float, high: float, jump: float, freeze: int, key: str = "sensor", time: str = "t", value: str = "value") -> DataFrame:
    """Label 0 good, 1 out of range, 2 jump from the last good value, 3 frozen for ``freeze`` rows or more, 4 no number.

    The base of a jump is the last number within range, whether or not it jumped itself.
    """
    w = Window.partitionBy(key).orderBy(time)
    number = parse_number(F.col(value))
    rows = series.withColumn("x", number)
    inside = F.col("x").between(low, high)
    base = F.last(F.when(inside, F.col("x")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_base": base, "_new": (~F.col("x").eqNullSafe(F.lag("x").over(w))).cast("int")})
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_len", F.count("*").over(Window.partitionBy(key, "_run")))
    label = F.when(F.col("x").isNull(), 4).when(~inside, 1).when(F.col("_len") >= freeze, 3).when(F.abs(F.col("x") - F.col("_base")) > jump, 2).otherwise(0)
    return rows.withColumn("label", label).drop("x", "_base", "_new", "_run", "_len")


def absolute_finding(temp: Column, setpoint: Column, side: str = "high", warn_share: float = 0.9) -> Column:
    if side == "high":
        return F.when(temp >= setpoint, "alarm").when(temp >= warn_share * setpoint, "warn").otherwise("none")
    return F.when(temp <= setpoint, "alarm").otherwise("none")


def band_finding(temps: DataFrame, key: str = "element", condition: str = "condition", least: int = 10, warn: float = 3, alarm: float = 4) -> DataFrame:
    """Deviation from the element's mean in its condition bucket, in population sigmas; needs enough points and sigma > 0."""
    w = Window.partitionBy(key, condition)
    n, s = F.count("temp").over(w), F.stddev_pop("temp").over(w)
    z = F.when((n >= least) & (s > 0), F.abs(F.col("temp") - F.avg("temp").over(w)) / s)
    return temps.withColumn("z", z).withColumn("band", F.when(F.col("z") >= alarm, "alarm").when(F.col("z") >= warn, "warn").otherwise("none"))


def peer_finding(temps: DataFrame, peer: list[str], key: str = "element", warn: float = 5, alarm: float = 10, least: int = 2) -> DataFrame:
    """Difference to the median of the other elements of a peer group at one time; groups are elements of one kind at one moment.

    Without itself, the middle of a group's sorted temperatures lies at most one place off: each row needs the
    few middle values of its group and its own place, and no row carries its group.
    """
    w = Window.partitionBy(*peer).orderBy("temp", key)
    ranked = temps.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*peer)) - 1})
    # places of the lower and upper median among the others are floor((n - 1) / 2) and floor(n / 2) of n others
    middle = ranked.where(F.col("_i").between(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2) + 1))
    middle = middle.groupBy(*peer).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_i").cast("int"), "temp"))).alias("_m"))
    rows = ranked.join(middle, peer, "left")
    others = lambda place: F.try_element_at("_m", F.when(place >= F.col("_i"), place + 1).otherwise(place).cast("int"))
    median = (others(F.floor((F.col("_n") - 1) / 2)) + others(F.floor(F.col("_n") / 2))) / 2
    rows = rows.withColumn("delta", F.when(F.col("_n") >= least, F.col("temp") - median))
    return rows.withColumn("peers", F.when(F.col("delta") >= alarm, "alarm").when(F.col("delta") >= warn, "warn").otherwise("none")).drop("_m", "_i", "_n")


def trend_finding(temps: DataFrame, key: str = "element", kind: str = "kind", rate: float = 0.2, times: float = 2.0, peer_seconds: int = 3600, tie: str | None = None) -> DataFrame:
    """Degrees an hour since the element's last reading; a warning at ``rate`` and ``times`` a base above zero.

    Bases are the mean rate of the other elements of its kind in the same ``peer_seconds``, and of the element's
    own earlier readings; later rows never count.  ``tie`` orders readings of one time.
    """
    w = Window.partitionBy(key).orderBy("t", *([tie] if tie else []))
    hours = (F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.lag("t").over(w).cast("timestamp"))) / 3.6e9
    rows = temps.withColumn("rate", (F.col("temp") - F.lag("temp").over(w)) / F.nullif(hours, F.lit(0.0)))
    rows = rows.withColumns({"_past": F.avg("rate").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_b": F.floor(F.unix_micros(F.col("t").cast("timestamp")) / (peer_seconds * 1_000_000))})
    own = rows.groupBy(key, kind, "_b").agg(F.sum("rate").alias("_s"), F.count("rate").alias("_n"))
    all_ = own.groupBy(kind, "_b").agg(F.sum("_s").alias("_as"), F.sum("_n").alias("_an"))
    peers = own.join(all_, [kind, "_b"]).select(key, kind, "_b", ((F.col("_as") - F.coalesce("_s", F.lit(0.0))) / F.nullif(F.col("_an") - F.col("_n"), F.lit(0))).alias("_peer"))
    rows = rows.join(peers, [key, kind, "_b"], "left")
    beats = lambda base: F.coalesce((F.col(base) > 0) & (F.col("rate") >= times * F.col(base)), F.lit(False))
    hot = (F.col("rate") >= rate) & (beats("_peer") | beats("_past"))
    return rows.withColumn("trend", F.when(hot, "warn").otherwise("none")).drop("_past", "_b", "_peer")


def worst_finding(*findings: Column) -> Column:
    rank = lambda f: F.when(f == "alarm", 2).when(f == "warn", 1).otherwise(0)
    top = F.greatest(*[rank(f) for f in findings]) if len(findings) > 1 else rank(findings[0])
    return F.when(top == 2, "alarm").when(top == 1, "warn").otherwise("none")


def fuse_signals(signals: DataFrame, weights: DataFrame, auto: float = 0.4, least: int = 2) -> DataFrame:
    """The top class of each entity from its sources' class probabilities (entity, class, source, p), with its verdict.

    Mass of a class is the weighted sum over sources; the class of most mass is the top one, the first of equals.
    Masses, and the limit of ``auto``, are compared at nine decimals, as the order of a sum shows beyond them.
    ``confidence`` is its mass, ``score`` its mass over the weight of the sources present (``coverage``),
    ``agreement`` the number of sources whose own best class it is, ``missing`` the sources without a signal.
    """
    sources = weights.agg(F.array_sort(F.collect_list("source")).alias("sources"))
    rows = signals.join(weights, "source")
    own = rows.groupBy("entity", "source").agg(F.max("weight").alias("weight"), F.min_by("class", F.struct(-F.col("p"), "class")).alias("best"))
    cover = own.groupBy("entity").agg(F.sum("weight").alias("coverage"), F.array_sort(F.collect_set("source")).alias("have"))
    mass = rows.groupBy("entity", "class").agg(F.sum(F.col("p") * F.col("weight")).alias("mass"))
    top = mass.groupBy("entity").agg(F.min_by("class", F.struct(F.round(-F.col("mass"), 9), "class")).alias("class"), F.max("mass").alias("confidence"))
    agreed = own.join(top.select("entity", "class"), "entity").groupBy("entity").agg(F.count_if(F.col("best") == F.col("class")).alias("agreement"))
    out = top.join(cover, "entity").join(agreed, "entity").join(F.broadcast(sources))  # one row
    verdict = F.when(F.round("confidence", 9) < auto, "human_review").when(F.col("agreement") < least, "low_confidence").otherwise("auto")
    return out.select("entity", "class", (F.col("confidence") / F.col("coverage")).alias("score"), "confidence", "agreement", "coverage", F.array_except("sources", "have").alias("missing"), verdict.alias("verdict"))


def monotonicity_violations(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Subsets of an entity's sources whose confidence is above that of all its sources; sources are few (8 give 255 subsets)."""
    rows = signals.join(weights, "source").groupBy("entity", "class").agg(F.array_sort(F.collect_list(F.struct("source", "p", "weight"))).alias("s"))
    masks = F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("s")) - 1))
    each = rows.withColumn("mask", masks)
    picked = F.filter("s", lambda x, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) == 1)
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x["p"] * x["weight"])
    return each.withColumns({"part": mass(picked), "whole": mass(F.col("s"))}).where(F.col("part") > F.col("whole") + 1e-12).select("entity", "class", "mask", "part", "whole")


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("mean"))


def criticality(factors: DataFrame, edges: tuple[float, float, float] = (1.75, 2.5, 3.25)) -> DataFrame:
    """Weighted 1 to 4 score of an entity and its category I to IV (I is the most critical)."""
    out = weighted_mean(factors, ["entity"], "value", "weight").withColumnRenamed("mean", "score")
    return out.withColumn("category", F.when(F.col("score") > edges[2], "I").when(F.col("score") > edges[1], "II").when(F.col("score") > edges[0], "III").otherwise("IV"))


def risk_zone(pof: Column, cof: Column, red: float = 12.0, yellow: float = 6.0) -> Column:
    return F.when(pof * cof >= red, "red").when(pof * cof >= yellow, "yellow").otherwise("green")


def risk_matrix(rows: DataFrame, pof: str = "pof", cof: str = "cof", base_months: float = 36, min_months: float = 1, max_months: float = 60) -> DataFrame:
    """Add ``risk`` (probability x consequence, 1 to 16), ``rank`` and ``zone`` by quarters of its range, and ``inspect_months``.

    The interval is the base over the risk, to a tenth of a month (halves to the even digit), within its bounds; null or
    zero risk has none.
    """
    risk = F.col(pof) * F.col(cof)
    rank = F.when(F.col("risk") > 12, 4).when(F.col("risk") > 8, 3).when(F.col("risk") > 4, 2).when(F.col("risk").isNotNull(), 1)
    months = F.greatest(F.lit(float(min_months)), F.least(F.lit(float(max_months)), F.bround(F.lit(float(base_months)) / F.nullif(F.col("risk"), F.lit(0.0)), 1)))
    out = rows.withColumn("risk", risk.cast("double")).withColumn("rank", rank)
    zones = F.array(*map(F.lit, ("green", "yellow", "orange", "red")))
    return out.withColumn("zone", F.get(zones, F.col("rank") - 1)).withColumn("inspect_months", F.when(F.col("risk") != 0, months))


def group_scoring(marks: DataFrame, by: list[str]) -> DataFrame:
    """Sum of priority x significance x mark, its ceiling, coverage rounded up to 0.01 and the failed mandatory criteria."""
    weight = F.col("priority") * F.col("significance")
    out = marks.groupBy(*by).agg(
        F.sum(weight * F.col("mark")).alias("score"), F.sum(weight * F.col("max_mark")).alias("ceiling"),
        F.array_sort(F.collect_list(F.when(F.col("mandatory") & (F.col("mark") == 0), F.col("criterion")))).alias("failed"),
    )
    # a hair is taken off first, so that an exact hundredth is not pushed up by rounding of the division
    return out.withColumn("coverage", F.ceil(F.col("score") / F.nullif("ceiling", F.lit(0)) * 100 - 1e-9) / 100)


def payback(flows: DataFrame, by: str = "project", year: str = "year", flow: str = "flow") -> DataFrame:
    """Cumulative flow and the fractional year in which it crosses zero; null if it never does."""
    w = Window.partitionBy(by).orderBy(year)
    cum = F.sum(flow).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = flows.withColumn("cum", cum)
    before = F.lag("cum").over(w)
    crossing = F.when((before < 0) & (F.col("cum") >= 0), F.lag(year).over(w) + (-before) / F.col(flow))
    return rows.withColumn("_c", crossing).groupBy(by).agg(F.min("_c").alias("payback"), F.max_by("cum", year).alias("total"))


def compliance(rules: DataFrame, fired: DataFrame) -> DataFrame:
    """Sum of the weights of an entity's fired rules, and the hit and missed ones; weights must total 100."""
    total = F.sum("weight").over(Window.partitionBy())  # the rules are a short list
    right = F.abs(F.coalesce(total, F.lit(0.0)) - 100) <= 1e-9
    text = F.concat(F.lit("rule weights total "), total.cast("string"), F.lit(", not 100"))
    checked = rules.select("rule", F.col("weight").cast("double").alias("weight"), right.alias("right"), text.alias("text"))
    checked = checked.select("rule", F.when(F.col("right"), F.col("weight")).otherwise(F.raise_error(F.col("text")).cast("double")).alias("weight"))
    listed = checked.agg(F.collect_list(F.struct("rule", "weight")).alias("_all"))
    grid = fired.select("entity").distinct().join(F.broadcast(listed)).select("entity", F.inline("_all"))  # one row
    both = grid.join(fired.select("entity", "rule").distinct().withColumn("hit", F.lit(True)), ["entity", "rule"], "left")
    return both.groupBy("entity").agg(
        F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)).alias("percent"),
        F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("rule")))).alias("hits"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("rule")))).alias("misses"),
    )
