"""Censored lifetimes: Kaplan-Meier, Weibull fits for all groups at once by distributed Newton steps, predictability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import gamma
from ..functions.steps import cut


def lifetimes(failures: DataFrame, key: str, start: str, data_end) -> DataFrame:
    """(key, ttf days, failed): gaps between a key's failures, the last one censored at the data's end."""
    w = Window.partitionBy(key).orderBy(start)
    later = F.lead(start).over(w)
    days = (F.unix_micros(F.coalesce(later, data_end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 8.64e10
    return failures.select(key, days.alias("ttf"), later.isNotNull().cast("int").alias("failed")).where("ttf > 0")


def kaplan_meier(lives: DataFrame, group: str = "grp") -> DataFrame:
    """(group, t, at_risk, events, survival) at the times with failures."""
    at = lives.groupBy(group, F.col("ttf").alias("t")).agg(F.sum("failed").alias("events"), F.count("*").alias("left"))
    back = Window.partitionBy(group).orderBy(F.col("t").desc())
    steps = at.withColumn("at_risk", F.sum("left").over(back)).where("events > 0")
    ahead = Window.partitionBy(group).orderBy("t")
    ratio = 1 - F.col("events") / F.col("at_risk")
    dead = F.max((ratio <= 0).cast("int")).over(ahead)
    logs = F.sum(F.when(ratio > 0, F.log(ratio)).otherwise(0.0)).over(ahead)
    return steps.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(logs))).select(group, "t", "at_risk", "events", "survival")


def survival_at(curve: DataFrame, moments: DataFrame, group: str = "grp") -> DataFrame:
    """Survival of the last step at or before each (group, t); 1 before the first."""
    both = curve.select(group, "t", F.col("survival").alias("_s")).unionByName(moments.select(group, "t").withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("survival", F.coalesce(F.min("_s").over(w), F.lit(1.0))).where("_ask").select(group, "t", "survival")


#: Groups whose parameters are few enough to travel to every task; more are joined by shuffle.
FEW_GROUPS = 100_000
#: Betas that one pass asks for while the bracket is wide, and passes that do so.
GRID, GRIDS = 24, 2


def weibull(lives: DataFrame, group: str = "grp", rounds: int = 60, low: float = 0.05, high: float = 20.0, close: float = 1e-6) -> DataFrame:
    """(group, n, failures, beta, eta, mean_life): censored maximum likelihood, by Newton's steps on beta for every group jointly.

    Lives are compressed to counts by (group, t).  A round is one aggregate over them with the small table of current
    betas joined in: partial sums by task, so a group of any size costs a row a task.  The first rounds ask at many
    betas at once, which brackets the answer; then come Newton's steps, and a step that leaves the bracket becomes its
    middle.  A group is done when a step is below ``close`` of its beta, which leaves an error of the square's order.
    Betas end at ``low`` or ``high`` where the likelihood still rises there (equal lives).
    Groups with fewer than two failures, or with null or non-positive lives alone, get null.
    """
    named = {"_group": F.coalesce(F.col(group).cast("string"), F.lit("")), "_null": F.col(group).isNull()}
    key = list(named)
    kept = cut(lives.where((F.col("ttf") > 0) & F.col("failed").isNotNull()).groupBy(group, "ttf").agg(F.count("*").alias("n"), F.sum("failed").alias("d")).withColumns(named))
    names = kept.groupBy(group, *key).agg(F.sum("n").alias("n"), F.sum("d").alias("failures"), F.max("ttf").alias("_max"), F.sum(F.col("d") * F.log("ttf")).alias("_logs"))
    names = cut(names.withColumn("_ml", F.col("_logs") / F.nullif("failures", F.lit(0)) - F.log("_max")))
    few = names.count() <= FEW_GROUPS
    given = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    # t over its group's maximum keeps powers in range
    counted = kept.join(given(names.where("failures >= 2").select(*key, "_max")), key).select(*key, F.log(F.col("ttf") / F.col("_max")).alias("l"), F.col("n").cast("double").alias("n"))
    state = names.where("failures >= 2").select(*key, "_ml", F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(1.0).alias("b"), F.lit(False).alias("done"))

    def slope_of(b: Column, s0: Column, s1: Column) -> Column:
        """Of the profile likelihood, negated, it rises in b: sum t^b ln t / sum t^b - 1/b - mean ln t of failures."""
        return s1 / s0 - 1 / b - F.col("_ml")

    def bracketed(now: DataFrame) -> DataFrame:
        """The two neighbours of GRID betas between which the slope changes its sign."""
        points = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda k: F.col("lo") * F.pow(F.col("hi") / F.col("lo"), k / (GRID - 1)))
        asked = now.where("not done").select(*key, "_ml", F.explode(points).alias("b"))
        power = F.col("n") * F.exp(F.col("b") * F.col("l"))
        by = counted.join(given(asked), key).groupBy(*key, "_ml", "b").agg(F.sum(power).alias("s0"), F.sum(power * F.col("l")).alias("s1"))
        g = slope_of(F.col("b"), F.col("s0"), F.col("s1"))
        both = now.join(by.groupBy(*key).agg(F.max(F.when(g < 0, F.col("b"))).alias("_below"), F.min(F.when(g >= 0, F.col("b"))).alias("_above")), key, "left")
        below, above = F.col("_below"), F.col("_above")
        ends = F.col("done") | below.isNull() | above.isNull()
        b = F.when(F.col("done"), F.col("b")).when(below.isNull(), F.col("lo")).when(above.isNull(), F.col("hi")).otherwise(F.sqrt(below * above))
        return both.select(*key, "_ml", *[F.when(ends, F.col(c)).otherwise(v).alias(c) for c, v in (("lo", below), ("hi", above))], b.alias("b"), ends.alias("done"))

    def stepped(now: DataFrame) -> DataFrame:
        power = F.col("n") * F.exp(F.col("b") * F.col("l"))
        by = counted.join(given(now.where("not done").select(*key, "b")), key).groupBy(*key).agg(F.sum(power).alias("s0"), F.sum(power * F.col("l")).alias("s1"), F.sum(power * F.col("l") * F.col("l")).alias("s2"))
        both = now.join(by, key, "left").withColumn("g", slope_of(F.col("b"), F.col("s0"), F.col("s1")))
        rise = F.col("s2") / F.col("s0") - F.pow(F.col("s1") / F.col("s0"), 2) + 1 / F.pow("b", 2)
        lo, hi, step = F.when(F.col("g") < 0, F.col("b")).otherwise(F.col("lo")), F.when(F.col("g") >= 0, F.col("b")).otherwise(F.col("hi")), F.col("b") - F.col("g") / rise
        both = both.withColumns({"_lo": lo, "_hi": hi, "_step": step})
        new = F.when((F.col("_step") >= F.col("_lo")) & (F.col("_step") <= F.col("_hi")), F.col("_step")).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        moved = {"lo": F.col("_lo"), "hi": F.col("_hi"), "b": new, "done": F.abs(new - F.col("b")) <= close * F.col("b")}
        return both.select(*key, "_ml", *[F.when(F.col("done"), F.col(c)).otherwise(v).alias(c) for c, v in moved.items()])

    for number in range(rounds):
        state = cut((bracketed if number < GRIDS else stepped)(state))
        if number >= GRIDS and state.where("not done").isEmpty():
            break
    total = counted.join(given(state.select(*key, "b")), key).groupBy(*key, "b").agg(F.sum(F.col("n") * F.exp(F.col("b") * F.col("l"))).alias("_total"))
    found = names.join(total, key, "left").withColumn("beta", F.col("b")).withColumn("eta", F.col("_max") * F.pow(F.col("_total") / F.col("failures"), 1 / F.col("beta")))
    # gamma(1 + 1/b) = gamma(2 + 1/b) / (1 + 1/b) keeps the argument away from small values
    mean = F.col("eta") * gamma(2 + 1 / F.col("beta")) / (1 + 1 / F.col("beta"))
    return found.select(group, "n", "failures", "beta", "eta", mean.alias("mean_life"))


def conditional_failure(fits: DataFrame, age: str, ahead: str) -> DataFrame:
    """Chance to fail within ``ahead`` having lived ``age``."""
    h = lambda t: F.pow(t / F.col("eta"), F.col("beta"))
    return fits.withColumn("p_fail", 1 - F.exp(h(F.col(age)) - h(F.col(age) + F.col(ahead))))


def predictability(lives: DataFrame, group: str = "grp") -> DataFrame:
    """k = (1 - cv^2) / (1 + cv^2) over failures alone; null below two."""
    out = lives.where("failed = 1").groupBy(group).agg(F.count("*").alias("failures"), F.avg("ttf").alias("_m"), F.stddev_pop("ttf").alias("_s"))
    cv2 = F.pow(F.col("_s") / F.col("_m"), 2)
    return out.select(group, "failures", F.when(F.col("failures") >= 2, (1 - cv2) / (1 + cv2)).alias("k"))


def life_verdict(fits: DataFrame, k: DataFrame, group: str = "grp") -> DataFrame:
    """chatter (k < 0), else early, random or wear by beta, and whether replacement by age pays (k >= 0.5 and wear)."""
    out = fits.join(k.select(group, "k"), group, "left")
    kind = F.when(F.col("k") < 0, "chatter").when(F.col("beta") < 0.9, "early").when(F.col("beta") <= 1.1, "random").when(F.col("beta").isNotNull(), "wear")
    return out.withColumn("verdict", kind).withColumn("by_age", F.coalesce((F.col("verdict") == "wear") & (F.col("k") >= 0.5), F.lit(False)))


def expected_hazard(days: DataFrame, beta: float, eta_days: float, age: str = "age_days", overdue: str = "overdue", multiplier: float = 2.0) -> DataFrame:
    """1 - exp(-M * dH) of each entity-day, M raised while a check is overdue."""
    h = lambda t: F.pow(t / eta_days, F.lit(beta))
    m = F.when(F.col(overdue), multiplier).otherwise(1.0)
    return days.withColumn("hazard", 1 - F.exp(-m * (h(F.col(age) + 1) - h(F.col(age)))))
