"""Mixing sources to target weights by exponential sampling keys.

A source's target is its weighted share of the whole budget, stopped at ``max_repeats`` times its size.
A target of several times the size takes every document that often (complete epochs); the rest is a
fraction drawn without replacement: document i gets the key -ln(u_i) / quality_i, with u_i a hash of its
id, and documents are taken in key order until their sizes reach the rest (Efraimidis and Spirakis).

The prefix sum inside a source runs in two levels, so no source is sorted in one task: keys fall into
buckets of about ``rows_per_bucket`` rows, bucket totals are summed along each source, and rows are
ordered inside their bucket only.  Buckets are quantiles of the keys: keys of quality q are exponential with
rate q, so the share of each quality in the corpus gives the distribution of all keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, text_or_empty

SPACES = ["\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d"]


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null and empty text have none."""
    pieces = F.size(F.split(text, f"{SPACE_CLASS}+", -1))
    edge = lambda c: c.isin(SPACES).cast("int")
    counted = pieces - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(counted).cast("long")


def quality_weight(n_chars: Column, size: Column) -> Column:
    """1 where the mean length of a word with its space is that of prose (4 to 9), else 1/4."""
    mean = n_chars / F.greatest(size, F.lit(1))
    return F.when((mean >= 4) & (mean <= 9), F.lit(1.0)).otherwise(F.lit(0.25))


def uniform(col: str) -> Column:
    """A uniform number inside (0, 1) from the MD5 of the value's text; null counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, weight) -> the same with target.

    Shares stopped at max_repeats times the size hand their excess to the others by weight.  Sources are
    ordered by the level at which they fill up; with the first k full the others stand at
    (total - their caps) / (their weights), and the final level is the highest of these.  The table has a
    row per source, so its one-partition window does not grow with documents.
    """
    cap = F.lit(max_repeats) * F.col("source_size")
    order = Window.orderBy(cap / F.col("weight"), F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum(cap).over(before), F.lit(0))
    gone = F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - filled).cast("double") / (F.sum("weight").over(whole) - gone).cast("double")
    leveled = sizes.withColumn("level", level)
    leveled = leveled.withColumn("level", F.max("level").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return leveled.withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight"))).drop("level")


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights 1, 2, 3, repeating over sources in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w).cast("long") for w in cycle])
    return sizes.withColumn("weight", F.element_at(weights, (place % len(cycle) + 1).cast("int")))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = 3,
    rows_per_bucket: int = 2048,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``weights`` has (source, weight) with positive whole weights for every source; None weighs sources
    1, 2, 3 in turn.  Null source is a source of its own, last in order.  Null or empty text has size 0 and
    is never drawn; a source without words has target 0.  Rows of equal id share a key and are ordered by size;
    rows equal in both are interchangeable.  A table without rows gives none.  Other columns are ignored.
    """
    size = word_count(F.col("t"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_or_empty(text_col).alias("t"))
    rows = rows.select("doc_id", "source", F.length("t").alias("chars"), size.alias("size"))
    rows = rows.withColumn("quality", quality_weight(F.col("chars"), F.col("size"))).drop("chars")
    rows = cut(rows.withColumn("key", -F.log(uniform("doc_id")) / F.col("quality")))
    # a row for each of the two qualities
    counts = sorted((r.quality, r["count"]) for r in rows.groupBy("quality").count().collect())
    n = max(1, sum(c for _, c in counts))
    buckets = -(-n // rows_per_bucket)
    below = sum((F.lit(c / n) * (1 - F.exp(-q * F.col("key"))) for q, c in counts), F.lit(0.0))
    part = F.least(F.floor(below * buckets), F.lit(buckets - 1)).cast("long")
    rows = rows.drop("quality")
    rows = rows.withColumn("bucket", part).withColumn("nameless", F.col("source").isNull()).withColumn("src", F.coalesce("source", F.lit("")))
    totals = cut(rows.groupBy("src", "nameless", "bucket").agg(F.sum("size").alias("total")))
    sizes = totals.groupBy("src", "nameless").agg(F.sum("total").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("nameless"), F.col("src")).alias("source"), "source_size")
    sizes = cyclic_weights(sizes) if weights is None else sizes.join(weights.select(F.col("source").alias("ws"), "weight"), F.expr("source <=> ws"), "left").drop("ws")
    targets = source_targets(sizes, max_repeats)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = targets.select(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("nameless"), "source_size", "target", "epochs", "rest")
    along = Window.partitionBy("src", "nameless").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("before", F.coalesce(F.sum("total").over(along), F.lit(0))).drop("total").join(targets, ["src", "nameless"])
    inside = Window.partitionBy("src", "nameless", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(placed, ["src", "nameless", "bucket"]).withColumn("prefix", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    drawn = (2 * F.col("prefix") + F.col("size")).cast("double") <= 2 * F.col("rest")
    copies = F.col("epochs") + (drawn & (F.col("size") > 0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
