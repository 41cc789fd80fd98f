"""Running sums and maxima by key, without sliding frames and without a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length of a piece of time: a key's rows are dealt by it, and only a row a piece is put in one order.
PIECE_US = 6 * 3_600_000_000


def running(asked: DataFrame, marks: DataFrame, key: str, sums: tuple[str, ...] = (), maxima: tuple[str, ...] = (), piece_us: int = PIECE_US) -> DataFrame:
    """(key, _us, sums, maxima) for each (key, _us) asked: of the key's marks at or before that microsecond, 0 and null where there are none.

    ``asked`` holds distinct pairs.  Sums are of whole numbers.  A piece's rows are summed in one task by a growing frame, the
    pieces before it come as one row, so work grows with rows and hangs on no key's size.
    """
    folded = marks.groupBy(key, "_us").agg(*[F.sum(c).cast("long").alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
    piece = F.floor(F.col("_us") / piece_us).alias("_piece")
    both = asked.select(key, "_us", F.lit(True).alias("_ask")).unionByName(folded.withColumn("_ask", F.lit(False)), allowMissingColumns=True).select("*", piece)
    totals = folded.select("*", piece).groupBy(key, "_piece").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
    # pieces that are only asked for need what came before them too
    totals = totals.unionByName(asked.select(key, piece).distinct(), allowMissingColumns=True).groupBy(key, "_piece").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_piece", *[F.sum(c).over(before).alias(f"_before_{c}") for c in sums], *[F.max(c).over(before).alias(f"_before_{c}") for c in maxima])
    inside = Window.partitionBy(key, "_piece").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    own = both.select(key, "_us", "_piece", "_ask", *[F.sum(c).over(inside).alias(c) for c in sums], *[F.max(c).over(inside).alias(c) for c in maxima]).where("_ask")
    out = own.join(carried, [key, "_piece"], "left")
    value = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"_before_{c}", F.lit(0))).cast("long").alias(c) for c in sums]
    return out.select(key, "_us", *value, *[F.greatest(c, f"_before_{c}").alias(c) for c in maxima])
