"""Daily rollups that are kept up to date: a batch recomputes the days it touches and replaces these alone.

The raw table is partitioned by day and batch, the rollup by day.  A batch is written first; the days of its rows are
then read anew, whole, and their rollup partitions are overwritten one by one (dynamic partition overwrite).  So late
rows change just their own days, and a batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

#: Touched days that one list of literals may name; beyond it the days are joined.
LISTED = 4000


def _put(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def touched_days(batch: DataFrame, time: str = "read_time") -> list[date]:
    """Days of a batch's rows: one for each day of the calendar at most."""
    return [r["day"] for r in batch.where(F.col(time).isNotNull()).select(F.to_date(time).alias("day")).distinct().orderBy("day").collect()]


def of_days(table: DataFrame, days: list[date]) -> DataFrame:
    """The table's partitions of these days: literals prune the listing of files, a join prunes at run time."""
    if len(days) <= LISTED:
        return table.where(F.col("day").isin(*days)) if days else table.where(F.lit(False))
    wanted = table.sparkSession.createDataFrame([(d,) for d in days], "day date")
    return table.join(wanted, "day", "left_semi")


def refresh_days(raw: DataFrame, rollup: Callable[[DataFrame], DataFrame], target: str, days: list[date]) -> None:
    """Recompute ``days`` of a rollup from the raw table and replace their partitions.

    ``rollup`` maps raw rows to rows with ``day``, each from its own day's rows.  A day of which the raw table holds no
    row keeps its old partition, as an overwrite of nothing replaces nothing; the raw table only gains rows.
    """
    if days:
        # one task group a day: each partition of the target gets as few files as its rows need
        _put(rollup(of_days(raw, days)).repartition("day"), target, "day")


def maintained_rollup(raw: str, target: str, rollup: Callable[[DataFrame], DataFrame], time: str = "read_time", keys: tuple[str, ...] = ("journal_id", "read_time")) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps ``raw`` (all rows by day and batch) and ``target`` (their rollup by day).

    A row seen before by ``keys``, in this batch or an earlier one, counts once: only the touched days are looked up.
    Rows without a time are left out.  Run again with the same batch number, it leaves the same tables.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(time).isNotNull()).withColumn("day", F.to_date(time)).dropDuplicates(list(keys))
        days = touched_days(rows, time)
        if not days:
            return
        shape = StructType([*[f for f in rows.schema.fields if f.name != "day"], StructField("day", DateType()), StructField("batch_id", LongType())])
        # a later run's rows must not hide those that an earlier batch holds already: only other, earlier batches count
        _put(rows.withColumn("batch_id", F.lit(batch_id).cast("long")), raw, "day", "batch_id")
        every = of_days(spark.read.schema(shape).parquet(raw), days)
        first = every.groupBy(*keys).agg(F.min("batch_id").alias("batch_id"))
        refresh_days(every.join(first, [*keys, "batch_id"], "left_semi").drop("batch_id"), rollup, target, days)

    return put
