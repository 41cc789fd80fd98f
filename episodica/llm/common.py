"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the folder the cluster names in spark.checkpoint.dir; without one, set a local one where Spark itself is local."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))


#: Spark's setting (4.1 on) that shuffle files go when their query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rules of the adaptive optimizer that are left out, and the one that drops a join whose side turns out empty while its other side still runs.
EXCLUDED, DROPS_SIDES = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder, so a lost executor costs a re-read only.

    The shuffle files behind it go at once, for else they stay until the driver happens to collect its garbage.
    Therefore no stage may outlive the query: tasks of a dropped one would hold their cores and ask for files that are
    gone, each for two minutes and again.  So a join with an empty side waits for its other side too.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = {name: spark.conf.get(name, None) for name in (CLEANUP, EXCLUDED)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(EXCLUDED, ",".join(x for x in (before[EXCLUDED], DROPS_SIDES) if x))
    try:
        # a query takes the first setting when it is made, the second while it runs
        return df.select("*").checkpoint(eager=True)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
