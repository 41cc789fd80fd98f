"""Structured Streaming versions of ingestion, rollups, episodes and alert state."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, LongType, StructField, StructType


# state processors travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def accept_readings(stream: DataFrame, channels: DataFrame, late: str = "2 days") -> DataFrame:
    """Readings once each by (journal_id, read_time) within the watermark, with ``known``: the channel is in the dictionary."""
    once = stream.withWatermark("read_time", late).dropDuplicatesWithinWatermark(["journal_id", "read_time"])
    return once.join(channels.select("channel_id", F.lit(True).alias("known")), "channel_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def accept_external(stream: DataFrame, sections: DataFrame, kinds: tuple[str, ...], late: str = "2 days", key: str = "source_id") -> DataFrame:
    """External events of the known kinds whose section exists, once each by ``key`` within the watermark."""
    once = stream.where(F.col("kind").isin(*kinds)).withWatermark("read_time", late).dropDuplicatesWithinWatermark([key])
    return once.join(sections.select("section_id").distinct(), "section_id", "left_semi")


def ingest_batches(channels: DataFrame, target: str, report: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: append fresh known readings, and one row of counters per batch.

    It is idempotent: a batch that is run again replaces its own partitions.  The target is partitioned by day
    and batch, and a batch reads only the days between its own first and last.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.join(channels.select("channel_id", F.lit(True).alias("known")), "channel_id", "left")
        once = rows.where("known").drop("known").dropDuplicates(["journal_id", "read_time"]).withColumn("day", F.to_date("read_time"))
        folder = spark._jvm.org.apache.hadoop.fs.Path(target)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            first, last = once.agg(F.min("day"), F.max("day")).first()
            old = spark.read.schema(StructType([*once.schema.fields, StructField("batch_id", LongType())])).parquet(target)
            old = old.where(F.col("day").between(F.lit(first), F.lit(last)) & (F.col("batch_id") != batch_id))
            once = once.join(old.select("journal_id", "read_time"), ["journal_id", "read_time"], "left_anti")
        write = lambda df, path, *by: df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(path)
        write(once, target, "day")
        accepted = spark.read.schema(StructType([StructField("day", DateType()), StructField("batch_id", LongType())])).parquet(target).where(F.col("batch_id") == batch_id)
        counts = rows.agg(F.count("*").alias("received"), F.count_if(F.col("known").isNull()).alias("unknown"))
        counts = counts.join(accepted.agg(F.count("*").alias("accepted")))  # a row each
        write(counts.withColumn("duplicates", F.col("received") - F.col("unknown") - F.col("accepted")), report)

    return put


def daily_rollup(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows, alarms and highest value by section and day; days stay open for late rows."""
    return stream.withWatermark("read_time", late).groupBy("section_id", F.window("read_time", "1 day").alias("w")).agg(
        F.count("*").alias("total"), F.count_if("is_alarm").alias("alarms"), F.max("value_num").alias("max_value")
    ).select("section_id", F.to_date("w.start").alias("day"), "total", "alarms", "max_value")


def sliding_rollup(stream: DataFrame, span: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return stream.withWatermark("read_time", late).groupBy("section_id", F.window("read_time", span, step).alias("w")).agg(F.count("*").alias("total"))


def incident_sessions(stream: DataFrame, group: str, time: str, minutes: int, late: str = "2 days") -> DataFrame:
    """Incidents as session windows; a microsecond is added as Spark's gap is exclusive and the rule's is not."""
    gap = f"{minutes * 60_000_000 + 1} microseconds"
    return stream.withWatermark(time, late).groupBy(group, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count("*").alias("events")).drop("w")


class EpisodeState(StatefulProcessor):
    """One open episode per channel; a closed one is emitted when its first good row comes.

    Rows of a channel must come in order of time across batches; inside a batch they are sorted.
    """

    def __init__(self, fault_words: tuple[str, ...]):
        self.fault_words = fault_words

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "started_us bigint, rows bigint, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["read_us", "journal_id"])
        state, out = self.open.get() if self.open.exists() else None, []
        for us, value in zip(batch.read_us, batch.value_text):
            if value in self.fault_words:
                state = (state[0], state[1] + 1, state[2]) if state else (int(us), 1, value)
            elif state:
                out.append((key[0], state[0], int(us), state[1], state[2], value))
                state = None
        if state:
            self.open.update(tuple(state))
        else:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["channel_id", "started_us", "ended_us", "rows_cnt", "fault_value", "closed_by"])

    def close(self) -> None:
        pass


EPISODE = "channel_id bigint, started_us bigint, ended_us bigint, rows_cnt bigint, fault_value string, closed_by string"


def live_episodes(stream: DataFrame, fault_words: tuple[str, ...]) -> DataFrame:
    """Closed episodes of a reading stream; state is one row per channel in failure."""
    rows = stream.select(F.col("channel_id").cast("long").alias("channel_id"), F.unix_micros(F.col("read_time").cast("timestamp")).alias("read_us"), "journal_id", "value_text")
    return rows.groupBy("channel_id").transformWithStateInPandas(EpisodeState(fault_words), EPISODE, "Append", "None")


POLICY_ROW = "key string, t_us bigint, probability double, risk_class string, reason string"


def policy_step(state: tuple | None, t: int, p: float, c: dict) -> tuple[tuple, str, str | None]:
    """One decision: state is (class, since, last logged probability, logged at); returns it with the class and the reason to log."""
    cls, since, logged, logged_at = state or (None, None, None, None)
    wanted = "high" if p >= c["threshold"] + c["hysteresis"] else "normal" if p <= c["threshold"] - c["hysteresis"] else cls or "normal"
    if cls is not None and wanted != cls and (t - since) / 6e7 < c["hold_min"]:
        wanted = cls
    why = "first" if logged_at is None else "change" if abs(p - logged) >= c["deadband"] or wanted != cls else "heartbeat" if (t - logged_at) / 6e7 >= c["heartbeat_min"] else None
    since = t if wanted != cls else since
    return (wanted, since, p if why else logged, t if why else logged_at), wanted, why


class PolicyState(StatefulProcessor):
    """Write policy per key; state is the class, its start and the last logged value."""

    def __init__(self, policy: dict):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "risk string, since bigint, logged double, logged_at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t_us", "probability"])
        state, out = tuple(self.last.get()) if self.last.exists() else None, []
        for t, p in zip(batch.t_us, batch.probability):
            state, cls, why = policy_step(state, int(t), float(p), self.policy)
            out.append((key[0], int(t), float(p), cls, why))
        self.last.update(state)
        yield pd.DataFrame(out, columns=["key", "t_us", "probability", "risk_class", "reason"])

    def close(self) -> None:
        pass


def live_policy(stream: DataFrame, policy: dict) -> DataFrame:
    """Decisions of a stream of (key, t_us, probability), logged or not."""
    return stream.groupBy("key").transformWithStateInPandas(PolicyState(policy), POLICY_ROW, "Append", "None")


class ChangeState(StatefulProcessor):
    """Emits a status only where it, or its time, differs from the last one of its key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, at_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_us", "status"], kind="stable")
        last, out = tuple(self.last.get()) if self.last.exists() else None, []
        for status, at in zip(batch.status, batch.at_us):
            if last != (status, int(at)):
                last = (status, int(at))
                out.append((key[0], *last))
        self.last.update(last)
        if out:
            yield pd.DataFrame(out, columns=["order_id", "status", "at_us"])

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame) -> DataFrame:
    return stream.groupBy("order_id").transformWithStateInPandas(ChangeState(), "order_id bigint, status string, at_us bigint", "Append", "None")


def new_alerts(stream: DataFrame, seen: list[int] | None = None) -> DataFrame:
    """Alerts of sections in scope (None: all); the checkpoint keeps what has been sent."""
    return stream if seen is None else stream.where(F.col("section_id").isin(*seen))


def silence(last_seen: DataFrame, at, norms: DataFrame) -> DataFrame:
    """Sources without data, or with a lag over their norm: (source, lag_seconds, lagging)."""
    lag = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 1e6
    out = norms.join(last_seen, "source", "left").withColumn("lag_seconds", lag)
    return out.select("source", "lag_seconds", (F.col("lag_seconds").isNull() | (F.col("lag_seconds") > F.col("norm_seconds"))).alias("lagging"))


__all__ = ["accept_readings", "daily_rollup", "incident_sessions", "ingest_batches", "live_episodes", "live_policy", "new_alerts", "policy_step", "silence", "sliding_rollup", "status_changes"]
