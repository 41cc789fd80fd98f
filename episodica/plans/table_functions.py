"""Operators as SQL table functions: ``SELECT * FROM episodes(TABLE(journal), array('error'))``.

Each takes a whole table; partitioning and order are the function's own, so a query names neither.  Rows pass one at
a time in order, and a function holds what it must of one key.  Functions that need no state in Python are SQL
functions, which Spark inlines into the caller's plan.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ..operators.risk import POLICY, policy_row

# functions travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Types by name: the analysis of a call runs where no session is, and so cannot read SQL's own names of types.
TYPES = {"bigint": LongType(), "double": DoubleType(), "string": StringType(), "timestamp": TimestampType()}


def _field(text: str) -> tuple:
    name, kind = text.split()
    return name, TYPES[kind]


def _result(table: AnalyzeArgument, key: str, order: tuple[str, ...], shape: str) -> AnalyzeResult:
    """Rows of a key together, in order; the key keeps the type that the table gives it."""
    names = {f.name: f for f in table.dataType.fields}
    missing = [c for c in (key, *order) if c not in names]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    schema = StructType([names[key], *[StructField(*_field(c)) for c in shape.split(", ")]])
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(c) for c in order])


class Episodes:
    """Runs of fault words: a run opens at its first fault and closes at the next other row; without one it is open."""

    @staticmethod
    def analyze(table: AnalyzeArgument, words: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, "channel_id", ("read_time", "journal_id"), "started_at timestamp, ended_at timestamp, rows_cnt bigint, fault_value string, closed_by string")

    def __init__(self):
        self.run, self.last = None, None

    def eval(self, row, words):
        at, value = row["read_time"], row["value_text"]
        if (at, row["journal_id"], value) == self.last:
            return  # a repeated row
        self.last = (at, row["journal_id"], value)
        if value in words:
            self.run = (*self.run[:2], self.run[2] + 1, self.run[3]) if self.run else (row["channel_id"], at, 1, value)
        elif self.run:
            channel, since, n, first = self.run
            self.run = None
            yield channel, since, at, n, first, value

    def terminate(self):
        if self.run:
            channel, since, n, first = self.run
            yield channel, since, None, n, first, None


class Policy:
    """Class and reason of every decision (key, at_us, probability): the library's write policy."""

    @staticmethod
    def analyze(table: AnalyzeArgument, threshold: AnalyzeArgument, heartbeat_min: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, "key", ("at_us", "probability"), "at_us bigint, probability double, risk_class string, reason string")

    def __init__(self):
        self.state = None

    def eval(self, row, threshold, heartbeat_min):
        c = POLICY | {"threshold": float(threshold), "heartbeat_min": float(heartbeat_min)}
        self.state, cls, why = policy_row(self.state, row["at_us"], row["probability"], False, c)
        yield row["key"], row["at_us"], row["probability"], cls, why


class Match:
    """Counts of an object's alerts and failures: rows (object_id, at_us, failure) where an alert stands at its time plus the least lead."""

    @staticmethod
    def analyze(table: AnalyzeArgument, span_us: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, "object_id", ("at_us", "failure"), "alerts bigint, failures bigint, tp bigint, fn bigint, fp bigint, dup bigint")

    def __init__(self):
        self.key, self.alerts, self.failures, self.hits, self.false, self.ready, self.fresh = None, 0, 0, 0, 0, [], []

    def eval(self, row, span_us):
        self.key, at = row["object_id"], row["at_us"]
        if not row["failure"]:
            self.alerts += 1
            self.ready.append(at)
            self.fresh.append(at)
            return
        self.failures += 1
        self.false += sum(x < at - span_us for x in self.fresh)
        self.ready, self.fresh = [x for x in self.ready if x >= at - span_us], []
        if self.ready:
            self.ready.pop()
            self.hits += 1

    def terminate(self):
        if self.alerts + self.failures:
            false = self.false + len(self.fresh)
            yield self.key, self.alerts, self.failures, self.hits, self.failures - self.hits, false, self.alerts - false - self.hits


#: SQL functions over a registered view ``journal``: name, parameters, columns, query.
SQL_FUNCTIONS = {
    "last_numbers": ("until TIMESTAMP", "channel_id BIGINT, read_time TIMESTAMP, value_num DOUBLE", "SELECT channel_id, max(read_time), max_by(value_num, struct(read_time, journal_id)) FROM {journal} WHERE value_num IS NOT NULL AND read_time <= until GROUP BY channel_id"),
    "section_rows": ("section BIGINT, first TIMESTAMP, last TIMESTAMP", "journal_id BIGINT, read_time TIMESTAMP, channel_id BIGINT, value_text STRING", "SELECT journal_id, read_time, channel_id, value_text FROM {journal} WHERE section_id = section AND read_time >= first AND read_time < last"),
}


def register_functions(spark: SparkSession, journal: str | None = None) -> None:
    """Register ``episodes``, ``write_policy`` and ``match_alerts``, and, over the view ``journal``, the SQL functions, for the session."""
    for name, kind in (("episodes", Episodes), ("write_policy", Policy), ("match_alerts", Match)):
        spark.udtf.register(name, udtf(kind))
    if journal:
        for name, (parameters, columns, text) in SQL_FUNCTIONS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {text.format(journal=journal)}")
