"""Predicates on time that reach the scan: literal ranges on the raw column, and on a day partition where there is one."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(time: str, low: Column, high: Column, partition: str | None = None) -> Column:
    """low <= time < high, both constants; a day partition is bounded as well, so that whole files fall away.

    Nothing is computed on ``time`` itself, so the comparison is pushed down to the files' statistics.
    """
    inside = (F.col(time) >= low) & (F.col(time) < high)
    if partition is None:
        return inside
    last = F.to_date(high - F.expr("INTERVAL 1 MICROSECOND"))
    return inside & (F.col(partition) >= F.to_date(low)) & (F.col(partition) <= last)


def on_days(time: str, days: list[Column], partition: str | None = None) -> Column:
    """Time lies on one of a few constant days."""
    starts = [F.to_timestamp(d) for d in days]
    return reduce(or_, [between(time, s, F.to_timestamp(s + F.expr("INTERVAL 1 DAY")), partition) for s in starts])
