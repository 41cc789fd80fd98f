"""Scalar helpers that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation with g = 7, nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gamma(x: Column) -> Column:
    """The gamma function for x >= 0.5."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit((2 * 3.141592653589793) ** 0.5) * F.pow(t, z + 0.5) * F.exp(-t) * total


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, to the microsecond."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def local_day(moment: Column, zone: str) -> Column:
    """The calendar day of a UTC timestamp in ``zone``."""
    return F.to_date(F.from_utc_timestamp(moment.cast("timestamp"), zone))


def hash_uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, the same on every run."""
    digits = F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(2**52)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open intervals share a moment."""
    return (a_start < b_end) & (b_start < a_end)


def clip_seconds(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Seconds of [start, end) within [low, high)."""
    return F.greatest(F.lit(0.0), seconds(F.least(end, high), F.greatest(start, low)))
