"""Spans of regular expressions in whole texts, with DataFrame functions only.

Spark returns what a pattern matches and what lies between matches, but no places.  The places are sums of
these lengths.  The sums run in blocks of 256, so a text with very many matches stays close to linear.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds spans, leftmost and without overlap; ``keep`` judges (match, group) and drops the failing."""

    name: str
    pattern: str
    group: int = 0
    keep: Callable[[Column, Column], Column] | None = None


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def _steps(i: int) -> Column:
    """A match ends where all pieces before it and all matches up to it end: the length of each such step."""
    return F.transform(f"_m{i}", lambda m, j: F.length(m) + F.get(F.col(f"_p{i}"), j))


def _block_sums(i: int) -> Column:
    blocks = F.sequence(F.lit(1), F.ceil(F.size(f"_s{i}") / BLOCK).cast("int"))
    return F.transform(blocks, lambda b: _total(F.slice(F.col(f"_s{i}"), (b - 1) * BLOCK + 1, BLOCK)))


def _block_starts(i: int) -> Column:
    return F.transform(f"_b{i}", lambda _, b: _total(F.slice(F.col(f"_b{i}"), 1, b)))


def _spans(i: int, kind: Kind, tag: Callable[[Column], Column] | None) -> Column:
    def span(m, j):
        block = F.floor(j / BLOCK).cast("int")
        end = F.get(F.col(f"_o{i}"), block) + _total(F.slice(F.col(f"_s{i}"), block * BLOCK + 1, j - block * BLOCK + 1))
        group = F.get(F.col(f"_g{i}"), j)
        return F.struct(
            (end - F.length(m)).alias("start"),
            F.lit(i).alias("place"),
            end.alias("end"),
            F.lit(kind.name).alias("kind"),
            (tag(group) if tag else F.lit(None).cast("string")).alias("tag"),
            (kind.keep(m, group) if kind.keep else F.lit(True)).alias("ok"),
        )

    kept = F.filter(F.transform(f"_m{i}", span), lambda s: s["ok"])
    return F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "place", "end", "kind", "tag")]))


def find_spans(texts: DataFrame, text_col: str, kinds: list[Kind], into: str, tag: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``into``: array of (start, place, end, kind, tag), ordered by start, then by the order of ``kinds``.

    Starts and ends count code points, the end is exclusive; place is the kind's index; tag is ``tag`` of the
    group's text (None: null).  A text without matches has an empty array.
    """
    text = F.col(text_col)
    none, no_ints = F.array().cast("array<string>"), F.array().cast("array<int>")
    each = list(enumerate(kinds))
    some = {i: F.size(f"_m{i}") > 0 for i, _ in each}
    out = once(texts, {f"_m{i}": F.when(text.rlike(k.pattern), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none) for i, k in each})
    pieces = {f"_p{i}": F.when(some[i], F.transform(F.split(text, k.pattern, -1), F.length)) for i, k in each}
    groups = {f"_g{i}": F.when(some[i], F.regexp_extract_all(text, F.lit(k.pattern), F.lit(k.group))) if k.group else F.col(f"_m{i}") for i, k in each}
    out = once(out, pieces | groups)
    out = once(out, {f"_s{i}": F.when(some[i], _steps(i)).otherwise(no_ints) for i, _ in each})
    out = once(out, {f"_b{i}": F.when(some[i], _block_sums(i)).otherwise(no_ints) for i, _ in each})
    out = once(out, {f"_o{i}": _block_starts(i) for i, _ in each})
    spans = F.concat(*[_spans(i, k, tag) for i, k in each])
    return once(out, {into: F.array_sort(spans)}).select(*texts.columns, into)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once a row.

    A plain projection may be merged into the next one, and what a lambda reads would then be computed anew
    for each element.  A generator of one row is not merged.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select(*df.columns, made).select(*df.columns, *[F.col(f"_made.{n}").alias(n) for n in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Characters of a chunk.
CHUNK = 512


def chunked(text: Column) -> Column:
    """The text as struct of ``c``, its chunks of equal length, and ``n``, its length: places are found without reading up to them."""
    return F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("c"), F.coalesce(F.length(text), F.lit(0)).alias("n"))


def part(chunks: Column, at: Column, n: Column) -> Column:
    """``n`` characters from place ``at`` (from 0) of a chunked text."""
    first = F.floor(at / CHUNK).cast("int")
    some = F.floor((at + F.greatest(n, F.lit(0))) / CHUNK).cast("int") - first + 1
    return F.substr(F.array_join(F.slice(chunks["c"], first + 1, some), ""), at - first * CHUNK + 1, F.greatest(n, F.lit(0)))


SPAN = "array<struct<start:int,place:int,end:int,kind:string,tag:string>>"


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))
