"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction (1 of ``scale``) of the hash range, so its size follows
the text's.  Two sketches are subsets of the texts' shingles by one rule: their intersection over the size of the
first estimates how much of the first text the second holds, however unequal the texts, and the sketch of a union
is the union of the sketches.  A text all of whose hashes lie above the bound keeps its smallest alone, so that
no text with words has an empty sketch; such a sketch meets others only where they keep that very hash.

A word is a run of other characters than the six ASCII spaces, A-Z lower-cased; shingles are five words, a text
of fewer words is one shingle.  Null texts are empty, an empty or blank text has an empty sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .shingles import SEED

#: One hash of so many is kept.
SCALE = 16
WIDTH = 5
#: Rows of a result batch, and words whose hashes a task remembers.
ROWS, WORDS = 2048, 1 << 18
#: What an intermediate row of ``compare_with_next`` is.
PAIR, HEAD, TAIL = 0, 1, 2


class _Words(dict):
    """Word -> hash, remembered: texts repeat their words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingle_values(text: str, words: _Words, width: int = WIDTH) -> np.ndarray:
    """Hashes of all shingles of a text, in order: word hashes times a multiplier a place, summed and stirred."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(found) - width + 1)
    value = np.zeros(n, np.uint64)
    for j in range(min(width, len(found))):
        value += each[j : j + n] * np.uint64(xxhash.xxh64_intdigest(b"place", j) | 1)
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def sketch(text: str, words: _Words, scale: int = SCALE, width: int = WIDTH) -> np.ndarray:
    """The kept hashes, ascending, as signed 64-bit numbers; those above the bound stand alone."""
    values = shingle_values(text, words, width)
    kept = np.unique(values[values < np.uint64((1 << 64) // scale if scale > 1 else (1 << 64) - 1)])
    if len(kept) == 0 and len(values):
        kept = values.min(keepdims=True)
    return kept.view(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of ``a`` that ``b`` holds; two empty sketches are alike, an empty one is like no other."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def contained(a: Column, b: Column) -> Column:
    """``likeness`` of two sketch columns."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise((F.size(a) == F.size(b)).cast("double"))


def fingerprint_text(sketch_col: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(sketch_col, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _sketches(batches: Iterable[pa.RecordBatch], place: int, schema: pa.Schema, scale: int, width: int) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        made = [sketch(t, words, scale, width) for t in batch.column(place).to_pylist()]
        columns = [*batch.columns[:place], pa.array(made, pa.list_(pa.int64())), *batch.columns[place + 1 :]]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def sketch_documents(docs: DataFrame, text_col: str = "text", into: str = "sketch", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """Replace ``text_col`` by ``into`` (array of bigint, see the module); all other columns stay, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, into)]
    given = docs.select(*kept, text_or_empty(f"`{text_col}`").alias(into))
    shape = docs.select(*kept, F.lit(None).cast("array<bigint>").alias(into)).schema
    return given.mapInArrow(partial(_sketches, place=len(kept), schema=to_arrow_schema(shape), scale=scale, width=width), shape)


def merged_sketches(sketches: DataFrame, by: list[str], sketch_col: str = "sketch") -> DataFrame:
    """Sketches of whole groups (a source, a crawl) as rows (``by``, hash), each hash of a group once.

    Rows, not arrays: a group's sketch grows with the group.  A hash above the bound comes along from texts that
    keep nothing else; rows of several runs merge by union and ``distinct``.  Repeated hashes are collapsed before
    the shuffle.
    """
    return sketches.select(*by, F.explode(sketch_col).alias("hash")).distinct()


def contained_in_groups(sketches: DataFrame, merged: DataFrame, keys: list[str], by: list[str], sketch_col: str = "sketch") -> DataFrame:
    """For every document and every group that shares a hash with it: ``keys``, ``by``, ``share`` of the document.

    A hash of which many documents hold a copy meets each group once, and documents without a shared hash have no row.
    """
    each = sketches.select(*keys, F.size(sketch_col).alias("_n"), F.explode(sketch_col).alias("hash"))
    return each.join(merged, "hash").groupBy(*keys, *by).agg((F.count("*") / F.first("_n")).alias("share"))


def _compared(held: tuple, following: tuple, words: _Words, scale: int, width: int) -> tuple:
    """The contract's figures of a document (id, text, sketch) and the next one."""
    _, text, own = held
    tail = len(text) // 3
    edited = text[: len(text) - tail] + following[1][:tail]
    changed = sketch(edited, words, scale, width)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return len(text), digest, own, changed, likeness(own, changed), likeness(own, following[2])


#: Of the rows that ``_in_order`` makes, after pid and the document's id.
FIGURES = "n_chars bigint, edited_sha256 string, sketch array<bigint>, edited_sketch array<bigint>, near_edited double, near_next double"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _in_order(batches: Iterable[pa.RecordBatch], schema: pa.Schema, scale: int, width: int) -> Iterator[pa.RecordBatch]:
    """Documents in order to figures of each with its next; of a partition's ends, the texts that meet those of other partitions."""
    words, pid, held, rows = _Words(), TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now = doc, text, sketch(text, words, scale, width)
            if held is None:
                rows.append((pid, HEAD, doc, text, *[None] * 6))
            else:
                rows.append((pid, PAIR, held[0], None, *_compared(held, now, words, scale, width)))
            held = now
            if len(rows) >= ROWS:
                yield _batch(rows, schema)
                rows = []
    if held is not None:
        rows.append((pid, TAIL, held[0], held[1], *[None] * 6))
    if rows:
        yield _batch(rows, schema)


def _at_borders(batches: Iterable[pa.RecordBatch], schema: pa.Schema, scale: int, width: int) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        rows = []
        for doc, text, later in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held, now = ((doc, t, sketch(t, words, scale, width)) for t in (text, later))
            rows.append((doc, *_compared(held, now, words, scale, width)))
        if rows:
            yield _batch(rows, schema)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text_col: str = "text", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """Fingerprint every document and its text after an edit, and compare it with both that and the next document.

    The next document follows in descending order of ``key`` (nulls last; equal keys by their text's hash, equal
    rows in any order, which changes no row of the result); after the last comes the first.  The edit replaces the
    last third of the code points by as many first ones of the next document's text, or all it has.

    Returns ``key``, n_chars, edited_sha256, sketch, edited_sketch, near_edited and near_next (shares of the
    document's sketch).  Other columns of ``docs`` don't matter; an empty table gives no rows, a single document is
    its own next.

    One range shuffle puts the texts in order, so that neighbours meet in one pass.  Only the first and last text
    of each partition stand apart; these meet by the partitions' numbers (as many as there are tasks) afterwards.
    Results are checkpointed, as ranges are drawn anew whenever they are computed.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), text_or_empty(f"`{text_col}`").alias("text"))
    # equal rows go to several ranges by the row's number, which no result depends on
    order = [F.col("key").desc_nulls_last(), F.xxhash64("text"), F.col("salt")]
    rows = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    kind = rows.schema["key"].dataType.simpleString()
    shape = spark.createDataFrame([], f"pid int, part int, key {kind}, text string, {FIGURES}").schema
    made = cut(rows.mapInArrow(partial(_in_order, schema=to_arrow_schema(shape), scale=scale, width=width), shape))

    full = sorted(r["pid"] for r in made.where(F.col("part") == HEAD).select("pid").collect())  # a number a task
    meets = spark.createDataFrame(list(zip(full, full[1:] + full[:1], strict=True)), "pid int, next int")
    heads = made.where(F.col("part") == HEAD).select(F.col("pid").alias("next"), F.col("text").alias("later"))
    ends = made.where(F.col("part") == TAIL).select("pid", "key", "text").join(meets, "pid").join(heads, "next").select("key", "text", "later")
    shape = made.select("key", "n_chars", "edited_sha256", "sketch", "edited_sketch", "near_edited", "near_next").schema
    ends = ends.mapInArrow(partial(_at_borders, schema=to_arrow_schema(shape), scale=scale, width=width), shape)
    return made.where(F.col("part") == PAIR).select(*shape.names).unionByName(ends).withColumnRenamed("key", key)
