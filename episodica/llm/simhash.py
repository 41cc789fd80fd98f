"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into six blocks.  Fingerprints that differ in at most three bits agree in three
blocks at least, so each fingerprint is indexed under its twenty choices of three blocks (the variants that
delete the other three); equal keys are joined and verified.

Buckets are not expanded blindly.  Exact copies share a fingerprint and are collapsed before indexing.
A bucket of at most ``light`` fingerprints is joined pair by pair.  The rows of a larger one meet at
midpoints: two values within three bits have a value between them, within one bit of one and within two
bits of the other, and all who meet there are linked to one of them by a true link, so connectivity is
exact and no bucket is squared.

``simhash_components`` links by bits alone.  ``near_duplicates`` links by similarity of shingle sets: pairs that
the signatures propose are verified, and as three of 64 bits reach only the closest pairs at a similarity of 0.8,
minhash bands propose the rest (see ``similar``; figures in the README).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components
from .shingles import majority_bits, shingle_hashes
from .similar import similar_components

def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((majority_bits(shingle_hashes(t.as_py() or b"", width)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; null or wordless text gives 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_fingerprint_batches(width), f"doc_id {kind}, fp bigint")


#: A fingerprint's 64 bits in six blocks; a key leaves three of them out.
BLOCKS = [(1 << width) - 1 << start for start, width in ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))]
#: The bits that each of the twenty keys keeps.
KEPT = [x | y | z for x, y, z in combinations(BLOCKS, 3)]
#: Fingerprints that one task spreads into index rows.
TASK_ROWS = 8192
KEY = ["part", "key"]


def _long(mask: int) -> str:
    return f"{mask - (1 << 64) if mask >> 63 else mask}L".replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")


def _array(values) -> str:
    """SQL text of an array, for hundreds of column objects take the driver many seconds."""
    return "array(" + ", ".join(values) + ")"


def _index(distinct: DataFrame) -> DataFrame:
    """20 rows a fingerprint: what three of its six blocks hold."""
    # fingerprints are few bytes and come in few partitions; their index rows are many
    distinct = distinct.repartition(max(8, -(-distinct.count() // TASK_ROWS)), "fp")
    return distinct.select("fp", F.posexplode(F.expr(_array(f"fp & {_long(m)}" for m in KEPT))).alias("part", "key"))


def _midpoints(rows: DataFrame) -> DataFrame:
    """Star links of crowded buckets, over the blocks that the bucket leaves open.

    In a bucket the open bits may differ in three: radius one meets radius two.  Whoever meets a radius-one value at
    a midpoint is within three bits of it, so every link here is a true one.
    """
    open_bits = F.expr(_array(_array(_long(1 << i) for i in range(64) if not m >> i & 1) for m in KEPT))
    marked = rows.select(*KEY, "fp", F.get(open_bits, F.col("part")).alias("bits"))
    ball = F.expr("""concat(array(named_struct('m', 0L, 'r', 1)), transform(bits, x -> named_struct('m', x, 'r', 1)),
        flatten(transform(bits, (x, i) -> transform(slice(bits, 1, i), y -> named_struct('m', x | y, 'r', 2)))))""")
    met = marked.select(*KEY, "fp", F.explode(ball).alias("f")).select(*KEY, "fp", F.col("fp").bitwiseXOR(F.col("f.m")).alias("z"), F.col("f.r").alias("r"))
    hubs = met.groupBy(*KEY, "z").agg(F.min(F.when(F.col("r") == 1, F.col("fp"))).alias("hub"), F.count("*").alias("n"))
    return met.join(hubs.where("hub is not null and n > 1"), [*KEY, "z"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def near_links(distinct: DataFrame, light: int = 256) -> DataFrame:
    """True links (a, b) between distinct fingerprints (column fp) that connect all which <= 3 bits connect.

    ``light`` is the largest bucket joined pair by pair; larger ones go through midpoints, with the same
    connectivity.  The choice is one of cost alone.
    """
    index = _index(distinct)
    sizes = index.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    sizes = cut(sizes.where("n > 1"))  # only these can hold a link
    twos = sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    rows = cut(index.join(sizes.where("n > 2").select(*KEY, "n"), KEY).select(*KEY, "fp", "n"))
    small = rows.where(F.col("n") <= light)
    pairs = small.select(*KEY, F.col("fp").alias("a")).join(small.select(*KEY, F.col("fp").alias("b")), KEY).where("a < b")
    found = twos.unionByName(pairs.select("a", "b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    return found.select("a", "b").distinct().unionByName(_midpoints(rows.where(F.col("n") > light)))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, light: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null, empty and wordless texts have fingerprint zero and link like any other.  Repeated rows stay
    repeated.  Other columns of ``docs`` are not looked at, whatever their names.  An empty table gives
    an empty result; rows whose id is null get the component of their fingerprint.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = cut(groups)
    roots = connected_components(near_links(groups.select("fp"), light))
    member = roots.select(F.col("node").alias("fp"), "root")
    named = groups.join(member, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # each root's smallest document: one row per group, so the window never sees copies
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(named.join(smallest, "root").select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, light: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, component (a number; equal for rows that verified pairs connect).

    A pair links if the sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more.  Null,
    empty and wordless texts are alike and form one component; a text of fewer words than ``width`` is one shingle.
    Long texts are read whole; repeated rows get one component; other columns don't matter; an empty table gives none.
    """

    def proposed(sketches: DataFrame) -> DataFrame:
        """(a, na, b, nb): of sets with one fingerprint each meets the smallest; smallest ones of near fingerprints meet."""
        heads = sketches.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("sets"))
        heads = cut(heads)
        same = sketches.join(heads.where("sets > 1").drop("sets"), "fp").where("node <> head.node").select(F.col("head.node").alias("a"), F.col("head.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
        ends = [heads.select(F.col("fp").alias(x), F.col("head.node").alias(f"{x}_node"), F.col("head.n").alias(f"{x}_n")) for x in ("a", "b")]
        near = near_links(heads.select("fp"), light).join(ends[0], "a").join(ends[1], "b")
        return same.unionByName(near.select(F.col("a_node").alias("a"), F.col("a_n").alias("na"), F.col("b_node").alias("b"), F.col("b_n").alias("nb")))

    return similar_components(docs, id_col, text_col, width, similarity, proposed)
