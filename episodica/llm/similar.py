"""Components of similar shingle sets: pairs are proposed, the sets themselves decide.

This is the part of the near-duplicate operator (see ``simhash``) that fingerprint bits are too coarse for: a
similarity of 0.8 is some ten of 64 bits, and segments short enough to find that distance hold most of the corpus.
Besides the pairs that fingerprints propose, a set of five-word shingles gets ``BANDS`` keys of ``ROWS``
minima each; a pair of similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS, 0.99994 at 0.8 and
more above.  Every proposed pair is verified by its exact similarity before it links.

Equal sets are collapsed first.  A bucket's members are held against its smallest one, and what this links is one
component; then only pairs of different components are left open, and each of those has an end outside the bucket's
largest component.  Components are those of all verified pairs.  Where over ``FEW`` members of a bucket stay outside
(pages of one site template resemble each other at 0.7), its members meet by prefixes instead: their shingles are put
in order of how many of these sets hold them, and two sets as similar as asked share a shingle among the first ones
of both.  Shingles of the template stand last in that order, so such pages meet only where they share more than
the template.  Both ways lose no pair of the bucket.  Where pairs are made there, both sets' bits are compared at once:
each of ``BITS`` bits says whether an odd number of shingles falls on it, so sets differ in as many shingles as bits
at least, and pairs that differ in more than the similarity allows are not made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .components import connected_components
from .shingles import SEED, majority_bits, shingle_hashes

BANDS, ROWS = 32, 6
#: Shingles whose minima are taken at once.
CHUNK = 256
#: Members outside a bucket's largest component that are held against all its members.
FEW = 64
#: Bits of a set that are compared before the set itself.
BITS = 256


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct shingle hashes in order."""
    return np.unique(shingle_hashes(text, width))


def _node(found: np.ndarray) -> int:
    """A number for a set; the empty set is 0."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def _keyed(found: np.ndarray, masks: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The keys of a set: a hash of ``ROWS`` minima and the band's number.

    Minima are taken over 32 mixed bits of each hash: words of that size fill vector registers.  Two shingles that
    agree in them by chance can only propose a pair more.
    """
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(masks), 2**32 - 1, np.uint32)
    room = np.empty((CHUNK, len(masks)), np.uint32)
    for i in range(0, len(short), CHUNK):
        part = short[i : i + CHUNK, None]
        h = room[: len(part)]
        np.bitwise_xor(part, masks, out=h)
        np.multiply(h, odd, out=h)
        np.minimum(least, h.min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.astype(np.uint64).reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _sketches(width: int):
    """mapInArrow: (doc_id, text_hash, t) -> (doc_id, text_hash, node, n, fp, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        masks = rng.integers(0, 2**32, BANDS * ROWS, np.uint32)
        odd = rng.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
        for b in batches:
            nodes, fps, sizes, keys = np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64), np.zeros(len(b), np.int32), np.zeros((len(b), BANDS), np.uint64)
            for i, t in enumerate(b.column(2)):
                hashes = shingle_hashes(t.as_py(), width)
                found, fps[i] = np.unique(hashes), majority_bits(hashes)
                nodes[i], sizes[i] = _node(found), len(found)
                keys[i] = _keyed(found, masks, odd)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(fps.view(np.int64)), listed], ["doc_id", "text_hash", "node", "n", "fp", "keys"])

    return run


def set_bits(found: np.ndarray) -> np.ndarray:
    """``BITS`` parities of a set's hashes, as longs."""
    odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_resemble(x: str, y: str, sizes: Column, similarity: float) -> Column:
    """Whether sets with bits ``x`` and ``y``, of ``sizes`` together, may be similar; false only if they are not."""
    apart = reduce(add, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)])
    return apart <= sizes * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def _sets(width: int):
    """mapInArrow: (node, t) -> (node, set, bits), the set as the bytes of its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([set_bits(x) for x in found], pa.list_(pa.int64()))], ["node", "set", "bits"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (node, set) -> (node, shingle), a row for each shingle."""
    for b in batches:
        for i, x in enumerate(b.column(1)):
            found = pa.array(np.frombuffer(x.as_py(), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b.column(0)[i].as_py(), np.int64)), found], ["node", "shingle"])


def prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, na, b, nb) of ``members`` (node, n, root, and bits if known) of different roots; every pair of that similarity is among them.

    Two sets of sizes m <= n that similar share s*n shingles and 2s/(1+s)*m, so the least frequent one they share
    stands among the first n - s*n + 1 of the greater and the first m - 2s/(1+s)*m + 1 of the smaller one.  Sizes are
    compared by equality of their classes, each a factor s wide.
    """
    each = sets.join(members.select("node"), "node", "left_semi").select("node", "set").mapInArrow(_shingles, "node bigint, shingle bigint")
    often = cut(each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1"))
    # shingles of one set alone stand first, so places are counted from the end
    order = Window.partitionBy("node").orderBy(F.desc("often"), F.desc("shingle"))
    placed = each.join(often, "shingle").withColumn("left", F.row_number().over(order)).join(members, "node")

    def first(placed: DataFrame, share: float) -> DataFrame:
        return placed.where(F.col("left") >= F.ceil(share * F.col("n") - 1e-9))

    placed = cut(first(placed, similarity))

    width = F.floor(F.log("n") / -math.log(similarity))
    known = ["bits"] if "bits" in members.columns else []
    small = first(placed, 2 * similarity / (1 + similarity)).select("shingle", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), width.alias("width"), *[F.col(x).alias("x") for x in known])
    great = placed.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.explode(F.array(width - 2, width - 1, width)).alias("width"), *[F.col(x).alias("y") for x in known])
    asked = (F.struct("na", "a") < F.struct("nb", "b")) & (F.col("ra") != F.col("rb"))
    if known:
        asked &= may_resemble("x", "y", F.col("na") + F.col("nb"), similarity)
    return small.join(great, ["shingle", "width"]).where(asked).select("a", "na", "b", "nb").distinct()


def _verified(similarity: float):
    """mapInArrow: (a, b, x, y) -> the pairs (a, b) whose sets x and y are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both >= similarity * (len(x) + len(y) - both)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


def similar_components(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, proposed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, component (a number; equal for rows that verified pairs connect).

    Null, empty and wordless texts are alike.  Words and shingles are those of ``shingle_hashes``; a text of fewer
    words than ``width`` is one shingle.  Other columns don't matter; an empty table gives none.  ``proposed``
    gives pairs (a, na, b, nb) of sets with their sizes from the distinct sets (node, n, fp, text_hash).
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    texts = texts.select("doc_id", F.xxhash64("t").alias("text_hash"), F.col("t").cast("binary").alias("t"))
    kind = dict(texts.dtypes)["doc_id"]
    rows = cut(texts.mapInArrow(_sketches(width), f"doc_id {kind}, text_hash bigint, node bigint, n int, fp bigint, keys array<bigint>"))
    sketches = rows.where("n > 0").dropDuplicates(["node"])
    index = sketches.select("node", "n", "text_hash", F.explode("keys").alias("key"))
    near = cut(proposed(sketches.select("node", "n", "fp", "text_hash")))
    buckets = index.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("hub")).where("members > 1")
    crowd = cut(index.join(buckets, "key").select("key", "node", "n", "text_hash", "hub"))
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    asked = crowd.select("node", "text_hash").unionByName(sketches.select("node", "text_hash").join(ends, "node", "left_semi"))
    picked = asked.groupBy("text_hash").agg(F.min("node").alias("node"))
    shown = texts.select("text_hash", "t").join(picked, "text_hash").dropDuplicates(["text_hash"])
    sets = cut(shown.select("node", "t").mapInArrow(_sets(width), "node bigint, set binary, bits array<bigint>"))

    def links(pairs: DataFrame) -> DataFrame:
        """The similar ones of (a, na, b, nb); sizes settle what they can."""
        open_ = pairs.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb")).select("a", "b").distinct()
        open_ = open_.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        return cut(open_.select("a", "b", "x", "y").mapInArrow(_verified(similarity), "a bigint, b bigint"))

    hubs = crowd.where("node <> hub.node").select(F.col("hub.node").alias("a"), F.col("hub.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    stars = links(near.unionByName(hubs))
    first = cut(connected_components(stars))
    placed = crowd.join(first, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    shares = placed.groupBy("key", "root").agg(F.count("*").alias("held"))
    most = shares.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("held", "root")).alias("most")).where("roots > 1").drop("roots")
    placed = cut(placed.join(most, "key").join(sets.select("node", "bits"), "node"))
    few = placed.where("root <> most").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("bits").alias("x"))
    wide = cut(few.groupBy("key").agg(F.count("*").alias("outside")).where(F.col("outside") > FEW).select("key"))
    few = few.join(wide, "key", "left_anti")
    every = placed.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("bits").alias("y"))
    across = few.join(every, "key").where((F.col("ra") != F.col("rb")) & may_resemble("x", "y", F.col("na") + F.col("nb"), similarity))
    across = across.select(*[F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("na", "nb"), ("b", "a"), ("nb", "na"))])
    if not wide.isEmpty():
        crowded = cut(placed.join(wide, "key", "left_semi").select("node", "n", "root", "bits").dropDuplicates(["node"]))
        across = across.unionByName(prefix_pairs(crowded, sets, similarity))
    across = links(across)
    member = cut(connected_components(stars.unionByName(across)))
    return rows.join(member, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("component"))
