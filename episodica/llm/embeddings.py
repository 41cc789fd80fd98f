"""Near-duplicate vectors by sorted projection passes.

Vectors are scaled to unit length, and those of one direction are collapsed.  Each pass gives a vector a key of
random hyperplane signs, concatenated.  All (length, pass, key) rows are ordered lexicographically in one range
shuffle, every vector is compared with the ``window`` that follow it in its pass at least, over the borders of
ranges too, and pairs at or above the cosine link.  The union over passes links the vectors.  Clusters of any
size stay connected, as neighbours in the order are compared whatever the cluster's size; of the links inside
one block of neighbours a spanning forest is kept, which says the same about components.  The number of passes
grows with that of the vectors, so that a pair at the cosine meets with a stated probability.

Links inside a component are then counted whole.  A component of up to ``TILE`` vectors is one matrix product.
A larger one is first reduced by geometry: members stand at angles from its mean direction, and two whose angles
add up to no more than the threshold angle are linked for certain, which ranks count.  What this leaves open is
dealt into blocks, and each pair of blocks is one matrix product in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

#: Guard against rounding where geometry settles a pair; such pairs are compared instead.
SLACK = 1e-9
#: Vectors on one side of a matrix product when links are counted.
TILE = 2048
#: Shells of equal angle, from 0 to the threshold angle.
SHELLS = 128
#: Shell of members that geometry has not placed: with any other it makes an open pair.
UNPLACED = 1 << 20


def _lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls; row i is values[offsets[i] : offsets[i + 1]]."""
    size = np.asarray(column.value_lengths(), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)))


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the stretches in which all keys stay the same."""
    n = len(keys[0])
    if not n:
        return []
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip([0, *at], [*at, n]))


def passes_for(n: int, cosine: float, window: int, recall: float) -> int:
    """Passes in which a pair at ``cosine`` among ``n`` vectors meets with probability ``recall``, 12 at least.

    In one pass the pair meets when it agrees in about log2(n / window) leading signs; half a sign more
    is asked, as blocks vary in size (by measurement, see the README).
    """
    agree = 1 - math.acos(min(cosine, 1.0)) / math.pi
    once = agree ** max(0.0, math.log2(max(n, 1) / window) + 0.5)
    return 12 if once >= 1 else max(12, math.ceil(math.log(1 - recall) / math.log1p(-once)))


def _keys(passes: int, bits: int, seed: int):
    """mapInArrow: (node, dim, v) -> (dim, pass, key, node, v); the planes follow from the seed and the dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            dims = whole.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                b = whole.filter(pa.array(dims == dim)) if (dims != dim).any() else whole
                if dim not in planes:
                    planes = {dim: np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))}
                x = _lengths(b.column(2))[0].reshape(-1, dim)
                for p in range(passes):
                    signs = x @ planes[dim][:, p * bits : (p + 1) * bits] > 0
                    keys = (signs.astype(np.int64) << np.arange(bits - 1, -1, -1, dtype=np.int64)).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.full(len(x), p, np.int32)), pa.array(keys), b.column(0), b.column(2)], ["dim", "pass", "key", "node", "v"])

    return run


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Numbers of edges (i, j) over ``n`` nodes that form a spanning forest."""
    root, left, kept = np.arange(n), np.arange(len(i)), [np.zeros(0, np.int64)]
    while True:
        a, b = root[i[left]], root[j[left]]
        left, high, low = left[a != b], np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
        if not len(left):
            return np.concatenate(kept)
        top, first = np.unique(high, return_index=True)
        kept.append(left[first])
        parent = np.arange(n)
        parent[top] = low[first]  # always to a smaller root, so without cycles
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]


NEAR = ["a", "b", "part", "dim", "pass", "pos", "v"]
NEAR_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
NEAR_SCHEMA = "a bigint, b bigint, part int, dim int, pass int, pos bigint, v array<double>"


def _near_rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(NEAR, NEAR_TYPES)], NEAR)


def _neighbours(window: int, cosine: float):
    """mapInArrow over rows in order: links (a, b) among each row and ``window`` or more after it in its pass.

    Rows of one length and pass are taken in blocks of ``window``; a block is compared with itself and the one
    before it.  Rows without b are for the borders: the first and last ``window`` of the partition, with their
    place in it and their vector, and one row without a whose pos is the number of rows.
    """

    def links(ids, x, before):
        both, vectors = (ids, x) if before is None else (np.concatenate([before[0], ids]), np.concatenate([before[1], x]))
        i, j = np.nonzero(x @ vectors.T >= cosine)
        i += len(both) - len(ids)
        i, j = i[j < i], j[j < i]
        keep = spanning(i, j, len(both)) if len(i) else i
        return _near_rows(len(keep), a=both[i[keep]], b=both[j[keep]]) if len(keep) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held, before, tail = TaskContext.get().partitionId(), 0, None, None, []
        for b in batches:
            dims, passes, ids = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
            flat, offsets = _lengths(b.column(4))
            for s, e in _runs(dims, passes):
                key, x = (int(dims[s]), int(passes[s])), flat[offsets[s] : offsets[e]].reshape(e - s, -1)
                run_ids, at = ids[s:e], np.arange(seen, seen + e - s)
                some = at < window
                if some.any():
                    yield _near_rows(int(some.sum()), a=run_ids[some], part=[part] * int(some.sum()), dim=[key[0]] * int(some.sum()), **{"pass": [key[1]] * int(some.sum())}, pos=at[some], v=list(x[some]))
                tail.append((key, run_ids[-window:], at[-window:], x[-window:]))
                while len(tail) > 1 and sum(len(t[1]) for t in tail[1:]) >= window:
                    tail.pop(0)
                seen += e - s
                if held is not None and held[0] == key:
                    run_ids, x = np.concatenate([held[1], run_ids]), np.concatenate([held[2], x])
                else:
                    if held is not None and (found := links(held[1], held[2], before)):
                        yield found
                    before = None
                while len(run_ids) > window:  # the last block waits for its rest
                    if found := links(run_ids[:window], x[:window], before):
                        yield found
                    before = run_ids[:window], x[:window]
                    run_ids, x = run_ids[window:], x[window:]
                held = key, run_ids, x
        if held is not None and (found := links(held[1], held[2], before)):
            yield found
        for key, run_ids, at, x in tail:
            some = (at >= window) & (at >= seen - window)
            n = int(some.sum())
            if n:
                yield _near_rows(n, a=run_ids[some], part=[part] * n, dim=[key[0]] * n, **{"pass": [key[1]] * n}, pos=at[some], v=list(x[some]))
        if seen:
            yield _near_rows(1, part=[part], pos=[seen])

    return run


def _border_links(found: DataFrame, cosine: float, window: int) -> DataFrame:
    """Links (a, b) of rows at most ``window`` places apart in one pass that lie in different partitions."""
    before, offsets = 0, []
    # one row a partition
    for r in sorted(found.where("a is null").select("part", "pos").collect()):
        offsets.append((r.part, before))
        before += r.pos
    places = found.sparkSession.createDataFrame(offsets, "part int, offset bigint")
    edges = found.where("a is not null and b is null").join(F.broadcast(places), "part").select("a", "part", "dim", "pass", (F.col("pos") + F.col("offset")).alias("at"), "v")
    edges = edges.withColumn("block", F.floor(F.col("at") / window))
    # each block of places meets the rows of the same and of the next block
    sides = edges.withColumn("later", F.lit(False)).unionByName(edges.withColumn("block", F.explode(F.array("block", F.col("block") - 1))).withColumn("later", F.lit(True)))

    def meet(t: pa.Table) -> pa.Table:
        x, at, part, ids, later = np.array(t["v"].to_pylist()), t["at"].to_numpy(), t["part"].to_numpy(), t["a"].to_numpy(), t["later"].to_numpy(zero_copy_only=False)
        i, j = np.flatnonzero(~later), np.flatnonzero(later)
        p, q = np.nonzero((x[i] @ x[j].T >= cosine) & (part[i][:, None] < part[j]) & (at[j] - at[i][:, None] <= window))
        return pa.table({"a": ids[i[p]], "b": ids[j[q]]})

    return sides.groupBy("dim", "pass", "block").applyInArrow(meet, "a bigint, b bigint")


def _units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) for every row: v of unit length, or null without an id, with a null or non-finite component, or all zero."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    # scaled by the largest component first: squares of very large or small ones leave the range of doubles
    rows = rows.select("vec_id", F.when(usable, F.col("v")).alias("v"), F.when(usable, F.array_max(F.transform("v", F.abs))).alias("top"))
    rows = rows.select("vec_id", F.transform("v", lambda x: x / F.col("top")).alias("v"))
    return rows.withColumn("len", _length("v")).select("vec_id", F.transform("v", lambda x: x / F.col("len") + F.lit(0.0)).alias("v"))


def _length(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def projected_links(nodes: DataFrame, cosine: float, passes: int, window: int, seed: int) -> DataFrame:
    """Distinct links (a < b) between ``nodes`` (node, v of unit length) that connect all which the sorted passes link."""
    keyed = nodes.select("node", F.size("v").alias("dim"), "v").mapInArrow(_keys(passes, 62, seed), "dim int, pass int, key bigint, node bigint, v array<double>")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "pass", "key", "node"]
    found = cut(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(window, cosine), NEAR_SCHEMA))
    links = found.where("b is not null").select("a", "b").unionByName(_border_links(found, cosine, window))
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tile_counts(cosine: float, settled: int):
    """mapInArrow over rows in order of their tile: (node, n), the copies at the other ends of a node's open links there.

    Side 0 is compared with itself where the tile has no side 1.  A pair is open if its shells add up to more
    than ``settled``.
    """

    def count(flat, lengths, side, nodes, copies, shells):
        x = flat.reshape(len(nodes), -1)
        i = side == 0
        j = ~i if (~i).any() else i
        link = (x[i] @ x[j].T >= cosine) & (shells[i][:, None] + shells[j] > settled)
        if j is i:
            np.fill_diagonal(link, False)
            n, to = link @ copies[j], nodes[i]
        else:
            n, to = np.concatenate([link @ copies[j], link.T @ copies[i]]), np.concatenate([nodes[i], nodes[j]])
        return pa.RecordBatch.from_arrays([pa.array(to[n > 0]), pa.array(n[n > 0])], ["node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            tile = [b.column(k).to_numpy() for k in range(3)]
            side, nodes, copies, shells = (b.column(k).to_numpy() for k in (3, 4, 5, 6))
            flat, at = _lengths(b.column(7))
            for s, e in _runs(*tile):
                now = tuple(int(k[s]) for k in tile)
                if now != key and held:
                    yield count(*map(np.concatenate, zip(*held)))
                    held = []
                key = now
                held.append((flat[at[s] : at[e]], at[s : e + 1], side[s:e], nodes[s:e], copies[s:e], shells[s:e].astype(np.int64)))
        if held:
            yield count(*map(np.concatenate, zip(*held)))

    return run


def _counts(inside: DataFrame, cosine: float, tile: int = TILE) -> DataFrame:
    """(node, n): the links of each node to others of its component, copies counted.

    ``inside`` has component, size (the component's nodes), node, copies and v.
    """
    limit = math.acos(min(cosine, 1.0))
    step = limit / SHELLS
    # shells s and t hold angles below (s + 1) and (t + 1) steps: together within the limit up to this sum
    settled = math.floor((limit - SLACK) / step) - 2
    columns = ["component", "p", "q", "side", "node", "copies", "shell", "v"]
    whole = inside.where(F.col("size") <= tile).select("component", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), "node", "copies", F.lit(UNPLACED).alias("shell"), "v")
    large = inside.where(F.col("size") > tile)
    sums = large.select("component", F.posexplode("v").alias("i", "x")).groupBy("component", "i").agg(F.sum("x").alias("x"))
    mean = sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    mean = mean.withColumn("len", _length("m")).select("component", F.transform("m", lambda x: x / F.greatest("len", F.lit(1e-300))).alias("m"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot("v", "m"))))
    placed = cut(large.join(mean, "component").select("component", "size", "node", "copies", "v", F.floor(angle / step).cast("int").alias("shell")))
    # copies by shell: few rows a component, and only shells that can be sure of another
    shells = placed.groupBy("component", "shell").agg(F.sum("copies").alias("n"))
    farthest = F.max("shell").alias("far")
    held = F.array_sort(F.collect_list(F.when(F.col("shell") <= settled, F.struct("shell", "n")))).alias("held")
    shells = shells.groupBy("component").agg(farthest, held)
    inner = F.transform(F.sequence(F.lit(0), F.lit(max(settled, 0))), lambda s: F.aggregate(F.filter("held", lambda h: h["shell"] <= s), F.lit(0).cast("long"), lambda a, h: a + h["n"]))
    placed = placed.join(shells.select("component", "far", inner.alias("inner")), "component")
    reach = F.lit(settled) - F.col("shell")
    sure = F.when(reach >= 0, F.get("inner", reach)).otherwise(F.lit(0)) - F.when(F.col("shell") <= reach, F.col("copies")).otherwise(F.lit(0))
    counted = placed.select("node", sure.cast("long").alias("n"))
    # an open pair has both ends among those that are not sure of the farthest member
    blocks = F.ceil(F.col("size") / tile).cast("int")
    open_ = placed.where(F.col("shell") + F.col("far") > settled).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pairs = open_.select("component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "copies", "shell", "v")
    tiles = whole.select(*columns).unionByName(pairs.select(*columns)).repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")
    return counted.unionByName(tiles.mapInArrow(_tile_counts(cosine, settled), "node bigint, n bigint")).groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    cosine: float = 0.9,
    passes: int | None = None,
    recall: float = 0.99,
    window: int = 128,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    A link is a pair of rows with cosine >= ``cosine`` in double precision; none below it is ever made.  Vectors
    that are null, empty or zero, or hold a null or non-finite component, link with nothing, and so do rows
    without id, which are kept.  Components may be as large or small as doubles go.  Vectors of unlike length
    never link.  Each row is a vector of its own, those that repeat an id too: equal ones link like any others,
    and of a component all rows with its smallest id are kept.  Ties at the cosine link.  An empty table gives
    none; other columns don't matter.  ``passes`` follows from the number of distinct directions and ``recall``,
    the probability that a pair at ``cosine`` is compared, if it is not given.
    """
    rows = cut(_units(vectors, id_col, vec_col))
    valid = rows.where("v is not null")
    nodes = cut(valid.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    if passes is None:
        passes = passes_for(nodes.count(), cosine, window, recall)
    links = cut(projected_links(nodes.select("node", "v"), cosine, passes, window, seed))
    member = cut(connected_components(links).select("node", F.col("root").alias("component")))
    held = member.join(nodes.select("node", "copies", "least"), "node")
    sizes = held.groupBy("component").agg(F.count("*").alias("size"), F.sum("copies").alias("all"), F.min("least").alias("smallest"))
    held = cut(held.join(sizes, "component"))
    pairs = held.where("size = 2").select("node", (F.col("all") - F.col("copies")).alias("n"))
    inside = held.where("size > 2").select("component", "size", "node", "copies").join(nodes.select("node", "v"), "node")
    counted = held.select("node", "smallest").join(pairs.unionByName(_counts(inside, cosine)), "node", "left")
    judged = nodes.join(counted, "node", "left").select("v", F.coalesce("smallest", "least").alias("component"), (F.coalesce("n", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"))
    alone = rows.where("v is null").select("vec_id", F.col("vec_id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    out = valid.join(judged, "v").select("vec_id", "component", "n_links").unionByName(alone)
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
