"""Hard negatives by exact integer scores of anchor-candidate tiles.

Vectors become integers, floor(256 x) of each component.  Anchors and candidates are dealt into a grid of cells of
bounded size; a cell multiplies its anchors with its candidates tile by tile, by Strassen's recursion over int64 with
zero padding where a side is odd.  Sums wrap modulo 2^64 alike on every path, so a score that fits into 64 bits is exact.

Every cell keeps a heap of the best positives for each anchor; heaps of one anchor merge by taking the best of all.
A second pass over the cells, with the positives known, keeps a heap of the best negatives in each positive's window.
Candidates within a cell go by id, so ties need no look back.  A score wanted from a cell must beat the heap's last,
which leaves later tiles little to sort.
"""

from __future__ import annotations

import heapq
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors on the sides of a tile.
ANCHORS, CANDIDATES = 512, 4096
#: No side of a product is halved that is this short.
LEAF = 32
#: Bytes of int64 that one side of a cell takes.
CELL_BYTES = 32 << 20
#: Below any score in a heap, and the largest one.
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two blocks; in double precision where the sizes of the numbers prove that every sum is exact."""
    if a.size and b.size:
        most = [max(abs(int(x.min())), abs(int(x.max()))) for x in (a, b)]
        if most[0] * most[1] * a.shape[1] < 1 << 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, [(0, n % 2) for n in x.shape]) if any(n % 2 for n in x.shape) else x


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices: seven half-size products instead of eight, odd sides padded with zeros."""
    if min(*a.shape, b.shape[1]) <= LEAF:
        return _leaf(a, b)
    rows, columns = a.shape[0], b.shape[1]
    a, b = _even(a), _even(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def _whole(row: np.ndarray) -> list[int]:
    """floor(256 x) of a vector as Python's integers, which don't overflow."""
    return [math.floor(256 * float(x)) if abs(x) < 1e300 else 256 * int(x) for x in row]


class Vectors:
    """Vectors of one length: int64 components, and those too long for a 64-bit product apart."""

    def __init__(self, raw: np.ndarray):
        self.raw, d = raw, max(1, raw.shape[1])
        with np.errstate(over="ignore"):
            values = np.floor(256 * raw)
        long = (np.abs(values) > math.isqrt((1 << 62) // d)).any(1)
        self.long = np.flatnonzero(long)
        if len(self.long):
            values[self.long] = 0
        self.ints = values.astype(np.int64)

    def exact(self, i: int) -> list[int]:
        return _whole(self.raw[i])

    def part(self, rows) -> Vectors:
        return Vectors(self.raw[rows])


def scores(a: Vectors, b: Vectors) -> np.ndarray:
    """Inner products; those of overlong vectors by Python's integers, held to 64 bits at both ends."""
    out = strassen(a.ints, np.ascontiguousarray(b.ints.T))
    if len(a.long) or len(b.long):
        for i, j in {*((i, j) for i in a.long.tolist() for j in range(len(b.raw))), *((i, j) for j in b.long.tolist() for i in range(len(a.raw)))}:
            out[i, j] = max(-MOST, min(MOST, sum(x * y for x, y in zip(a.exact(i), b.exact(j), strict=True))))
    return out


def _push(heaps: list[list], values: np.ndarray, wanted: np.ndarray, first: int, size: int, rows=None) -> None:
    """Put each row's best wanted values into its heap of (-score, place); ``first`` is the place of column 0."""
    hit = np.flatnonzero(wanted.any(1))
    if len(hit) == 0:
        return
    masked = np.where(wanted[hit], values[hit], LEAST)
    if masked.shape[1] > size:
        least = np.partition(masked, masked.shape[1] - size, axis=1)[:, -size]
        chosen = wanted[hit] & (masked >= least[:, None])
    else:
        chosen = wanted[hit]
    at, column = np.nonzero(chosen)
    found = masked[at, column]
    starts = np.searchsorted(at, np.arange(len(hit) + 1)).tolist()
    for i, row in enumerate(hit.tolist()):
        k = row if rows is None else int(rows[row])
        part = slice(starts[i], starts[i + 1])
        new = zip((-found[part]).tolist(), (column[part] + first).tolist(), strict=True)
        heaps[k] = heapq.nsmallest(size, [*heaps[k], *new])


def _bar(heap: list, size: int, least: int) -> int:
    """A score that would enter the heap: later candidates have larger ids, so they must beat a full heap's last."""
    return min(MOST, max(least, 1 - heap[-1][0])) if len(heap) == size else least


class _Side:
    """One side of a cell, ordered by id (nulls last): ids, labels and vectors by length."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        plain = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((plain, ~known))
        self.order, self.known, self.ids = order, known[order], plain[order]
        self.labels = table.column("label").to_numpy()[order].astype(np.int64)
        lists = table.column("vec").combine_chunks().take(pa.array(order))
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(lengths)))
        self.groups = {}
        for d in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == d)
            self.groups[d] = rows, flat[(starts[rows][:, None] + np.arange(d)[None, :])].reshape(len(rows), d)


def _tiles(n: int, size: int):
    return (slice(i, min(n, i + size)) for i in range(0, n, size))


def _positives(anchors: pa.Table, candidates: pa.Table, size: int) -> pa.Table:
    """A cell's best candidates of an anchor's own label: (aid, id, score, same), same where it may be the anchor itself."""
    out = {"aid": [], "id": [], "score": [], "same": []}
    if anchors.num_rows and candidates.num_rows:
        left, right = _Side(anchors), _Side(candidates)
        aids = anchors.column("aid").to_numpy()[left.order]
        for d in left.groups.keys() & right.groups.keys():
            (at, a), (ct, c) = left.groups[d], right.groups[d]
            heaps: list[list] = [[] for _ in at]
            for label in np.unique(left.labels[at]).tolist():
                mine, theirs = np.flatnonzero(left.labels[at] == label), np.flatnonzero(right.labels[ct] == label)
                for some in _tiles(len(mine), ANCHORS):
                    rows, x = mine[some], Vectors(a[mine[some]])
                    for cols in _tiles(len(theirs), CANDIDATES):
                        value = scores(x, Vectors(c[theirs[cols]]))
                        bar = np.array([_bar(heaps[r], size, LEAST + 1) for r in rows.tolist()])
                        _push(heaps, value, value >= bar[:, None], cols.start, size, rows)
                for r in mine.tolist():
                    heaps[r] = [(s, int(theirs[k])) for s, k in heaps[r]]
            for r, heap in enumerate(heaps):
                for s, k in heap:
                    same = right.known[ct[k]] and right.ids[ct[k]] == left.ids[at[r]] and np.array_equal(a[r], c[k])
                    for name, value in zip(out, (int(aids[at[r]]), int(right.ids[ct[k]]) if right.known[ct[k]] else None, -s, bool(same)), strict=True):
                        out[name].append(value)
    return pa.table(out, schema=pa.schema([("aid", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("same", pa.bool_())]))


def _negatives(anchors: pa.Table, candidates: pa.Table, size: int, low: int, high: int) -> pa.Table:
    """A cell's best candidates of other labels inside each positive's window: (aid, place, id, score)."""
    out = {"aid": [], "place": [], "id": [], "score": []}
    if anchors.num_rows and candidates.num_rows:
        left, right = _Side(anchors), _Side(candidates)
        aids = anchors.column("aid").to_numpy()[left.order]
        given = anchors.column("positives").combine_chunks().take(pa.array(left.order)).to_pylist()
        for d in left.groups.keys() & right.groups.keys():
            (at, a), (ct, c) = left.groups[d], right.groups[d]
            for some in _tiles(len(at), ANCHORS):
                rows, x = at[some], Vectors(a[some])
                windows = [[(-(-low * p // 100), high * p // 100) for p in given[r]] for r in rows.tolist()]
                most = max(map(len, windows), default=0)
                heaps: list[list[list]] = [[[] for _ in rows] for _ in range(most)]
                for cols in _tiles(len(ct), CANDIDATES):
                    value = scores(x, Vectors(c[cols]))
                    other = left.labels[rows][:, None] != right.labels[ct[cols]][None, :]
                    for j in range(most):
                        # a row without such a positive has an empty window
                        lows = np.array([_bar(h, size, w[j][0]) if j < len(w) else 1 for h, w in zip(heaps[j], windows, strict=True)])
                        highs = np.array([w[j][1] if j < len(w) else 0 for w in windows])
                        open_ = np.flatnonzero(lows <= highs)
                        if len(open_):
                            wanted = (value[open_] >= lows[open_][:, None]) & (value[open_] <= highs[open_][:, None]) & other[open_]
                            _push(heaps[j], value[open_], wanted, cols.start, size, open_)
                for j in range(most):
                    for r, heap in enumerate(heaps[j]):
                        for s, k in heap:
                            for name, value in zip(out, (int(aids[rows[r]]), j + 1, int(right.ids[ct[k]]) if right.known[ct[k]] else None, -s), strict=True):
                                out[name].append(value)
    return pa.table(out, schema=pa.schema([("aid", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]))


def takes_part(label: Column, vector: Column) -> Column:
    """Label and vector are there, and no component is null or non-finite."""
    return label.isNotNull() & vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def _best(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """Merge the heaps of several cells: ``size`` best rows, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, cell_bytes: int = CELL_BYTES
) -> DataFrame:
    """For every anchor and each of its best ``positives`` rows of the same label, its ``negatives`` best rows of other labels in the positive's window.

    A score is the integer inner product of the vectors' components floor(256 x); higher scores come first, ties by
    smaller id (null ids last).  A negative's score lies from ``low`` to ``high`` hundredths of the positive's, both
    ends included.  Rows for which ``takes_part`` does not hold are left out.  ``anchor`` is a condition on the row;
    an anchor is not its own positive, an equal row is.  Equal anchors are mined once and returned as often as they
    stand there.  Vectors of different lengths have no score.  Scores beyond 64 bits are held at the ends of the range.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.  No row is left out of
    the comparison: anchors meet all rows, in cells of ``cell_bytes`` a side at most.  The grid has as many cells as
    rows and anchors ask for, so memory stays bounded and the shuffle carries each row once for every block of anchors.
    """
    spark = vectors.sparkSession
    clean = vectors.where(takes_part(F.col(label_col), F.col(vector_col)))
    rows = clean.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vec"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    wanted = rows.where("is_anchor").groupBy("id", "label", "vec").agg(F.count("*").alias("copies"))
    wanted = cut(wanted.withColumn("aid", F.monotonically_increasing_id()))  # numbers that later jobs must find again
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    side = max(1, cell_bytes // (8 * max(1, sizes["d"] or 1)))
    blocks = max(1, -(-wanted.count() // side))
    parts = max(1, -(-sizes["n"] // side), -(-4 * spark.sparkContext.defaultParallelism // blocks))

    def dealt(df: DataFrame, number: Column, own: int, others: int, cell) -> DataFrame:
        """Each row to all cells of its row or column of the grid; equal rows part by their number."""
        mine = F.pmod(F.xxhash64(number), F.lit(own))
        return df.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("cell", cell(F.col("_mine"), F.col("_other"))).drop("_mine", "_other")

    def by_cell(anchors: DataFrame):
        anchors = dealt(anchors, F.col("aid"), blocks, parts, lambda p, q: p * parts + q)
        others = dealt(rows.select("id", "label", "vec"), F.monotonically_increasing_id(), parts, blocks, lambda q, p: p * parts + q)
        return anchors.groupBy("cell").cogroup(others.groupBy("cell"))

    found = by_cell(wanted.select("aid", "id", "label", "vec")).applyInArrow(partial(_positives, size=positives + 1), "aid long, id long, score long, same boolean")
    best = _best(found, ["aid"], positives + 1).groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "same"))).alias("top"))
    self_at = F.coalesce(F.array_min(F.transform(F.filter("top", lambda x: x["same"]), lambda x: x["rank"])), F.lit(0))
    others = F.slice(F.filter("top", lambda x: x["rank"] != F.col("self_at")), 1, positives)
    known = cut(best.withColumn("self_at", self_at).select("aid", F.transform(others, lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("top")))

    anchors = wanted.join(known.where(F.size("top") > 0), "aid").select("aid", "id", "label", "vec", F.col("top.score").alias("positives"))
    hits = by_cell(anchors).applyInArrow(partial(_negatives, size=negatives, low=low, high=high), "aid long, place int, id long, score long")
    hits = _best(hits, ["aid", "place"], negatives)
    named = wanted.select("aid", F.col("id").alias("anchor_id"), "copies").join(known, "aid")
    out = hits.join(named, "aid").withColumn("positive", F.get("top", F.col("place") - 1)).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
