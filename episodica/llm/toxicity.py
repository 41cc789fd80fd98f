"""Toxicity by a classifier chain.

Categories are predicted one after another.  Each is a logistic model on hashed presence features (words,
and word beginnings for inflected forms) that also sees the probabilities of the categories before it.
The finer categories are kinds of toxic text that the labelled documents themselves show: a kind is told by the
feature most of its documents share beyond what documents at large would; the last category is toxicity itself.
While training, these come from models that had not seen the row (out-of-fold), so that later models meet
earlier ones as uncertain as they are on new text.  Models are fitted on a bounded sample of labelled rows;
every whole text is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
CACHE = 300_000

#: Finer categories before the last.
KINDS = 2


def token_features(token: str) -> list[int]:
    """Hashed features of one lower-case token: its letters, and their first four and five."""
    word = "".join(c for c in token if c.isalpha())
    if not word:
        return []
    names = [word] + [f"{word[:n]}*" for n in (4, 5) if len(word) >= n]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


class _Cache(dict):
    """token -> features, over a column table if one is given; emptied when it has grown large."""

    def __init__(self, columns: dict[int, int] | None = None):
        self.columns = columns

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = token_features(token)
        if self.columns is not None:
            found = [self.columns[f] for f in found if f in self.columns]
        if len(self) >= CACHE:
            self.clear()
        self[token] = value = tuple(found)
        return value


def _presence(text: str, cache: _Cache) -> set[int]:
    return {f for token in set(text.lower().split()) for f in cache[token]}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, inside: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights and, last, the bias of an L2 logistic model, by accelerated gradient steps.

    ``inside`` is 1 for the rows to learn from and 0 for the others, which count for nothing; so no fold copies ``x``.
    """
    n, m = float(inside.sum()), x.shape[1]
    w, v, rate = np.zeros(m + 1, np.float32), np.zeros(m + 1, np.float32), np.float32(min(0.9, (float(y @ inside) / n * 0.98 + 0.01)))
    w[-1] = v[-1] = np.log(rate / (1 - rate))
    # the curvature is at most a quarter of the largest eigenvalue of X'X / n, found by a few power steps
    u = np.ones(m, np.float32)
    for _ in range(8):
        u = x.T @ (x @ u * inside)
        u /= max(float(np.linalg.norm(u)), 1e-12)
    top = float(np.linalg.norm(x @ u * inside) ** 2) / n
    step = np.float32(1 / (0.25 * (top + 1) * 1.1 + l2))
    t = 1.0
    for _ in range(rounds):
        e = (_sigmoid(x @ v[:-1] + v[-1]) - y) * inside
        g = np.append(x.T @ e / n + l2 * v[:-1], e.sum() / n).astype(np.float32)
        new, t2 = v - step * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w


@dataclass
class Chain:
    names: list[str]
    columns: dict[int, int]
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(row, category), each category fed with those before it."""
        out = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            m = x.shape[1]
            z = x @ w[:m] + (out - 0.5) @ w[m:-1] + w[-1]
            out = np.concatenate([out, _sigmoid(z)[:, None].astype(np.float32)], axis=1)
        return out


def _dense(rows: list[np.ndarray], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    return x


def _telling(features: list[np.ndarray], marked: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of ``least`` documents or more, and by how many deviations their share among the marked ones is off.

    Counts go by bucket, document by document: the sample's features are never copied as a whole.
    """
    n, n1 = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for f, yes in zip(features, marked):
        n[f] += 1
        if yes:
            n1[f] += 1
    share = float(marked.sum()) / max(len(marked), 1)
    seen = np.flatnonzero(n >= least)
    expected = n[seen] * share
    return seen, (n1[seen] - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9) + 1)


def toxic_kinds(features: list[np.ndarray], toxic: np.ndarray, kinds: int = KINDS, least: int = 3) -> np.ndarray:
    """(row, category) 0/1: ``kinds`` kinds of toxic documents, then toxicity.

    A kind holds the toxic documents with the feature that tells most of those not in an earlier kind.
    """
    y, left = np.zeros((len(features), kinds + 1), np.float32), toxic > 0
    y[:, -1] = left
    for k in range(kinds):
        seen, spread = _telling(features, left, least)
        if not left.any() or not len(seen):
            break
        best = seen[spread.argmax()]
        y[:, k] = [yes and best in f for yes, f in zip(left, features)]
        left = left & (y[:, k] == 0)
    return y


def fit_chain(features: list[np.ndarray], labels: np.ndarray, names: list[str], folds: int = 3, width: int = 1024, least: int = 3) -> Chain:
    """Fit a chain on sparse presence features and a (row, category) 0/1 array.

    The ``width`` features that tell the last category best are kept.  Rows go to folds by position.
    """
    seen, spread = _telling(features, labels[:, -1] > 0, least)
    best = seen[np.argsort(-np.abs(spread), kind="stable")[:width]]
    best = np.sort(best)
    chain = Chain(names, {int(f): i for i, f in enumerate(best)})
    if not len(labels):
        chain.weights = [np.append(np.zeros(len(best) + k, np.float32), np.float32(-5)) for k in range(len(names))]
        return chain
    # one matrix: the features' columns, then what each category adds for the later ones
    x = np.zeros((len(features), len(best) + len(names)), np.float32)
    column = np.full(BUCKETS, -1, np.int32)
    column[best] = np.arange(len(best))
    for i, f in enumerate(features):
        at = column[f]
        x[i, at[at >= 0]] = 1
    fold, held = np.arange(len(x)) % folds, np.zeros(len(x), np.float32)
    for k in range(len(names)):
        y, xs = labels[:, k].astype(np.float32), x[:, : len(best) + k]
        for f in range(folds):
            inside = (fold != f).astype(np.float32)
            w = fit_logistic(xs, y, inside) if inside.any() else np.zeros(xs.shape[1] + 1, np.float32)
            held[fold == f] = _sigmoid(xs @ w[:-1] + w[-1])[fold == f]
        chain.weights.append(fit_logistic(xs, y, np.ones(len(x), np.float32)))
        x[:, len(best) + k] = held - 0.5
    chain.threshold = best_threshold(held, labels[:, -1])
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray, least: float = 0.15, most: float = 0.5) -> float:
    """The threshold of best F1 on out-of-fold probabilities, in the middle of its gap and within bounds."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + max(float(y.sum()), 1e-9))
    k = int(f1.argmax())
    below = float(p[order[k + 1]]) if k + 1 < len(p) else 0.0
    return float(np.clip((float(p[order[k]]) + below) / 2, least, most))


def labelled_features(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray, list[str]]:
    """Features and categories of at most ``sample_rows`` labelled texts, chosen by a hash of their id; a text counts once an id."""
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("t"))
    # an id may stand for any number of rows: the bound is one of rows, and holds before anything is collected
    chosen = rows.select("doc_id", "h").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache()
        for b in batches:
            found = [np.array(sorted(_presence(text, cache)), np.int32).tobytes() for text in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary())], ["doc_id", "h", "toxic", "f"])

    rows = rows.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "toxic", "t")
    # as Arrow: neither the JVM nor Python then holds a row's features as an object of its own
    got = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, h bigint, toxic int, f binary").toArrow()
    ids, hashes = got["doc_id"].to_pylist(), got["h"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], hashes[i]))
    features = [np.frombuffer(got["f"][i].as_buffer(), np.int32) for i in order]
    return features, toxic_kinds(features, got["toxic"].to_numpy()[order].astype(np.float32)), [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"]


def score_chain(docs: DataFrame, chain: Chain, keep: list[str], *, text_col: str = "text", block: int = 256) -> DataFrame:
    """Columns ``keep`` of ``docs`` with p_<category> for each category and ``is_toxic``.

    A kept column that has one of these names is replaced.
    """
    names = [f"p_{n}" for n in chain.names]
    keep = [c for c in keep if c not in (*names, "is_toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, width = _Cache(chain.columns), len(chain.columns)
        for b in batches:
            out = [np.zeros((0, len(names)), np.float32)]
            for start in range(0, b.num_rows, block):
                texts = b.column(b.num_columns - 1).slice(start, block).to_pylist()
                out.append(chain.probabilities(_dense([np.fromiter(_presence(t or "", cache), np.int64) for t in texts], width)))
            p = np.concatenate(out).astype(np.float64)
            columns = [*b.columns[:-1], *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= chain.threshold)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names, "is_toxic"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = "".join(f"`{n}` double, " for n in names)
    fields = "".join(f"`{c}` {t}, " for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{fields}{kinds}is_toxic boolean")


def judge_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000) -> DataFrame:
    """Columns ``keep`` (None: all) of ``docs`` with the probabilities of each category and ``is_toxic``.

    ``labels`` has doc_id and toxic (0/1); of repeated ids the highest label holds; ids or labels that are
    null are not learned from.  At most ``sample_rows`` labelled texts are learned from, a text that repeats under
    an id once.  A null or empty text gets the models' base rate; long texts are read whole.  Without any label
    nothing is toxic.  Repeated rows are scored alike; features that tell equally much go by number; an empty
    table gives none; columns of ``labels`` other than the two don't matter.
    """
    chain = fit_chain(*labelled_features(docs, labels, sample_rows, id_col, text_col))
    return score_chain(docs, chain, docs.columns if keep is None else keep, text_col=text_col)
