"""Text quality from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  Expectation-maximisation over the counts of
vote patterns, taken over the whole corpus, estimates how often each labeller is right and how common good
text is; a pattern's posterior is the soft label of its documents.  A linear scorer on hashed features is
fitted to soft labels of a bounded sample and scores every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut
from .mixing import word_count

BUCKETS = 1 << 15
CACHE = 300_000
#: Feature of a word that repeats the one before it.
AGAIN = 0
LABELLERS = ("symbols", "capitals", "word_length", "marks", "short", "repeated_lines", "repeated_words", "varied", "sentences")


def votes(text: Column) -> list[Column]:
    """One vote in -1, 0, 1 per labeller, from the whole text.

    A labeller that looks for one defect votes bad or nothing: a text without it may have another.
    """
    chars = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars
    words = F.greatest(word_count(text), F.lit(1))
    bad = lambda c: F.when(c, F.lit(-1)).otherwise(F.lit(0))
    mean, lines = F.length(text) / words, F.split(text, "\n")
    distinct = F.size(F.array_distinct(F.split(text, f"{SPACE_CLASS}+"))) / words
    ends = (F.size(F.split(text, r"[.!?](?=\s|\z)")) - 1) / words
    return [
        bad(share(r"[^\p{L}\p{N}\s.,;:'\"()!?-]+") > 0.06),
        bad(share(r"\p{Lu}+") > 0.3),
        bad((mean > 10) | (mean < 3)),
        bad(share("[!?|#*%$&]+") > 0.05),
        bad(words < 5),
        bad(1 - F.size(F.array_distinct(lines)) / F.size(lines) > 0.3),
        bad(share(r"(?<!\S)(\S++)(?:\s\1(?!\S))++") > 0.2),
        F.when(distinct < 0.15, F.lit(-1)).when(distinct > 0.25, F.lit(1)).otherwise(F.lit(0)),
        F.when(ends.between(1 / 60, 1 / 3), F.lit(1)).otherwise(F.lit(0)),
    ]


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """EM for two classes and independent labellers: (chance of each vote by class, share of good, posterior).

    ``patterns`` is (pattern, labeller) in -1, 0, 1.  It starts from the majority vote, which also says which
    class is the good one.
    """
    w = counts.astype(float)
    good = 1 / (1 + np.exp(-np.clip(patterns.sum(axis=1).astype(float), -20, 20)))
    table, prior = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(rounds):
        prior = float(np.clip((good * w).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3))
        for c, p in ((1, good), (0, 1 - good)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] = ((patterns == v) * (p * w)[:, None]).sum(axis=0) + 0.5
            table[c] /= table[c].sum(axis=1, keepdims=True)
        at = patterns + 1
        each = [np.log(table[c][np.arange(patterns.shape[1]), at]).sum(axis=1) for c in (0, 1)]
        z = np.log(prior) + each[1] - np.log(1 - prior) - each[0]
        good = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return table, prior, good


class _Tokens(dict):
    """Raw token -> number of its form; forms (shape, length, end) are few, and each has three hashed features."""

    def __init__(self):
        self.forms, self.hashed, self._table = {}, [], np.zeros((0, 3), np.int64)

    def __missing__(self, token: str) -> int:
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in token)
        squeezed = "".join(c for i, c in enumerate(shape) if i == 0 or c != shape[i - 1])[:12]
        form = (f"s{squeezed}", f"l{min(len(token), 24)}", f"e{shape[-2:]}")
        if form not in self.forms:
            self.forms[form] = len(self.forms)
            self.hashed.append([zlib.crc32(x.encode()) % BUCKETS for x in form])
        if len(self) >= CACHE:
            self.clear()
        self[token] = n = self.forms[form]
        return n

    def table(self) -> np.ndarray:
        """(form, 3) hashed features of all forms seen."""
        if len(self._table) < len(self.hashed):
            self._table = np.array(self.hashed, np.int64)
        return self._table


def features(text: str, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Sparse hashed features of a whole text, as shares of all its tokens' features."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    again = sum(map(eq, words, words[1:]))
    forms, count = np.unique(np.fromiter(map(tokens.__getitem__, words), np.int64, len(words)), return_counts=True)
    if len(tokens.forms) > CACHE:  # forms of odd scripts may be many; numbers start anew
        hashed = tokens.table()[forms]
        tokens.clear()
        tokens.__init__()
    else:
        hashed = tokens.table()[forms]
    at, place = np.unique(np.append(hashed.ravel(), AGAIN), return_inverse=True)
    n = np.bincount(place, weights=np.append(np.repeat(count, 3), again))
    return at[n > 0], np.sqrt(n[n > 0] / len(words)).astype(np.float32)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, l2: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer on soft labels, by Adagrad over the whole sample."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    if not len(rows):
        return w
    sizes = np.array([len(a) for a, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), sizes)
    for _ in range(rounds):
        z = np.bincount(row, weights=w[at] * value, minlength=len(rows)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / len(rows)
        g = np.bincount(at, weights=e[row] * value, minlength=BUCKETS + 1) + l2 * w
        g[-1] = e.sum()
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def score_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, quality (the scorer's, 0 to 1), keep.

    Null text counts as empty: it gets the scorer's bias; long texts are read whole.  At most ``sample_rows``
    texts, chosen by a hash of the id, fit the scorer, one that repeats under an id once; vote counts cover all.
    Repeated rows are scored alike; a score at the threshold is kept; an empty table gives none; other columns
    don't matter.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    base = [3**i for i in range(len(LABELLERS))]
    pattern = sum(((v + 1) * b for v, b in zip(votes(F.col("t")), base)), F.lit(0)).alias("pattern")
    voted = cut(rows.select("doc_id", F.xxhash64("t").alias("h"), pattern))
    # at most 3^9 rows, whatever the corpus
    counted = voted.groupBy("pattern").count().orderBy("pattern").collect()
    codes = np.array([r[0] for r in counted], np.int64)
    patterns = (codes[:, None] // np.array(base)) % 3 - 1
    posterior = fit_votes(patterns, np.array([r[1] for r in counted]))[2] if len(codes) else np.zeros(0)
    by_code = dict(zip(codes.tolist(), posterior.tolist()))
    # an id may stand for any number of rows: the bound is one of rows, and holds before anything is collected
    picked = voted.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample_rows)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for b in batches:
            found = [features(t, tokens) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "h", "pattern", "a", "v"])

    texts, picked = rows.withColumn("h", F.xxhash64("t")).alias("r"), picked.alias("p")
    sample = texts.join(F.broadcast(picked), F.expr("r.doc_id <=> p.doc_id and r.h = p.h")).select("r.doc_id", "r.h", "p.pattern", "r.t").dropDuplicates(["doc_id", "h"])
    got = sample.mapInArrow(sparse, f"doc_id {dict(rows.dtypes)['doc_id']}, h bigint, pattern int, a binary, v binary").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), r.h))
    weights = fit_scorer([(np.frombuffer(r.a, np.int32), np.frombuffer(r.v, np.float32)) for r in got], np.array([by_code[r.pattern] for r in got]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for b in batches:
            found = [features(t, tokens) for t in b.column(1).to_pylist()]
            z = np.array([float(weights[a] @ v) + weights[-1] for a, v in found])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(score >= threshold)], ["doc_id", "quality", "keep"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, quality double, keep boolean")
