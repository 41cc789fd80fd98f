"""Language identification by string kernels.

The kernel of two texts is the share of character n-grams (orders 1 to 3, hashed) present in both:
|A and B| / sqrt(|A| |B|).  Nystroem landmarks are a bounded subset of the training sample; a ridge regression
per language is fitted on the kernel against them (one versus rest).  The kernel is a product of scaled
presence vectors, so landmarks, their weights and presence vectors fold into one matrix, and a batch of
documents is scored by a single matrix product.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: Odd multipliers that spread n-grams over buckets.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def present(text: str) -> np.ndarray:
    """Buckets of the n-grams of orders 1 to 3 of a whole text, lower-cased, each once."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(BUCKETS, bool)
    for n in (1, 2, 3):
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            seen[h & np.uint32(BUCKETS - 1)] = True
    return np.flatnonzero(seen)


def _scaled(rows: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        if len(r):
            x[i, r] = 1 / np.sqrt(len(r))
    return x


@dataclass
class Kernel:
    langs: list[str]
    folded: np.ndarray  # (bucket, language): landmarks times their weights

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return _scaled(rows) @ self.folded


def fit_kernel(rows: list[np.ndarray], langs: list[str], landmarks: int = 256, ridge: float = 1e-3, block: int = 256) -> Kernel:
    """Nystroem ridge regression of one-versus-rest language indicators; landmarks are spread over languages."""
    names = sorted(set(langs))
    if not names:
        return Kernel([], np.zeros((BUCKETS, 0), np.float32))
    by = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    share = max(1, landmarks // len(names))
    picked = [i for n in names for i in by[n][:share]]
    z = _scaled([rows[i] for i in picked])
    k_mm = (z @ z.T).astype(np.float64)
    gram, target = np.zeros_like(k_mm), np.zeros((len(picked), len(names)))
    y = np.array([[float(x == n) for n in names] for x in langs])
    for s in range(0, len(rows), block):
        k = (_scaled(rows[s : s + block]) @ z.T).astype(np.float64)
        gram += k.T @ k
        target += k.T @ y[s : s + block]
    weights = np.linalg.solve(gram + ridge * len(rows) * k_mm + 1e-6 * np.eye(len(picked)), target)
    return Kernel(names, (z.T @ weights.astype(np.float32)))


def training_rows(docs: DataFrame, sample_rows: int) -> tuple[list[np.ndarray], list[str]]:
    """Presence vectors and languages of at most ``sample_rows`` labelled texts, chosen by a hash of their id; a text counts once an id and language."""
    rows = docs.where("learn and lang is not null and some").select("doc_id", "lang", F.xxhash64("t").alias("h"), "t")
    keys = ["doc_id", "lang", "h"]
    # an id may stand for any number of rows: the bound is one of rows, and holds before anything is collected
    asked = rows.select(*keys).distinct().orderBy(F.xxhash64("doc_id"), *keys).limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [present(t).astype(np.int16).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary())], [*keys, "f"])

    rows, asked = rows.alias("r"), asked.alias("a")
    rows = rows.join(F.broadcast(asked), F.expr(" and ".join(f"r.{k} <=> a.{k}" for k in keys)), "left_semi").dropDuplicates(keys)
    got = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang string, h bigint, f binary").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), r.lang, r.h))
    return [np.frombuffer(r.f, np.int16) for r in got], [r.lang for r in got]


def identify_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 4000,
    landmarks: int = 256,
    held_out: int = 2,
    block: int = 128,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learned from text and language of at most ``sample_rows`` documents whose crc32(id) mod 4 is not
    ``held_out`` and whose language is not null; a text that repeats under an id and language counts once.  Texts that are null or without a letter are ``und`` with score
    0, and so is everything where nothing can be learned.  A null id counts as empty text in the hash.  Ties go
    to the first language in order.  Repeated rows are judged alike; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    side = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == held_out
    rows = docs.select(F.col(id_col).alias("doc_id"), side.alias("held_out"), (~side).alias("learn"), F.col(lang_col).cast("string").alias("lang"), text.rlike(r"\p{L}").alias("some"), text.alias("t"))
    model = fit_kernel(*training_rows(rows, sample_rows), landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for s in range(0, b.num_rows, block):
                some, texts = b.column(2).slice(s, block).to_pylist(), b.column(3).slice(s, block).to_pylist()
                if not model.langs:
                    langs += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                got = model.scores([present(t) for t in texts])
                best, top = got.argmax(axis=1).tolist(), np.clip(got.max(axis=1), 0, 1).astype(float).tolist()
                langs += [model.langs[i] if ok else "und" for i, ok in zip(best, some)]
                scores += [x if ok else 0.0 for x, ok in zip(top, some)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    out = rows.select("doc_id", "held_out", "some", "t")
    return out.mapInArrow(run, f"doc_id {dict(out.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
