"""Word shingles of whole texts and what fingerprints are made of."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 of every ``width``-word shingle, ASCII lower-cased; fewer words give one shingle of them all."""
    words = text.lower().split()  # bytes.split cuts exactly at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; byte lanes hold counts of up to 255 rows at a time."""
    n = len(hashes)
    if n == 0:
        return 0
    rows = np.zeros((-(-n // 255) * 255), np.uint64)
    rows[:n] = hashes
    rows = rows.reshape(-1, 255)
    value = 0
    for k in range(8):
        lanes = ((rows >> np.uint64(k)) & LANES).sum(axis=1, dtype=np.uint64).astype("<u8")
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in range(8):
            if 2 * int(counts[lane]) > n:
                value |= 1 << (8 * lane + k)
    return value
