"""Texts of one template: pairs that are proposed for verification grow with the texts, and no similar pair is lost."""

import random

import pytest

from episodica.llm import similar
from episodica.llm.common import cut
from episodica.llm.simhash import near_duplicates


def pages(rng, n, own):
    """n texts of a common 170-word template and ``own`` words each; every tenth has a near copy of two changed words."""
    common, out = [f"t{i}" for i in range(170)], []
    for k in range(n):
        words = common + [f"w{k}x{i}" for i in range(own)]
        out.append(words)
        if k % 10 == 0:
            out.append(words[:-1] + [f"z{k}"])
    rng.shuffle(out)
    return [" ".join(w) for w in out]


def brute(texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("own", [40])
def test_template_pages_equal_brute_force_without_squares(spark, monkeypatch, own):
    proposed, plain = [], similar.prefix_pairs
    monkeypatch.setattr(similar, "prefix_pairs", lambda *a: proposed.append(cut(plain(*a))) or proposed[-1])
    counts = []
    for n in (200, 400):
        texts = pages(random.Random(n), n, own)
        got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.component, []).append(r.doc_id)
        assert {d: min(g) for g in groups.values() for d in g} == dict(enumerate(brute(texts)))
        counts.append(proposed.pop().count())
    assert counts[1] <= 4 * counts[0] + 100 and counts[1] < 2 * 440


def test_prefixes_lose_no_pair(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(1, 400, 60).astype(np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([rng.choice(b, int(len(b) * rng.uniform(0.75, 1)), replace=False), rng.integers(1, 400, rng.integers(0, 8)).astype(np.uint64)])) for b in base for _ in range(12)]
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node bigint, set binary")
    members = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "node bigint, n int, root bigint")
    got = {tuple(sorted((r.a, r.b))) for r in similar.prefix_pairs(members, table, 0.8).collect()}
    want = {(j, i) for i, x in enumerate(sets) for j in range(i) if 10 * len(np.intersect1d(x, sets[j])) >= 8 * len(np.union1d(x, sets[j]))}
    assert want <= got and len(want) > 30
