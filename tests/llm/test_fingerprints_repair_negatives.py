"""op11, op12 and op13 against plain Python, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episodica.llm import conversations as conv
from episodica.llm import fingerprints as fp
from episodica.llm import negatives as neg
from episodica.llm.queries import op11_fingerprints, op12_conversations, op13_hard_negatives


def words_of(text):
    return text.encode().lower().split()


# op11


def plain_sketch(text, scale=fp.SCALE, width=fp.WIDTH):
    values = [int(v) for v in fp.shingle_values(text, fp._Words(), width)]
    kept = {v for v in values if v < (1 << 64) // scale}
    return kept or ({min(values)} if values else set())


def share(a, b):
    return len(a & b) / len(a) if a and b else float(len(a) == len(b))


def plain_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (doc, text), (_, later) in zip(rows, rows[1:] + rows[:1]):
        text, later = text or "", later or ""
        tail = math.floor(len(text) / 3)
        edited = text[: len(text) - tail] + later[:tail]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(later)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), frozenset(a), frozenset(b), share(a, b), share(a, c)))
    return out


def test_shingles_by_their_words():
    """Equal five-word runs have equal values, others don't; short texts are one shingle."""
    rng = random.Random(1)
    text = [rng.choice("ab cd ef gh ij Ä é ß 日本".split()) for _ in range(4000)]
    values = fp.shingle_values(" ".join(text), fp._Words())
    grams = [tuple(w.encode().lower() for w in text[i : i + 5]) for i in range(len(text) - 4)]
    assert len(values) == len(grams) and len(set(zip(values.tolist(), grams))) == len(set(grams)) == len(set(values.tolist()))
    assert len(fp.shingle_values("one two", fp._Words())) == 1 and len(fp.shingle_values(" \n", fp._Words())) == 0
    assert fp.shingle_values("One  two", fp._Words()) == fp.shingle_values("one two", fp._Words()) != fp.shingle_values("two one", fp._Words())


def test_op11_equals_plain(spark, sf):
    given = pd.read_parquet(f"{sf}/documents.parquet")
    got = op11_fingerprints(spark, sf).collect()
    want = {r[0]: r for r in plain_fingerprints([(int(r.doc_id), r.text) for r in given.itertuples()])}
    assert len(got) == len(given) and {r.doc_id for r in got} == set(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == w[1:3]
        for text, kept in ((r.fingerprint, w[3]), (r.edited_fingerprint, w[4])):
            assert [int(text[i : i + 16], 16) for i in range(0, len(text), 16)] == sorted(kept)
        assert (r.near_edited, r.near_next) == pytest.approx(w[5:])
    long = [r for r in got if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.55 and np.mean([r.near_next for r in long]) < 0.1


@pytest.mark.parametrize("parts", [1, 7])
def test_op11_odd_rows(spark, parts):
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, None), (3, ""), (2, "  "), (1, long), (None, "tail of them all"), (7, "日本 語 " * 40)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("n_chars", F.lit(-1)).withColumn("pid", F.lit(9)).withColumn("key", F.lit("x")).repartition(parts)
    got = [tuple(r) for r in fp.compare_with_next(df).select("doc_id", "n_chars", "edited_sha256", "sketch", "near_edited", "near_next").collect()]
    assert len(got) == len(rows)
    equal = [g for g in got if g[0] == 5]
    assert equal[0][3] == equal[1][3] and sorted(g[5] for g in equal)[-1] == 1.0
    by_id = {g[0]: g for g in got if g[0] is not None}
    assert by_id[3][3] == [] and by_id[3][5] == 1.0 and by_id[2][5] == 0.0
    # the last in order meets the first
    last = next(g for g in got if g[0] == 1)
    assert last[1] == len(long) and last[4] > 0.6
    empty = fp.compare_with_next(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and fp.compare_with_next(spark.createDataFrame([(1, "ab cd ef")], "doc_id long, text string")).first()["near_next"] == 1.0


def test_merged_sketches_and_containment(spark):
    """A short text inside a much longer one, and inside a group's merged sketch."""
    words = [f"w{i}" for i in range(40_000)]
    docs = spark.createDataFrame([(1, "a", " ".join(words)), (2, "b", " ".join(words[5000:9000])), (3, "b", " ".join(words[7000:11000])), (4, "c", "other words only " * 300)], "doc_id long, source string, text string")
    made = fp.sketch_documents(docs)
    assert made.columns == ["doc_id", "source", "sketch"]
    one = made.alias("x").join(made.alias("y"), F.col("x.doc_id") < F.col("y.doc_id")).select("x.doc_id", "y.doc_id", fp.contained(F.col("y.sketch"), F.col("x.sketch")))
    shares = {(a, b): s for a, b, s in (tuple(r) for r in one.collect())}
    assert shares[1, 2] == 1.0 and shares[1, 3] == 1.0 and abs(shares[2, 3] - 0.5) < 0.15 and shares[1, 4] == 0.0
    merged = fp.merged_sketches(made, ["source"])
    again = merged.unionByName(merged).distinct()
    assert merged.count() == again.count()
    inside = {(r.doc_id, r.group): r.share for r in fp.contained_in_groups(made, merged.withColumnRenamed("source", "group"), ["doc_id"], ["group"]).collect()}
    assert inside[2, "a"] == inside[3, "b"] == inside[2, "b"] == 1.0 and 0.1 < inside[1, "b"] < 0.2 and (4, "a") not in inside


# op12


def plain_repair(rows):
    """Figures, audit and repaired text of a conversation's rows (turn, role, text) by the least (cost, letters) from every row and state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, put_in):
        """(cost, letters, repaired lines) from row i on after a row of initial ``last``; no more than two rows are put in at one place."""
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        role = "assistant" if last == "u" else "user"
        if put_in < 2:
            cost, letters, lines = best(i, role[0], put_in + 1)
            options.append((cost + 2, "I" + letters, (f"{role}:", *lines)))
        if i < len(rows):
            cost, letters, lines = best(i + 1, last, 0)
            options.append((cost + 3, "D" + letters, lines))
            if faults[i] in ("", "truncated"):
                extra = faults[i] == "truncated"
                own = rows[i][1][:1]
                if own and own in follows[last]:
                    cost, letters, lines = best(i + 1, own, 0)
                    options.append((cost + extra, "K" + letters, (f"{rows[i][1]}:{rows[i][2]}", *lines)))
                cost, letters, lines = best(i + 1, role[0], 0)
                options.append((cost + 2 + extra, "R" + letters, (f"{role}:{rows[i][2]}", *lines)))
        return min(options) if options else (10**6, "", ())

    cost, letters, lines = best(0, "", 0)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(c, [])
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if lot == 1 else "".join(x for x in text if x not in ".!?") if lot == 2 else text
        out[c] += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_op12_equals_plain(spark, sf):
    given = pd.read_parquet(f"{sf}/conversations.parquet")
    want = {c: plain_repair(r) for c, r in plain_damage((int(r.conv_id), int(r.turn), r.role, r.text) for r in given.itertuples()).items()}
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in op12_conversations(spark, sf).collect()}
    assert got == want and any(w[5] for w in want.values())


def random_rows(rng, convs, most):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "usr"]
    texts = ["Yes.", "no", "", " \n", "What?", "Go on!  ", "cut off", None, "日本。", "ok. then"]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(most)):
            rows.append((None if c == 3 else c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("chunk", [1, 2, 5, conv.CHUNK])
def test_op12_random_rows_in_chunks(spark, chunk):
    """Any chunk size gives what the plain search gives: passes, stitching and tracing over chunk borders."""
    rows = random_rows(random.Random(11), 60, 14)
    given = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("block", F.lit(1)).withColumn("state", F.lit("x")).repartition(5)
    want = {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in conv.repair_digests(conv.damage(given), given, chunk).collect()}
    assert got == want


def test_op12_one_long_conversation(spark):
    """One conversation over all partitions, with a text that half of its rows repeat."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), "Same." if rng.random() < 0.5 else f"Text {t}{rng.choice(['.', ''])}") for t in range(900)]
    given = spark.createDataFrame([*rows, *rows[:100]], "conv_id long, turn long, role string, text string")
    got = conv.repair_digests(given, given, 16).first()
    import sys

    sys.setrecursionlimit(20_000)
    assert tuple(got[f] for f in FIELDS) == plain_repair([r[1:] for r in [*rows, *rows[:100]]])
    out = conv.repaired_rows(given, 16).orderBy("place").collect()
    assert "".join(r.edit for r in out) == got.audit
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in out if r.edit != "D").encode()).hexdigest() == got.repaired_sha256


def test_op12_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.repair_digests(none, none).collect() == []
    ids = spark.createDataFrame([(4,), (None,), (4,)], "conv_id long")
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in conv.repair_digests(none, ids).collect()}
    assert got == dict.fromkeys((4, None), (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


# op13


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (37, 64, 91), (130, 33, 65), (200, 129, 77), (5, 0, 4)])
def test_strassen_equals_plain(m, k, n):
    rng = np.random.default_rng(m)
    for most in (300, 1 << 40):
        a, b = (rng.integers(-most, most, s) for s in ((m, k), (k, n)))
        assert (neg.strassen(a, b) == a @ b).all()


def whole(v):
    return [math.floor(256 * float(x)) for x in v]


def plain_negatives(rows, anchor):
    """(anchor, positive, rank, negative, scores) by Python's integers; rows are (id, label, vector)."""
    top = (1 << 63) - 1
    kept = [(i, label, whole(v)) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, label, v) in enumerate(kept):
        if not anchor(i):
            continue
        scored = [(max(-top, min(top, sum(x * y for x, y in zip(v, w)))), j, other) for m, (j, other, w) in enumerate(kept) if m != k and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(i, j, r + 1, s[1], p, s[0]) for r, s in enumerate(fit)]
    return sorted(out, key=str)


def test_op13_equals_plain(spark, sf):
    given = pd.read_parquet(f"{sf}/embeddings.parquet")
    rows = [(int(r.vec_id), (int(r.label) + 1) % 10 if r.vec_id % 7 == 0 else int(r.label), r.embedding.tolist()) for r in given.itertuples()]
    got = sorted((tuple(r) for r in op13_hard_negatives(spark, sf).collect()), key=str)
    assert got == plain_negatives(rows, lambda i: i % 50 == 0) and got


@pytest.mark.parametrize("cell", [1 << 10, neg.CELL_BYTES])
def test_op13_odd_rows(spark, cell):
    """Nulls, ties, repeated rows and anchors, unlike lengths, huge and non-finite components, tiny cells."""
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 2, 3]), [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(200)]
    rows += [rows[0], rows[50], rows[50], (50, 1, [1e30, -2.0, 0.0, 1e9]), (300, 2, [1e29, 1.0, 1.0, 1.0]), (301, 1, [1e200, 0.5, 0.5, 0.5])]
    rows += [(None, 1, [1.0, 1.0, 0.5, 0.5]), (302, None, [1.0] * 4), (303, 1, None), (304, 1, [1.0, None, 1.0, 1.0]), (305, 2, [float("nan")] * 4), (306, 2, [float("inf"), 0.0, 0.0, 0.0]), (100, 1, [1.0, 2.0]), (307, 1, [1.0, 1.9]), (308, 2, [1.0, 1.0]), (350, 7, [0.5] * 4), (309, 1, [])]
    given = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("cell", F.lit(None).cast("string")).repartition(3)
    got = neg.mine_hard_negatives(given, F.col("vec_id") % 50 == 0, cell_bytes=cell)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows, lambda i: i is not None and i % 50 == 0)
    assert neg.mine_hard_negatives(given.limit(0), F.col("vec_id") % 50 == 0).collect() == []
