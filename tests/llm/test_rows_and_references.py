"""Rows that share an id, clashing columns, empty tables, and plain Python references of the models and windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import langid, quality, toxicity
from episodica.llm.decontam import find_leaks
from episodica.llm.mixing import mix_sources
from episodica.llm.urls import CUT, Automaton, Rule

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- decontamination ---------------------------------------------------------------------------------------

DENSE = "Ann has 3 kg, Bob has 4 kg, Cal has 5 kg. How many kg do Ann, Bob and Cal have?"


@pytest.mark.parametrize("text,held", [
    (DENSE, True), (DENSE.replace("Ann", "Eve").replace("Bob", "Dan").replace("Cal", "Kim").replace("3", "7").replace("4", "8").replace("5", "9"), True),
    ("before it all " + DENSE.replace("Ann", "Eve").replace("3", "12") + " after it", True),
    (DENSE.replace("Ann", "Eve", 1), True), (DENSE.replace("Ann", "Eve", 1).replace("Ann", "Joe").replace("Bob", "Dan", 1).replace("Cal", "Kim", 1).replace("3", "7").replace("4", "8").replace("5", "9"), False), (DENSE.replace("kg", "words"), False), ("1 2 3 4 5 6 7 8 9 10 11 12", False), ("Ann has 3 kg, Bob has 4 kg", False),
])
def test_slot_dense_items(spark, text, held):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, DENSE), (6, "1 2 3 4 5 6 77 8 9 10")], "item_id bigint, text string")
    r = find_leaks(docs, bench).first()
    assert (r["items"], r.contaminated) == (([5], True) if held else ([], False))


def plain_places(text, small, view):
    """(form, value) of each place of a text: tokens by regular expressions, runs of numbers or names as one."""
    out, opens = [], True
    for token in (text or "").split():
        core = re.sub(r"^[\W_]+|[\W_]+$", "", token)
        if not core:
            continue
        low, form = core.lower(), core.lower()
        if view and (re.search(r"\d", low) or low in ("two", "seven", "twelve", "twenty-one")):
            form = "<num>"
        elif view and low in ("kg", "km", "hours"):
            form = "<unit>"
        elif view == 2 and (low not in small or not opens and re.fullmatch(r"[A-Z]([a-z].*)?", core)):
            form = "<name>"
        opens = bool(re.search(r"[.!?:]$", token))
        if out and form in ("<num>", "<name>") and out[-1][0] == form:
            out[-1] = (form, out[-1][1] + " " + low)
        else:
            out.append((form, low))
    return out


def plain_windows(places, slotted):
    """position -> forms of the window that starts there."""
    found = {}
    for s in range(len(places) - 4):
        forms = [f for f, _ in places[s:]]
        ends = [e for e in range(5, len(forms) + 1) if not slotted or sum(f[0] != "<" for f in forms[:e]) >= 2]
        if ends:
            found[s] = tuple(forms[: ends[0]])
    return found


def plain_holds(text, item, small, least=0.8):
    for view in range(3):
        own, doc = plain_places(item, small, view), plain_places(text, small, view)
        if view == 0 and 0 < len(own) < 5:
            return any(doc[i : i + len(own)] == own for i in range(len(doc)))
        mine, theirs = plain_windows(own, view), plain_windows(doc, view)
        if not mine:
            continue
        if view == 0:
            if len(set(mine.values()) & set(theirs.values())) >= least * len(set(mine.values())):
                return True
            continue
        shifts, sound = {}, set()
        for s, form in mine.items():
            for t in [t for t, other in theirs.items() if other == form]:
                shifts.setdefault(t - s, []).append(s)
        for shift, places in shifts.items():
            said = {}
            for s in places:
                for u in range(s, s + 5):
                    form, value = own[u]
                    if form[0] == "<":
                        slot = (form, value, own[u + 1][1] if form == "<num>" and u + 1 < len(own) else None)
                        said.setdefault(slot, []).append((s, doc[u + shift][1]))
            usual = {k: max(Counter(x for _, x in v).items(), key=lambda kv: (kv[1], kv[0]))[0] for k, v in said.items()}
            if any(k[0] == "<name>" and not set(x.split()) & set(usual[k].split()) for k, v in said.items() for _, x in v):
                continue
            sound |= set(places) - {s for k, v in said.items() if k[0] != "<name>" for s, x in v if x != usual[k]}
        if len(sound) >= least * (len(own) - 4):
            return True
    return False


def small_words(items):
    cores = {re.sub(r"^[\W_]+|[\W_]+$", "", x) for i in items for x in (i or "").split()}
    return {c.lower() for c in cores if c and not re.fullmatch(r"[A-Z]([a-z].*)?", c)}


def test_all_readings_equal_brute_force(spark):
    rng = random.Random(8)
    names, words, units = ["Ann", "Bob", "Cal", "Dora", "Eve", "Will"], ["has", "and", "walks", "buys", "old", "red", "to", "will", "the"], ["kg", "km", "hours"]

    def piece(n):
        return " ".join(rng.choice([rng.choice(names), str(rng.randrange(9)), rng.choice(units), rng.choice(words), rng.choice(words) + rng.choice(["", "", "."])]) for _ in range(n))

    items = [piece(rng.randrange(2, 30)) for _ in range(25)] + [None, "", "7 8 9 1 2 3 4", "Ann Bob Cal Dora Eve Ann Bob"]
    texts = [None, "", "3 4 5 6 7 8 9", "has " * 300]
    for item in [i for i in items if i]:
        for _ in range(4):
            mapping = {x: rng.choice(names + ["Mary Ann"]) if x in names else rng.choice(["1 200", "seven", "31"]) if x.isdigit() else x for x in item.split()}
            changed = [mapping[x] for x in item.split()]
            if rng.random() < 0.5:
                changed[rng.randrange(len(changed))] = rng.choice(words + names + ["9"])
            changed = " ".join(changed)
            texts.append(piece(rng.randrange(5)) + " " + (changed.lower() if rng.random() < 0.3 else changed) + " " + piece(rng.randrange(5)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    small = small_words(items)
    want = {i: [k for k, item in enumerate(items) if plain_holds(t, item, small)] for i, t in enumerate(texts)}
    assert {r.doc_id: r["items"] for r in find_leaks(docs, bench).collect()} == want and sum(map(bool, want.values())) > 40


QUESTION = "Anton buys 3 pens, 3 books and 3 coins from the shop near the old bridge. Then Anton sells 12 of them to the teacher for 40 cents. How many things does Anton keep?"


@pytest.mark.parametrize("text,held", [
    (QUESTION.replace("Anton", "Mary Ann"), True), (QUESTION.replace("12", "1 200").replace("40", "seven"), True), (QUESTION.replace("Anton", "Mary").lower(), True),
    (QUESTION.replace("3 pens", "5 pens").replace("3 books", "8 books").replace("3 coins", "2 coins"), True),
    (QUESTION.replace("12", "15").replace("Anton", "Mary", 1).replace("Anton", "Bob", 1).replace("Anton", "Cal", 1).replace("3", "4").replace("40", "50"), False),
    (QUESTION.replace("buys", "paints").replace("sells", "shows").replace("shop", "river").replace("keep", "lose"), False),
])
def test_reparameterised_questions(spark, text, held):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, QUESTION), (6, "A train leaves Paris at 5 and the driver counts all of the people in it.")], "item_id bigint, text string")
    assert find_leaks(docs, bench).first()["items"] == ([5] if held else [])


STEMS = [
    "{a} has {x} apples and gives {y} of them to {b}. Later {b} buys {z} more at the market. How many apples does {b} have now?",
    "A train leaves {p} at {x} in the morning and reaches {q} after {y} hours. How fast does the train go if {p} and {q} are {z} km apart?",
    "{a} reads {x} pages of a book every day for {y} days. The book has {z} pages. How many pages are left for {a} to read?",
    "In the garden of {a} there are {x} red flowers and {y} white flowers. If {b} takes {z} flowers away, how many flowers can {a} still count?",
    "{a} and {b} share a cake that weighs {x} kg. {a} eats {y} percent of it and then {b} eats {z} percent of the rest. How much cake is left?",
    "A shop in {p} sells {x} chairs for {y} dollars each. What does {a} pay for {z} chairs if the owner takes ten percent off the price?",
]


def questions(rng, n):
    """(item, the same stem with other names and numbers in other forms, a question that differs in a third of its words)."""
    people, other, places = ["Anton", "Berta", "Carl", "Dora"], ["Mary Ann", "Jose Maria Lopez", "Kim", "Oleg", "Priya"], ["Leeds", "York", "Bonn", "New Delhi", "Sao Paulo", "Kiel"]
    for _ in range(n):
        stem = rng.choice(STEMS)
        (a, b), (c, d), (p, q, r, s) = rng.sample(people, 2), rng.sample(other, 2), rng.sample(places, 4)
        numbers = lambda: [rng.choice([str(rng.randrange(2, 99)), f"{rng.randrange(1, 9)} {rng.randrange(100, 999)}", rng.choice(["seven", "twelve", "twenty-one"])]) for _ in range(3)]
        x, y = dict(zip("xyz", numbers())), dict(zip("xyz", numbers()))
        new = stem.format(a=c, b=d, p=r, q=s, **y)
        words = new.split()
        for i in rng.sample(range(len(words)), len(words) // 3):
            words[i] = "the" if words[i] != "the" else "and"
        yield stem.format(a=a, b=b, p=p, q=q, **x), new.lower() if rng.random() < 0.3 else new, " ".join(words)


def test_recall_of_generated_questions(spark):
    made = list(questions(random.Random(3), 300))
    bench = spark.createDataFrame([(i, m[0]) for i, m in enumerate(made)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k * 1000 + i, "Some words before it. " + m[k] + " And some after it.") for i, m in enumerate(made) for k in (1, 2)], "doc_id bigint, text string")
    got = {r.doc_id: r["items"] for r in find_leaks(docs, bench).collect()}
    found, wrong = sum(i in got[1000 + i] for i in range(300)), sum(i in got[2000 + i] for i in range(300))
    print("found", found, "wrong", wrong)
    assert found >= 270 and wrong == 0


def test_long_runs_of_numbers_are_read(spark):
    docs = spark.createDataFrame([(1, "7 " * 60_000 + DENSE), (2, "Ann " * 60_000)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, DENSE), (6, "3 " * 500 + "of all words here")], "item_id bigint, text string")
    assert {r.doc_id: r["items"] for r in find_leaks(docs, bench).collect()} == {1: [5], 2: []}


# --- mixing, URLs ------------------------------------------------------------------------------------------


def test_buckets_stay_even_when_a_fifth_is_of_low_quality(spark, monkeypatch):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "x y z").otherwise("words of usual length").alias("text"), F.lit("s").alias("source"))
    from episodica.llm import mixing

    seen, cut = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    mix_sources(docs, rows_per_bucket=400).count()
    totals = [r.total for r in seen[1].collect()]
    assert len(totals) == 100 and max(totals) <= 2 * sorted(totals)[50]


@pytest.mark.parametrize("glob,path,fits", [("/?x", "/éx", True), ("/?", "/é", True), ("/??", "/é", False), ("/?é", "/éé", True), ("/?x", "/\U0001f600x", True), ("/?", "/", False), ("/?*", "/é12", True)])
def test_a_question_mark_is_one_character(glob, path, fits):
    assert Automaton([Rule("block", "*", glob)]).matches([b".h" + bytes([CUT]) + path.encode()])[0, 0] == fits


# --- models ------------------------------------------------------------------------------------------------


def test_kernel_equals_plain_kernel():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcde fghij" if k % 2 else "klmno pqrst") for _ in range(40)) for k in range(30)]
    langs = ["a" if k % 2 else "b" for k in range(30)]
    rows = [langid.present(t) for t in texts]
    model = langid.fit_kernel(rows, langs, landmarks=8, ridge=1e-3)
    kernel = lambda x, y: len(set(x.tolist()) & set(y.tolist())) / (len(x) * len(y)) ** 0.5
    picked = [i for n in "ab" for i in [k for k in range(30) if langs[k] == n][:4]]
    k_nm = np.array([[kernel(r, rows[m]) for m in picked] for r in rows])
    k_mm = k_nm[picked]
    y = np.array([[float(n == x) for n in "ab"] for x in langs])
    weights = np.linalg.solve(k_nm.T @ k_nm + 1e-3 * 30 * k_mm + 1e-6 * np.eye(8), k_nm.T @ y)
    assert model.langs == ["a", "b"] and np.allclose(model.scores(rows), k_nm @ weights, atol=1e-3)


def test_chain_equals_plain_chain():
    rng = np.random.default_rng(4)
    features = [np.sort(rng.choice(60, size=6, replace=False)) for _ in range(80)]
    toxic = np.array([float(7 in f or 9 in f) for f in features], np.float32)
    y = toxicity.toxic_kinds(features, toxic)
    assert (y[:, 0] * y[:, 1] == 0).all() and (y[:, -1] == toxic).all() and 0 < y[:, 0].sum() < toxic.sum()
    kind = next(f for f in range(60) if all((f in x and t) == bool(k) for x, t, k in zip(features, toxic, y[:, 0])))
    assert kind in (7, 9)
    chain = toxicity.fit_chain(features, y, ["k", "l", "toxic"], width=40)
    x = np.zeros((len(features), len(chain.columns)), np.float32)
    for i, f in enumerate(features):
        x[i, [chain.columns[int(v)] for v in f if int(v) in chain.columns]] = 1
    got = chain.probabilities(x)
    for i, f in enumerate(features):
        before = []
        for k, w in enumerate(chain.weights):
            z = float(w[-1]) + sum(float(w[chain.columns[int(v)]]) for v in f if int(v) in chain.columns) + sum((p - 0.5) * float(w[len(chain.columns) + j]) for j, p in enumerate(before))
            before.append(1 / (1 + np.exp(-z)))
            assert abs(got[i, k] - before[-1]) < 1e-4
    assert ((got[:, -1] >= chain.threshold) == toxic).mean() > 0.95


def test_scorer_features_equal_plain_counts():
    text = "Some some words WORDS 12 a-b and and !!! end."
    at, value = quality.features(text, quality._Tokens())
    import zlib

    count, words = Counter(), text.split()
    for w in words:
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w)
        short = "".join(c for i, c in enumerate(shape) if not i or c != shape[i - 1])[:12]
        for name in (f"s{short}", f"l{min(len(w), 24)}", f"e{shape[-2:]}"):
            count[zlib.crc32(name.encode()) % quality.BUCKETS] += 1
    count[quality.AGAIN] += sum(a == b for a, b in zip(words, words[1:]))
    assert dict(zip(at.tolist(), (value**2 * len(words)).round().astype(int).tolist())) == {k: n for k, n in count.items() if n}


def test_scorer_reaches_the_least_loss():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(np.arange(1, 9), 3, replace=False)), np.ones(3, np.float32)) for _ in range(200)]
    soft = np.array([0.9 if 3 in a else 0.1 for a, _ in rows])
    w = quality.fit_scorer(rows, soft)
    p = np.array([1 / (1 + np.exp(-(w[a].sum() + w[-1]))) for a, _ in rows])
    assert np.abs(p - soft).mean() < 0.1


def test_samples_are_bounded_in_rows_of_one_id(spark):
    rows = [(1, f"words number {i} of a text that repeats its id", "en", "s", 1) for i in range(300)] + [(1, "the same text", "en", "s", 1)] * 300 + [(2, "otro texto", "es", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert len(toxicity.labelled_features(docs, labels, 10)[0]) == 10
    learn = docs.select("doc_id", "lang", F.col("text").alias("t"), F.lit(True).alias("learn"), F.lit(True).alias("some"))
    assert len(langid.training_rows(learn, 10)[0]) == 10 and len(langid.training_rows(learn, 1000)[0]) == 302
    assert quality.score_quality(docs, sample_rows=10).count() == 601


# --- pipeline ----------------------------------------------------------------------------------------------

STAGES = ["drop_toxic", "drop_near_duplicates", "drop_leaks", "redact_personal"]


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_clashing_columns_and_empty_tables(spark, sf, stage):
    import corpus_pipeline as P

    extra = ["_spans", "_id", "_hash", "_text", "p_toxic", "is_toxic", "row", "component", "doc", "hash", "spans", "clean", "c0", "h", "toxic"]
    rows = [(1, "mail a.b@x.org now and then", "en", "s", 27), (None, "plain words that nobody minds at all", None, None, 36), (3, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(f"own {c}").alias(c) for c in extra])
    out = getattr(P, stage)(spark, docs, sf)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == 3 and all(r[c] == f"own {c}" for r in got for c in extra)
    empty = getattr(P, stage)(spark, docs.limit(0), sf)
    assert empty.columns == docs.columns and empty.count() == 0


def test_mix_of_an_empty_table(spark, sf):
    import corpus_pipeline as P

    assert P.mix(spark, spark.createDataFrame([], DOCS), sf).count() == 0
