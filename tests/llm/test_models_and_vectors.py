"""URL rules, models, decontamination, vectors and the pipeline against brute force or held-out labels."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import queries
from episodica.llm.decontam import find_leaks
from episodica.llm.embeddings import near_vectors
from episodica.llm.langid import identify_languages
from episodica.llm.quality import fit_votes, score_quality
from episodica.llm.toxicity import fit_chain, judge_toxicity, labelled_features
from episodica.llm.urls import CUT, Automaton, Rule, filter_urls

from .test_advice_r01 import brute_components

LARGER = "/root/testdata/sf0.01"


def test_automaton_equals_patterns():
    rng = random.Random(1)
    globs = ["*.a", "b?.*", "*a*b*", ".", "*", "?a", "*.com"]
    rules = [Rule("block", h, p) for h in globs for p in ("*", "/x*", "*/y", "/?/*z*", "")]
    urls = []
    for _ in range(400):
        host = "." + "".join(rng.choice("ab.") for _ in range(rng.randrange(7))) + rng.choice(["", ".com"])
        path = "".join(rng.choice("/xyzé") for _ in range(rng.randrange(6)))
        urls.append((host, path))
    urls.append(("." + "ab" * 40_000, "/x" * 100))

    def plain(glob, text, any_):
        return re.fullmatch("".join(any_ + "*" if c == "*" else any_ if c == "?" else re.escape(c) for c in glob), text, re.S) is not None

    got = Automaton(rules).matches([h.encode() + bytes([CUT]) + p.encode() for h, p in urls])
    for i, (h, p) in enumerate(urls):
        for k, r in enumerate(rules):
            assert got[i, k] == (plain(r.host, h, ".") and plain(r.path, p, ".")), (h, p, r)


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://X.Example.COM/en/7?a", "x.example.com", "/en/7", "example.com/en/7", "allow"), ("https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"), ("x://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("http://a.net/de/8", "a.net", "/de/8", "net/de/", "allow"), ("http://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"),
    (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://evil.org/x.com/en/", "evil.org", "/x.com/en/", None, "allow"), ("http://spam-farm.org", "spam-farm.org", "", None, "block"), ("http://a://b/c", "a:", "//b/c", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    r = filter_urls(spark.createDataFrame([(1, url, "x")], "page_id bigint, url string, host string"), queries.URL_RULES).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    key = lambda df: sorted(tuple("" if x is None or x != x else round(float(x), 5) if not isinstance(x, str) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    out = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert set(out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]) == {True}
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    again = identify_languages(docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.col("lang")))).toPandas()
    assert dict(zip(again.doc_id, again.lang_pred)) == dict(zip(out.doc_id, out.lang_pred))


def test_languages_of_letterless_texts(spark):
    rows = [(i, "el perro come", "es", "s", 1) for i in range(8)] + [(i, "the dog eats", "en", "s", 1) for i in range(8, 16)] + [(20, None, "en", "s", 1), (21, "", None, "s", 1), (22, "123 !?", "es", "s", 1), (23, "the the dog", None, "s", 1)]
    out = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert [out[i].lang_pred for i in (20, 21, 22, 23)] == ["und", "und", "und", "en"] and out[20].score == 0


def test_toxicity_on_rows_it_has_not_seen(spark):
    # a few hundred toxic examples are learned from here; a third of the labels is held out
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = F.crc32(F.col("doc_id").cast("string")) % 3 != 0
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = judge_toxicity(docs, labels.where(seen), ["doc_id"]).join(labels.where(~seen), "doc_id").toPandas()
    toxic = out[out.toxic == 1]
    assert len(out) > 800 and toxic.is_toxic.mean() > 0.75 and out[out.toxic == 0].is_toxic.mean() < 0.01


def test_chain_feeds_earlier_categories(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    features, y, names = labelled_features(docs, labels, 5000)
    chain = fit_chain(features, y, names)
    assert [len(w) - 1 - len(chain.columns) for w in chain.weights] == [0, 1, 2] and np.abs(chain.weights[2][-3:-1]).max() > 0
    assert len(labelled_features(docs, labels, 50)[0]) == 50


def test_no_labels_no_toxicity(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert judge_toxicity(docs, labels.limit(0), ["doc_id"]).where("is_toxic").count() == 0


def test_quality_agrees_with_labels(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    out = score_quality(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").toPandas()
    assert out[out.label == 1].keep.mean() > 0.98 and out[out.label == 0].keep.mean() < 0.15


def test_votes_find_the_accuracy_of_labellers():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    right = [0.95, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) for a in right], axis=1) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    table, prior, _ = fit_votes(patterns, counts)
    assert abs(prior - 0.7) < 0.03 and all(abs(table[1, k, 2] - a) < 0.05 for k, a in enumerate(right))


def test_null_and_awkward_rows_are_judged(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "words of a text", "en", "s", 1), (4, "x" * 200_000, "en", "s", 1), (5, "\U0001f600 ok " * 50, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("toxic", F.lit("clash")).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(2, 1, 1), (2, 1, 0), (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "words of a text")], "item_id bigint, text string")
    assert judge_toxicity(docs, labels).count() == score_quality(docs).count() == identify_languages(docs).count() == find_leaks(docs, bench).count() == 6


ITEM = "Maria Lopez drives 120 km from Leeds to York in 3 hours and then Maria Lopez walks 5 km to the old museum near the river bank."


@pytest.mark.parametrize("text,leaks", [
    (ITEM, True), ("before it " + ITEM.upper() + " after it", True), (ITEM.lower().replace(",", ""), True),
    (ITEM.replace("Maria Lopez", "Anna Schmidt").replace("120", "75").replace("Leeds", "Bonn").replace("York", "Kiel"), True),
    (ITEM.replace("Maria Lopez", "Anna Schmidt", 1).replace("Leeds", "Bonn").replace("York", "Kiel"), False),
    (ITEM[:60], False), ("Nothing of the kind is said in this text about museums, rivers or old hours.", False), (None, False), ("", False),
])
def test_leaks(spark, text, leaks):
    docs = spark.createDataFrame([(7, text, "x")], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(1, ITEM), (2, "Two words")], "item_id bigint, text string")
    r = find_leaks(docs, bench).first()
    assert r.contaminated == leaks and r["items"] == ([1] if leaks else [])


def test_leaks_equal_brute_force(spark):
    docs, bench = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/benchmark.parquet")

    def windows(t):
        w = [x for x in (re.sub(r"^[^\w]+|[^\w]+$", "", x).lower() for x in (t or "").split()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = {r.item_id: windows(r.text) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        have = windows(r.text)
        want[r.doc_id] = sorted(i for i, w in items.items() if len(w & have) >= 0.8 * len(w))
    got = {r.doc_id: r["items"] for r in find_leaks(docs, bench).collect()}
    assert got == want and sum(map(bool, want.values())) > 10


def brute(x, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (u @ u.T >= cosine) & ~np.eye(len(x), dtype=bool)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    rows = []
    for k, c in enumerate(centres):
        n = 90 if k == 0 else rng.integers(1, 6)
        rows += [c + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25, 0.32]) for _ in range(n)]
    x = np.array(rows)
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [float("inf")] + [0.0] * 23]
    data = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000 + i, v, "x") for i, v in enumerate(bad)] + [(None, x[0].tolist(), "x")]
    out = near_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>, n_links string")).collect()
    link = brute(x)
    by = {r.vec_id: r for r in out}
    assert len(out) == len(data) and all(by[1000 + i].n_links == 0 and by[1000 + i].kept for i in range(len(bad)))
    found, true = sum(by[i].n_links for i in range(len(x))), int(link.sum())
    assert true >= found >= 0.97 * true and all(by[i].n_links <= link[i].sum() for i in range(len(x)))
    assert all(by[i].kept == (by[i].component_id == i) for i in range(len(x)))


def test_vectors_of_any_length_and_size(spark):
    """Unlike lengths never link, doubles of any size do, rows that repeat an id stand for themselves."""
    tiny, huge = 1e-200, 1e200
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0, 1.0]), (2, [5.0, 5.0, 5.0]), (3, [tiny, tiny]), (4, [tiny, 2 * tiny]), (5, [huge, huge]), (6, [1.7e308, 1.7e308]), (7, [5e-324, 5e-324]), (1, [9.0, 0.1]), (0, [1.0, 0.0]), (None, [1.0, 0.0])]
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()), key=str)
    assert out == sorted([(0, 2, 0, True), (0, 2, 0, True), (1, 0, 1, True), (1, 2, 0, False), (2, 0, 2, True), (3, 4, 3, True), (4, 4, 3, False), (5, 4, 3, False), (6, 4, 3, False), (7, 4, 3, False), (None, 0, None, True)], key=str)


@pytest.mark.parametrize("tile", [2048, 100])
def test_five_thousand_vectors_equal_brute_force(spark, tile, monkeypatch):
    """Clusters of up to 1200, tight and wide, counted as one product and as blocks (tile of 100)."""
    from episodica.llm import embeddings

    monkeypatch.setattr(embeddings._counts, "__defaults__", (tile,))
    rng = np.random.default_rng(6)
    rows = []
    for k, centre in enumerate(rng.standard_normal((350, 24))):
        n = {0: 1200, 1: 400}.get(k, int(rng.integers(1, 20)))
        rows += [centre + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25, 0.32]) for _ in range(n)]
    x = np.array(rows)
    assert len(x) > 4500
    link, out = brute(x), {r.vec_id: r for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    got, want = np.array([out[i].n_links for i in range(len(x))]), link.sum(axis=1)
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert (np.array([out[i].component_id for i in range(len(x))]) == root).mean() > 0.99


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, total = docs.columns, docs.count()
    toxic = P.drop_toxic(spark, docs, sf)
    gone = {r.doc_id for r in docs.select("doc_id").subtract(toxic.select("doc_id")).collect()}
    assert toxic.columns == columns and gone == {r.doc_id for r in queries.op9_toxicity(spark, sf).where("is_toxic").collect()}
    single = P.drop_near_duplicates(spark, docs, sf)
    # five-word shingles and similarity 0.8 hold in this stage, not the three words and three bits of op4's own contract
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    root, _ = brute_components([t for _, t in rows])
    blank = {i for i, t in rows if not (t or "").split()}
    want = {rows[k][0] for k in root if rows[k][0] not in blank} | ({min(blank)} if blank else set())
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want
    clean = P.drop_leaks(spark, docs, sf)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in queries.op7_decontam(spark, sf).where("not contaminated").collect()}
    redacted = P.redact_personal(spark, docs, sf)
    assert redacted.columns == columns and redacted.count() == total and redacted.where(F.col("text").rlike(r"@mail\d")).count() == 0
    assert redacted.where("n_chars <> length(text)").count() == 0
    ran = P.run(spark, sf).toPandas()
    assert [n for n, _ in P.STAGES][0] == "toxicity" and 0 < len(ran) < total and ran.taken.sum() > 0


def test_pipeline_stages_on_awkward_rows(spark, sf):
    import corpus_pipeline as P

    rows = [(1, "mail a.b@x.org now", "en", "s", 18), (1, "call +1 (523) 555-1055 now", "en", "s", 26), (None, "mail c.d@x.org then", None, None, 19), (4, None, "en", "s", None), (5, "", None, "s", 0), (5, "", None, "s", 0), (6, "\U0001f600 e@x.org", "en", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = P.redact_personal(spark, docs, sf)
    want = ["", "", "[EMAIL]", "call [PHONE] now", "mail [EMAIL] now", "mail [EMAIL] then", None]
    got = sorted((r.text for r in out.collect()), key=lambda x: (x is None, x or ""))
    assert len(got) == 7 and got[-1] is None and got[:2] == ["", ""] and sorted(got[2:6]) == sorted(["\U0001f600 [EMAIL]", *want[3:6]])
    for stage in (P.drop_toxic, P.drop_leaks):
        assert stage(spark, docs, sf).count() == 7
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, sf).collect()} == {None, 1, 4, 6}
    assert P.mix(spark, docs, sf).count() == 7
