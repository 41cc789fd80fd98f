
import random

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, least=0.8):
    """Root of each text by all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], links


def varied_copies(rng):
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(60, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_near_copies_from_similarity_08_on_are_one_group(spark, sf):
    import corpus_pipeline as P

    texts = varied_copies(random.Random(3))
    root, links = brute_components(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, docs, sf).collect()}
    assert links > 40 and kept == set(root)


def test_links_cross_range_borders_and_copies_do_not_fill_the_window(spark):
    import numpy as np

    from episodica.llm.embeddings import near_vectors, passes_for, projected_links

    rng = np.random.default_rng(2)
    # one pass in which all that is near stands within the window: only borders could lose a pair
    x = rng.standard_normal(8) + 0.02 * rng.standard_normal((40, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    assert near.all()
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "node bigint, v array<double>")
    for window in (40, 3):
        links = [(r.a, r.b) for r in projected_links(nodes, 0.9, 1, window, 7).collect()]
        root = {i: i for i in range(40)}
        for a, b in sorted(links):
            old, new = root[b], root[a]
            root = {i: new if r == old else r for i, r in root.items()}
        assert set(root.values()) == {root[0]} and all(near[a, b] and a < b for a, b in links)
    # 100 copies of one vector and a near one whose key stands apart from theirs in the single pass
    a = rng.standard_normal(8)
    near = a + 0.15 * rng.standard_normal((3, 8))
    rows = [(i, a.tolist()) for i in range(100)] + [(100 + i, v.tolist()) for i, v in enumerate(near)]
    out = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), passes=1, window=3).collect()}
    every = np.array([v for _, v in rows])
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    assert [out[i].n_links for i in range(103)] == ((every @ every.T >= 0.9).sum(axis=1) - 1).tolist() and out[102].component_id == 0
    assert passes_for(1000, 0.9, 128, 0.99) == 12 and 30 < passes_for(1_000_000, 0.9, 128, 0.99) < passes_for(30_000_000, 0.9, 128, 0.99) < 80


def added_terms(spark, texts):
    from episodica.llm.pii import find_personal

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: [r.t[s.start : s.end] for s in r.added] for r in find_personal(docs, keep_text=True).collect()}


FILLER = ["plain words of nothing at all stand here for long " * 60] * 20


def test_names_inside_their_entity_short_and_at_the_edge_are_terms(spark):
    smith = [f"see Smith <john.smith@smith.com> of nothing {i}" for i in "abcde"]
    got = added_terms(spark, smith + FILLER)
    assert all(got[i][-1:] == [] or "Smith" in got[i] for i in range(5)) and all("Smith" in got[i] for i in range(5))
    lee = [f"here Lee at +1 (523) 555-1055 and 王伟 {c}" for c in ("plain", "words", "stand")]
    got = added_terms(spark, lee + FILLER)
    assert all({"Lee", "王伟"} <= set(got[i]) for i in range(3)) and not got[5]
    edge = ["Zanzibarovich " + "of all " * 6 + "a.b@x.org"] * 3
    assert all("Zanzibarovich" in added_terms(spark, edge + FILLER)[i] for i in range(3))


def test_telling_terms_go_wherever_they_stand(spark, sf):
    import corpus_pipeline as P

    texts = ["plain zanzibarian a.b@mail.example.com here plain words " + "of all " * 20 + "Zanzibarian long"] * 2 + ["plain zanzibarian a.b@mail.example.com here"] * 2 + ["words zanzibarian plain"] + FILLER * 10
    got = added_terms(spark, texts)
    assert got[0] == ["zanzibarian", "Zanzibarian"] and got[2] == ["zanzibarian"] and got[4] == ["zanzibarian"] and not got[5]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert P.redact_personal(spark, docs, sf).where(F.lower("text").contains("zanzibarian")).count() == 0


def test_stages_judge_rows_not_ids(spark, sf):
    import corpus_pipeline as P

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(None, item), (None, "clean text without any passage at all"), (1, item), (1, "another clean text of the same id here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert {r.text for r in P.drop_leaks(spark, docs, sf).collect()} == {rows[1][1], rows[3][1]}
    twice = [(None, "a b c d e f"), (None, "a b c d e f"), (2, "g h i j k l"), (2, "g h i j k l"), (2, "a b c d e f"), (None, "m n o p q r"), (None, "m n o p q r")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in twice], DOCS)
    got = sorted(((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, sf).collect()), key=str)
    assert got == [(2, "a b c d e f"), (2, "g h i j k l"), (None, "m n o p q r")]
    docs = spark.createDataFrame([(1, "4111 1111 1111 1111@x.com then", "en", "s", 1)], DOCS)
    assert P.redact_personal(spark, docs, sf).first().text == "[CARD] then"
