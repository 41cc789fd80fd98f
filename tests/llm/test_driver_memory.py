"""What the pipeline's driver holds: plans in steps, one matrix of the toxicity sample."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from episodica.llm.common import table
from episodica.llm.decontam import find_leaks
from episodica.llm.similar import may_resemble, set_bits
from episodica.llm.toxicity import fit_chain, labelled_features


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_decontamination_is_planned_in_steps(spark, sf):
    docs = table(spark, sf, "documents")
    leaks = find_leaks(docs, table(spark, sf, "benchmark"))
    assert leaks.where("contaminated").count() and exchanges(leaks) <= 8
    assert exchanges(P.drop_leaks(spark, docs, sf)) <= 4


def test_chain_holds_its_sample_once():
    rng = np.random.default_rng(1)
    features = [np.sort(rng.choice(4096, 40, replace=False)).astype(np.int32) for _ in range(3000)]
    labels = np.array([[7 in f, 9 in f, 7 in f or 9 in f] for f in features], np.float32)
    tracemalloc.start()
    chain = fit_chain(features, labels, ["k", "l", "toxic"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.9 * 3000 * 1027 * 4 and len(chain.columns) == 1024
    assert {7, 9} <= set(chain.columns)


def test_labelled_features_order_and_rows_without_words(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", "a b", None, "c!", "1 2"])], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    features, y, _ = labelled_features(docs, labels, 10)
    assert sorted(map(len, features)) == [0, 0, 0, 1, 2] and y[:, -1].sum() == 2
    assert [list(f) for f in features] == [list(f) for f in labelled_features(docs.repartition(3), labels, 10)[0]]
    assert labelled_features(docs.limit(0), labels, 10)[1].shape == (0, 3)


def test_bits_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        n, share = int(rng.integers(1, 400)), rng.choice([0.5, 0.7, 0.8, 0.81, 0.9, 1.0])
        pool = rng.integers(0, 2**63, 2 * n, np.uint64)
        both = int(np.ceil(2 * share / (1 + share) * n))
        x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
        met = len(np.intersect1d(x, y))
        rows.append((i, set_bits(x).tolist(), set_bits(y).tolist(), len(x) + len(y), met >= 0.8 * (len(x) + len(y) - met)))
    df = spark.createDataFrame(rows, "i long, x array<bigint>, y array<bigint>, n long, similar boolean")
    judged = df.withColumn("may", may_resemble("x", "y", F.col("n"), 0.8))
    assert judged.where("similar").count() > 150 and judged.where("similar and not may").count() == 0
    assert judged.where("not similar and not may").count() > 50
