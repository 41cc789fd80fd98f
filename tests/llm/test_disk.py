"""What steps leave on disk, and how many of them there are."""

import time

import pytest
from pyspark.sql import functions as F

from episodica.llm import components, similar
from episodica.llm.common import CLEANUP, EXCLUDED, cut


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    df = spark.range(5000, numPartitions=3).groupBy((F.col("id") % 50).alias("k")).count()
    df = df.join(spark.range(0, 60, 1, 3).withColumnRenamed("id", "k").hint("merge"), "k")
    setting, before = spark.conf.get(CLEANUP), shuffle_files(spark)
    out = cut(df)
    assert not shuffle_files(spark) - before and spark.conf.get(CLEANUP) == setting
    assert out.count() == df.count() == len(df.collect()) == 50 and out.columns == df.columns


@pytest.mark.parametrize(("limit", "rules"), [("-1", None), ("10m", "some.Rule")])
def test_no_stage_outlives_a_cut(spark, limit, rules):
    """Tasks that outlive it ask a cluster's driver for shuffle files that are gone, and hold their cores for minutes."""
    done = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def slow(x):
        time.sleep(0.1)
        done.add(1)
        return x

    kept = {name: spark.conf.get(name, None) for name in (EXCLUDED, "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    if rules:
        spark.conf.set(EXCLUDED, rules)
    try:
        # nothing but the run shows that one side is empty
        many = spark.range(40, numPartitions=3).select(F.col("id").alias("k"), slow("id").alias("x"))
        none = spark.range(0, 1000, 1, 2).where(F.spark_partition_id() > 9).groupBy(F.col("id").alias("k")).count()
        out = cut(many.join(none, "k"))
        assert done.value == 40 and spark.conf.get(EXCLUDED, None) == rules
        assert out.count() == 0 and out.columns == ["k", "x", "count"]
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def rounds(spark, monkeypatch, edges):
    made = []
    monkeypatch.setattr(components, "cut", lambda df: made.append(1) or cut(df))
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    return got, len(made) - 1


def test_stars_need_no_round(spark, monkeypatch):
    got, n = rounds(spark, monkeypatch, [(0, i) for i in range(1, 60)] + [(i, 100) for i in range(101, 130)] + [(7, 0), (5, 5)])
    assert n == 0 and got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 130)}


def test_paths_and_late_minima_settle(spark, monkeypatch):
    # two paths, a root that another component's hub points at, and a node of two smaller ends
    edges = [(i, i + 1) for i in range(200, 230)] + [(x, x + 7) for x in range(400, 470, 7)] + [(50, 60), (60, 1), (9, 90), (8, 90)]
    got, n = rounds(spark, monkeypatch, edges)
    want = {i: 200 for i in range(200, 231)} | {x: 400 for x in range(400, 471, 7)} | {1: 1, 50: 1, 60: 1, 8: 8, 9: 8, 90: 8}
    assert got == want and n > 0


def test_prefixes_take_shared_shingles_alone(spark, monkeypatch):
    held = []
    monkeypatch.setattr(similar, "cut", lambda df: held.append(cut(df)) or held[-1])
    import numpy as np

    sets = [np.array([*range(10, 20), 100 + i], np.uint64) for i in range(6)]
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node bigint, set binary")
    members = spark.createDataFrame([(i, 11, i) for i in range(6)], "node bigint, n int, root bigint")
    got = {(r.a, r.b) for r in similar.prefix_pairs(members, table, 0.8).collect()}
    assert got == {(i, j) for i in range(6) for j in range(i + 1, 6)}
    often, placed = held
    assert often.count() == 10 and placed.count() == 6 * 2
