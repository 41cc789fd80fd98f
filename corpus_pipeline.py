"""A corpus pipeline over ``documents``: five stages, each by one operator of episodica.llm.

toxicity -> near duplicates -> benchmark decontamination -> personal data -> mixing.  Every stage takes
(spark, docs, sf_dir) and judges all documents that the one before it kept; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result as Parquet in the shared checkpoint folder and
reads it again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import cut, ensure_checkpoint_dir, table
from episodica.llm.decontam import find_leaks
from episodica.llm.mixing import mix_sources
from episodica.llm.pii import find_personal, redact
from episodica.llm.simhash import near_duplicates
from episodica.llm.toxicity import judge_toxicity


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, hash, text): whole rows as one column, so that no column of theirs clashes with a stage's own.

    Rows are told apart by id and a hash of the text; rows equal in both are alike to every stage.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("doc"), F.col("doc_id"), F.xxhash64(text).alias("hash"), F.col("text"))


def _same_row(rows: DataFrame, other: DataFrame):
    return rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["hash"] == other["hash"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain rejects go; null and empty texts get its base rate.

    Rows of one id are judged each by its text, repeated rows alike.  An empty table gives none; columns named
    like the chain's own come through as they are.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, plain))
    judged = judge_toxicity(docs.toDF(*plain), table(spark, sf_dir, "labels"), plain, id_col=named["doc_id"], text_col=named["text"])
    return judged.where(~F.col("is_toxic")).select(*plain).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8) one row stays: that of the smallest (id, text hash).

    Rows without id come after those with one; of rows equal in id and text any one stays.  Null, empty and
    wordless texts are one group.  An empty table gives none; other columns don't matter.
    """
    found = near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = found.groupBy("component").agg(F.min_by(F.struct("doc_id", F.col("text_hash").alias("hash")), order).alias("k")).select("k.*")
    rows = _packed(docs)
    # what is left besides one row a group are rows of one id and one text
    return rows.join(kept, _same_row(rows, kept), "left_semi").dropDuplicates(["doc_id", "hash"]).select("doc.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; other rows of their id stay, and so do null and empty texts.

    Repeated rows go or stay together.  An empty table gives none; columns of any other name don't matter.
    """
    rows = _packed(docs)
    keyed = rows.select(F.struct("doc_id", "hash").alias("doc_id"), "text")
    leaks = cut(find_leaks(keyed, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id.*").distinct())
    return rows.join(leaks, _same_row(rows, leaks), "left_anti").select("doc.*")


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced by their kind; no row goes, n_chars follows the text.

    Spans go back to their text by id and a hash of the text, so rows that repeat an id keep their own.  Null
    texts stay null.  An empty table gives none; columns of any other name don't matter.
    """
    rows = _packed(docs)
    found = find_personal(docs).where("size(base) + size(added) > 0")
    found = found.select("doc_id", F.col("text_hash").alias("hash"), F.array_sort(F.concat("base", "added")).alias("spans")).dropDuplicates(["doc_id", "hash"])
    out = rows.join(found, _same_row(rows, found), "left")
    text = F.when(found["spans"].isNull(), rows["text"]).otherwise(redact(rows["text"], found["spans"]))
    out = out.select("doc", text.alias("clean"))
    made = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[made[c].alias(c) if c in made else F.col("doc").getField(c).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's bill: how often each document is taken; documents that are not taken stay listed with 0.

    Null and empty texts have no words and are never taken; rows without source are a source of their own; rows of
    one id share a key.  An empty table gives none; other columns don't matter.
    """
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("pii", redact_personal),
    ("mixing", mix),
]

#: Models and XXH64 fingerprints are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def _forget(spark: SparkSession, path: str) -> None:
    """Delete a stage's own folder once the next stage has been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; of the stages' folders only the last one's input stays, as the result reads it."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
