"""Registered queries of this subpackage and their SQL.  Each opN query is a thin contract over an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii
from .common import table
from .conversations import damage, repair_digests
from .decontam import find_leaks
from .embeddings import near_vectors
from .fingerprints import compare_with_next, fingerprint_text
from .langid import identify_languages
from .mixing import mix_sources
from .negatives import mine_hard_negatives
from .pii import find_personal
from .quality import score_quality
from .secrets import scan_secrets
from .simhash import simhash_components
from .spans import count_kind, span_text
from .toxicity import judge_toxicity
from .urls import domain_rule, filter_urls, host_words

URL_RULES = [
    domain_rule("block", "com", "/en/"),
    domain_rule("allow", "example.com", "/en/7"),
    domain_rule("allow", "net", "/de/"),
    domain_rule("block", "example.net", "/de/8"),
    domain_rule("block", "org", "/es/"),
    *host_words("block", "spam-farm", "cheap-pills", "casino"),
]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _digest(spans: Column) -> Column:
    return F.sha2(span_text(spans), 256).alias("base_sha256")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *kinds, _digest(F.col("base")), span_text(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_example")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    kinds = [count_kind(F.col("base"), k.name).alias(f"n_{k.name}") for k in pii.BASE]
    return found.select("doc_id", *kinds, _digest(F.col("base")), span_text(F.array_sort(F.concat("base", "added"))).alias("spans"), count_kind(F.col("added"), pii.TERM).alias("n_term"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_with_next(table(spark, sf_dir, "documents"))
    texts = [fingerprint_text(F.col(c)).alias(name) for c, name in (("sketch", "fingerprint"), ("edited_sketch", "edited_fingerprint"))]
    return found.select("doc_id", "n_chars", "edited_sha256", *texts, "near_edited", "near_next")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return repair_digests(damage(given), given)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(given.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mixing, op2_urls, op3_secrets, op4_simhash, op5_langid, op6_pii, op7_decontam, op8_embeddings, op9_toxicity, op10_quality, op11_fingerprints, op12_conversations, op13_hard_negatives)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(coalesce(text, '')) AS chars,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / CASE WHEN chars / greatest(size, 1) >= 4 AND chars / greatest(size, 1) <= 9 THEN 1.0 ELSE 0.25 END AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([1, 2, 3])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM k GROUP BY source),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / ((sum(weight) OVER ())
             - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM s),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, source,
       epochs + (size > 0 AND (2 * prefix + size)::DOUBLE <= 2 * rest)::BIGINT AS copies,
       (epochs + (size > 0 AND (2 * prefix + size)::DOUBLE <= 2 * rest)::BIGINT) * size AS taken
FROM p
"""

OP2_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, '.' || host AS h,
         CASE WHEN suffix('.' || host, '.example.com') AND prefix(path, '/en/7') THEN 'example.com/en/7'
              WHEN suffix('.' || host, '.example.net') AND prefix(path, '/de/8') THEN 'example.net/de/8'
              WHEN suffix('.' || host, '.com') AND prefix(path, '/en/') THEN 'com/en/'
              WHEN suffix('.' || host, '.net') AND prefix(path, '/de/') THEN 'net/de/'
              WHEN suffix('.' || host, '.org') AND prefix(path, '/es/') THEN 'org/es/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN contains(host, 'spam-farm') OR contains(host, 'cheap-pills') OR contains(host, 'casino') THEN 'block'
            ELSE 'allow' END AS verdict
FROM r
"""



def _op12_sql() -> str:
    """The least (cost, letters, lines) from every row and state on, found from a conversation's last row back."""

    def grown(cost: str, letter: str, line: str, of: str) -> str:
        return f"{{'c': {of}.c + {cost}, 'a': '{letter}' || {of}.a, 't': {line}{of}.t}}"

    def put_in(role: str, of: str) -> str:
        return grown("2", "I", f"'{role}:' || chr(10) || ", of)

    role_after, state_after = {"z": "user", "s": "user", "u": "assistant", "a": "user"}, {"z": "u", "s": "u", "u": "a", "a": "u"}
    may_keep = {"z": "su", "s": "u", "u": "a", "a": "u"}

    def own(state: str) -> str:
        kept = "role || ':' || text || chr(10) || "
        options = [grown("3", "D", "", f"b.{state}")]
        for initial in may_keep[state]:
            options.append(grown(f"CASE WHEN fault < 2 AND left(role, 1) = '{initial}' THEN fault ELSE 1000000 END", "K", kept, f"b.{initial}"))
        options.append(grown("CASE WHEN fault < 2 THEN 2 + fault ELSE 1000000 END", "R", f"'{role_after[state]}:' || text || chr(10) || ", f"b.{state_after[state]}"))
        return f"list_min([{', '.join(options)}])"

    return rf"""
WITH RECURSIVE w AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
             lambda c, x: list_reduce(list_concat([xor(c, x)]::BIGINT[], range(8)), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)))), 4294967295) % 20 AS lot
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM w, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) WHERE lot <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(md5(text))) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (
  SELECT *, regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
         left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy
  FROM n),
r AS (
  SELECT *, CASE WHEN last = '' THEN 2 WHEN copy > 1 THEN 3 WHEN last IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault FROM f),
b AS (
  SELECT conv_id, max(n) + 1 AS i, {{'c': 0, 'a': '', 't': ''}} AS z, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS s,
         {{'c': 2, 'a': 'I', 't': 'assistant:' || chr(10)}} AS u, {{'c': 0, 'a': '', 't': ''}} AS a
  FROM n GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_min([z, {put_in("user", "nu")}]), list_min([s, {put_in("user", "nu")}]), nu, na
  FROM (SELECT *, list_min([u, {put_in("assistant", "a")}]) AS nu, list_min([a, {put_in("user", "u")}]) AS na
        FROM (SELECT r.conv_id, r.i, {own("z")} AS z, {own("s")} AS s, {own("u")} AS u, {own("a")} AS a
              FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1))),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
         count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.z.c, 0)::BIGINT AS cost, coalesce(b.z.a, '') AS audit, sha256(coalesce(left(b.z.t, greatest(length(b.z.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
"""


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_urls": OP2_SQL, "op12_conversations": _op12_sql(), "op13_hard_negatives": OP13_SQL}
