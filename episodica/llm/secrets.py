"""Secret scans judged by how widely a candidate is owned across the corpus.

Patterns propose candidates in each whole text.  The hash of every candidate is counted over all documents
by distinct repositories and distinct owners: a value that many owners share is a copied example, one that
stays with an owner looks live.  Opaque tokens, which no keyword or fixed form gives away, count as secrets
only where ownership says so.  DataFrame functions alone; values leave the scan only as SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .spans import SPAN, Kind, find_spans, overlaps

#: Fixed patterns and lengths of the base kinds.  hex and access carry their least length in the pattern: a
#: run that is too short has no other match inside it.  assign keeps short matches, as they use up text.
BASE = [
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, lambda m, g: F.length(g) >= 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}"),
    Kind("hex", r"[0-9a-f]{32,}"),
]
_IN = "A-Za-z0-9+/_-"
#: A run of 24 or more token characters with a digit, a capital and a small letter.
OPAQUE = Kind("opaque", rf"(?<![{_IN}])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[{_IN}]{{24,}}+")


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    live_owners: int = 1,
    live_repos: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, base (spans), added (spans), n_live, n_example.

    Spans are (start, place, end, kind, tag), tag the SHA-256 of the value.  ``added`` holds opaque tokens that
    at most ``live_owners`` owners and ``live_repos`` repositories have and that no base span overlaps.  n_live
    and n_example count the document's spans (base and added) by the same test.  Null or empty text has none.
    A null owner, and each combination of repository columns with nulls, counts as one owner or repository.
    Repeated rows are judged row by row; an empty table gives none; clashing names in other columns don't matter.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\u0000")).alias("owner"),
        F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in repo_cols]).alias("repo"),
        text_or_empty(text_col).alias("t"),
    )
    found = find_spans(rows, "t", [*BASE, OPAQUE], "spans", lambda value: F.sha2(value, 256))
    base = F.filter("spans", lambda s: s["kind"] != OPAQUE.name)
    other = F.filter("spans", lambda s: (s["kind"] == OPAQUE.name) & ~overlaps(s, base))
    found = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", base.alias("base"), other.alias("other"))
    found = cut(found)
    each = found.select("row", "owner", "repo", F.explode(F.concat("base", "other")).alias("span")).withColumn("tag", F.col("span.tag"))
    # one row per (value, owner) and (value, repository) first: a value that fills the corpus shrinks before it moves
    owned = each.groupBy("tag", "owner").count().groupBy("tag").agg(F.count("*").alias("owners"))
    held = each.groupBy("tag", "repo").count().groupBy("tag").agg(F.count("*").alias("repos"))
    spread = owned.join(held, "tag").select("tag", ((F.col("owners") <= live_owners) & (F.col("repos") <= live_repos)).alias("live"))
    judged = each.join(spread, "tag").groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("live") & (F.col("span.kind") == OPAQUE.name), F.col("span")))).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if((~F.col("live")) & (F.col("span.kind") != OPAQUE.name)).alias("n_example"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.join(judged, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"), zero("n_live"), zero("n_example"))
