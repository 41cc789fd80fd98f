"""Personal data by pattern, and by what the corpus reveals about it.

Patterns find protected entities in each whole text.  Terms around an entity are then measured against the
whole corpus: a term that stands mostly beside one entity reveals it even when the entity itself is gone.
The strength is P(entity | term), its occurrences beside the entity over all its occurrences, with pointwise
mutual information in bits; terms over both thresholds are removed along with the entity.
DataFrame functions alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .spans import BLOCK, SPAN, Kind, chunked, find_spans, let, once, part

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Fixed patterns and lengths of the base kinds.  Written so that a long run costs one pass: possessive where
#: backing off cannot help, and starting only where a run starts or the last match ended.
BASE = [
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0, lambda m, g: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}\z")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", 0, lambda m, g: F.length(_digits(m)).between(14, 19) & luhn(_digits(m))),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda m, g: F.length(_digits(m)).between(10, 15)),
]
TERM = "term"
_WORD = r"\p{L}\p{M}'-"


def find_entities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, base) for every row: whole text and its base spans, tag the SHA-256 of the value."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    return find_spans(rows, "t", BASE, "base", lambda value: F.sha2(value, 256))


def _stitched(text: Column, spans: Column, piece: Callable[[Column, Column, Column], tuple[Column, Column]]) -> Column:
    """``text`` with pieces put for its spans: ``piece(chunks, at, span)`` gives what stands from place ``at`` to the span's end, and the place after it.

    Spans are taken in blocks, so that what has been put together is copied once a block and not once a span.
    """

    def fold(chunks: Column) -> Column:
        def put(acc, s):
            out, at = piece(chunks, acc["at"], s)
            return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], out).alias("out"))

        def block(acc, b):
            got = F.aggregate(F.slice(spans, b * BLOCK + 1, BLOCK), F.struct(acc["at"].alias("at"), F.lit("").alias("out")), put)
            return let(got, lambda g: F.struct(g["at"].alias("at"), F.array_append(acc["parts"], g["out"]).alias("parts")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        blocks = F.sequence(F.lit(0), F.floor(F.size(spans) / BLOCK).cast("int"))
        return F.aggregate(blocks, start, block, lambda acc: F.concat(F.array_join(acc["parts"], ""), part(chunks, acc["at"], chunks["n"] - acc["at"])))

    return F.when(F.size(spans) > 0, let(chunked(text), fold)).otherwise(text)


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span blanked, so that all places stay."""

    def piece(chunks, at, s):
        start, end = F.greatest(at, s["start"]), F.greatest(at, s["end"])
        return F.concat(part(chunks, at, start - at), F.repeat(F.lit(" "), end - start)), end

    return _stitched(text, spans, piece)


#: Bytes up to which the telling terms are broadcast; more are joined by a shuffle.
SMALL = 16_000_000
#: Characters in which the rest of a word over a window's edge is looked for first.
EDGE = 64


def _near_terms(found: DataFrame, reach: int) -> DataFrame:
    """(row, entity, term, start, end) for the words that stand, or begin or end, within ``reach`` characters of an entity.

    Windows are cut out inside the text's row, so that no row but its own carries a text.
    """
    m, inside = F.col("m"), rf"\A[{_WORD}]+\z"

    def windows(chunks: Column) -> Column:
        def window(s):
            at, to = F.greatest(s["start"] - reach, F.lit(0)), F.least(s["end"] + reach, chunks["n"])
            lead = F.greatest(at - EDGE, F.lit(0))
            return F.struct(s["tag"].alias("entity"), at.alias("at"), to.alias("to"), lead.alias("lead"), part(chunks, lead, at - lead).alias("head"), part(chunks, at, to - at).alias("part"), part(chunks, to, F.lit(EDGE)).alias("tail"))

        return F.transform("base", window)

    def whole(w):
        # words over the window's edge are read whole, however long
        head = F.when((w["lead"] > 0) & w["head"].rlike(inside), F.regexp_extract(F.substr(m, F.lit(1), w["at"]), rf"(?<![{_WORD}])[{_WORD}]++\z", 0)).otherwise(w["head"])
        tail = F.when((F.length(w["tail"]) == EDGE) & w["tail"].rlike(inside), F.regexp_extract(F.substr(m, w["to"] + 1, F.length(m)), rf"\A[{_WORD}]++", 0)).otherwise(w["tail"])
        return F.struct(w["entity"].alias("entity"), w["at"].alias("at"), head.alias("head"), w["part"].alias("part"), tail.alias("tail"))

    cut_out = once(found.select("row", "m", "base"), {"near": let(chunked(m), windows)})
    near = cut_out.select("row", F.explode(F.transform("near", whole)).alias("w")).select("row", "w.*")
    before = F.when(F.col("part").rlike(rf"\A[{_WORD}]"), F.regexp_extract("head", rf"(?<![{_WORD}])[{_WORD}]++\z", 0)).otherwise("")
    after = F.when(F.col("part").rlike(rf"[{_WORD}]\z"), F.regexp_extract("tail", rf"\A[{_WORD}]++", 0)).otherwise("")
    near = near.select("row", "entity", (F.col("at") - F.length(before)).alias("at"), F.concat(before, "part", after).alias("part"))
    words = find_spans(near, "part", [Kind(TERM, rf"[{_WORD}]++")], "words", lambda w: F.lower(w))
    each = words.select("row", "entity", "at", F.explode("words").alias("w")).where(F.col("w.tag").rlike(r"\p{L}"))
    return each.select("row", "entity", F.col("w.tag").alias("term"), (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end")).distinct()


def _words(texts: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """(term, ...) for every word of every text: a run of letters, lower-cased, of any length."""
    words = texts.select(*keep, F.explode(F.split(F.lower(F.col(text_col)), f"[^{_WORD}]+")).alias("term"))
    return words.where(F.col("term").rlike(r"\p{L}"))


def term_counts(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n) over every word of every text outside base spans.

    Texts with base spans are few: their words are taken off whole and put back masked.
    """
    some = found.where(F.size("base") > 0)
    every = docs.select(text_or_empty(text_col).alias("t"))
    words = _words(every, "t", F.lit(1).alias("n")).unionByName(_words(some, "t", F.lit(-1).alias("n"))).unionByName(_words(some, "m", F.lit(1).alias("n")))
    return words.groupBy("term").agg(F.sum("n").alias("n"))


def disclosures(found: DataFrame, near: DataFrame, docs: DataFrame, text_col: str, share: float, bits: float, support: int) -> DataFrame:
    """(entity, term) pairs over the disclosure thresholds, counted over all documents."""
    joint = cut(near.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support))
    beside = near.groupBy("entity").agg(F.count("*").alias("beside"))
    asked = joint.select("term").distinct().withColumn("asked", F.col("term"))
    # the counts of all words meet the asked terms where they already are; all the rest falls into one row
    counts = term_counts(docs, found, text_col).join(asked, "term", "left").groupBy("asked").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    mass = counts.agg(F.sum("n")).first()[0] or 0
    scored = joint.join(counts.withColumnRenamed("asked", "term"), "term").join(beside, "entity")
    pmi = F.log2(F.col("both") * F.lit(mass) / (F.col("n") * F.col("beside")))
    return scored.where((F.col("both") / F.col("n") >= share) & (pmi >= bits)).select("entity", "term")


def _occurrences(docs: DataFrame, found: DataFrame, telling: DataFrame, text_col: str) -> DataFrame:
    """(text_hash, added): every place of a telling term outside base spans, in whatever text."""
    # every word of the corpus meets the terms: these are sent to it where their measured size allows
    size = telling.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    telling = F.broadcast(telling) if size <= SMALL else telling
    texts = docs.select(text_or_empty(text_col).alias("t")).select(F.xxhash64("t").alias("text_hash"), "t")
    masked = found.where(F.size("base") > 0).select("text_hash", "m").dropDuplicates(["text_hash"])
    words = _words(texts, "t", F.col("text_hash")).unionByName(_words(masked, "m", F.col("text_hash")))
    # a row's words meet the terms before anything is dealt out; one row a text is left
    holders = cut(words.join(telling, "term", "left_semi").select("text_hash").distinct())
    texts = texts.join(holders, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    texts = texts.join(masked, "text_hash", "left").select("text_hash", F.coalesce("m", "t").alias("m"))
    placed = find_spans(texts, "m", [Kind(TERM, rf"[{_WORD}]++")], "words", lambda w: F.lower(w)).select("text_hash", F.explode("words").alias("w"))
    placed = placed.select("text_hash", F.col("w.tag").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end")).join(telling, "term", "left_semi")
    span = F.struct("start", F.lit(len(BASE)).alias("place"), "end", F.lit(TERM).alias("kind"), F.lit(None).cast("string").alias("tag"))
    return placed.groupBy("text_hash").agg(F.array_sort(F.collect_set(span)).alias("added"))


def find_personal(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int = 48,
    share: float = 0.5,
    bits: float = 8.0,
    support: int = 3,
    keep_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, text_hash, base, added (spans) and, if asked for, t (the text).

    ``added`` holds every occurrence, in any text, of the terms that reveal an entity: those that stand within
    ``reach`` characters of it ``support`` times or more, with at least ``share`` of all their occurrences outside base spans and ``bits`` of information; a term
    is a word of any length.  Null text counts as
    empty and has no spans; repeated rows are judged row by row (and their occurrences count); an empty table
    gives none; columns of any other name don't matter.
    """
    found = find_entities(docs, id_col=id_col, text_col=text_col)
    some = F.size("base") > 0
    kept = F.col("t") if keep_text else F.when(some, F.col("t"))
    found = cut(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("t").alias("text_hash"), kept.alias("t"), F.when(some, _masked(F.col("t"), F.col("base"))).alias("m"), "base"))
    near = cut(_near_terms(found.where(some), reach))
    telling = disclosures(found, near, docs, text_col, share, bits, support)
    added = _occurrences(docs, found, cut(telling.select("term").distinct()), text_col)
    columns = ["row", "doc_id", "text_hash", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added")] + ["t"] * keep_text
    return found.join(added, "text_hash", "left").select(*columns)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are merged under the first's kind."""

    def piece(chunks, at, s):
        out = F.concat(part(chunks, at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= at, out).otherwise(""), F.greatest(s["end"], at)

    return _stitched(text, spans, piece)
