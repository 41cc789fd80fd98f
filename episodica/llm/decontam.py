"""Benchmark decontamination through templates.

Tokens are read three ways.  Exact: lower-cased.  Plain: numbers (digits or number words) and units become typed
placeholders.  Loose: names as well, where a name is a word that the benchmark nowhere writes in lower case, or one
with a capital inside a sentence; so a name is known without its capital, in the benchmark and in documents alike.
Runs of numbers and runs of names are one placeholder, so "1 200" stands where "7" did and "Mary Ann" where "Anton".

A window starts at each place: five places in the exact reading; in the others it goes on until it holds two
words that are no placeholders.  Places without such a window count against the share.  Windows are hashed; a
filter over the benchmark's hashes passes nearly only true hits, and hits are hash-joined with the benchmark's windows.
Where an item's share is reached in a reading with placeholders, slots must be consistent along one alignment.
A name stands for one name throughout (its values share a word), else the alignment is none.  A number's slot is
its value and what it counts, so equal numbers of different things are different slots; windows in which a
number or unit differs from its slot's usual value don't count.  The first five places of a window are looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW, LITERALS = 5, 2
#: Characters of text that one block of windows holds.
BLOCK_CHARS = 2_000_000
VOCABULARY = 500_000
#: Bits of a filter, as powers of two: 128 a hash within these bounds.
LEAST_BITS, MOST_BITS = 16, 26
#: Fixed list of units that may follow a number.
UNITS = frozenset("mm cm m km ft mi mg g kg lb oz ml l s sec min h hr hour hours day days week weeks year years percent % $ € £ usd eur dollars euros cents mph kmh".split())
#: Fixed list of number words.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

EXACT, PLAIN, LOOSE = 0, 1, 2
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
HITS = "row bigint, doc_id {kind}, view int, hash bigint, pos int, slots array<string>, starts int"
NAMES = ["row", "doc_id", "view", "hash", "pos", "slots", "starts"]
ODD = 0x9E3779B97F4A7C15
PLACES = np.array([0, *(xxhash.xxh64_intdigest(f"<{k}>") for k in ("num", "unit", "name"))], np.uint64)


MONEY = frozenset("%$€£")


def core_of(token: str) -> str:
    """The token without the punctuation around it; empty if no letter, digit or unit is left."""
    if token.isalnum():
        return token
    start, end = 0, len(token)
    while start < end and not (token[start].isalnum() or token[start] in MONEY):
        start += 1
    while start < end and not (token[end - 1].isalnum() or token[end - 1] in MONEY):
        end -= 1
    core = token[start:end]
    return core if core in UNITS or any(map(str.isalnum, core)) else ""


def kind_of(low: str) -> int:
    """NUMBER, UNIT or WORD of a lower-cased core."""
    if low in NUMBERS:
        return NUMBER
    if low in UNITS:
        return UNIT
    if low.isalpha():
        return WORD
    return NUMBER if any(map(str.isdigit, low)) or NUMBERS.issuperset(low.split("-")) else WORD


def capital(core: str) -> bool:
    """Whether only the first letter is a capital."""
    return core[0].isupper() and not core[1:].isupper()


def _ends(token: str) -> bool:
    """Whether a sentence ends with the token."""
    return token.rstrip("\"')]”’»").endswith((".", "!", "?", ":"))


class _Vocabulary(dict):
    """token -> its number, or -1; by number: hash, words, and kinds as two bits each (plain, loose, loose inside a sentence), then the end of a sentence."""

    def __init__(self, known: Callable[[int], bool]):
        self.known, self.hashes, self.words, self.codes = known, array("Q"), [], array("B")

    def __missing__(self, token: str) -> int:
        whole = token.isalpha()
        core, n = token if whole else core_of(token), -1
        if core:
            n, low = len(self.words), core.lower()
            plain, h = kind_of(low), xxhash.xxh64_intdigest(low)
            loose = inner = plain
            if plain == WORD:
                loose = WORD if self.known(h) else NAME
                inner = NAME if loose == NAME or capital(core) else WORD
            self.words.append(low)
            self.hashes.append(h)
            self.codes.append(plain | loose << 2 | inner << 4 | (not whole and _ends(token)) << 6)
        self[token] = n
        return n


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^n modulo 2^64."""
    if len(_POWERS.get(base, ())) <= n:
        steps = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][: n + 1]


def _hashed(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end]: polynomials as differences of one running sum."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(ODD, n)[:n], out=total[1:])
    h = (total[end] - total[start]) * _powers(pow(ODD, -1, 1 << 64), n)[start]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)) ^ (end - start).astype(np.uint64)


class _Reading:
    """The windows of one reading over a block of texts: arrays by window, and the slots of chosen ones."""

    def __init__(self, view: int, vocabulary: _Vocabulary, flat: np.ndarray, doc: np.ndarray, kinds: np.ndarray | None, n: int):
        self.view, self.flat, self.vocabulary = view, flat, vocabulary
        hashes = np.array(vocabulary.hashes, np.uint64)[flat]
        if kinds is None:
            self.heads, self.kinds, self.doc, self.values = np.arange(len(flat)), np.zeros(len(flat), np.int8), doc, hashes
        else:
            run = (kinds[1:] == kinds[:-1]) & (doc[1:] == doc[:-1]) & ((kinds[1:] == NUMBER) | (kinds[1:] == NAME))
            self.heads = np.flatnonzero(np.concatenate(([True], ~run)))
            self.kinds, self.doc = kinds[self.heads], doc[self.heads]
            self.values = np.where(self.kinds == WORD, hashes[self.heads], PLACES[self.kinds])
        self.counts = np.bincount(self.doc, minlength=n)
        last = np.cumsum(self.counts)
        self.first, self.stop = np.concatenate(([0], last[:-1])), last[self.doc]

    def windows(self, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document index, position, hash, start, end) of all windows, a width after the other in the exact reading."""
        n = len(self.heads)
        all_ = np.arange(n)
        ends = [all_ + w for w in widths]
        if self.view != EXACT:
            literal = self.kinds == WORD
            before, places = np.cumsum(literal) - literal, np.append(np.flatnonzero(literal), [n + 1] * LITERALS)
            ends = [np.maximum(all_ + WINDOW, places[before + LITERALS - 1] + 1)]
        for end in ends:
            start = np.flatnonzero(end <= self.stop)
            if len(start):
                d = self.doc[start]
                yield d, start - self.first[d], _hashed(self.values, start, end[start]), start, end[start]

    def _said(self, u: int) -> str:
        end = self.heads[u + 1] if u + 1 < len(self.heads) else len(self.flat)
        return " ".join([self.vocabulary.words[n] for n in self.flat[self.heads[u] : end].tolist()])

    def slots(self, starts: np.ndarray, keys: bool) -> list[list[str]]:
        """Of the first places of each window: what stands in a placeholder, or "" for a word.

        With ``keys`` it is the slot that the place belongs to: a name is n:words, a unit v:word, a number v:words
        with the place after it.
        """
        seen: dict[int, str] = {}

        def one(u: int) -> str:
            if self.kinds[u] == WORD:
                return ""
            said = self._said(u)
            if not keys:
                return said
            if self.kinds[u] == NAME:
                return f"n:{said}"
            follows = self.kinds[u] == NUMBER and u + 1 < self.stop[u]
            return f"v:{said} {self._said(u + 1)}" if follows else f"v:{said}"

        out = []
        for s in starts.tolist():
            for u in range(s, s + WINDOW):
                if u not in seen:
                    seen[u] = one(u)
            out.append([seen[u] for u in range(s, s + WINDOW)])
        return out


def _readings(texts: list[str], vocabulary: _Vocabulary) -> Iterator[_Reading]:
    if len(vocabulary) > VOCABULARY:
        vocabulary.clear()
        vocabulary.__init__(vocabulary.known)
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)[flat >= 0]
    flat = flat[flat >= 0]
    if not len(flat):
        return
    yield _Reading(EXACT, vocabulary, flat, doc, None, len(texts))
    codes = np.array(vocabulary.codes, np.uint8)[flat]
    yield _Reading(PLAIN, vocabulary, flat, doc, codes & 3, len(texts))
    opens = np.ones(len(flat), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (codes[:-1] >> 6 == 1)
    yield _Reading(LOOSE, vocabulary, flat, doc, np.where(opens, codes >> 2, codes >> 4) & 3, len(texts))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= BLOCK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _scan(known: np.ndarray, bits: np.ndarray | None, widths: list[int]):
    """mapInArrow function from (row, id, text) to window rows that pass ``bits``, and a row of view -1 for each text.

    Without ``bits`` the texts are the benchmark itself: every window is given, slots are named by their keys, starts
    is the number of places where a window could start, and a text below the window is one exact window of all its tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(_holds(known))
        for b in batches:
            rows, ids, texts = b.column(0), b.column(1), [t or "" for t in b.column(2).to_pylist()]
            n = len(texts)
            yield pa.RecordBatch.from_arrays([rows, ids, pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.int32())], NAMES)
            for lo, hi in _blocks(texts):
                for reading in _readings(texts[lo:hi], vocabulary):
                    view, counts = reading.view, reading.counts
                    lengths = sorted({min(int(n), WINDOW) for n in counts if n}) if bits is None else widths
                    for doc, place, h, start, end in reading.windows(lengths):
                        hit = np.flatnonzero((counts[doc] == end - start) | (end - start >= WINDOW) if bits is None else _passes(bits, h))
                        if not len(hit):
                            continue
                        slots = pa.nulls(len(hit), pa.list_(pa.string())) if view == EXACT else pa.array(reading.slots(start[hit], bits is None), pa.list_(pa.string()))
                        starts = pa.array((counts[doc[hit]] - WINDOW + 1).astype(np.int32)) if bits is None else pa.nulls(len(hit), pa.int32())
                        take = pa.array(doc[hit] + lo)
                        yield pa.RecordBatch.from_arrays([rows.take(take), ids.take(take), pa.array(np.full(len(hit), view, np.int32)), pa.array(h[hit].view(np.int64)), pa.array(place[hit].astype(np.int32)), slots, starts], NAMES)

    return run


def _lower_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words that a batch of texts writes without a capital of their own."""
    for b in batches:
        cores = {core_of(x) for t in b.column(0).to_pylist() for x in (t or "").split()}
        found = {xxhash.xxh64_intdigest(c.lower()) for c in cores if c and not capital(c)}
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64))], ["hash"])


def benchmark_words(benchmark: DataFrame, text_col: str) -> np.ndarray:
    """Filter over the words that the benchmark writes in lower case (or in capitals throughout)."""
    words = benchmark.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_lower_words, "hash bigint")
    return _filter_words(cut(words.distinct()))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, known: np.ndarray) -> DataFrame:
    """(item, item_id, view, hash, item_pos, item_slots, starts) of every window of every item; item is a number of its row."""
    items = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    found = items.mapInArrow(_scan(known, None, []), HITS.format(kind=dict(items.dtypes)["doc_id"])).where("view >= 0")
    return found.select(F.col("row").alias("item"), F.col("doc_id").alias("item_id"), "view", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "starts")


def _holds(bits: np.ndarray) -> Callable[[int], bool]:
    """``_passes`` for one hash at a time."""
    size = int(np.log2(len(bits))) + 6
    words, mask, shift = memoryview(bits), (1 << size) - 1, 64 - size

    def one(h: int) -> bool:
        low, high = h & mask, h >> shift
        return bool((words[low >> 6] >> (low & 63)) & (words[high >> 6] >> (high & 63)) & 1)

    return one


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set: the one of its low digits and the one of its high digits."""
    size = int(np.log2(len(bits))) + 6
    own = np.ones(len(h), bool)
    for at in (h & np.uint64((1 << size) - 1), h >> np.uint64(64 - size)):
        own &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return own


def _filter_words(hashes: DataFrame) -> np.ndarray:
    """A filter's 64-bit words; at most 2^20 of them come to the driver, whatever the benchmark's size."""
    size = min(MOST_BITS, max(LEAST_BITS, (128 * hashes.count()).bit_length()))
    low, high = F.col("hash").bitwiseAND(F.lit((1 << size) - 1)), F.call_function("shiftrightunsigned", F.col("hash"), F.lit(64 - size))
    at = hashes.select(F.explode(F.array(low, high)).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = 0.8,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, items (sorted item ids), coverage (of the best item, or null).

    A document holds an item when in one of the readings at least ``least`` of the item's windows occur in it:
    of its distinct windows in the exact reading; of the places where its windows could start in the others, where
    windows count only if their slots are consistent along an alignment.  Items below five tokens are one exact
    window; items below five places in a reading with placeholders are judged by the other readings.
    Coverage is a share before the slots are looked at where it stays below ``least``.
    Null, empty or wordless texts and items hold nothing.  Texts of any length are read whole.  Repeated rows
    are judged alike, items with one id or text each by themselves; ties need no order, as all items count (of two
    equally usual values of a number's slot the greater text is the usual one).
    Empty tables give no rows, or none contaminated; columns with other names don't matter.
    """
    known = benchmark_words(benchmark, item_text_col)
    windows = cut(benchmark_windows(benchmark, item_col, item_text_col, known))
    widths = sorted({WINDOW, *range(1, WINDOW)}) if _has_short(benchmark, item_text_col) else [WINDOW]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    hits = cut(rows.mapInArrow(_scan(known, _filter_words(windows), widths), HITS.format(kind=dict(rows.dtypes)["doc_id"])))
    exact, slotted = F.col("view") == EXACT, F.col("view") != EXACT
    weight = F.when(exact, 1).otherwise(F.count("*")).cast("long")
    each = windows.groupBy("item", "view", "hash").agg(weight.alias("places"), F.max("starts").cast("long").alias("starts"))
    totals = each.groupBy("item", "view").agg(F.when(exact, F.sum("places")).otherwise(F.max("starts")).alias("total"))
    # hashes first: only where they reach the share are places and slots looked at
    met = hits.where("view >= 0").select("row", "view", "hash").distinct().join(each.drop("starts"), ["view", "hash"])
    shares = met.groupBy("row", "item", "view").agg(F.sum("places").alias("places")).join(totals, ["item", "view"])
    shares = cut(shares.select("row", "item", "view", "total", (F.col("places") / F.col("total")).alias("share")))
    asked = shares.where(slotted & (F.col("share") >= least)).select("row", "item", "view", "total")
    # in one plan, what follows would have the driver plan some thirty exchanges anew after each of them: it goes by steps
    pairs = hits.where("view > 0").drop("starts").join(asked, ["row", "view"]).join(windows.drop("item_id", "starts"), ["item", "view", "hash"])
    pairs = cut(pairs.withColumn("shift", F.col("pos") - F.col("item_pos")))
    alignment = ["row", "item", "view", "shift"]
    slots = pairs.select(*alignment, "item_pos", F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).where("s.item_slots <> ''")
    slots = slots.select(*alignment, "item_pos", F.col("s.item_slots").alias("slot"), F.col("s.slots").alias("value"))
    counted = slots.groupBy(*alignment, "slot", "value").agg(F.count("*").alias("times"))
    usual = counted.groupBy(*alignment, "slot").agg(F.max_by("value", F.struct("times", "value")).alias("usual"), F.count("*").alias("values")).where("values > 1").drop("values")
    name, alike = F.col("slot").startswith("n:"), F.arrays_overlap(F.split("value", " "), F.split("usual", " "))
    other = slots.join(usual, [*alignment, "slot"]).where((F.col("value") != F.col("usual")) & ~(name & alike))
    other = cut(other.select(*alignment, "item_pos", name.alias("name")))
    broken = other.where("name").select(*alignment).distinct()
    odd = other.where("not name").select(*alignment, "item_pos").distinct()
    sound = pairs.join(broken, alignment, "left_anti").join(odd, [*alignment, "item_pos"], "left_anti")
    sound = sound.groupBy("row", "item", "view", "total").agg(F.count_distinct("item_pos").alias("n"))
    sound = cut(sound.select("row", "item", (F.col("n") / F.col("total")).alias("share")))
    plain = shares.where(exact | (F.col("share") < least)).select("row", "item", "share")
    best = plain.unionByName(sound).groupBy("row", "item").agg(F.max("share").alias("share"))
    named = best.join(windows.select("item", "item_id").distinct(), "item")
    judged = named.groupBy("row").agg(F.max("share").alias("coverage"), F.array_sort(F.collect_set(F.when(F.col("share") >= least, F.col("item_id")))).alias("items"), F.bool_or(F.col("share") >= least).alias("contaminated"))
    none = F.array().cast(f"array<{dict(benchmark.dtypes)[item_col]}>")
    every = hits.where("view = -1").select("row", "doc_id").join(judged, "row", "left")
    return every.select("doc_id", F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.coalesce("items", none).alias("items"), "coverage")


def _has_short(benchmark: DataFrame, text_col: str) -> bool:
    """Whether any item may have fewer tokens than the window; then documents are read at the shorter widths too."""
    pieces = F.size(F.split(F.trim(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"\s+"))
    alnum = F.size(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\p{L}\p{N}]+")) - 1
    return not benchmark.where((F.least(pieces, alnum) < WINDOW) & (alnum > 0)).isEmpty()
