"""Conversation structure repair: the cheapest edits that make a conversation's roles read ``(s?(ua)+)?``.

The cheapest edits are a shortest path over the rows and four states (nothing yet, after system, user, assistant).
Backward costs from a row on are a vector of four numbers, and only its direction matters: vectors that differ by a
constant lead to the same choices.  So the rows are cut into chunks that are worked on at once (rank-convergence
parallel Viterbi): each chunk starts at its end from a speculative vector, fix-up passes hand a chunk the vector
that its successor really begins with and rerun it backwards until its vectors differ from the earlier ones by a
constant only, and passes repeat until no chunk's end changes its direction.  What the constants took off is summed
over the chunks for the cost.  Stitched backward costs then drive the trace: at every row the least letter that
keeps to the cheapest cost is taken; a chunk first tells where each of the four entries would leave it, a walk over
these chunk maps gives the true entries, and all chunks are traced at once.

Equal rows of a turn are one entry with a count, so hot rows don't meet in one task.  Chunks carry no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, cut

#: Entries of a chunk.
CHUNK = 4096
#: Costs of the edits; a kept row with a truncated text adds 1.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant row leads to: a user row from all states but the user's.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row leads, by state and initial (s, u, a, other); None where it can't stay.
KEEP = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
FINE, CUT_OFF, FORCED = range(3)
BIG = 1 << 40


def _with_inserts(costs: tuple) -> tuple:
    """Costs at a place when rows may be put in there first."""
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant


#: Backward costs behind the last row: only nothing at all and an assistant's row may end a conversation.
END = _with_inserts((0, BIG, BIG, 0))


def _edges(state: int, code: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state it leads to) of what may be done with a row, in order of the letters; code is initial * 3 + fault."""
    initial, fault = divmod(code, 3)
    out = [("D", DELETE, state)]
    if fault != FORCED:
        extra = TRUNCATED * (fault == CUT_OFF)
        if KEEP[state][initial] is not None:
            out.append(("K", extra, KEEP[state][initial]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


@lru_cache(maxsize=1 << 16)
def back(code: int, after: tuple) -> tuple[tuple, int]:
    """Backward costs before a row from those after it, less their least number, and that number."""
    costs = _with_inserts(tuple(min(cost + after[to] for _, cost, to in _edges(state, code)) for state in range(4)))
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(maxsize=1 << 16)
def step(code: int, state: int, after: tuple) -> tuple[str, int]:
    """The least letters that take a state through a row at the cheapest cost, and the state behind it."""
    here, lift = back(code, after)
    letters = ""
    while True:
        best = here[state] + lift
        options = [(letter, to, cost + after[to]) for letter, cost, to in _edges(state, code)] + [("I", NEXT[state], INSERT + here[NEXT[state]] + lift)]
        letter, state = min((letter, to) for letter, to, cost in options if cost == best)
        letters += letter
        if letter != "I":
            return letters, state


def closing(state: int) -> str:
    """Rows put in behind the last one."""
    letters = ""
    while state not in (START, ASSISTANT):
        letters, state = letters + "I", NEXT[state]
    return letters


def _initial(role: str) -> int:
    return "sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3


def damage(rows: DataFrame) -> DataFrame:
    """Damage rows (conv_id, turn, role, text; nulls of role and text: one space) by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes every ``.``, ``!`` and ``?``, 3 repeats it, 4 sets its role to user.
    """
    given = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    given = given.withColumn("_lot", F.crc32(key.cast("binary")) % 20).where(F.col("_lot") != 0)
    lot = F.col("_lot")
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(lot == 3, 2).otherwise(1)))
    return given.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the columns that order a conversation: turns (nulls first), then role, then the text's 128-bit digest."""
    given = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return given.select("conv", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "role", F.unhex(F.md5("text")).alias("digest"), "text")


ORDER = ["conv", "known", "turn", "role", "digest"]


def _entries(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one entry: how many there are, and whether the first of them is blank, seen earlier or cut off."""
    keyed = _keyed(rows)
    blank = ~F.col("text").rlike(WORD)
    whole = F.col("text").rlike(rf"[.!?]{SPACE_CLASS}*\z")
    each = keyed.select(*ORDER, F.when(blank, 2).when(whole, 0).otherwise(1).alias("shape")).groupBy(*ORDER).agg(F.count("*").alias("n"), F.first("shape").alias("shape"))
    first = each.groupBy("conv", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("at")).select(F.col("conv").alias("conv2"), F.col("role").alias("role2"), F.col("digest").alias("digest2"), "at.known", "at.turn", F.lit(True).alias("is_first"))
    # rows of one text meet their first by their own turn, so a text that a conversation repeats is no hot key
    same = each["conv"].eqNullSafe(first["conv2"]) & (each["known"] == first["known"]) & (each["turn"] == first["turn"]) & (each["role"] == first["role2"]) & (each["digest"] == first["digest2"])
    return each.join(first, same, "left").select(*[each[c] for c in (*ORDER, "n", "shape")], F.coalesce("is_first", F.lit(False)).alias("is_first"))



def pack(vector: tuple) -> int:
    """A vector's four small numbers as one."""
    return sum(v << (15 * i) for i, v in enumerate(vector))


@lru_cache(maxsize=1 << 16)
def unpack(value: int) -> tuple:
    return tuple((value >> (15 * i)) & 0x7FFF for i in range(4))


def run_back(codes: list[int], after: tuple) -> tuple[list[int], int]:
    """Packed vectors before each entry of a chunk, and what normalising took off in all."""
    vectors, lift = [0] * len(codes), 0
    for i in range(len(codes) - 1, -1, -1):
        after, least = back(codes[i], after)
        vectors[i], lift = pack(after), lift + least
    return vectors, lift


def rerun(codes: list[int], vectors: list[int], before: int, now: int) -> int:
    """Redo a chunk from another vector behind it, in place, until old and new vectors differ by a constant; the change of its lift."""
    change, old, new = 0, unpack(before), unpack(now)
    for i in range(len(codes) - 1, -1, -1):
        (old, taken), (new, takes) = back(codes[i], old), back(codes[i], new)
        change += takes - taken
        if old == new:
            break
        vectors[i] = pack(new)
    return change


#: Of a chunk: its place, its entries with their codes and vectors, the vector behind it, and figures of its rows.
CHUNK_FIELDS = {
    "pid": "int", "block": "int", "knowns": "array<boolean>", "turns": "array<bigint>", "roles": "array<string>", "digests": "array<binary>", "more": "array<bigint>",
    "codes": "array<int>", "vectors": "array<bigint>", "starts": "bigint", "ends": "bigint", "lift": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
    "illegal": "bigint", "n_turns": "bigint", "first_turn": "bigint", "last_turn": "bigint", "first_role": "int", "last_role": "int",
}
FIGURES = ("lift", "blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn", "first_role", "last_role")
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _chunk(pid: int, block: int, conv, entries: list[tuple]) -> tuple:
    """A chunk of one conversation from its entries (known, turn, role, digest, n, shape, is_first), run from the vector of an end."""
    codes, more, blank, duplicate, truncated, illegal = [], [], 0, 0, 0, 0
    for known, turn, role, digest, n, shape, first in entries:
        stands = first and shape != 2
        codes.append(_initial(role) * 3 + ((CUT_OFF if shape == 1 else FINE) if stands else FORCED))
        more.append(n - 1)
        blank += n * (shape == 2)
        duplicate += (n - stands) * (shape != 2)
        truncated += stands and shape == 1
        illegal += n - 1
    illegal += sum((a // 3, b // 3) not in LEGAL for a, b in zip(codes, codes[1:]))
    vectors, lift = run_back(codes, END)
    turns = [t for known, t, *_ in entries if known]
    knowns, places, roles, digests = (list(c) for c in list(zip(*entries, strict=True))[:4])
    return (
        conv, pid, block, knowns, places, roles, digests, more, codes, vectors, vectors[0], pack(END), lift + DELETE * sum(more), blank, duplicate, truncated,
        illegal, len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None, codes[0] // 3, codes[-1] // 3,
    )


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _build(batches: Iterable[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Entries in order to chunks of up to ``size`` entries of one conversation."""

    def chunks() -> Iterator[tuple]:
        pid, block, conv, held = TaskContext.get().partitionId(), 0, None, []
        for now, *entry in _tuples(batches):
            if held and (now != conv or len(held) >= size):
                yield _chunk(pid, block, conv, held)
                block, held = block + 1, []
            conv = now
            held.append(tuple(entry))
        if held:
            yield _chunk(pid, block, conv, held)

    return _batches(chunks(), schema, max(1, 65536 // size))


def _fix(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks with ``need``, the packed vector that their successor begins with, or null: rerun those that end with another."""
    names = schema.names
    at = {c: names.index(c) for c in ("codes", "vectors", "starts", "ends", "lift")}

    def fixed() -> Iterator[tuple]:
        for *row, need in _tuples(batches):
            if need is not None:
                vectors = list(row[at["vectors"]])
                row[at["lift"]] += rerun(row[at["codes"]], vectors, row[at["ends"]], need)
                row[at["vectors"]], row[at["starts"]], row[at["ends"]] = vectors, vectors[0], need
            yield tuple(row)

    return _batches(fixed(), schema, 16)


def _walk(codes: list[int], vectors: list[int], end: int, state: int) -> Iterator[tuple[str, int]]:
    """Letters of each entry of a chunk and the state before it, from an entry state on; last, no letters and the exit."""
    for code, after in zip(codes, [*vectors[1:], end], strict=True):
        letters, now = step(code, state, unpack(after))
        yield letters, state
        state = now
    yield "", state


def _exit(codes: list[int], vectors: list[int], end: int, state: int) -> int:
    for _, state in _walk(codes, vectors, end, state):  # noqa: B020, PLW2901
        pass
    return state


def _map(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Where a chunk leaves each of the four states, and its figures."""

    def rows() -> Iterator[tuple]:
        for conv, pid, block, codes, vectors, end, *figures in _tuples(batches):
            yield conv, pid, block, [_exit(codes, vectors, end, state) for state in range(4)], unpack(vectors[0])[START], *figures

    return _batches(rows(), schema, 1024)


BILL = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stitch(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunk maps in order to each chunk's entry state, and a bill for each conversation (block null) with its last state.

    One row is held at a time, however many chunks a conversation has.
    """

    def rows() -> Iterator[tuple]:
        total, state, conv, seen = None, START, None, False

        def bill() -> tuple:
            low, high, turns = total["low"], total["high"], total["n_turns"]
            gaps = 0 if low is None else high - low + 1 - turns
            return conv, None, None, state, gaps, *[total[c] for c in ("blank", "duplicate", "truncated", "illegal")], total["first_cost"] + total["lift"]

        for now, pid, block, exits, first_cost, *figures in _tuples(batches):
            f = dict(zip(FIGURES, figures, strict=True))
            if not seen or now != conv:
                if seen:
                    yield bill()
                total, state, conv, seen = f | {"low": f["first_turn"], "high": f["last_turn"], "first_cost": first_cost}, START, now, True
            else:
                for c in ("lift", "blank", "duplicate", "truncated", "illegal", "n_turns"):
                    total[c] += f[c]
                total["illegal"] += (total["last_role"], f["first_role"]) not in LEGAL
                total["n_turns"] -= total["high"] is not None and total["high"] == f["first_turn"]
                if f["first_turn"] is not None:
                    total["low"], total["high"] = f["first_turn"] if total["low"] is None else total["low"], f["last_turn"]
                total["last_role"] = f["last_role"]
            yield conv, pid, block, state, *[None] * 6
            state = exits[state]
        if seen:
            yield bill()

    return _batches(rows(), schema, 4096)


def _trace(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks with their entry states to an edit for each entry."""

    def rows() -> Iterator[tuple]:
        for conv, knowns, turns, roles, digests, more, codes, vectors, end, entry in _tuples(batches):
            for key, (letters, state) in zip(zip(knowns, turns, roles, digests, more), _walk(codes, vectors, end, entry)):  # noqa: B905  the exit stays over
                yield conv, *key, letters, state

    return _batches(rows(), schema, 8192)


def _shape(df: DataFrame, fields: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.schema["conv"].dataType.simpleString()
    shape = df.sparkSession.createDataFrame([], f"conv {kind}, {fields}").schema
    return shape, to_arrow_schema(shape)


def _map_in_arrow(df: DataFrame, work, fields: str, **more) -> DataFrame:
    shape, schema = _shape(df, fields)
    return df.mapInArrow(partial(work, schema=schema, **more), shape)


def repair_plan(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of conversation rows (conv_id, turn, role, text), as (edits, bills).

    edits: one row for each set of equal rows of a turn (conv, known, turn, role, digest), ``letters`` (I for rows put
    in before it, then K, R or D for its first row), ``state`` before them and ``more``, further equal rows, all deleted.
    bills: one row for each conversation with rows: gaps, blank, duplicate, truncated, illegal, cost, and ``state``
    behind its last row (``closing`` gives the rows put in there).

    Conversations go by turn (nulls first), then role, then the text's digest; a null conv_id is a conversation; nulls
    of role and text count as one space; other columns don't matter.  An empty table gives none of both.
    """
    keyed = _entries(rows).repartitionByRange(*[F.col(c) for c in ORDER]).sortWithinPartitions(*ORDER)
    chunks = _map_in_arrow(keyed, _build, ", ".join(f"{c} {k}" for c, k in CHUNK_FIELDS.items()), size=chunk)
    chunks = cut(chunks)  # ranges are drawn anew whenever they are computed
    follow = Window.partitionBy("conv").orderBy("pid", "block")
    while True:
        ends = chunks.select("conv", "pid", "block", "ends", F.coalesce(F.lead("starts").over(follow), F.lit(pack(END))).alias("need"))
        wrong = ends.where(F.col("ends") != F.col("need")).select("pid", "block", "need")
        if wrong.isEmpty():
            break
        fields = ", ".join(f"{c} {k}" for c, k in CHUNK_FIELDS.items())
        chunks = cut(_map_in_arrow(chunks.join(wrong, ["pid", "block"], "left").select(*chunks.columns, "need"), _fix, fields))
    kinds = ", ".join(f"{c} {CHUNK_FIELDS[c]}" for c in FIGURES)
    maps = _map_in_arrow(chunks.select("conv", "pid", "block", "codes", "vectors", "ends", *FIGURES), _map, f"pid int, block int, exits array<int>, first_cost bigint, {kinds}")
    maps = maps.repartition("conv").sortWithinPartitions("conv", "pid", "block")
    stitched = _map_in_arrow(maps, _stitch, "pid int, block int, state int, " + ", ".join(f"{c} bigint" for c in BILL))
    stitched = cut(stitched)
    entered = stitched.where(F.col("block").isNotNull() & (F.col("state") != START)).select("pid", "block", F.col("state").alias("entry"))
    each = chunks.join(entered, ["pid", "block"], "left").select("conv", "knowns", "turns", "roles", "digests", "more", "codes", "vectors", "ends", F.coalesce("entry", F.lit(START)).alias("entry"))
    edits = _map_in_arrow(each, _trace, "known boolean, turn bigint, role string, digest binary, more bigint, letters string, state int")
    return edits, stitched.where(F.col("block").isNull()).select("conv", "state", *BILL)


#: Of the rows that a repair is told by, ordered: a conversation, its bill, then each entry's edit and texts.
TOLD = "part int, known boolean, turn bigint, role string, digest binary, kind int, letters string, state int, more bigint, text string, " + ", ".join(f"{c} bigint" for c in BILL)
HERE, BILLED, ENTRY = range(3)


def _told(rows: DataFrame, ids: DataFrame, chunk: int) -> DataFrame:
    """Conversations, bills, edits and texts in one shuffle by conversation, in order."""
    edits, bills = repair_plan(rows, chunk)
    names = [f.split()[0] for f in TOLD.split(", ")]
    kinds = dict(f.split() for f in TOLD.split(", "))

    def part(df: DataFrame, **given: Column) -> DataFrame:
        columns = [given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names]
        return df.select("conv", *columns)

    heads = part(ids.select(F.col("conv_id").alias("conv")).distinct(), part=F.lit(HERE))
    billed = part(bills, part=F.lit(BILLED))
    edited = part(edits, part=F.lit(ENTRY), kind=F.lit(0))
    texts = part(_keyed(rows), part=F.lit(ENTRY), kind=F.lit(1))
    return heads.unionByName(billed).unionByName(edited).unionByName(texts).repartition("conv").sortWithinPartitions("conv", "part", "known", "turn", "role", "digest", "kind")


def _inserted(state: int, letters: str) -> Iterator[tuple[str, str, str]]:
    for letter in letters:
        state = NEXT[state]
        yield letter, NAMES[state], ""


def _applied(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, letter, role, text) of each edit in order; letter null for a conversation's bill, which comes last as text."""
    conv, seen, bill, end, held = None, False, (0,) * 6, START, None

    def rest() -> Iterator[tuple]:
        for made in _inserted(end, closing(end)):
            yield conv, *made
        yield conv, None, None, bill

    for now, part, _known, _turn, role, _digest, kind, letters, state, more, text, *figures in _tuples(batches):
        if not seen or now != conv:
            if seen:
                yield from rest()
            conv, seen, bill, end, held = now, True, (0,) * 6, START, None
        if part == BILLED:
            bill, end = tuple(figures), state
        elif kind == 0:
            held = letters, state, more
        elif kind == 1 and held:  # the first of equal rows; the others are deleted
            letters, state, more = held
            held, own = None, letters.lstrip("I")
            put_in = letters[: len(letters) - len(own)]
            for made in _inserted(state, put_in):
                yield conv, *made
            for _ in put_in:
                state = NEXT[state]
            yield conv, own, NAMES[NEXT[state]] if own == "R" else role, text
            for _ in range(more):
                yield conv, "D", role, text
    if seen:
        yield from rest()


def _digest(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Conversations to bill, audit and hash; texts pass one at a time."""

    def rows() -> Iterator[tuple]:
        sha, letters, between = hashlib.sha256(), [], ""
        for conv, letter, role, text in _applied(batches):
            if letter is None:
                yield conv, *text, "".join(letters), sha.hexdigest()
                sha, letters, between = hashlib.sha256(), [], ""
                continue
            if letter != "D":
                sha.update(f"{between}{role}:{text}".encode())
                between = "\n"
            letters.append(letter)

    return _batches(rows(), schema, 1024)


def _rows(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        place = 0
        for conv, letter, role, text in _applied(batches):
            place = 0 if letter is None else place + 1
            if letter is not None:
                yield conv, place, letter, role, text

    return _batches(rows(), schema, 1024)


def repaired_rows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every edit in order: conv_id, place (from 1), edit (D, I, K or R), role and text; without the deleted ones, the repaired conversations."""
    told = _told(rows, rows.select("conv_id"), chunk)
    return _map_in_arrow(told, _rows, "place bigint, edit string, role string, text string").withColumnRenamed("conv", "conv_id")


def repair_digests(rows: DataFrame, ids: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each conv_id of ``ids``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Conversations without rows have zeros, an empty audit and the hash of nothing.  The hash of a conversation is one
    pass over its repaired rows in order, which no number of machines can share; that pass holds a row at a time.
    """
    told = _told(rows, ids, chunk)
    return _map_in_arrow(told, _digest, ", ".join(f"{c} bigint" for c in BILL) + ", audit string, repaired_sha256 string").withColumnRenamed("conv", "conv_id")
