"""Keyed streams whose rows come late and out of order: rows wait in state until the watermark passes them.

``Settled`` keeps unsettled rows in a list state and one event-time timer.  Keys share a state by ``BUCKETS`` of
their hash, as every access to state is a call between Python and the JVM that costs far more than a key's rows.  Once the watermark has passed
rows, no earlier ones can come, so they are handed on in order of (time, id); what a key must do although nothing
comes (a heartbeat, an alert of silence, forgetting a dead key) is a deadline that stands in the same order.  Results
so depend on the rows and the last watermark alone, not on how rows were cut into batches.

Time is microseconds.  A row at the very moment of a deadline comes first.  A row repeated with its time and id is
one row.  Rows later than the watermark are dropped by Spark before they come here.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .live import policy_step

# state processors travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Buckets of keys: a batch costs some calls for each of them that has rows or a due moment.
BUCKETS = 1024


class Settled(StatefulProcessor):
    """Base of processors over settled rows.  ``payload`` are (name, SQL type) of what a row carries besides time and id."""

    #: Columns of the result after the key.
    columns: list[str] = []
    #: SQL columns of the key's own state.
    kept: str = ""

    #: SQL type of the key.
    key: str = "string"

    def __init__(self, payload: list[tuple[str, str]]):
        self.payload = payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"key {self.key}, at_us bigint, row_id bigint, " + ", ".join(f"{n} {k}" for n, k in self.payload))
        self.states = handle.getListState("states", f"key {self.key}, {self.kept}")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    # what a subclass says

    def on_row(self, state: tuple | None, at: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """Next state and rows to write for a settled row."""
        raise NotImplementedError

    def deadline(self, state: tuple | None) -> int | None:
        """When the key must act although no row comes."""
        return None

    def on_deadline(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    # the machinery

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["key", "at_us", "row_id", *(n for n, _ in self.payload)]
        kinds = [self.key, "bigint", "bigint", *(k for _, k in self.payload)]
        columns = []
        batch = pd.concat(list(rows))
        for name, kind in zip(names, kinds):
            column = batch[name]
            # a column with a null comes as floats, which a bigint state would take for null
            columns.append([None if gone else int(v) if kind == "bigint" else v for v, gone in zip(column.tolist(), column.isna().tolist())])
        yield from self._settle(list(zip(*columns)), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._settle([], timerValues)

    def _settle(self, fresh: list[tuple], timers) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs() * 1000
        states = {r[0]: tuple(r[1:]) for r in self.states.get()}
        before, rows = dict(states), {}
        for r in [*map(tuple, self.waiting.get()), *fresh]:
            rows.setdefault(r[0], {})[r[1:3]] = r
        out, rest = [], []
        for key in rows.keys() | states.keys():
            own = sorted(rows[key].values(), key=lambda r: r[1:3]) if key in rows else []
            state, made = self._settle_key(states.get(key), [r for r in own if r[1] <= mark], mark)
            rest += (r for r in own if r[1] > mark)
            out += ((key, *o) for o in made)
            if state is None:
                states.pop(key, None)
            else:
                states[key] = state
        if states != before:
            self.states.put([(k, *s) for k, s in states.items()]) if states else self.states.clear()
        if rows:
            self.waiting.put(rest) if rest else self.waiting.clear()
        self._arm(min((r[1] for r in rest), default=None), *map(self.deadline, states.values()))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _settle_key(self, state: tuple | None, due: list[tuple], mark: int) -> tuple[tuple | None, list[tuple]]:
        out = []

        def act(until: int, rows_first: bool) -> None:
            nonlocal state
            while (at := self.deadline(state)) is not None and (at < until if rows_first else at <= until):
                state, made = self.on_deadline(state, at)
                out.extend(made)

        for _, at, _, *row in due:
            act(at, True)
            state, made = self.on_row(state, at, tuple(row))
            out.extend(made)
        act(mark, False)
        return state, out

    def _arm(self, *moments: int | None) -> None:
        """One timer a bucket, at the first of these moments."""
        wanted = min((-(-m // 1000) for m in moments if m is not None), default=None)
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == wanted:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if wanted is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def close(self) -> None:
        pass


class LateEpisodes(Settled):
    """Closed runs of fault words of a channel; state is the open run."""

    columns = ["channel_id", "started_us", "ended_us", "rows_cnt", "fault_value", "closed_by"]
    kept = "started_us bigint, rows_cnt bigint, fault_value string"
    key = "bigint"

    def __init__(self, fault_words: tuple[str, ...]):
        super().__init__([("value", "string")])
        self.fault_words = fault_words

    def on_row(self, state, at, row):
        (value,) = row
        if value in self.fault_words:
            return ((state[0], state[1] + 1, state[2]) if state else (at, 1, value)), []
        return None, [(state[0], at, *state[1:], value)] if state else []


class Heartbeats(Settled):
    """Write policy with heartbeats of their own: state is the class, its start, the last logged value and the last row.

    A key without a row for ``forget_min`` is forgotten, so dead keys write no more and hold no state.
    """

    columns = ["key", "t_us", "probability", "risk_class", "reason"]
    kept = "risk string, since bigint, logged double, logged_at bigint, last double, last_at bigint"

    def __init__(self, policy: dict, forget_min: float):
        super().__init__([("probability", "double")])
        self.policy, self.forget, self.beat = policy, int(forget_min * 6e7), int(policy["heartbeat_min"] * 6e7)

    def on_row(self, state, at, row):
        (p,) = row
        if p is None:
            return state, []
        now, cls, why = policy_step(state[:4] if state else None, at, p, self.policy)
        return (*now, p, at), [(at, p, cls, why)]

    def deadline(self, state):
        return min(state[3] + self.beat, state[5] + self.forget) if state else None

    def on_deadline(self, state, at):
        risk, since, _, _, last, last_at = state
        if at == last_at + self.forget:
            return None, []
        return (risk, since, last, at, last, last_at), [(at, last, risk, "heartbeat")]


class Silences(Settled):
    """Alerts of silent sources: ``silent`` once a source is quiet for longer than its norm, ``back`` at its next row.

    State is the last row's time, the norm and whether the alert is out.  A source quiet for ``forget_us`` is ``gone``:
    its state goes, and its next row begins anew.
    """

    columns = ["source", "event", "at_us", "last_us"]
    kept = "last_us bigint, norm_us bigint, silent boolean"

    def __init__(self, forget_us: int):
        super().__init__([("norm_us", "bigint")])
        self.forget = forget_us

    def on_row(self, state, at, row):
        out = [("back", at, state[0])] if state and state[2] else []
        return (at, row[0], False), out

    def deadline(self, state):
        if not state:
            return None
        last, norm, silent = state
        # lag over the norm, not at it: the moment after
        return last + self.forget if silent or norm is None or norm >= self.forget else last + norm + 1

    def on_deadline(self, state, at):
        last, norm, silent = state
        if at == last + self.forget:
            return None, [("gone", at, last)]
        return (last, norm, True), [("silent", at, last)]


def _settle(stream: DataFrame, key: Column, time: str, row_id: Column, payload: dict[str, Column], late: str, processor: Settled, shape: str) -> DataFrame:
    # the time column stays beside the microseconds: it carries the watermark
    marked = stream.withWatermark(time, late)
    rows = marked.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), key.alias("key"), F.col(time), F.unix_micros(F.col(time)).alias("at_us"), row_id.cast("long").alias("row_id"), *[c.alias(n) for n, c in payload.items()])
    return rows.groupBy("bucket").transformWithStateInPandas(processor, shape, "Append", "EventTime")


EPISODE = "channel_id bigint, started_us bigint, ended_us bigint, rows_cnt bigint, fault_value string, closed_by string"


def late_episodes(stream: DataFrame, fault_words: tuple[str, ...], late: str = "2 days") -> DataFrame:
    """Closed episodes of a reading stream whose rows come in any order, up to ``late``: those of the ordered batch operator that close by the watermark."""
    return _settle(stream, F.col("channel_id").cast("long"), "read_time", F.col("journal_id"), {"value": F.col("value_text")}, late, LateEpisodes(tuple(fault_words)), EPISODE)


def live_heartbeats(stream: DataFrame, policy: dict, late: str = "2 days", forget_min: float = 30 * 1440.0, time: str = "read_time", row_id: str = "journal_id") -> DataFrame:
    """Decisions of a stream of (key, time, id, probability), logged or not, and heartbeats of keys whose rows stay away."""
    shape = "key string, t_us bigint, probability double, risk_class string, reason string"
    return _settle(stream, F.col("key").cast("string"), time, F.col(row_id), {"probability": F.col("probability").cast("double")}, late, Heartbeats(policy, forget_min), shape)


def silence_alerts(stream: DataFrame, source: str, norms: DataFrame, late: str = "2 days", forget: str = "365 days", time: str = "read_time", row_id: str = "journal_id") -> DataFrame:
    """Events of sources that fall silent, come back or are gone: (source, event, at_us, last_us).

    ``norms`` is a static table (source, norm_seconds); sources without a norm are only ever gone.
    """
    known = stream.join(norms.select(F.col("source").alias(source), "norm_seconds"), source, "left")
    micros = int(pd.Timedelta(forget).total_seconds() * 1_000_000)
    payload = {"norm_us": F.col("norm_seconds").cast("long") * 1_000_000}
    shape = "source string, event string, at_us bigint, last_us bigint"
    return _settle(known, F.col(source).cast("string"), time, F.col(row_id), payload, late, Silences(micros), shape)
