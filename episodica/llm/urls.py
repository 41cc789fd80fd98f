"""URL filters through a bit-parallel wildcard automaton.

Every glob rule is a run of bits: one for its start and one for each character it consumes.  All rules of
a table are packed into one mask of several 64-bit words, and one Shift-And step per character moves all
of them at once, for a whole batch of URLs.  Wildcards are bits that may stay where they are on a
character.  The masks depend on the rules alone, so what is shipped to a task does not grow with pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands between host and path in a canonical URL; this byte is in no UTF-8 text.
CUT = 0xFF
END = 256
#: A character in UTF-8 is a leading byte and the bytes that go on with it.
LEAD = set(range(256)) - set(range(0x80, 0xC0)) - {CUT}
GO_ON = set(range(0x80, 0xC0))
CELLS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """A glob over hosts and one over paths. ``*`` is any run of characters in the host or the path, ``?`` is one."""

    action: str
    host: str
    path: str
    name: str | None = None
    rank: int = 0


def domain_rule(action: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains where the path starts with ``path``; the longest such rule wins."""
    return Rule(action, f"*.{host}", f"{path}*", f"{host}{path}", 1000 + len(host + path))


def host_words(action: str, *words: str) -> list[Rule]:
    return [Rule(action, f"*{w}*", "*") for w in words]


class Automaton:
    """Packed masks of a rule table and their simulation over a batch of byte strings."""

    def __init__(self, rules: list[Rule]):
        take, stay, starts, finals = [], [], [], []
        for r in rules:
            starts.append(len(take))
            take.append(set())
            stay.append(set())
            # the canonical URL is "." + host + CUT + path
            for half, glob in enumerate((r.host, r.path)):
                anything = set(range(256)) - {CUT}
                for ch in glob:
                    if ch == "*":
                        stay[-1] |= anything
                        continue
                    for b in [LEAD] if ch == "?" else [{b} for b in ch.encode()]:
                        take.append(b)
                        stay.append(set())
                    if ch == "?":  # the bytes that go on with the character are taken in place
                        stay[-1] |= GO_ON
                if half == 0:
                    take.append({CUT})
                    stay.append(set())
            finals.append(len(take) - 1)
        self.words = max(1, -(-len(take) // 64))
        self.take, self.stay = (self._masks(x) for x in (take, stay))
        self.stay[END] = ~np.uint64(0)
        self.start = np.zeros(self.words, np.uint64)
        for p in starts:
            self.start[p // 64] |= np.uint64(1 << (p % 64))
        self.finals = np.array(finals, np.int64)

    def _masks(self, sets: list[set[int]]) -> np.ndarray:
        out = np.zeros((257, self.words), np.uint64)
        for p, chars in enumerate(sets):
            out[sorted(chars), p // 64] |= np.uint64(1 << (p % 64))
        return out

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """Boolean (url, rule). URLs run in order of length, in blocks of bounded size."""
        out = np.zeros((len(urls), len(self.finals)), bool)
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(urls[order[to]]) <= CELLS:
                to += 1
            block = order[at:to]
            out[block] = self._run([urls[i] for i in block])
            at = to
        return out

    def _run(self, urls: list[bytes]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls])
        chars = np.full((len(urls), int(lengths.max(initial=0))), END, np.int16)
        chars[np.arange(chars.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(urls), np.uint8)
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for c in chars.T:
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.take[c]) | (state & self.stay[c])
        return (state[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64)) & one == one


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    Of the rules that fit, the one of highest rank decides, the earlier of equals; ``rule`` is its name
    and is null for rules without one.  Where none fits the verdict is ``default``.  A null URL, or one
    without "://", has an empty host and path.  Long URLs are read whole.  An empty table gives none, repeated
    rows stay repeated, other columns are ignored.
    """
    machine = Automaton(rules)
    order = sorted(range(len(rules)), key=lambda i: (-rules[i].rank, i))
    names = [rules[i].name for i in order] + [None]
    actions = [rules[i].action for i in order] + [default]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            urls = [b"." + h.encode() + bytes([CUT]) + p.encode() for h, p in zip(hosts, paths)]
            fits = machine.matches(urls)[:, order]
            fits = np.concatenate([fits, np.ones((len(urls), 1), bool)], axis=1)
            first = fits.argmax(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([names[i] for i in first], pa.string()), pa.array([actions[i] for i in first], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col).cast("string")).alias("host"), path_of(F.col(url_col).cast("string")).alias("path"))
    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string")
