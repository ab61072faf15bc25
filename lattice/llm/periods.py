"""Runs of repeated word sequences, found by recompression.

A run is a stretch of words that repeats with a smallest period q, is at least `least` words and `times` periods long, and
that no neighbouring word extends. Texts go to tasks in batches of whole texts. A batch becomes one sequence of word
numbers with a number of its own after each text, which is compressed into a run-length grammar: a level that joins each
block of equal symbols to one (symbol, length) alternates with a level that joins pairs of a left and a right symbol, the
symbols being dealt to left and right anew on each level. What a level joins depends on neighbouring symbols only, so
equal stretches have equal parses but for their ends.

The words that equal the word q places on form a stretch of at least max(least - q, (times - 1) * q) in a run of period q,
so a grid of that step meets each run: n log n candidates in all. From each candidate whose two words are equal the
grammar answers how far the two places agree, ahead and behind: a query climbs the levels while both places are at the
start of a symbol, steps over at most one partial symbol a level, and comes down at the difference. All queries of a batch
climb together, as arrays. Answers are exact; no suffix array and no hash of words is used.

Defined cases: null, empty and short texts have no run; a stretch has one smallest period, so none is reported twice;
runs may overlap; repeated rows get equal results; an empty table gives an empty one; other columns stay, and those named
as a result are replaced. Memory of a task is about 100 bytes a word of a batch (BATCH words, or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, TIMES = 24, 3
#: Words that are compressed together, and candidates that are looked at together.
BATCH, CANDIDATES = 1 << 16, 1 << 20
#: No more levels once no text is longer than this many symbols; queries end there one symbol at a time.
SHORT, ROUNDS = 4, 96
RUN = "start bigint, length bigint, period bigint"


class _Level:
    """One level of the grammar: its symbols, and how they join to the level above. starts[i] is the first symbol of the
    i-th symbol above (with the number of symbols at its end), up[i] the symbol above i."""

    def __init__(self, sym: np.ndarray, first: np.ndarray | None, blocks: bool):
        self.sym, self.blocks, self.first = sym, blocks, first
        if first is not None:
            self.starts = np.flatnonzero(first).astype(np.int32)
            self.up = (np.cumsum(first) - 1).astype(np.int32)
            self.starts = np.append(self.starts, np.int32(len(sym)))

    def flipped(self) -> _Level:
        out = _Level.__new__(_Level)
        out.sym, out.blocks, out.first = self.sym[::-1], self.blocks, None
        if self.first is not None:
            out.starts = (len(self.sym) - self.starts)[::-1]
            out.up = (len(self.starts) - 2 - self.up)[::-1]
            out.first = np.append(self.first[1:], True)[::-1]
        return out


def _numbered(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """A number from base on for each distinct pair."""
    return np.unique((a.astype(np.int64) << 32) | b, return_inverse=True)[1].astype(np.int64) + base


class Grammar:
    """Run-length grammar of a sequence of symbols 0 to n_symbols - 1. Those of at least `ends` are ends: they never
    join, so nothing joins across them."""

    def __init__(self, sym: np.ndarray, ends: int, n_symbols: int):
        self.levels: list[_Level] = []
        sym, fresh, self.size = sym.astype(np.int64), n_symbols, len(sym)
        for k in range(ROUNDS):
            end = (sym >= ends) & (sym < n_symbols)
            at = np.flatnonzero(end)
            if not len(sym) or np.diff(at, prepend=-1, append=len(sym)).max(initial=0) - 1 <= SHORT:
                break
            same = np.append(False, (sym[1:] == sym[:-1]) & ~end[1:])
            if same.any():
                level = _Level(sym, ~same, True)
                above, n = sym[level.starts[:-1]].copy(), np.diff(level.starts)
                many = n > 1
                above[many] = _numbered(above[many], n[many], fresh)
                fresh = max(fresh, int(above.max(initial=0)) + 1)
                self.levels.append(level)
                sym = above
                end = (sym >= ends) & (sym < n_symbols)
            left = ((sym * 0x9E3779B1 + (k + 1) * 0x85EBCA6B & 0xFFFFFFFF) * 0xC2B2AE35 & 0xFFFFFFFF) >> 31 == 1
            here, other = left & ~end, ~left & ~end
            pair, turned = here[:-1] & other[1:], other[:-1] & here[1:]
            pair = turned if np.count_nonzero(turned) > np.count_nonzero(pair) else pair
            if not pair.any():
                continue
            level = _Level(sym, np.append(True, ~pair), False)
            above, at = sym[level.starts[:-1]].copy(), np.flatnonzero(pair)
            above[level.up[at]] = _numbered(sym[at], sym[at + 1], fresh)
            fresh = max(fresh, int(above.max(initial=0)) + 1)
            self.levels.append(level)
            sym = above
        self.levels.append(_Level(sym, None, False))
        self._back = [x.flipped() for x in self.levels]

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols from x on equal those from y on, x < y. The last symbol occurs nowhere else."""
        return _agree(self.levels, x, y) - x

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols before x, and before y, are equal, x < y. A text begins after an end or at the start."""
        out = np.zeros(len(x), np.int64)
        some = np.flatnonzero(x > 0)
        # flipped, the right place comes first; its queries end where the left place meets an end or the start
        a, b = self.size - y[some], self.size - x[some]
        out[some] = _agree(self._back, a, b) - a
        return out


def _agree(levels: list[_Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where the symbols from x on first differ from those from y on, as a place of x. y may reach the end of the
    sequence, which differs from every symbol."""
    x, y, n = x.astype(np.int64), y.astype(np.int64), len(x)
    fell = np.full(n, -1)  # the level at which a difference showed
    live = np.arange(n)
    for k, level in enumerate(levels):
        if not len(live):
            break
        sym, size = np.append(level.sym, -1), len(level.sym)
        if level.first is None:  # the top: a few symbols a text
            while len(live):
                a, b = x[live], y[live]
                on = (sym[a] == sym[b]) & (b < size)
                fell[live[~on]] = k
                live = live[on]
                x[live] += 1
                y[live] += 1
            break
        first, up = np.append(level.first, True), np.append(level.up, level.starts.size - 1)
        a, b = x[live], y[live]
        part = ~(first[a] & first[b])
        alike = (sym[a] == sym[b]) & (b < size)
        if level.blocks:  # what is left of either block
            ra, rb = level.starts[np.minimum(up[a] + 1, level.starts.size - 1)] - a, level.starts[np.minimum(up[b] + 1, level.starts.size - 1)] - b
            step = np.where(part & alike, np.minimum(ra, rb), 0)
            ended = part & (~alike | (ra != rb))
        else:
            step = (part & alike).astype(np.int64)
            ended = part & ~alike
        a, b = a + step, b + step
        ended |= ~(first[a] & first[b])  # one place is inside a pair, the other at a start: their symbols differ
        x[live], y[live] = a, b
        fell[live[ended]] = k
        live = live[~ended]
        x[live], y[live] = up[x[live]], up[y[live]]
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(fell >= k)
        if not len(down):
            continue
        level = levels[k - 1]
        a, b = level.starts[x[down]].astype(np.int64), level.starts[y[down]].astype(np.int64)
        sym, size = np.append(level.sym, -1), len(level.sym)
        alike = (sym[a] == sym[b]) & (b < size)
        if level.blocks:
            ends = np.append(level.starts[1:], size)
            step = np.where(alike, np.minimum(ends[x[down]] - a, ends[y[down]] - b), 0)
        else:
            step = alike.astype(np.int64)
        x[down], y[down] = a + step, b + step
    return x


def _grid(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of a text of n words, for each period that fits `times` times, in parts of bounded size."""
    q = np.arange(1, n // times + 1)
    q = q[np.maximum(least, times * q) <= n]
    step = np.maximum(least - q, (times - 1) * q)
    count = -(-(n - q) // step)
    total = np.cumsum(count)
    while len(q):
        k = max(1, int(np.searchsorted(total, (total[0] - count[0]) + CANDIDATES)))
        c = count[:k]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield nth * np.repeat(step[:k], c), np.repeat(q[:k], c)
        q, step, count, total = q[k:], step[k:], count[k:], total[k:]


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each list of words an array of (start, length, period), by start, then period."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts])
    words = [number.setdefault(w, len(number)) for t in texts for w in t]
    ends = len(number)
    begins = np.cumsum(sizes + 1) - sizes - 1
    sym = np.empty(len(words) + len(texts), np.int64)
    last = begins + sizes
    own = np.ones(len(sym), bool)
    own[last] = False
    sym[own], sym[last] = words, ends + np.arange(len(texts))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    grammar, room = None, 0

    def ask() -> None:
        nonlocal grammar, room
        if not held:
            return
        grammar = grammar or Grammar(sym, ends, ends + len(texts))
        at, q = (np.concatenate(c) for c in zip(*held))
        ahead = grammar.ahead(at, at + q)
        behind = grammar.behind(at, at + q)
        s, e = at - behind, at + ahead + q
        good = e - s >= np.maximum(least, times * q)
        found.append((s[good], e[good], q[good]))
        held.clear()
        room = 0

    for i, n in enumerate(sizes):
        for at, q in _grid(int(n), least, times):
            at = at + begins[i]
            hit = sym[at] == sym[at + q]
            held.append((at[hit], q[hit]))
            room += int(np.count_nonzero(hit))
            if room >= CANDIDATES:
                ask()
    ask()
    out = [np.empty((0, 3), np.int64)] * len(texts)
    if not found:
        return out
    s, e, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.append(True, (s[1:] != s[:-1]) | (e[1:] != e[:-1]))[: len(s)]  # the least period of a stretch comes first
    s, e, q = s[new], e[new], q[new]
    order = np.lexsort((q, s))
    s, e, q = s[order], e[order], q[order]
    text = np.searchsorted(begins, s, "right") - 1
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in np.unique(text):
        a, b = cut[i], cut[i + 1]
        out[i] = np.stack([s[a:b] - begins[i], e[a:b] - s[a:b], q[a:b]], axis=1)
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run repeats after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
    return b" ".join(words)


def _batches(texts: list[bytes | None], size: int) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for t in texts:
        words = (t or b"").split()  # bytes split at space and \x09-\x0D only
        if held and n + len(words) > size:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def periodic_runs(df: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """df with n_words, runs (array of start, length, period in words, by start) and collapsed (the text without
    repeated periods, its words joined by one space)."""
    if not (isinstance(least, int) and isinstance(times, int) and times >= 2 and least >= 1):
        raise ValueError("least and times are whole numbers, times 2 at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            for texts in _batches(whole.column(1).to_pylist(), BATCH):
                found = runs_of(texts, least, times)
                flat = np.concatenate(found)
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(offsets, items), pa.array([collapsed(t, r) for t, r in zip(texts, found)], pa.binary())],
                    ["kept", "n_words", "runs", "collapsed"],
                )
                at += len(texts)

    names = {"n_words", "runs", "collapsed"}
    stay = [c for c in df.columns if c.lower() not in names]
    rows = df.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in stay)).alias("kept"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = T.StructType([rows.schema["kept"], *T._parse_datatype_string(f"n_words bigint, runs array<struct<{RUN}>>, collapsed binary").fields])
    out = rows.mapInArrow(run, kind)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in stay), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period; ties: least start, then least period. Compared as fractions."""

    def better(best: Column, x: Column) -> Column:
        mine, own = x["length"] * best["period"], best["length"] * x["period"]
        return F.when(best.isNull() | (mine > own), x).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)
