"""Maximal periodic runs of words by recompression.

Word numbers are compressed in rounds: a block round turns each maximal stretch of one symbol into a symbol
of its own, a pair round splits the symbols into left and right ones and joins each left one with a right one
behind it. Equal stretches are cut alike, so the symbols of all rounds are a run-length grammar, and how far two
places agree is found by climbing to ever larger equal symbols and down again: no suffix array is needed.

A run of period p and length 2p or more holds two neighbouring multiples of p. So for every p the pairs
(kp, kp + p) are candidates, n/1 + n/2 + ... in all; those that agree are extended to both sides by the grammar.
A stretch found under several periods has the smallest of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import WORD, add_columns, mixed, read_table

#: Fewest words of a run.
LEAST = 12
#: Candidates that are looked at together; a memory bound, it has no effect on results.
TOGETHER = 1_000_000


@dataclass
class Level:
    """Symbols of a level and where they go in the next one: ``up`` is the symbol that takes them in, ``left`` how
    many symbols from here to its end, ``child`` (of the next level) the first symbol that each takes in."""

    symbols: np.ndarray
    up: np.ndarray | None = None
    left: np.ndarray | None = None
    child: np.ndarray | None = None
    pairs: bool = False


def _next(level: Level, starts: np.ndarray, new: np.ndarray, pairs: bool) -> Level:
    at = np.flatnonzero(starts)
    sizes = np.diff(np.append(at, len(starts)))
    level.up = np.cumsum(starts) - 1
    level.left = np.repeat(at + sizes, sizes) - np.arange(len(starts))
    level.child, level.pairs = at, pairs
    return Level(new)


def _numbered(keys: np.ndarray, first: int) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1) + first


def recompress(words: np.ndarray) -> list[Level]:
    """Levels of the grammar over ``words``, stretches of numbers from 1 on; a 0 stands before, between and behind them
    and is never joined. The last level has one symbol for each stretch."""
    levels, free, round_ = [Level(words)], int(words.max(initial=0)) + 1, 0
    while len(now := levels[-1].symbols) > 2 * int((now == 0).sum()) - 1:
        # blocks
        starts = np.append(True, (now[1:] != now[:-1]) | (now[1:] == 0))
        at = np.flatnonzero(starts)
        if len(at) < len(now):
            sizes = np.diff(np.append(at, len(now)))
            new, many = now[at].copy(), sizes > 1
            new[many] = _numbered(new[many] * np.int64(len(now) + 1) + sizes[many], free)
            free = max(free, int(new.max()) + 1)
            levels.append(_next(levels[-1], starts, new, False))
            now = new
        # pairs: the side of a symbol is drawn anew in each round, the better direction is taken
        side = (mixed(now.astype(np.uint64) * np.uint64(2) + np.uint64(round_ << 40)) & np.uint64(1)).astype(bool)
        inner = (now[:-1] != 0) & (now[1:] != 0)
        there, back = inner & ~side[:-1] & side[1:], inner & side[:-1] & ~side[1:]
        joins = there if there.sum() >= back.sum() else back
        round_ += 1
        if not joins.any():
            continue
        starts = np.append(True, ~joins)
        at = np.flatnonzero(starts)
        new, two = now[at].copy(), np.append(joins, False)[at]
        new[two] = _numbered(new[two] * np.int64(free) + now[at[two] + 1], free)
        free = max(free, int(new.max()) + 1)
        levels.append(_next(levels[-1], starts, new, True))
    return levels


def mirrored(levels: list[Level]) -> list[Level]:
    """The same grammar read from the end to the start."""
    out = []
    for level in levels:
        size, new = len(level.symbols), Level(level.symbols[::-1], pairs=level.pairs)
        if level.up is not None:
            new.up = len(level.child) - 1 - level.up[::-1]
            new.left = (np.arange(size) - level.child[level.up] + 1)[::-1]
            new.child = (size - np.append(level.child[1:], size))[::-1]
        out.append(new)
    return out


def agreement(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols of the first level agree from places ``i`` and ``j`` on, ``i`` and ``j`` being different places of
    one stretch: climb while the symbols are equal, then descend to the first difference."""
    a, b = i.copy(), j.copy()
    parked = np.zeros(len(a), np.int64)
    climbing = np.arange(len(a))
    for height, level in enumerate(levels):
        at = climbing
        equal = level.symbols[a[at]] == level.symbols[b[at]]
        parked[at[~equal]] = height
        at = at[equal]
        if not len(at) or level.up is None:
            break
        # one step to the end of a symbol of the next level, where one of the two places is inside of it
        inside = (level.child[level.up[a[at]]] != a[at]) | (level.child[level.up[b[at]]] != b[at])
        move = at[inside]
        step = np.minimum(level.left[a[move]], level.left[b[move]])
        a[move] += step
        b[move] += step
        differ = move[level.symbols[a[move]] != level.symbols[b[move]]]
        parked[differ] = height
        stays = np.ones(len(a), bool)
        stays[differ] = False
        climbing = at[stays[at]]
        a[climbing] = level.up[a[climbing]]
        b[climbing] = level.up[b[climbing]]
    for height in range(int(parked.max(initial=0)) - 1, -1, -1):
        level, at = levels[height], np.flatnonzero(parked > height)
        a[at], b[at] = level.child[a[at]], level.child[b[at]]
        at = at[level.symbols[a[at]] == level.symbols[b[at]]]
        step = 1 if level.pairs else np.minimum(level.left[a[at]], level.left[b[at]])
        a[at] += step
        b[at] += step
    return a - i


def candidates(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the pairs of neighbouring multiples of a period that can lie in a run."""
    halves = sizes // 2
    of = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(of)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    counts = (sizes[of] - 1) // period
    ends, at, found = np.cumsum(counts), 0, []
    changes = np.flatnonzero(np.append(words[1:] != words[:-1], True))
    equal_to = changes[np.searchsorted(changes, np.arange(len(words)))]
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
        c, p = counts[at:to], period[at:to]
        steps = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        p, i = np.repeat(p, c), np.repeat(starts[of[at:to]], c)
        i = i + steps * p
        # where all words from i to i + p are one word, the period is 1
        hit = (words[i] == words[i + p]) & ((p == 1) | (equal_to[i] < i + p))
        i, p = i[hit], p[hit]
        # the places that agree with the one a period later are a stretch of at least half a run, this one in it
        need = np.maximum(p, least - p)
        reach = np.minimum(need, 6)
        got, going = np.ones(len(i), np.int64), np.ones(len(i), bool)
        for way in (1, -1):
            going[:] = True
            for k in range(1, 6):
                x = i + way * k
                going &= (x >= 0) & (x + p < len(words))
                x = np.where(going, x, 0)
                going &= (words[x] == words[x + np.where(going, p, 0)]) & (words[x] != 0)
                got += going
        found.append((i[got >= reach], p[got >= reach]))
        at = to
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text, given as numbers from 1 on, its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = [np.empty((0, 3), np.int64)] * len(texts)
    if not sizes.sum():
        return out
    starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)

    def joined(which: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], *(part for t in which.tolist() for part in (texts[t], [0]))]).astype(np.int64)

    words = joined(np.arange(len(texts)))
    i, p = candidates(words, starts, sizes, least)
    if not len(i):
        return out
    # the grammar needs only the texts that have candidates
    of = np.searchsorted(starts, i, side="right") - 1
    which, back = np.unique(of, return_inverse=True)
    own = 1 + np.cumsum(sizes[which] + 1) - (sizes[which] + 1)
    levels = recompress(joined(which))
    flipped, last = mirrored(levels), len(levels[0].symbols) - 1
    place, found = own[back] + i - starts[of], []
    for at in range(0, len(i), TOGETHER):
        x, q = place[at : at + TOGETHER], p[at : at + TOGETHER]
        after = agreement(levels, x, x + q)
        before = agreement(flipped, last - (x - 1), last - (x + q - 1))
        keep = (after + before >= q) & (after + before + q >= least)
        text = back[at : at + TOGETHER][keep]
        found.append(np.stack([text, x[keep] - before[keep] - own[text], (after + before + q)[keep], q[keep]], 1))
    rows = np.unique(np.concatenate(found), axis=0)
    if not len(rows):
        return out
    # rows of one stretch stand together, the smallest period first
    first = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(which) + 1))
    for k, text in enumerate(which.tolist()):
        out[text] = rows[cuts[k] : cuts[k + 1], 1:]
    return out


def repeats_in(size: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``size`` words lie in a run behind its first period."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


class Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self) + 1
        return number


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, runs (start, length, period in words; by start, then period) and collapsed: the text's words, without
    those that a run repeats, joined by one space.

    A run is a longest stretch of at least ``least`` words, and of two periods, in which words a period apart are
    identical. A null, empty or blank text has no words, no runs and an empty collapsed text. Every row is taken by
    itself, repeated rows alike. Columns of the input with the names of new ones are replaced. No rows give no rows.
    """

    def work(texts: list[str]) -> list[pa.Array]:
        find, numbers = re.compile(WORD).findall, Numbers()
        words = [find(t) for t in texts]
        runs = runs_of([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words], least)
        left = [" ".join(np.array(w, object)[~repeats_in(len(w), r)]) if len(r) else " ".join(w) for w, r in zip(words, runs, strict=True)]
        rows = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
        ends = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=[f.name for f in RUN.fields])
        return [pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), items), pa.array(left, pa.string())]

    return add_columns(df, text, FIELDS, work, keep)


def with_planted_periods(text: Column, doc_id: Column) -> Column:
    """The text; for one in ten documents, by crc32 of the doc_id, its end repeats a stretch of it."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + WORD + ")"), F.lit(1))
    n = F.size(words).cast("long")

    def edited(own: Column) -> Column:
        n = F.size(own).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        return F.concat_ws(" ", F.transform(own, lambda w, i: F.get(own, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    return F.when((h % 10 == 0) & (n > 0), F.get(F.transform(F.array(words), edited), F.lit(0))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", with_planted_periods(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, keep=["doc_id"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-F.col("best.less") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
