"""Byte-pair merging of many pre-tokens at once: linked lists in numpy, driven by a rank queue.

All pre-tokens of a batch lie one after the other with a border symbol between them. The queue gives
the lowest rank that any adjacent pair has; all pairs of that rank are merged in one step, left to
right where they touch. That equals merging them one by one, unless a merge brings forth a pair of the
same or a lower rank; pre-tokens where that happens are reported and merged singly by the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np

NONE = np.int32(2**31 - 1)
BORDER = (1 << 20) - 1


class Pairs:
    """Pair of symbols -> rank; ``made`` gives the symbol that a rank makes."""

    def __init__(self, pairs: dict[int, int], made: np.ndarray):
        self.keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.ranks = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.made = made

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def leftmost(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places whose pairs share a symbol, every second one from the left."""
    touching = after[places[:-1]] == places[1:]
    if not touching.any():
        return places
    take = np.ones(len(places), bool)
    for i in (np.flatnonzero(touching) + 1).tolist():
        take[i] = not take[i - 1]
    return places[take]


def merge_all(symbols: np.ndarray, pairs: Pairs, queue) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges ``symbols`` (with borders) to the end.

    ``queue`` has ``add(rank)`` and ``pop()`` (lowest rank, None when empty). Result: symbols (-1 where
    merged away), places of all merges, places next to which a rank came too late (see above).
    """
    n = len(symbols)
    symbols = symbols.astype(np.int32)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    wanted = np.full(n, NONE, np.int32)
    wanted[:-1] = pairs.find(symbols[:-1], symbols[1:])
    first = np.flatnonzero(wanted != NONE).astype(np.int32)
    first = first[np.argsort(wanted[first], kind="stable")]
    ranks, starts = np.unique(wanted[first], return_index=True)
    cuts = [*starts.tolist(), len(first)]
    buckets: dict[int, list] = {}
    for i, rank in enumerate(ranks.tolist()):
        buckets[rank] = [first[cuts[i] : cuts[i + 1]]]
        queue.add(rank)
    late, done = [], []
    keys, known, top, shift = pairs.keys, pairs.ranks, len(pairs.keys) - 1, np.int64(20)
    while (rank := queue.pop()) is not None:
        held = buckets.pop(rank)
        places = held[0] if len(held) == 1 else np.concatenate(held)
        places = places[wanted[places] == rank]
        if len(places) > 1:
            places = np.sort(places)
            places = places[np.concatenate(([True], places[1:] != places[:-1]))]
            places = leftmost(places, after)
        elif not len(places):
            continue
        made = pairs.made[rank]
        gone = after[places]
        ends = after[gone]
        after[places] = ends
        before[ends] = places
        symbols[places] = made
        symbols[gone] = -1
        wanted[gone] = NONE
        done.append(places)
        both = np.concatenate([places, before[places]])
        key = symbols[both].astype(np.int64) << shift | symbols[after[both]]
        at = keys.searchsorted(key)
        np.minimum(at, top, out=at)
        hit = keys[at] == key
        wanted[both] = NONE
        both, new = both[hit], known[at[hit]]
        if not len(both):
            continue
        wanted[both] = new
        if new.min() <= rank:
            bad = new <= rank
            late.append(both[bad])
            wanted[both[bad]] = NONE
            both, new = both[~bad], new[~bad]
            if not len(both):
                continue
        order = new.argsort(kind="stable")
        both, new = both[order], new[order]
        cuts = [0, *((new[1:] != new[:-1]).nonzero()[0] + 1).tolist(), len(new)]
        for i, r in enumerate(new[cuts[:-1]].tolist()):
            part = both[cuts[i] : cuts[i + 1]]
            if r in buckets:
                buckets[r].append(part)
            else:
                buckets[r] = [part]
                queue.add(r)
    none = np.empty(0, np.int32)
    return symbols, np.concatenate(done) if done else none, np.concatenate(late) if late else none


class Pieces(dict):
    """Pre-token -> number, in order of first sight; remembers what was worked out for each number."""

    def __init__(self, solve: Callable[[list[str]], list], limit: int):
        super().__init__()
        self.solve, self.limit, self.solved = solve, limit, 0

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int32, len(pieces))

    def fresh(self) -> list[str]:
        found = list(islice(self, self.solved, None))
        self.solved = len(self)
        return found

    def trim(self) -> bool:
        """Forgets everything when over the limit; to be called between batches."""
        if len(self) <= self.limit:
            return False
        self.clear()
        self.solved = 0
        return True


class Flat:
    """Lists of ids for numbers 0, 1, ...: joined by numpy, without a Python step per id."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        starts = np.cumsum(lengths) - lengths + len(self.ids)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(total)]


def laid_out(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of pre-tokens with a border before, between and after: (bytes as int32, is border, starts)."""
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(lengths + 1) - lengths
    out = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8).astype(np.int32)
    border = np.zeros(len(out), bool)
    border[np.concatenate([[0], starts + lengths])] = True
    return out, border, starts
