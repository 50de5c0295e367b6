"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of symbols. Every merge rank has a bucket of list positions, and a
two-level bitmap (256 words of 256 bits) tells which buckets hold anything: find-first-set on the top
word and on the word below gives the next rank. Entries whose pair has changed meanwhile are stale
and skipped. Finding the next rank costs the same whatever the pre-token's length, so a pre-token of
megabytes takes time in proportion to its length.

The new pre-tokens of an Arrow batch share one queue: a bucket then holds all places of its rank, which
numpy merges in one step (``merging.py``); ``merge`` is the same for one pre-token, place by place, and
takes over where the order inside a pre-token matters. Pre-tokens repeat; a worker keeps the ids of
about ``CACHE`` of them. A document is one row and is worked on as a whole: memory follows the longest text.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.classes import splitter
from webloom.llm.common import add_columns, kept_by_worker, read_table
from webloom.llm.merging import BORDER, Flat, Pairs, Pieces, laid_out, merge_all

#: Pre-tokens whose ids one Python worker keeps; a memory bound, it has no effect on results.
CACHE = 250_000
RANKS = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of "base64 rank" lines."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost first among equals."""
    n = len(piece)
    get = ranks.get
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    wanted = [-1] * n
    buckets: dict[int, list[int]] = {}
    top, words = 0, {}
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            wanted[i] = rank
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                top |= 1 << (rank >> 8)
                words[rank >> 8] = words.get(rank >> 8, 0) | 1 << (rank & 255)
    while top:
        high = (top & -top).bit_length() - 1
        word = words[high]
        rank = high << 8 | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        left = heappop(bucket)
        if not bucket:
            del buckets[rank]
            words[high] = word & word - 1
            if not words[high]:
                top &= top - 1
        if wanted[left] != rank:
            continue
        middle = after[left]
        end = after[middle]
        after[left] = end
        wanted[middle] = -1
        spans = []
        if end < n:
            before[end] = left
            spans.append((left, after[end]))
        else:
            wanted[left] = -1
        if before[left] >= 0:
            spans.append((before[left], end))
        for start, stop in spans:
            new = get(piece[start:stop])
            if new is None:
                wanted[start] = -1
                continue
            wanted[start] = new
            if new in buckets:
                heappush(buckets[new], start)
            else:
                buckets[new] = [start]
                top |= 1 << (new >> 8)
                words[new >> 8] = words.get(new >> 8, 0) | 1 << (new & 255)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class BitmapQueue:
    """Set of ranks below 65536 in two levels of 256-bit words; ``pop`` finds the lowest by find-first-set."""

    def __init__(self):
        self.top, self.words = 0, [0] * 256

    def add(self, rank: int) -> None:
        self.top |= 1 << (rank >> 8)
        self.words[rank >> 8] |= 1 << (rank & 255)

    def pop(self) -> int | None:
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        word = self.words[high]
        self.words[high] = word & (word - 1)
        if not self.words[high]:
            self.top &= self.top - 1
        return high << 8 | (word & -word).bit_length() - 1


class Encoder:
    """Texts -> ids by one rank file and one split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("the bitmap holds ranks below 65536")
        self.split = splitter(pattern)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = Pairs(pairs, np.arange(1 << 16))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pieces, self.ids = Pieces(self.solve, CACHE), Flat()

    def solve(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, joined, and how many each has."""
        raw = [p.encode() for p in pieces]
        values, border, starts = laid_out(raw)
        symbols = np.where(border, BORDER, self.single[values])
        symbols, _, late = merge_all(symbols, self.pairs, BitmapQueue())
        alive = (symbols >= 0) & ~border
        ids, counts = symbols[alive], np.add.reduceat(alive, starts) if len(starts) else np.empty(0, np.int64)
        # a pre-token that is a token stays whole, whatever its merges would give
        again = {*np.unique(np.searchsorted(starts, late, side="right") - 1).tolist()}
        again |= {i for i in np.flatnonzero(counts > 1).tolist() if raw[i] in self.ranks}
        if again:
            ends, parts, at = np.cumsum(counts), [], 0
            for i in sorted(again):
                whole = self.ranks.get(raw[i])
                own = np.array([whole] if whole is not None else merge(raw[i], self.ranks), np.int32)
                parts += [ids[at : ends[i] - counts[i]], own]
                at, counts[i] = ends[i], len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, counts.astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.pieces.trim():
            self.ids.clear()
        numbers = [self.pieces.numbers(self.split(t)) for t in texts]
        if fresh := self.pieces.fresh():
            self.ids.extend(*self.solve(fresh))
        return [self.ids.joined(n) for n in numbers]


def encode(
    df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, out: str = "ids",
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``out``: the ids of the whole text as ``array<int>``; special strings are ordinary text.

    A null or empty text has no ids. Repeated rows each get their ids. A column already called ``out``
    is replaced; other columns (``keep``, all by default) stay as they are. No rows give no rows.
    """
    path = path or public_tokenizers.path(RANKS)

    def work(texts: list[str]) -> list[pa.Array]:
        encoder = kept_by_worker(("op3", path, pattern), lambda: Encoder(path, pattern))
        parts = encoder.encode(texts)
        ends = np.cumsum([0, *map(len, parts)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int32()))]

    return add_columns(df, text, [T.StructField(out, T.ArrayType(T.IntegerType(), False))], work, keep)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the bytes that the ids stand for. Null or empty ids give no bytes; an unknown id is an error."""
    path = path or public_tokenizers.path(RANKS)

    def work(rows: list) -> list[pa.Array]:
        tokens = kept_by_worker(("op3 bytes", path), lambda: {r: t for t, r in load_ranks(path).items()})
        return [pa.array([b"".join(map(tokens.__getitem__, row or ())) for row in rows], pa.binary())]

    return add_columns(df, ids, [T.StructField(out, T.BinaryType())], work, keep)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = encode(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    both = decode(ids, keep=["doc_id", "ids"])
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
