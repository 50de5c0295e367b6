"""Token counts by heap-and-linked-list byte-pair merging, without producing identifiers.

A word's symbols form a linked list, its mergeable pairs a heap by rank. The lowest pair is popped again
and again; the count is the number of first symbols less the number of merges. The new words of an Arrow
batch share one heap, so that all pairs of a rank merge in one numpy step (``merging.py``); ``word`` is
the same for a single word, pair by pair, and takes over where the order inside a word matters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.classes import splitter
from webloom.llm.common import add_columns, kept_by_worker, read_table
from webloom.llm.merging import BORDER, Pairs, Pieces, laid_out, merge_all

#: Words whose counts one Python worker keeps; a memory bound, it has no effect on results.
CACHE = 250_000
VOCABULARY = "word_bpe_49k.json"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class HeapQueue:
    """Ranks in a heap; each is held once."""

    def __init__(self):
        self.heap: list[int] = []

    def add(self, rank: int) -> None:
        heappush(self.heap, rank)

    def pop(self) -> int | None:
        return heappop(self.heap) if self.heap else None


class Counter:
    """Counts of one vocabulary file: BPE with word ends over lower-cased, composed text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocabulary = spec["model"], spec["model"]["vocab"]
        self.check(spec)
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int32)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocabulary[a] << 20 | vocabulary[b]] = (rank, vocabulary[a + b])
        self.pairs = Pairs({k: r for k, (r, _) in self.merges.items()}, np.array([vocabulary[a + b] for a, b in model["merges"]]))
        self.split = splitter(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))
        self.pieces, self.counts = Pieces(self.solve, CACHE), np.empty(0, np.int64)

    @staticmethod
    def check(spec: dict) -> None:
        """Files of another make would be counted wrongly; they are refused."""
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if not (
            spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] and steps == ["NFC", "Replace", "Lowercase"]
            and split["invert"] and split["behavior"] == "Removed" and bytes_["type"] == "ByteLevel" and not bytes_["use_regex"] and plain
        ):
            raise ValueError("not a vocabulary of lower-cased words with word ends")

    def word(self, raw: bytes) -> int:
        """Tokens of one word: symbols less merges."""
        merges, n = self.merges, len(raw)
        symbols = self.inner[np.frombuffer(raw, np.uint8)].tolist()
        symbols[-1] = int(self.last[raw[-1]])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 20 | symbols[i + 1])
            if found:
                heap.append((found[0], i, found[1]))
        heapify(heap)
        done = 0
        while heap:
            _, left, made = heappop(heap)
            right = after[left]
            if symbols[left] < 0 or right >= n:
                continue
            found = merges.get(symbols[left] << 20 | symbols[right])
            if found is None or found[1] != made:
                continue
            symbols[left], symbols[right] = made, -1
            done += 1
            after[left] = end = after[right]
            if end < n:
                before[end] = left
                found = merges.get(made << 20 | symbols[end])
                if found:
                    heappush(heap, (found[0], left, found[1]))
            first = before[left]
            if first >= 0:
                found = merges.get(symbols[first] << 20 | made)
                if found:
                    heappush(heap, (found[0], first, found[1]))
        return n - done

    def solve(self, pieces: list[str]) -> np.ndarray:
        """Token counts of words."""
        raw = [p.encode() for p in pieces]
        values, border, starts = laid_out(raw)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = np.where(border, BORDER, self.inner[values])
        ends = starts + lengths - 1
        symbols[ends] = self.last[values[ends]]
        _, done, late = merge_all(symbols, self.pairs, HeapQueue())
        owner = np.searchsorted(starts, done, side="right") - 1
        counts = lengths - np.bincount(owner, minlength=len(raw))
        for i in np.unique(np.searchsorted(starts, late, side="right") - 1).tolist():
            counts[i] = self.word(raw[i])
        return counts

    def parts(self, text: str) -> tuple[list[str], int]:
        """Words of a whole text, and the number of special strings in it; those are found before anything is normalised."""
        parts = self.special.split(text)
        return [w for p in parts for w in self.split(plain(p))] if len(parts) > 1 else self.split(plain(text)), len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        if self.pieces.trim():
            self.counts = np.empty(0, np.int64)
        found = [(self.pieces.numbers(words), extra) for words, extra in map(self.parts, texts)]
        if fresh := self.pieces.fresh():
            self.counts = np.concatenate([self.counts, self.solve(fresh)])
        return [int(self.counts[numbers].sum()) + extra for numbers, extra in found]


def plain(text: str) -> str:
    """Composed and lower-cased. The library lower-cases letter by letter, so a capital sigma never becomes the final form."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def count_tokens(
    df: DataFrame, text: str = "text", path: str | None = None, out: str = "n_tokens", keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``out``: the number of tokens of the whole text, without begin or end tokens.

    A null, empty or blank text has 0 tokens. Repeated rows are counted alike; a column already called
    ``out`` is replaced, the others (``keep``, all by default) stay. No rows give no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def work(texts: list[str]) -> list[pa.Array]:
        counter = kept_by_worker(("op9", path), lambda: Counter(path))
        return [pa.array(counter.count(texts), pa.int64())]

    return add_columns(df, text, [T.StructField(out, T.LongType())], work, keep)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than 2048 tokens)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
