"""Best-fit packing of token sequences by bin completion with branch and bound.

Lengths are whole numbers up to the capacity, so their histogram says all about the bins: one row per
length, whatever the number of documents. The driver packs the histogram: around the largest open length it
enumerates undominated fillings, takes each as many times at once as the counts allow, prunes by the
waste that is left to beat, and keeps the best-fit solution as incumbent. Spark ranks the pieces of each
length in parallel and every piece finds its sequence by (length, rank).
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.classes import splitter
from webloom.llm.common import add_columns, kept_by_worker, read_table, written
from webloom.llm.merging import Flat, Pieces

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.json"
#: Id after each document.
END = 2
#: Pre-tokens whose ids one Python worker keeps; a memory bound, it has no effect on results.
CACHE = 400_000
#: Rows that are ranked together in one task.
CHUNK = 100_000
#: Nodes of the search; when they are used up the incumbent stands.
NODES = 20_000


class Tokenizer:
    """Ids of whole texts by the tokenizers library, each pre-token encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.split = splitter(public_tokenizers.PATTERN)
        self.pieces, self.flat = Pieces(None, CACHE), Flat()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.pieces.trim():
            self.flat.clear()
        # a text with a special string goes through the library as a whole
        whole = [i for i, t in enumerate(texts) if self.special(t)]
        numbers = [self.pieces.numbers([] if i in whole else self.split(t)) for i, t in enumerate(texts)] if whole else [
            self.pieces.numbers(self.split(t)) for t in texts]
        if fresh := self.pieces.fresh():
            found = [e.ids for e in self.library.encode_batch_fast(fresh, add_special_tokens=False)]
            self.flat.extend(np.fromiter((i for ids in found for i in ids), np.int32), np.fromiter(map(len, found), np.int64, len(found)))
        out = [self.flat.joined(n) for n in numbers]
        for i in whole:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ones of the capacity, what is over comes first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(
    df: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, keep: list[str] | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: columns ``keep`` (all by default), piece, start, length, ids_crc32 and, if asked for, ids.

    A null or empty text is one piece: the end id alone. Repeated rows give repeated pieces.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    fields = ["piece int", "start long", "length long", "ids_crc32 long"] + ["ids array<int>"] * with_ids
    row = ", ".join(f"{f.split()[0]}:{f.split()[1].replace('long', 'bigint')}" for f in fields)
    kind = T.ArrayType(T._parse_datatype_string(f"struct<{row}>"))

    def work(texts: list[str]) -> list[pa.Array]:
        tokenizer = kept_by_worker(("op2", path), lambda: Tokenizer(path))
        ends, columns = [0], [[] for _ in fields]
        for ids in tokenizer.ids(texts):
            ids = np.append(ids, np.int32(END))
            raw = memoryview(ids.astype("<u4").tobytes())
            spans = cut(len(ids), capacity)
            ends.append(ends[-1] + len(spans))
            for i, (start, length) in enumerate(spans):
                row = (i, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), *([ids[start : start + length]] * with_ids))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        struct = pa.StructArray.from_arrays(arrays, names=[f.split()[0] for f in fields])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)]

    made = [f.split()[0] for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    # the caller's columns travel as one, so that no name of theirs meets one of these
    own = F.struct(*keep) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    found = add_columns(df.select(own.alias("own"), F.col(text).alias("text")), "text", [T.StructField("pieces", kind)], work, ["own"])
    return found.select("own", F.inline("pieces")).select(*[F.col("own")[c].alias(c) for c in keep], *made)


class Open:
    """Counts of the lengths still to be packed, with the largest open length up to a bound."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.order = sorted(self.left)

    def below(self, most: int) -> int:
        """Largest open length <= most, 0 if there is none."""
        at = bisect_right(self.order, most)
        return self.order[at - 1] if at else 0

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for n in filling:
            self.left[n] -= times
            if not self.left[n]:
                del self.left[n]
                self.order.remove(n)

    def copy(self) -> Open:
        return Open(self.left)


def fillings(open_: Open, capacity: int, width: int = 3, tries: int = 400) -> list[tuple[int, ...]]:
    """Up to ``width`` undominated fillings of a bin around the largest open length, least waste first.

    At each place the largest length that fits comes first, as often as count and room allow; a filling that
    leaves room for a further open length, or for a larger one in an item's place, is dominated and not looked
    at. A step adds all copies of a length, so a way down has no more steps than a bin has different lengths.
    When ``tries`` steps are used up before any filling is known, the one begun is completed greedily.
    """
    largest = open_.order[-1]
    best: list[tuple[int, tuple[int, ...]]] = []
    budget = [tries]

    def record(chosen: list[int], room: int) -> bool:
        """True when enough perfect fillings are known."""
        entry = (room, tuple(chosen))
        if entry not in best:
            best.append(entry)
            best.sort(key=lambda e: (e[0], tuple(-x for x in e[1])))
            del best[width:]
        return len(best) == width and best[-1][0] == 0

    def greedy(chosen: list[int], room: int, n: int) -> bool:
        while n:
            times = min(open_.left[n], room // n)
            chosen, room = chosen + [n] * times, room - n * times
            n = open_.below(min(room, n - 1))
        return record(chosen, room)

    def extend(chosen: list[int], room: int, most: int) -> bool:
        n = open_.below(min(room, most))
        if not n:
            return record(chosen, room)
        while n:
            for times in range(min(open_.left[n], room // n), 0, -1):
                budget[0] -= 1
                if budget[0] < 0 and not best:
                    greedy(chosen, room, n)
                if budget[0] < 0 or extend(chosen + [n] * times, room - n * times, n - 1):
                    return True
            if n == largest:  # every filling is around the largest
                return False
            n = open_.below(n - 1)
        return False

    extend([], capacity, largest)
    return [f for _, f in best]


def best_fit(open_: Open, capacity: int, runs: list) -> tuple[list, int]:
    """Completes ``runs`` with the best filling each time: the incumbent. (runs, waste)."""
    runs, waste = list(runs), 0
    while open_.order:
        filling = fillings(open_, capacity, 1)[0]
        times = min(open_.left[n] // filling.count(n) for n in set(filling))
        open_.take(filling, times)
        runs.append((filling, times))
        waste += (capacity - sum(filling)) * times
    return runs, waste


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Packs ``counts[length]`` items of each length: (lengths of a bin, number of such bins), as few bins as found.

    Branch and bound over fillings of the largest open length. A branch ends where its bins so far and the
    least that the rest needs are no fewer than the incumbent's. When ``nodes`` are used up the incumbent stands.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    total = sum(n * c for n, c in counts.items())
    least = -(-total // capacity)
    runs, _ = best_fit(Open(counts), capacity, [])
    best, bins = runs, sum(t for _, t in runs)
    left = [nodes]
    stack: list[tuple[Open, list, int, int]] = [(Open(counts), [], 0, total)]
    while stack and bins > least and left[0] > 0:
        open_, done, used, rest = stack.pop()
        if not open_.order:
            if used < bins:
                best, bins = done, used
            continue
        if used + -(-rest // capacity) >= bins:
            continue
        options = fillings(open_, capacity)
        left[0] -= 1 + len(done) // 8
        for filling in reversed(options):
            times = min(open_.left[n] // filling.count(n) for n in set(filling))
            child = open_.copy()
            child.take(filling, times)
            # bins beyond this node: these, and at least what the rest's total asks for
            then = rest - sum(filling) * times
            if used + times + -(-then // capacity) < bins:
                stack.append((child, [*done, (filling, times)], used + times, then))
    return best


def placements(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, times per bin, first sequence, offset in the bin), by rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for filling, times in runs:
        offset = 0
        for n in sorted(set(filling), reverse=True):
            each = filling.count(n)
            rows.setdefault(n, []).append((ranks.get(n, 0), each, sequence, offset))
            ranks[n] = ranks.get(n, 0) + each * times
            offset += each * n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def ranked(pieces: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Adds ``rank``: the place of a piece among those of its length, counted without one task per length."""
    chunks = max(1, -(-rows // CHUNK))
    chunk = F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int")
    cut_ = pieces.select(F.struct("*").alias("own"), "length", chunk.alias("chunk"))
    sizes = cut_.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "chunk").orderBy(*[F.col("own")[c] for c in order])) - 1
    return cut_.withColumn("local", local).join(sizes, ["length", "chunk"]).select("own.*", (F.col("local") + F.col("before")).alias("rank"))


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length``; ``order`` are columns that tell pieces apart.

    Pieces are written once to the shared folder, for the counts and the ranks must see the same rows. Pieces
    equal in ``order`` and ``length`` may swap places. No pieces give no rows.
    """
    made = ("rank", "sequence_id", "offset")
    pieces = written(pieces.select(*[c for c in pieces.columns if c not in made]))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(placements(pack_counts(counts, capacity)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                own = lengths == n
                rows = table.value[n]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
                within = ranks[own] - row[:, 0]
                sequence[own] = row[:, 2] + within // row[:, 1]
                offset[own] = row[:, 3] + within % row[:, 1] * n
            names = [f.name for f in schema.fields]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:-2]] + [pa.array(sequence), pa.array(offset)], names=names)

    return ranked(pieces, order, sum(counts.values())).mapInArrow(place, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = pieces_of(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return pack(pieces, ["doc_id", "piece", "ids_crc32"])
