"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a set of paragraphs: its lines, and inside a line pieces that end at a space where the letters
before it say so, so that an edit moves no border but its own. Each paragraph's digest is xored into three
cells of a sketch. Subtracting two sketches leaves the differing digests; peeling cells that hold a single
digest recovers them. When peeling gets stuck, both sketches are made twice as large and tried again.

The documents of an Arrow batch are sketched and peeled together in numpy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import mixed, read_table

#: Mean number of words of a piece of a line.
PIECE = 8
#: Cells of the smallest sketch.
LEAST = 8
#: Rows of one range of doc_id as a target, and the largest number of ranges.
RANGE_ROWS, RANGES = 4_000, 4_096
#: Documents that are sketched together; a memory bound.
TOGETHER = 400
SPOTS = 3


def paragraphs(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs, sorted; a repeat of a paragraph counts as another one."""
    raw = text.encode()
    codes = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero((codes == 10) | (codes == 32))
    before = np.zeros(len(ends), np.uint32)
    for back in range(1, 6):
        before = before * np.uint32(31) + codes[np.maximum(ends - back, 0)]
    cuts = ends[(codes[ends] == 10) | ((before * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(PIECE) == 0)] + 1
    digest = xxhash.xxh3_64_intdigest
    bounds = [0, *cuts.tolist(), len(raw)]
    found = np.fromiter((digest(raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if b > a), np.uint64)
    keys, times = np.unique(found, return_counts=True)
    if len(keys) == len(found):
        return keys
    more = [mixed(keys[times > k] ^ mixed(np.array([k], np.uint64))) for k in range(1, int(times.max()))]
    return np.unique(np.concatenate([keys, *more]))


def cells_for(n: int) -> int:
    """Cells of the sketch that a set of ``n`` paragraphs is kept as: a power of two, half of ``n`` or more."""
    size = LEAST
    while 2 * size < n:
        size *= 2
    return size


def spots(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Three cells per key (keys x 3), ``cells`` being powers of two."""
    return np.stack([mixed(keys ^ np.uint64(0xA5A5A5A5 + i)) & (cells - np.uint64(1)) for i in range(SPOTS)], 1).astype(np.int64)


def checks(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ np.uint64(0x5BD1E995)) >> np.uint64(32)


class Sketches:
    """Sketches of many sets: cells of set i are from ``starts[i]`` on, ``sizes[i]`` of them."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        self.count, self.key, self.check = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)
        keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.apply(keys, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.ones(len(keys), np.int64))

    def where(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return spots(keys, self.sizes[owner].astype(np.uint64)) + self.starts[owner][:, None]

    def apply(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        at, check = self.where(keys, owner), checks(keys)
        for i in range(SPOTS):
            # a key whose spots fall together goes into a cell once
            new = np.ones(len(keys), bool)
            for j in range(i):
                new &= at[:, i] != at[:, j]
            np.add.at(self.count, at[new, i], sign[new])
            np.bitwise_xor.at(self.key, at[new, i], keys[new])
            np.bitwise_xor.at(self.check, at[new, i], check[new])

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches([], np.empty(0))
        out.sizes, out.starts = self.sizes, self.starts
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests that only the first or only the second set has: (how many of the first, of the second, is it all)."""
        sets = len(self.sizes)
        first, second = np.zeros(sets, np.int64), np.zeros(sets, np.int64)
        owner_of = np.repeat(np.arange(sets), self.sizes)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (checks(self.key[look]) == self.check[look])]
            if not len(pure):
                break
            both = np.stack([owner_of[pure].astype(np.uint64), self.key[pure]], 1)
            order = np.lexsort((both[:, 1], both[:, 0]))
            both, pure = both[order], pure[order]
            once = np.concatenate(([True], (both[1:] != both[:-1]).any(1)))
            keys, owner, sign = both[once, 1], both[once, 0].astype(np.int64), self.count[pure[once]]
            np.add.at(first, owner, sign == 1)
            np.add.at(second, owner, sign == -1)
            self.apply(keys, owner, -sign)
            look = np.unique(self.where(keys, owner))
        stuck = np.zeros(sets, np.int64)
        np.add.at(stuck, owner_of, (self.count != 0) | (self.key != 0) | (self.check != 0))
        return first, second, stuck == 0

    def text(self, i: int) -> str:
        part = slice(self.starts[i], self.starts[i] + self.sizes[i])
        raw = self.count[part].astype("<i2").tobytes() + self.key[part].astype("<u8").tobytes() + self.check[part].astype("<u4").tobytes()
        return base64.b64encode(raw).decode()


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared share (Jaccard) of paragraph sets, from what peeling the difference of their sketches recovers.

    Two empty sets are alike (1). The sketch starts at the smaller of both sets' own sizes and doubles until
    peeling succeeds; digests are 64 bits, so it ends for all sets that differ in fewer than their cells.
    """
    n_a, n_b = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
    sizes = np.fromiter((min(cells_for(len(x)), cells_for(len(y))) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    shared, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(open_):
        left, right = ([s[i] for i in open_] for s in (a, b))
        first, _, done = Sketches(left, sizes[open_]).minus(Sketches(right, sizes[open_])).peel()
        shared[open_[done]] = n_a[open_[done]] - first[done]
        open_ = open_[~done]
        sizes[open_] *= 2
    union = n_a + n_b - shared
    return np.where(union == 0, 1.0, shared / np.maximum(union, 1))


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """Fingerprint of each set of paragraphs: number of paragraphs, cells, and the sketch; equal sets have equal ones."""
    sketches = Sketches(sets, np.fromiter((cells_for(len(s)) for s in sets), np.int64, len(sets)))
    return [f"{len(s)}.{sketches.sizes[i]}.{sketches.text(i)}" for i, s in enumerate(sets)]


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Documents (doc_id, text) dealt by ranges of doc_id and sorted inside: range, halo, doc_id, text.

    A range ends with a copy (halo = 1) of the first document after it; after the last comes the first of all.
    So every document's successor is the next row, and each text is shuffled once. Order: doc_id, null first,
    then text. The cuts between ranges are approximate quantiles; they balance the tasks and decide nothing else.
    """
    at = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("double")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at.alias("at"))
    if ranges is None:
        ranges = min(RANGES, -(-docs.count() // RANGE_ROWS))
    cuts = []
    if ranges > 1:
        shares = F.lit([i / ranges for i in range(1, ranges)])
        cuts = sorted(set(rows.agg(F.percentile_approx("at", shares, 4 * ranges).alias("c")).head()[0] or ()))
    cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="range")
    placed = cut.transform(rows).select("range", "doc_id", "text") if cuts else rows.select(F.lit(0.0).alias("range"), "doc_id", "text")
    there = sorted(r[0] for r in placed.select("range").distinct().collect())
    before = dict(zip(there, [there[-1], *there[:-1]], strict=True)) if there else {}
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")
    heads = placed.groupBy("range").agg(F.min(order).alias("head"))
    back = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<double,double>")
    halo = heads.select(back[F.col("range")].alias("range"), F.lit(1).alias("halo"), "head.doc_id", "head.text")
    both = placed.select("range", F.lit(0).alias("halo"), "doc_id", "text").unionByName(halo)
    return both.repartition(max(1, len(there)), "range").sortWithinPartitions("range", "halo", F.col("doc_id").asc_nulls_first(), "text")


def compare_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they and the next documents are.

    The edited text has the last quarter of the code points replaced by the first as many (or all) of the next
    document's text. A null text is empty. Rows that repeat a doc_id are documents of their own, in the order of
    their texts; equal texts have equal fingerprints, and two empty texts are fully alike. The only document
    is its own next one. Other columns are ignored; no rows give no rows.
    """

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """``rows`` are (doc_id, text, next text)."""
        edited = []
        for _, text, after in rows:
            k = len(text) // 4
            edited.append(text[: len(text) - k] + after[:k])
        own, new = [paragraphs(t) for _, t, _ in rows], [paragraphs(t) for t in edited]
        # a row's next text is mostly the row after it
        following = [own[i + 1] if i + 1 < len(rows) and rows[i + 1][1] is r[2] else paragraphs(r[2]) for i, r in enumerate(rows)]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(fingerprints(own)), pa.array(fingerprints(new)),
            pa.array(likeness(own, new)), pa.array(likeness(own, following)),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for halo, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("halo", "doc_id", "text")), strict=True):
                if last is not None:
                    held.append((*last, text))
                    if len(held) == TOGETHER:
                        yield work(held)
                        held = []
                last = None if halo else (doc_id, text)
        if held:
            yield work(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, ranges).mapInArrow(run, schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return compare_edits(read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text")))
