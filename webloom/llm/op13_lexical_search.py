"""Ranked lexical search with hashed max-sketches.

The impact of a term in a document is the part of its score that does not depend on the query. A document's
impacts fold into a sketch: each term is hashed to one of ``WIDTH`` coordinates, which keeps the greatest impact.
For a block of queries one matrix product of sketches and query weights gives an upper bound of every score; then
documents are scored exactly in descending order of their bounds, until the bound falls below the k-th best score.

Two passes over the documents: statistics (N, L and the document frequencies of the queries' terms), then sketches,
bounds and exact scores. Every task keeps the best ``k`` of its documents for each query. Queries are a stated set;
they are worked off in blocks of a bounded size, each block against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import portions, read_table, written

#: Coordinates of a sketch.
WIDTH = 4096
#: Bytes of query terms that a block has, as expected: blocks are drawn by hash. One query is never split.
BLOCK_BYTES = 4_000_000
#: Documents whose sketches are held at once, and terms whose numbers a task keeps; memory bounds without effect on results.
SLAB, CACHE = 512, 400_000
#: Parts in which the best of all tasks are ranked before they meet.
SALTS = 32
#: Scores: term frequencies saturate by ``SOFT`` and the share ``B`` of a document's length in the mean.
SCALE, TIMES, SOFT, B = 1_000_000_000, 1000, 8, 75
#: Bytes between terms become blanks, A-Z lower case.
TERM_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: str) -> list[bytes]:
    """Maximal stretches of ASCII letters, digits and all other characters beyond ASCII; A-Z lower-cased."""
    return text.encode().translate(TERM_BYTES).split()


@dataclass
class Block:
    """Queries as numbers of their distinct terms and how often they have them."""

    vocabulary: dict[bytes, int]
    numbers: list[int]
    term_ids: list[np.ndarray]
    times: list[np.ndarray]


def read_queries(items: DataFrame, text: str) -> DataFrame:
    """(number, item: struct of all columns, terms, times, bytes) of each row with a term, as a written table."""
    schema = T.StructType([
        T.StructField("item", items.select(F.struct("*")).schema[0].dataType), T.StructField("terms", T.ArrayType(T.BinaryType())),
        T.StructField("times", T.ArrayType(T.LongType())), T.StructField("bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                 pa.array([sum(map(len, c)) + 16 * len(c) for c in found], pa.int64())], names=schema.names)

    rows = items.select(F.struct("*").alias("item"), F.col(text).alias("text")).mapInArrow(run, schema)
    return written(rows.where("bytes > 0").withColumn("number", F.monotonically_increasing_id()))


def read_block(rows: DataFrame) -> Block:
    vocabulary: dict[bytes, int] = {}
    block = Block(vocabulary, [], [], [])
    for r in rows.select("number", "terms", "times").orderBy("number").collect():
        block.numbers.append(r["number"])
        block.term_ids.append(np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]], np.int64))
        block.times.append(np.array(r["times"], np.int64))
    return block


class Codes(dict):
    """Term -> number, in order of first sight, with each number's coordinate and place in the queries' vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], width: int):
        self.vocabulary, self.width = vocabulary, width
        self.coordinate: list[int] = []
        self.wanted: list[int] = []

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self.wanted)
        self.wanted.append(self.vocabulary.get(term, -1))
        self.coordinate.append(xxhash.xxh3_64_intdigest(term) % self.width)
        return number

    def trimmed(self) -> Codes:
        return self if len(self) <= CACHE else Codes(self.vocabulary, self.width)


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """(ids, terms) of some documents at a time."""
    for part in portions(batches, "text"):
        for at in range(0, len(part), SLAB):
            slab = part.slice(at, SLAB)
            yield slab.column("id"), [terms(t) if t else [] for t in slab.column("text").to_pylist()]


def frequencies(found: list[list[bytes]], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms per document; document, term number, occurrences of each distinct term of each)."""
    sizes = np.array([len(f) for f in found], np.int64)
    numbers = np.fromiter(map(codes.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
    keys, times = np.unique(np.repeat(np.arange(len(found)), sizes) << 40 | numbers, return_counts=True)
    return sizes, keys >> 40, keys & ((1 << 40) - 1), times


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, document frequency of each term of the block)."""
    vocabulary = block.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, df, n, total = Codes(vocabulary, 1), np.zeros(len(vocabulary), np.int64), 0, 0
        for _, found in slabs(batches):
            codes = codes.trimmed()
            sizes, _, numbers, _ = frequencies(found, codes)
            wanted = np.array(codes.wanted, np.int64)[numbers]
            df += np.bincount(wanted[wanted >= 0], minlength=len(df))
            n += int((sizes > 0).sum())
            total += int(sizes.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [n, total]))], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(t, 0) for t in range(len(vocabulary))], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(times: np.ndarray, sizes: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    longest = int(sizes.max(initial=0))
    share = B * sizes * n_docs // total if B * longest * n_docs < 2**63 else np.array([B * int(s) * n_docs // total for s in sizes], np.int64)
    return SCALE * times // (TIMES * times + SOFT * (100 - B + share))


class Searcher:
    """The best ``k`` of the documents of one task for each query of a block."""

    def __init__(self, block: Block, weight: np.ndarray, n_docs: int, total: int, width: int, k: int):
        self.block, self.n_docs, self.total, self.width, self.k = block, n_docs, total, width, k
        self.codes = Codes(block.vocabulary, width)
        self.factors = [weight[t] * n for t, n in zip(block.term_ids, block.times, strict=True)]
        self.queries = np.zeros((width, len(block.numbers)))
        spots = np.array([xxhash.xxh3_64_intdigest(t) % width for t in block.vocabulary], np.int64)
        for q, (ids, factor) in enumerate(zip(block.term_ids, self.factors, strict=True)):
            np.add.at(self.queries[:, q], spots[ids], factor.astype(float))
        self.best: list[list[tuple]] = [[] for _ in block.numbers]
        self.least = np.ones(len(block.numbers))  # the k-th best score so far
        self.scored = 0

    def add(self, ids: pa.Array, found: list[list[bytes]]) -> None:
        self.codes = codes = self.codes.trimmed()
        sizes, docs, numbers, times = frequencies(found, codes)
        if not len(docs):
            return
        impact = impacts(times, sizes[docs], self.n_docs, self.total)
        sketch = np.zeros(len(found) * self.width)
        np.maximum.at(sketch, docs * self.width + np.array(codes.coordinate, np.int64)[numbers], impact.astype(float))
        # sums of whole numbers in floating point; the slack is far above their rounding
        bounds = (sketch.reshape(-1, self.width) @ self.queries) * (1 + 1e-9)
        wanted = np.array(codes.wanted, np.int64)[numbers]
        held = np.flatnonzero(wanted >= 0)
        keys = docs[held] * len(codes.vocabulary) + wanted[held]
        order = np.argsort(keys)
        keys, impact = keys[order], impact[held][order]
        if not len(keys):
            return
        for q in np.flatnonzero(bounds.max(0) >= self.least).tolist():
            self.rescore(q, bounds[:, q], keys, impact, ids)

    def rescore(self, q: int, bounds: np.ndarray, keys: np.ndarray, impact: np.ndarray, ids: pa.Array) -> None:
        terms_, factor = self.block.term_ids[q], self.factors[q]
        able = np.flatnonzero(bounds >= self.least[q])
        able = able[np.argsort(-bounds[able], kind="stable")]
        at, many = 0, self.k
        while at < len(able) and bounds[able[at]] >= self.least[q]:
            some = able[at : at + many]
            some = some[bounds[some] >= self.least[q]]
            asked = some[:, None] * len(self.codes.vocabulary) + terms_[None, :]
            spot = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            score = (np.where(keys[spot] == asked, impact[spot], 0) * factor[None, :]).sum(1)
            self.scored += len(some)
            good = np.flatnonzero(score >= self.least[q])
            if len(good):
                new = [(-s, i is None, i) for s, i in zip(score[good].tolist(), ids.take(pa.array(some[good])).to_pylist(), strict=True)]
                self.best[q] = sorted(self.best[q] + new, key=lambda x: x if not x[1] else x[:2])[: self.k]
                if len(self.best[q]) == self.k:
                    self.least[q] = -self.best[q][-1][0]
            at, many = at + len(some) if len(some) else len(able), 2 * many


def search_block(docs: DataFrame, block: Block, width: int, k: int) -> DataFrame | None:
    """(number, id, score) of the best ``k`` documents of every task for each query of the block."""
    n_docs, total, df = statistics(docs, block)
    if not total:
        return None
    weight, kind = weights(n_docs, df), docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, type_ = Searcher(block, weight, n_docs, total, width, k), None
        for ids, found in slabs(batches):
            type_ = ids.type
            searcher.add(ids, found)
        for number, best in zip(block.numbers, searcher.best, strict=True):
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(best), pa.int64()), pa.array([b[2] for b in best], type_), pa.array([-b[0] for b in best], pa.int64())], names=["number", "id", "score"])

    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    return docs.mapInArrow(run, schema)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item: struct of the row of ``items``, rank from 1, id, score) of the ``k`` best documents of each row of ``items``.

    Equal scores are ranked by ascending id, null ids last; only scores above 0 count. Null and empty texts have no
    terms: such documents are not counted, such items give no rows. Every row is a document, or an item, of its own,
    repeated rows and ids included. Other columns of the documents are not read. Empty tables give no rows.
    """
    queries = read_queries(items, item_text)
    docs = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    size = queries.agg(F.sum("bytes")).head()[0] or 0
    blocks, parts = max(1, math.ceil(size / BLOCK_BYTES)), []
    for b in range(blocks):
        block = read_block(queries.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b))
        found = search_block(docs, block, width, k) if block.numbers else None
        if found is not None:
            parts.append(found)
    schema = T.StructType([T.StructField("number", T.LongType()), docs.schema["id"], T.StructField("score", T.LongType())])
    best = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        best = best.unionByName(part)
    order = (F.desc("score"), F.asc_nulls_last("id"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    first = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("number", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(queries.select("number", "item"), "number").select("item", "rank", "id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark item its 10 best documents: item_id, rank, doc_id, score."""
    found = lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("item.item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


#: The same by joining items and documents on their terms.
SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS word FROM split) GROUP BY doc_id, word),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM size),
weight AS (SELECT word, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT word, count(*) AS df FROM tf GROUP BY word), total),
asked AS (SELECT item_id, word, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY item_id, word),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weight USING (word) JOIN tf USING (word) JOIN size USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
