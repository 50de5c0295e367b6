"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of five-word shingles gets a signature of ``SYMBOLS`` min-hashes, ``BITS`` bits each. Two
documents whose signatures differ in at most ``DISTANCE`` symbols must, by the pigeonhole principle, differ in
at most one symbol of some chunk of four; so each chunk is indexed four times, each time with one symbol
left out, and every pair within the distance meets under some key. At a similarity of 0.75 a distance above
31 of 64 has a probability of about 1e-5, and less above. Links are confirmed on the full sets.

Equal sets are one class. First every class is compared with one centre, the member that most of its keys name:
what that joins needs no further comparison, since only reachability is asked for. Then the members of a key that lie
in different components meet in a task: those in a pair within the distance meet again with their sets and are compared
exactly, and one link for any two components that meet is told. A key with very many members is cut into blocks, and each two blocks are a
task of their own, so no pair is lost and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import add_columns, in_cells, mixed, read_table, written
from webloom.llm.components import components
from webloom.llm.shingles import shared, shingle_set

SYMBOLS, BITS, CHUNK = 64, 16, 4
CHUNKS = SYMBOLS // CHUNK
#: Differing symbols up to which a pair is found for certain: one error per chunk, and one short of two in each.
DISTANCE = 2 * CHUNKS - 1
#: Members of a block, and bytes of their sets, as expected (blocks are drawn by hash): the members of a key that meet in
#: a task. A memory bound, it has no effect on results.
BLOCK, BLOCK_BYTES = 2048, 16_000_000
ROUNDS = 2
#: Rows that are compared together, unless one block has more; a memory bound.
TOGETHER = 8192


def _factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64))
    return seeds[:SYMBOLS] | np.uint64(1), seeds[SYMBOLS:]


def signature(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> bytes:
    """``SYMBOLS`` min-hashes, each reduced to ``BITS`` bits."""
    least = np.full(SYMBOLS, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            least = np.minimum(least, (part[None, :] * factors[0][:, None] + factors[1][:, None]).min(1))
    return (mixed(least) & np.uint64(2**BITS - 1)).astype("<u2").tobytes()


def signed(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_shingles, class (64-bit digest of the set) and signature; the last two are null for an empty set."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()), T.StructField("signature", T.BinaryType())]
    factors = _factors()

    def work(texts: list[str]) -> list[pa.Array]:
        sizes, classes, signatures = [], [], []
        for t in texts:
            found = shingle_set(t)
            sizes.append(len(found))
            classes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63 if len(found) else None)
            signatures.append(signature(found, factors) if len(found) else None)
        return [pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(signatures, pa.binary())]

    return add_columns(docs, text, fields, work, keep)


def symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows x 64) keys: chunk number, symbol left out, the other three symbols."""
    chunks = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.int64)
    out = []
    for left_out in range(CHUNK):
        a, b, c = (chunks[:, :, i] for i in range(CHUNK) if i != left_out)
        out.append((np.arange(CHUNKS) * CHUNK + left_out) << 48 | a << 32 | b << 16 | c)
    return np.concatenate(out, 1)


def keyed(classes: DataFrame) -> DataFrame:
    """(key, class) rows of (class, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                keys = chunk_keys(symbols(part.column("signature")))
                ids = np.repeat(part.column("class").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], names=["key", "class"])

    return classes.select("class", "signature").mapInArrow(run, "key long, class long")


class Found:
    """Components of the members of some cells, joined as links are found."""

    def __init__(self, cell: np.ndarray, roots: np.ndarray):
        _, self.at = np.unique(np.stack([cell, roots], 1), axis=0, return_inverse=True)
        self.at = self.at.reshape(-1)
        self.up = list(range(int(self.at.max()) + 1))

    def of(self, row: int) -> int:
        x = int(self.at[row])
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[max(a, b)] = min(a, b)


def pairs_within(part: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """(rows r, step): pairs (r, r + step) of a cell in different components, within the distance and of sizes that can be
    similar.

    Rows come sorted by cell and size; row r is compared with row r + 1, then r + 2 and so on, for all cells at once.
    A pair whose first common key is another one is left to that.
    """
    keys, i, j, blocks, roots, sizes = (part.column(c).to_numpy() for c in ("key", "i", "j", "block", "root", "n_shingles"))
    cell, signatures = cells_of(part), symbols(part.column("signature"))
    across = i != j  # here only pairs of the two blocks count, the others meet in cells of their own
    at, step = np.arange(len(keys)), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[(cell[at] == cell[at + step]) & (100 * sizes[at] >= percent * sizes[at + step])]
        if not len(at):
            return
        apart = at[(roots[at] != roots[at + step]) & ~(across[at] & (blocks[at] == blocks[at + step]))]
        for some in np.array_split(apart, len(apart) // 4096 + 1):
            differ = (signatures[some] != signatures[some + step]).reshape(-1, CHUNKS, CHUNK)
            wrong = differ.sum(2)
            # a pair meets under several keys and is compared under the first of them
            chunk = (wrong <= 1).argmax(1)
            left_out = differ[np.arange(len(chunk)), chunk].argmax(1)
            hit = some[(wrong.sum(1) <= DISTANCE) & (keys[some] >> 48 == chunk * CHUNK + left_out)]
            if len(hit):
                yield hit, step
        step += 1


def cells_of(part: pa.Table) -> np.ndarray:
    """The number of each row's cell; rows come sorted by cell."""
    key, i, j = (part.column(c).to_numpy() for c in ("key", "i", "j"))
    return np.cumsum(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))


def by_cells(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on whole cells, sorted by size, some thousand rows at a time or one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            number = cells_of(table)
            whole = int(np.searchsorted(number, number[-1]))  # the last cell may go on
            if whole:
                yield from work(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n_shingles", "class").mapInArrow(run, schema)


MEMBER = "key long, i int, j int, block int, class long, root long, n_shingles long, signature binary"


def paired(rows: DataFrame, percent: int) -> DataFrame:
    """The rows that are in a pair of their cell, by their signatures; the others need no set."""

    def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
        taken = np.zeros(len(part), bool)
        for at, step in pairs_within(part, percent):
            taken[at] = taken[at + step] = True
        yield from part.filter(pa.array(taken)).to_batches()

    return by_cells(rows.select(*(c.split()[0] for c in MEMBER.split(", "))), work, MEMBER)


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of a cell in different components whose sets share ``percent`` of their union, one for any two
    components that meet."""

    def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, sizes, packed = part.column("class").to_numpy(), part.column("n_shingles").to_numpy(), part.column("shingles")
        found, links = Found(cells_of(part), part.column("root").to_numpy()), []

        def set_of(row: int) -> np.ndarray:
            return np.frombuffer(packed[row].as_buffer(), np.uint64)

        for at, step in pairs_within(part, percent):
            for row in at.tolist():
                x, y = found.of(row), found.of(row + step)
                if x == y:
                    continue
                both = shared(set_of(row), set_of(row + step))
                if 100 * both >= percent * (sizes[row] + sizes[row + step] - both):
                    found.join(x, y)
                    links.append((ids[row], ids[row + step]))
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return by_cells(rows, work, "a long, b long")


def packed_sets(texts: DataFrame) -> DataFrame:
    """(class, shingles: the sorted set as bytes) of (class, text)."""

    def work(found: list[str]) -> list[pa.Array]:
        return [pa.array([shingle_set(t).tobytes() for t in found], pa.binary())]

    return add_columns(texts, "text", [T.StructField("shingles", T.BinaryType())], work, ["class"])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets share ``percent`` of their union, by the texts of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            ids, others, lefts, rights = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for a, x, y in zip(ids, lefts, rights, strict=True):
                if a != last:
                    last, held = a, shingle_set(x)
                other = shingle_set(y)
                both = shared(held, other)
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").mapInArrow(run, "a long, b long")


def with_roots(rows: DataFrame, roots: DataFrame | None, name: str = "class", out: str = "root") -> DataFrame:
    if roots is None:
        return rows.withColumn(out, F.col(name))
    known = roots.select(F.col("node").alias(name), F.col("root").alias("__root"))
    return rows.join(known, name, "left").withColumn(out, F.coalesce("__root", name)).drop("__root")


def link_classes(docs: DataFrame, table: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of all classes that are linked to another; None where no two share a key."""
    classes = written(table.where("class IS NOT NULL").groupBy("class").agg(
        F.min(F.col("doc_id")).alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")))
    keys = keyed(classes)
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared_keys = written(keys.join(often, "key"))
    members = shared_keys.select("class").distinct().join(classes, "class").select("class", F.col("doc_id").alias("d"))
    found = docs.select("doc_id", "text").join(members, F.col("doc_id").eqNullSafe(F.col("d")))
    # rows with a repeated doc_id may hold other texts: the class itself decides
    texts = written(signed(found.select(F.col("class").alias("wanted"), "text"), keep=["wanted", "text"]).where(
        "class = wanted").select("class", "text").dropDuplicates(["class"]))
    edges, roots = None, None
    for round_ in range(ROUNDS):
        order = (F.col("class"), F.xxhash64("class"), -F.col("class"))[round_ % 3]
        rows = with_roots(shared_keys, roots)
        spread = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by(F.struct("class", "root"), order).alias("centre"))
        named = rows.join(spread.where("r0 < r1"), "key").where("root != centre.root").groupBy("class", F.col("centre.class").alias("centre")).agg(F.count(F.lit(1)).alias("keys"))
        # one centre for each class: the one that most of its keys name
        one = named.groupBy("class").agg(F.min(F.struct((-F.col("keys")).alias("k"), "centre")).alias("c")).select(
            F.least("class", "c.centre").alias("a"), F.greatest("class", "c.centre").alias("b")).distinct()
        new = written(confirmed(one, texts, percent))
        edges = new if edges is None else edges.unionByName(new)
        roots = components(edges, "a", "b")
    rows = with_roots(shared_keys, roots)
    sizes = classes.select("class", "signature", "n_shingles")
    open_keys = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    rows = written(rows.drop("n").join(open_keys, "key").join(sizes, "class"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, 8 * F.sum("n_shingles") / BLOCK_BYTES)).cast("int")
    cut = rows.groupBy("key").agg(blocks.alias("blocks"))
    # signatures tell which rows can be in a link at all; only these get their sets
    open_ = written(paired(in_cells(rows.join(cut, "key"), "class"), percent))
    sets = packed_sets(texts.join(open_.select("class").distinct(), "class", "left_semi"))
    return components(edges.unionByName(written(linked(open_.join(sets, "class"), percent))), "a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text") -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Two documents are linked when their shingle sets share ``percent`` of their union. A document without words
    (null, empty or blank text) is linked with nothing. Rows that repeat a doc_id are documents of their own;
    with equal texts they are one class like any other copies, and have one doc_id to be kept. Documents with
    null doc_id take part, but never name a component that has another member; kept is false for them.
    No rows give no rows.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    table = written(signed(docs, keep=["doc_id"]))
    roots = link_classes(docs, table, percent)
    placed = with_roots(table.select("doc_id", "n_shingles", "class"), roots)
    named = placed.where("class IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(named, "root", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def kept_rows(docs: DataFrame, percent: int = 75, text: str = "text") -> DataFrame:
    """One row of each component of ``docs``, all its columns: the one with the smallest doc_id, a null one last.

    Rows are told apart by doc_id and text: rows that share a doc_id stay if their texts are in different components,
    and of rows with one doc_id and one set of shingles one stays. Documents without words are linked with nothing, so
    all their rows stay. No rows give no rows.
    """
    narrow = docs.select("doc_id", F.col(text).alias("text"))
    table = written(signed(narrow, keep=["doc_id"]))
    placed = with_roots(table.select("doc_id", "class"), link_classes(narrow, table, percent))
    best = placed.where("class IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "class")).alias("b"))
    chosen = written(best.select("b.doc_id", "b.class").unionByName(placed.where("class IS NULL").select("doc_id", "class")))
    ids = table.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id")
    rows = docs.select(F.struct("*").alias("own"), "doc_id", F.col(text).alias("text"))
    alone = rows.join(ids, "doc_id", "left_anti").join(chosen.select("doc_id"), "doc_id", "left_semi")
    # of doc_ids that repeat, and of rows without one, the class decides
    shared_ids = rows.join(ids.withColumnRenamed("doc_id", "often"), F.col("doc_id").eqNullSafe(F.col("often")), "left_semi")
    classed = signed(shared_ids, keep=["own", "doc_id"]).select("own", "doc_id", "class")
    wanted = chosen.select(F.col("doc_id").alias("d"), F.col("class").alias("c"))
    odd = classed.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("class").eqNullSafe(F.col("c")), "left_semi")
    once = odd.where("class IS NOT NULL").dropDuplicates(["doc_id", "class"]).unionByName(odd.where("class IS NULL"))
    return alone.where("doc_id IS NOT NULL").select("own.*").unionByName(once.select("own.*"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: The same by a self-join on shingles and a recursive walk over the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
    UNION ALL SELECT doc_id, len(words) || ' words ' || array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
h AS (SELECT DISTINCT doc_id, hash(shingle) AS shingle FROM s),
links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS joint FROM h p JOIN h q ON p.shingle = q.shingle AND p.doc_id != q.doc_id GROUP BY 1, 2) x
  JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b WHERE 100 * joint >= 75 * (p.size + q.size - joint)
), walk AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a)
SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
