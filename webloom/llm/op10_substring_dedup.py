"""Substring deduplication by paragraph MinHash banding.

Texts are cut into paragraphs: at both ends of lines of five words or more (shorter lines run on into each
other), and before words whose hash is the smallest among their neighbours, so that a passage is cut alike
wherever it stands. Paragraphs meet when a band of
min-hashes of their five-word shingles agrees. Equal paragraphs meet under a key of their own, the digest;
each is compared with the first of its band by exact Jaccard similarity of the shingle sets, then all members
of a band that still lie in different components are compared with each other. Of each component the first
paragraph of all stays. Runs of repeated paragraphs are extended word by word
on both sides and cut out of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import in_cells, mixed, portions, read_table, written
from webloom.llm.components import components
from webloom.llm.shingles import rolled, words_at

#: A border is a word whose hash is below those of this many words on both sides; paragraphs have 11 words on average.
REACH = 5
SHINGLE = 5
PERCENT = 75
#: Fewest words of a run of repeated paragraphs that is cut out: more than a licence line or a slogan has.
RUN_WORDS = 15
#: Words seen on each side of a run in the first round; where all are the same, later rounds look further.
FURTHER = 24
#: A paragraph is its number in the document and 40 bits of its digest.
DIGEST_BITS = 40
NO_ID = -(2**63)
#: Bands that a sample shows to be frequent are grouped by salt first: one in SAMPLE documents, at most HOT bands.
SAMPLE, HOT, SALTS = 64, 1000, 64
#: Members of a block, as expected: a band with more is cut into blocks, and each two of them are compared in a task of
#: their own. A memory bound, it has no effect on results.
BLOCK = 1024


def tune_bands(similarity: float, recall: float, rows: tuple[int, ...] = (1, 2, 3), most: int = 64) -> tuple[int, int]:
    """(bands, rows per band) with the fewest bands, then the most rows, that find a pair of this similarity with this probability."""
    fits = []
    for r in rows:
        for bands in range(1, most + 1):
            if 1 - (1 - similarity**r) ** bands >= recall:
                fits.append((bands, -r))
                break
    bands, r = min(fits)
    return bands, -r


BANDS, ROWS = tune_bands(PERCENT / 100, 0.93)


class Paragraphs:
    """Borders and digests of the paragraphs of some texts, cut in one pass; numpy arrays by paragraph.

    ``of`` is the text of a paragraph, ``numbers`` its number there, ``firsts`` and ``offsets`` the first paragraph and word of a text.
    """

    def __init__(self, texts: list[str]):
        parts = [t.encode() for t in texts]
        blob = b"\n".join(parts)
        self.words, self.hashes = words_at(blob)
        at, h, n = self.words, self.hashes, len(self.words)
        self.letters = np.frombuffer(blob, np.uint8)
        self.begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.offsets = np.searchsorted(at, self.begins)  # and the end of the last text
        opens = np.zeros(n, bool)
        opens[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        border = opens.copy()
        if n:
            line = np.searchsorted(np.flatnonzero(self.letters == 10), at)
            starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
            long = np.diff(np.append(starts, n)) >= SHINGLE
            border[starts[long | np.append(True, long[:-1])]] = True
            before = np.roll(h, 1)
            before[opens] = 0
            score = mixed(h ^ (before << np.uint64(1)))
            low = np.ones(n, bool)
            for k in range(1, REACH + 1):
                low[k:] &= score[k:] < score[:-k]
                low[:-k] &= score[:-k] < score[k:]
            counts = np.diff(self.offsets)
            place = np.arange(n) - np.repeat(self.offsets[:-1], counts)
            low &= (place >= REACH) & (np.repeat(counts, counts) - place > REACH)
            # no border so close to a line's end that a paragraph would be too short for a shingle
            ends = np.append(np.flatnonzero(border), n)
            at = np.flatnonzero(low)
            after = np.searchsorted(ends, at, side="right")
            border[at[(at - ends[after - 1] >= SHINGLE) & (ends[after] - at >= SHINGLE)]] = True
        self.starts = np.flatnonzero(border)
        self.sizes = np.diff(np.append(self.starts, n))
        self.firsts = np.searchsorted(self.starts, self.offsets)
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.firsts))
        self.numbers = np.arange(len(self.starts)) - self.firsts[self.of]

    def digests(self) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, np.uint64)
        places = mixed(np.arange(1, int(self.sizes.max()) + 1).astype(np.uint64))
        place = np.arange(len(self.hashes)) - np.repeat(self.starts, self.sizes)
        return mixed(np.add.reduceat(mixed(self.hashes ^ places[place]), self.starts))

    def packs(self, digests: np.ndarray | None = None) -> np.ndarray:
        """Number << 40 | digest of each paragraph."""
        digests = self.digests() if digests is None else digests
        return (self.numbers.astype(np.int64) << DIGEST_BITS) | (digests >> np.uint64(64 - DIGEST_BITS)).astype(np.int64)

    def keys(self, digests: np.ndarray) -> np.ndarray:
        """(bands + 1 x paragraphs) keys, the last one the whole digest; only for paragraphs of a shingle or more."""
        n = len(self.hashes)
        shingles = np.full(n, np.uint64(2**64 - 1))
        whole = rolled(self.hashes, SHINGLE)
        left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(n)
        inside = left[: len(whole)] >= SHINGLE
        out = []
        for band in range(BANDS):
            key = np.zeros(len(self.starts), np.uint64)
            for row in range(ROWS):
                shingles[: len(whole)] = np.where(inside, mixed(whole ^ np.uint64(1 + band * ROWS + row)), np.uint64(2**64 - 1))
                key = mixed(key * np.uint64(31) + np.minimum.reduceat(shingles, self.starts))
            out.append(key ^ np.uint64(band))
        return np.stack([*out, digests])

    def shingles(self, places: np.ndarray) -> pa.ListArray:
        """Distinct shingles of each of these paragraphs, sorted."""
        whole = rolled(self.hashes, SHINGLE)
        sizes = np.maximum(self.sizes[places] - SHINGLE + 1, 0)
        of = np.repeat(np.arange(len(places)), sizes)
        values = whole[spans(self.starts[places], sizes)]
        order = np.lexsort((values, of))
        values, first = values[order], np.ones(len(order), bool)
        first[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        ends = np.cumsum([0, *np.bincount(of[first], minlength=len(places))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[first].astype(np.int64)))

    def points(self, text: int) -> np.ndarray:
        """Code points of a text before each of its words, and all of them."""
        first, end = self.begins[text], self.begins[text + 1] - 1
        before = np.cumsum(np.append(0, self.letters[first:end] & 0xC0 != 0x80))
        return before[np.append(self.words[self.offsets[text] : self.offsets[text + 1]], end) - first]

    def places(self, packs: np.ndarray, texts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, places) of those ``wanted`` paragraphs that the text of that number has."""
        at = self.firsts[texts] + (wanted >> DIGEST_BITS)
        which = np.flatnonzero(at < self.firsts[texts + 1])
        which = which[packs[at[which]] == wanted[which]]
        return which, at[which]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def listed(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of all values in the lists of a column."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten()


def banded(docs: DataFrame) -> DataFrame:
    """(key, doc, pack) for each band and the digest of each paragraph of at least five words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            found = Paragraphs(part.column("text").to_pylist())
            long = found.sizes >= SHINGLE
            if long.any():
                digests = found.digests()
                ids = part.column("doc").to_numpy(zero_copy_only=False)[found.of[long]]
                columns = [found.keys(digests)[:, long].reshape(-1).astype(np.int64), np.tile(ids, BANDS + 1), np.tile(found.packs(digests)[long], BANDS + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "doc", "pack"])

    return docs.mapInArrow(run, "key long, doc long, pack long")


def paragraph(doc: str, pack: str) -> Column:
    return F.struct(F.col(doc).alias("doc"), F.col(pack).alias("pack"))


def first_links(docs: DataFrame) -> DataFrame:
    """(key, member, first, mixed: whether paragraphs of the key differ) for each paragraph of a key but the first, from a written table.

    Rows stream through one pass sorted by band; a task holds the ids of one band at a time. A band that the sample
    shows to be frequent is first grouped by salts, then the firsts of its salts are linked to the first of all.
    """
    rows = banded(docs)
    sample = banded(docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0))
    hot = sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 20").orderBy(F.desc("n"), "key").limit(HOT)
    hot = [r["key"] for r in hot.collect()]
    salt = F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(-1) if hot else F.lit(-1).cast("long")
    names = ["key", "doc", "pack", "first_doc", "first_pack", "head", "mixed"]

    def told(key: np.ndarray, salt: np.ndarray, doc: np.ndarray, pack: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole keys the rows behind the first of a key and salt, and the firsts of salts."""
        same = key[1:] == key[:-1]
        some = np.flatnonzero(np.append(same, False) | np.append(False, same) | (salt >= 0))
        order = some[np.lexsort((pack[some], doc[some], salt[some], key[some]))]
        if not len(order):
            return
        key, salt, doc, pack = key[order], salt[order], doc[order], pack[order]
        head = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
        first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        differs = (pack ^ pack[first]) & ((1 << DIGEST_BITS) - 1) != 0
        mixed = np.logical_or.reduceat(differs, np.flatnonzero(head))[np.cumsum(head) - 1]
        kept = (doc != doc[first]) | (pack != pack[first]) | (head & (salt >= 0))
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (key, doc, pack, doc[first], pack[first], head, mixed)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows of the last key, which may go on
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("key", "salt", "doc", "pack")]
            if not len(batch):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if held and (cut or held[0][0][0] != rows[0][0]):
                held.append([c[:cut] for c in rows])
                yield from told(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            elif cut:
                yield from told(*(c[:cut] for c in rows))
            held.append([c[cut:].copy() for c in rows])
        if held:
            yield from told(*map(np.concatenate, zip(*held, strict=True)))

    # one sort column: its order needs no comparison of rows
    met = rows.withColumn("salt", salt).repartition("key", "salt").sortWithinPartitions("key").select("key", "salt", "doc", "pack")
    found = met.mapInArrow(run, "key long, doc long, pack long, first_doc long, first_pack long, head boolean, mixed boolean")
    found = written(found.select("key", paragraph("doc", "pack").alias("member"), F.struct(F.col("first_doc").alias("doc"), F.col("first_pack").alias("pack")).alias("first"), "head", "mixed"))
    links, heads = found.where("NOT head").drop("head"), found.where("head")
    if not hot:
        return links
    both = F.max("mixed") | (F.min(digest("first")) != F.max(digest("first")))
    lead = F.broadcast(written(heads.groupBy("key").agg(F.min("first").alias("best"), both.alias("both"))))  # at most HOT rows
    through = heads.join(lead, "key").select("key", F.col("first").alias("member"), F.col("best").alias("first"), F.col("both").alias("mixed"))
    direct = links.join(lead, "key", "left").select("key", "member", F.coalesce("best", "first").alias("first"), F.coalesce("both", "mixed").alias("mixed"))
    return direct.unionByName(through).where("member != first")


def shingle_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(p, set: sorted shingles) of the paragraphs ``wanted.p``."""
    ends = wanted.select("p.doc", "p.pack").groupBy("doc").agg(F.collect_set("pack").alias("packs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            found = Paragraphs(part.column("text").to_pylist())
            of, wanted = listed(part.column("packs"))
            wanted = wanted.to_numpy(zero_copy_only=False)
            which, at = found.places(found.packs(), of, wanted)
            ids = part.column("doc").to_numpy(zero_copy_only=False)[of[which]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(wanted[which]), found.shingles(at)], names=["doc", "pack", "set"])

    sets = docs.join(ends, "doc").select("doc", "text", "packs").mapInArrow(run, "doc long, pack long, set array<long>")
    return written(sets.dropDuplicates(["doc", "pack"]).select(paragraph("doc", "pack").alias("p"), "set"))


def similar(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Of links between different paragraphs those whose shingle sets are similar enough."""
    sets = shingle_sets(links.select(F.explode(F.array("member", "first")).alias("p")), docs)
    both = links.join(sets.select(F.col("p").alias("member"), F.col("set").alias("a")), "member").join(
        sets.select(F.col("p").alias("first"), F.col("set").alias("b")), "first")
    joint = F.size(F.array_intersect("a", "b"))
    return both.where(100 * joint >= PERCENT * (F.size("a") + F.size("b") - joint)).select("member", "first")


def alike(docs: list, roots: list, sets: list, blocks: list | None = None) -> Iterator[tuple[int, int]]:
    """(later, earlier) places of similar paragraphs of different documents, one for any two components that meet.

    Paragraphs come sorted; all that lie in different components (and blocks, where given) are compared exactly.
    """
    block = np.array(blocks) if blocks is not None else np.arange(len(docs))
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, ids = ends - sizes, np.array(docs)
    of = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    component = np.array([of[r] for r in roots])
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    for at in range(len(sets) - 1):
        rest = slice(at + 1, None)
        if not (component[rest] != component[at]).any():
            continue
        own = flat[starts[at] : ends[at]]
        mark[own] = 1
        joint = np.add.reduceat(mark[flat[ends[at] :]], starts[rest] - ends[at])
        mark[own] = 0
        hit = (100 * joint >= PERCENT * (sizes[rest] + sizes[at] - joint)) & (ids[rest] != ids[at]) & (block[rest] != block[at])
        for other in (np.flatnonzero(hit) + at + 1).tolist():
            if component[other] != component[at]:
                component[component == component[other]] = component[at]
                yield other, at


def clusters(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member, lead: its first of all) and (node, root) of the firsts that links make one cluster."""
    lead = written(good.groupBy("member").agg(F.min("first").alias("lead"), F.max("first").alias("b")))
    firsts = good.select(F.col("first").alias("member")).distinct()
    joined = lead.where("lead != b").select("lead", "b").unionByName(
        lead.join(firsts, "member", "left_semi").select("lead", F.col("member").alias("b")))
    return lead.select("member", "lead"), components(joined, "lead", "b")


def digest(p: str) -> Column:
    return F.col(f"{p}.pack").bitwiseAND(F.lit((1 << DIGEST_BITS) - 1))


def further_links(links: DataFrame, good: DataFrame, docs: DataFrame) -> DataFrame:
    """(member, first) of all similar members of a band that ``good`` leaves in different components."""
    lead, roots = clusters(good)
    # only bands of different paragraphs can be open
    links = links.where("mixed")
    rows = links.select("key", F.col("member").alias("p")).unionByName(links.select("key", F.col("first").alias("p")).distinct())
    placed = rows.join(lead.withColumnRenamed("member", "p"), "p", "left").withColumn("lead", F.coalesce("lead", "p"))
    placed = placed.join(roots.select(F.col("node").alias("lead"), "root"), "lead", "left").select("key", "p", F.coalesce("root", "lead").alias("root"))
    placed = written(placed)
    open_ = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    # equal paragraphs of a component are one member
    members = written(placed.join(open_, "key").groupBy("key", "root", digest("p").alias("digest")).agg(F.min("p").alias("p")).drop("digest"))
    cut = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = in_cells(members.join(cut, "key"), "p").join(shingle_sets(members.select("p").distinct(), docs), "p").select(
        "key", "i", "j", "block", "p.doc", "p.pack", "root", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            docs_, packs, roots_, sets, blocks = zip(*held, strict=True)
            across = last[1] != last[2]  # in a cell of two blocks only pairs of both count
            found = list(alike(docs_, roots_, sets, blocks if across else None)) if len(held) > 1 else []
            if found:
                ends = [[c[i] for i in side] for side in zip(*found, strict=True) for c in (docs_, packs)]
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["doc", "pack", "first_doc", "first_pack"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "block", "doc", "pack", "root")]
            sets, ends = batch.column("set").flatten().to_numpy(), np.cumsum(batch.column("set").value_lengths().to_numpy())
            for (key, i, j, block, doc, pack, root), own in zip(zip(*columns, strict=True), np.split(sets, ends[:-1]), strict=True):
                if (key, i, j) != last:
                    if held:
                        yield from links()
                    last, held = (key, i, j), []
                held.append((doc, pack, (root["doc"], root["pack"]), own, block))
        if held:
            yield from links()

    met = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc", "pack")
    found = met.mapInArrow(run, "doc long, pack long, first_doc long, first_pack long")
    return found.select(paragraph("doc", "pack").alias("member"), F.struct(F.col("first_doc").alias("doc"), F.col("first_pack").alias("pack")).alias("first"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, packs: paragraphs to cut with the document that keeps a copy and the words to cut beside them) of (doc, text)."""
    keyed = first_links(docs)
    links = written(keyed.where("member.doc != first.doc").select("member", "first").distinct())
    equal = digest("member") == digest("first")
    good = written(links.where(equal).unionByName(similar(links.where(~equal), docs)))
    good = written(good.unionByName(further_links(keyed, good, docs)).distinct())
    merged = clusters(good)[1].where("node.doc != root.doc").select(F.col("node").alias("member"), F.col("root").alias("first"))
    cuts = written(good.unionByName(merged).groupBy("member").agg(F.min("first").alias("first")))
    ends = further_words(cuts, docs).groupBy("member").agg(F.max(F.when(~F.col("after"), F.col("same"))).alias("left"), F.max(F.when(F.col("after"), F.col("same"))).alias("right"))
    cuts = cuts.join(ends, "member", "left").select("member.doc", F.struct("member.pack", F.col("first.doc").alias("kept_in"), "left", "right").alias("pack"))
    return cuts.groupBy("doc").agg(F.collect_list("pack").alias("packs"))


def neighbours(ends: DataFrame, docs: DataFrame, reach: int) -> DataFrame:
    """(p, after, words) with the hashes of up to ``reach`` words before or after each paragraph of (p, after), the nearest first."""
    wanted = ends.select("p.doc", F.struct("p.pack", "after").alias("end")).groupBy("doc").agg(F.collect_set("end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            found = Paragraphs(part.column("text").to_pylist())
            of, ends = listed(part.column("ends"))
            packs, after = (ends.field(f).to_numpy(zero_copy_only=False) for f in ("pack", "after"))
            which, at = found.places(found.packs(), of, packs)
            of, packs, after = of[which], packs[which], after[which]
            at = found.starts[at] + np.where(after, found.sizes[at], 0)
            begins = np.where(after, at, at - 1)
            sizes = np.minimum(np.where(after, found.offsets[of + 1] - at, at - found.offsets[of]), reach)
            # words before a paragraph are read backwards
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            words = found.hashes[np.repeat(begins, sizes) + np.where(np.repeat(after, sizes), step, -step)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(words.astype(np.int64)))
            ids = part.column("doc").to_numpy(zero_copy_only=False)[of]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(packs), pa.array(after), lists], names=["doc", "pack", "after", "words"])

    found = docs.join(wanted, "doc").select("doc", "text", "ends").mapInArrow(run, "doc long, pack long, after boolean, words array<long>")
    return found.dropDuplicates(["doc", "pack", "after"]).select(paragraph("doc", "pack").alias("p"), "after", "words")


def further_words(cuts: DataFrame, docs: DataFrame) -> DataFrame:
    """(member, after, same: words beyond it that its copy has as well) for the ends of runs of paragraphs, and of equal ones, in (member, first).

    Rounds look further and further: where all words seen are the same, the next round sees eight times as many.
    """
    number = F.shiftright("member.pack", DIGEST_BITS)
    order = Window.partitionBy("member.doc").orderBy("member.pack")
    rows = cuts.withColumns({"number": number, "equal": digest("member") == digest("first")})

    def end(beside: Callable, step: int) -> Column:
        """Whether no cut paragraph is beside this one or, of equal paragraphs, none that is equal to its copy too."""
        return (beside("number", 1, -2).over(order) != F.col("number") + step) | (F.col("equal") & ~beside("equal", 1, False).over(order))

    sides = F.array(F.when(end(F.lag, -1), F.lit(False)), F.when(end(F.lead, 1), F.lit(True)))
    left = written(rows.withColumn("sides", F.array_compact(sides)).select("member", "first", F.explode("sides").alias("after")))
    done, reach = [], FURTHER
    while not left.isEmpty():
        words = written(neighbours(left.select(F.col("member").alias("p"), "after").unionByName(left.select(F.col("first").alias("p"), "after")).distinct(), docs, reach))
        both = left.join(words.withColumnsRenamed({"p": "member", "words": "a"}), ["member", "after"]).join(
            words.withColumnsRenamed({"p": "first", "words": "b"}), ["first", "after"])
        differs = F.array_position(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
        same = F.when(differs > 0, differs - 1).otherwise(F.size("a")).cast("int")
        seen = written(both.select("member", "first", "after", same.alias("same")))
        done.append(seen.where(F.col("same") < reach).select("member", "after", "same"))
        left, reach = seen.where(F.col("same") >= reach).drop("same"), 8 * reach
    return reduce(DataFrame.unionByName, done) if done else left.select("member", "after", F.lit(0).alias("same"))


def cut_runs(found: Paragraphs, own: np.ndarray, number: int, text: str, packs: dict[int, dict], run_words: int = RUN_WORDS) -> tuple[list[tuple[int, int]], int, int, list[int]]:
    """Spans of ``text``, text ``number`` of ``found``, to cut (code points), words in them, repeated paragraphs, documents that keep copies."""
    first, end = int(found.firsts[number]), int(found.firsts[number + 1])
    begin = int(found.offsets[number])
    own, sizes, starts = own[first:end].tolist(), found.sizes[first:end].tolist(), (found.starts[first:end] - begin).tolist()
    hit = [p in packs for p in own]
    # a paragraph too short for a shingle goes with its neighbours
    for i in range(1, len(hit) - 1):
        if sizes[i] < SHINGLE and hit[i - 1] and (hit[i + 1] or (i + 2 < len(hit) and sizes[i + 1] < SHINGLE and hit[i + 2])):
            hit[i] = True
    runs: list[list] = []  # first word, end, paragraphs, documents
    i = 0
    while i < len(hit):
        j = i
        while j < len(hit) and hit[j]:
            j += 1
        if j > i:
            at = min(starts[k] - (packs[own[k]]["left"] or 0) for k in range(i, j) if own[k] in packs)
            to = max(starts[k] + sizes[k] + (packs[own[k]]["right"] or 0) for k in range(i, j) if own[k] in packs)
            run = [at, to, j - i, {packs[p]["kept_in"] for p in own[i:j] if p in packs}]
            if runs and at <= runs[-1][1]:
                last = runs.pop()
                run = [min(last[0], at), max(last[1], to), last[2] + run[2], last[3] | run[3]]
            runs.append(run)
        i = max(j, i + 1)
    runs = [run for run in runs if run[1] - run[0] >= run_words]
    if not runs:
        return [], 0, 0, []
    words = found.points(number)
    return [(int(words[at]), int(words[to])) for at, to, _, _ in runs], sum(r[1] - r[0] for r in runs), sum(r[2] for r in runs), sorted(set().union(*(r[3] for r in runs)))


def cut_repeats(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with repeated passages cut out of ``text``, and removed_words, removed_paragraphs, copies_in.

    A run of repeated paragraphs, with the words on both sides that its copy has as well, is cut from all documents
    but the one with the smallest doc_id, named in ``copies_in``, if it has 15 words or more. Repeats inside one
    document stay. Rows with equal doc_id, and all rows with null doc_id, count as one document, so they cut nothing
    from each other; words beside a run of theirs may stay. Null text stays null; empty and
    short texts have nothing to cut. Columns with the names of new ones are replaced; no rows give no rows.
    """
    made = [T.StructField("removed_words", T.LongType()), T.StructField("removed_paragraphs", T.LongType()), T.StructField("copies_in", T.ArrayType(T.LongType()))]
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, *(f.name for f in made))]
    doc = F.coalesce("doc_id", F.lit(NO_ID)) if "doc_id" in df.columns else F.lit(NO_ID)
    found = repeats(df.select(doc.alias("doc"), F.coalesce(text, F.lit("")).alias("text")))
    # the caller's columns travel as one, so that no name of theirs meets one of these
    own = F.struct(*keep) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    rows = df.select(own.alias("own"), F.col(text).alias("text"), doc.alias("doc")).join(found, "doc", "left").select("own", "text", "packs")
    schema = T.StructType([rows.schema["own"], T.StructField("text", T.StringType()), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            texts, words, paragraphs, copies = [], [], [], []
            values, cuts = part.column("text").to_pylist(), part.column("packs").to_pylist()
            found = Paragraphs([value if packs and value else "" for value, packs in zip(values, cuts, strict=True)])
            own = found.packs()
            for i, (value, packs) in enumerate(zip(values, cuts, strict=True)):
                spans, n, k, kept = cut_runs(found, own, i, value, {p["pack"]: p for p in packs}) if packs and value else ([], 0, 0, [])
                at, left = 0, []
                for start, end in spans:
                    left.append(value[at:start])
                    at = end
                texts.append("".join([*left, value[at:]]) if spans else value)
                words.append(n)
                paragraphs.append(k)
                copies.append([c for c in kept if c != NO_ID])
            yield pa.RecordBatch.from_arrays(
                [part.column("own"), pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(paragraphs, pa.int64()), pa.array(copies, pa.list_(pa.int64()))],
                names=schema.names)

    cut = rows.mapInArrow(run, schema)
    return cut.select(*[F.col("own")[c].alias(c) for c in keep], F.col("text").alias(text), *(f.name for f in made))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, text without repeated passages, removed_words, removed_paragraphs, copies_in (doc_ids)."""
    return cut_repeats(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
