"""Pairs of records with similar content, exactly and without comparing all pairs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.cleaning import content_hash, squeeze
from webloom.functions.common import let, total
from webloom.session import spread, written

#: Hashes that the words of a field are marked by, a multiple of 64; fewer where its records have few words.
MARKS = 2048
#: A word that more records have in a field makes them meet by the next field instead.
HOT_WORDS = 1024
#: Counts of words by hash, a power of two.
USAGE = 1 << 22
#: Words of the records that are at home in one block.
CELL_WORDS = 100_000
#: Hashes of a word: 28 bits of its md5, multiplied and shifted modulo a prime; other engines give the same ones.
HASH_PRIME = 2_147_483_647


def tokens(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_remove(F.array_distinct(F.split(squeeze(F.lower(text)), " ")), "")


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def field_similarity(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """1 for equal texts, else shared words over all words; ``ta`` and ``tb`` are the word sets."""

    def share(common: Column) -> Column:
        every = F.size(ta) + F.size(tb) - common
        return F.when(every == 0, 0.0).otherwise(common / F.nullif(every, F.lit(0)))

    return F.when(a == b, 1.0).otherwise(let(overlap(ta, tb), share))


def content_similarity(fields: Sequence[str], left: str = "a", right: str = "b") -> Column:
    """Mean field similarity of two records whose fields are the columns ``left.f`` and ``right.f``."""

    def one(f: str) -> Column:
        a, b = F.col(f"{left}.{f}"), F.col(f"{right}.{f}")
        return let(tokens(a), lambda ta: let(tokens(b), lambda tb: field_similarity(a, b, ta, tb)))

    return total([one(f) for f in fields]) / F.lit(float(len(fields)))


def representatives(records: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """(key, first): the record that stands for each content, found by partial aggregation."""
    hashed = records.select(key, content_hash(**{f: F.col(f) for f in fields}).alias("h"))
    first = hashed.groupBy("h").agg(F.min(key).alias("first"))
    return hashed.join(first, "h").select(key, "first")


def similar_pairs(records: DataFrame, fields: Sequence[str], threshold: float = 0.85, key: str = "data_id") -> DataFrame:
    """(id1, id2, score) with id1 < id2.

    Records of equal content are paired with the first of them, score 1, and that one stands for
    all in the near pairs; a content shared by very many records thus gives one row per record,
    and the pairs of its copies follow from a join with ``representatives``.
    """
    if len(fields) * threshold - (len(fields) - 1) <= 0:
        raise ValueError("too many fields for this threshold: some field could differ in every word")
    filled = spread(records).select(key, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
    hashed = filled.select("*", content_hash(**{f: F.col(f) for f in fields}).alias("__h"))
    firsts = hashed.groupBy("__h").agg(F.min(key).alias(key)).select(key, F.lit(True).alias("__first")).distinct()
    words = hashed.join(firsts, key, "left").withColumns({f"__w_{f}": F.when(F.col("__first"), tokens(F.col(f))) for f in fields})
    # texts move for this join alone; of a text stay its digest and its words, each once and all in one string
    stored = written(words.select(F.col(key).alias("key"), F.col("__h").alias("h"), F.col("__first").alias("open"), F.monotonically_increasing_id().alias("rid"), *[
        F.struct(F.unhex(F.sha2(F.col(f), 256)).alias("v"), F.size(f"__w_{f}").alias("n"), F.array_join(f"__w_{f}", " ").alias("w")).alias(f"f{i}")
        for i, f in enumerate(fields)]), compression="zstd")
    leaders = stored.groupBy("h").agg(F.min("key").alias("first"))
    copies = stored.select("key", "h").join(leaders, "h").where(F.col("key") != F.col("first")).select(
        F.col("first").alias("id1"), F.col("key").alias("id2"), F.lit(1.0).alias("score"))
    return copies.unionByName(_near_pairs(stored.where("open"), [f"f{i}" for i in range(len(fields))], threshold))


def word_marks(places: Column, marks: int = MARKS) -> Column:
    """For each hash of a word whether an odd number of the words have it, as 64-bit numbers."""

    @F.pandas_udf("array<bigint>")
    def odd(rows: pd.Series) -> pd.Series:
        return pd.Series([np.packbits((np.bincount(r, minlength=marks) & 1).astype(np.uint8)).view(np.int64) for r in rows], dtype=object)

    return odd(places)


def most_similar(a: Column, b: Column) -> Column:
    """What two word sets (``n`` words, ``marks``) can have in common at most: each mark that differs is a word of one of them only."""
    return _shared(a["n"], b["n"], F.aggregate(F.zip_with(a["marks"], b["marks"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n))


def _shared(a: Column, b: Column, differ: Column) -> Column:
    """What sets of so many words can have in common at most, if so many words are in one of them only."""
    common = F.least(a, b, F.floor((a + b - differ) / 2).cast("int"))
    return F.when(a + b == 0, 1.0).otherwise(let(common, lambda c: c / F.nullif(a + b - c, F.lit(0))))


def _of_both(pairs: DataFrame, each: DataFrame, key: str, what: str) -> DataFrame:
    """Pairs with the column ``what`` of both records as ``a`` and ``b``."""
    return pairs.join(each.select(F.col(key).alias("id1"), F.col(what).alias("a")), "id1") \
        .join(each.select(F.col(key).alias("id2"), F.col(what).alias("b")), "id2")


def _places(words: Column, marks: int = MARKS) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(marks)).cast("int"))


def _marks(fields: Sequence[str]) -> Column:
    return F.struct(*[F.struct(F.size(f"__w_{f}").alias("n"), F.col(f"__m_{f}").alias("marks")).alias(f) for f in fields])


def _body(fields: Sequence[str]) -> Column:
    """Word sets, and digests that tell texts apart."""
    return F.struct(*[F.struct(F.sha2(F.col(f), 256).alias("v"), F.col(f"__w_{f}").alias("t")).alias(f) for f in fields])


def _at_most(fields: Sequence[str], a: Column | None = None, b: Column | None = None) -> Column:
    a, b = F.col("a") if a is None else a, F.col("b") if b is None else b
    return total([most_similar(a[f], b[f]) for f in fields]) / F.lit(float(len(fields)))


def _score(fields: Sequence[str], a: Column | None = None, b: Column | None = None) -> Column:
    a, b = F.col("a") if a is None else a, F.col("b") if b is None else b
    return total([field_similarity(a[f]["v"], b[f]["v"], a[f]["t"], b[f]["t"]) for f in fields]) / F.lit(float(len(fields)))


def _cut(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _near_pairs(df: DataFrame, fields: list[str], threshold: float) -> DataFrame:
    """Near pairs among records of distinct content: candidates, those that their marks leave possible, then the true score.

    A pair moves as two numbers. What is compared moves by record, once to each cell that has a pair of it: first
    the marks, then the words of pairs that the marks cannot rule out. Records without a candidate stay where they are.
    """
    mean = df.agg(*[F.avg(f"{f}.n").alias(f) for f in fields]).first().asDict()
    fields = sorted(fields, key=lambda f: mean[f] or 0)
    bits = [min(MARKS, max(64, 1 << math.ceil(math.log2(2 * (mean[f] or 0) + 1)))) for f in fields]
    met = written(_candidates(df, fields, threshold, bits).distinct())
    named = _named(df, met)

    def mate(s: Column, rids: Column, m: Column) -> Column:
        return F.get(s, (F.array_position(rids, m) - 1).cast("int"))

    def possible(s: Column) -> Column:
        """Members with the mates that their marks allow; those without any that are no mate either are left out."""
        left = let(s["rid"], lambda rids: F.transform(s, lambda x: F.struct(x["rid"].alias("rid"), F.filter(
            x["mates"], lambda m: let(mate(s, rids, m), lambda y: _at_most(fields, x["c"], y["c"]) >= threshold - 1e-9)).alias("mates"))))
        return let(left, lambda k: let(F.flatten(k["mates"]), lambda p: F.filter(k, lambda x: (F.size(x["mates"]) > 0) | F.array_contains(p, x["rid"]))))

    def scored(s: Column) -> Column:
        def pair(x: Column, y: Column) -> Column:
            return F.struct(F.least(x["key"], y["key"]).alias("id1"), F.greatest(x["key"], y["key"]).alias("id2"),
                            F.when(x["key"] != y["key"], _score(fields, x, y)).alias("score"))

        split = F.transform(s, lambda x: F.struct(x["rid"].alias("rid"), x["key"].alias("key"), x["mates"].alias("mates"), *[
            F.struct(x["c"][f]["v"].alias("v"), _cut(x["c"][f]["w"]).alias("t")).alias(f) for f in fields]))
        return let(split, lambda s: let(s["rid"], lambda rids: F.flatten(F.transform(s, lambda x: F.filter(
            F.transform(x["mates"], lambda m: let(mate(s, rids, m), lambda y: pair(x, y))), lambda p: p["score"] >= threshold)))))

    places = named.select("rid", *[F.struct(f"{f}.n", _places(_cut(F.col(f"{f}.w")), m).alias("p")).alias(f) for f, m in zip(fields, bits)])
    marks = places.select("rid", F.struct(*[F.struct(f"{f}.n", word_marks(F.col(f"{f}.p"), m).alias("marks")).alias(f) for f, m in zip(fields, bits)]).alias("c"))
    words = named.select("rid", "key", F.struct(*[F.struct(f"{f}.v", f"{f}.w").alias(f) for f in fields]).alias("c"))
    left = _by_cell(_cells(met).join(marks, "rid"), "rid", "mates", "c").select("a", "b", F.explode(possible(F.col("s"))).alias("x")).select("a", "b", "x.*")
    return _by_cell(left.join(words, "rid"), "rid", "key", "mates", "c").select(F.explode(scored(F.col("s"))).alias("p")).select("p.*")


def _by_cell(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("a", "b").agg(F.collect_list(F.struct(*columns)).alias("s"))


def _named(df: DataFrame, met: DataFrame) -> DataFrame:
    """The records that some candidate names, known by one bit per record."""
    bits = met.select(F.explode(F.array("rid1", "rid2")).alias("r")).groupBy(F.bitmap_bucket_number("r").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("r")).alias("__bits"))
    at = F.bitmap_bit_position("rid").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at % 8 + 1)) != 0
    # numbers run on within a task, so the bits take an eighth of a byte for each record
    return df.join(F.broadcast(bits), F.bitmap_bucket_number("rid") == F.col("__bucket")).where(has).drop("__bucket", "__bits")


def _cells(met: DataFrame) -> DataFrame:
    """(a, b, rid, mates): pairs dealt out so that those of like records meet, and few records are in many cells.

    A record is at home with the least record it meets, which near copies have in common; a home of many words is cut into
    blocks, and two homes make a cell.
    """
    both = met.select(F.explode(F.array(F.struct(F.col("rid1").alias("rid"), F.col("s1").alias("size"), F.col("rid2").alias("mate")),
                                        F.struct(F.col("rid2").alias("rid"), F.col("s2").alias("size"), F.col("rid1").alias("mate")))).alias("x"))
    least = both.groupBy("x.rid").agg(F.least(F.min("x.mate"), F.col("rid")).alias("least"), F.max("x.size").alias("size"))
    blocks = least.groupBy("least").agg(F.ceil(F.sum(F.col("size") + 100) / CELL_WORDS).alias("blocks"))
    home = least.join(blocks, "least").select("rid", F.xxhash64("least", F.pmod(F.xxhash64("rid"), "blocks")).alias("home"))
    placed = met.select("rid1", "rid2").join(home.toDF("rid1", "h1"), "rid1").join(home.toDF("rid2", "h2"), "rid2")
    sides = placed.select(F.least("h1", "h2").alias("a"), F.greatest("h1", "h2").alias("b"), F.explode(F.array(
        F.struct(F.col("rid1").alias("rid"), F.col("rid2").alias("mate")), F.struct(F.col("rid2").alias("rid"), F.lit(None).cast("long").alias("mate")))).alias("x"))
    return sides.groupBy("a", "b", "x.rid").agg(F.collect_list("x.mate").alias("mates"))


def _candidates(df: DataFrame, fields: list[str], threshold: float, bits: list[int]) -> DataFrame:
    """(rid1, rid2, s1, s2): all pairs that can reach the threshold, and few others, with the number of their words. A pair may come a few times.

    A mean of at least t over k fields leaves every field at least m = k*t - (k-1). Two word sets with Jaccard similarity m or
    more share a word among the first |x| - ceil(m*|x|) + 1 words of each, in any fixed order of words; with rare words first
    few records meet. What meets must also pass the size and position bounds, and those of the marks that its rows have.

    Any field will do, so the shortest comes first, and its rows bring all marks of the other fields. Records with a word of
    very many there meet by the next field as well: a pair that shares none but such words is found in that one. A field without
    words is passed over, as in a pair both records have none or the field is not similar. In a record's last field all words count.

    A pair whose words before this one are the same has met by that word already: bounds only fall from one to the next.
    """
    k = len(fields)
    need = k * threshold - (k - 1)
    hashes = df.select("rid", *[F.transform(_cut(F.col(f"{f}.w")), _seeded(i)).alias(f) for i, f in enumerate(fields)])
    others = range(k - 1)
    usage = df.sparkSession.sparkContext.broadcast(_usage(hashes.drop("rid")))
    rows = hashes.mapInArrow(_prefixes(usage, bits, need, HOT_WORDS), ", ".join(
        ["word long, before long, rid long, pos int, n int", *[f"n{j} int, few{j} long, marks{j} array<long>" for j in others]]))

    def side(n: int) -> DataFrame:
        return rows.select("word", F.col("rid").alias(f"rid{n}"), F.struct("*").alias("ab"[n - 1]))

    a, b = F.col("a"), F.col("b")
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    allowed = F.least(a["n"] - a["pos"], b["n"] - b["pos"]) + 1
    wanted = (a["n"] + b["n"]) * (need / (1 + need)) - 1e-9
    few = total([small / large, *[_shared(a[f"n{j}"], b[f"n{j}"], F.bit_count(a[f"few{j}"].bitwiseXOR(b[f"few{j}"]))) for j in others]])
    full = total([small / large, *[F.coalesce(most_similar(*[F.struct(x[f"n{j}"].alias("n"), x[f"marks{j}"].alias("marks")) for x in (a, b)]), F.lit(1.0)) for j in others]])
    met = side(1).join(side(2), "word").where(
        (F.col("rid1") < F.col("rid2")) & (small >= large * need - 1e-9) & (allowed >= wanted) & F.coalesce(a["before"] != b["before"], F.lit(True))
        & (few >= k * threshold - 1e-9) & (full >= k * threshold - 1e-9))
    return met.select("rid1", "rid2", *[total([x["n"], *[x[f"n{j}"] for j in others]]).alias(s) for x, s in ((a, "s1"), (b, "s2"))])


def _seeded(seed: int):
    return lambda w: F.xxhash64(w, F.lit(seed))


def _usage(hashes: DataFrame) -> np.ndarray:
    """How many records have a word, by the last bits of its hash: never too few, a fixed number of bytes."""
    slices = 64

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(USAGE, np.uint32)
        for batch in batches:
            for column in batch.columns:
                np.add(counts, np.bincount(column.flatten().to_numpy() & (USAGE - 1), minlength=USAGE), out=counts, casting="unsafe")
        for n, part in enumerate(np.split(counts, slices)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([n], pa.int32()), "counts": [zlib.compress(part.tobytes(), 1)]})

    def summed(parts: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in parts["counts"])
        return pd.DataFrame({"slice": parts["slice"][:1], "counts": [np.minimum(counts, 65_535).astype(np.uint16).tobytes()]})

    usage = np.zeros((slices, USAGE // slices), np.uint16)
    for row in hashes.mapInArrow(counted, "slice int, counts binary").groupBy("slice").applyInPandas(summed, "slice int, counts binary").collect():
        usage[row["slice"]] = np.frombuffer(row["counts"], np.uint16)
    return usage.reshape(-1)


def _prefixes(shared: Broadcast, bits: list[int], need: float, hot: int):
    """The words that records meet by, with the place in the order of a field, the word before, and sizes and marks of the other fields.

    64 marks each go with all rows, the full ones where another field is to follow: then few rows are told of a record.
    """
    k = len(bits)

    def rows_of(rid: np.ndarray, sizes: np.ndarray, words: list[np.ndarray]) -> Iterator[list[pa.Array]]:
        usage, some = shared.value, sizes > 0
        last = np.where(some.any(0), k - 1 - some[::-1].argmax(0), -1)
        owner = [np.repeat(np.arange(len(rid)), n) for n in sizes]
        few, full = ([_parity(o, w, len(rid), m) for o, w, m in zip(owner, words, ms)] for ms in ([64] * k, bits))
        open_ = some.any(0)
        for i, n in enumerate(sizes):
            asked = open_[owner[i]]
            o, w = owner[i][asked], words[i][asked]
            used = usage[w & (USAGE - 1)]
            order = np.lexsort((w, used, o))
            o, w, used = o[order], w[order], used[order]
            pos = np.arange(len(o)) - np.searchsorted(o, o) + 1
            first = pos <= n[o] - np.ceil(n[o] * need - 1e-9) + 1
            o, w, used, pos = o[first], w[first], used[first], pos[first]
            more = last[o] != i
            later = more & (used > hot)
            out = ~later & (used > 1)  # a word of one record meets none
            open_ &= ~some[i]
            open_[o[later]] = True
            o, w, pos, more = o[out], w[out], pos[out], more[out]
            start = np.ones(len(o), bool)
            start[1:] = o[1:] != o[:-1]
            each = [pa.array(w), pa.array(np.roll(w, 1), mask=start), pa.array(rid[o]), pa.array(pos, pa.int32()), pa.array(n[o], pa.int32())]
            for j in range(k):
                if j != i:
                    at = np.concatenate([[0], np.cumsum(more * (bits[j] // 64))])
                    marks = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(full[j][o[more]].reshape(-1)), mask=pa.array(~more))
                    each += [pa.array(sizes[j][o], pa.int32()), pa.array(few[j][o, 0]), marks]
            yield each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "before", "rid", "pos", "n", *[x for j in range(k - 1) for x in (f"n{j}", f"few{j}", f"marks{j}")]]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rid, *columns = batch.slice(at, 1000).columns
                sizes = np.stack([c.value_lengths().to_numpy().astype(np.int64) for c in columns])
                for each in rows_of(rid.to_numpy(), sizes, [c.flatten().to_numpy() for c in columns]):
                    yield pa.RecordBatch.from_arrays(each, names)

    return run


def _parity(owner: np.ndarray, words: np.ndarray, n: int, marks: int) -> np.ndarray:
    """As ``word_marks``: a row of 64-bit numbers for each of ``n`` records."""
    odd = np.bincount(owner * marks + ((words >> 40) & (marks - 1)), minlength=n * marks) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, -1)


# --- approximate mode ----------------------------------------------------------------------

def tune_bands(similarity: float, recall: float, rows: Sequence[int] = (2, 3, 4), most: int = 40) -> tuple[int, int]:
    """(bands, rows per band): the most rows for which at most ``most`` bands find a pair of this similarity with this
    probability, and as few bands as do."""
    for r in sorted(rows, reverse=True):
        for bands in range(1, most + 1):
            if 1 - (1 - similarity**r) ** bands >= recall:
                return bands, r
    raise ValueError("no such bands: allow more of them or fewer rows")


def hash_factors(n: int) -> list[tuple[int, int]]:
    """Multipliers and shifts of ``n`` hash functions."""
    return [(48_271 * (i + 1) ** 3 % HASH_PRIME, 69_621 * (i + 1) ** 5 % HASH_PRIME) for i in range(n)]


def band_keys(words: Column, bands: int, rows: int) -> Column:
    """One key per band: its number and the smallest hashes of the words. Null without words."""
    factors = np.array(hash_factors(bands * rows), np.int64)

    @F.pandas_udf("array<string>")
    def keys(sets: pd.Series) -> pd.Series:
        def of_one(bases: np.ndarray | None) -> list[str] | None:
            if bases is None or not len(bases):
                return None
            least = np.full(len(factors), HASH_PRIME)
            for at in range(0, len(bases), 4096):
                hashes = (bases[at : at + 4096].astype(np.int64)[None, :] * factors[:, :1] + factors[:, 1:]) % HASH_PRIME
                least = np.minimum(least, hashes.min(axis=1))
            return ["|".join(map(str, (b, *least[b * rows : (b + 1) * rows].tolist()))) for b in range(bands)]

        return pd.Series([of_one(bases) for bases in sets], dtype=object)

    return keys(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int")))


def similar_links(
    records: DataFrame, fields: Sequence[str], threshold: float = 0.85, key: str = "data_id", recall: float = 0.95, rounds: int = 2,
) -> DataFrame:
    """(id1, id2, score): the approximate mode of ``similar_pairs``, a part of its pairs that links what is similar.

    Records of equal content are linked to the first of them. The others get MinHash signatures of their words,
    each marked with its field; a mean similarity of t over k fields leaves at least k*t - (k-1) for all words
    together, and the bands are tuned to find that with probability ``recall``. In each bucket the first record is
    the centre and all others are compared with it exactly; those that fail do the same among themselves, ``rounds``
    times. So a record has at most bands * rounds candidates, however many resemble it, and a template with m
    variants gives m links.
    """
    need = len(fields) * threshold - (len(fields) - 1)
    if need <= 0:
        raise ValueError("too many fields for this threshold: some field could differ in every word")
    bands, rows = tune_bands(need, recall)
    filled = records.select(key, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
    words = F.flatten(F.array(*[F.transform(tokens(F.col(f)), _marked(n)) for n, f in enumerate(fields)]))
    # one pass over the texts gives what is moved: hashes and keys
    marked = written(spread(filled).select(key, content_hash(**{f: F.col(f) for f in fields}).alias("__h"), band_keys(words, bands, rows).alias("bands")))
    leaders = marked.groupBy("__h").agg(F.min(key).alias("first"))
    copies = marked.select(key, "__h").join(leaders, "__h").where(F.col(key) != F.col("first")).select(
        F.col("first").alias("id1"), F.col(key).alias("id2"), F.lit(1.0).alias("score"))
    distinct = marked.join(leaders.select(F.col("first").alias(key)), key, "left_semi")
    open_ = written(distinct.select(F.col(key).alias("id2"), F.explode("bands").alias("band")))
    links = []
    for _ in range(rounds):
        centre = open_.groupBy("band").agg(F.min("id2").alias("id1"), F.count(F.lit(1)).alias("n")).where("n > 1")
        met = open_.join(centre.drop("n"), "band").where("id1 < id2")
        judged = written(_scored(met.select("id1", "id2").distinct(), filled, fields, threshold, key))
        links.append(judged.where(F.col("score") >= threshold))
        open_ = written(met.join(judged.where(F.col("score") < threshold), ["id1", "id2"]).select("id2", "band"))
    near = links[0]
    for more in links[1:]:
        near = near.unionByName(more)
    return copies.unionByName(near.distinct())


def _marked(field: int):
    return lambda w: F.concat(F.lit(f"{field}:"), w)


def _scored(pairs: DataFrame, records: DataFrame, fields: Sequence[str], threshold: float, key: str) -> DataFrame:
    """(id1, id2, score) of each pair: the exact similarity, or 0 where the marks rule the threshold out.

    Words are taken from a text once, and only those of pairs that the marks leave possible are moved.
    """
    asked = pairs.select(F.explode(F.array("id1", "id2")).alias(key)).distinct()
    words = records.join(asked, key, "left_semi").select("*", *[tokens(F.col(f)).alias(f"__w_{f}") for f in fields])
    marked = words.withColumns({f"__m_{f}": word_marks(_places(F.col(f"__w_{f}"))) for f in fields})
    each = written(marked.select(key, _marks(fields).alias("marks"), _body(fields).alias("body")))
    bounds = written(_of_both(pairs, each, key, "marks").select("id1", "id2", _at_most(fields).alias("most")))
    possible = bounds.where(F.col("most") >= threshold - 1e-9).select("id1", "id2").distinct()
    exact = _of_both(possible, each, key, "body").select("id1", "id2", _score(fields).alias("score"))
    return exact.unionByName(bounds.where(F.col("most") < threshold - 1e-9).select("id1", "id2", F.lit(0.0).alias("score")))
