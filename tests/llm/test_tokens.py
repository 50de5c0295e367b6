"""Token operators against the libraries whose results they must give."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, empty, rows_of
from webloom.llm import op2_packing as op2
from webloom.llm import op3_byte_bpe as op3
from webloom.llm import op9_token_counts as op9

ENCODER = op3.Encoder(P.path(op3.RANKS), P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})
COUNTER = op9.Counter(P.path(op9.VOCABULARY))
WORDS = tokenizers.Tokenizer.from_file(P.path(op9.VOCABULARY))
BYTES = tokenizers.Tokenizer.from_file(P.path(op2.VOCABULARY))
PARTS = ["a", "b", "the ", "e", "ing", "  ", "\n", "1", "23", "!", "\u00e9", "\u65e5", "<|endoftext|>", "\u03a3", "'s", "\x1c", "\u0130", "x" * 50, "ab" * 40]
TEXT = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_same_ids_and_counts_as_the_libraries(text):
    assert ENCODER.encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)
    assert COUNTER.count([text]) == [len(WORDS.encode(text, add_special_tokens=False).ids)]
    assert op2.Tokenizer(P.path(op2.VOCABULARY)).ids([text])[0].tolist() == BYTES.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abcdefgh tion", max_size=80))
def test_single_merges_equal_merges_in_steps(text):
    raw = text.encode()
    assert op3.merge(raw, ENCODER.ranks) == TIKTOKEN.encode_ordinary(text) or " " in text
    if raw:
        ids, counts = ENCODER.solve([text])
        whole = ENCODER.ranks.get(raw)
        assert ids.tolist() == ([whole] if whole is not None else op3.merge(raw, ENCODER.ranks)) and counts.tolist() == [len(ids)]


def test_all_low_code_points():
    texts = [f"a{chr(c)} {chr(c)}1 {chr(c)}{chr(c)}'s \n{chr(c)} x" for c in range(0x530)]
    assert [i.tolist() for i in ENCODER.encode(texts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert COUNTER.count(texts) == [len(WORDS.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_very_long_word():
    text = "ab" * 60_000
    assert ENCODER.encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)
    assert COUNTER.count([text])[0] == len(WORDS.encode(text, add_special_tokens=False).ids)


def test_bitmap_queue_gives_ranks_in_order():
    queue, ranks = op3.BitmapQueue(), random.Random(1).sample(range(65536), 500)
    for r in ranks:
        queue.add(r)
    assert [queue.pop() for _ in range(501)] == [*sorted(ranks), None]


def test_encode_decode_table(spark):
    docs = documents(spark)
    got = rows_of(op3.decode(op3.encode(docs)))
    assert len(got) == docs.count()
    for r in got:
        text = r["text"] or ""
        assert r["ids"] == TIKTOKEN.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert op3.decode(op3.encode(empty(spark))).count() == 0


def test_counts_table(spark):
    got = rows_of(op9.count_tokens(documents(spark).withColumnRenamed("rank", "n_tokens")))
    assert all(r["n_tokens"] == len(WORDS.encode(r["text"] or "", add_special_tokens=False).ids) for r in got)
    assert op9.count_tokens(empty(spark)).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        op9.Counter(P.path("byte_bpe_50k.json"))


def test_packing_table(spark):
    docs = documents(spark).withColumnRenamed("rank", "offset")
    got = rows_of(op2.pack(op2.pieces_of(docs, keep=["doc_id", "source"], capacity=128), ["doc_id", "piece", "ids_crc32"], 128))
    want = Counter()
    for r in docs.collect():
        ids = BYTES.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        for i, (s, n) in enumerate(op2.cut(len(ids), 128)):
            want[(r["doc_id"], i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(r["length"] for r in got) // 128) + 2
    assert op2.pack(op2.pieces_of(empty(spark), keep=["doc_id"]), ["doc_id", "piece", "ids_crc32"]).count() == 0


def fewest(items, capacity):
    """Fewest bins by trying everything."""
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                put(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion_against_all_packings(items):
    runs = op2.pack_counts(dict(Counter(items)), 20)
    assert Counter(n for f, t in runs for n in f for _ in range(t)) == Counter(items)
    assert all(sum(f) <= 20 for f, _ in runs)
    assert sum(t for _, t in runs) == fewest(sorted(items, reverse=True), 20)


@pytest.mark.parametrize("counts", [{1: 1000}, {1: 5000}, {2: 5000}, {1: 5000, 2: 5000}, {1: 5000, 2: 700, 3: 1, 700: 20, 1000: 3, 1024: 2}])
def test_thousands_of_empty_and_one_token_texts_fill_bins(counts):
    runs = op2.pack_counts(counts)
    packed = Counter()
    for filling, times in runs:
        assert sum(filling) <= 1024 and times > 0
        for n in filling:
            packed[n] += times
    assert packed == counts
    assert sum(t for _, t in runs) == -(-sum(n * c for n, c in counts.items()) // 1024)


def test_a_search_without_steps_still_gives_a_filling():
    assert op2.fillings(op2.Open({1: 5000, 3: 2}), 20, tries=0) == [(3, 3) + (1,) * 14]


def test_digest_of_ids_is_the_contract_form(spark):
    from pyspark.sql import functions as F

    row = op3.encode(spark.createDataFrame([(1, "Hello there")], "doc_id long, text string")).select(
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("h")).head()
    assert row.h == hashlib.sha256(" ".join(map(str, TIKTOKEN.encode_ordinary("Hello there"))).encode()).hexdigest()
