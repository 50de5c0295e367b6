"""Near duplicates, substring dedup and components against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, empty, rows_of, sentence
from webloom.llm import op6_near_duplicates as op6
from webloom.llm import op10_substring_dedup as op10
from webloom.llm.common import WORD
from webloom.llm.components import components
from webloom.llm.shingles import rolled, word_hashes, words_at


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_against_union_find(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(45)] + [(200, i) for i in range(201, 260)] + [(7, 7), (3, 4), (4, 3)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in rows_of(components(spark.createDataFrame(edges, "a long, b long"), "a", "b"))}
    assert got == {x: find(parent, x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_near(rows, percent=75):
    """(doc_id, n_shingles, component_id, kept) of each row by comparing all pairs of distinct sets."""
    sets = {}
    for doc, text in rows:
        sets.setdefault(frozenset(shingles(text)), []).append(doc)
    parent = {s: s for s in sets}
    for a, b in combinations([s for s in sets if s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            parent[find(parent, a)] = find(parent, b)
    least = {}
    for s, ids in sets.items():
        root = find(parent, s)
        known = [i for i in [*ids, least.get(root)] if i is not None]
        least[root] = min(known) if known else None
    out = []
    for doc, text in rows:
        s = frozenset(shingles(text))
        component = least[find(parent, s)] if s else doc
        out.append((doc, len(s), component, doc is not None and doc == component))
    return Counter(out)


def result(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(df))


def test_near_duplicates_table(spark):
    docs = documents(spark).withColumnRenamed("rank", "class")
    assert result(op6.near_duplicates(docs)) == brute_near([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert op6.near_duplicates(empty(spark)).count() == 0


def family(r, size, words, edits):
    base = sentence(r, words).split()
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [2, 2048])
def test_near_duplicates_families_and_a_common_passage(spark, monkeypatch, block):
    """Families of copies with few to many edits, some just above and below the limit; a passage in a third of the rows."""
    monkeypatch.setattr(op6, "BLOCK", block)
    monkeypatch.setattr(op6, "ROUNDS", 1 if block == 2 else 2)
    r = random.Random(8)
    texts = family(r, 60, 80, 6) + family(r, 25, 40, 3) + family(r, 25, 200, 12)
    passage = sentence(r, 60)
    texts += [f"{sentence(r, 25)} {passage} {sentence(r, 20)}" for _ in range(50)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(op6.near_duplicates(df)) == brute_near(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, op6.DISTANCE), st.integers(0, 10**6))
def test_any_two_signatures_within_the_distance_share_a_key(apart, seed):
    r = np.random.default_rng(seed)
    a = r.integers(0, 2**16, op6.SYMBOLS).astype("<u2")
    b = a.copy()
    at = r.choice(op6.SYMBOLS, apart, replace=False)
    b[at] ^= 1
    keys = op6.chunk_keys(np.stack([a, b]))
    assert len(np.intersect1d(keys[0], keys[1]))


def test_tuned_bands_reach_the_recall():
    for similarity in (0.6, 0.75, 0.9):
        bands, rows = op10.tune_bands(similarity, 0.95)
        assert 1 - (1 - similarity**rows) ** bands >= 0.95


def repeats(texts, n):
    """Documents that share a run of ``n`` words with a document of a smaller id."""
    first, out = {}, set()
    for doc, text in sorted(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(words) - n + 1):
            if first.setdefault(tuple(words[i : i + n]), doc) != doc:
                out.add(doc)
    return out


def test_passages_are_cut_from_all_but_the_first(spark):
    r = random.Random(11)
    passages = [sentence(r, r.randrange(52, 90)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [sentence(r, r.randrange(20, 60)), sentence(r, r.randrange(20, 60))]
        inside = passages[i % 5] if i % 3 else ""
        if i == 31:  # one word changed: still a near copy of most paragraphs
            inside = inside.replace(inside.split()[20], "changed", 1)
        rows.append((i, " ".join([parts[0], inside, parts[1]]) if i % 4 else f"{parts[0]}\n{inside}\n{parts[1]}"))
    df = spark.createDataFrame([(*x, 1, "a") for x in rows], "doc_id long, text string, removed_words int, lang string").repartition(4)
    got = {r["doc_id"]: r for r in rows_of(op10.cut_repeats(df))}
    assert len(got) == len(rows) and repeats(rows, 51)
    assert not repeats([(i, r["text"]) for i, r in got.items()], 51)
    for i, text in rows:
        row = got[i]
        assert (row["removed_words"] > 0) == (i in repeats(rows, 45) or i == 31)
        words, left = text.split(), row["text"].split()
        assert len(words) - len(left) == row["removed_words"]
        assert all(c < i for c in row["copies_in"]) and bool(row["copies_in"]) == (row["removed_words"] > 0)
        if not row["removed_words"]:
            assert row["text"] == text
    for k, passage in enumerate(passages):
        holders = [i for i, r in got.items() if passage in r["text"].replace("\n", " ")]
        assert holders == [min(i for i, t in rows if i % 3 and i % 5 == k)]


def test_a_frequent_passage_goes_through_salts(spark, monkeypatch):
    monkeypatch.setattr(op10, "SAMPLE", 1)
    r = random.Random(12)
    passage = sentence(r, 60)
    rows = [(i, f"{sentence(r, 30)} {passage} {sentence(r, 30)}") for i in range(80)]
    got = {r["doc_id"]: r for r in rows_of(op10.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert [i for i, r in got.items() if r["removed_words"] == 0] == [0]
    assert all(0 in r["copies_in"] for i, r in got.items() if i)


def test_a_paragraph_that_captures_the_bands_hides_no_copies(spark):
    """The first of every band is unlike the others, which are copies and near copies of each other."""
    r = random.Random(21)
    n = 0
    while n < 3:
        hidden = sentence(r, 24)
        found = op10.Paragraphs([hidden])
        if len(found.starts) != 1:
            continue
        # a paragraph of the shingles that are least in each band, and many other words
        least = [int(np.argmin(op10.mixed(op10.rolled(found.hashes, 5) ^ np.uint64(1 + b)))) for b in range(op10.BANDS)]
        words = hidden.split()
        captor = " ".join(w for at in least for w in words[at : at + 5]) + " extra"
        near = " ".join([*words[:-1], "changed"])
        each = op10.Paragraphs([captor, hidden, near])
        keys = each.keys(each.digests())[: op10.BANDS]
        if len(each.starts) != 3 or (keys != keys[:, :1]).any():
            continue
        n += 1
        rows = [(1, captor), (2, hidden), (3, hidden), (4, near)]
        got = {x["doc_id"]: x for x in rows_of(op10.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")))}
        assert [got[i]["text"] for i in (1, 2, 3, 4)] == [captor, hidden, "", ""]
        assert got[3]["copies_in"] == [2] and got[4]["copies_in"] == [2]


def test_all_members_of_a_band_in_different_components_are_compared():
    r = random.Random(22)
    sets = []
    for _ in range(40):
        base = r.sample(range(10**6), 20)
        sets += [np.array(sorted([*base[k:], *r.sample(range(10**6), k)]), np.int64) for k in (0, 0, 1, 2)]
    r.shuffle(sets)
    roots, parent = list(range(len(sets))), {i: i for i in range(len(sets))}
    for i, j in combinations(range(len(sets)), 2):
        joint = len(set(sets[i].tolist()) & set(sets[j].tolist()))
        if 100 * joint >= 75 * (len(sets[i]) + len(sets[j]) - joint):
            parent[find(parent, j)] = find(parent, i)
    got = {i: i for i in range(len(sets))}
    for later, earlier in op10.alike(list(range(len(sets))), roots, sets):
        assert later > earlier
        got[find(got, later)] = find(got, earlier)
    both = {(find(parent, i), find(got, i)) for i in range(len(sets))}
    assert len(both) == len({a for a, _ in both}) == len({b for _, b in both})


def lines_of(text, n):
    words = text.split()
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_paragraphs_too_short_for_a_shingle_are_short_lines_between_long_ones():
    r = random.Random(31)
    for _ in range(200):
        lines = [sentence(r, r.choice([0, 1, 2, 3, 4, 5, 9, 40])) for _ in range(r.randrange(1, 30))]
        found = op10.Paragraphs(["\n".join(lines)])
        lines = [x for x in lines if x]
        alone, at = set(), 0
        for i, line in enumerate(lines):
            if len(line.split()) < 5 and (i == 0 or len(lines[i - 1].split()) >= 5):
                alone.add(at)  # a stretch of short lines begins
            at += len(line.split())
        assert {int(a) for a, size in zip(found.starts, found.sizes, strict=True) if size < 5} <= alone and found.sizes.sum() == at


def test_a_passage_of_short_lines_is_cut(spark):
    r = random.Random(32)
    verse, prose = lines_of(sentence(r, 60), 3), [sentence(r, 30) for _ in range(2)]
    mixed = "\n".join([prose[0], lines_of(sentence(r, 12), 3), prose[1]])
    rows = [(i, "\n".join([sentence(r, 20), (verse, mixed)[i % 2], sentence(r, 20)])) for i in range(6)]
    got = {x["doc_id"]: x for x in rows_of(op10.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert [got[i]["removed_words"] for i in range(6)] == [0, 0, 60, 72, 60, 72]


def test_paragraphs_of_a_text_do_not_depend_on_the_texts_beside_it():
    r = random.Random(41)
    texts = ["", *("\n".join(sentence(r, r.choice([0, 1, 3, 5, 12, 60])) for _ in range(r.randrange(6))) for _ in range(80)), "\u00a0 one\u2028two\t\x0bthree ", "", "x"]
    all_ = op10.Paragraphs(texts)
    packs, digests = all_.packs(), all_.digests()
    for i, text in enumerate(texts):
        one = op10.Paragraphs([text])
        own = slice(all_.firsts[i], all_.firsts[i + 1])
        assert (all_.of[own] == i).all() and one.packs().tolist() == packs[own].tolist() and one.sizes.tolist() == all_.sizes[own].tolist()
        assert len(one.hashes) == len(re.findall(r"[^\x20\x09-\x0D]+", text)) == one.sizes.sum()
        if (one.sizes >= 5).any():
            long = one.sizes >= 5
            assert (one.keys(one.digests())[:, long] == all_.keys(digests)[:, own][:, long]).all()


@pytest.mark.parametrize("further", [2, 24])
def test_passages_of_51_words_go_to_both_ends(spark, monkeypatch, further):
    """In the middle of lines, and where lines are broken otherwise."""
    monkeypatch.setattr(op10, "FURTHER", further)
    r = random.Random(42)
    rows, want = [], {}
    for k in range(150):
        passage = sentence(r, 51)
        for i in (2 * k, 2 * k + 1):
            before, after = (" ".join(f"{c}{i}w{j}" for j in range(r.randrange(6, 40))) for c in "ab")
            broken = lines_of(passage, 33) if k % 3 == 0 and i % 2 else passage
            rows.append((i, f"{before} {broken} {after}"))
            want[i] = f"{before} {after}" if i % 2 else rows[-1][1]
    got = {x["doc_id"]: x for x in rows_of(op10.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))}
    assert all(got[i]["text"] == rows[i][1] for i in range(0, 300, 2))
    apart = []
    for i in range(1, 300, 2):
        left, wanted = got[i]["text"].split(), want[i].split()
        assert got[i]["removed_words"] == len(rows[i][1].split()) - len(left)
        apart.append(len(set(left) ^ set(wanted)))
    # a paragraph at an end may be near its copy only: then it goes as it is, a few words shorter or longer than the passage
    assert sum(n == 0 for n in apart) >= 130 and sum(n > 12 for n in apart) <= 2


def test_substring_dedup_table(spark):
    docs = documents(spark).withColumnRenamed("rank", "__at")
    got = rows_of(op10.cut_repeats(docs))
    assert len(got) == docs.count() and set(got[0]) == {*docs.columns, "removed_words", "removed_paragraphs", "copies_in"}
    want = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert all((r["doc_id"], r["text"]) in want for r in got if not r["removed_words"])
    assert {r["doc_id"] for r in got if 300 <= (r["doc_id"] or 0) < 310 and r["removed_words"]} == {301, 302, 303, 304, 305}
    assert op10.cut_repeats(empty(spark)).count() == 0


def test_words_are_hashed_together():
    random = np.random.default_rng(3)
    words = [bytes(random.choice(np.setdiff1d(np.arange(256), [32, *range(9, 14)]), size).astype(np.uint8)) for size in [*range(1, 60)] * 3]
    for text in (b"", b" \n", b"A", b"\x0b".join(words), b"  " + b" \t".join(words * 9) + b"\n"):
        starts, hashes = words_at(text)
        assert hashes.tolist() == word_hashes(text).tolist() == [xxhash.xxh3_64_intdigest(w) for w in text.lower().split()]
        assert [text[i:].split(None, 1)[0] for i in starts.tolist()] == text.split()


def test_op10_places_of_words_in_code_points():
    texts = ["", "über  \U0001f600 a b\n日本 x", "\x0b"]
    found = op10.Paragraphs(texts)
    for i, text in enumerate(texts):
        assert found.points(i).tolist() == [m.start() for m in re.finditer(WORD, text)] + [len(text)]


def test_op10_shingles_of_several_paragraphs():
    found = op10.Paragraphs(["a b c d e f a b c d e f\nx y\n1 2 3 4 5", "", "n o p q r s t"])
    for place, own in enumerate(found.shingles(np.arange(len(found.starts))).to_pylist()):
        words = found.hashes[found.starts[place] :][: found.sizes[place]]
        assert own == np.unique(rolled(words, op10.SHINGLE)).astype(np.int64).tolist()


def test_op10_first_of_a_key_over_many_batches(spark):
    same = "one two three four five six seven"
    docs = spark.createDataFrame([(i, same if i % 3 else f"{same} {i} {i + 1} {i + 2}") for i in range(60)], "doc long, text string").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = op10.first_links(docs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    groups = {}
    for r in op10.banded(docs).collect():
        groups.setdefault(r["key"], set()).add((r["doc"], r["pack"]))
    assert {(r["key"], tuple(r["member"]), tuple(r["first"])) for r in rows} == {(k, m, min(g)) for k, g in groups.items() for m in g if m != min(g)}
