"""Approximate links against the exact pairs, and their number on a template with many variants."""

import random

from pyspark.sql import functions as F

from webloom.operators import similar as M

FIELDS = ["title", "text"]


def records(spark, families, variants, seed=5):
    r, rows = random.Random(seed), []
    for f in range(families):
        words = [f"w{f}_{i}" for i in range(60)]
        for _ in range(variants):
            own = list(words)
            for _ in range(r.randrange(5)):
                own[r.randrange(60)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), f"title {f}", " ".join(own)))
    rows += [(len(rows) + i, "", "") for i in range(3)] + [(len(rows) + 3 + i, f"only title {i}", None) for i in range(3)]
    return spark.createDataFrame(rows, "data_id long, title string, text string").repartition(4)


def roots(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return find


def test_links_are_pairs_and_few_are_missed(spark):
    df = records(spark, 40, 6)
    exact = {(r.id1, r.id2): round(r.score, 9) for r in M.similar_pairs(df, FIELDS).collect()}
    links = {(r.id1, r.id2): round(r.score, 9) for r in M.similar_links(df, FIELDS).collect()}
    assert len(exact) > 300 and all(exact.get(p) == s for p, s in links.items())
    find = roots(links)
    assert sum(find(a) == find(b) for a, b in exact) >= 0.9 * len(exact)


def test_a_template_gives_a_star(spark):
    df = records(spark, 1, 300)
    links = [(r.id1, r.id2) for r in M.similar_links(df, FIELDS).collect()]
    bands, _ = M.tune_bands(2 * 0.85 - 1, 0.95)
    assert len(links) <= 2 * bands * 300 < 300 * 299 / 4
    find = roots(links)
    assert sum(find(i) == find(0) for i in range(300)) >= 0.97 * 300
    assert M.similar_links(df.limit(0), FIELDS).count() == 0


def test_bands_find_what_they_promise():
    for similarity, recall in ((0.7, 0.95), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = M.tune_bands(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall
    assert len(set(M.hash_factors(100))) == 100


def test_marks_rule_out_no_similar_pair_and_most_others(spark):
    """The words of a pair are moved only where marks leave it possible; equal, empty and large sets included."""
    import random

    random.seed(11)
    pool = [f"w{i}" for i in range(9000)]
    sets = [random.sample(pool, n) for n in (0, 0, 1, 1, 5, 40, 300, 300, 2500, 6000)]
    sets += [s[: len(s) * 9 // 10] + random.sample(pool, len(s) // 20) for s in sets] + [sets[5]]
    df = spark.createDataFrame([(i, sorted(set(s))) for i, s in enumerate(sets)], "id int, words array<string>")
    marks = M.word_marks(F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(M.MARKS)).cast("int")))
    each = df.select("id", F.struct(F.size("words").alias("n"), marks.alias("marks")).alias("c"))
    both = each.select(F.col("id").alias("i"), F.col("c").alias("a")).crossJoin(each.select(F.col("id").alias("j"), F.col("c").alias("b")))
    ruled_out = 0
    for r in both.select("i", "j", M.most_similar(F.col("a"), F.col("b")).alias("most")).collect():
        x, y = set(sets[r.i]), set(sets[r.j])
        true = len(x & y) / len(x | y) if x | y else 1.0
        assert r.most >= true - 1e-12
        ruled_out += true < 0.3 and r.most < 0.7
    assert ruled_out > 300


def test_pairs_that_cannot_be_similar_carry_no_words(spark):
    """Records that share a rare word and little else meet, but their words stay where they are."""
    rows = [(i, "same title", " ".join([f"a{i % 20}", *(f"x{i}y{k}" for k in range(30))])) for i in range(200)]
    rows += [(1000 + i, "same title", " ".join([*(f"x{i}y{k}" for k in range(30)), "more"])) for i in range(10)]
    df = spark.createDataFrame(rows, "data_id int, title string, text string")
    pairs = M.similar_pairs(df, ["title", "text"], 0.85)
    assert {(r.id1, r.id2) for r in pairs.collect()} == {(i, 1000 + i) for i in range(10)}
    # the join that the marks decide lies below those with digests and words
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    marks = next(line for line in plan if "bit_count" in line)
    words = next(line for line in plan if "array_intersect" in line)
    assert plan.index(words) < plan.index(marks) and len(marks.split("+-")[0]) > len(words.split("+-")[0])


def test_pairs_of_keys_that_repeat_come_as_often_as_their_rows(spark):
    text = " ".join(f"x{k}" for k in range(30))
    df = spark.createDataFrame([(1, "t", text), (1, "t", text), (2, "t", text + " more"), (2, "t", text + " more")], "data_id int, title string, text string")
    assert [(r.id1, r.id2) for r in M.similar_pairs(df, ["title", "text"], 0.85).collect()] == [(1, 2)] * 4


def test_links_move_words_only_where_marks_allow_it(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(1, "t", "a b c d e f g h"), (2, "t", "a b c d e f g h i"), (3, "t", "x y z w v u q r"), (3, "t", "a b c d e f g h"), (4, "", ""), (5, "t", None)]
    records = spark.createDataFrame(rows, "data_id long, title string, text string").fillna("")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "id1 long, id2 long")
    moved, both = [], M._of_both
    monkeypatch.setattr(M, "_of_both", lambda p, each, key, what: (moved.append((what, p.count())) or both(p, each, key, what)))
    got = sorted((r.id1, r.id2, round(r.score, 6)) for r in M._scored(pairs, records, ["title", "text"], 0.85, "data_id").collect())
    assert got == [(1, 2, round((1 + 8 / 9) / 2, 6)), (1, 3, 0.0), (1, 3, 0.5), (1, 3, 1.0), (4, 5, 0.0)]
    assert moved == [("marks", 3), ("body", 2)]


def test_band_keys_are_least_hashes(spark):
    from hashlib import md5

    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 7, 9000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.k for r in df.orderBy("i").select(M.band_keys(M.tokens(F.col("t")), 2, 3).alias("k")).collect()]
    for text, keys in zip(texts, got):
        bases = [int(md5(w.encode()).hexdigest()[:7], 16) for w in text.split()]
        least = [min(((h * a + b) % M.HASH_PRIME for h in bases), default=None) for a, b in M.hash_factors(6)]
        assert keys == ([f"{b}|" + "|".join(map(str, least[3 * b:3 * b + 3])) for b in range(2)] if bases else None)


def brute_force(rows, fields, threshold):
    """Of rows (key, texts): copies, and near pairs of the rows whose key stands for some content."""
    from collections import Counter

    rows = [(k, tuple(t or "" for t in texts)) for k, texts in rows]
    first = {}
    for k, texts in rows:
        if k is not None:
            first[texts] = min(first.get(texts, k), k)
    got = Counter((first[x], k, 1.0) for k, x in rows if k is not None and k != first[x])
    chosen = [(k, x, [set(t.lower().split()) for t in x]) for k, x in rows if k in first.values()]
    for k, x, u in chosen:
        for j, y, v in chosen:
            if k < j and any(u):
                score = sum(1.0 if a == b else len(p & q) / len(p | q) if p | q else 0.0 for a, b, p, q in zip(x, y, u, v)) / fields
                if score >= threshold:
                    got[(k, j, round(score, 6))] += 1
    return got


def test_pairs_by_every_field_equal_brute_force(spark, monkeypatch):
    """Words of many records, blank fields, missing and repeated keys, hashes that clash and homes of several blocks."""
    from collections import Counter

    for n, (hot, usage, cell, k) in enumerate([(1, 64, 150, 2), (3, 1 << 10, 1000, 3), (10**6, 1 << 22, 10**6, 1)]):
        monkeypatch.setattr(M, "HOT_WORDS", hot)
        monkeypatch.setattr(M, "USAGE", usage)
        monkeypatch.setattr(M, "CELL_WORDS", cell)
        r = random.Random(n)
        names = ["title", "rid", "key"][:k] if k > 1 else ["text"]
        bases = [[[f"{f}{r.randrange(60)}" for _ in range(r.randrange(1, size))] for f, size in zip("abc", (6, 40, 9) if k > 1 else (40,))] for _ in range(12)]
        rows = []
        for i in range(220):
            texts = [list(x) for x in r.choice(bases)[:k]]
            if r.random() < 0.8:
                x = texts[k > 1]
                x[r.randrange(len(x))] = r.choice(["the", "The", f"x{r.randrange(99)}"])
            texts = [" ".join(x) for x in texts]
            if r.random() < 0.3:
                texts[0] = r.choice(["of the", "", " ", "."])
            if r.random() < 0.1:
                texts[k > 1] = r.choice(["", None])
            rows.append((None if r.random() < 0.02 else r.randrange(200), texts))
        df = spark.createDataFrame([(k, *x) for k, x in rows], "data_id long, " + ", ".join(f"{x} string" for x in names)).repartition(3)
        threshold = 0.9 if k == 3 else 0.85
        got = Counter((p.id1, p.id2, round(p.score, 6)) for p in M.similar_pairs(df, names, threshold).collect())
        assert len(got) > 300 and got == brute_force(rows, k, threshold)


def test_pairs_need_little_disk(spark, monkeypatch):
    """What is written is smaller than the texts, pairs meet a few times, not by each word they share, and words of lone records stay."""
    import os

    r = random.Random(3)
    rows = []
    for f in range(40):  # four families of 30 and many lone records, all of one common title
        words = [f"w{f}v{r.randrange(10**6)}" for _ in range(200)]
        for _ in range(30 if f < 4 else 6):
            if f >= 4:
                words = [f"w{r.randrange(10**6)}" for _ in range(200)]
            own = list(words)
            own[r.randrange(200)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), f"common title {f % 2}", " ".join(own)))
    monkeypatch.setattr(M, "HOT_WORDS", 20)
    tables, met, written, candidates = [], [], M.written, M._candidates
    monkeypatch.setattr(M, "written", lambda df, **options: (tables.append(written(df, **options)), tables[-1])[1])
    monkeypatch.setattr(M, "_candidates", lambda *a: (met.append(candidates(*a)), met[-1])[1])
    df = spark.createDataFrame(rows, "data_id long, title string, text string").repartition(2)
    pairs = M.similar_pairs(df, FIELDS, 0.85)
    size = sum(os.path.getsize(path.removeprefix("file://")) for t in tables for path in t.inputFiles())
    assert size < 0.8 * sum(len(t) + len(x) for _, t, x in rows)
    number = pairs.count()
    assert number == 4 * 30 * 29 // 2
    assert met[0].count() <= 4 * number  # a pair shares some sixty of the words that records meet by
    assert M._named(tables[0], tables[1]).count() == 4 * 30
    assert sum(M._cells(tables[1]).select(F.size("mates").alias("n")).toPandas().n) == number
