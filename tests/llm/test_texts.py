"""Chat windows, quality rules, fingerprints, classifier and URL filters."""

import dataclasses
import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, rows_of
from webloom.llm import op1_chat_format as op1
from webloom.llm import op4_quality_rules as op4
from webloom.llm import op5_fingerprints as op5
from webloom.llm import op7_quality_classifier as op7
from webloom.llm import op8_url_filters as op8


def conversations(spark):
    r = random.Random(5)
    odd = ["</turn>\n### assistant: ", "\\l \\b \\h \\\\", "#<\\", "", None, "a: b", "\u00e9" * 30]
    rows = []
    for conv in [*range(12), None]:
        if conv is None or conv % 2:
            rows.append((conv, 0, "system", "be brief " * r.randrange(1, 90)))
        for t in range(1, r.randrange(3, 40)):
            rows.append((conv, t, ["user", "assistant", None, "odd: role#"][r.choice([0, 0, 1, 1, 2, 3])], r.choice([r.choice(odd), "word " * r.randrange(1, 400)])))
    rows += [(3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (4, None, "user", "no turn"), (50, 0, "system", "alone")]
    rows += [(60, t, "user" if t % 2 else "assistant", f"turn {t} " * 9) for t in range(1500)]
    return spark.createDataFrame([(*row, "x") for row in rows], "conv_id long, turn long, role string, text string, window string").repartition(4)


def by_turn(rows):
    out = {}
    for r in rows:
        out.setdefault(r["conv_id"], []).append(r)
    for turns in out.values():
        turns.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    return out


def test_windows_read_back_and_keep_to_the_budget(spark):
    turns = conversations(spark)
    windows = op1.format_windows(turns, budget=512, history_tokens=100)
    read = {(r["conv_id"], r["window"]): r for r in rows_of(op1.read_back(windows))}
    raw = {(r["conv_id"], r["window"]): r for r in rows_of(windows)}
    for conv, own in by_turn(rows_of(turns)).items():
        numbers = sorted(w for c, w in read if c == conv)
        assert numbers == list(range(1, len(numbers) + 1))
        seen = [(t["role"], t["text"]) for w in numbers for t in read[conv, w]["turns"]]
        assert seen == [(r["role"] or "", r["text"] or "") for r in own]
        assert [x for w in numbers for x in read[conv, w]["loss"]] == [r["text"] or "" for r in own if r["role"] == "assistant"]
        leading = own[0]["role"] == "system"
        for w in numbers:
            row = raw[conv, w]
            fresh = len(read[conv, w]["turns"])
            assert row["n_tokens"] <= 512 or fresh == 1 or own[0]["role"] == "system" and len(own[0]["text"]) > 500
            assert row["n_repeated"] <= 5
            if leading and w > 1:
                assert row["formatted"].startswith("### system: " + (own[0]["text"]))
    assert max(w for c, w in read if c == 60) > 20
    assert op1.format_windows(turns.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="\\<#:lbhc/>turn \n", max_size=30))
def test_escapes_are_reversible(text):
    coded = text
    for plain, code in op1.ESCAPES:
        coded = coded.replace(plain, code)
    assert "<" not in coded and "#" not in coded
    back = coded
    for plain, code in reversed(op1.ESCAPES):
        back = back.replace(code, plain)
    assert back == text


def brute_rules(text, limits):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = sum(map(len, words))

    def inside(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        hit = set()
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                hit.update(range(i, i + n))
        return hit

    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = [x for i, x in enumerate(lines) if x in lines[:i]]
    dup_chars = sum(len(w) for x in dups for w in re.findall(r"[^\x20\x09-\x0D]+", x))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    repeat = len(inside(5))
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    bad = failed or symbols > limits.symbols * len(words) or len(dups) > limits.lines * len(lines) or dup_chars > limits.line_chars * chars
    bad = bad or any(sum(len(words[i]) for i in inside(n)) / chars > most for n, most in limits.ngrams)
    for n, most in limits.tops:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        bad = bad or any(grams.count(g) > 1 and grams.count(g) * sum(map(len, g)) / chars > most for g in set(grams))
    return len(words), chars, symbols, len(dups), repeat, failed, not bad


TEXTS = st.lists(st.sampled_from(["a", "b", "cc", "\n", " ", "dd#", "\u00e9 ", "a b c d e f\n", "\x0b", "\u00a0"]), max_size=80).map(" ".join)


@settings(max_examples=120, deadline=None)
@given(TEXTS)
def test_quality_rules_against_counting(text):
    assert op4.Meter(op4.Limits()).measure(text)[:7] == brute_rules(text, op4.Limits())


def only(text, rule):
    """What the base rules and all rules but ``rule`` let through, and ``rule`` rejects."""
    limits = op4.Limits()
    free = dataclasses.replace(limits, **{rule: 9.0 if rule in ("lines", "line_chars", "symbols") else ()})
    with_rule, without = op4.Meter(limits).measure(text), op4.Meter(free).measure(text)
    return not with_rule[5] and not with_rule[6] and without[6]


def test_each_rule_rejects_what_the_base_rules_keep():
    own = [f"word{i}" for i in range(100)]
    phrase = ["anniversary", "celebration"]
    assert only(" ".join(own[:10] + phrase + own[10:20] + phrase + own[20:30] + phrase + own[30:40] + phrase), "tops")
    assert only(" ".join(own[:90] + own[:9]), "ngrams")
    assert only("\n".join(x for i in range(20) for x in ("x", " ".join(own[3 * i : 3 * i + 3]))), "lines")
    assert only(" ".join(own) + " " + "#" * 12, "symbols")


def test_hash_collisions_are_settled_by_the_words():
    codes = np.zeros(30, np.uint64)
    codes[:] = np.arange(30)
    assert len(op4.repeated(codes, np.arange(20), 5)) == 0


def test_quality_rules_table(spark):
    got = rows_of(op4.rate(documents(spark).withColumnRenamed("rank", "kept")))
    assert all(tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
               == brute_rules(r["text"], op4.Limits()) for r in got if len(r["text"] or "") < 5000)
    assert op4.rate(empty(spark)).count() == 0


def test_fingerprints_against_sets(spark):
    docs = documents(spark)
    got = rows_of(op5.compare_edits(docs, ranges=4))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    want = []
    for i, (known, doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][2]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        a, b, c = (set(op5.paragraphs(t).tolist()) for t in (text, edited, after))
        near = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
        want.append((doc if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near))
    key = lambda t: tuple(str(x) for x in t)
    have = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    texts = {}
    for r in docs.collect():
        if r["doc_id"] is not None and r["doc_id"] not in (10, 11):
            texts[r["doc_id"]] = r["text"] or ""
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    for a in texts:
        for b in texts:
            assert (texts[a] == texts[b]) == (prints[a] == prints[b]) or set(op5.paragraphs(texts[a])) == set(op5.paragraphs(texts[b]))
    assert op5.compare_edits(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=80, unique=True), st.integers(0, 80), st.integers(0, 80))
def test_peeling_recovers_any_difference(keys, i, j):
    a, b = np.array(sorted(keys[: max(i, j)]), np.uint64), np.array(sorted(keys[min(i, j) :]), np.uint64)
    union = set(a.tolist()) | set(b.tolist())
    want = len(set(a.tolist()) & set(b.tolist())) / len(union) if union else 1.0
    assert op5.likeness([a], [b])[0] == want


def test_nearest_neighbour_votes_against_all_cosines():
    r = np.random.default_rng(1)
    model = op7.Model(np.ones(op7.DIMENSIONS, np.float32), r.normal(size=(op7.DIMENSIONS, 8)).astype("f4"), op7.unit(r.normal(size=(60, 8)).astype("f4")),
                      (r.random(60) > 0.5).astype("f4"))
    found = [op7.Features().of(t) for t in ("some words here", "", "AND SHOUTING!! THERE!!", "x " * 400)]
    latent = model.latent(found)
    for vector, score in zip(latent, model.scores(found, k=9, block=2), strict=True):
        cosine = sorted(((float(v @ vector), float(y)) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:9]
        weights = [max(c, 1e-3) ** 4 for c, _ in cosine]
        assert abs(score - sum(w * y for w, (_, y) in zip(weights, cosine, strict=True)) / sum(weights)) < 1e-4


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op7.op7_quality_classifier(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_classifier_on_odd_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(10, 1), (10, 0), (406, 0), (405, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    model = op7.fit(docs, labels)
    got = rows_of(op7.classify(docs, model))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert op7.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in rows_of(op7.classify(docs, None))} == {0.5}
    assert op7.classify(empty(spark), model).count() == 0


URLS = [None, "", "no scheme", "http://A.B.net", "http://net/", "https://x.example.net/en/1", "https://example.net/en", "https://Example.NET/en/?q=1", "http://notexample.net/en/",
        "http://example.com/de/x#y", "http://shop.example.com/de", "http://a.org/fr/1", "http://aorg/fr/1", "http://org/fr/1?u=http://b.net/", "ftp://h.com?x=1&y=2", "http://h.com#f", "x://", "a://b.net/c://d"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = []
    for verdict, text in op8.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_urls_and_rules_against_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, suffix_share double")
    got = rows_of(op8.judge(pages, trees=2))
    assert len(got) == len(URLS) * 2
    for r in got:
        host, path = brute_url(r["url"])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
        assert r["suffix_share"] == 1.0
    assert op8.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in rows_of(op8.judge(pages, rules=[]))} == {"allow"}


def test_trees_find_what_the_rules_say_of_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rules = [op8.Rule("block", "example.net/"), op8.Rule("allow", "example.org/")]
    even = F.xxhash64("url") % 2 == 0
    host, path = op8.host_and_path(F.col("url"))
    # urls that no rule fits any more, since their host gets a further part, must be judged like their like
    held = pages.where(even).withColumn("url", F.regexp_replace("url", r"example\.(net|org)", "example2.$1"))
    got = op8.judge(pages.where(~even).unionByName(held), rules=rules).where("rule IS NULL AND (host LIKE '%.net' OR host LIKE '%.org')").collect()
    assert len(got) > 40
    assert np.mean([(r["verdict"] == "block") == r["host"].endswith(".net") for r in got]) > 0.9


def test_host_entropy(spark):
    row = spark.createDataFrame([("aabb",), ("",)], "h string").select(op8.entropy(F.col("h")).alias("e")).collect()
    assert [r["e"] for r in row] == [1.0, 0.0]
