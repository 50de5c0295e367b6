"""Periodic runs, main text of pages and ranked search."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, rows_of
from webloom.llm import op11_periodic_runs as op11
from webloom.llm import op12_main_text as op12
from webloom.llm import op13_lexical_search as op13

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs ----------------------------------------------------------------------------

def brute_runs(words, least=12):
    """Runs by walking along every period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            size = i + p - start
            if i > start and size >= max(least, 2 * p):
                found.setdefault((start, size), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def runs_of(texts, least=12):
    return [sorted(map(tuple, r.tolist())) for r in op11.runs_of([np.array(t, np.int64) for t in texts], least)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=60), max_size=6), st.sampled_from([1, 4, 12]))
def test_runs_of_small_alphabets(texts, least):
    assert runs_of(texts, least) == [brute_runs(t, least) for t in texts]


def test_runs_of_nested_and_planted_periods():
    r = random.Random(2)
    texts = []
    for n in (0, 1, 11, 12, 40, 200, 700):
        for kinds in (1, 2, 5, 400):
            words = [r.randrange(1, kinds + 1) for _ in range(n)]
            a = r.randrange(n) if n else 0
            p = 1 + (n - a) // (3 + r.randrange(8))
            texts += [words, words[:a] + [words[a + (i - a) % p] for i in range(a, n)]]
    short, long = [1], [1, 2]
    while len(long) < 900:  # a word with very many runs inside each other
        short, long = long, long + short
    texts += [long, [1, 1, 2] * 200 + [1, 1, 3] * 100, [5] * 700]
    assert runs_of(texts) == [brute_runs(t) for t in texts]


def test_agreement_of_places_is_exact():
    r = random.Random(4)
    texts = [[r.randrange(1, 3) for _ in range(150)] for _ in range(3)]
    words = np.array([0, *(x for t in texts for x in [*t, 0])], np.int64)
    levels = op11.recompress(words)
    assert len(levels[-1].symbols) == 2 * len(texts) + 1 and len(levels) < 60
    pairs = [(i, j) for k in range(3) for i in range(1 + k * 151, 151 * (k + 1), 7) for j in range(i + 1, 151 * (k + 1))]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))

    def plain(x, y, way):
        n = 0
        while words[x] == words[y] and words[x] != 0:
            x, y, n = x + way, y + way, n + 1
        return n

    assert op11.agreement(levels, i, j).tolist() == [plain(x, y, 1) for x, y in pairs]
    last = len(words) - 1
    assert op11.agreement(op11.mirrored(levels), last - i, last - j).tolist() == [plain(x, y, -1) for x, y in pairs]


def test_one_very_long_text():
    start = time.time()
    words = np.resize(np.arange(1, 4001), 300_000)
    assert op11.runs_of([words, np.ones(100_000, np.int64)])[0].tolist() == [[0, 300_000, 4000]]
    assert time.time() - start < 30


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    out = set()
    for s, size, p in runs:
        out.update(range(s + p, s + size))
    best = min(((-size, s, p) for s, size, p in runs), default=None)

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    return (doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in out)))


def test_periodic_runs_table(spark, tmp_path):
    docs = documents(spark).where("doc_id is null or doc_id != 406").unionByName(spark.range(1000, 1060).select(
        F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 90), x -> concat('w', hash(id, x) % 9)))").alias("text"),
        F.lit("s").alias("source"), F.lit(0.1).alias("score"), F.lit(1).alias("rank")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in rows_of(docs)), key=str)
    assert sum(r[1] > 0 for r in got) > 5
    clash = docs.withColumn("runs", F.lit("mine")).withColumn("n_words", F.lit(0))
    assert op11.periodic_runs(clash).select("runs").schema[0].dataType == op11.FIELDS[1].dataType
    assert op11.periodic_runs(empty(spark)).count() == 0


# --- main text -----------------------------------------------------------------------------------

BODY = "<p>The first paragraph, with commas, is long enough to count as text, surely.</p><p>Second one here, also with words.</p>"
LINES = "The first paragraph, with commas, is long enough to count as text, surely.\nSecond one here, also with words."
SIDE = "<p>Text beside it, which is rather long, with many, many, commas, to win, the, contest, of, points.</p>"
PAGES = {
    "named divs": (f"<head><title>T</title></head><body><div id=header><h1>Site</h1><ul class=menu><li><a href=/>Home</a></ul></div><div id=wrap><div class='content'>"
                   f"<h1>Title</h1>{BODY}<ul><li>one</li><li>two, <a href=x>link</a></li></ul></div><div class=sidebar>{SIDE}</div></div><div id=footer>foot</div>",
                   f"Title\n{LINES}\none\ntwo, link"),
    "no names": (f"<div><a href=1>Home</a> <a href=2>News</a> <a href=3>About us</a></div><div><h2>Title</h2>{BODY}{BODY}</div>"
                 "<div><ul><li><a href=a>Other story</a><li><a href=b>Another story</a><li><a href=c>Third</a></ul></div><div>Imprint</div>", f"Title\n{LINES}\n{LINES}"),
    "tables": (f"<table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>Title</h1>{BODY}</td></tr></table>", f"Title\n{LINES}"),
    "comments": (f"<main><article><header><h1>Title</h1></header>{BODY}<footer>tags</footer></article><section id=comments><article class=comment>{SIDE}{SIDE}</article></section></main>",
                 f"Title\n{LINES}"),
    "short article": (f"<div class='cookie-notice'>{SIDE}</div><div role=dialog>{SIDE}</div><article><h1>T</h1><p>x</p><div class=adBox>{SIDE}</div></article><aside>{SIDE}</aside>", "T\nx"),
    "blocks": ("<article><h1>T</h1><p>one<br>two &amp; three&nbsp;four &#8212; &lt;b&gt;\n\n five</p>direct <b>bold</b>ed<div>in div<span>s</span></div></article>",
               "T\none two & three four — <b> five\ndirect bolded\nin divs"),
    "empty article": (f"<nav>n</nav><article> </article><div class=ad>{SIDE}</div>", ""),
    "one form": (f"<form id=aspnet>{BODY}<input value=x><button>Go</button><select><option>a<option>b</select></form>", LINES),
    "form in article": ("<article><p>a</p><form><p>mail</p><input></form><p>b</p></article>", "a\nb"),
    "sections": (f"<article><h1>T</h1><section><h2>A</h2>{BODY}{BODY}</section><section><h2>B</h2><p>tiny</p></section></article>", f"T\nA\n{LINES}\n{LINES}\nB\ntiny"),
    "unclosed": ("<nav><ul><li>a<li>b</ul></nav><article><h1>T<p>para one<p>para <b>two<p>three", "T\npara one\npara two\nthree"),
    "raw": ("<article><p>a</p><script>if (a<b) document.write('<p>no</p>')</script><style>p {}</style><!-- <p>no</p> --><p>b</p><noscript><p>no</p></noscript><p hidden>no</p></article>", "a\nb"),
    "quotes": ("<article><p title='a > b' data-x=\"1 > 2\">ok</p><a href=\"x>oops</a><p>rest</p></article>", "ok\noops\nrest"),
    "cut tag": ("<article><p>a</p><p>b</p><a href='x", "a\nb"),
    "cut comment": ("<article><p>a</p><p>b</p><!-- c", "a\nb"),
    "plain": ("just words, no markup: 1 < 2", "just words, no markup: 1 < 2"),
    "empty": ("", ""), "blank": (" \n ", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, text = PAGES[name]
    assert op12.main_text(html) == text


def test_awkward_pages_take_linear_time():
    start = time.time()
    for html in ("<a href=\"x " * 100_000, "<p " * 200_000, "<" * 500_000, "<script>" * 50_000, "<div>" * 50_000 + "<b>x</i>" * 1000, "<ul><li>" * 30_000, "<!--" * 100_000):
        op12.main_text(html)
    assert op12.main_text("<div>" * 20_000 + "<p>deep, text</p>") == "deep, text"
    assert len(op12.main_text("<article>" + BODY * 20_000)) > 2_000_000
    assert time.time() - start < 30


def test_main_text_table(spark, tmp_path):
    rows = [(1, "u", PAGES["sections"][0], 3), (1, "u", PAGES["sections"][0], 3), (2, None, None, 4), (None, "v", "", None), (4, "w", "x" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = op12.op12_main_text(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        *[(1, "u", PAGES["sections"][1], len(PAGES["sections"][1]))] * 2, (2, None, "", 0), (None, "v", "", 0), (4, "w", "x" * 300_000, 300_000)], key=str)
    assert op12.extract_main_text(pages.limit(0)).count() == 0


# --- ranked search -----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k):
    found = [(i, Counter(brute_terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in found:
            m = 25 + 75 * n * n_docs // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, times in Counter(brute_terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, s[2], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@given(st.text(max_size=40))
def test_terms(text):
    assert [t.decode() for t in op13.terms(text)] == brute_terms(text)


@pytest.mark.parametrize("width", [2, 4096])
def test_search_against_brute_force(spark, monkeypatch, width):
    docs = documents(spark).withColumn("id", F.lit("mine")).withColumn("number", F.lit(1)).withColumn("score", F.lit("x"))
    own = rows_of(docs)
    items = [(n, " ".join((own[n]["text"] or "none").split()[:1] * 3 + (own[n + 20]["text"] or "").split()[:30])) for n in range(20)]
    items += [(90, None), (91, ""), (92, "--- !!"), (93, "nowhere"), (None, "river1 river2 river3"), (95, "RIVER1, river1; éé")]
    asked = spark.createDataFrame([(*i, 1, "s") for i in items], "item_id long, text string, rank int, score string")
    got = op13.lexical_search(docs, asked, k=4, width=width).select("item.item_id", "rank", "id", "score")
    brute = brute_search([(r["doc_id"], r["text"]) for r in own], items, 4)
    assert sorted(map(tuple, got.collect()), key=str) == brute
    monkeypatch.setattr(op13, "BLOCK_BYTES", 500)  # many blocks of queries
    again = op13.lexical_search(docs, asked.where("item_id < 5 or item_id > 90"), k=4, width=width).select("item.item_id", "rank", "id", "score")
    assert sorted(map(tuple, again.collect()), key=str) == [b for b in brute if b[0] is not None and (b[0] < 5 or b[0] > 90)]
    assert op13.lexical_search(docs.limit(0), asked).count() == 0
    assert op13.lexical_search(docs, asked.limit(0)).count() == 0


def test_bounds_spare_most_exact_scores():
    r = random.Random(1)
    texts = [" ".join(f"w{int(r.expovariate(0.002))}" for _ in range(120)) for _ in range(2000)]
    block, codes = op13.Block({}, [], [], []), []
    for q in range(10):
        c = Counter(op13.terms(" ".join(texts[q * 50].split()[:25])))
        block.numbers.append(q)
        block.term_ids.append(np.array([block.vocabulary.setdefault(t, len(block.vocabulary)) for t in c]))
        block.times.append(np.array(list(c.values())))
    codes = Counter(t for x in texts for t in set(op13.terms(x)))
    df = np.array([codes[t] for t in block.vocabulary])
    searcher = op13.Searcher(block, op13.weights(len(texts), df), len(texts), 120 * len(texts), op13.WIDTH, 10)
    for at in range(0, len(texts), 500):
        searcher.add(pa.array(range(at, at + 500)), [op13.terms(t) for t in texts[at : at + 500]])
    assert [b[0][2] for b in searcher.best] == [q * 50 for q in range(10)]
    assert searcher.scored < 0.3 * len(texts) * 10
