"""Unit rows, properties and brute-force checks."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import cleaning as C
from webloom.functions import markup, protect, text as X, urls as U, validate as V
from webloom.operators import analytics as A
from webloom.operators import cleaning as O
from webloom.operators import links as L
from webloom.operators import pages as P
from webloom.operators import records as R
from webloom.operators import similar as M
from webloom.sources import sinks as W


def one(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r.r) if hasattr(r.r, "__fields__") else r.r for r in df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


def test_cleaning_edges(spark):
    assert one(spark, ["", " A@B.co ", "a@b.c1", "none"], C.clean_email) == [("", 0.0), ("a@b.co", 1.0), ("a@b.c1", 0.7), ("none", 0.2)]
    assert one(spark, ["+1 (555) 010-9999", "0123-4567", "12", ""], C.clean_phone) == [("+15550109999", 1.0), ("01234567", 0.8), ("12", 1.0), ("", 0.0)]
    assert one(spark, ["//x.org/a", "x.org", "word", "http://"], C.clean_url) == [("https://x.org/a", 1.0), ("https://x.org", 1.0), ("word", 0.4), ("http://", 0.4)]
    assert one(spark, ["  ", "ab", "a  b c", "12345", "ﬁne"], C.clean_text) == [("", 0.0), ("ab", 0.5), ("a b c", 0.9), ("12345", 0.6), ("fine", 0.9)]
    assert one(spark, ["USD 1,234.5", ",", "free", "7"], C.clean_price) == [("$1234.50", 0.9), (",", 0.3), ("free", 0.1), ("$7.00", 0.9)]


def test_clean_record_properties(spark):
    rows = [(1, "a@b.co", None, "x  y"), (2, None, None, None), (3, "", "", "")]
    df = spark.createDataFrame(rows, "data_id int, email string, phone string, text string")
    out = {r.data_id: r for r in O.clean(df, ["email", "phone", "text"]).collect()}
    assert out[1].text == "x y" and out[1].corrected and 0 <= out[1].quality <= 1
    assert out[2].field_scores == {} and out[2].quality == pytest.approx(0.25) and not out[2].keep
    assert out[3].quality == pytest.approx(0.5)
    chained = O.clean(df, ["email"], [O.CleaningRule("text", "text_cleaning"), O.CleaningRule("email", "email_validation")], chained=True)
    assert chained.where("data_id = 1").first().email == "a@b.co"
    unknown = O.clean(df, ["email"], [O.CleaningRule("email", "no_such_rule")]).where("data_id = 1").first()
    assert unknown.field_scores == {"email": 0.5}


def test_duplicates_add_up_and_dedup_is_idempotent(spark):
    rows = [(i, f"t{i % 7}" if i % 3 else "same", i) for i in range(300)]
    df = spark.createDataFrame(rows, "data_id int, text string, extracted_at int")
    kept = O.keep_first(df, ["text"], ["extracted_at", "data_id"])
    again = O.keep_first(kept.drop("content_hash"), ["text"], ["extracted_at", "data_id"])
    marked = O.split_duplicates(df, ["text"], ["extracted_at", "data_id"])
    assert kept.count() == again.count() == 8
    assert marked.where("duplicate").count() + kept.count() == 300
    assert {r.data_id for r in marked.where("not duplicate").collect()} == {r.data_id for r in kept.collect()}


def test_similar_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 40))] for _ in range(60)]
    rows = []
    for i in range(260):
        words = list(rnd.choice(base))
        if words and rnd.random() < 0.7:
            words[rnd.randrange(len(words))] = "common" if rnd.random() < 0.3 else f"w{rnd.randrange(400)}"
        title = " ".join(words[:4]) if rnd.random() < 0.8 else "hot title"
        rows.append((i, title, " ".join(words) if rnd.random() < 0.9 else rnd.choice(["", " "])))
    df = spark.createDataFrame(rows, "data_id long, title string, text string")
    got = {(r.id1, r.id2): r.score for r in M.similar_pairs(df, ["title", "text"], 0.85).collect()}

    def field(a, b):
        if a == b:
            return 1.0
        x, y = set(a.lower().split()), set(b.lower().split())
        return len(x & y) / len(x | y) if x | y else 0.0

    first, want = {}, {}
    for i, t, x in rows:
        if (t, x) in first:
            want[(first[(t, x)], i)] = 1.0
        else:
            first[(t, x)] = i
    reps = sorted((i, t, x) for (t, x), i in first.items())
    for n, (i, t, x) in enumerate(reps):
        for j, u, y in reps[n + 1:]:
            s = (field(t, u) + field(x, y)) / 2
            if s >= 0.85:
                want[(i, j)] = s
    assert len(want) > 50
    assert set(got) == set(want)
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def test_similar_pairs_with_blank_driver(spark):
    rows = [(i, f"a b c d e f g h i j k l m n o p {i % 3}", ["", " "][i % 2]) for i in range(6)]
    df = spark.createDataFrame(rows, "data_id long, title string, text string")
    got = {(r.id1, r.id2) for r in M.similar_pairs(df, ["title", "text"], 0.85).collect()}
    assert got == {(i, j) for i in range(6) for j in range(i + 1, 6) if i % 2 == j % 2}


def test_selectors_and_tolerant_reading():
    reader = markup.PageReader(P.UNWANTED, P.MAIN, {"x": "ul.menu li"}, "priority")
    page = reader("<p>one<p>two <b>bold<div class='ad'>no</div><ul class='menu x'><li>a<li>b</ul><table><tr><th>h<tr><td>1<td>2</table>&amp; &lt;end<br")
    assert page["paragraphs"] == ["one", "two bold"]
    assert dict(page["custom"])["x"] == ["a", "b"]
    assert page["tables"] == [{"caption": None, "headers": ["h"], "rows": [["1", "2"]]}]
    assert "no" not in page["text"].split() and "& <end" in page["text"]
    for html in ("", "<", "<<>>", "</p>", "<p", "<a href=>x</a>", "<!--", "<script>", "<title>", "<ul><li><table><td><p>" * 50):
        assert reader(html)["error"] is None
    with pytest.raises(ValueError):
        markup.compile_selector("a >> b!")


def test_extract_keeps_failed_rows(spark):
    df = spark.createDataFrame([(1, "http://x.org/", None), (2, "http://x.org/", "<title>t</title><p>long enough text</p>")], "page_id long, url string, raw_html string")
    out = {r.page_id: r for r in P.extract_pages(df).collect()}
    assert out[1].error == "no content" and out[1].paragraphs == [] and out[2].title == "t" and out[2].error is None


def test_page_confidence_compat(spark):
    html = "<title>t</title><main><h1>head</h1><p>" + "long text " * 20 + "</p></main>"
    df = P.extract_pages(spark.createDataFrame([(1, "http://x.org/", html)], "page_id long, url string, raw_html string"))
    row = df.select(P.page_confidence().alias("a"), P.page_confidence(compat=True).alias("b")).first()
    assert row.a == pytest.approx(0.85) and row.b == pytest.approx(0.7)


@pytest.mark.parametrize("ref", ["a", "../a", "./a/../b", "/x/./y", "?q", "#f", "//h/p", "http://z/..", "", "../../../a", "..", "a/b/..", "/..", "mailto:x@y", "a?x=../b"])
def test_resolve_like_the_standard_library(spark, ref):
    from urllib.parse import urljoin

    for base in ("http://h.org/a/b/c?x=1#y", "https://h.org", "http://h.org/dir/"):
        assert one(spark, [ref], lambda v: U.resolve(F.lit(base), v)) == [urljoin(base, ref)]


def test_crawl_is_first_in_first_out(spark):
    rnd = random.Random(3)
    pages = [f"p{i}" for i in range(60)]
    links = [(a, rnd.choice(pages + ["gone"]), k + 1) for a in pages for k in range(rnd.randrange(5))]
    links = [(a, b, k) for n, (a, b, k) in enumerate(links) if a != b and all((a, b) != (x, y) for x, y, _ in links[:n])]
    got = L.crawl_rounds(
        spark.createDataFrame([(1, "p0"), (2, "p5")], "crawl_id int, url string"),
        spark.createDataFrame(links, "page_url string, url string, rank int"), spark.createDataFrame([(p,) for p in pages], "url string"), max_pages=8)
    got = {c: [r.url for r in got.where(F.col("crawl_id") == c).orderBy("position").collect()] for c in (1, 2)}
    for crawl, start in ((1, "p0"), (2, "p5")):
        queue, read = [start], []
        while queue:
            url = queue.pop(0)
            if url in read or url not in pages:
                continue
            read.append(url)
            if len(read) < 8:
                queue += [b for a, b, k in sorted(links, key=lambda x: x[2]) if a == url and b not in read and b not in queue]
        assert got[crawl] == read


def test_crawl_takes_seeds_as_given(spark):
    seeds = spark.createDataFrame([(1, "p9", 1), (1, "p2", 2), (1, "p5", 3)], "crawl_id int, url string, rank int")
    links = spark.createDataFrame([("p2", "p1", 1), ("p9", "p2", 1), ("p9", "p0", 2)], "page_url string, url string, rank int")
    pages = spark.createDataFrame([(f"p{i}",) for i in range(10)], "url string")
    got = [r.url for r in L.crawl_rounds(seeds, links, pages).orderBy("position").collect()]
    assert got == ["p9", "p2", "p5", "p0", "p1"]


def test_seen_table_appends_and_joins_in_place(spark):
    seen = L.SeenTable(spark, ["url"], buckets=4)
    urls = spark.range(100).select(F.concat(F.lit("u"), "id").alias("url"), "id")
    seen.add(urls.where("id < 40"))
    files = set(seen.rows().inputFiles())
    seen.add(seen.unseen(urls.where("id < 70")))
    assert files < set(seen.rows().inputFiles())
    left = seen.unseen(urls)
    assert sorted(r.id for r in left.collect()) == list(range(70, 100)) and seen.rows().count() == 70
    plan = left._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # the stored side is read bucket by bucket: no exchange stands between it and the join
    stored = final[final.index("FileScan parquet spark_catalog.default.seen_"):] if "spark_catalog" in final else final
    assert "Bucketed: true" in final and final.count("Exchange hashpartitioning") <= 1 and "SelectedBucketsCount: 4 out of 4" in stored
    seen.drop()


def test_json_nodes_have_paths_and_sizes(spark):
    df = spark.createDataFrame([(1, '{"b":[1,{"c":"x"}],"a":null}'), (2, "3"), (3, "{"), (4, None)], "i int, j string")
    got = sorted((r.i, tuple(r.path), r.depth, r.name, r.kind, r.size, r.value) for r in V.json_nodes(df, "i", "j").collect())
    assert got == [
        (1, (), 0, None, "object", 2, None), (1, (0,), 1, "a", "null", None, None), (1, (1,), 1, "b", "array", 2, None), (1, (1, 0), 2, None, "number", None, "1"),
        (1, (1, 1), 2, None, "object", 1, None), (1, (1, 1, 0), 3, "c", "string", None, "x"), (2, (), 0, None, "number", None, "3")]
    assert V.json_nodes(df, "i", "j", deepest=1).count() == 4
    odd = spark.createDataFrame([(i, v) for i, v in enumerate([
        "[" * 2000 + "]" * 2000, "[" * 2000, '["' + "[" * 50 + '"]', '{"a":1,"a":2}', '{"x":{"drop table":[[[[[[[[[[[[1]]]]]]]]]]]]}}', '"a\\\\u0000b\\u0000c"', ""])], "i int, j string")
    out = [r for r in V.check_json(odd, "j").orderBy("i").collect()]
    assert ["depth" in (r.error or "") for r in out[:3]] == [True, False, False]
    assert "dangerous" in out[2].error and "valid JSON" in out[1].error and "valid JSON" in out[3].error and "dangerous" in out[4].error and "valid JSON" in out[6].error
    assert V.check_json(odd.limit(0), "j").count() == 0


def test_json_checks(spark):
    deep = "[" * 12 + "]" * 12
    wide = "{" + ",".join(f'"k{i}":1' for i in range(101)) + "}"
    values = ['{"a":[1,"<b"]}', deep, wide, "[" + "1," * 1000 + "1]", "{", None, '{"a":"drop it"}', '{"x":"1 < 2"}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, j string")
    out = [(r.is_valid, r.error, r.value) for r in V.check_json(df, "j").orderBy("i").collect()]
    assert [o[0] for o in out[:6]] == [True, False, False, False, False, True]
    assert "depth" in out[1][1] and "keys" in out[2][1] and "large" in out[3][1] and "not valid" in out[4][1]
    assert out[0][2] == '{"a": [1, "&lt;b"]}' and out[6][0] is False and out[7][0] is True


def test_words_respect_letters_around_them(spark):
    got = one(spark, ["The été cat's dog_1 CAT abc123 xyz", "", None], lambda v: F.array_join(X.words(v), " "))
    assert got == ["the cat cat xyz", "", None]


def test_pages_do_not_overlap(tables):
    jobs = tables.jobs()
    seen = [r.job_id for p in range(1, 6) for r in R.page(jobs, "priority", "asc", p, 100, "job_id").collect()]
    assert len(seen) == len(set(seen)) == 500
    with pytest.raises(ValueError):
        R.page(jobs, "priority", "up", 1, 10)
    with pytest.raises(ValueError):
        R.filter_records(tables.records(), date_from="2024-02-01", date_to="2024-01-01")


def test_filters_reach_the_scan(tables):
    plan = R.by_key(tables["documents"], "doc_id", 5).select("doc_id", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan and "text" not in plan.split("ReadSchema")[1]
    recent = R.recent(tables["events"], "ts", "2024-01-31", hours=24)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in recent


def test_leaving_the_host_agrees_with_resolving(spark):
    refs = ["a", "//h.org/x", "//H.org", "//z.org", "http://h.org/", "https://z.org", "/p", "?q", "#f", "mailto:a@b", ""]
    direct = one(spark, refs, lambda v: U.leaves_host(F.lit("h.org"), v))
    assert direct == one(spark, refs, lambda v: U.is_external(U.resolve(F.lit("http://h.org/d/"), v), F.lit("http://h.org/d/")))


def test_query_params(spark):
    urls = ["https://x.org/a?q=1&q=2&e=", "/a?x=%zz&y=a%3Db+c#z=1", "https://x.org", "?&=1&n", "https://x.org/?k=a=b", None]
    assert one(spark, urls, protect.query_params) == [{"q": "2", "e": ""}, {"x": "%zz", "y": "a=b c"}, None, None, {"k": "a=b"}, None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.path for r in protect.request_target(df).collect()] == ["/a", "/a", "/", "/", "/", None]


def test_response_log(spark):
    rows = [({"Content-Length": "5", "content-length": "7", "COOKIE": "c"}, 5.0), ({"content-length": "much"}, 5.00049), (None, None)]
    got = protect.response_log(spark.createDataFrame(rows, "headers map<string,string>, seconds double")).collect()
    assert [(r.body_size_bytes, r.processing_time_seconds, r.is_slow) for r in got] == [(7, 5.0, False), (0, 5.0, True), (0, None, False)]
    assert got[0].headers["COOKIE"] == "[REDACTED]"


def test_schema_gaps(spark):
    df = spark.createDataFrame([(1, "7", [1]), (2, "x", None), (None, None, [2])], "a int, b string, c array<int>")
    assert V.schema_gaps(df, {"a": "int", "b": "string"}).collect() == []
    got = V.schema_gaps(df, {"a": "string", "b": "int", "c": "string", "d": "int"})
    assert [tuple(r) for r in got.collect()] == [
        ("a", "is int, expected string", 0), ("b", "is string, expected int", 1), ("c", "is array<int>, expected string", 2), ("d", "missing", 3)]
    assert [r.rows for r in V.schema_gaps(df.limit(0), {"b": "int", "d": "int"}).collect()] == [0, 0]


def test_export_states(spark, tmp_path):
    ledger, df = str(tmp_path / "ledger"), spark.range(10)
    done = W.export(df, str(tmp_path / "a"), "parquet", user_id="u", ledger=ledger, export_id="a").first()
    failing = df.select(F.raise_error(F.lit("broken row")).alias("x"))
    assert W.export(failing, str(tmp_path / "b"), "json", user_id="u", ledger=ledger, export_id="b").first().status == "failed"
    assert done.status == "completed" and done.records == 10
    assert done.file_size == sum(p.stat().st_size for p in (tmp_path / "a").glob("part-*"))
    table = spark.read.parquet(ledger)
    assert sorted(r.status for r in table.where("export_id = 'b'").collect()) == ["failed", "pending", "processing"]
    assert [r.status for r in W.export_status(table, "u", "a").collect()] == ["completed"]
    assert [r.export_id for r in W.export_status(table, "u", status="failed").collect()] == ["b"]
    assert W.export_status(table, "u", status="pending").isEmpty() and W.export_status(table, "other", "a").isEmpty()
    left = W.latest_states(table.where("status = 'pending'"))
    assert left.count() == 2 and left.where("file_path IS NULL AND file_size IS NULL").count() == 2


def test_merged_sketches(spark):
    rows = spark.range(60000).select(F.expr("timestamp'2024-01-01' + make_dt_interval(CAST(id % 7 AS INT))").alias("ts"), (F.col("id") % 20000).alias("v"))
    days = A.source_sketches(rows.unionByName(rows.limit(5).withColumn("v", F.lit(None).cast("long"))), "ts", F.col("v"))
    assert days.count() == 7
    got = A.merged_distinct(days).first()
    assert got["rows"] == 60005 and abs(got.distinct_values - 20000) <= 20000 * 3 * A.SKETCH_ERROR
    assert A.merged_distinct(A.source_sketches(rows.limit(0), "ts", F.col("v")), "day").count() == 0


def test_summary_of_content_types(spark):
    rows = [(1, "html"), (1, None), (2, "html"), (2, "json"), (3, "a")]
    records = spark.createDataFrame(rows, "job_id int, content_type string").selectExpr(
        "*", "0.5D AS confidence_score", "current_timestamp() AS extracted_at", "true AS ai_processed", "array() AS validation_errors")
    assert [tuple(x) for x in A.data_summary(records).first().content_types] == [("html", 2), ("a", 1), ("json", 1), ("unknown", 1)]
    assert A.data_summary(records.limit(0)).first().content_types == []


def test_pages_are_read_in_portions():
    """Parts of few pages are held at once, however many rows a batch has and however large a page is."""
    import pyarrow as pa

    from webloom.operators import pages as P

    cut = list(P.portions(pa.array(["x"] * 450 + ["y" * 700_000] * 2 + [None] + ["z" * 3_000_000, "a"])))
    assert cut == [(0, 200), (200, 200), (400, 51), (451, 2), (453, 1), (454, 1)] and not list(P.portions(pa.array([], pa.string())))


def test_selectors_are_tested_once_for_elements_alike(monkeypatch):
    tests = []
    fits = markup.fits
    monkeypatch.setattr(markup, "fits", lambda *a: tests.append(1) or fits(*a))
    wanted = {"deep": "main div.x a", "kind": "#more span[data-kind*=price]", "all": "*"}
    reader = markup.PageReader([".ad", "nav ul"], ["main"], wanted, "priority")
    page = ("<nav><ul><li>no</ul></nav><main><div class='x y'><p><a href='/{0}'>deep</a></div><a href='/{0}b'>flat</a><div class=ad>no</div>"
            "<b id=more><span data-kind='old price'>{0}</span></b><span data-kind='price'>out</span></main>")
    found, first = dict(reader(page.format(0))["custom"]), len(tests)
    assert found["deep"] == ["deep"] and found["kind"] == ["0"] and "no" not in "".join(found["all"])
    for i in range(1, 20):
        assert dict(reader(page.format(i))["custom"])["kind"] == [str(i)]
    assert len(tests) == first


def test_one_scan_for_dangerous_input(spark):
    words = ["select", "Drop", "ſelect", "selected", "or 1=1", "and  2 = 3", "or x", "onload =", "one", "javascript:", "VBSCRIPT:", "javascript", "<script a>b</script>",
             "<script>", "<iframe>\n</iframe>", "<embed></embed>", "--", "-", "#", "/*", "*/", "*a*", "*", "*\n*", "../", "..\\", "/../", "..", "../a..", "&", "!", "<!doctype", "$ne",
             "<![CDATA[", "k57", "12", "é", "K", "cat", "cats", "a\\b", "(", "su", "sun", "<object>x</object>"]
    texts = words + [a + b for a in words for b in words] + [f"{a} {b}" for a in words for b in words]
    each = "(?imU)" + "|".join(f"(?:{p})" for p in V.DANGEROUS)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", V.is_dangerous("t").alias("now"), F.col("t").rlike(each).alias("each")).collect()
    assert [r.t for r in found if r.now != r.each] == [] and len({r.now for r in found}) == 2
    # what is implied by another pattern is not tried at each place again
    assert len(V.ALL_DANGEROUS) < len(each)


def test_crawl_stores_its_links_once_and_ends_with_its_last_page(spark, monkeypatch):
    added, asked = [], []
    add, unseen = L.SeenTable.add, L.SeenTable.unseen
    monkeypatch.setattr(L.SeenTable, "add", lambda self, rows: added.append(self.keys) or add(self, rows))
    monkeypatch.setattr(L.SeenTable, "unseen", lambda self, rows: asked.append(1) or unseen(self, rows))
    seeds = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "a")], "crawl_id int, url string")
    links = spark.createDataFrame([("a", "b", 1), ("a", "gone", 2), ("b", "c", 1), ("c", "a", 1), ("c", None, 2)], "page_url string, url string, rank int")
    pages = spark.createDataFrame([(u,) for u in "abc"] + [(None,)], "url string")
    found = L.crawl_rounds(seeds, links, pages, max_pages=1)
    assert sorted((r.crawl_id, r.url, r.position) for r in found.where("crawl_id > 0").collect()) == [(1, "a", 1), (2, "b", 1)]
    assert added == [["from_url"], ["crawl_id", "url"]] and not asked
    found = L.crawl_rounds(seeds, links, pages, max_pages=2)
    assert sorted((r.crawl_id, r.url, r.position) for r in found.where("crawl_id > 0").collect()) == [(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "c", 2)]
    assert len(asked) == 1


def test_selectors_that_a_page_cannot_meet_are_not_tried(monkeypatch):
    tried = []
    reader = markup.PageReader([".ad"], ["main"], {}, "priority")
    call = markup.Matcher.__call__
    monkeypatch.setattr(markup.Matcher, "__call__", lambda self, e: tried.append(self) or call(self, e))
    page = "<script>if (a < b) '<p>no</p>'</SCRIPT ><title>1 &lt; 2</title><p>a < b<a href=/x>x</a><a href=/y>y</a><textarea><b>t</textarea> end"
    found = reader(page)
    assert [a["text"] for a in found["anchors"]] == ["x", "y"] and not any(a["pager"] or a["article"] for a in found["anchors"]) and not tried
    assert found["title"] == "1 < 2" and found["text"] == "1 < 2 a < b x y <b>t end" and found["paragraphs"] == ["a < bxy<b>t end"]
    found = reader("<div class=pager><a href=/2>2</a></div><div class=ad>no<a href=/n>n</a></div><a rel='next x' href=/3>3</a>")
    assert [(a["href"], a["pager"]) for a in found["anchors"]] == [("/2", True), ("/3", True)] and tried


def test_table_cells_in_sql_expand_in_place(spark):
    L.register_functions(spark)
    kind = P.EXTRACT["tables"].dataType.simpleString()
    one = {"caption": "c", "headers": ["h"], "rows": [["1", "2"], [], None, ["3", None]]}
    rows = [(1, [one, {"caption": None, "headers": None, "rows": None}, None, {"caption": None, "headers": None, "rows": [["x"]]}]), (2, []), (3, None), (1, [one])]
    pages = spark.createDataFrame(rows, f"page_id long, tables {kind}")
    found = spark.sql("SELECT p.page_id, c.* FROM {p} p, LATERAL table_cells(p.tables) c", p=pages)
    cells = [(1, 0, "c", 0, 0, "h", "1"), (1, 0, "c", 0, 1, None, "2"), (1, 0, "c", 3, 0, "h", "3"), (1, 0, "c", 3, 1, None, None)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(cells * 2 + [(1, 3, None, 0, 0, None, "x")], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Generate") == 1


def test_tags_alike_are_read_once(monkeypatch):
    read = []
    kind = markup.tag_kind
    monkeypatch.setattr(markup, "tag_kind", lambda whole, mark: read.append(whole) or kind(whole, mark))
    reader = markup.PageReader([".ad"], ["main"], {}, "priority")
    page = "<main><p><a href='/{0}'>one</a><a href=/b>two</a><p class=ad>no<a href=/n>n</a></p><a\"b c\"d>odd<x'y z>end</main>"
    for i in range(20):
        found = reader(page.format(i % 2))
        assert [a["href"] for a in found["anchors"]] == [f"/{i % 2}", "/b"] and found["paragraphs"][0] == "onetwo" and "no" not in found["text"]
    # once for each tag as it is written, with or without elements taken out
    assert sorted(read) == sorted({"main", "p", "a href='/0'", "a href='/1'", "/a", "a href=/b", "p class=ad", "a href=/n", "/p", 'a"b c"d', "x'y z", "/main"})


def test_parts_are_laid_out_flat_for_arrow():
    import pyarrow as pa

    inner = pa.struct([pa.field("s", pa.string()), pa.field("l", pa.list_(pa.list_(pa.string()))), pa.field("b", pa.bool_())])
    rows = [[{"s": "a", "l": [["x", None], []], "b": True}, {"s": None, "l": [], "b": False}], [], [{"s": "", "l": [["é"]], "b": None}]]
    for values in (rows, rows[1:2], []):
        found = P.column(values, pa.list_(inner))
        found.validate(full=True)
        assert found.equals(pa.array(values, pa.list_(inner))) and found.type == pa.list_(inner)
    assert P.column([[("k", 1)], []], pa.map_(pa.string(), pa.int32())).to_pylist() == [[("k", 1)], []]
