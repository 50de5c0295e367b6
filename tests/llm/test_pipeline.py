"""The pipeline's stages on awkward rows and on the smallest tables, and the registered queries against their SQL."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import documents, rows_of
from tools import check_results as C
from webloom.llm import op2_packing, op4_quality_rules, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return C.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    ok, note = C.compare(spark, duck, FOLDER, name, registry.QUERIES[name], registry.ORACLE[name])
    assert ok, note


def test_one_query_per_operator():
    assert sorted(k.split("_")[0] for k in registry.QUERIES) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])


def test_stages_keep_columns_and_apply_their_decisions(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    meter = op4_quality_rules.Meter(op4_quality_rules.Limits())
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            rows = rows_of(after)
            if number == 0:
                assert sorted(str(r) for r in rows) == sorted(str(r) for r in before if meter.measure(r["text"] or "")[6])
            if number == 2:
                assert {10} <= {r["doc_id"] for r in rows} and not {200, 201, 100} & {r["doc_id"] for r in rows}
                assert [r["doc_id"] for r in rows].count(10) == 1
            if number == 3:
                assert all(r["n_chars"] == len(r["text"]) for r in rows)
            docs = after
    kept = {r["doc_id"] for r in rows_of(docs)}
    assert kept == {r["doc_id"] for r in rows_of(after)}


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "red green blue cyan pink grey black")
    rows = [(0, a), (1, a), (1, b), (1, b), (None, a), (None, c), (None, c), (7, c), (8, None), (8, " "), (None, "")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, class int").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in rows_of(corpus_pipeline.near_duplicates(spark, docs, FOLDER))), key=str)
    assert got == sorted([(0, a), (1, b), (7, c), (8, None), (8, " "), (None, "")], key=str)


def test_stages_take_columns_of_any_name(spark):
    names = ("own", "class", "root", "rank", "chunk", "pieces", "packs", "doc", "kept", "score", "__at", "__row", "__id", "__doc", "__packs", "__chunk", "__local", "__before", "__pieces", "__other")
    docs = documents(spark).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit(f"my {n}").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns and all(r[n] == f"my {n}" for r in rows_of(after) for n in names)
    assert op2_packing.pack(op2_packing.pieces_of(docs), ["doc_id", "piece"]).where("__chunk = 'my __chunk' AND __pieces = 'my __pieces'").count() > 0


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    labels = spark.read.parquet(os.path.join(FOLDER, "labels.parquet"))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    held = out.select("doc_id").distinct().join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r["quality"] for r in held} == {1}
