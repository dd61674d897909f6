import collections
import os
import re

import pytest
from data import EXTRA, SCHEMA, frame, rows
from pyspark.sql import functions as F

import corpus_pipeline
from storelens.llm import decontaminate, packing, pii, quality_rules, simhash
from storelens.llm.queries import QUERIES
from storelens.llm.tokenizer import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA_EXTRA = [c.split()[0] for c in EXTRA.split(", ")]


@pytest.fixture
def folder(spark, tmp_path):
    data = rows(n=80)
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    words = next(t for i, t, *_ in data if i % 7 and i > 12 and len(t.split()) > 100).split()
    spark.createDataFrame([(1, " ".join(words[:12])), (2, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_keep_the_documents_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    good = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    one = by["quality_rules"](spark, docs, folder)
    assert {r.doc_id for r in one.collect()} == good
    two = by["simhash_near_dedup"](spark, one, folder)
    assert {r.doc_id for r in two.collect()} == {
        r.component_id for r in simhash.near_duplicates(one).collect()}
    three = by["benchmark_decontamination"](spark, two, folder)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert {r.doc_id for r in three.collect()} == {
        r.doc_id for r in decontaminate.contamination(two, bench).where("not contaminated").collect()}
    four = by["pii"](spark, three, folder)
    assert four.count() == three.count()
    for stage in (one, two, three, four):
        assert stage.columns == columns
        counts.append(stage.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[3] < counts[2]
    five = by["packing"](spark, four, folder)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}
    total = lambda d: collections.Counter((r.doc_id, r.doc_tokens) for r in d.where("start = 0").collect())
    assert total(corpus_pipeline.run(spark, folder)) == total(five)


def test_stages_take_columns_with_the_names_they_use(spark, folder):
    names = ("__id", "__row", "__bad", "__lang", "__cuts", "__text", "row", "kept", "text_", "__ID_")
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop(*SCHEMA_EXTRA)
    plain = docs
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for name, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, docs, folder), stage(spark, plain, folder)
        if name != "packing":
            assert got.columns == docs.columns
            assert all(r[c] == k for r in got.collect() for k, c in enumerate(names))
        key = lambda d: sorted((repr(r.doc_id), repr(r.text)) for r in d.collect())
        assert name == "packing" or key(got) == key(want)


def test_pipeline_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered_queries_have_the_contracts_columns(spark):
    first = {
        "op1": "doc_id n_words n_removed kept_sha256", "op2": "doc_id n_words word_chars n_symbols n_dup_lines "
        "n_repeat_words base_failed kept", "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op4": "doc_id n_bytes n_removed n_spans kept_sha256", "op5": "doc_id fingerprint component_id",
        "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7": "doc_id n_assign n_access n_hex "
        "base_sha256 spans", "op8": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op9": "doc_id n_words n_hit n_items items_sha256 contaminated", "op10": "page_id url text n_chars",
        "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
        "op12": "anchor_id positive_id rank negative_id positive_score negative_score",
        "op13": "doc_id held_out score predicted"}
    for name, query in QUERIES.items():
        if name != "pipeline":
            got = query(spark, SF)
            want = first[name.split("_")[0]].split()
            assert got.columns[:len(want)] == want, name
            assert not [f.name for f in got.schema.fields if f.name.startswith("n_") and f.dataType.typeName() != "long"]


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, files in os.walk(os.path.join(top, "storelens")):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"storelens\.llm|from storelens import llm|corpus_pipeline",
                                         open(os.path.join(folder, f)).read()), f


def test_operators_leave_extra_columns_out(spark):
    df = frame(spark, rows(n=10)[:20])
    assert packing.pack_documents(df, tokenizer_path()).count() >= 20
    assert pii.find(df).count() == 20
