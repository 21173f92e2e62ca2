"""Stages of the pipeline: columns, effects, and what they must leave alone."""

import corpus_pipeline as p
from gleaner.llm import queries
from gleaner.llm.common import written
from pyspark.sql import functions as F


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality rules", "language ID", "line dedup", "SimHash near-dedup", "packing"]
    counts = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns == p.COLUMNS
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    pieces = p.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_quality_keeps_good_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = p.quality(spark, docs, d).join(labels, "doc_id")
    good = docs.join(labels.filter("quality = 1"), "doc_id").count()
    assert kept.filter("quality = 1").count() >= 0.98 * good
    assert kept.filter("quality = 0").count() <= 0.1 * labels.filter("quality = 0").count()


def test_odd_rows_pass_every_stage(spark, sf_dir):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here, but a text of some words", "en", "s", 3), (3, "x" * 100_000, "en", "s", 1), (4, "word " * 50_000, "en", "s", 1)]
    rows += [(i, "a quick text of more than ten words that is quite the same in all rows", "en", "s", 5) for i in range(5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for _, stage in p.STAGES:
        stage(spark, docs, sf_dir).collect()
    none = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert p.run(spark, sf_dir).count() > 0
    assert len(queries.QUERIES) == 10
