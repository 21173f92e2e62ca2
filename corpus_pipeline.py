"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, works on all of docs, and returns a
DataFrame; run() writes each stage's result as Parquet in the shared folder and reads it as the next one's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import lang_id, line_dedup, packing, quality_rules, simhash
from gleaner.llm.common import table, written
from gleaner.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the boosted trees reject go (null and empty texts among them)."""
    trees = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, trees, keep=COLUMNS).filter("kept").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every learned language, go."""
    return lang_id.predicted(docs, lang_id.fit(docs), keep=COLUMNS).filter("lang_pred <> 'und' AND score >= 0.25").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are deleted; documents of which nothing is left go. n_chars follows the text."""
    out = line_dedup.deduped(docs.select(COLUMNS), min_words=50)
    return out.filter("n_removed = 0 OR trim(text) <> ''").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are like one another (Jaccard similarity of five-word shingles 0.8 or more) one stays."""
    return simhash.deduped(docs.select(COLUMNS), width=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("packing", packed)]

#: No stage but the base rules can be put as SQL: trees, profiles, doubling, fingerprints and packing can't. The stages
#: are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
