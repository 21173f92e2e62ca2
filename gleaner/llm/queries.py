"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, lang_id, licenses, line_dedup, packing, pieces, quality_mil, quality_rules, simhash, token_files
from .common import is_held_out, table, work_dir, written


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids and ids_crc32 of the whole text's ids, and decoded_sha256 of the text that decoding them gives."""
    import hashlib
    import zlib

    import numpy as np
    import pyarrow as pa

    model = pieces.load(vocabulary("piece_bpe_32k.model"))
    text = pieces.decoder(model)

    def digests(ids):
        sha = [hashlib.sha256(text(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest() for x in ids]
        return {"n_ids": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()), "decoded_sha256": pa.array(sha, pa.string())}

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model, columns=digests, schema="n_ids long, ids_crc32 long, decoded_sha256 string")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduped(docs).select("doc_id", "n_lines", "n_removed", "text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.documents(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    return quality_mil.scored(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.digests(token_files.read_token_files(spark, path))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(simhash.fingerprints(table(spark, sf_dir, "documents"), width=4))
    return simhash.groups(prints, radius=4).select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, trees).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "quality_score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near(written(fingerprints.compared(table(spark, sf_dir, "documents"))))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = lang_id.fit(docs)
    return lang_id.predicted(docs.select("doc_id", "text"), profiles).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_license_scan, op4_quality_classifier, op5_token_files, op6_simhash_near_dedup, op7_quality_rules, op8_packing, op9_fingerprints, op10_language_id)}


def _op3_sql() -> str:
    def canonical(x: str) -> str:
        out = f"' ' || regexp_replace(regexp_replace(lower({x}), '{licenses.COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for pattern, to in licenses.SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        return f"trim({out})"

    texts = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in licenses.wordings())
    digests = ", ".join(f"('{k}', '{d}')" for k, d in licenses.DIGESTS.items())
    return f"""
    WITH known AS (SELECT license, sha256({canonical('text')}) AS digest FROM (VALUES {texts}) t(license, text) UNION ALL SELECT * FROM (VALUES {digests}) d(license, digest)),
    units AS (
      SELECT doc_id, -1 AS line, text AS unit FROM documents WHERE length(text) > 0
      UNION ALL
      SELECT doc_id, 0 AS line, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE length(text) > 0
    ),
    hits AS (SELECT doc_id, line, license FROM units JOIN known ON sha256({canonical('unit')}) = digest)
    SELECT doc_id, max(CASE WHEN line < 0 THEN license END) AS whole_license,
           coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN line >= 0 THEN license END) FILTER (line >= 0))), ','), '') AS line_licenses,
           count(CASE WHEN line >= 0 THEN 1 END) AS n_lines_found
    FROM hits GROUP BY doc_id
    """


ORACLE_SQL = {"op3_license_scan": _op3_sql()}
