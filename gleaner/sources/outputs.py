"""What an analysis leaves behind, and how it is read again: logs, CSV and HTML reports, ground truth, evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, reports


def append_log(rows: DataFrame, path: str) -> None:
    """A line of JSON a message, added to what is there."""
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, human: bool = True) -> None:
    """One CSV file with a header (of people's words) in a folder; a report is small, so one task writes it."""
    named = rows.withColumnsRenamed({c: reports.header(c) for c in rows.columns}) if human else rows
    named.coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A CSV report with its columns' own names again; a field that is empty in the file is an empty string."""
    rows = spark.read.options(header=True, quote='"', escape='"', multiLine=True, emptyValue="", nullValue="\0").csv(path).na.fill("")
    known = [*reports.HEADERS, "person_id", "canonical_name", "canonical_email", "entity_type", "report_job_id", "report_schema_version", "report_build_id", "report_generated_utc"]
    back = {reports.header(k): k for k in reversed(known)}
    return rows.withColumnsRenamed({c: back.get(c, c.lower().replace(" ", "_")) for c in rows.columns})


def stamped(rows: DataFrame, job_id: str, schema_version: str, build: str) -> DataFrame:
    """rows with what says which job, layout and code made them, and when."""
    stamp = {"report_job_id": F.lit(job_id), "report_schema_version": F.lit(schema_version), "report_build_id": F.lit(build), "report_generated_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return rows.select(*[v.alias(k) for k, v in stamp.items()], *rows.columns)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A page or a note, in whatever store Spark can write to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


TRUTH = "schema_version int, files array<struct<eml_filename:string,needs_human_review:boolean,expected_findings:array<struct<source_ref:string,pii_type:string,normalized_value:string,owner:string>>>>"


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, needs_review) and (file, source_ref, pii_type, normalized_value, owner) of a ground truth file, values as rules write them."""
    files = spark.read.schema(TRUTH).json(path, multiLine=True).select(F.inline("files"))
    rows = files.select(F.col("eml_filename").alias("file"), F.inline("expected_findings"))
    return files.select(F.col("eml_filename").alias("file"), F.coalesce("needs_human_review", F.lit(False)).alias("needs_review")), rows.withColumn("normalized_value", metrics.normalized(F.col("pii_type"), F.col("normalized_value")))


def write_truth(files: DataFrame, expected: DataFrame, path: str) -> None:
    """One JSON document of files (file, needs_review) and expected findings, as read_truth() takes it."""
    by = expected.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("source_ref", "pii_type", "normalized_value", "owner"))).alias("expected_findings"))
    none = F.array().cast("array<struct<source_ref:string,pii_type:string,normalized_value:string,owner:string>>")
    rows = files.join(by, "file", "left").select(F.struct(F.col("file").alias("eml_filename"), F.col("needs_review").alias("needs_human_review"), F.coalesce("expected_findings", none).alias("expected_findings")).alias("f"))
    whole = rows.agg(F.array_sort(F.collect_list("f")).alias("files")).select(F.lit(1).alias("schema_version"), "files")
    whole.coalesce(1).write.mode("overwrite").json(path)


def write_evaluation(spark: SparkSession, rows: DataFrame, path: str, title: str) -> None:
    """Figures as JSON lines below path/json, and as a Markdown table below path/md."""
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    write_text(spark, metrics.markdown(rows, title), f"{path}/md")
