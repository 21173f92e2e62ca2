"""Mails as a stream: files that appear in a folder are parsed, scanned and written as findings, each value once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..sources import messages

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """file, content, at of .eml files as they appear; at most per_batch a micro-batch."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(messages.below(F.col("path"), path).alias("file"), "content", F.col("modificationTime").alias("at"))


def findings(files: DataFrame, types: list[str] | None = None, late: str = "1 day") -> DataFrame:
    """Findings of arriving files. A value that a source holds twice, or a file that comes twice within `late`, is told of once."""
    rows = messages.sources(messages.parse(files, keep=("at",)), keep=("at",))
    found = scan.scored(scan.candidates(rows, types=types, keep=("at",)), types, keep=("at",))
    return found.withWatermark("at", late).dropDuplicatesWithinWatermark(["source_ref", "pii_type", "normalized_value"])


def counts(found: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """How many findings of each type arrived in each window of time."""
    return found.withWatermark("at", late).groupBy(F.window("at", width), "pii_type").agg(F.count("*").alias("n")).select("window.start", "pii_type", "n")


def start(rows: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Writes a stream as Parquet; once: what is there now, then it ends. The checkpoint makes a restart go on where it was."""
    q = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="10 seconds")).start()
