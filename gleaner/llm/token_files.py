"""Token-ID output: Parquet files of list columns, in order of documents.

Each file holds one range of doc_ids in ascending order, a row a document: doc_id, row (its place in the file),
start_in_file (ids before it in the file), n_tokens and ids. Integers are delta-encoded (version 2 pages), row groups
and pages have a set size, and page indexes (with row groups sorted by doc_id) let a reader fetch the metadata columns,
or a few documents' ids, without the rest. A task writes one file, whatever the session says of rows a file.

Null texts are empty: a document of the end id alone. Rows that share a doc_id follow one another, in order of text,
and a null doc_id comes first. Very long texts are one row each; slices of other texts are encoded at a time. An empty
table makes files without rows. Of the columns only doc_id and text are read, so others, of whatever name, do not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .tokens import encoder

SCHEMA = "doc_id long, row long, start_in_file long, n_tokens long, ids array<int>"


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, leading_space: bool = False) -> DataFrame:
    """Rows of SCHEMA, in ascending doc_id within and across partitions."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        enc, row, start = encoder(vocabulary, leading_space), 0, 0
        from .common import texts_of

        for batch in batches:
            for part, texts in texts_of(batch, "text", 2 << 20):
                ids = [enc.encode(t) + end for t in texts]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                ends = start + np.cumsum(n)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(row, row + len(ids))), pa.array(ends - n), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), values)],
                    names=["doc_id", "row", "start_in_file", "n_tokens", "ids"],
                )
                row += len(ids)
                start = int(ends[-1])

    rows = docs.select("doc_id", "text")
    return rows.repartitionByRange(parts(rows), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, row_group_mb: int = 32, page_kb: int = 256) -> None:
    """Encode whole texts, append end_id to each document, and write the files to path."""
    tokenized(docs, vocabulary, end_id).write.options(
        **{
            "compression": "zstd",
            "maxRecordsPerFile": "0",
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "false",
            "parquet.block.size": str(row_group_mb << 20),
            "parquet.page.size": str(page_kb << 10),
            "parquet.page.row.count.limit": "2000",
        }
    ).parquet(path)


def read_token_files(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """The files' rows with start: the ids of all documents before them. Reads only the columns asked for."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    file = F.col("_metadata.file_name")
    # a row a file, whatever the number of documents: what comes to the driver is as many numbers as there are files
    per_file = rows.groupBy(file.alias("file")).agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.sum("n_tokens").alias("n")).collect()
    before, at = [], 0
    # nulls sort first; files of one least doc_id were written in order of their part numbers
    for r in sorted(per_file, key=lambda r: (r["nulls"] == 0, r["least"] if r["least"] is not None else -(1 << 63), r["file"])):
        before.append((r["file"], at))
        at += r["n"]
    offsets = spark.createDataFrame(before, "file string, before long")
    wanted = columns or ["doc_id", "n_tokens", "ids"]
    return (
        rows.select("start_in_file", *wanted, file.alias("file"))
        .join(F.broadcast(offsets), "file")
        .select("doc_id", (F.col("start_in_file") + F.col("before")).alias("start"), *[c for c in wanted if c != "doc_id"])
    )


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
