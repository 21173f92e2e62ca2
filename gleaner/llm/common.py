"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every contract of this subpackage.
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below shared_folder(). Whoever owns that folder clears it: results may be read after a query returns."""
    return f"{shared_folder(spark)}/gleaner-{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage, and survives lost executors."""
    path = work_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, and has the shuffle files of what is done go too.

    A frame that is no such table itself is left alone.
    """
    for t in tables:
        path = t.__dict__.pop("_written_to", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the rows' bytes, from file sizes; starts no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, mb: int = 32) -> int:
    """Partitions for an exchange of whole texts: the session's number, or more where the input needs it."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return max(session, min(200_000, size // (mb << 20) + 1) if size < 1 << 60 else 1)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def texts_of(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch whose texts hold about `most` bytes at most, each with its texts (null: empty)."""
    col = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            part = batch.slice(at, i - at)
            yield part, [x or "" for x in col.slice(at, i - at).to_pylist()]
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield batch.slice(at), [x or "" for x in col.slice(at).to_pylist()]


def on_texts(df: DataFrame, column: str, schema: str, f: Callable[[pa.RecordBatch, list[str]], dict]) -> DataFrame:
    """Arrow map: f gets a bounded slice and its texts, and returns the columns of schema for it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part, texts in texts_of(batch, column):
                cols = f(part, texts)
                yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type) if not isinstance(cols[x.name], pa.Array) else cols[x.name] for x in out], schema=out)

    return df.mapInArrow(run, schema)


def split_hot(counts: DataFrame, keys: list[str], n: str, most: int = 10_000) -> tuple[DataFrame, int]:
    """Rows of counts whose n is over a `most`-th of all: fewer than `most` rows, whatever the input, so that they may be broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    least = max(1000, total // most)
    return counts.filter(F.col(n) > least), least


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Left join with a side that has one row a key and how many left rows the key has.

    Keys with many rows meet a broadcast of at most 10,000 rows, so that no task gets all rows of such a key; the
    others are joined by an exchange. right is read twice and must be cheap to read (a written table).
    """
    hot, least = split_hot(right, keys, n)
    more = [c for c in right.columns if c not in keys and c != n]
    hot = hot.select(*keys, F.struct(*more).alias("_hot"))
    marked = left.join(F.broadcast(hot), keys, "left")
    cold = right.filter(F.col(n) <= least).select(*keys, F.struct(*more).alias("_cold"))
    out_cols = left.columns
    a = marked.filter(F.col("_hot").isNotNull()).select(*out_cols, "_hot.*")
    b = marked.filter(F.col("_hot").isNull()).drop("_hot").join(cold, keys, "left").select(*out_cols, "_cold.*")
    return a.unionByName(b)


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """Inner join with a side of one large row a key: keys with over max(1000, a `most`-th) of the left rows are salted.

    A salted key's left rows are dealt over as many salts as it takes to come below that bound, and the right row is
    repeated for each, so that no task gets all rows of a key and nothing large is broadcast. What is broadcast are the
    salted keys: fewer than `most`. left is read twice and must be cheap to read (a written table).
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot, least = split_hot(counts, keys, "_n", most)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("_salts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return a.join(b, [*keys, "_salt"]).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as set for the session or its context; a temporary folder where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or os.path.join(tempfile.gettempdir(), "gleaner-work")).rstrip("/")
