"""Run history: a job's states as rows that are only ever added, so that any number of writers agree on the last one."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, fields
from os import environ
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ["queued", "processing", "complete", "error"]
SCHEMA = "job_id string, status string, processed long, total long, current_file string, persons_found long, message string, created_at timestamp, at timestamp"


@dataclass(frozen=True)
class Config:
    """What an analysis may be told; environment variables GLEANER_<NAME> override the defaults."""

    slots: int = 2
    keep_hours: int = 24
    most_upload_mb: int = 2048
    review_all: bool = False
    build: str = field(default_factory=lambda: fingerprint())

    @classmethod
    def read(cls, env=environ) -> Config:
        kinds = {"int": int, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "str": str}
        return cls(**{f.name: kinds[f.type](env[f"GLEANER_{f.name.upper()}"]) for f in fields(cls) if f"GLEANER_{f.name.upper()}" in env})


def fingerprint(root: str | None = None) -> str:
    """12 hex digits of the package's sources: equal for equal code, wherever and whenever it was put there."""
    base = Path(root or Path(__file__).parent.parent)
    h = hashlib.sha256()
    for p in sorted(base.rglob("*.py")):
        h.update(f"{p.relative_to(base).as_posix()}\0".encode() + p.read_bytes() + b"\0")
    return h.hexdigest()[:12]


def record(spark: SparkSession, path: str, **state) -> None:
    """Adds a job's state, as of now."""
    if state["status"] not in STATES:
        raise ValueError(f"no such state: {state['status']}")
    cols = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
    row = spark.range(1).select(*[F.current_timestamp().alias(c) if c == "at" else F.lit(state.get(c)).cast(t).alias(c) for c, t in cols.items()])
    row.coalesce(1).write.mode("append").parquet(path)


def latest(history: DataFrame) -> DataFrame:
    """Each job's last state, newest job first."""
    last = history.groupBy("job_id").agg(F.max_by(F.struct(*history.columns), F.struct("at", F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status")))).alias("s"), F.min(F.coalesce("created_at", "at")).alias("_first"))
    return last.select("s.*", "_first").withColumn("created_at", F.col("_first")).drop("_first").orderBy(F.desc("created_at"), "job_id")


def recovered(history: DataFrame) -> DataFrame:
    """latest(), with jobs that a restart has cut short as errors."""
    cut = F.col("status").isin("queued", "processing")
    return latest(history).withColumns({"message": F.when(cut, "Interrupted by a restart.").otherwise(F.col("message")), "status": F.when(cut, "error").otherwise(F.col("status"))})


def kept(history: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The states of jobs that ended less than so many hours ago, or have not ended; rewriting the table with these expires the rest."""
    ended = history.filter(F.col("status").isin("complete", "error")).groupBy("job_id").agg(F.max("at").alias("_end"))
    old = ended.filter(F.col("_end") < now - F.make_interval(hours=F.lit(hours)))
    return history.join(old, "job_id", "left_anti")


def free_slots(history: DataFrame, slots: int = 2) -> DataFrame:
    """One row: running, waiting, free."""
    s = F.col("status")
    return latest(history).agg(F.count_if(s == "processing").alias("running"), F.count_if(s == "queued").alias("waiting")).withColumn("free", F.greatest(F.lit(0), F.lit(slots) - F.col("running")))


def from_report(rows: DataFrame) -> DataFrame:
    """One row a person of a report that was read back (outputs.read_report()), the first of each in order of files: what an old job's summary is rebuilt from."""
    first = Window.partitionBy("person_id").orderBy("current_source_file")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


# ---- uploads


def safe_name(name: Column) -> Column:
    """The last part of a path, unsafe letters as underscores, without leading dots."""
    base = F.substring_index(F.substring_index(name, "/", -1), "\\", -1)
    return F.regexp_replace(F.regexp_replace(F.trim(base), "[^A-Za-z0-9._ -]", "_"), "^\\.+", "")


def upload_names(uploads: DataFrame) -> DataFrame:
    """n, name, stored_as, ok of the files of one upload (n, name): ok is false for all if any is no .eml; equal names get _2, _3, ..."""
    rows = uploads.withColumn("_safe", safe_name(F.col("name")))
    good = F.coalesce(F.lower("_safe").endswith(".eml") & (F.length("_safe") > 4), F.lit(False))
    rows = rows.withColumn("_good", good)
    place = F.row_number().over(Window.partitionBy("_safe").orderBy("n"))
    bad = rows.filter(~F.col("_good")).agg(F.count("*").alias("_bad"))
    stem = F.substr("_safe", F.lit(1), F.length("_safe") - 4)
    out = rows.withColumn("stored_as", F.when(place > 1, F.concat(stem, F.lit("_"), place.cast("string"), F.right("_safe", F.lit(4)))).otherwise(F.col("_safe")))
    return out.join(F.broadcast(bad)).select("n", "name", "stored_as", (F.col("_bad") == 0).alias("ok"))
