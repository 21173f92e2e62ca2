"""Evaluation: multiset and set matches of expected and found values, precision and recall, listings, data set figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.rules import RULES

KEY = ["source_ref", "pii_type", "normalized_value"]


def normalized(kind: Column, value: Column) -> Column:
    """An expected value as the last rule of its type writes found ones."""
    out = None
    for r in {r.type: r for r in RULES}.values():
        out = F.when(kind == r.type, r.normal(value)) if out is None else out.when(kind == r.type, r.normal(value))
    return out.otherwise(T.collapse(value))


def matches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """KEY with tp, fp, fn: of each value, as many as both sides hold, and what is over on either."""
    e, f = expected.groupBy(*KEY).agg(F.count("*").alias("e")), found.groupBy(*KEY).agg(F.count("*").alias("f"))
    both = e.join(f, KEY, "full_outer").fillna(0, ["e", "f"])
    return both.select(*KEY, F.least("e", "f").alias("tp"), F.greatest(F.col("f") - F.col("e"), F.lit(0)).alias("fp"), F.greatest(F.col("e") - F.col("f"), F.lit(0)).alias("fn"))


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision and recall; nothing found is right where nothing was expected."""
    found, expected = tp + fp, tp + fn
    return [F.when(found > 0, tp / found).otherwise(F.when(expected == 0, 1.0).otherwise(0.0)).alias("precision"), F.when(expected > 0, tp / expected).otherwise(1.0).alias("recall")]


def by_type(matched: DataFrame) -> DataFrame:
    """pii_type (ALL: the total), tp, fp, fn, precision and recall."""
    rolled = matched.rollup("pii_type").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return rolled.select(F.coalesce("pii_type", F.lit("ALL")).alias("pii_type"), "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """What was expected and not found, as often as it is over; swap the sides for what was found unexpectedly."""
    return expected.select(*KEY).exceptAll(found.select(*KEY))


def on_sets(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row tp, fp, fn, precision, recall of distinct keys: (file, type), with an owner too, or files alone."""
    e, f = expected.select(*keys).distinct(), found.select(*keys).distinct()
    both = e.withColumn("e", F.lit(1)).join(f.withColumn("f", F.lit(1)), keys, "full_outer").fillna(0, ["e", "f"])
    agg = both.agg(*[F.count_if(c).alias(k) for k, c in (("tp", (F.col("e") == 1) & (F.col("f") == 1)), ("fp", F.col("e") == 0), ("fn", F.col("f") == 0))])
    return agg.select("tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def data_set(files: DataFrame, expected: DataFrame) -> DataFrame:
    """pii_type (ALL: the total), n_findings, n_files of the expected findings; n_clean and n_review, of the files, beside the total.

    files: file, needs_review. expected: file, pii_type.
    """
    rolled = expected.rollup("pii_type").agg(F.count("*").alias("n_findings"), F.count_distinct("file").alias("n_files"))
    whole = files.join(expected.select("file").distinct().withColumn("_f", F.lit(1)), "file", "left").agg(F.count_if(F.col("_f").isNull()).alias("n_clean"), F.count_if(F.col("needs_review")).alias("n_review")).withColumn("pii_type", F.lit("ALL"))
    return rolled.withColumn("pii_type", F.coalesce("pii_type", F.lit("ALL"))).join(whole, "pii_type", "left")


def markdown(rows: DataFrame, title: str) -> str:
    """A small table as Markdown."""
    cols = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "-|" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.collect()])
