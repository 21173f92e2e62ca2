"""Blocks of a source's text, the block that an offset lies in, and neighbouring blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segment(sources: DataFrame, ref: str = "source_ref", text: str = "text") -> DataFrame:
    """source_ref, block_ix, start, end, text of each block.

    Blank lines end a block; a line with a TAB, and a marker line, is a block of its own. Gaps and islands: a running
    sum over each source's lines numbers the blocks, and one aggregate joins them. Lines end at newlines.
    """
    lines = sources.select(F.col(ref).alias("source_ref"), F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"), F.length(text).alias("size"))
    in_order = Window.partitionBy("source_ref").orderBy("n")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"start": F.coalesce(F.sum(F.length("line") + 1).over(so_far), F.lit(0)), "stripped": F.trim(F.regexp_replace("line", "^\\s+|\\s+$", ""))})
    alone = F.col("line").contains("\t") | F.col("stripped").rlike("^(\\[Sheet:|\\[ZIP member:|Attachment filename:)")
    lines = lines.withColumns({"blank": F.col("stripped") == "", "alone": alone, "end": F.least(F.col("start") + F.length("line") + 1, F.col("size"))})
    new = F.col("blank") | F.col("alone") | F.lag("alone", 1, False).over(in_order)
    lines = lines.withColumn("island", F.sum(new.cast("int")).over(in_order)).filter("NOT blank")
    found = lines.groupBy("source_ref", "island").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "stripped"))), lambda x: x["stripped"]), "\n").alias("text"))
    numbered = F.row_number().over(Window.partitionBy("source_ref").orderBy("start")) - 1
    return found.select("source_ref", numbered.alias("block_ix"), "start", "end", "text")


def lookup(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """findings with block_ix and finding_no (its place in the source): the first block whose range, ends included, holds char_offset, else block 0.

    Findings and the begins of blocks are put in one order, in which a finding sees the last block that begins before
    it: one exchange, and no pair of a finding and a block.
    """
    near = Window.partitionBy("source_ref").orderBy("start")
    b = blocks.select("source_ref", F.col("start").alias("_pos"), F.lit(1).alias("_kind"), F.struct("block_ix", F.col("end").alias("end"), F.lead("start").over(near).alias("next")).alias("_b"))
    f = findings.select("source_ref", F.col("char_offset").alias("_pos"), F.lit(0).alias("_kind"), F.struct(*findings.columns).alias("_f"))
    in_order = Window.partitionBy("source_ref").orderBy("_pos", "_kind")
    rows = f.unionByName(b, allowMissingColumns=True).withColumns({"_b": F.last("_b", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), "finding_no": F.row_number().over(in_order)})
    at, here = F.col("_b"), F.col("_pos")
    ix = F.when(at["end"] >= here, at["block_ix"]).when(at["next"] == here, at["block_ix"] + 1).otherwise(0)
    return rows.filter(F.col("_f").isNotNull()).select("_f.*", ix.cast("int").alias("block_ix"), "finding_no")


def neighbours(blocks: DataFrame, reach: int = 3) -> DataFrame:
    """source_ref, block_ix, other_ix, distance: pairs of blocks at most `reach` apart, by an equi-join on shifted places."""
    near = blocks.select("source_ref", "block_ix", F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d])).alias("d"))
    near = near.select("source_ref", "block_ix", (F.col("block_ix") + F.col("d")).alias("other_ix"), F.abs("d").alias("distance"))
    return near.join(blocks.select("source_ref", F.col("block_ix").alias("other_ix")), ["source_ref", "other_ix"])
