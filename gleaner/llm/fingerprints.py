"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a weighted set: its words, weighted by how often they occur. For sample k a word draws r and c from
Gamma(2, 1) and b from (0, 1), all from a hash of the word and k. With weight w, t = floor(ln w / r + b) and
a = c exp(-r (t - b) - r); the word of least a is the sample, with its t. Two texts have the same sample k with a
chance equal to the generalised Jaccard similarity of their weights, so the share of equal samples estimates it, and
equal texts have equal fingerprints.

The draws are taken in an order that makes the usual weight, 1, cheap: there t = 0 and a = c exp(-r (1 - b)) is
exponential, so a = -ln v for a uniform v, and the least a is the largest v: a bid is a hash. What is left of c and r,
given a, is again exponential (a part c u of c = Gamma(2, 1), u uniform, is independent of the rest): c = a + c',
s = -ln(a / c), r = s + s' and b = s' / r, with c' and s' exponential. Only weights from 2 on work this out.

As a also tells word and t apart, a sample is kept as the plain maximum of v = exp(-a), and 16 bits of its hash are its
part of the fingerprint: words are exploded, and all maxima are taken in one hash aggregate. One 64-bit hash serves two
samples. The exchange of texts in order of doc_id, which the edited texts need, already holds each document in one task,
so the aggregates need no exchange of words. The share of equal samples has a standard error of sqrt(p (1 - p) / 64):
0.05 at a likeness of 0.8, 0.06 at most.

Null and empty texts have no words; their fingerprint is all zeros, like only to one another. Rows that share a
doc_id are fingerprinted one by one, in order of text; a null doc_id comes before all others. Repeated rows are each a
row. Very long texts are exploded as a stream. An empty table gives no rows. Of the columns only doc_id and text are
read, so others, of whatever name, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

SAMPLES = 64
SPACE = "[\\x20\\x09-\\x0D]+"
_EMPTY = "0" * (4 * SAMPLES)


def _uniform(bits: Column) -> Column:
    """A number in (0, 1) of 31 bits."""
    return (bits.cast("double") + 0.5) * float(2.0**-31)


def sample(bits: Column, word: Column, weight: Column, k: int) -> Column:
    """exp(-a) of a word's bid for sample k: the largest wins. bits: 32 of the word's hash for this sample."""
    v = (bits.cast("double") + 0.5) * float(2.0**-32)
    y = F.xxhash64(word, F.lit(1000 + k))
    a = -F.ln(v)
    c = a - F.ln(_uniform(F.shiftrightunsigned(y, 33)))
    rest = -F.ln(_uniform(y.bitwiseAND(F.lit((1 << 31) - 1))))
    r = rest - F.ln(a / c)
    t = F.floor((F.ln(weight.cast("double")) + rest) / r)
    # r (t - b) + r, with b = rest / r; at t = 0 the bid is that of weight 1, to the last bit
    # (two tests, as the parts of an OR would all be worked out for every word)
    return F.when(weight == 1, v).otherwise(F.when(t == 0, v).otherwise(F.exp(-c * F.exp(rest - r * (t + 1)))))


def signatures(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s0, s1, ... of rows (keys, word hash h), a row an occurrence. Needs no exchange where rows are dealt by some of keys."""
    weighed = words.groupBy(*keys, "h").agg(F.count("*").cast("int").alias("w"))
    hashed = weighed.select(*keys, "h", "w", *[F.xxhash64("h", F.lit(j)).alias(f"x{j}") for j in range(SAMPLES // 2)])
    bits = [F.shiftrightunsigned(f"x{k // 2}", 32) if k % 2 == 0 else F.col(f"x{k // 2}").bitwiseAND(F.lit((1 << 32) - 1)) for k in range(SAMPLES)]
    return hashed.groupBy(*keys).agg(*[F.max(sample(bits[k], F.col("h"), F.col("w"), k)).alias(f"s{k}") for k in range(SAMPLES)])


def as_text() -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(f"s{k}").bitwiseAND(F.lit(0xFFFF)))), 4, "0") for k in range(SAMPLES)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints; 1 for equal ones, and 0 where just one is of a text without words."""
    same = sum((F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(SAMPLES)) / float(SAMPLES)
    return F.when(a == b, F.lit(1.0)).when((a == _EMPTY) | (b == _EMPTY), F.lit(0.0)).otherwise(same)


def buckets(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """rows with block and sub, about n ranges of doc_id in their order; and the ranges, a row each, with their least doc_id.

    A block is a doc_id divided by a fixed width, which needs no table. Blocks with over 4 times the mean of rows are
    cut into subs of even width (a broadcast of fewer than n / 4 rows). Null doc_ids are the first block.
    """
    r = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).first()
    width = max(1, ((r["hi"] or 0) - (r["lo"] or 0) + 1) // n)
    rows = rows.withColumn("block", F.coalesce(F.expr(f"doc_id div {width}L"), F.lit(-(1 << 63))))
    mean = max(1, r["n"] // n)
    heavy = rows.groupBy("block").agg(F.count("*").alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter(F.col("c") > 4 * mean)
    heavy = heavy.select("block", "lo", F.expr(f"greatest(1L, (hi - lo + 1) div (c div {mean}L))").alias("step"))
    rows = rows.join(F.broadcast(heavy), "block", "left").withColumn("sub", F.coalesce(F.expr("(doc_id - lo) div step"), F.lit(0).cast("long"))).drop("lo", "step")
    return rows, rows.groupBy("block", "sub").agg(F.min("doc_id").alias("least"))


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """block, sub, doc_id, at (place among rows of a doc_id), text, next_id, next_at, next_text: each row by the next of ascending doc_id (the last by the first).

    Rows are dealt by n ranges of doc_id. A range's first documents are also sent to the end of the range before it, so
    that each range knows its successor; the first range's go to the last. The ranges' least doc_ids are broadcast: a
    row a range, at most 12 for each partition of an exchange, of which there are 200,000 at most.
    """
    rows, ranges = buckets(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), n)
    here = F.struct("block", "sub")
    in_order = Window.orderBy("block", "sub")
    before = F.coalesce(F.lag(here).over(in_order), F.max(here).over(Window.orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = ranges.select(F.col("least"), before.alias("home"))
    met = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("least")), "left")
    own = F.array(F.struct("block", "sub", F.lit(0).alias("guest")))
    visit = F.when(F.col("home").isNotNull(), F.concat(own, F.array(F.struct(F.col("home.block").alias("block"), F.col("home.sub").alias("sub"), F.lit(1).alias("guest"))))).otherwise(own)
    dealt = met.select("doc_id", "text", F.explode(visit).alias("v")).select("v.*", "doc_id", "text")
    same = Window.partitionBy("block", "sub", "guest", "doc_id").orderBy("text")
    follow = Window.partitionBy("block", "sub").orderBy("guest", "doc_id", "text")
    dealt = dealt.repartition(3 * parts(docs.select("doc_id", "text")), "block", "sub").withColumn("at", F.row_number().over(same))
    nxt = {f"next_{c}": F.lead(c).over(follow) for c in ("doc_id", "at", "text")}
    return dealt.withColumns(nxt).filter("guest = 0").select("block", "sub", "doc_id", "at", "text", F.col("next_doc_id").alias("next_id"), "next_at", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text whose last floor(n/2) code points are replaced by as many of the next text's first."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row's text; the general operator, dealt by a hash of doc_id."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("v"))
    # rows of one doc_id and text are one set of words
    words = rows.dropDuplicates(["doc_id", "v"]).select("doc_id", "v", F.explode_outer(F.filter(F.split("text", SPACE), lambda w: w != "")).alias("word"))
    got = signatures(words.filter(F.col("word").isNotNull()).select("doc_id", "v", F.xxhash64("word").alias("h")), ["doc_id", "v"])
    got = got.select(F.col("doc_id").alias("_id"), F.col("v").alias("_v"), as_text().alias("fingerprint"))
    met = rows.select("doc_id", "v").join(got, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("v") == F.col("_v")), "left")
    return met.select("doc_id", F.coalesce("fingerprint", F.lit(_EMPTY)).alias("fingerprint"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, at, next_id, next_at, n_chars, edited_sha256, fingerprint, edited_fingerprint of each row."""
    pairs = with_next(docs, 12 * parts(docs.select("doc_id", "text"))).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    keys = ["block", "sub", "doc_id", "at"]
    both = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("x")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("x")))).alias("e"))
    words = both.select(*keys, "e.which", F.explode(F.filter(F.split("e.x", SPACE), lambda w: w != "")).alias("word"))
    sig = signatures(words.select(*keys, "which", F.xxhash64("word").alias("h")), [*keys, "which"]).select(*keys, "which", as_text().alias("print"))
    told = pairs.select(*keys, "next_id", "next_at", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    facts = ["next_id", "next_at", "n_chars", "edited_sha256"]
    prints = [F.when(F.col("which") == k, F.col("print")).alias(c) for k, c in enumerate(("fingerprint", "edited_fingerprint"))]
    # a union, not a join: a join would push its null tests below one side's exchange of texts, and that would then be made twice
    whole = told.select(*keys, *facts, *[F.lit(None).cast("string").alias(c) for c in ("fingerprint", "edited_fingerprint")])
    whole = whole.unionByName(sig.select(*keys, *prints), allowMissingColumns=True)
    full = whole.groupBy(*keys).agg(*[F.max(c).alias(c) for c in [*facts, "fingerprint", "edited_fingerprint"]])
    return full.withColumns({c: F.coalesce(c, F.lit(_EMPTY)) for c in ("fingerprint", "edited_fingerprint")})


def near(full: DataFrame) -> DataFrame:
    """compared()'s rows (a written table) with near_edited and near_next."""
    following = full.select(F.col("doc_id").alias("next_id"), F.col("at").alias("next_at"), F.col("fingerprint").alias("next_fingerprint"))
    mine = full.withColumnsRenamed({"next_id": "_id", "next_at": "_at"})
    out = mine.join(following, F.col("_id").eqNullSafe(F.col("next_id")) & (F.col("_at") == F.col("next_at")), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
