"""Line dedup: later copies of repeated line runs are deleted.

A document is a sequence of line ids (128-bit hashes). Its suffixes are ranked by distributed prefix doubling: round k
has the rank of each place's first 2^k lines; the pair (rank here, rank 2^k lines on) stands for the first 2^(k+1), and
the pairs that occur more than once are sorted over the cluster and numbered in that order, which is the next round's
rank. Places whose first 2^k lines occur nowhere else have no rank: their suffixes are told apart already, and so is
every suffix that reaches over one. What is left is the part of the suffix array where neighbours have a common prefix.

Its longest-common-prefix intervals are read off the ranks: two suffixes have their first m lines in common if the
ranks of the 2^k lines from each one's start and of the 2^k lines up to its m-th are equal (k: the power of two up to
m). For each place the depths m in question are the shortest prefix of at least `min_words` words, and each longer one
that ends before the shortest prefix of the next line with words does, or at the document's end where that line has
none: over a document no more than it has lines. In an interval the suffix of the least (doc_id, line) is the first
copy, and the lines of every other one go. The last line from which a repeated run still has `min_words` words has a
depth that ends where the run does, and those before it overlap with that, so what goes is just the maximal repeated
runs of at least `min_words` words, their first copies left. A run begins at a line with words.

Texts that are equal as a whole are grouped first, and only the first of them (least doc_id) is ranked: of the others
all from the first line with words goes, if it has `min_words` words. Pairs and intervals are counted with partial
sums, and the size lets frequent ones be met by a bounded broadcast, so no task gets all places of one.

Null texts stay null; empty lines belong to runs but hold no words. Rows with the same doc_id and text are one document
and get the same result; rows of one doc_id with other texts are documents of their own. Rows without a doc_id are not
looked at, and stay as they are. A very long text is one row of the map stages. Empty tables give no rows. All columns
are kept as they are, but for columns n_lines and n_removed of the input, which the operator's own replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_hot, on_texts, parts, texts_of, written

PLACE = ["doc_id", "version", "line"]


def needed_depths(words: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line of documents laid end to end the least depth in question (0: none), and how many there are.

    words: of each line; first: where each document begins.
    """
    n = len(words)
    stop, many = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return stop, many
    end_of = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    held = np.concatenate([[0], np.cumsum(words)])
    reach = np.searchsorted(held, held[:-1] + min_words, "left")
    place = np.flatnonzero((reach <= end_of) & (words > 0))
    worded = np.append(np.flatnonzero(words > 0), n)
    after = worded[np.searchsorted(worded, place, "right")]  # the next line with words
    last = np.minimum(np.append(reach, n + 1)[after] - 1, end_of[place])
    stop[place] = reach[place] - place
    many[place] = np.maximum(last - reach[place], 0) + 1
    return stop, many


def places(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version (hash of the text), line, stop and many (needed_depths()), and the line's 128 bits a, b, of texts with enough words."""

    def run(batches):
        import xxhash

        for batch in batches:
            for part, texts in texts_of(batch, "text", 4 << 20):
                raw = [t.encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
                words = [[len(x.split()) for x in r] for r in raw]
                some = [i for i, w in enumerate(words) if sum(w) >= min_words]
                n = np.array([len(raw[i]) for i in some], np.int64)
                first = np.cumsum(n) - n
                lines = [x for i in some for x in raw[i]]
                ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(-1, 2)
                stop, many = needed_depths(np.array([w for i in some for w in words[i]], np.int64), first, min_words)
                owner = np.repeat(np.array(some, np.int64), n)
                line = np.arange(len(lines)) - np.repeat(first, n)
                of = [part.column(c).take(pa.array(owner)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*of, *(pa.array(x.astype(np.int32)) for x in (line, stop, many)), pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=[*PLACE, "stop", "many", "a", "b"])

    return docs.mapInArrow(run, "doc_id long, version long, line int, stop int, many int, a long, b long")


def ranked(pairs: DataFrame, keys: list[str], many: int) -> DataFrame:
    """keys, n, rank of the keys that occur more than once (a written table): ranks are in the order of the keys."""
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    in_order = counts.repartitionByRange(many, *keys).sortWithinPartitions(*keys)
    return written(in_order.withColumn("rank", F.monotonically_increasing_id()))


def doubled(ranks: DataFrame, k: int, many: int) -> DataFrame:
    """Two kinds of rows of the k-th ranks (PLACE, stop, many, rank): pairs (depth 0; r, other: the ranks here and 2^k lines
    on), and the prefixes of the depths in question from 2^k to below 2^(k+1) (r, other: their names)."""
    span = 1 << k
    names = [*PLACE, "stop", "many", "depth", "r", "other"]

    def out(cols):
        new = np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))) if len(cols[0]) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(cols[0]))))
        line, stop, count, rank = (c.astype(np.int64) for c in cols[2:])
        key = (doc << 32) + line

        def at(i, far):
            """Where the rank of the line `far` after i's is, and whether it is there."""
            want = key[i] + far
            j = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
            return j, key[j] == want

        i = np.arange(len(key))
        j, there = at(i, span)
        i, j = i[there], j[there]
        low, high = np.maximum(stop, span), np.minimum(stop + count, 2 * span)
        depths = np.where(stop > 0, np.maximum(high - low, 0), 0)
        own = np.repeat(np.arange(len(key)), depths)
        depth = np.arange(len(own)) - np.repeat(np.cumsum(depths) - depths, depths) + np.repeat(low, depths)
        to, found = at(own, depth - span)
        own, depth, to = own[found], depth[found], to[found]
        every, other, deep = np.concatenate([i, own]), np.concatenate([j, to]), np.concatenate([np.zeros(len(i), np.int64), depth])
        return pa.RecordBatch.from_arrays([*(pa.array(c[every]) for c in cols[:5]), pa.array(deep.astype(np.int32)), pa.array(rank[every]), pa.array(rank[other])], names=names)

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in range(6)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
            if len(last):  # the last document may go on in the next batch
                cut = int(last[-1]) + 1
                yield out([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield out(held)

    rows = ranks.select(*PLACE, "stop", "many", "rank").repartition(many, "doc_id", "version").sortWithinPartitions(*PLACE)
    return rows.mapInArrow(run, "doc_id long, version long, line int, stop int, many int, depth int, r long, other long")


def repeated(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, version, runs: (line, depth) of each later copy of a run; (-1, 0): all from the first line with words."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    whole = ["version", "size", "check"]
    named = rows.select("doc_id", "version", F.length("text").alias("size"), F.hash("text").alias("check")).distinct()
    first = written(named.groupBy(*whole).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = written(join_hot(named, first, whole, "n").filter("doc_id <> first").select("doc_id", "version"))
    many = parts(rows, 64)
    base = written(places(rows, min_words).join(later, ["doc_id", "version"], "left_anti"))
    deepest = base.agg(F.max(F.col("stop") + F.col("many") - 1).alias("m")).first()["m"] or 0
    told = later.select("doc_id", "version", F.lit(-1).alias("line"), F.lit(0).alias("depth"))
    prefixes = []
    pairs, keys, k = base, ["a", "b"], 0
    while deepest >> k:
        table = ranked(pairs, keys, many)
        if table.isEmpty():
            break
        ranks = join_hot(pairs, table, keys, "n").filter("rank IS NOT NULL")
        both = written(doubled(ranks, k, many))
        prefixes.append(both.filter("depth > 0").select(*PLACE, "depth", "r", "other"))
        pairs, keys, k = both.filter("depth = 0"), ["r", "other"], k + 1
    if prefixes:
        # a depth tells the round, so prefixes of all rounds may stand in one table
        table = prefixes[0]
        for p in prefixes[1:]:
            table = table.unionByName(p)
        here = F.struct(*PLACE)
        intervals = written(table.groupBy("depth", "r", "other").agg(F.min(here).alias("kept"), F.count("*").alias("n")).filter("n > 1"))
        met = join_hot(table, intervals, ["depth", "r", "other"], "n").filter(F.col("kept").isNotNull() & (here != F.col("kept")))
        told = told.unionByName(met.select(*PLACE, "depth"))
    return told.groupBy("doc_id", "version").agg(F.collect_list(F.struct("line", "depth")).alias("runs"))


def deduped(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with text without its later copies, and n_lines and n_removed (longs)."""
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    d, v, r = (fresh(docs, c) for c in ("doc", "version", "runs"))
    runs = repeated(docs, min_words).select(F.col("doc_id").alias(d), F.col("version").alias(v), F.col("runs").alias(r))
    joined = docs.join(runs, (docs["doc_id"] == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(v)), "left").drop(d, v)
    out = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", n_lines long, n_removed long"

    def run(part, texts):
        runs, was = part.column(len(names)).to_pylist(), part.column(names.index("text"))
        new, total, gone = [], [], []
        for t, r, null in zip(texts, runs, was.is_null().to_pylist(), strict=True):
            n = 0 if null else t.count("\n") + 1
            lost = 0
            if r:
                lines = t.split("\n")
                drop = np.zeros(n + 1, np.int64)
                for x in r:
                    if x["line"] < 0:
                        counts = [len(y.encode("utf-8", "surrogatepass").split()) for y in lines]
                        a, b = (next(i for i, c in enumerate(counts) if c), n) if sum(counts) >= min_words else (0, 0)
                    else:
                        a, b = x["line"], x["line"] + x["depth"]
                    drop[a] += 1
                    drop[b] -= 1
                stay = np.cumsum(drop[:-1]) == 0
                lost = int(n - stay.sum())
                t = "\n".join([x for x, s in zip(lines, stay, strict=True) if s])
            new.append(None if null else t)
            total.append(n)
            gone.append(lost)
        cols = {c: part.column(i) for i, c in enumerate(names)}
        return cols | {"text": new, "n_lines": total, "n_removed": gone}

    return on_texts(joined, "text", out, run)
