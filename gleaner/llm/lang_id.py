"""Language ID by rank-order profiles.

A language's profile is its `size` most frequent letter n-grams (one to three code points, words framed by blanks) in
order of frequency, counted over a bounded sample of labelled documents: at most `max_train` a language, those of
lowest hash. A document's own profile is made of all of its text, and its distance to a language is the sum of the
places by which its n-grams are out of place, `size` for one that the language lacks; the least distance wins, ties
going to the language that comes first by name. Profiles are keyed by packed code points, so that ranks are looked up
for a whole batch by binary search.

Null texts and texts without a letter are `und` with score 0. Without labelled documents all are `und`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_held_out, on_texts

ORDERS = (1, 2, 3)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text's words (lower case, letters only) as packed code points, and their counts."""
    low = text.lower()
    if low.isascii():
        a = np.frombuffer(low.encode(), np.uint8).astype(np.int64)
        letter = (a >= 97) & (a <= 122)
    else:
        a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kinds, inverse = np.unique(a, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in kinds], bool)[inverse]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.where(letter, a, 0)
    a = np.concatenate([[0], a, [0]])
    a = a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]  # runs of other characters are one blank
    all_of = [a[a != 0]]
    two = (a[:-1] << 21) | a[1:]
    three = (two[:-1] << 21) | a[2:]
    all_of += [two | (1 << 42), three[a[1:-1] != 0] | (1 << 62)]
    return np.unique(np.concatenate(all_of), return_counts=True)


def profile(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, best first; ties by code."""
    if len(keys) > size:  # cut to those that may be in it before sorting
        keep = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


class Profiles:
    def __init__(self, names: list[str], ranked: list[np.ndarray], size: int):
        self.names, self.size = names, size
        self.keys = np.unique(np.concatenate(ranked)) if ranked else np.empty(0, np.int64)
        self.rank = np.full((len(names), len(self.keys) + 1), -1, np.int64)
        for i, r in enumerate(ranked):
            self.rank[i, np.searchsorted(self.keys, r)] = np.arange(len(r))

    def predict(self, text: str) -> tuple[str, float]:
        keys, counts = grams(text)
        if not len(keys) or not self.names:
            return "und", 0.0
        own = profile(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = np.where(self.keys[at] == own, at, len(self.keys))
        there = self.rank[:, at]
        d = np.where(there < 0, self.size, np.abs(there - np.arange(len(own)))).sum(1)
        best = int(d.argmin())
        # 1: in place throughout; 0: no n-gram in common
        return self.names[best], float(1 - d[best] / (self.size * len(own)))


def fit(docs: DataFrame, size: int = 400, max_train: int = 1000) -> Profiles:
    """Profiles of the labelled documents outside the held-out quarter, at most max_train a language."""
    some = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles([], [], size)
    # a share by hash brings a little over max_train rows a language to the exact cut
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.5 * max_train / n + 50 / n))) for k, n in counts.items()])
    drawn = some.select("doc_id", "lang", "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = drawn.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= max_train).drop("at")

    def run(batches):
        import pandas as pd

        total: dict[str, dict] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                keys, n = grams(text)
                total.setdefault(lang, []).append((keys, n))
        for lang, got in total.items():
            k, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            n = np.bincount(at, np.concatenate([g[1] for g in got])).astype(np.int64) if len(k) else np.empty(0, np.int64)
            yield pd.DataFrame({"lang": lang, "gram": k, "n": n})

    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = drawn.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= size).orderBy("lang", "at").collect()  # size rows a language
    names = sorted({r["lang"] for r in rows})
    return Profiles(names, [np.array([r["gram"] for r in rows if r["lang"] == k], np.int64) for k in names], size)


def predicted(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (doc_id), lang_pred and score."""
    keep = keep or ["doc_id"]
    out = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"

    def run(part, texts):
        got = [profiles.predict(t) for t in texts]
        return {c: part.column(part.schema.get_field_index(c)) for c in keep} | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return on_texts(docs.select(*dict.fromkeys([*keep, "text"])), "text", out, run)
