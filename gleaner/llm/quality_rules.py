"""Quality rules: gradient-boosted trees over document statistics.

Every whole text gets its statistics in one pass. Base rules reject texts of under `min_words` words, and texts where
over a fifth of the words stand in repeated five-word windows. Boosted trees, fitted on a bounded sample of labelled
documents (`max_train` rows of lowest hash), judge the rest. Statistics that only junk raises (symbols, repeats, bars,
capitals, exclamation marks, repeated lines) may only lower a tree score. The fitted trees are flat numpy node arrays,
scored for all rows of a batch at once, level by level.

Null texts are empty: all statistics 0, rejected by the base rules. Without labels of both classes there are no trees,
and the base rules alone decide. Rows that share a doc_id are judged one by one; repeated labels count once, the
highest quality of a doc_id holding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, is_held_out, on_texts

WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: name -> how a tree score may move as it rises (-1: only down, 0: freely)
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "bars_per_word": -1,
    "capital_share": -1, "marks_per_word": -1, "same_as_last_share": -1, "distinct_share": 0, "stops_per_word": 0, "digit_share": 0,
}
_KEEP = {name: bytes(c for c in range(256) if c not in chars) for name, chars in (("symbols", b"#*$%&|<>"), ("bars", b"|"), ("capitals", bytes(range(65, 91))), ("letters", bytes(range(65, 91)) + bytes(range(97, 123))), ("marks", b"!?"), ("stops", b".,;:"), ("digits", b"0123456789"))}


def repeated_words(codes: np.ndarray) -> int:
    """Words in five-word windows that are found twice or more, the first included."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n + 1, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit[:n])
    edge = np.zeros(len(codes) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The contract's counts and the trees' features of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, ASCII_SPACE)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    count = {k: len(raw.translate(None, drop)) for k, drop in _KEEP.items()}
    codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeat = repeated_words(codes)
    same = int((codes[1:] == codes[:-1]).sum())
    per = 1.0 / max(1, n)
    return [n, chars, count["symbols"], dup, repeat], [
        np.log1p(n), chars * per, count["symbols"] * per, dup / max(1, len(lines)), repeat * per, count["bars"] * per,
        count["capitals"] / max(1, count["letters"]), count["marks"] * per, same * per, len(set(words)) * per, count["stops"] * per, count["digits"] / max(1, len(raw)),
    ]


@dataclass
class Trees:
    """Flat node arrays of all trees: a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Trees | None:
    """Logistic boosting by histograms. A split on a constrained feature whose leaves go the wrong way is not made, and the middle of its leaves bounds all below it."""
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    p0 = y.mean()
    base = float(np.log(p0 / (1 - p0)))
    f = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots = []

    def leaf(g, h, lo, hi):
        return float(np.clip(-g / (h + l2), lo, hi))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        todo = [(len(nodes), np.arange(len(y)), 0, -np.inf, np.inf)]
        nodes.append([0, 0.0, 0, 0, 0.0])
        while todo:
            at, rows, level, lo, hi = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value = leaf(gs, hs, lo, hi)
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    k = len(c) + 1
                    if k < 2:
                        continue
                    b = code[rows, j]
                    gl, hl = np.cumsum(np.bincount(b, g[rows], k))[:-1], np.cumsum(np.bincount(b, h[rows], k))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=k))[:-1]
                    vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(gs - gl) / (hs - hl + l2), lo, hi)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    ok = (nl >= least) & (len(rows) - nl >= least) & (signs[j] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -1)
                    i = int(gain.argmax())
                    if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                        best = (gain[i], j, i, vl[i], vr[i])
            if best is None:
                nodes[at] = [0, np.inf, at, at, rate * value]
                f[rows] += rate * value
                continue
            _, j, i, vl, vr = best
            mid = (vl + vr) / 2
            left, right = rows[code[rows, j] <= i], rows[code[rows, j] > i]
            a = len(nodes)
            nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
            nodes[at] = [j, cuts[j][i], a, a + 1, 0.0]
            bounds = {0: ((lo, hi), (lo, hi)), -1: ((max(lo, mid), hi), (lo, min(hi, mid))), 1: ((lo, min(hi, mid)), (max(lo, mid), hi))}[signs[j]]
            todo += [(a, left, level + 1, *bounds[0]), (a + 1, right, level + 1, *bounds[1])]
    t = np.array(nodes, float)
    return Trees(t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4], np.array(roots), depth, base)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> DataFrame:
    """At most max_train labelled documents outside the held-out quarter, those of lowest hash: small enough to broadcast."""
    pick = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    pick = pick.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    return docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> Trees | None:
    """Trees for labels.quality, of at most max_train documents' statistics."""
    schema = "label int, " + ", ".join(f"{k} double" for k in FEATURES)

    def run(part, texts):
        s = np.array([statistics(t)[1] for t in texts]).reshape(-1, len(FEATURES))
        return {"label": part.column(part.schema.get_field_index("label"))} | {k: s[:, j] for j, k in enumerate(FEATURES)}

    rows = on_texts(training_rows(docs, labels, "quality", max_train), "text", schema, run).toPandas()
    x = rows[list(FEATURES)].to_numpy(float)
    return fit_trees(x, rows["label"].to_numpy(float), list(FEATURES.values()))


def judged(docs: DataFrame, trees: Trees | None, min_words: int = 10, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (doc_id), the counts, base_failed, quality_score and kept."""
    keep = keep or ["doc_id"]
    base = docs.schema
    out = ", ".join(f"`{c}` {base[c].dataType.simpleString()}" for c in keep) + ", " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, quality_score double, kept boolean"

    def run(part, texts):
        both = [statistics(t) for t in texts]
        n = np.array([b[0] for b in both], np.int64).reshape(-1, len(BASE))
        score = trees.score(np.array([b[1] for b in both]).reshape(-1, len(FEATURES))) if trees else np.ones(len(texts))
        failed = (n[:, 0] < min_words) | (100 * n[:, 4] > 20 * n[:, 0])
        return {c: part.column(part.schema.get_field_index(c)) for c in keep} | {c: n[:, j] for j, c in enumerate(BASE)} | {"base_failed": failed, "quality_score": score, "kept": ~failed & (score >= threshold)}

    return on_texts(docs.select(*dict.fromkeys([*keep, "text"])), "text", out, run)
