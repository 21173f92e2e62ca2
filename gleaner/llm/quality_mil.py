"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded as hashed word shapes and passage
statistics, projected and squashed; gated attention (a tanh branch times a sigmoid branch) gives each passage a
weight, the weights sum to 1 over the document, and the weighted mean of its passages is scored. Only document labels
are learned from: attention, encoder and score are fitted together by Adam on a bounded sample of labelled documents
(`max_train`, those of lowest hash, outside the held-out quarter).

A document's last passage holds the words left over. Null and empty texts are one passage without words. Passages of
a very long text are encoded as a stream of blocks, whose weights are summed as they come, so memory stays bounded.
Without labels of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import on_texts
from .quality_rules import training_rows

PASSAGE = 128
BUCKETS = 128
_STATS = 9
_SHAPES: dict[bytes, int] = {}
_DROP = {k: bytes(c for c in range(256) if c not in chars) for k, chars in (("capital", bytes(range(65, 91))), ("letter", bytes(range(65, 91)) + bytes(range(97, 123))), ("symbol", b"#*$%&|<>"), ("mark", b"!?"), ("stop", b".,;:"), ("digit", b"0123456789"))}


def _bucket(word: bytes) -> int:
    """Bucket of a word's marks and ends: what a word looks like, not which word it is."""
    got = _SHAPES.get(word)
    if got is None:
        if len(_SHAPES) > 500_000:
            _SHAPES.clear()
        low = word.lower()
        shape = (b"A" if word[:1].isupper() else b"a") + (b"U" if word.isupper() else b"-") + low[-2:] + bytes([48 + min(9, len(word) // 3)])
        got = _SHAPES[word] = zlib.crc32(shape) % BUCKETS
    return got


def passages(text: str) -> np.ndarray:
    """A row a passage."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    count = max(1, -(-n // PASSAGE))
    x = np.zeros((count, BUCKETS + _STATS), np.float32)
    if not n:
        x[0, -1] = 1
        return x
    codes = np.fromiter(map(hash, words), np.int64, n)
    where = np.arange(n) // PASSAGE
    held = np.bincount(where, minlength=count).astype(np.float32)
    buckets = np.fromiter(map(_bucket, words), np.int64, n)
    x[:, :BUCKETS] = np.sqrt(np.bincount(where * BUCKETS + buckets, minlength=count * BUCKETS).reshape(count, BUCKETS) / held[:, None])
    same = np.zeros(n)
    same[1:] = codes[1:] == codes[:-1]
    for i in range(count):
        part = words[i * PASSAGE : (i + 1) * PASSAGE]
        raw = b" ".join(part)
        c = {k: len(raw.translate(None, d)) for k, d in _DROP.items()}
        m = len(part)
        x[i, BUCKETS:] = [
            c["symbol"] / m, c["mark"] / m, c["stop"] / m, c["digit"] / len(raw), c["capital"] / max(1, c["letter"]), len(set(part)) / m,
            (len(raw) - m + 1) / m / 8, same[i * PASSAGE : i * PASSAGE + m].mean(), 0,
        ]
    return x


def _forward(w: dict, x: np.ndarray):
    h = np.tanh(x @ w["e"] + w["eb"])
    a, b = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    return h, a, b, (a * b) @ w["w"]


def score(w: dict, x: np.ndarray, block: int = 4096) -> float:
    """The document's probability of label 1; passages are taken a block at a time."""
    top, total, mean = -np.inf, 0.0, np.zeros(w["e"].shape[1])
    for at in range(0, len(x), block):
        h, _, _, s = _forward(w, (x[at : at + block] - w["mu"]) / w["sd"])
        new = max(top, float(s.max()))
        scale = np.exp(top - new) if total else 0.0
        e = np.exp(s - new)
        mean, total, top = mean * scale + e @ h, total * scale + float(e.sum()), new
    return float(1 / (1 + np.exp(-(mean / total @ w["c"] + w["cb"]))))


def fit_bags(bags: list[np.ndarray], y: np.ndarray, hidden: int = 16, attention: int = 8, epochs: int = 25, rate: float = 0.01, l2: float = 1e-4, batch: int = 64, seed: int = 7) -> dict:
    """Weights of encoder, gated attention and score, by Adam on the documents' log loss; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mu, sd = every.mean(0), every.std(0) + 0.05
    d = every.shape[1]
    w = {"e": rng.normal(0, d**-0.5, (d, hidden)), "eb": np.zeros(hidden), "v": rng.normal(0, 0.3, (hidden, attention)), "u": rng.normal(0, 0.3, (hidden, attention)), "w": rng.normal(0, 0.3, attention), "c": rng.normal(0, 0.3, hidden), "cb": np.zeros(())}
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            n = np.array([len(bags[i]) for i in pick])
            x = (np.concatenate([bags[i] for i in pick]) - mu) / sd
            owner, first = np.repeat(np.arange(len(pick)), n), np.concatenate([[0], np.cumsum(n)[:-1]])
            h, a, b, s = _forward(w, x)
            e = np.exp(s - np.maximum.reduceat(s, first)[owner])
            alpha = e / np.add.reduceat(e, first)[owner]
            z = np.add.reduceat(alpha[:, None] * h, first)
            p = 1 / (1 + np.exp(-(z @ w["c"] + w["cb"])))
            dout = (p - y[pick]) * weight[pick] / len(pick)
            dz = dout[:, None] * w["c"]
            dalpha = (dz[owner] * h).sum(1)
            ds = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[owner])
            da, db = ds[:, None] * w["w"] * b * (1 - a * a), ds[:, None] * w["w"] * a * b * (1 - b)
            dh = alpha[:, None] * dz[owner] + da @ w["v"].T + db @ w["u"].T
            de = dh * (1 - h * h)
            g = {"e": x.T @ de, "eb": de.sum(0), "v": h.T @ da, "u": h.T @ db, "w": (a * b).T @ ds, "c": z.T @ dout, "cb": dout.sum()}
            step += 1
            for k in w:
                gk = g[k] + (l2 * w[k] if k in ("e", "v", "u", "c") else 0)
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return w | {"mu": mu, "sd": sd}


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 3000) -> dict | float:
    """Weights for labels.quality from at most max_train documents; their share of label 1 where only one class is there."""

    def run(part, texts):
        bags = [passages(t) for t in texts]
        return {"label": part.column(part.schema.get_field_index("label")), "n": [len(b) for b in bags], "x": [b.tobytes() for b in bags]}

    rows = on_texts(training_rows(docs, labels, "quality", max_train), "text", "label int, n int, x binary", run).collect()
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return fit_bags([np.frombuffer(r["x"], np.float32).reshape(r["n"], -1) for r in rows], y)


def scored(docs: DataFrame, model: dict | float, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (doc_id), score and predicted."""
    keep = keep or ["doc_id"]
    out = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"

    def run(part, texts):
        s = np.array([score(model, passages(t)) if isinstance(model, dict) else model for t in texts], float)
        return {c: part.column(part.schema.get_field_index(c)) for c in keep} | {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return on_texts(docs.select(*dict.fromkeys([*keep, "text"])), "text", out, run)
