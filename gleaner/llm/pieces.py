"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words where a run of blanks begins, and words into runs of letters, where no piece of the vocabulary
goes on past the cut; each task keeps its distinct runs. A run's lattice is relational: its substrings, bounded in
length by the longest piece that begins with the same three letters, are exploded, and an equi-join to the piece table (as many rows as the vocabulary, so it is broadcast) leaves the edges.
No text and no edge is exchanged. Edges are grouped by run and folded into the run's pieces:

* models of the unigram kind: Viterbi, by one `aggregate` over a word's edges in order of their ends;
* models of the BPE kind, as the public one is: their segmentation is not the path of the largest sum of scores, so
  Viterbi gives other ids than the library. The fold is that of merges instead: over the same edges, the adjacent pair
  whose edge has the best score is joined, the leftmost of equals first, until no edge joins two neighbours.

Characters without an edge become the ids of their UTF-8 bytes, or the unknown id (unigram models: always that). Each
document's ids are those of its words in order. Decoding looks up each id's bytes, puts them together, and restores
blanks.

Null and empty texts have no ids. Rows that share a doc_id, and repeated rows, are encoded one by one. Ties go to the
leftmost pair (merges) or the shorter last piece (Viterbi). Very long texts are read a slice of texts at a time, and
very long words stay whole: their lattice is built a chunk of starts at a time, and they are merged with a heap. An
empty table gives no rows. Of the columns only doc_id and text are read, so others, of whatever name, do not matter.
"""

from __future__ import annotations

import heapq
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, texts_of, written

BLANK = "▁"
CHUNK = 240
WORDS = 20 << 20  # bytes of words that a task remembers
NUMBERS = (1 << 23) - 1
_NONE = np.iinfo(np.int32).max
_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


@dataclass
class Model:
    """A vocabulary's pieces: those that texts match, and what stands for the rest."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int] | None
    unknown: int
    longest: int
    bpe: bool

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Each id's rank (0: the best score), and each rank's id."""
        ids = np.array([i for _, i, _ in sorted(self.pieces, key=lambda p: -p[2])], np.int64)
        rank = np.full(ids.max(initial=0) + 1, _NONE, np.int32)
        rank[ids] = np.arange(len(ids), dtype=np.int32)
        return rank, ids

    def cutter(self):
        """A function of words: the runs of all of them, and where each word's runs end.

        A word is cut between two letters that stand side by side in no piece, so that no piece goes past a cut.
        """
        pairs = sorted({p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1)})
        letters = sorted(set("".join(pairs)))
        code = np.zeros(0x110000, np.int16)
        code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for x, y in pairs:
            together[code[ord(x)], code[ord(y)]] = True

        def cut(words: list[str]) -> tuple[list[str], list[int]]:
            text = "".join(words)
            if not text:
                return [], [0] * len(words)
            c = code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
            last = np.append(~together[c[:-1], c[1:]], True)  # the last letter of a run
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            last[ends[ends > 0] - 1] = True
            bounds = np.flatnonzero(last) + 1
            flat, lo = [], 0
            for hi in bounds.tolist():
                flat.append(text[lo:hi])
                lo = hi
            return flat, np.searchsorted(bounds, ends, "right").tolist()

        return cut

    def reach(self):
        """A function of runs: for each letter of all of them, the length up to which its substrings may be pieces.

        That of the longest piece that begins with the same three letters, two if none does, and never past the run.
        """
        far: dict[str, int] = {}
        for p, _, _ in self.pieces:
            if len(p) > 2:
                far[p[:3]] = max(far.get(p[:3], 0), len(p))
        letters = sorted(set("".join(far)))
        code = np.zeros(0x110000, np.int16)
        code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        size = len(letters) + 1

        def key(c: np.ndarray) -> np.ndarray:
            c = c.astype(np.int64)
            return (c[..., :-2] * size + c[..., 1:-1]) * size + c[..., 2:]

        starts = sorted(far)
        keys = key(code[np.array([[ord(c) for c in t] for t in starts], np.int64).reshape(-1, 3)]).reshape(-1)
        order = np.argsort(keys)
        keys, most = np.append(keys[order], -1), np.append(np.array([far[t] for t in starts], np.int32)[order], 2)

        def bounds(runs: list[str], ends: np.ndarray) -> np.ndarray:
            text = "".join(runs)
            left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(text))
            own = np.full(len(text), 2, np.int32)
            k = key(code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")])
            at = np.searchsorted(keys[:-1], k)
            own[: len(k)] = np.where(keys[at] == k, most[at], 2)
            return np.minimum(own, left).astype(np.int32)

        return bounds


def load(path: str) -> Model:
    """A model file of the sentencepiece library with the identity normaliser, a blank before the text, and blanks kept."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    byte_ids = [i for i in range(n) if m.is_byte(i)]
    usual = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    pieces = [(m.id_to_piece(i), i, m.get_score(i)) for i in usual]
    # a BPE model's scores are minus the rank of each merge: whole numbers, each once
    bpe = all(float(s).is_integer() for _, _, s in pieces)
    return Model(pieces, byte_ids or None, m.unk_id(), max(len(p) for p, _, _ in pieces), bpe)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame(model.pieces, "piece string, id int, score double")


def normal(text):
    """Blanks as the vocabulary writes them, with one before a text that is not empty."""
    return F.when(F.length(text) > 0, F.concat(F.lit(BLANK), F.translate(text, " ", BLANK)))


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """words with start, n, id, score of each edge: a substring of at most `longest` letters that is a piece."""
    starts = words.select("*", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("n"))
    return spans.withColumn("piece", F.expr("substring(word, start, n)")).join(F.broadcast(table), "piece").drop("piece")


def viterbi(edges: DataFrame, unknown: int, penalty: float = -1e4) -> DataFrame:
    """word, ids: each word's best path, as one fold over its edges in order of end; ties go to the shorter last piece.

    The fold's state holds, for each place in the word, the best score so far and its ids. A letter without an edge is
    crossed as the unknown id at a penalty.
    """
    edge = F.struct((F.col("start") + F.col("n") - 1).alias("end"), "n", "start", "id", "score")
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    state = "array<struct<s:double,ids:array<int>>>"
    first = F.expr(f"cast(array(struct(0D, cast(array() as array<int>))) as {state})")

    def crossed(acc, upto):
        """acc with places up to `upto` that no edge ends at, reached by unknown letters."""
        extra = F.sequence(F.size(acc) + 1, upto + 1)
        last = F.element_at(acc, -1)
        fill = F.transform(extra, lambda j: F.struct((last["s"] + F.lit(penalty) * (j - F.size(acc))).alias("s"), F.concat(last["ids"], F.array_repeat(F.lit(unknown), (j - F.size(acc)).cast("int"))).alias("ids")))
        return F.when(F.size(acc) <= upto, F.concat(acc, fill)).otherwise(acc)

    def step(acc, e):
        filled = crossed(acc, e["end"] - 1)
        back = F.element_at(filled, e["start"])
        here = F.struct((back["s"] + e["score"]).alias("s"), F.concat(back["ids"], F.array(e["id"])).alias("ids"))
        # a place already has a path: the better one stays, the first among equals
        there = F.get(filled, e["end"])
        return F.when(there.isNull(), F.concat(filled, F.array(here))).when(here["s"] > there["s"], F.concat(F.slice(filled, F.lit(1), e["end"]), F.array(here))).otherwise(filled)

    folded = grouped.withColumn("best", F.aggregate("edges", first, step))
    return folded.select("word", F.element_at(crossed(F.col("best"), F.length("word")), -1)["ids"].alias("ids"))


# ---- merges


def joined(size: int, rank: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """(start, n) of one long word's symbols once no edge joins two neighbours; a heap holds the pairs to join."""
    n, before = [1] * size, list(range(-1, size - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(s: int, t: int) -> None:
        r = rank.get((s, n[s] + n[t]))
        if r is not None:
            heapq.heappush(heap, (r, s, n[s], n[t]))

    for s in range(size - 1):
        offer(s, s + 1)
    while heap:
        _, s, left, right = heapq.heappop(heap)
        t = s + left
        if n[s] != left or t >= size or n[t] != right:  # one of the two has grown or gone
            continue
        n[s], n[t] = left + right, 0
        after = s + n[s]
        if after < size:
            before[after] = s
            offer(s, after)
        if before[s] >= 0:
            offer(before[s], s)
    return [(s, k) for s, k in enumerate(n) if k]


def word_ids(words: list[str], edges: np.ndarray, model: Model, ranks: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Ids of words as little-endian bytes. edges: (word, start, n, id) rows in order of word, starts from 0.

    All words of one length are merged at once, a step joining each word's best pair; words over 64 letters are merged
    one by one.
    """
    rank_of, id_of = ranks
    out: list[bytes] = [b""] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.searchsorted(edges[:, 0], np.arange(len(words) + 1))

    def spelt(w: int, parts_of: list[tuple[int, int]], known: dict[tuple[int, int], int]) -> bytes:
        ids: list[int] = []
        for s, n in parts_of:
            i = known.get((s, n))
            if i is not None:
                ids.append(id_of[i])
            elif model.byte_ids:
                ids += [model.byte_ids[b] for b in words[w][s : s + n].encode("utf-8", "surrogatepass")]
            else:
                ids.append(model.unknown)
        return np.array(ids, "<u4").tobytes()

    def own(w: int) -> dict[tuple[int, int], int]:
        e = edges[first[w] : first[w + 1]]
        return dict(zip(zip(e[:, 1].tolist(), e[:, 2].tolist(), strict=True), rank_of[e[:, 3]].tolist(), strict=True))

    at = np.zeros(len(words), np.int64)
    length_of_edge = lengths[edges[:, 0]]
    for size in np.unique(lengths).tolist():
        who = np.flatnonzero(lengths == size)
        if size > 64:
            for w in who.tolist():
                known = own(w)
                out[w] = spelt(w, joined(size, known), known)
            continue
        if size == 0:
            continue
        width = min(size, model.longest)
        of_size = edges[length_of_edge == size]
        step = max(1, 400_000 // (size * width))
        for a in range(0, len(who), step):
            some = who[a : a + step]
            at[some] = np.arange(len(some))
            lo, hi = np.searchsorted(of_size[:, 0], [some[0], some[-1] + 1])
            e = of_size[lo:hi]
            rank = np.full((len(some), size + 1, width + 1), _NONE, np.int32)
            rank[at[e[:, 0]], e[:, 1], e[:, 2]] = rank_of[e[:, 3]]
            starts = _merged(rank, size, width)
            row, pos = np.nonzero(starts)
            until = np.append(pos[1:], size)
            until[np.flatnonzero(np.diff(row))] = size
            got = rank[row, pos, until - pos]
            ends = np.cumsum(starts.sum(1))
            raw = id_of[np.where(got < _NONE, got, 0)].astype("<u4").tobytes()
            lo = 0
            for w, hi in zip(some.tolist(), (4 * ends).tolist(), strict=True):
                out[w] = raw[lo:hi]
                lo = hi
            for r in np.unique(row[got == _NONE]).tolist():  # letters that are no piece
                b = np.flatnonzero(starts[r]).tolist()
                out[some[r]] = spelt(int(some[r]), list(zip(b, np.diff([*b, size]).tolist(), strict=True)), own(int(some[r])))
    return out


def _merged(rank: np.ndarray, size: int, width: int) -> np.ndarray:
    """Where symbols begin in words of one size once no edge joins two neighbours; rank: (word, start, n)."""
    starts = np.ones((len(rank), size), bool)
    live, places = np.arange(len(rank)), np.arange(size)
    while len(live):
        s = starts[live]
        # where the next symbol starts, and where it ends, for each place
        pos = np.where(s, places, size)
        nxt = np.minimum.accumulate(np.concatenate([pos[:, 1:], np.full((len(live), 1), size)], 1)[:, ::-1], 1)[:, ::-1]
        after = np.take_along_axis(np.concatenate([nxt, np.full((len(live), 1), size)], 1), nxt, 1)
        n = np.where(s & (nxt < size), after - places, 0)
        n[n > width] = 0
        cost = np.where(n > 0, rank[live[:, None], places[None, :], n], _NONE)
        best = cost.argmin(1)
        can = np.flatnonzero(cost[np.arange(len(live)), best] < _NONE)
        starts[live[can], nxt[can, best[can]]] = False
        live = live[can]
    return starts


# ---- texts


def words_of(text: str) -> list[str]:
    """The text's words, each without the blank that it begins with."""
    if not text:
        return []
    if text[0] == " " or "  " in text or BLANK in text:
        return [w[1:] for w in _WORDS.findall(BLANK + text.replace(" ", BLANK))]
    return text.split(" ")


def _size(words) -> int:
    """Bytes that a remembered word costs, about: its letters and what Python keeps beside them."""
    return sum(map(len, words)) + 100 * len(words)


def new_runs(docs: DataFrame, model: Model, most: int) -> DataFrame:
    """Rows of one stream: each slice's runs that its task has not met (a, far, s), then its texts (a null, s).

    a: the run's number, shifted by 40 bits; s: up to CHUNK of its letters, and as many more as a piece may reach; far:
    a zero, and for each of the letters how long its substrings may be. After `most` bytes of runs a task forgets them,
    which a row with a = -1 tells, so that its memory is bounded.
    """
    longest, cut, bounds = model.longest, model.cutter(), model.reach()
    schema = pa.schema([("a", pa.int64()), ("far", pa.list_(pa.int32())), ("s", pa.string()), ("doc_id", pa.int64())])

    def zeros(n):
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.zeros(n, np.int32)))

    def run(batches):
        seen: set[str] = set()
        met: set[str] = set()
        count = held = held_words = 0
        for batch in batches:
            for part, texts in texts_of(batch, "text", 1 << 20):
                if held >= most:
                    seen, met, held, held_words = set(), set(), 0, 0
                    yield pa.RecordBatch.from_arrays([pa.array([-1]), zeros(1), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], schema=schema)
                if held_words >= WORDS:
                    met, held_words = set(), 0
                words = dict.fromkeys(w for t in texts for w in words_of(t) if w not in met)
                met.update(words)
                held_words += _size(words)
                fresh = [u for u in dict.fromkeys(cut([BLANK + w for w in words])[0]) if u not in seen]
                seen.update(fresh)
                held += _size(fresh)
                ends = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))
                size = np.diff(ends, prepend=0)
                chunks = -(-size // CHUNK)
                number = np.repeat(np.arange(count, count + len(fresh)) & NUMBERS, chunks)
                base = (np.arange(len(number)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
                first = np.repeat(ends - size, chunks) + base
                far = np.insert(bounds(fresh, ends), first, 0)
                offsets = np.append(first + np.arange(len(first)), len(far)).astype(np.int32)
                s = fresh if len(number) == len(fresh) else [fresh[i][b : b + CHUNK + longest - 1] for i, b in zip(np.repeat(np.arange(len(fresh)), chunks).tolist(), base.tolist(), strict=True)]
                count += len(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(number << 40), pa.ListArray.from_arrays(pa.array(offsets), pa.array(far)), pa.array(s, pa.string()), pa.nulls(len(s), pa.int64())], schema=schema)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), zeros(n), pa.array(texts, pa.string()), part.column(0).cast(pa.int64())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "a long, far array<int>, s string, doc_id long")


def stream_edges(stream: DataFrame, table: DataFrame) -> DataFrame:
    """The lattice of a stream's runs: its rows as they are, and each run's edges after it (a: with start, n and id)."""
    starts = stream.select("a", "s", "doc_id", F.posexplode("far").alias("start", "far"))
    spans = starts.select("*", F.explode(F.expr("if(start = 0, array(0), sequence(1, far))")).alias("n"))
    met = spans.withColumn("piece", F.expr("if(n > 0, substring(s, start, n), null)")).join(F.broadcast(table), "piece", "left").filter("n = 0 OR id IS NOT NULL")
    return met.selectExpr("if(n = 0, a, a + shiftleft(cast(start AS long), 32) + shiftleft(cast(n AS long), 24) + id) AS a", "if(n = 0, s, null) AS s", "doc_id")


class Folding:
    """What a task does with its stream: runs to ids, then texts to the ids of their runs, and these to columns."""

    def __init__(self, model: Model, columns):
        self.model, self.ranks, self.cut, self.columns = model, model.ranks(), model.cutter(), columns
        self.known: dict[str, bytes] = {}  # runs
        self.words: dict[str, bytes] = {}
        self.names: list[str] = []  # runs whose edges may not all have come
        self.held: list[np.ndarray] = []
        self.n_held = self.base = self.n_words = 0
        self.zero, self.last = 0, -1  # numbers of names[0] and names[-1]

    def fold(self, upto: int) -> None:
        if not upto:
            return
        e = np.concatenate(self.held) if self.held else np.empty((0, 4), np.int64)
        e[:, 0] = (e[:, 0] - self.zero) & NUMBERS
        cut = int(np.searchsorted(e[:, 0], upto))
        some = self.names[:upto]
        self.known.update(zip(some, word_ids(some, e[:cut], self.model, self.ranks), strict=True))
        self.names, self.held, self.n_held = self.names[upto:], [e[cut:]], len(e) - cut
        self.zero = (self.zero + upto) & NUMBERS
        self.held[0][:, 0] = (self.held[0][:, 0] - upto + self.zero) & NUMBERS

    def take(self, a: np.ndarray, s: pa.Array) -> None:
        """Rows of runs (s: letters) and of their edges."""
        n = a >> 24 & 255
        opens = np.flatnonzero(n == 0)
        bases = [self.base]
        for number, span in zip((a[opens] >> 40).tolist(), s.take(pa.array(opens)).to_pylist(), strict=True):
            if number == self.last:  # more letters of the same run
                self.base += CHUNK
                self.names[-1] += span[:CHUNK]
            else:
                if not self.names:
                    self.zero = number
                self.base, self.last = 0, number
                self.names.append(span[:CHUNK])
            bases.append(self.base)
        start = (a >> 32 & 255) - 1
        if any(bases):
            start += np.repeat(bases, np.diff([0, *opens.tolist(), len(a)]))
        i = np.flatnonzero(n)
        self.held.append(np.stack([a[i] >> 40, start[i], n[i], a[i] & 0xFFFFFF], 1))
        self.n_held += len(i)
        if self.n_held > 400_000:
            self.fold(len(self.names) - 1)  # the last run may go on

    def ids(self, texts: list[str]) -> list[bytes]:
        words_of_texts = [words_of(t) for t in texts]
        if self.n_words >= WORDS:
            self.words, self.n_words = {}, 0
        words = self.words
        new = list(dict.fromkeys(w for ws in words_of_texts for w in ws if w not in words))
        self.n_words += _size(new)
        runs, ends = self.cut([BLANK + w for w in new])
        got, lo = [self.known[r] for r in runs], 0
        for w, hi in zip(new, ends, strict=True):
            words[w] = got[lo] if hi == lo + 1 else b"".join(got[lo:hi])
            lo = hi
        return [b"".join(map(words.__getitem__, ws)) for ws in words_of_texts]

    def __call__(self, batches):
        for batch in batches:
            a, s = pc.fill_null(batch.column(0), -2).to_numpy(), batch.column(1)
            kind = np.minimum(a, 0)
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(a)] if len(a) else []
            for lo, hi in itertools.pairwise(cuts):
                if kind[lo] == 0:
                    self.take(a[lo:hi], s.slice(lo, hi - lo))
                    continue
                self.fold(len(self.names))
                self.last = -1
                if kind[lo] == -1:
                    self.known = {}
                    continue
                cols = self.columns(self.ids(s.slice(lo, hi - lo).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), *cols.values()], names=["doc_id", *cols])


def as_lists(out: list[bytes]) -> dict[str, pa.Array]:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
    return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), "<i4")))}


def encode(docs: DataFrame, model: Model, most: int = 64 << 20, columns=as_lists, schema: str = "ids array<int>") -> DataFrame:
    """doc_id, ids (array<int>) of each document's whole text.

    BPE models: one stage without an exchange. Each task builds the lattice of the runs of its words that it has not
    met yet (`most` bytes of them are remembered), folds a run's edges as they arrive one after another, and puts its
    texts' words together. The join to the broadcast piece table keeps a task's rows in order; a run that had not come
    before its texts would fail the lookup. columns and schema put what columns() makes of the ids (one bytes object a
    text, little-endian) in the place of ids, in the same stage.

    Unigram models: best_paths().
    """
    if not model.bpe:
        return best_paths(docs, model)
    if model.longest > 255 or max(i for _, i, _ in model.pieces) >> 24:
        raise ValueError("pieces of over 255 letters, or over 2 ** 24 of them")
    table = piece_table(docs.sparkSession, model).select("piece", "id")
    return stream_edges(new_runs(docs, model, most), table).mapInArrow(lambda batches: Folding(model, columns)(batches), f"doc_id long, {schema}")


def best_paths(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ids of texts by a unigram model, all relational: distinct words, their lattice, Viterbi, and back.

    Words are counted with partial sums, each distinct one is folded once, and the frequent ones are met by a bounded
    broadcast. Equal texts are put together once.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = texts.select("text").distinct().withColumn("v", F.sha2(F.encode("text", "utf-8"), 256))
    words = each.select("v", F.posexplode(F.split(normal(F.col("text")), f"(?<=[^{BLANK}])(?={BLANK})")).alias("at", "word"))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")))
    folded = viterbi(lattice(counts.select("word"), piece_table(docs.sparkSession, model), model.longest), model.unknown)
    bare = F.array_repeat(F.lit(model.unknown), F.length("word").cast("int"))  # words without an edge
    known = written(counts.join(folded, "word", "left").select("word", F.coalesce("ids", bare).alias("ids"), "n"))
    spelt = join_hot(words, known, ["word"], "n").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("w"))
    ids = spelt.select("v", F.flatten(F.transform("w", lambda x: x["ids"])).alias("ids"))
    rows = texts.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("v"))
    return rows.join(ids, "v", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decoder(model: Model):
    """A function of one list of ids: the text they stand for (ids over all bytes, invalid UTF-8 as U+FFFD)."""
    size = max([i for _, i, _ in model.pieces] + (model.byte_ids or [0])) + 1
    table: list[bytes] = [b" \xe2\x81\x87 "] * size
    for p, i, _ in model.pieces:
        table[i] = p.replace(BLANK, " ").encode()
    for b, i in enumerate(model.byte_ids or []):
        table[i] = bytes([b])

    def run(ids: list[int]) -> str:
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")

    return run


def decoded(column: str, model: Model):
    """An Arrow UDF of id arrays: the texts they stand for; null for null."""
    text = decoder(model)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return pa.array([text(x) if x is not None else None for x in ids.to_pylist()], pa.string())

    return run(column)
