"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link where at most `radius` bits differ. The bits are dealt into m parts with thresholds t_i
whose sum is radius - m + 1: two linked fingerprints are within t_i in at least one part i, so probing each part at
its own threshold finds every link. Bits that are correlated over the corpus go into one part, and the thresholds are
allotted by dynamic programming over the candidates that each part would bring at each threshold, estimated from
counts over all fingerprints. A part at threshold t is probed by its value with each choice of t bits blanked; only
equal keys meet, and what meets is verified on all 64 bits.

Equal fingerprints are one node. Groups are compared in sorted runs, in blocks, and give only a spanning forest of
their links; keys with over a ten-thousandth of all rows are cut into blocks that meet pair by pair, so no task gets
an unbounded group and pairs within a group are never rows. Nothing is capped: every link is found.

Null and empty texts have the fingerprint zero, and link like any other. Rows that share a doc_id are fingerprinted
one by one; a null doc_id is carried along, and comes last where the least doc_id is asked for. Very long texts are
hashed whole, their bits counted a block of shingles at a time. Empty tables give no rows. Of the columns only doc_id
and text are read, so others, of whatever name, do not matter.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, join_hot, join_salted, on_texts, plan_bytes, written
from .components import connected_components

BITS = 64
_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 2048
FEW = 1_000_000  # pairs that are verified by plain joins: no key has more rows than that
RUN = 32  # members of a run of equal prefix hashes, up to which all pairs of them are rows
FULL = 32  # links a member of a run of equal keys, up to which all of them are looked at


def fingerprint(text: str, width: int) -> int:
    """Majority of the bits of the XXH64 (seed 42) of each shingle of `width` words of the text in lower case (A-Z)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOW).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    count = np.zeros(BITS, np.int64)
    s, e = starts[:n].tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, 65536):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(s[at : at + 65536], e[at : at + 65536], strict=True)])
        count += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(part, texts):
        fp = np.array([fingerprint(t, width) for t in texts], np.uint64)
        return {"doc_id": part.column(0), "fp": fp.view(np.int64)}

    return on_texts(docs.select("doc_id", "text"), "text", "doc_id long, fp long", run)


# ---- parts and thresholds


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both; a task sends 64 x 64 sums."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "both"])

    total, n = np.zeros((BITS, BITS)), 0
    for r in fps.select("fp").mapInArrow(run, "n long, both binary").toLocalIterator():
        total += np.frombuffer(r["both"]).reshape(BITS, BITS)
        n += r["n"]
    return n, total


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits 0..63 (0: the highest) in m parts of even size: each part grows by the bit most correlated with it."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(part[0])
        while len(part) < size:
            b = max(sorted(left), key=lambda b: corr[b, part].sum())
            part.append(b)
            left.discard(b)
        out.append(sorted(part))
    return out


def _blanked(bits: list[int], t: int) -> list[int]:
    """Masks of a part's bits with each choice of t of them blanked, as signed longs."""
    masks = [sum(1 << (63 - b) for b in bits if b not in blank) for blank in itertools.combinations(bits, t)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def equal_pairs(fps: DataFrame, parts: list[list[int]]) -> list[float]:
    """For each part, the pairs of fingerprints that agree in all of its bits."""
    rows = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_blanked(bits, 0)[0])).alias("x")) for i, bits in enumerate(parts)]
    met = fps.select(F.explode(F.array(*rows)).alias("r")).select("r.*").groupBy("i", "x").agg(F.count("*").alias("c"))
    got = {r["i"]: r["pairs"] for r in met.groupBy("i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()}
    return [got.get(i, 0.0) for i in range(len(parts))]


def candidate_counts(n: int, both: np.ndarray, bits: list[int], equal: float, most: int) -> list[float]:
    """Estimated candidate pairs of a part at thresholds 0..most: those that agree, and as many more with each further
    differing bit as the bits' own frequencies say."""
    p = np.diag(both) / max(1, n)
    differ = np.zeros(most + 1)  # chance that so many of the part's bits differ
    differ[0] = 1
    for q in 2 * p[bits] * (1 - p[bits]):
        differ = differ * (1 - q) + np.concatenate([[0], differ[:-1]]) * q
    return (max(1.0, equal) * np.cumsum(differ) / max(differ[0], 1e-12)).tolist()


def allot(costs: list[list[float]], sizes: list[int], total: int, rows: int, row_cost: float = 60.0) -> tuple[float, list[int]] | None:
    """Thresholds (-1: the part is not probed) of the given sum of least estimated cost, by dynamic programming over parts.

    A probe row costs as much as row_cost verified pairs.
    """
    from math import comb

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i, c in enumerate(costs):
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (v, ts) in best.items():
            for t in range(-1, len(c)):
                cost = v + (0 if t < 0 else c[t] + row_cost * rows * comb(sizes[i], t))
                if s + t not in new or cost < new[s + t][0]:
                    new[s + t] = (cost, [*ts, t])
        best = new
    return best.get(total)


def plan(fps: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part to probe, of least estimated cost over several numbers of parts."""
    n, both = bit_counts(fps)
    tried = [correlated_parts(n, both, m) for m in range(2, min(8, radius + 1) + 1)]
    equal = iter(equal_pairs(fps, [p for parts in tried for p in parts]))
    found = []
    for parts in tried:
        most = min(3, radius)
        costs = [candidate_counts(n, both, p, next(equal), most) for p in parts]
        got = allot(costs, [len(p) for p in parts], radius - len(parts) + 1, n)
        if got:
            found.append((got[0], [(p, t) for p, t in zip(parts, got[1], strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


# ---- probe and verify


def linked(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a run, as two arrays of places in it; memory is bounded by blocks."""
    left, u, v = np.arange(len(x)), [], []
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            some, frontier = frontier[:64], frontier[64:]
            near = np.zeros(len(left), bool)
            for at in range(0, len(left), 65536):
                near[at : at + 65536] = (np.bitwise_count(x[some][:, None] ^ x[left[at : at + 65536]][None, :]) <= radius).any(0)
            hit = left[near]
            u.append(np.full(len(hit), root))
            v.append(hit)
            left = left[~near]
            frontier = np.concatenate([frontier, hit])
    return (np.concatenate(u), np.concatenate(v)) if u else (np.empty(0, np.int64), np.empty(0, np.int64))


def first_met(u: np.ndarray, v: np.ndarray, k: int, masks: np.ndarray) -> np.ndarray:
    """Which pairs have no key before the k-th in common."""
    differ, first = u ^ v, np.ones(len(u), bool)
    for m in masks[:k]:
        first &= (differ & m) != 0
    return first


def near_pairs(x: np.ndarray, radius: int, most: int, k: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The links within a run of the k-th key that no earlier key has, as places in it; None if there are over `most`."""
    us, vs, held, raw = [], [], 0, 0
    for a in range(0, len(x), 64):
        for b in range(a, len(x), 65536):
            i, j = np.nonzero(np.bitwise_count(x[a : a + 64][:, None] ^ x[b : b + 65536][None, :]) <= radius)
            later = j + b > i + a
            i, j = i[later] + a, j[later] + b
            raw += len(i)
            if raw > 16 * most:
                return None
            new = first_met(x[i], x[j], k, masks)
            us.append(i[new])
            vs.append(j[new])
            held += int(new.sum())
            if held > most:
                return None
    return np.concatenate(us), np.concatenate(vs)


def run_links(key: np.ndarray, x: np.ndarray, radius: int, which: np.ndarray | None = None, masks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys. Runs of few members are compared at once for all runs, shifted step by step.

    which: the number of each row's key, where all links are wanted, each from the first key that has both its ends.
    """
    n = len(key)
    if n < 2:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    every = which is not None
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    few = 8 if every else 32
    small = np.repeat(size <= few, size)
    for d in range(1, int(min(few, size.max()))):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= radius]
        for k in np.unique(which[i]).tolist() if every else []:
            of = np.flatnonzero(which[i] == k)
            i = np.delete(i, of[~first_met(x[i[of]], x[i[of] + d], k, masks)])
        us.append(x[i])
        vs.append(x[i + d])
    for a, m in zip(first[size > few].tolist(), size[size > few].tolist(), strict=True):
        part = x[a : a + m]
        u, v = (near_pairs(part, radius, FULL * m, int(which[a]), masks) if every else None) or linked(part, radius)
        us.append(part[u])
        vs.append(part[v])
    return np.concatenate(us), np.concatenate(vs)


def links(fps: DataFrame, radius: int, every: bool = False) -> DataFrame:
    """u, v: links between different fingerprints that span the same components as all links within radius.

    every: all links, but for runs with over FULL links a member that no earlier key has, where each member's link to
    the first it hangs on does. Elsewhere a link comes from the first key that both its ends have, so it is one row,
    however many keys they share.
    """
    keys, masks = [], []
    for i, (bits, t) in enumerate(plan(fps, radius)):
        for k, m in enumerate(_blanked(bits, t)):
            keys.append(F.xxhash64(F.lit(i * 100_000 + k), F.col("fp").bitwiseAND(F.lit(m))))
            masks.append(m)
    masks = np.array(masks, np.int64).view(np.uint64)
    probes = fps.select("fp", F.posexplode(F.array(*keys)).alias("k", "key"))
    if not every:
        probes = probes.select("fp", F.lit(0).alias("k"), "key")
    sizes = probes.groupBy("key").agg(F.count("*").alias("n"))
    total = fps.count() * len(keys)
    hot = F.broadcast(sizes.filter(F.col("n") > max(BLOCK, total // 10_000)))  # under 10,000 rows
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(j, F.col("mine")), F.greatest(j, F.col("mine"))))
    dealt = probes.join(hot, "key", "left").withColumn("blocks", blocks).withColumn("mine", mine)
    dealt = dealt.select("fp", "k", F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array("key"))).alias("key"))
    session = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held_k, held_x, held_w = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32)
        for b in batches:
            k = np.concatenate([held_k, b.column(0).to_numpy()])
            x = np.concatenate([held_x, b.column(1).to_numpy().view(np.uint64)])
            w = np.concatenate([held_w, b.column(2).to_numpy()])
            cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            held_k, held_x, held_w = k[cut:], x[cut:], w[cut:]
            if cut:
                yield out(*run_links(k[:cut], x[:cut], radius, w[:cut] if every else None, masks))
        yield out(*run_links(held_k, held_x, radius, held_w if every else None, masks))

    def out(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.uint64).view(np.int64)), pa.array(v.astype(np.uint64).view(np.int64))], names=["u", "v"])

    rows = dealt.select("key", "fp", "k").repartition(max(session, plan_bytes(fps) * len(keys) // (64 << 20)), "key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(run, "u long, v long").filter("u <> v")


def groups(prints: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, component_id of rows doc_id, fp (a written table): the least doc_id that links reach."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(nodes.select("fp"), radius))
    of = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(of.join(heads, "root").select("fp", "component_id", "n"))
    return join_hot(prints, of, ["fp"], "n")


def hashes(text: str, width: int) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle of `width` words of the text, as in fingerprint(); none of a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOW).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    s, e = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    return np.frombuffer(b"".join([xxhash.xxh64_digest(joined[a:b], 42) for a, b in zip(s, e, strict=True)]), ">u8").astype(np.uint64)


def majority(h: np.ndarray) -> int:
    """fingerprint() of a text of these hashes."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        count += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def _least(similarity: float, n):
    """The fewest shingles that a set of n shares with one that is like it."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def parities(h: np.ndarray) -> bytes:
    """For each bit place, whether the set has an odd number of hashes there: four places a hash or more, 64 to 16384.

    Hashes that only one of two sets has, d of them, change at most d places. A longer row of places becomes that of
    the shorter kind by the exclusive or of its halves.
    """
    n = 64
    while n < 4 * len(h) and n < 16384:
        n *= 2
    odd = np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(rows: list[np.ndarray], words: int) -> np.ndarray:
    """parities() as rows of so many 64-bit words each."""
    return np.array([np.bitwise_xor.reduce(r.reshape(-1, words), axis=0) for r in rows], np.uint64).reshape(-1, words)


def few_places(odd: bytes, size: int) -> bytes:
    """parities() of a set of so many hashes, folded to a place a hash or more: what is sent with each pair of a set."""
    words = 1
    while 64 * words < size and 8 * words < len(odd):
        words *= 2
    return np.bitwise_xor.reduce(np.frombuffer(odd, "<u8").reshape(-1, words), axis=0).tobytes()


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many places the parities of two sets differ, pair by pair; a longer row of places is folded to the shorter."""
    lengths, out = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2), np.zeros(len(x), np.int64)
    for most, least in np.unique(lengths, axis=0).tolist():
        of = np.flatnonzero((lengths == (most, least)).all(1)).tolist()
        words = min(most, least) // 8
        p, q = (np.bitwise_xor.reduce(np.frombuffer(b"".join([z[i] for i in of]), "<u8").reshape(len(of), -1, words), axis=1) for z in (x, y))
        out[of] = np.bitwise_count(p ^ q).sum(1)
    return out


def share(similarity: float, total):
    """The fewest common shingles of two sets of so many shingles in all that are `similarity` alike."""
    return np.ceil(similarity / (1 + similarity) * total - 1e-9).astype(np.int64)


def met_in_runs(key: np.ndarray, node: np.ndarray, size: np.ndarray, label: np.ndarray, similarity: float):
    """Pairs (a, b, their sizes) of nodes of different labels in runs of at most RUN equal keys, of sizes that may be alike.

    Members of longer runs are told one by one (key, node, the run's length, -1).
    """

    def fit(i, j):
        x, y = size[i], size[j]
        keep = (label[i] != label[j]) & (node[i] != node[j]) & (np.minimum(x, y) >= _least(similarity, np.maximum(x, y)))
        i, j = i[keep], j[keep]
        i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
        return node[i], node[j], size[i], size[j]

    n = len(key)
    if n < 2:
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    small = np.repeat(count <= RUN, count)
    for d in range(1, int(min(RUN, count.max()))):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        yield fit(i, i + d)
    for start, m in zip(first[count > RUN].tolist(), count[count > RUN].tolist(), strict=True):
        run = slice(start, start + m)
        if (label[run] != label[start]).any():
            yield key[run], node[run], np.full(m, m), np.full(m, -1)


def near_in_run(node: np.ndarray, size: np.ndarray, label: np.ndarray, block: np.ndarray, odd: list[np.ndarray], similarity: float):
    """Pairs (a, b, their sizes) of nodes of different labels of a run whose parities allow them to be `similarity` alike.

    What the places that differ leave for both sets to share must reach share(): for others it is proved that they
    aren't alike. Folded places tell nothing of sets much larger, so sizes must fit too, and only sets of as many places
    are taken together. block: -1, or where two blocks of a run meet, the one of the two.
    """
    order = np.argsort(size, kind="stable")
    node, size, label, block, odd = node[order], size[order], label[order], block[order], [odd[i] for i in order.tolist()]
    lengths, stop, largest = np.array([len(r) for r in odd], np.int64), 0, size / similarity + 1e-6
    while stop < len(node):
        at, words = stop, int(lengths[stop])
        stop = min(at + 64, int(np.searchsorted(lengths, words, "right")))
        x = slice(at, stop)
        mine = _folded(odd[x], words)
        upto = int(np.searchsorted(size, largest[stop - 1], "right"))
        for b in range(at, upto, 4096):
            y = slice(b, min(b + 4096, upto))
            other, differ = _folded(odd[y], words), np.zeros((x.stop - x.start, y.stop - y.start), np.int64)
            for w in range(words):
                differ += np.bitwise_count(mine[:, None, w] ^ other[None, :, w])
            total = size[x][:, None] + size[y][None, :]
            can = (total - differ) // 2 >= share(similarity, total)
            can &= size[y][None, :] <= largest[x][:, None]
            can &= (label[x][:, None] != label[y][None, :]) & (node[x][:, None] != node[y][None, :])
            can &= (block[x][:, None] < 0) | (block[x][:, None] != block[y][None, :])
            i, j = np.nonzero(can)
            later = j + b > i + at
            i, j = i[later] + at, j[later] + b
            i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            if len(i):
                yield node[i], node[j], size[i], size[j]


def candidates(prefixes: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of different labels that can be at least `similarity` alike, of rows doc_id, size, prefix, label, odd (a written table).

    A prefix is a set's first size - ceil(similarity * size) + 1 hashes in an order that is the same for all. Sets that are like one another have at least one
    of them in common, so equal ones meet in sorted runs. A run of at most RUN members gives its pairs. The members of
    longer runs meet a second time, with their sets' parities (`odd`), in blocks of BLOCK that meet two by two: of
    their pairs only those become rows that the parities do not rule out. A pair that is alike is so met at each of the
    c hashes that both its prefixes have, and shares at most c + ceil(similarity * the larger size) - 1 in all; one for
    which that is too few goes. So does one whose parities leave too few to share: these are a small part of the sets, and
    leave few pairs but those that are alike, so no other pair's sets are sent about. Nothing is missed or capped.
    """
    spark = prefixes.sparkSession
    rows = prefixes.select(F.explode("prefix").alias("key"), "doc_id", "size", "label")
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(max(session, plan_bytes(prefixes) // (16 << 20)), "key").sortWithinPartitions("key")
    names = ["a", "b", "m", "n"]

    def out(*held):
        for cols in met_in_runs(*held, similarity):
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def run(batches):
        held = [np.empty(0, np.int64) for _ in range(4)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            if cut:
                yield from out(*[h[:cut] for h in held])
                held = [h[cut:] for h in held]
        yield from out(*held)

    both = written(dealt.mapInArrow(run, "a long, b long, m long, n long"))
    sets = prefixes.select(F.col("doc_id").alias("b"), "size", "label", "odd")
    members = both.filter("n < 0").select(F.col("a").alias("key"), "b", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = members.withColumn("mine", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.xxhash64("key", F.least(j, F.col("mine")), F.greatest(j, F.col("mine"))).alias("key"), F.when(j == F.col("mine"), -1).otherwise(F.col("mine")).alias("block")))
    members = members.select("b", F.explode(meet).alias("r")).select("b", "r.*")
    # within a block its own members are marked -1 and meet one another; those of the block pair (j, mine) carry their block
    members = members.join(sets, "b").select("key", "b", "size", "label", "block", "odd")

    def compare(batches):
        held, odd = [np.empty(0, np.int64) for _ in range(5)], []
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            odd += [np.frombuffer(x, "<u8") for x in batch.column(5).to_pylist()]
            cut = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            yield from runs([h[:cut] for h in held], odd[:cut])
            held, odd = [h[cut:] for h in held], odd[cut:]
        yield from runs(held, odd)

    def runs(held, odd):
        key = held[0]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
        for lo, hi in itertools.pairwise([*first, len(key)]):
            for cols in near_in_run(*[h[lo:hi] for h in held[1:]], odd[lo:hi], similarity):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    again = members.repartition(session, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long, m long, n long")
    met = both.filter("n >= 0").unionByName(again).groupBy(*names).agg(F.count("*").alias("c"))
    fewest = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("m") + F.col("n")) - 1e-9)
    most = F.col("c") + F.ceil(F.lit(similarity) * F.greatest("m", "n") - 1e-9) - 1
    pairs = written(met.filter(most >= fewest).select("a", "b", F.expr("m + n").alias("total")).distinct())
    dropped(both)
    digests = on_nodes(prefixes.select(F.col("doc_id").alias("node"), "size", "odd"))
    out = not_ruled_out(pairs, digests, similarity)
    dropped(pairs, digests)
    return out


def on_nodes(sets: DataFrame) -> DataFrame:
    """node, odd (a written table): few_places() of rows node, size, odd; rows of one node are equal."""

    def run(batches):
        for b in batches:
            odd = [few_places(x, n) for x, n in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(odd, pa.binary())], names=["node", "odd"])

    return written(sets.mapInArrow(run, "node long, odd binary").dropDuplicates(["node"]))


def not_ruled_out(pairs: DataFrame, digests: DataFrame, similarity: float) -> DataFrame:
    """a, b (a written table): the pairs (a, b, total: their sizes' sum; a written table) whose sets' parities (node, odd) allow them to be `similarity` alike."""

    def run(batches):
        for batch in batches:
            a, b, total, x, y = (batch.column(i) for i in range(5))
            sizes = total.to_numpy()
            can = pa.array((sizes - differing(x.to_pylist(), y.to_pylist())) // 2 >= share(similarity, sizes))
            yield pa.RecordBatch.from_arrays([a.filter(can), b.filter(can)], names=["a", "b"])

    both, held = with_both(pairs, digests)
    out = written(both.select("a", "b", "total", "x", "y").mapInArrow(run, "a long, b long"))
    dropped(*held)
    return out


def with_both(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """pairs (of nodes a and b; a written table) with x and y, what sets (node, and one column; a written table) has of both; and tables to drop when it is read.

    Beyond FEW pairs, a node of many pairs is salted.
    """
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    if pairs.count() <= FEW:
        return pairs.join(x, "a").join(y, "b"), []
    first = written(join_salted(pairs, x, ["a"]))
    return join_salted(first, y, ["b"]), [first]


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """u, v (a written table): the pairs (a, b: nodes; a written table) whose texts are at least `similarity` alike, or both without words.

    Only texts of nodes in pairs are read into sets. Their list is a written table, so that Spark knows its size: it is
    broadcast where it is small, and joined by an exchange of the texts where not.
    """
    some = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "v"), "node"))
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("v"), "text").join(some, ["doc_id", "v"]).select("node", "text")

    def run(part, texts):
        return {"node": part.column(0), "set": [np.unique(hashes(t, width)).view(np.int64) for t in texts]}

    sets = written(on_texts(texts, "text", "node long, set array<long>", run).dropDuplicates(["node"]))
    both, held = with_both(pairs, sets)
    met = F.size(F.array_intersect("x", "y"))
    like = met / F.greatest(F.lit(1), F.size("x") + F.size("y") - met)
    out = written(both.filter((like >= similarity) | (F.size("x") + F.size("y") == 0)).select(F.col("a").alias("u"), F.col("b").alias("v")))
    dropped(some, sets, *held)
    return out


def prefix_of(h: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first size - ceil(similarity * size) + 1 of a set's hashes (ascending), common ones last; a key of its own for an empty set."""
    if not len(h):
        return np.zeros(1, np.int64)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = np.concatenate([h[~late], h[late]])
    return h[: len(h) - int(_least(similarity, len(h))) + 1].view(np.int64)


def rarer_prefixes(texts: DataFrame, rows: DataFrame, width: int, similarity: float, rounds: int = 2, most: int = 200_000) -> DataFrame:
    """doc_id, v, size, prefix, odd, from prefixes in ascending order (rows; a written table), with the common hashes last.

    Any one order of all hashes will do for prefixes to meet. One in which those that stand in many prefixes (over a `most`-th
    of all, and two) come last keeps passages that many texts share from bringing all of these together. Fewer
    than `most` hashes are sent to the driver and back. As others take their places in the prefixes, it is done twice.
    They are counted in one text of eight, drawn by its hash: which hashes come last changes no result. A hash of 64
    texts is then found but for one time in 70.
    """
    common, got = np.empty(0, np.uint64), rows.select("doc_id", "v", "size", "prefix", *[c for c in rows.columns if c == "odd"])
    for _ in range(rounds):
        drawn = got.filter(F.pmod("v", F.lit(8)) == 0)
        total = drawn.agg(F.sum(F.size("prefix"))).first()[0] or 0
        counts = drawn.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter((F.col("n") > max(2, total // most)) & (F.col("key") != 0))
        new = np.array([r["key"] for r in counts.select("key").toLocalIterator()], np.int64).view(np.uint64)
        new = np.setdiff1d(new, common)
        if not len(new):
            break
        common = np.union1d(common, new)

        def run(part, texts, common=common):
            sets = [np.unique(hashes(t, width)) for t in texts]
            return {"doc_id": part.column(0), "v": part.column(1), "size": [len(h) for h in sets], "prefix": [prefix_of(h, common, similarity) for h in sets], "odd": [parities(h) for h in sets]}

        before, got = got, written(on_texts(texts, "text", "doc_id long, v long, size long, prefix array<long>, odd binary", run))
        dropped(before)
    return got


def copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 10) -> DataFrame:
    """doc_id, v (the text's xxhash64), copy_of (a written table): each document that is let go, and the kept one of its group.

    Likeness is the Jaccard similarity of the sets of `width`-word shingles; the components of all pairs at least
    `similarity` alike are the groups, of which the document of least (doc_id, v) stays. Two passes find them. Texts
    with fingerprints (of the same shingles) at most `radius` bits apart are verified first, which joins most of each
    group cheaply, but not every pair: it looks at spanning links only where a run of equal keys is dense. All pairs
    that are then not in one group yet, and may be alike by what their sets have in common (candidates()), are verified
    next, so no pair is missed.

    A document is a (doc_id, text): rows that share a doc_id but not the text are documents of their own, and equal
    rows are one. Equal texts are one node, whatever their number. Texts without words (null and empty ones too) are
    alike. Rows without a doc_id are not looked at, and stay. An empty table has no copies.
    """
    v, none = F.xxhash64(F.coalesce("text", F.lit(""))), np.empty(0, np.uint64)

    def run(part, texts):
        fp, size, prefix, odd = [], [], [], []
        for t in texts:
            h = hashes(t, width)
            fp.append(majority(h))
            h = np.unique(h)
            size.append(len(h))
            prefix.append(prefix_of(h, none, similarity))  # texts without words meet at a key of their own: they are alike
            odd.append(parities(h))
        return {"doc_id": part.column(0), "v": part.column(1), "fp": np.array(fp, np.uint64).view(np.int64), "size": size, "prefix": prefix, "odd": odd}

    some = docs.select("doc_id", v.alias("v"), "text").filter(F.col("doc_id").isNotNull())
    rows = written(on_texts(some, "text", "doc_id long, v long, fp long, size long, prefix array<long>, odd binary", run))
    nodes = rows.groupBy("v", "fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    near = written(links(prints.select("fp"), radius, every=True).distinct())
    head = prints.select("fp", "head")
    pairs = near.join(head.toDF("u", "a"), "u").join(head.toDF("v", "b"), "v").select("a", "b")
    same = join_hot(nodes.select("node", "fp"), prints.select("fp", "head", "n"), ["fp"], "n").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    pairs = written(pairs.unionByName(same).distinct())
    first = verified(docs, nodes, pairs, width, similarity)
    dropped(near, prints, pairs)
    labels = nodes.join(connected_components(first).toDF("node", "label"), "node", "left").select("node", "doc_id", "v", "fp", F.coalesce("label", "node").alias("label"))
    # a node's set is that of its least doc_id's row; should that row come twice, so do its keys, which changes nothing
    rare = rarer_prefixes(some, rows, width, similarity)
    prefixes = written(rare.join(labels, ["doc_id", "v"]).select(F.col("node").alias("doc_id"), "size", "prefix", "label", "odd"))
    dropped(rare)
    pairs = candidates(prefixes, similarity)
    dropped(prefixes)
    rest = verified(docs, nodes, pairs, width, similarity)
    roots = connected_components(first.unionByName(rest))
    of = written(nodes.join(roots, "node", "left").select("node", "v", "fp", "doc_id", "n", F.coalesce("root", "node").alias("root")))
    kept = written(of.groupBy("root").agg(F.min(F.struct("doc_id", "v")).alias("kept"), F.count("*").alias("texts")))
    told = written(join_hot(of, kept, ["root"], "texts").select("v", "fp", "kept", "n"))
    every = join_hot(rows.select("doc_id", "v", "fp"), told, ["v", "fp"], "n")
    out = written(every.filter(F.struct("doc_id", "v") != F.col("kept")).select("doc_id", "v", F.col("kept.doc_id").alias("copy_of")))
    dropped(rows, nodes, first, pairs, rest, of, kept, told)
    return out


def deduped(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the copies: one document of each group stays. No column is added, so names cannot clash."""
    gone = copies(docs, **parameters).select("doc_id", "v").distinct()
    mine = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (mine == gone["v"]), "left_anti")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
