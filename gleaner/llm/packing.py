"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

A document's ids (an end id last) are cut into whole sequences and a remainder. Each group packs its remainders in
descending order: the tree's inner nodes hold the largest free space below them, so that the first bin that fits is
found in log2(bins) steps. Bins that stay open at the end are filled by cutting the pieces of the emptiest bins, so
that each group leaves one open sequence, which is split at powers of two: those need no padding.

Groups are drawn by a hash of doc_id, so that a group's sizes follow the corpus's, and no source or run of long
documents fills a group. Null and empty texts are the end id alone. Rows that share a doc_id are packed one by one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Free space of bins 0..n-1; bins are opened from the left by need."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with that much space, which it then has no more."""
        at, most, leaves = 1, self.most, self.leaves
        while at < leaves:
            at *= 2
            if most[at] < size:
                at += 1
        found = at - leaves
        most[at] -= size
        at //= 2
        while at:
            high = most[2 * at] if most[2 * at] >= most[2 * at + 1] else most[2 * at + 1]
            if most[at] == high:
                break
            most[at] = high
            at //= 2
        return found


def pack_sizes(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of documents with these token counts."""
    out, rests, sequence = [], [], 0
    for d, n in enumerate(sizes):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((n % capacity, d, whole * capacity))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree, bins, space = CapacityTree(len(rests), capacity), [], []
    for n, d, start in rests:
        b = tree.take(n)
        if b == len(bins):
            bins.append([])
            space.append(capacity)
        bins[b].append((d, start, n))
        space[b] -= n
    # fill: the emptiest bin's pieces go, cut where needed, into the fullest open ones
    order = sorted(range(len(bins)), key=lambda b: (space[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        into, of = order[low], order[high]
        if not space[into]:
            low += 1
        elif not bins[of]:
            high -= 1
        else:
            d, start, n = bins[of].pop()
            m = min(n, space[into])
            bins[into].append((d, start + n - m, m))
            space[into] -= m
            space[of] += m
            if n > m:
                bins[of].append((d, start, n - m))
    for b in order:
        if not bins[b]:
            continue
        held = sum(x[2] for x in bins[b])
        # room: a full sequence, or the binary digits of what the last bin holds
        rooms = [capacity] if held == capacity else [1 << k for k in range(held.bit_length() - 1, -1, -1) if held >> k & 1]
        room, offset = rooms.pop(0), 0
        for d, start, n in bins[b]:
            while n:
                m = min(n, room - offset)
                out.append((d, start, m, sequence, offset))
                start, n, offset = start + m, n - m, offset + m
                if offset == room:
                    sequence += 1
                    room, offset = (rooms.pop(0) if rooms else 0), 0
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 1024, group_mb: int = 2) -> DataFrame:
    """SCHEMA's rows: where each piece of each whole document lies. sequence_id is the group's number and the place in it."""
    end = end_id.to_bytes(4, "little")
    rows = docs.select("doc_id", "text")
    exchange = parts(rows)
    groups = exchange * max(1, 24 // group_mb)

    def run(t: pa.Table) -> pa.Table:
        enc = encoder(vocabulary, True)
        order = np.argsort(t["doc_id"].fill_null(-1).to_numpy(), kind="stable")
        keys, texts, group = t["doc_id"].to_pylist(), t["text"], int(t["pack_group"][0].as_py())
        ids = [enc.encode(texts[int(i)].as_py() or "") + end for i in order]
        sizes = [len(x) // 4 for x in ids]
        got = pack_sizes(sizes, capacity)
        cols = np.array(got, np.int64).reshape(-1, 5)
        crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]) for d, s, n, _, _ in got]
        d = cols[:, 0]
        return pa.table(
            {
                "doc_id": pa.array([keys[int(order[i])] for i in d], pa.int64()), "start": cols[:, 1], "length": cols[:, 2], "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": np.array(sizes, np.int64)[d] if len(d) else np.empty(0, np.int64), "sequence_id": (np.int64(group) << np.int64(32)) + cols[:, 3], "offset": cols[:, 4],
            }
        )

    drawn = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", F.lit("pack")), F.lit(groups)).cast("int"))
    return drawn.repartition(exchange, "pack_group").groupBy("pack_group").applyInArrow(run, SCHEMA)
