"""Conflict-constrained best-fit packing.

Texts are cut into pieces of at most ``capacity`` tokens and the pieces, largest first, go to the open bin with the least
room that still takes them.  Open bins stand in the order of their room; each carries a bitmap of its sources and of its
duplicate clusters.  A bin that holds the piece's cluster, or ``source_limit`` pieces of its source, is passed over, and the
search goes on to the next larger room until a compatible bin is found; a new bin opens if there is none.

Blocks of about ``BLOCK`` pieces, dealt by a hash of doc_id, are packed apart, each in one task with bounded memory; a
block leaves at most its last few bins less full than one packing of everything would.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK = 2048


class Bins:
    """Open bins by room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (room, bin), rising
        self.sources: list[int] = []  # bitmap of full-up sources for each bin
        self.clusters: list[int] = []
        self.held: list[dict[int, int]] = []

    def place(self, length: int, source: int, cluster: int, source_limit: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece; bitmaps and order are brought up to date."""
        s, c = 1 << source, 1 << cluster
        for at in range(bisect_left(self.order, (length, -1)), len(self.order)):
            room, b = self.order[at]
            if not (self.sources[b] & s or self.clusters[b] & c):
                del self.order[at]
                break
        else:
            room, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
            self.held.append({})
        self.clusters[b] |= c
        n = self.held[b][source] = self.held[b].get(source, 0) + 1
        if n >= source_limit:
            self.sources[b] |= s
        if room > length:
            insort(self.order, (room - length, b))
        return b, self.capacity - room


def _pack(capacity: int, source_limit: int):
    def run(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        doc = table["doc_id"].fill_null(-1).to_numpy()
        order = np.lexsort((table["start"].to_numpy(), table["cluster"].to_numpy(), doc, -length))
        source = np.unique(table["source"].fill_null("").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        cluster = np.unique(table["cluster"].to_numpy(), return_inverse=True)[1]
        bins, out = Bins(capacity), np.empty((len(length), 2), np.int64)
        for i in order:
            out[i] = bins.place(int(length[i]), int(source[i]), int(cluster[i]), source_limit)
        out_bins = pa.array(out[:, 0]), pa.array(out[:, 1])
        return pa.table([table["doc_id"], table["start"], table["length"], table["block"], *out_bins], names=["doc_id", "start", "length", "block", "bin", "offset"])

    return run


def token_count(text: Column) -> Column:
    """Words between white space, and one for the end of the text; null and empty texts have that one."""
    return (F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1).cast("long")


def best_fit(docs: DataFrame, capacity: int = 2048, source_limit: int = 4) -> DataFrame:
    """doc_id, start, length, block, bin, offset: where each piece of each row of ``docs`` lies.

    (block, bin) names a bin; its pieces fill it from offset 0 without gaps.  Every token of every row is in one piece: pieces
    of a row start at multiples of ``capacity``.  No bin has two pieces of equal texts (a row's pieces included) or more
    than ``source_limit`` of one source.  Null and empty texts have one token; null sources are one source; repeated rows are
    equal texts, each packed; a null doc_id is returned as null; more columns are ignored; no rows give no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"),
        token_count(F.col("text")).alias("tokens"),
    )
    pieces = rows.select("doc_id", "source", "cluster", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(capacity).cast("long"))).alias("start"))
    pieces = pieces.select("doc_id", "source", "cluster", "start", F.least(F.col("tokens") - F.col("start"), F.lit(capacity)).cast("long").alias("length"))
    pieces = cut(pieces, "pieces")
    n_blocks = max(1, -(-pieces.count() // BLOCK))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "cluster"), n_blocks).cast("long"))
    return pieces.groupBy("block").applyInArrow(_pack(capacity, source_limit), "doc_id long, start long, length long, block long, bin long, offset long")
