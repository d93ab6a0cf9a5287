"""Round tags as bits, mask tests, and first-come quotas for strata."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def base_only() -> Column:
    return F.col("trigger") == 0


def entered_free() -> Column:
    """A triggered round whose free part won more than five whole bets."""
    return (F.col("trigger") > 0) & F.expr("(total_win - base_win) div bet > 5")


_BUILDERS = {"bg": base_only, "fg": entered_free}


def register_tag(name: str, build) -> bool:
    """Add a tag; False if the name is taken."""
    if name in _BUILDERS:
        return False
    _BUILDERS[name] = build
    return True


def _signed(mask: int) -> int:
    """64 bits as a long."""
    return mask - (1 << 64) if mask >> 63 else mask


class Tagger:
    """Up to 64 tags in order; tag i is bit i of a long, the last one its sign."""

    def __init__(self, names: Sequence[str]) -> None:
        self.names = list(dict.fromkeys(names))
        if not 1 <= len(self.names) <= 64:
            raise ValueError("from 1 to 64 tags")
        if unknown := [n for n in self.names if n not in _BUILDERS]:
            raise ValueError(f"unknown tags: {unknown}")

    def bits(self) -> Column:
        none = F.lit(0).cast("long")
        return reduce(lambda a, b: a.bitwiseOR(b), (F.when(_BUILDERS[n](), F.lit(_signed(1 << i)).cast("long")).otherwise(none) for i, n in enumerate(self.names)))

    def mask(self, names: Sequence[str]) -> int:
        """Bits of the names; unknown names have none."""
        return _signed(sum(1 << self.names.index(n) for n in dict.fromkeys(names) if n in self.names))


def covers(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(mask) == mask


def equals(bits: Column, mask: int) -> Column:
    return bits == mask


def any_of(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(mask) != 0


def none_of(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(mask) == 0


def collect_strata(rows: DataFrame, strata: Sequence[tuple[str, Column, int]], order: str) -> DataFrame:
    """``rows`` with ``cname``: each row in order goes to the first stratum that accepts it and still has room.

    ``strata``: (name, accepts, room); ``order`` is a sortable column without ties.  One pass: a row's strata are bits, and of all rows
    with equal bits only the first can be taken, as many as their strata have room.  Spark keeps so many of a task, and what is left, bounded by
    the rooms, is dealt out in one task.
    """
    if not 1 <= len(strata) <= 63:
        raise ValueError("from 1 to 63 strata")
    bits = sum((F.when(accepts, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, accepts, _) in enumerate(strata)), F.lit(0).cast("long"))
    room = sum((F.when(F.col("__bits").bitwiseAND(1 << i) != 0, F.lit(k)).otherwise(F.lit(0)) for i, (_, _, k) in enumerate(strata)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__bits").orderBy(order))
    # the rank is bounded by a constant first, which tasks can apply before the shuffle
    most = sum(k for _, _, k in strata)
    kept = rows.withColumn("__bits", bits).where("__bits <> 0").withColumn("__place", place).where(F.col("__place") <= most).where(F.col("__place") <= room).drop("__place")
    names, rooms = [n for n, _, _ in strata], [k for _, _, k in strata]

    def deal(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(order, "ascending")]))
        bits = table["__bits"].to_numpy()
        taken = np.full(len(bits), -1)
        for i, k in enumerate(rooms):
            taken[np.flatnonzero((taken < 0) & (bits >> i & 1 == 1))[:k]] = i
        mine = np.flatnonzero(taken >= 0)
        return table.drop_columns(["__bits", "__all"]).take(mine).append_column("cname", pa.array([names[i] for i in taken[mine]], pa.string()))

    return kept.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(deal, rows.withColumn("cname", F.lit(None).cast("string")).schema)


def collect_disjoint(rows: DataFrame, strata: Sequence[tuple[str, Column, int]], order: str) -> DataFrame:
    """The same for strata that exclude each other: one window instead of one pass for each."""
    name, room = F.lit(None).cast("string"), F.lit(0)
    for n, accepts, k in reversed(strata):
        name, room = F.when(accepts, F.lit(n)).otherwise(name), F.when(accepts, F.lit(k)).otherwise(room)
    placed = rows.withColumns({"cname": name, "room": room}).where("cname is not null")
    rank = F.row_number().over(Window.partitionBy("cname").orderBy(order))
    return placed.withColumn("place", rank).where("place <= room").drop("room", "place")
