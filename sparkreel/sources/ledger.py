"""The round ledger: (spin_id, player_id, seq, bet_unit, bet, total_win, base_win, trigger), all whole numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("spin_id", "player_id", "seq", "bet_unit", "bet", "total_win", "base_win", "trigger")


def from_events(events: DataFrame, bet_unit: int = 40) -> DataFrame:
    """An event stream as rounds: purchases trigger and win three times their value on top, views and errors win nothing."""
    value, kind = F.col("value"), F.col("event_type")
    base = F.when(kind.isin("view", "error"), F.lit(0)).otherwise(F.floor(value)).cast("long")
    free = F.when(kind == "purchase", F.floor(value * 3)).otherwise(F.lit(0)).cast("long")
    unit = F.lit(bet_unit).cast("long")
    return events.select(
        F.col("event_id").alias("spin_id"),
        F.col("user_id").alias("player_id"),
        F.struct("ts", "event_id").alias("seq"),
        unit.alias("bet_unit"),
        unit.alias("bet"),
        (base + free).alias("total_win"),
        base.alias("base_win"),
        (kind == "purchase").cast("int").alias("trigger"),
    )


def from_arrays(spark: SparkSession, posted: Mapping[str, Any]) -> DataFrame:
    """A posted ledger of parallel arrays; rounds beyond the shortest array are left out, and free wins only bound the length."""
    names: Sequence[str] = ("total_wins", "base_wins", "free_wins", "triggers")
    rounds = min(len(posted[k]) for k in names)
    unit = int(posted["bet_units"][posted.get("bet_mode", 0)])
    if rounds == 0:
        return spark.createDataFrame([], "spin_id long, player_id long, seq long, bet_unit long, bet long, total_win long, base_win long, trigger int")
    zipped = spark.createDataFrame([tuple(list(posted[k][:rounds]) for k in names)], ", ".join(f"{k} array<long>" for k in names))
    rows = zipped.select(F.posexplode(F.arrays_zip(*names)).alias("spin", "r"))
    n = F.col("spin").cast("long")
    return rows.select(
        n.alias("spin_id"),
        F.lit(0).cast("long").alias("player_id"),
        n.alias("seq"),
        F.lit(unit).cast("long").alias("bet_unit"),
        F.lit(int(posted.get("bet") or unit)).cast("long").alias("bet"),
        F.col("r.total_wins").alias("total_win"),
        F.col("r.base_wins").alias("base_win"),
        F.col("r.triggers").cast("int").alias("trigger"),
    )
