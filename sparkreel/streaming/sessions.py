"""Streaming counterparts: event-time ledger reports, and player sessions with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import LEAVE_AT


def windowed_report(rounds: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Whole-number sums of a streamed ledger (with ``ts``) for each event-time window; rounds later than ``late`` are dropped."""
    rows = rounds.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"))
    rows = rows.agg(F.count("*").alias("rounds"), *(F.sum(c).alias(c) for c in ("bet", "total_win", "base_win", "trigger")))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rounds", "bet", "total_win", "base_win", "trigger")


def session_stream(rounds: DataFrame, init_bets: int = 20) -> DataFrame:
    """(player_id, rounds, balance, outcome) after each batch of a player's rounds; rounds after the end change nothing.

    Rounds of a player must arrive in order between batches; within a batch they are put in the order of ``seq``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        unit = int(rows["bet_unit"].iloc[0])
        start = unit * init_bets
        n, balance, outcome = state.get if state.exists else (0, start, "alive")
        for win in rows["total_win"]:
            if outcome != "alive":
                break
            n, balance = n + 1, balance - unit + int(win)
            outcome = "bust" if balance < unit else "cashout" if balance >= LEAVE_AT * start else "alive"
        state.update((n, balance, outcome))
        yield pd.DataFrame({"player_id": [key[0]], "rounds": [n], "balance": [balance], "outcome": [outcome]})

    kind = "player_id long, rounds long, balance long, outcome string"
    slim = rounds.select("player_id", "seq", "bet_unit", "total_win")
    return slim.groupBy("player_id").applyInPandasWithState(run, kind, "rounds long, balance long, outcome string", "update", GroupStateTimeout.NoTimeout)
