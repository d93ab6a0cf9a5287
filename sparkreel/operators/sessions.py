"""Player sessions: a running balance that ends in bust, cash-out or alive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAVE_AT = 3


def running(ledger: DataFrame, init_bets: int = 20) -> DataFrame:
    """The rounds each player still plays, with rn, balance, bust and cashout after each.

    A round costs one bet unit and pays its win.  A player leaves bust when the balance is below one bet unit, and cashed out
    at LEAVE_AT times the start; the rounds after that are not played and are dropped.
    """
    order = Window.partitionBy("player_id").orderBy("seq")
    start = F.lit(init_bets) * F.col("bet_unit")
    rows = ledger.withColumns({"rn": F.row_number().over(order), "init_balance": start.cast("long")})
    rows = rows.withColumn("balance", F.col("init_balance") + F.sum(F.col("total_win") - F.col("bet_unit")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"bust": F.col("balance") < F.col("bet_unit"), "cashout": F.col("balance") >= LEAVE_AT * F.col("init_balance")})
    ended = F.count_if(F.col("bust") | F.col("cashout")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ended", ended)
    return rows.where((F.col("ended") == 0) & (F.col("init_balance") >= F.col("bet_unit"))).drop("ended")


def outcomes(ledger: DataFrame, init_bets: int = 20) -> DataFrame:
    """(player_id, rounds, init_balance, balance, max_balance, min_balance, bust, cashout, alive) of every player who plays."""
    played = running(ledger, init_bets)
    last = F.max_by("balance", "rn")
    out = played.groupBy("player_id").agg(
        F.count("*").alias("rounds"),
        F.max("init_balance").alias("init_balance"),
        last.alias("balance"),
        F.greatest(F.max("balance"), F.max("init_balance")).alias("max_balance"),
        F.least(F.min("balance"), F.max("init_balance")).alias("min_balance"),
        F.max("bust").alias("bust"),
        F.max("cashout").alias("cashout"),
    )
    return out.withColumn("alive", ~(F.col("bust") | F.col("cashout")))
