"""Ledger reports: return to player, volatility, confidence interval, rates and win buckets.

Everything is summed in whole numbers and divided once at the end, so the figures don't depend on the order of partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bucket edges in bet units, and the names of the 14 buckets.
BUCKET_EDGES = (0, 1, 2, 5, 10, 20, 50, 100, 300, 500, 1000, 2000, 10000)
BUCKET_NAMES = ("[0,0]", "(0,1)", "[1,2)", "[2,5)", "[5,10)", "[10,20)", "[20,50)", "[50,100)", "[100,300)", "[300,500)", "[500,1000)", "[1000,2000)", "[2000,10000)", "[10000,+inf)")


def bucket(win: Column, bet_unit: Column) -> Column:
    """Index of the bucket that holds a win."""
    reached = sum((F.when(win >= edge * bet_unit, 1).otherwise(0) for edge in BUCKET_EDGES[1:]), F.lit(1))
    return F.when(win <= 0, 0).otherwise(reached).cast("int")


def _square_sum(x: Column) -> Column:
    """Sum of squares, exact up to the last step.

    Squares of wins under 2**31 are summed as their high and low 31 bits, so that the sums stay whole longs; larger wins, which are
    rare, as decimals.
    """
    usual = F.abs(x) < 1 << 31
    square = F.when(usual, x).otherwise(F.lit(0)) * F.when(usual, x).otherwise(F.lit(0))
    high, low = F.sum(F.shiftright(square, 31)), F.sum(square.bitwiseAND((1 << 31) - 1))
    large = F.sum(F.when(~usual, x.cast("decimal(19,0)") * x.cast("decimal(19,0)")))
    return F.coalesce(high.cast("double") * float(1 << 31) + low.cast("double"), F.lit(0.0)) + F.coalesce(large.cast("double"), F.lit(0.0))


WINS = ("total", "base", "free")


def _unit() -> Column:
    """The group's bet unit; reports of different ones don't add up."""
    return F.when(F.min("bet_unit") == F.max("bet_unit"), F.max("bet_unit")).otherwise(F.when(F.max("bet_unit").isNotNull(), F.raise_error("rounds of different bet units in one report").cast("long")))


def summary(ledger: DataFrame, *keys: str) -> DataFrame:
    """One report row, or one for each value of ``keys``; an empty ledger without keys gives zeros.

    Columns: rounds, total_bet, total_win, base_win, free_win, triggers, no_win_rounds, rtp, std, cv, ci_lo, ci_hi,
    trigger_rate, hit_rate and the win multiples with their squares.  Rounds of different bet units in one group are an error.
    """
    w, b = F.col("total_win"), F.col("base_win")
    f = w - b
    sums = {"total_bet": F.col("bet"), "total_win": w, "base_win": b, "free_win": f, "triggers": F.col("trigger").cast("long"), "no_win_rounds": F.when(w <= 0, F.lit(1)).otherwise(F.lit(0)).cast("long")}
    rows = ledger.groupBy(*keys).agg(
        F.count("*").alias("rounds"),
        _unit().alias("bet_unit"),
        *(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(k) for k, x in sums.items()),
        *(_square_sum(x).alias(f"{k}_sq") for k, x in zip(WINS, (w, b, f), strict=True)),
    )
    return _rates(_multiples(rows)).drop(*(f"{k}_sq" for k in WINS))


def _multiples(rows: DataFrame) -> DataFrame:
    """Wins and their squares as multiples of the bet unit."""
    unit, zero = F.col("bet_unit").cast("double"), F.lit(0.0)
    return rows.withColumns({f"{k}_mult": F.coalesce(F.col(f"{k}_win") / unit, zero) for k in WINS} | {f"{k}_mult_sq": F.coalesce(F.col(f"{k}_sq") / (unit * unit), zero) for k in WINS})


def _rates(rows: DataFrame) -> DataFrame:
    """Sums with what follows from them."""
    n, zero = F.col("rounds").cast("double"), F.lit(0.0)
    rows = rows.withColumn("rtp", F.when(F.col("total_bet") > 0, F.col("total_win") / F.when(F.col("total_bet") > 0, F.col("total_bet"))).otherwise(zero))
    spread = F.sqrt(F.greatest(zero, (F.col("total_mult_sq") - F.col("total_mult") * F.col("total_mult") / n) / (n - 1)))
    rows = rows.withColumn("std", F.when(F.col("rounds") < 2, zero).otherwise(F.coalesce(spread, zero)))
    rows = rows.withColumn("cv", F.when(F.col("rtp") > 0, F.col("std") / F.when(F.col("rtp") > 0, F.col("rtp"))).otherwise(zero))
    half = F.when(F.col("rounds") > 1, 1.96 * (F.col("std") / F.sqrt(n))).otherwise(zero)
    some = F.when(F.col("rounds") > 0, n)
    return rows.withColumns(
        {
            "ci_lo": F.greatest(F.col("rtp") - half, zero),
            "ci_hi": F.col("rtp") + half,
            "trigger_rate": F.coalesce(F.col("triggers") / some, zero),
            "hit_rate": F.coalesce(1.0 - F.col("no_win_rounds") / some, zero),
        }
    )


COUNTED = ("rounds", "total_bet", "total_win", "base_win", "free_win", "triggers", "no_win_rounds")


def finalise(parts: DataFrame, *keys: str) -> DataFrame:
    """Partial reports of a simulation, with exact sums of squares, added up to what :func:`summary` gives for all their rounds."""
    parts = parts.withColumn("free_win", F.col("total_win") - F.col("base_win"))
    rows = parts.groupBy(*keys).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTED),
        _unit().alias("bet_unit"),
        *(F.coalesce(F.sum(f"{k}_sq").cast("double"), F.lit(0.0)).alias(f"{k}_sq") for k in WINS),
    )
    return _rates(_multiples(rows)).drop(*(f"{k}_sq" for k in WINS))


def finalise_buckets(parts: DataFrame, *keys: str) -> DataFrame:
    """The same for the buckets: what :func:`distribution` gives."""
    counts = parts.groupBy(*keys).agg(F.coalesce(F.sum("rounds"), F.lit(0)).alias("rounds"), *(F.coalesce(F.sum(F.col(f"{k}_buckets")[i]), F.lit(0)).alias(f"{k}{i}") for k in WINS for i in range(len(BUCKET_NAMES))))
    return _unpivoted(counts, *keys)


def distribution(ledger: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, label, total_n, base_n, free_n, total_share, base_share, free_share): all 14 buckets of each group.

    The counts are 42 conditional sums in one pass, without a row for each win.
    """
    wins = {"total": F.col("total_win"), "base": F.col("base_win"), "free": F.col("total_win") - F.col("base_win")}
    at = {k: bucket(w, F.col("bet_unit")) for k, w in wins.items()}
    slim = ledger.select(*keys, *(c.alias(k) for k, c in at.items()))
    counts = slim.groupBy(*keys).agg(F.count("*").alias("rounds"), *(F.count_if(F.col(k) == i).alias(f"{k}{i}") for k in at for i in range(len(BUCKET_NAMES))))
    return _unpivoted(counts, *keys)


def _unpivoted(counts: DataFrame, *keys: str) -> DataFrame:
    """A row for each bucket from counts total0, base0, free0 and so on."""
    entries = F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(name).alias("label"), *(F.col(f"{k}{i}").alias(f"{k}_n") for k in WINS)) for i, name in enumerate(BUCKET_NAMES)))
    rows = counts.select(*keys, "rounds", F.inline(entries))
    share = {f"{k}_share": F.coalesce(F.col(f"{k}_n") / F.when(F.col("rounds") > 0, F.col("rounds")), F.lit(0.0)) for k in WINS}
    return rows.withColumns(share).drop("rounds")


def merge(reports: DataFrame, *keys: str) -> DataFrame:
    """Reports of one game and bet unit added up to one, with all its rates; session columns don't merge and are left out."""
    sums = [*COUNTED, *(f"{k}_mult_sq" for k in WINS)]
    rows = reports.groupBy(*keys).agg(_unit().alias("bet_unit"), *(F.coalesce(F.sum(c), F.lit(0)).cast("double" if c.endswith("sq") else "long").alias(c) for c in sums))
    unit = F.col("bet_unit").cast("double")
    return _rates(rows.withColumns({f"{k}_mult": F.coalesce(F.col(f"{k}_win") / unit, F.lit(0.0)) for k in WINS}))


def merge_buckets(buckets: DataFrame, *keys: str) -> DataFrame:
    """Distributions of one game added up: counts by bucket, and their shares."""
    rows = buckets.groupBy(*keys, "bucket", "label").agg(*(F.sum(f"{k}_n").alias(f"{k}_n") for k in WINS))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # 14 rows a group
    return rows.withColumns({f"{k}_share": F.coalesce(F.col(f"{k}_n") / F.nullif(F.sum(f"{k}_n").over(every), F.lit(0)), F.lit(0.0)) for k in WINS})
