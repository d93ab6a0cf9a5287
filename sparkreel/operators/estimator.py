"""What players experience: exact nearest-rank quantiles, shares at thresholds, event counts, each with its interval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.beta import clopper_pearson, quantile_ranks
from .report import BUCKET_NAMES, bucket, summary
from .sessions import outcomes

QUANTILES = (("p10", 0.10), ("p33", 1.0 / 3.0), ("p50", 0.5), ("p67", 2.0 / 3.0), ("p90", 0.90))
RTP_MARKS = (0.3, 0.5, 0.7, 1.0)
BINS = 4096


def nearest_rank_index(n: int, q: float) -> int:
    """0-based rank of the q-quantile of n values: int(q * n), kept inside."""
    return min(max(int(q * n), 0), n - 1)


def values_at_ranks(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at 0-based ranks of the ascending order of a column without nulls.

    No sort: equal values are counted once for all, and the counts of BINS equal bins between the extremes tell in which bins the ranks lie.  Such a
    bin is binned again between its own extremes until it holds one value, so outliers cost a round and no task gets more than its share.
    """
    counted = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).persist()
    try:
        lo, hi = counted.agg(F.min("v"), F.max("v")).first()
        found: dict[int, float] = {}
        left = [(lo, hi, 0, sorted(set(ranks)))] if lo is not None and ranks else []
        while left:
            where, place = F.lit(None).cast("int"), F.lit(0)
            for i, (a, b, _, _) in enumerate(left):
                inside = F.col("v").between(a, b)
                where = F.when(inside, F.lit(i)).otherwise(where)
                place = F.when(inside, F.least(F.floor((F.col("v") - a) / ((b - a) or 1) * BINS), F.lit(BINS - 1)).cast("int")).otherwise(place)
            binned = counted.select("v", "n", where.alias("i"), place.alias("bin")).where("i is not null")
            rows = binned.groupBy("i", "bin").agg(F.sum("n").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()  # BINS rows for each rank at most
            fresh = []
            for i, (_, _, before, wanted) in enumerate(left):
                for r in sorted((r for r in rows if r["i"] == i), key=lambda r: r["bin"]):
                    own = [k for k in wanted if before <= k < before + r["n"]]
                    if own and r["a"] == r["b"]:
                        found |= dict.fromkeys(own, r["a"])
                    elif own:
                        fresh.append((r["a"], r["b"], before, own))
                    before += r["n"]
            left = fresh
        return found
    finally:
        counted.unpersist()


def player_rtp(ledger: DataFrame) -> DataFrame:
    """(player_id, rtp) on each player's own bets."""
    return summary(ledger, "player_id").select("player_id", "rtp")


def rtp_quantiles(ledger: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(name, q, value, lo, hi) of the players' RTP."""
    rtp = player_rtp(ledger).persist()
    try:
        n = rtp.count()
        ranks = {name: (nearest_rank_index(n, q), *quantile_ranks(n, q, confidence)) for name, q in QUANTILES} if n else {}
        values = values_at_ranks(rtp, "rtp", sorted({r for x in ranks.values() for r in x}))
    finally:
        rtp.unpersist()
    rows = [(name, q, *(float(values[r]) for r in ranks[name])) for name, q in QUANTILES if ranks]
    return ledger.sparkSession.createDataFrame(rows, "name string, q double, value double, lo double, hi double")


def with_intervals(rows: DataFrame, k: str, n: str, confidence: float = 0.95) -> DataFrame:
    """``rows`` with share, lo and hi: ``k`` in ``n`` and its exact binomial interval; nothing in nothing is 0 in the whole range."""
    at, names = (rows.columns.index(k), rows.columns.index(n)), [*rows.columns, "share", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True))
            bounds = [clopper_pearson(a, b, confidence) for a, b in pairs]
            shares = [a / b if b else 0.0 for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shares, pa.float64()), *(pa.array([x[i] for x in bounds], pa.float64()) for i in (0, 1))], names=names)

    return rows.mapInArrow(run, rows.withColumns(dict.fromkeys(("share", "lo", "hi"), F.lit(None).cast("double"))).schema)


def rtp_cdf(ledger: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(mark, players, at_most, share, lo, hi): players whose RTP is at most each mark."""
    rtp = player_rtp(ledger)
    sums = rtp.agg(F.count("*").alias("players"), *(F.count_if(F.col("rtp") <= m).alias(f"m{i}") for i, m in enumerate(RTP_MARKS)))
    rows = F.array(*(F.struct(F.lit(m).alias("mark"), F.col(f"m{i}").alias("at_most")) for i, m in enumerate(RTP_MARKS)))
    return with_intervals(sums.select("players", F.inline(rows)).select("mark", "players", "at_most"), "at_most", "players", confidence)


def event_counts(ledger: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(times, players, of, share, lo, hi): how many of all players triggered 0, 1, 2 and 3 or more times; times 3 stands for more."""
    per = ledger.groupBy("player_id").agg(F.least(F.sum("trigger"), F.lit(3)).alias("k"))
    sums = per.agg(F.count("*").alias("of"), *(F.count_if(F.col("k") == t).alias(f"t{t}") for t in range(4)))
    entries = F.array(*(F.struct(F.lit(t).alias("times"), F.col(f"t{t}").alias("players")) for t in range(4)))
    return with_intervals(sums.select("of", F.inline(entries)).select("times", "players", "of"), "players", "of", confidence)


def bucket_counts(ledger: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(bucket, label, times, players, of, share, lo, hi): the same for wins in each of the 14 buckets."""
    at = bucket(F.col("total_win"), F.col("bet_unit"))
    per = ledger.select("player_id", at.alias("b")).groupBy("player_id").agg(*(F.least(F.count_if(F.col("b") == i), F.lit(3)).alias(f"b{i}") for i in range(len(BUCKET_NAMES))))
    sums = per.agg(F.count("*").alias("of"), *(F.count_if(F.col(f"b{i}") == t).alias(f"b{i}t{t}") for i in range(len(BUCKET_NAMES)) for t in range(4)))
    entries = F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(name).alias("label"), F.lit(t).alias("times"), F.col(f"b{i}t{t}").alias("players")) for i, name in enumerate(BUCKET_NAMES) for t in range(4)))
    return with_intervals(sums.select("of", F.inline(entries)).select("bucket", "label", "times", "players", "of"), "players", "of", confidence)


def session_shares(ledger: DataFrame, init_bets: int = 20, confidence: float = 0.95) -> DataFrame:
    """(name, k, n, share, lo, hi) of bust, cashout and alive."""
    names = ("bust", "cashout", "alive")
    sums = outcomes(ledger, init_bets).agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in names))
    entries = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("k")) for c in names))
    return with_intervals(sums.select("n", F.inline(entries)).select("name", "k", "n"), "k", "n", confidence)
