"""Acts of a spin: numbering by boundaries, running totals of mode, round and step, and the fold of recorded events into acts.

A recorder's buffer is a table of events in order.  What the buffer would do one event at a time is a fold by windows: an act lands the details that
were recorded since the act before it, but for those that were discarded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_acts(events: DataFrame, *keys: str, order: str) -> DataFrame:
    """``events`` (keys, order, actwin, is_step_end, is_round_end) with round, step and act from 0.

    A round end is also a step end; steps count from 0 in each round, acts in each step.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("round", F.count_if(F.col("is_round_end")).over(before).cast("int"))
    in_round = Window.partitionBy(*keys, "round").orderBy(order)
    rows = rows.withColumn("step", F.count_if(F.col("is_step_end")).over(in_round.rowsBetween(Window.unboundedPreceding, -1)).cast("int"))
    in_step = Window.partitionBy(*keys, "round", "step").orderBy(order)
    return rows.withColumn("act", (F.row_number().over(in_step) - 1).cast("int"))


def running_totals(acts: DataFrame, *keys: str, order: str) -> DataFrame:
    """``acts`` (numbered) with nowtotalwin, roundaccwin and stepaccwin: totals up to each act of its mode, round and step."""
    totals = {}
    for name, parts in (("nowtotalwin", keys), ("roundaccwin", (*keys, "round")), ("stepaccwin", (*keys, "round", "step"))):
        upto = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        totals[name] = F.sum("actwin").over(upto)
    return acts.withColumns(totals)


#: Kinds of events.  ``detail`` records a hit (win, hits; two segments are one hit of both); ``discard`` drops what is pending; ``set_win`` replaces the
#: pending win; ``act`` lands it, and ends its step or round as ``finish`` (act, step, round) says; ``finish_step`` and ``finish_round`` end those of
#: the last act; ``reset`` forgets everything before; ``end`` closes the result.
KINDS = ("detail", "discard", "set_win", "act", "finish_step", "finish_round", "reset", "end")


def _pending(events: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Events since the last reset, with the number of acts before each, and whether a detail and a replaced win still count."""
    every = Window.partitionBy(*keys)
    before = every.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind, over: F.max(F.when(F.col("kind") == kind, F.col(order))).over(over)
    rows = events.withColumn("__reset", last("reset", every)).where(F.col("__reset").isNull() | (F.col(order) > F.col("__reset")))
    rows = rows.withColumn("__n", F.count_if(F.col("kind") == "act").over(before))
    own = Window.partitionBy(*keys, "__n")
    rows = rows.withColumn("__gone", last("discard", own))
    alive = F.col("__gone").isNull() | (F.col(order) > F.col("__gone"))
    rows = rows.withColumn("__set", F.max(F.when((F.col("kind") == "set_win") & alive, F.col(order))).over(own))
    return rows.withColumns({"__kept": (F.col("kind") == "detail") & alive, "__counts": (F.col("kind").isin("detail", "set_win")) & alive & (F.col("__set").isNull() | (F.col(order) >= F.col("__set")))})


def _folded(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """One row for each act and for what is pending behind the last one."""
    detail = F.struct(F.col(order).alias("at"), F.coalesce("win", F.lit(0)).cast("long").alias("win"), F.coalesce("hits", F.array().cast("array<short>")).alias("hits"))
    act = F.col("kind") == "act"
    return rows.groupBy(*keys, "__n").agg(
        F.coalesce(F.sum(F.when(F.col("__counts"), F.coalesce("win", F.lit(0)))), F.lit(0)).cast("long").alias("actwin"),
        F.array_sort(F.collect_list(F.when(F.col("__kept"), detail))).alias("details"),
        F.max(F.when(act, F.col(order))).alias(order),
        *(F.max(F.when(act, F.col(c))).alias(c) for c in ("acttype", "finish", "screen")),
        F.max(F.col("kind") == "finish_step").alias("__step"),
        F.max(F.col("kind") == "finish_round").alias("__round"),
    )


def land_acts(events: DataFrame, *keys: str, order: str) -> DataFrame:
    """The acts of ``events`` (keys, order, kind, win, hits, acttype, finish, screen), numbered and with their running totals.

    Columns: keys, order (of the act's event), acttype, screen, actwin, details (win, hits), is_step_end, is_round_end, round, step, act and the
    totals.  What is pending behind the last act isn't part of it; see :func:`pending` and :func:`event_errors`.
    """
    folded = _folded(_pending(events, keys, order), keys, order)
    after = Window.partitionBy(*keys).orderBy("__n")
    flags = {f"__{c}_behind": F.coalesce(F.lead(f"__{c}").over(after), F.lit(False)) for c in ("step", "round")}
    rows = folded.withColumns(flags).where(F.col(order).isNotNull())
    ends_round = (F.col("finish") == "round") | F.col("__round_behind")
    rows = rows.withColumns({"is_round_end": F.coalesce(ends_round, F.lit(False)), "is_step_end": F.coalesce((F.col("finish") == "step") | F.col("__step_behind") | ends_round, F.lit(False))})
    rows = rows.withColumn("details", F.transform("details", lambda d: F.struct(d["win"].alias("win"), d["hits"].alias("hits"))))
    rows = rows.select(*keys, order, "acttype", "screen", "actwin", "details", "is_step_end", "is_round_end")
    return running_totals(number_acts(rows, *keys, order=order), *keys, order=order)


def pending(events: DataFrame, *keys: str, order: str) -> DataFrame:
    """(keys, win, hits, n_details) that were recorded behind the last act and not discarded, of each group."""
    rows = _folded(_pending(events, keys, order), keys, order)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(F.col(order).alias("at"), "actwin", "details"), "__n").alias("last"))
    open_ = F.col("last.at").isNull()
    none = F.array().cast("array<short>")
    return last.select(
        *keys,
        F.when(open_, F.col("last.actwin")).otherwise(F.lit(0)).cast("long").alias("win"),
        F.when(open_, F.flatten("last.details.hits")).otherwise(none).alias("hits"),
        F.when(open_, F.size("last.details")).otherwise(F.lit(0)).alias("n_details"),
    )


def event_errors(events: DataFrame, *keys: str, order: str, screen_size: int | None = None) -> DataFrame:
    """(keys, order, error) of events that a recorder refuses: unknown kinds, a finish without an act, a screen of another size, anything
    behind the end."""
    rows = _pending(events, keys, order)
    ended = F.count_if(F.col("kind") == "end").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)) > 0
    size: Column = F.lit(False) if screen_size is None else F.coalesce(F.size("screen") > 0, F.lit(False)) & (F.size("screen") != screen_size)
    error = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), F.lit("unknown kind"))
        .when(F.col("__ended"), F.lit("the result has ended"))
        .when(F.col("kind").startswith("finish") & (F.col("__n") == 0), F.lit("no act to finish"))
        .when((F.col("kind") == "act") & size, F.lit("the screen has another size"))
    )
    return rows.withColumn("__ended", ended).select(*keys, order, error.alias("error")).where("error is not null")


def last_screen(acts: DataFrame, *keys: str, order: str) -> DataFrame:
    """(keys, screen) of the last act of each group that has one."""
    return acts.where(F.col("screen").isNotNull()).groupBy(*keys).agg(F.max_by("screen", order).alias("screen"))


def last_hits(acts: DataFrame, *keys: str, order: str) -> DataFrame:
    """(keys, hits) of the last act of each group."""
    return acts.groupBy(*keys).agg(F.max_by("hits", order).alias("hits"))
