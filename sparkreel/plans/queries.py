"""Driver queries over the shared tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, rng
from ..operators import acts, boards, cluster, estimator, report, sampling, sessions, tags, tuner
from ..sources import ledger, wire
from ..sources.config import Mode
from . import demo
from .engine import Engine


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.from_events(_table(spark, sf_dir, "events"))


LEDGER_SQL = """
l as (select event_id spin_id, user_id player_id, ts, event_id, 40::bigint bet_unit, 40::bigint bet, (event_type = 'purchase')::int trig,
  case when event_type in ('view', 'error') then 0 else floor(value) end::bigint base_win,
  case when event_type = 'purchase' then floor(value * 3) else 0 end::bigint free_win from events),
led as (select *, base_win + free_win total_win from l)"""
SUMMARY_SQL = """count(*)::bigint rounds, sum(bet)::bigint total_bet, sum(total_win)::bigint total_win, sum(base_win)::bigint base_win, sum(free_win)::bigint free_win,
  sum(trig)::bigint triggers, sum((total_win <= 0)::int)::bigint no_win_rounds, sum(total_win)::double / sum(bet)::double rtp,
  case when count(*) < 2 then 0.0e0 else sqrt(greatest(0.0e0, (sum(total_win * total_win)::double / 1600.0e0 - (sum(total_win)::double / 40.0e0) * (sum(total_win)::double / 40.0e0) / count(*)) / (count(*) - 1))) end std"""
ROUNDED = ("rtp", "std", "cv", "ci_lo", "ci_hi", "trigger_rate", "hit_rate")


def _rounded(df: DataFrame, columns, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def stat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one report row of the whole ledger."""
    names = ("rounds", "total_bet", "total_win", "base_win", "free_win", "triggers", "no_win_rounds", *ROUNDED)
    return _rounded(report.summary(_rounds(spark, sf_dir)).select(*names), ROUNDED)


STAT_SQL = f"""with {LEDGER_SQL}, s as (select {SUMMARY_SQL} from led)
select rounds, total_bet, total_win, base_win, free_win, triggers, no_win_rounds, round(rtp, 9) rtp, round(std, 9) std,
  round(case when rtp > 0 then std / rtp else 0 end, 9) cv, round(greatest(0.0e0, rtp - 1.96e0 * (std / sqrt(rounds))), 9) ci_lo, round(rtp + 1.96e0 * (std / sqrt(rounds)), 9) ci_hi,
  round(triggers::double / rounds, 9) trigger_rate, round(1.0e0 - no_win_rounds::double / rounds, 9) hit_rate from s"""


def win_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.distribution(_rounds(spark, sf_dir)), ("total_share", "base_share", "free_share"))


def _bucket_sql(win: str) -> str:
    return f"case when {win} <= 0 then 0 else 1 + " + " + ".join(f"({win} >= {e} * 40)::int" for e in report.BUCKET_EDGES[1:]) + " end"


_LABELS = ", ".join(f"({i}, '{name}')" for i, name in enumerate(report.BUCKET_NAMES))
BUCKET_SQL = f"""with {LEDGER_SQL}, b as (select {_bucket_sql('total_win')} t, {_bucket_sql('base_win')} b, {_bucket_sql('free_win')} f from led)
select v.bucket::int bucket, v.label, count(*) filter (t = v.bucket) total_n, count(*) filter (b = v.bucket) base_n, count(*) filter (f = v.bucket) free_n,
  round(count(*) filter (t = v.bucket) / count(*)::double, 9) total_share, round(count(*) filter (b = v.bucket) / count(*)::double, 9) base_share, round(count(*) filter (f = v.bucket) / count(*)::double, 9) free_share
from b cross join (values {_LABELS}) v(bucket, label) group by v.bucket, v.label"""


def player_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.summary(_rounds(spark, sf_dir), "player_id").select("player_id", "rounds", "total_bet", "total_win", "base_win", "free_win", "triggers", "no_win_rounds", "rtp", "std"), ("rtp", "std"))


PLAYER_SQL = f"""with {LEDGER_SQL}, s as (select player_id, {SUMMARY_SQL} from led group by player_id) select * replace (round(rtp, 9) as rtp, round(std, 9) as std) from s"""


def session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.outcomes(_rounds(spark, sf_dir), 20)


SESSION_CTE = f"""{LEDGER_SQL},
r as (select *, row_number() over w rn, 800 + sum(total_win - 40) over (w rows unbounded preceding) balance from led window w as (partition by player_id order by ts, event_id)),
e as (select *, min(case when balance < 40 or balance >= 2400 then rn end) over (partition by player_id) stop from r),
p as (select * from e where stop is null or rn <= stop),
so as (select player_id, count(*)::bigint rounds, 800::bigint init_balance, arg_max(balance, rn)::bigint balance, greatest(800, max(balance))::bigint max_balance, least(800, min(balance))::bigint min_balance,
  bool_or(balance < 40) bust, bool_or(balance >= 2400) cashout, not bool_or(balance < 40 or balance >= 2400) alive from p group by player_id)"""
SESSION_SQL = f"with {SESSION_CTE} select * from so"


def player_rtp_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimator.rtp_quantiles(_rounds(spark, sf_dir)).select("name", F.round("value", 9).alias("value"))


QUANTILE_SQL = f"""with {LEDGER_SQL}, p as (select player_id, sum(total_win)::double / sum(bet)::double rtp from led group by player_id),
o as (select rtp, row_number() over (order by rtp) - 1 rk, count(*) over () n from p),
q as (select * from (values ('p10', 0.1e0), ('p33', 1.0e0 / 3.0e0), ('p50', 0.5e0), ('p67', 2.0e0 / 3.0e0), ('p90', 0.9e0)) v(name, q))
select name, round(rtp, 9) "value" from q join o on rk = least(greatest(floor(q * n)::bigint, 0), n - 1)"""


def _interval_sql(rows: str) -> str:
    """CTEs: ci (id, lo, hi), the exact binomial intervals of ``rows`` (id, k, n), by halving on the binomial tail."""
    x = "((a + b) / 2)"
    tail = f"list_sum(list_transform(range(m, n + 1), lambda j: exp(lgamma(n + 1.0e0) - lgamma(j + 1.0e0) - lgamma(n - j + 1.0e0) + j * ln{x} + (n - j) * ln(1 - {x}))))"
    return f"""bi as (select id, side, k + side m, n, case side when 0 then 0.025e0 else 0.975e0 end t, 0.0e0 a, 1.0e0 b, 0 i from {rows} cross join (values (0), (1)) s(side)
  union all select id, side, m, n, t, case when {tail} < t then {x} else a end, case when {tail} < t then b else {x} end, i + 1 from bi where i < 54),
ci as (select id, max(case when side = 0 then case when m = 0 then 0 else {x} end end) lo, max(case when side = 1 then case when m > n then 1 else {x} end end) hi from bi where i = 54 group by id)"""


INTERVAL = ("share", "lo", "hi")


def quantile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(estimator.rtp_quantiles(_rounds(spark, sf_dir)), ("q", "value", "lo", "hi"))


QUANTILE_CI_SQL = f"""with recursive {LEDGER_SQL}, p as (select player_id, sum(total_win)::double / sum(bet)::double rtp from led group by player_id),
o as (select rtp, row_number() over (order by rtp) - 1 rk, count(*) over () n from p),
q as (select * from (values ('p10', 0.1e0), ('p33', 1.0e0 / 3.0e0), ('p50', 0.5e0), ('p67', 2.0e0 / 3.0e0), ('p90', 0.9e0)) v(name, q)),
r as (select name id, least(greatest(floor(q * n)::bigint, 1), n - 1) k, n, q from q cross join (select count(*) n from p)),
{_interval_sql('r')},
places as (select id, q, n, least(greatest(floor(q * n)::bigint, 0), n - 1) mid, floor(lo * n)::bigint low, greatest(floor(hi * n)::bigint - 1, 0) high from r join ci using (id))
select id "name", round(q, 9) q, round(m.rtp, 9) "value", round(l.rtp, 9) lo, round(h.rtp, 9) hi from places join o m on m.rk = mid join o l on l.rk = low join o h on h.rk = high"""


def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(estimator.session_shares(_rounds(spark, sf_dir), 20), INTERVAL)


CLOPPER_SQL = f"""with recursive {SESSION_CTE},
c as (select v.id, count(*) filter (case v.id when 'bust' then bust when 'cashout' then cashout else alive end) k, count(*) n from so cross join (values ('bust'), ('cashout'), ('alive')) v(id) group by v.id),
{_interval_sql('c')}
select id "name", k, n, round(k / n::double, 9) share, round(lo, 9) lo, round(hi, 9) hi from c join ci using (id)"""


def player_rtp_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(estimator.rtp_cdf(_rounds(spark, sf_dir)), INTERVAL)


CDF_SQL = f"""with recursive {LEDGER_SQL}, p as (select player_id, sum(total_win)::double / sum(bet)::double rtp from led group by player_id),
c as (select mark id, count(*) filter (rtp <= mark) k, count(*) n from p cross join (values (0.3e0), (0.5e0), (0.7e0), (1.0e0)) v(mark) group by mark),
{_interval_sql('c')}
select id mark, n players, k at_most, round(k / n::double, 9) share, round(lo, 9) lo, round(hi, 9) hi from c join ci using (id)"""


def event_count_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(estimator.event_counts(_rounds(spark, sf_dir)), INTERVAL)


EVENT_SQL = f"""with recursive {LEDGER_SQL}, p as (select player_id, sum(trig) k from led group by player_id),
c as (select t id, count(*) filter (least(k, 3) = t) k, count(*) n from p cross join range(4) v(t) group by t),
{_interval_sql('c')}
select id::int times, k players, n "of", round(k / n::double, 9) share, round(lo, 9) lo, round(hi, 9) hi from c join ci using (id)"""


def bucket_count_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(estimator.bucket_counts(_rounds(spark, sf_dir)), INTERVAL)


BUCKET_COUNT_SQL = f"""with recursive {LEDGER_SQL}, b as (select player_id, {_bucket_sql('total_win')} b from led),
p as (select player_id, v.bucket, v.label, least(3, count(*) filter (b = v.bucket)) k from b cross join (values {_LABELS}) v(bucket, label) group by 1, 2, 3),
c as (select 4 * bucket + t id, bucket, label, t, count(*) filter (k = t) k, count(*) n from p cross join range(4) v(t) group by bucket, label, t),
{_interval_sql('c')}
select bucket::int bucket, label, t::int times, k players, n "of", round(k / n::double, 9) share, round(lo, 9) lo, round(hi, 9) hi from c join ci using (id)"""


def merged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of each kind of event, merged to the report of all."""
    names = ("rounds", "total_bet", "total_win", "base_win", "free_win", "triggers", "no_win_rounds", *ROUNDED)
    rows = _rounds(spark, sf_dir).withColumn("kind", F.col("player_id") % 5)
    return _rounded(report.merge(report.summary(rows, "kind")).select(*names), ROUNDED)


# boards: 5 columns and 3 rows of 7 symbols, from order keys

COLS, ROWS = 5, 3
SYMBOLS = ("W1", "H1", "H2", "L1", "L2", "L3", "C1")
PAYS = ((0, 0, 40, 400, 1600), (0, 0, 40, 400, 1600), (0, 0, 20, 160, 600), (0, 0, 10, 80, 160), (0, 5, 10, 80, 160), (0, 0, 10, 40, 120), (0, 0, 0, 0, 0))
BOARD_MODE = Mode(COLS, ROWS, "GenReelByReelIdx", (), SYMBOLS, PAYS, "line_ltr", demo.LINES[:5])
COUNT_PAYS = tuple(tuple((7 - s) * n if s < 6 and n >= 4 + s % 2 else 0 for n in range(1, COLS * ROWS + 1)) for s in range(7))


def _cell(key: str, r: int, k: int) -> str:
    return f"((({key} * {31 + 17 * r}) % 101) * {k + 3} + ({key} * {7 + 5 * k}) % 53) % 7"


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ", ".join(f"cast({_cell('o_orderkey', r, k)} as smallint)" for r in range(ROWS) for k in range(COLS))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(f"array({cells})").alias("board"))


BOARD_SQL = "b as (select o_orderkey id, [" + ", ".join(f"({_cell('o_orderkey', r, k)})::int" for r in range(ROWS) for k in range(COLS)) + "] board from orders)"


def _totals(df: DataFrame, mode: Mode) -> DataFrame:
    return boards.score_boards(df, mode).select("id", "win", F.size("details").alias("n_details"), F.size(F.flatten("details.hits")).alias("n_hits"))


def _line_scores(bet_type: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _totals(_boards(spark, sf_dir), dataclasses.replace(BOARD_MODE, bet_type=bet_type))

    return run


def _pay_sql(s: str, n: str, pays=PAYS) -> str:
    return f"coalesce({[list(p) for p in pays]}[({s}) + 1][{n}], 0)"


def _line_sql(directions: str) -> str:
    lines = ", ".join(f"{[r * COLS + c + 1 for c, r in enumerate(line)]}" for line in BOARD_MODE.lines)
    run = "case " + " ".join(f"when not (c[{i}] = 0 or c[{i}] = ns) then {i - 1}" for i in range(1, 9)) + " else 5 end"
    lead = "case " + " ".join(f"when c[{i}] <> 0 then {i - 1}" for i in range(1, 9)) + " else 5 end"
    return f"""with {BOARD_SQL}, n as (select unnest([{lines}]) line), d as (select unnest({directions}) rev),
x as (select id, list_transform(case when rev then list_reverse(line) else line end, lambda p: board[p]) c from b, n, d),
w as (select *, {lead} wr from x), m as (select *, c[wr + 1] ns from w), k as (select *, case when ns is null or ns = 6 then 0 else {run} end nr from m),
f as (select id, {_pay_sql('c[1]', 'wr')} * (wr > 0)::int pw, {_pay_sql('coalesce(ns, 9)', 'nr')} pn, wr, nr from k)
select id, sum(greatest(pw, pn))::bigint win, count(*) filter (greatest(pw, pn) > 0)::int n_details, sum(case when greatest(pw, pn) = 0 then 0 when pw > pn then wr else nr end)::int n_hits
from f group by id"""


def _way_scores(bet_type: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _totals(_boards(spark, sf_dir), dataclasses.replace(BOARD_MODE, bet_type=bet_type))

    return run


def _way_sql(directions: str) -> str:
    column = lambda k: f"[board[{k}], board[{k} + 5], board[{k} + 10]]"
    hits = ", ".join(f"len(list_filter({column(f'(case when rev then {5 - k} else {k + 1} end)')}, lambda v: {'v = s' if k == 0 else 'v = s or v = 0'}))" for k in range(COLS))
    run = "case " + " ".join(f"when h[{i}] = 0 then {i - 1}" for i in range(1, 9)) + " else 5 end"
    return f"""with {BOARD_SQL}, d as (select unnest({directions}) rev),
s as (select distinct id, board, rev, unnest({column('(case when rev then 5 else 1 end)')}) s from b, d),
x as (select id, s, case when s = 0 then [len(list_filter(w, lambda v: v = 0)) for w in [{', '.join(column(f'(case when rev then {5 - k} else {k + 1} end)') for k in range(COLS))}]] else [{hits}] end h from s),
r as (select id, s, h, {run} n from x), p as (select id, h, n, {_pay_sql('s', 'n')} win from r)
select b.id, coalesce(sum(win), 0)::bigint win, (count(*) filter (win > 0))::int n_details, coalesce(sum(case when win > 0 then list_sum(h[1:n]) end), 0)::int n_hits from b left join p using (id) group by b.id"""


def count_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = dataclasses.replace(BOARD_MODE, bet_type="count", pay_table=COUNT_PAYS)
    return _totals(_boards(spark, sf_dir), mode)


COUNT_SQL = f"""with {BOARD_SQL}, s as (select id, s, len(list_filter(board, lambda v: v = 0 or v = s)) n from b, range(6) t(s)),
p as (select id, n, {_pay_sql('s', 'n', COUNT_PAYS)} win from s)
select id, sum(win)::bigint win, (count(*) filter (win > 0))::int n_details, coalesce(sum(n) filter (win > 0), 0)::int n_hits from p group by id"""

CLUSTER_MODE = dataclasses.replace(BOARD_MODE, bet_type="cluster", pay_table=tuple(tuple(0 if s in (0, 9) or n < 4 else (7 - s) * n for n in range(1, 13)) for s in range(7)))


def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(_boards(spark, sf_dir), CLUSTER_MODE)


CLUSTER_SQL = f"""with recursive {BOARD_SQL},
c as (select id, unnest(range(15)) p, unnest(board) s from b),
m as (select b.id, t.s, p, c.s own from b cross join range(1, 9) t(s) join c on c.id = b.id and (c.s = t.s or c.s = 0)),
reach as (select id, s, p root, p from m where own = s
  union select r.id, r.s, r.root, n.p from reach r join m n on n.id = r.id and n.s = r.s and ((abs(n.p - r.p) = 1 and n.p // 5 = r.p // 5) or abs(n.p - r.p) = 5)),
own as (select r.id, r.s, r.root, count(*) n, min(r.p) filter (m.own = r.s) first from reach r join m on m.id = r.id and m.s = r.s and m.p = r.p group by 1, 2, 3),
k as (select id, s, n, {_pay_sql('s', 'least(n, 12)', CLUSTER_MODE.pay_table)} win from own where root = first)
select b.id, coalesce(sum(win), 0)::bigint win, (count(*) filter (win > 0))::int n_details, coalesce(sum(n) filter (win > 0), 0)::int n_hits from b left join k using (id) group by b.id"""


def _text(board: Column) -> Column:
    return F.array_join(board.cast("array<string>"), ",")


HITS = "array(cast(id % 15 as int), cast(id * 3 % 15 as int), cast(id * 7 % 15 as int), 20)"
HITS_SQL = "[id % 15, id * 3 % 15, id * 7 % 15, 20]"
CLEAR_SQL = f"{BOARD_SQL}, cl as (select id, list_transform(board, lambda x, i: case when list_contains({HITS_SQL}, i - 1) then 0 else x end) board from b)"
STRIPS = [[3 + (i * 3 + c) % 4 for i in range(7 + c)] for c in range(COLS)]


def _cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boards(spark, sf_dir).select("id", boards.clear(F.col("board"), F.expr(HITS), COLS * ROWS).alias("board"))


def clear_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleared(spark, sf_dir).select("id", _text(F.col("board")).alias("board"))


def gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.drop_boards(_cleared(spark, sf_dir), COLS, ROWS).select("id", _text(F.col("fallen")).alias("board"), _text(F.col("fill")).alias("fill"))


def _fallen_sql(k: int) -> str:
    column = f"[board[{k}], board[{k} + 5], board[{k} + 10]]"
    full = f"list_filter({column}, lambda x: x <> 0)"
    return f"list_concat([0 for z in range(3 - len({full}))], {full})"


_BOARD_OF_F = "[" + ", ".join(f"f[{k + 1}][{r + 1}]" for r in range(ROWS) for k in range(COLS)) + "]"
GRAVITY_CTE = f"{CLEAR_SQL}, fa as (select id, [{', '.join(_fallen_sql(k + 1) for k in range(COLS))}] f from cl), gr as (select id, f, {_BOARD_OF_F} g from fa)"
GRAVITY_SQL = f"""with {GRAVITY_CTE} select id, array_to_string(g, ',') board, array_to_string([{', '.join(f'(len(list_filter(f[{k + 1}], lambda x: x = 0)) - 1) * 5 + {k}' for k in range(COLS))}], ',') fill from gr"""


def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("array(" + ", ".join(f"cast(id % {len(s)} as int)" for s in STRIPS) + ")")
    rows = boards.fill_boards(_cleared(spark, sf_dir).withColumn("at", start), STRIPS, COLS, ROWS, positions="at")
    return rows.select("id", _text(F.col("filled")).alias("board"), _text(F.col("left")).alias("positions"))


def _filled(r: int, k: int) -> str:
    n = len(STRIPS[k])
    nth = " + ".join(f"(board[{q * COLS + k + 1}] = 0)::int" for q in range(r, ROWS))
    return f"case when board[{r * COLS + k + 1}] = 0 then {STRIPS[k]}[((id % {n} - ({nth})) % {n} + {n}) % {n} + 1] else board[{r * COLS + k + 1}] end"


def _left_at(k: int) -> str:
    n = len(STRIPS[k])
    return f"((id % {n} - ({' + '.join(f'(board[{q * COLS + k + 1}] = 0)::int' for q in range(ROWS))})) % {n} + {n}) % {n}"


FILL_SQL = f"with {CLEAR_SQL} select id, array_to_string([{', '.join(_filled(r, k) for r in range(ROWS) for k in range(COLS))}], ',') board, array_to_string([{', '.join(_left_at(k) for k in range(COLS))}], ',') positions from cl"


def reel_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.expr("array(" + ", ".join(f"cast(o_orderkey * {k + 2} % {len(s)} as int)" for k, s in enumerate(STRIPS)) + ")")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _text(boards.window_of_reels(STRIPS, starts, ROWS)).alias("board"))


REEL_SQL = "select o_orderkey id, array_to_string([" + ", ".join(f"{STRIPS[k]}[(o_orderkey * {k + 2} % {len(STRIPS[k])} + {r}) % {len(STRIPS[k])} + 1]" for r in range(ROWS) for k in range(COLS)) + "], ',') board from orders"


# acts, tags, samples


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("spin_id"), "event_id", F.floor("value").alias("actwin"), kind.isin("purchase", "error").alias("is_round_end"), kind.isin("purchase", "error", "signup").alias("is_step_end"))
    return acts.running_totals(acts.number_acts(rows, "spin_id", order="event_id"), "spin_id", order="event_id")


def acts_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acts(spark, sf_dir).select("spin_id", "event_id", "round", "step", "act", "actwin", "nowtotalwin", "roundaccwin", "stepaccwin")


ACTS_CTE = """e as (select user_id spin_id, event_id, floor(value)::bigint actwin, (event_type in ('purchase', 'error'))::int re, (event_type in ('purchase', 'error', 'signup'))::int se from events),
r as (select *, coalesce(sum(re) over (partition by spin_id order by event_id rows between unbounded preceding and 1 preceding), 0)::int "round" from e),
s as (select *, coalesce(sum(se) over (partition by spin_id, "round" order by event_id rows between unbounded preceding and 1 preceding), 0)::int step from r),
a as (select *, (row_number() over (partition by spin_id, "round", step order by event_id) - 1)::int act,
  sum(actwin) over (partition by spin_id order by event_id)::bigint nowtotalwin, sum(actwin) over (partition by spin_id, "round" order by event_id)::bigint roundaccwin,
  sum(actwin) over (partition by spin_id, "round", step order by event_id)::bigint stepaccwin from s)"""
ACTS_SQL = f'with {ACTS_CTE} select spin_id, event_id, "round", step, act, actwin, nowtotalwin, roundaccwin, stepaccwin from a'


def spin_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts nested into results and flattened again."""
    rows = _acts(spark, sf_dir)
    act = F.struct("round", "step", "act", F.lit("act").alias("acttype"), "actwin", "stepaccwin", "roundaccwin", "nowtotalwin", F.array().cast(f"array<{wire.DETAIL}>").alias("details"))
    nested = rows.groupBy("spin_id").agg(F.array_sort(F.collect_list(act)).alias("acts"))
    results = nested.select("spin_id", F.array(F.struct("acts")).alias("gamemodes"))
    return wire.flatten_acts(results)


FLATTEN_SQL = f'with {ACTS_CTE} select spin_id, 0 mode, "round", step, act, \'act\' acttype, actwin, stepaccwin, roundaccwin, nowtotalwin, 0 n_details from a'

def buffer_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a recorder's buffer: views record, errors discard, clicks replace the pending win, the others land acts."""
    kind = F.col("event_type")
    kinds = F.when(kind == "view", "detail").when(kind == "error", "discard").when(kind == "click", "set_win").otherwise("act")
    none = F.lit(None)
    rows = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("spin_id"), "event_id", kinds.alias("kind"), F.floor("value").alias("win"), F.array(F.col("event_id") % 15).cast("array<smallint>").alias("hits"),
        kind.alias("acttype"), F.when(kind == "purchase", "round").otherwise("step").alias("finish"), none.cast("array<smallint>").alias("screen"),
    )
    landed = acts.land_acts(rows, "spin_id", order="event_id")
    return landed.select("spin_id", "event_id", "acttype", "round", "step", "act", "is_round_end", "is_step_end", "actwin", "nowtotalwin", "roundaccwin", "stepaccwin", F.size("details").alias("n_details"))


BUFFER_SQL = """with e as (select user_id spin_id, event_id, event_type, floor(value)::bigint win, (event_type in ('signup', 'purchase'))::int lands from events),
g as (select *, coalesce(sum(lands) over (partition by spin_id order by event_id rows between unbounded preceding and 1 preceding), 0) n from e),
d as (select *, coalesce(max(event_id) filter (event_type = 'error') over (partition by spin_id, n), -1) gone from g),
c as (select *, coalesce(max(event_id) filter (event_type = 'click' and event_id > gone) over (partition by spin_id, n), -1) put from d),
l as (select spin_id, n, max(event_id) filter (lands = 1) event_id, max(event_type) filter (lands = 1) acttype,
  coalesce(sum(win) filter (event_type in ('view', 'click') and event_id > gone and event_id >= put), 0)::bigint actwin, (count(*) filter (event_type = 'view' and event_id > gone))::int n_details from c group by 1, 2),
a as (select *, acttype = 'purchase' is_round_end, true is_step_end from l where event_id is not null),
r as (select *, coalesce(sum(is_round_end::int) over (partition by spin_id order by event_id rows between unbounded preceding and 1 preceding), 0)::int "round" from a)
select spin_id, event_id, acttype, "round", (row_number() over w - 1)::int step, 0 act, is_round_end, is_step_end, actwin, (sum(actwin) over (partition by spin_id order by event_id))::bigint nowtotalwin,
  (sum(actwin) over w)::bigint roundaccwin, actwin stepaccwin, n_details from r window w as (partition by spin_id, "round" order by event_id)"""

TAGGER = tags.Tagger(["bg", "fg"])


def tag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounds(spark, sf_dir).select("spin_id", TAGGER.bits().alias("bits"))


TAG_CTE = f"{LEDGER_SQL}, t as (select *, (trig = 0)::int + 2 * (trig > 0 and (total_win - base_win) // 40 > 5)::int bits from led)"
TAG_SQL = f"with {TAG_CTE} select spin_id, bits::bigint bits from t"


def tag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = TAGGER.mask(["fg"])
    bits = F.col("bits")
    tests = {"covers": tags.covers(bits, mask), "equals": tags.equals(bits, mask), "any_of": tags.any_of(bits, 3), "none_of": tags.none_of(bits, 3)}
    return tag_bits(spark, sf_dir).agg(*(F.count_if(c).alias(k) for k, c in tests.items()))


MATCH_SQL = f"with {TAG_CTE} select count(*) filter (bits & 2 = 2) covers, count(*) filter (bits = 2) equals, count(*) filter (bits & 3 <> 0) any_of, count(*) filter (bits & 3 = 0) none_of from t"


def stratified_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping strata: rows that the full first one would have taken go on to the second."""
    rows = _rounds(spark, sf_dir).select("spin_id", "total_win", TAGGER.bits().alias("bits"))
    strata = [("base", tags.covers(F.col("bits"), 1) & F.col("total_win").between(0, 200), 100), ("any", F.col("total_win") >= 8, 60), ("fg", tags.covers(F.col("bits"), 2), 50)]
    return tags.collect_strata(rows, strata, "spin_id").select("cname", "spin_id", "total_win")


COLLECT_SQL = f"""with {TAG_CTE},
c1 as (select 'base' cname, spin_id, total_win from t where bits & 1 = 1 and total_win between 0 and 200 order by spin_id limit 100),
c2 as (select 'any' cname, spin_id, total_win from t where total_win >= 8 and spin_id not in (select spin_id from c1) order by spin_id limit 60),
c3 as (select 'fg' cname, spin_id, total_win from t where bits & 2 = 2 and spin_id not in (select spin_id from c1 union all select spin_id from c2) order by spin_id limit 50)
select * from c1 union all select * from c2 union all select * from c3"""

_U = "(p_partkey * 7919 % 10007 + 1) / 10008.0D"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice", F.expr("p_size % 6").alias("w"), F.expr(_U).alias("u"))


def weighted_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted_order(_parts(spark, sf_dir), "w", "u", "p_brand", tie="p_partkey").select("p_brand", "p_partkey", "place")


def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted_sample(_parts(spark, sf_dir), 3, "w", "u", "p_brand", tie="p_partkey").select("p_brand", "p_partkey", "place")


_SCORE = "p as (select p_brand, p_partkey, p_size % 6 w, case when p_size % 6 > 0 then -ln((p_partkey * 7919 % 10007 + 1) / 10008.0e0) / (p_size % 6) else 'inf'::double end score from part)"
SHUFFLE_SQL = f"with {_SCORE} select p_brand, p_partkey, (row_number() over (partition by p_brand order by score, p_partkey))::int place from p"
SAMPLE_SQL = f"with {_SCORE} select * from (select p_brand, p_partkey, (row_number() over (partition by p_brand order by score, p_partkey))::int place from p where w > 0) where place <= 3"


def lut_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.expr("array(p_size % 4, p_size % 3, p_size % 5)")
    return _table(spark, sf_dir, "part").select("p_partkey", _text(sampling.lut_column(weights)).alias("lut"))


LUT_SQL = "select p_partkey, array_to_string(list_concat(list_concat([0 for i in range(p_size % 4)], [1 for i in range(p_size % 3)]), [2 for i in range(p_size % 5)]), ',') lut from part"


def alias_mass_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mass that each part's alias table over three weights gives each index; parts of one size share a table."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(0).to_pylist()
            mass = [sampling.alias_mass(*sampling.alias_table([n % 4 + 1, n % 3, n % 5])).tolist() for n in sizes]
            yield pa.RecordBatch.from_pydict({"size": pa.array(sizes, pa.int32()), "masses": pa.array(mass, pa.list_(pa.int64()))})

    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    tables = parts.select("p_size").distinct().mapInArrow(run, "size int, masses array<long>")
    return parts.join(tables, parts["p_size"] == tables["size"]).select("p_partkey", F.posexplode("masses").alias("idx", "mass"))


ALIAS_SQL = "select p_partkey, i::int idx, (3 * [p_size % 4 + 1, p_size % 3, p_size % 5][i + 1])::bigint mass from part, range(3) t(i)"


#: Parts that a class, here a brand, collects at most: the tuner's functions work on such samples, which one task holds.
QUOTA = 100_000


def _per_class(spark: SparkSession, sf_dir: str, schema: str, work) -> DataFrame:
    """``work`` (wins, weights, keys) -> columns, on the collected sample of each class; wins rise, with the key where they tie."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("p_retailprice", "ascending"), ("p_partkey", "ascending")]))
        out = work(table["p_retailprice"].to_numpy(), table["p_size"].to_numpy().astype(float), table["p_partkey"].to_numpy())
        n = len(next(iter(out.values())))
        return pa.table({"p_brand": pa.array([table["p_brand"][0].as_py()] * n, pa.string())} | {k: pa.array(v) for k, v in out.items()})

    rows = _parts(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return rows.withColumn("place", place).where(F.col("place") <= QUOTA).drop("place").groupBy("p_brand").applyInArrow(run, f"p_brand string, {schema}")


SAMPLE_CTE = f"s as (select * from (select *, row_number() over (partition by p_brand order by p_partkey) place from part) where place <= {QUOTA})"


def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean and population deviation of prices in each class."""
    out = _per_class(spark, sf_dir, "mean double, std double", lambda x, w, _: {"mean": [tuner.mean_of(x, w / w.sum())], "std": [tuner.population_std(x, w)]})
    return _rounded(out, ("mean", "std"))


MOMENTS_SQL = f"""with {SAMPLE_CTE}, m as (select p_brand, sum(p_size * p_retailprice) / sum(p_size) mean from s group by 1)
select p_brand, round(any_value(mean), 9) mean, round(sqrt(sum(p_size * (p_retailprice - mean) ** 2) / sum(p_size)), 9) std from s join m using (p_brand) group by 1"""


def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_class(spark, sf_dir, "median double", lambda x, w, _: {"median": [tuner.median_of(x, w)]})


MEDIAN_SQL = f"""with {SAMPLE_CTE}, c as (select p_brand, p_retailprice, sum(p_size) over (partition by p_brand order by p_retailprice, p_partkey rows unbounded preceding) upto, sum(p_size) over (partition by p_brand) total from s)
select p_brand, min(p_retailprice) median from c where 2 * upto >= total group by 1"""


def gaussian_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(x, _, keys):
        w = tuner.normal_pdf(x, 1500.0, 200.0)
        return {"p_partkey": keys, "weight": w / w.sum()}

    return _rounded(_per_class(spark, sf_dir, "p_partkey long, weight double", work).drop("p_brand"), ("weight",))


GAUSS_SQL = f"""with {SAMPLE_CTE}, g as (select p_partkey, p_brand, exp(-0.5e0 * ((p_retailprice - 1500.0e0) / 200.0e0) ** 2) / (200.0e0 * sqrt(2 * pi())) w from s)
select p_partkey, round(w / sum(w) over (partition by p_brand), 9) weight from g"""


def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each class the mix of weights by price and by inverse price whose mean lies a quarter of the way up."""

    def work(x, _, keys):
        high, low = x / x.sum(), (1 / x) / (1 / x).sum()
        a, b = tuner.mean_of(x, high), tuner.mean_of(x, low)
        return {"p_partkey": keys, "weight": tuner.blend(x, high, low, b + (a - b) / 4)}

    return _rounded(_per_class(spark, sf_dir, "p_partkey long, weight double", work).drop("p_brand"), ("weight",))


BLEND_SQL = f"""with {SAMPLE_CTE}, t as (select p_brand, sum(p_retailprice) s1, sum(p_retailprice * p_retailprice) s2, sum(1.0e0 / p_retailprice) s0, count(*) n from s group by 1),
q as (select *, case when s2 / s1 = n / s0 then 1.0e0 else ((n / s0 + (s2 / s1 - n / s0) / 4) - n / s0) / (s2 / s1 - n / s0) end p from t)
select p_partkey, round(p * (p_retailprice / s1) + (1 - p) * ((1.0e0 / p_retailprice) / s0), 9) weight from s join q using (p_brand)"""


def quantize_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in each class as whole parts of 2**52 / n."""
    return _per_class(spark, sf_dir, "p_partkey long, weight long", lambda _, w, keys: {"p_partkey": keys, "weight": tuner.quantize(w)}).drop("p_brand")


QUANTIZE_SQL = f"""with {SAMPLE_CTE}, t as (select p_brand, sum(p_size) total, count(*) n from s group by 1)
select p_partkey, floor(p_size::double / total::double * greatest({tuner.ACCURACY} // n, 1)::double)::bigint weight from s join t using (p_brand)"""


def gamma_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random gamma mixtures over a class's collected wins, made on the executors."""
    setting = tuner.ClassSetting("base", (), 0, 10000, 400, 0, 60.0, 20, 20, tuner.Mixture("gamma", (3, 5), 80.0, 15.0, (5.0, 30.0), (0.1, 0.7), (0.3, 0.4)), (0.0, 1e9))
    rows = tags.collect_disjoint(_rounds(spark, sf_dir).select("spin_id", "total_win"), [("base", F.col("total_win").between(0, 10000), setting.collect)], "spin_id")
    wins = [r["total_win"] for r in rows.collect()]  # the class's quota bounds it
    return tuner.shapes_frame(spark, setting, wins, 200)


def tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classes collected from the ledger, tuned, and the bank's weights."""
    rows = _rounds(spark, sf_dir).select("spin_id", (F.col("total_win") / 40).alias("win"), TAGGER.bits().alias("bits"))
    mix = tuner.Mixture("gaussian", (2, 4), 2.0, 2.0, (1.0, 3.0), (0.1, 0.7), (0.4, 0.6))
    classes = tuner.share_out([
        tuner.ClassSetting("base", ("bg",), 0, 10, 100, 0, 1.0, 20, 50, mix, (0.0, 1e9)),
        tuner.ClassSetting("fg", ("fg",), 6, 60, 50, 50_000, 15.0, 20, 50, tuner.Mixture("gaussian", (2, 4), 15.0, 8.0, (4.0, 12.0), (0.1, 0.7)), (0.0, 1e9)),
    ])
    strata = [(c.name, tags.covers(F.col("bits"), TAGGER.mask(c.tags)) & F.col("win").between(c.min_win, c.max_win), c.collect) for c in classes]
    got = tags.collect_disjoint(rows, strata, "spin_id").orderBy("spin_id").collect()  # the classes' quotas bound it
    parts = [(c, np.array([r["win"] for r in got if r["cname"] == c.name]), [int(r["spin_id"]).to_bytes(8, "little") for r in got if r["cname"] == c.name]) for c in classes]
    bank, wins, weights = tuner.tune(parts, 4.0)
    out = [(int.from_bytes(bank.seed(i), "little"), float(wins[i]), float(weights[i])) for i in range(len(wins))]
    return spark.createDataFrame(out, "spin_id long, win double, weight double")


def simulate_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, games=[demo.line_game()])
    return report.summary(engine.simulate("demo_normal", 1_000_000))


SPINS, SPIN_SEED = 2000, 11


def simulate_line_spins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spins of the line game one by one."""
    rows = Engine(spark, games=[demo.line_game()]).simulate("demo_normal", SPINS, seed=SPIN_SEED)
    return rows.select("spin_id", "bet", "total_win", "base_win", "trigger")


def _spins_sql() -> str:
    """The same from scratch: counter-based draws as 128-bit whole numbers, reel windows, and runs along each line."""
    game, two64 = demo.line_game(), "18446744073709551616::uhugeint"
    golden, m1, m2, gap = (f"{x}::uhugeint" for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03))
    key = int(rng.splitmix(np.array([SPIN_SEED], np.uint64))[0])

    def mixed(name: str, source: str, x: str, keep: str) -> str:
        steps = [f"{name}0 as (select {keep}, ({x} + {golden}) % {two64} x from {source})", f"{name}1 as (select {keep}, (xor(x, x >> 30) * {m1}) % {two64} x from {name}0)"]
        return ", ".join([*steps, f"{name}2 as (select {keep}, (xor(x, x >> 27) * {m2}) % {two64} x from {name}1)", f"{name} as (select {keep}, xor(x, x >> 31) x from {name}2)"])

    reels = [[list(r.symbols) for r in mode.reel_sets[0].reels] for mode in game.modes]
    pays = [[list(p) for p in mode.pay_table] for mode in game.modes]
    free = game.fixed["free_round"]
    cells = ", ".join(f"{{reels}}[free][{c + 1}][(s[{c + 1}] + {r}) % len({{reels}}[free][{c + 1}]) + 1]" for r in range(3) for c in range(5)).format(reels=f"({reels})")
    lines = ", ".join(f"{[r * 5 + c + 1 for c, r in enumerate(line)]}" for line in game.modes[0].lines)
    run = "case " + " ".join(f"when not (c[{i}] = 2 or c[{i}] = ns) then {i - 1}" for i in range(1, 6)) + " else 5 end"
    lead = "case " + " ".join(f"when c[{i}] <> 2 then {i - 1}" for i in range(1, 6)) + " else 5 end"
    pay = lambda s, n: f"coalesce(({pays})[free][({s}) + 1][{n}], 0)"
    return f"""with i as (select range id, xor(range::ubigint, {key}::ubigint)::uhugeint x from range({SPINS})), {mixed('st', 'i', 'x', 'id')},
n as (select id, x, r, c, (r > 0)::int + 1 free, r * 4096 + 1 + c num from st cross join range({free + 1}) a(r) cross join range(5) b(c)),
{mixed('dr', 'n', f'(x + num::uhugeint * {gap})', 'id, r, c, free')},
s as (select id, r, any_value(free) free, list(((x * len(({reels})[free][c + 1])::uhugeint) >> 64)::bigint order by c) s from dr group by id, r),
b as (select id, r, free, [{cells}] board from s),
x as (select id, r, free, board, list_transform(line, lambda p: board[p]) c from b cross join (select unnest([{lines}]) line)),
w as (select *, {lead} wr from x), m as (select *, c[wr + 1] ns from w), k as (select *, case when ns is null or ns < 2 then 0 else {run} end nr from m),
f as (select id, r, sum(greatest({pay('c[1]', 'wr')} * (wr > 0)::int, {pay('coalesce(ns, 99)', 'nr')})) win, any_value(len(list_filter(board, lambda v: v = 1))) scatters from k group by id, r),
t as (select id, (max(case when r = 0 then scatters end) > 2)::int trigger, sum(case when r = 0 then win end) base, sum(case when r > 0 then win end) free from f group by id)
select id spin_id, 40::bigint bet, (base + trigger * free)::bigint total_win, base::bigint base_win, trigger from t"""


def result_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All acts of spins of the cascade game, flattened."""
    return wire.flatten_acts(Engine(spark, games=[demo.cascade_game()]).results("demo_cascade", SPINS, seed=SPIN_SEED))


def simulate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, games=[demo.cascade_game()])
    return report.summary(engine.simulate("demo_cascade", 100_000))


def player_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, games=[demo.line_game()])
    return sessions.outcomes(engine.simulate_players(0, 2000, 200, 50), 50)


def spin_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spin requests, some of them wrong, answered by the engine."""
    engine = Engine(spark, games=[demo.line_game(), demo.cascade_game()])
    key = F.col("o_orderkey")
    requests = _table(spark, sf_dir, "orders").select(key.alias("request_id"), (key % 3).alias("gid"), F.when(key % 3 == 0, "demo_normal").otherwise("demo_cascade").alias("game"), F.when(key % 5 == 0, F.lit(7)).when(key % 3 == 0, 40).otherwise(30).alias("bet"), F.lit(0).alias("bet_mode"), F.lit(1).alias("bet_mult"))
    return engine.spin(requests)


def spin_request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spin_requests(spark, sf_dir).groupBy("gid", "error").agg(F.count("*").alias("n"))


REQUEST_SQL = """select o_orderkey % 3 gid, case when o_orderkey % 3 = 2 then 'no such game' when o_orderkey % 5 = 0 then 'the bet is no multiple of its unit' end error, count(*) n from orders group by 1, 2"""


def posted_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = {"game_name": "x", "bet_units": [40], "bet_mode": 0, "bet": 40, "total_wins": [0, 40, 100, 7, 9], "base_wins": [0, 40, 20, 7, 9], "free_wins": [0, 0, 80, 0], "triggers": [0, 0, 1, 0, 0]}
    return report.summary(ledger.from_arrays(spark, posted)).select("rounds", "total_bet", "total_win", "base_win", "free_win", "triggers", F.round("rtp", 9).alias("rtp"))


POSTED_SQL = "select 4::bigint rounds, 160::bigint total_bet, 147::bigint total_win, 67::bigint base_win, 80::bigint free_win, 1::bigint triggers, round(147 / 160.0e0, 9) rtp"


def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, games=[demo.line_game(), demo.cascade_game()])
    return engine.catalog.summary(spark).select("game_id", "game_name", "logic_key", _text(F.col("bet_units")).alias("bet_units"), "n_modes", "bet_type")


CATALOG_SQL = "select * from (values (0::bigint, 'demo_normal', 'demo_normal', '40', 2, 'line_ltr'), (1::bigint, 'demo_cascade', 'demo_cascade', '30', 2, 'cluster')) v(game_id, game_name, logic_key, bet_units, n_modes, bet_type)"


def snapshot_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("p_name").cast("binary")
    coded = codec.to_base64url(data)
    return _table(spark, sf_dir, "part").select("p_partkey", coded.alias("b64u"), codec.to_hex(data).alias("hex"), (codec.from_base64url(coded) == data).alias("same"))


CODEC_SQL = "select p_partkey, rtrim(translate(base64(encode(p_name)), '+/', '-_'), '=') b64u, lower(hex(encode(p_name))) hex, true same from part"

ENTRIES = {
    "stat_summary": (stat_summary, STAT_SQL),
    "win_buckets": (win_buckets, BUCKET_SQL),
    "player_reports": (player_reports, PLAYER_SQL),
    "session_outcomes": (session_outcomes, SESSION_SQL),
    "player_rtp_quantiles": (player_rtp_quantiles, QUANTILE_SQL),
    "player_rtp_cdf": (player_rtp_cdf, CDF_SQL),
    "event_count_dist": (event_count_dist, EVENT_SQL),
    "bucket_count_dist": (bucket_count_dist, BUCKET_COUNT_SQL),
    "quantile_ci": (quantile_ci, QUANTILE_CI_SQL),
    "clopper_pearson": (clopper_pearson, CLOPPER_SQL),
    "merged_report": (merged_report, STAT_SQL),
    "line_scores": (_line_scores("line_ltr"), _line_sql("[false]")),
    "line_scores_rtl": (_line_scores("line_rtl"), _line_sql("[true]")),
    "line_scores_both": (_line_scores("line_both"), _line_sql("[false, true]")),
    "way_scores": (_way_scores("way_ltr"), _way_sql("[false]")),
    "way_scores_rtl": (_way_scores("way_rtl"), _way_sql("[true]")),
    "way_scores_both": (_way_scores("way_both"), _way_sql("[false, true]")),
    "count_scores": (count_scores, COUNT_SQL),
    "cluster_scores": (cluster_scores, CLUSTER_SQL),
    "clear_cells": (clear_cells, f"with {CLEAR_SQL} select id, array_to_string(board, ',') board from cl"),
    "gravity": (gravity, GRAVITY_SQL),
    "fill_holes": (fill_holes, FILL_SQL),
    "reel_window": (reel_window, REEL_SQL),
    "acts_running_totals": (acts_running_totals, ACTS_SQL),
    "spin_flatten": (spin_flatten, FLATTEN_SQL),
    "buffer_acts": (buffer_acts, BUFFER_SQL),
    "tag_bits": (tag_bits, TAG_SQL),
    "tag_match": (tag_match, MATCH_SQL),
    "stratified_collect": (stratified_collect, COLLECT_SQL),
    "weighted_shuffle": (weighted_shuffle, SHUFFLE_SQL),
    "weighted_sample": (weighted_sample, SAMPLE_SQL),
    "lut_expand": (lut_expand, LUT_SQL),
    "alias_mass_check": (alias_mass_check, ALIAS_SQL),
    "weighted_moments": (weighted_moments, MOMENTS_SQL),
    "weighted_median": (weighted_median, MEDIAN_SQL),
    "gaussian_weights": (gaussian_weights, GAUSS_SQL),
    "blend_weights": (blend_weights, BLEND_SQL),
    "quantize_weights": (quantize_weights, QUANTIZE_SQL),
    "gamma_weights": (gamma_weights, None),
    "tune": (tune, None),
    "simulate_line": (simulate_line, None),
    "simulate_line_spins": (simulate_line_spins, _spins_sql()),
    "result_acts": (result_acts, None),
    "simulate_cascade": (simulate_cascade, None),
    "player_study": (player_study, None),
    "spin_requests": (spin_requests, None),
    "spin_request_errors": (spin_request_errors, REQUEST_SQL),
    "posted_stat": (posted_stat, POSTED_SQL),
    "catalog_summary": (catalog_summary, CATALOG_SQL),
    "snapshot_codec": (snapshot_codec, CODEC_SQL),
}
QUERIES = {k: f for k, (f, _) in ENTRIES.items()}
SQL = {k: s for k, (_, s) in ENTRIES.items() if s}
