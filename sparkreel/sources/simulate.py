"""The seeded simulation source: spins as ledger rows, generated a batch at a time in numpy inside ``mapInArrow``.

A spin is a function of (seed, spin_id).  A logic is made once a task from a game, and turns the streams of a batch into (base wins, total wins, trigger counts).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators.boards import Found, fall, refill, scorer
from ..operators.cluster import Clusters
from ..operators.report import BUCKET_EDGES
from ..operators.sampling import alias_pick
from ..operators.tuner import SeedBank
from .config import ConfigError, Game, Mode, decode_fixed
from .ledger import COLUMNS
from .record import Acts, assemble, restore, snapshot
from .wire import MODE as MODE_TYPE
from .wire import STATE as STATE_TYPE

U64 = np.uint64
#: Spins that a task handles at once.
BATCH = 1 << 15
#: Spins whose whole results a task holds at once.
RECORDED = 1 << 11
Rounds = tuple[np.ndarray, np.ndarray, np.ndarray]
Play = Callable[[np.ndarray, int], Rounds]
Logic = Callable[[Game], Play]


class Reels:
    """A mode's reels as padded arrays; weighted starts by a look-up on cumulative weights."""

    def __init__(self, mode: Mode) -> None:
        self.mode = mode
        self.strips = [[np.array(r.symbols, np.int8) for r in s.reels] for s in mode.reel_sets]
        self.rising = [[np.cumsum(r.weights) for r in s.reels] for s in mode.reel_sets]
        self.even = [[len(set(r.weights)) == 1 for r in s.reels] for s in mode.reel_sets]
        self.set_rising = np.cumsum([s.weight for s in mode.reel_sets])

    def pick(self, bits: np.ndarray, which: int, column: int) -> np.ndarray:
        """A weighted place on a reel."""
        rising = self.rising[which][column]
        if self.even[which][column]:
            return rng.below(bits, len(rising))
        return np.searchsorted(rising, rng.below(bits, int(rising[-1])), "right")

    def boards(self, state: np.ndarray, first_draw: np.ndarray | int, fixed: int | None = None) -> np.ndarray:
        """int8 (spins, cells): draw ``first_draw`` picks the set, unless a ``fixed`` one is wanted; the next ones the columns or cells."""
        mode, n = self.mode, len(state)
        out = np.empty((n, mode.rows, mode.columns), np.int8)
        chosen = np.zeros(n, np.int64)
        if fixed is not None:
            chosen[:] = fixed
        elif np.count_nonzero(np.diff(self.set_rising, prepend=0)) > 1:
            chosen = np.searchsorted(self.set_rising, rng.below(rng.draw(state, first_draw), int(self.set_rising[-1])), "right")
        else:
            chosen[:] = int(np.argmax(self.set_rising > 0))
        for which in np.unique(chosen):
            rows = slice(None) if (chosen == which).all() else np.flatnonzero(chosen == which)
            own, base = state[rows], np.broadcast_to(first_draw, (n,))[rows] + 1
            for c in range(mode.columns):
                strip = self.strips[which][c]
                if mode.reel_type == "GenReelByReelIdx":
                    start = self.pick(rng.draw(own, base + c), which, c)
                    ring = np.concatenate([strip, np.resize(strip, mode.rows)])
                    for r in range(mode.rows):
                        out[rows, r, c] = ring[start + r]
                else:
                    for r in range(mode.rows):
                        out[rows, r, c] = strip[self.pick(rng.draw(own, base + c * mode.rows + r), which, c)]
        return out.reshape(n, -1)


def line_table(mode: Mode) -> np.ndarray:
    """Pay of every sequence of symbols along a line, left to right; index in base len(symbols)."""
    k, cols = len(mode.symbols), mode.columns
    if k**cols > 1 << 24:
        raise ConfigError("too many symbol sequences for a line table")
    index = np.arange(k**cols)
    cells = np.stack([index // k ** (cols - 1 - c) % k for c in range(cols)])
    wild, paid = np.array(mode.wild), np.array(mode.paid)
    pay = np.concatenate([np.zeros((k, 1), np.int64), np.array(mode.pay_table, np.int64)[:, :cols]], 1)
    lead = np.cumprod(wild[cells], 0).sum(0)
    other = cells[np.minimum(lead, cols - 1), index]
    has = (lead < cols) & paid[other]
    run = np.cumprod(wild[cells] | (cells == other), 0).sum(0)
    return np.maximum(pay[cells[0], lead], np.where(has, pay[other, run], 0)).astype(np.int32)


class LineGame:
    """Win of boards over all lines by one look-up a line."""

    def __init__(self, mode: Mode) -> None:
        self.mode, self.tables = mode, []
        table = line_table(mode)
        k = len(mode.symbols)
        for d in {"ltr": [0], "rtl": [1], "both": [0, 1]}[mode.bet_type.rpartition("_")[2]]:
            for line in mode.lines:
                cells = [r * mode.columns + c for c, r in enumerate(line)]
                self.tables.append(cells[::-1] if d else cells)
        self.table = table
        # the places of a line have rising powers of the base, from its last cell
        self.powers = [k ** (mode.columns - 1 - i) for i in range(mode.columns)]

    def win(self, boards: np.ndarray) -> np.ndarray:
        cells = np.ascontiguousarray(boards.T).astype(np.int32)
        scaled: dict[tuple[int, int], np.ndarray] = {}
        out = np.zeros(len(boards), np.int64)
        at = np.empty(len(boards), np.int32)
        for line in self.tables:
            for i, c in enumerate(line):
                if (i, c) not in scaled:
                    scaled[i, c] = cells[c] * np.int32(self.powers[i])
            np.add(scaled[0, line[0]], scaled[1, line[1]] if len(line) > 1 else 0, out=at)
            for i, c in enumerate(line[2:], 2):
                at += scaled[i, c]
            out += self.table.take(at)
        return out


@dataclass(frozen=True)
class FreeRounds:
    """Fixed part of the line game; names in the configuration are kept."""

    free_round: int = 10
    demo_b: tuple = ()
    demo_c: str = ""


@dataclass(frozen=True)
class CascadeRules:
    """Fixed part of the cascade game."""

    max_step: int = 1000
    free_rounds: int = 10
    scatter_pay: int = 300
    trigger: int = 3


#: Draw numbers are dealt out so that base and free rounds never share one.
PER_ROUND = 1 << 12


def _free_rounds(state: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(streams, first draws) of all free rounds of these spins, round by round."""
    return np.tile(state, rounds), np.repeat(np.arange(1, rounds + 1) * PER_ROUND, len(state))


class LinesLogic:
    """A base board; more than two scatters start free rounds on the second mode."""

    def __init__(self, game: Game) -> None:
        self.rules = decode_fixed(FreeRounds, {k: tuple(v) if isinstance(v, list) else v for k, v in game.fixed.items()})
        base, free = game.modes[0], game.modes[min(1, len(game.modes) - 1)]
        self.reels, self.free_reels, self.modes = Reels(base), Reels(free), (base, free)
        self.score, self.free_score = LineGame(base), LineGame(free)
        self.scatter = np.array(base.scatter)

    def __call__(self, state: np.ndarray, bet_mult: int) -> Rounds:
        boards = self.reels.boards(state, 0)
        base_win = self.score.win(boards) * bet_mult
        triggered = self.scatter[boards].sum(1) > 2
        hit = np.flatnonzero(triggered)
        total = base_win.copy()
        if len(hit) and self.rules.free_round:
            free_state, draws = _free_rounds(state[hit], self.rules.free_round)
            total[hit] += self.free_score.win(self.free_reels.boards(free_state, draws)).reshape(self.rules.free_round, -1).sum(0) * bet_mult
        return base_win, total, triggered.astype(np.int64)

    def record(self, state: np.ndarray, bet_mult: int) -> tuple[list[Acts], dict[int, np.ndarray]]:
        """The acts of the same spins: a screen, its win, and the trigger with its scatters; then a screen and its win for each free round."""
        boards = self.reels.boards(state, 0)
        scatter = self.scatter[boards]
        triggered = scatter.sum(1) > 2
        hit = np.flatnonzero(triggered)
        ext = [{"is_trigger": True, "scatters": int(scatter[i].sum()), "scatter_hits": np.flatnonzero(scatter[i]).tolist()} for i in hit]
        acts = _scored(self.modes[0], boards, np.arange(len(state)), 0, 0, bet_mult)
        acts.append(Acts("trigger", hit, 0, 0, 2, ext=ext))
        if len(hit) and self.rules.free_round:
            free_state, draws = _free_rounds(state[hit], self.rules.free_round)
            rounds = np.repeat(np.arange(self.rules.free_round), len(hit))
            acts += _scored(self.modes[1], self.free_reels.boards(free_state, draws), np.tile(hit, self.rules.free_round), 1, rounds, bet_mult)
        return acts, {0: triggered.astype(np.int32)}


def _scored(mode: Mode, boards: np.ndarray, rows: np.ndarray, number: int, rounds: np.ndarray | int, bet_mult: int) -> list[Acts]:
    """A screen, and its win if there is one."""
    rounds = np.broadcast_to(rounds, rows.shape)
    win, found = _hits(mode, boards, bet_mult)
    paid = np.flatnonzero(win)
    return [Acts("screen", rows, number, rounds, 0, screen=boards), Acts("win", rows[paid], number, rounds[paid], 1, win[paid], found=found)]


def _hits(mode: Mode, boards: np.ndarray, bet_mult: int) -> tuple[np.ndarray, list[Found]]:
    """(win of each board, hits whose rows count the boards that win)."""
    found = list(scorer(mode).found(boards.astype(np.int16), np.full(len(boards), bet_mult, np.int64))) if any(mode.paid) else []
    win = np.zeros(len(boards), np.int64)
    for f in found:
        np.add.at(win, f.row, f.win)
    number = np.cumsum(win > 0) - 1
    return win, [f._replace(row=number[f.row]) for f in found]


def _fall_and_fill(boards: np.ndarray, reels: Reels, pos: np.ndarray, columns: int, rows: int) -> np.ndarray:
    """Symbols fall in each column; empty cells fill from the bottom with the refill reels stepping back."""
    grid, _ = fall(boards, columns, rows)
    pos[:] = refill(grid, reels.strips[1], pos)
    return grid.reshape(len(boards), -1)


class Cascade:
    """One mode of a cascade game."""

    def __init__(self, mode: Mode, rules: CascadeRules) -> None:
        self.mode, self.rules, self.reels, self.tool = mode, rules, Reels(mode), Clusters(mode)

    def play(self, state: np.ndarray, draw: np.ndarray | int, bet_mult: int, acts: list[Acts] | None = None, rows: np.ndarray | None = None, number: int = 0, rounds: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(win, final boards): score, clear, fall and refill until nothing pays; all spins of a batch step together.

        With ``acts``, what happens to the spins ``rows`` in mode ``number`` is recorded.
        """
        mode, reels, tool = self.mode, self.reels, self.tool
        boards = reels.boards(state, draw).copy()
        pos = np.stack([reels.pick(rng.draw(state, draw + 64 + c), 1, c) for c in range(mode.columns)], 1)
        wins, live = np.zeros(len(state), np.int64), np.arange(len(state))
        rounds = np.broadcast_to(rounds, (len(state),))

        def add(kind: str, at: np.ndarray, order: int, **what: Any) -> None:
            if acts is not None:
                acts.append(Acts(kind, rows[at], number, rounds[at], order, **what))

        add("gen_screen", live, 0, screen=boards.copy(), step_end=not self.rules.max_step)
        for step in range(self.rules.max_step):
            won, hit, found = tool.score(boards[live], bet_mult)
            keep = won > 0
            if step == 0 and acts is not None:
                acts[-1].step_end = ~keep
            if acts is not None:
                index = np.cumsum(keep) - 1
                hits = [Found(index[r], s.astype(np.int64) * tool.cells + cells.argmax(1), p, s, 0, k, np.zeros(len(r), np.int64), 0, cells) for r, s, k, p, b in found for cells in [tool.spread(b)]]
                add("win", live[keep], 4 * step + 1, win=won[keep], found=hits)
            live, hit = live[keep], hit[keep]
            if not len(live):
                break
            wins[live] += won[keep]
            cleared = boards[live]
            cleared[tool.spread(hit)] = 0
            own = pos[live]
            add("clear", live, 4 * step + 2, screen=cleared, step_end=True)
            if acts is not None:
                add("gravity", live, 4 * step + 3, screen=fall(cleared, mode.columns, mode.rows)[0].reshape(len(live), -1), step_end=True)
            boards[live] = _fall_and_fill(cleared, reels, own, mode.columns, mode.rows)
            pos[live] = own
            add("fillscreen", live, 4 * step + 4, screen=boards[live], step_end=True)
        return wins, boards


class CascadeLogic:
    """A cascade; enough scatters on the last board pay and start free cascades on the second mode, which don't start more."""

    def __init__(self, game: Game) -> None:
        self.rules = decode_fixed(CascadeRules, game.fixed)
        self.base, self.free = Cascade(game.modes[0], self.rules), Cascade(game.modes[min(1, len(game.modes) - 1)], self.rules)
        self.scatter = np.array(game.modes[0].scatter)

    def _play(self, state: np.ndarray, bet_mult: int, acts: list[Acts] | None) -> Rounds:
        rules = self.rules
        base_win, boards = self.base.play(state, 0, bet_mult, acts, np.arange(len(state)))
        scatter = self.scatter[boards]
        hit = scatter.sum(1) >= rules.trigger
        base_win = base_win + np.where(hit, rules.scatter_pay * bet_mult, 0)
        total, rows = base_win.copy(), np.flatnonzero(hit)
        if acts is not None:
            ext = [{"is_trigger": True, "scatters": int(scatter[i].sum()), "scatter_hits": np.flatnonzero(scatter[i]).tolist()} for i in rows]
            acts.append(Acts("trigger", rows, 0, 0, 4 * rules.max_step + 5, rules.scatter_pay * bet_mult, ext=ext))
        if len(rows) and rules.free_rounds:
            free_state, draws = _free_rounds(state[rows], rules.free_rounds)
            won = self.free.play(free_state, draws, bet_mult, acts, np.tile(rows, rules.free_rounds), 1, np.repeat(np.arange(rules.free_rounds), len(rows)))[0]
            total[rows] += won.reshape(rules.free_rounds, -1).sum(0)
        return base_win, total, hit.astype(np.int64)

    def __call__(self, state: np.ndarray, bet_mult: int) -> Rounds:
        return self._play(state, bet_mult, None)

    def record(self, state: np.ndarray, bet_mult: int) -> tuple[list[Acts], dict[int, np.ndarray]]:
        """The acts of the same spins: screens, wins, cleared, fallen and filled screens, and the trigger with its scatters and pay."""
        acts: list[Acts] = []
        trigger = self._play(state, bet_mult, acts)[2]
        return acts, {0: trigger.astype(np.int32)}


def record(play: Play, state: np.ndarray, bet_mult: int) -> tuple[list[Acts], dict[int, np.ndarray]]:
    """What a logic records of these spins; of one that records nothing, an act for the base part and one for the free part."""
    if hasattr(play, "record"):
        return play.record(state, bet_mult)
    base, total, trigger = play(state, bet_mult)
    at = np.flatnonzero(trigger)
    return [Acts("base", np.arange(len(base)), 0, 0, 0, base), Acts("free", at, 1, 0, 0, (total - base)[at])], {0: trigger.astype(np.int32)}


#: Logic by key; :class:`sparkreel.plans.engine.Engine` adds its own to a copy.
LOGICS: dict[str, Logic] = {"demo_normal": LinesLogic, "demo_cascade": CascadeLogic}
#: Columns of a partial report.
PART_TYPES = {
    **{k: pa.int64() for k in ("rounds", "bet_unit", "total_bet", "total_win", "base_win", "triggers", "no_win_rounds")},
    **{f"{k}_sq": pa.decimal128(38, 0) for k in ("total", "base", "free")},
    **{f"{k}_buckets": pa.list_(pa.int64()) for k in ("total", "base", "free")},
}
LEDGER = "spin_id long, player_id long, seq long, bet_unit long, bet long, total_win long, base_win long, trigger int"


def banked(bank: SeedBank, state: np.ndarray) -> np.ndarray:
    """Spin ids picked from a bank whose seeds are 8-byte ids."""
    slot = rng.below(rng.draw(state, 0), len(bank.prob))
    level = np.floor(rng.unit(rng.draw(state, 1)) * bank.total)
    return np.frombuffer(bank.seeds, "<i8")[alias_pick(bank.prob, bank.alias, bank.total, slot, level)]


def _chunks(spark: SparkSession, spins: int, partitions: int | None) -> DataFrame:
    """A row for each BATCH spins; the spins themselves are numbered in the tasks."""
    return spark.range(0, -(-spins // BATCH), 1, min(partitions or spark.sparkContext.defaultParallelism, max(1, -(-spins // BATCH))))


def _played(make: Logic, game: Game, spins: int, seed: int, bet_mult: int, first_spin: int, bank: SeedBank | None, prng: str = "splitmix"):
    """A function from batches of chunk numbers to (spin ids, base wins, total wins, triggers) of one chunk after another."""

    draw = rng.GENERATORS.get(prng)
    if draw is None:
        raise ValueError(f"no generator {prng}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        rng.GENERATORS.setdefault(prng, draw)  # a registered one travels along
        play = make(game)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                own = first_spin + np.arange(chunk * BATCH, min(spins, (chunk + 1) * BATCH))
                with rng.using(prng):
                    rounds = play(rng.streams(seed, own if bank is None else banked(bank, rng.streams(~seed, own))), bet_mult)
                yield own, *rounds

    return run


def simulate(spark: SparkSession, game: Game, spins: int, seed: int = 1, bet_mode: int = 0, bet_mult: int = 1, partitions: int | None = None, logic: Logic | None = None, first_spin: int = 0, bank: SeedBank | None = None, prng: str = "splitmix") -> DataFrame:
    """A ledger of ``spins`` spins.  The rows don't depend on ``partitions``; any range of spin ids can be replayed alone.

    With a ``bank`` each spin plays a banked spin id, picked by the bank's weights.  Draws come from the generator ``prng``.
    """
    unit = game.bet_units[bet_mode]
    played = _played(logic or LOGICS[game.logic_key], game, spins, seed, bet_mult, first_spin, bank, prng)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, base, total, trigger in played(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(base), pa.array(trigger.astype(np.int32))], names=["spin_id", "total_win", "base_win", "trigger"])

    rows = _chunks(spark, spins, partitions).mapInArrow(run, "spin_id long, total_win long, base_win long, trigger int")
    fixed = {"player_id": 0, "bet_unit": unit, "bet": unit * bet_mult}
    return rows.withColumns({k: F.lit(v).cast("long") for k, v in fixed.items()} | {"seq": F.col("spin_id")}).select(*COLUMNS)


def simulated_parts(spark: SparkSession, game: Game, spins: int, seed: int = 1, bet_mode: int = 0, bet_mult: int = 1, partitions: int | None = None, logic: Logic | None = None, first_spin: int = 0, bank: SeedBank | None = None) -> DataFrame:
    """The ledger of :func:`simulate` as partial reports, a row for each BATCH spins: what ``operators.report.finalise`` adds up."""
    unit = game.bet_units[bet_mode]
    played = _played(logic or LOGICS[game.logic_key], game, spins, seed, bet_mult, first_spin, bank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, base, total, trigger in played(batches):
            n, wins = len(base), {"total": total, "base": base, "free": total - base}
            row = {"rounds": n, "bet_unit": unit, "total_bet": n * unit * bet_mult, "total_win": int(total.sum()), "base_win": int(base.sum()), "triggers": int(trigger.sum()), "no_win_rounds": int((total <= 0).sum())}
            row |= {f"{k}_sq": _square_sum(w) for k, w in wins.items()}
            row |= {f"{k}_buckets": np.bincount(np.where(w <= 0, 0, np.searchsorted(np.array(BUCKET_EDGES) * unit, w, "right")), minlength=len(BUCKET_EDGES) + 1).tolist() for k, w in wins.items()}
            yield pa.RecordBatch.from_pydict({k: pa.array([v], PART_TYPES[k]) for k, v in row.items()})

    schema = ", ".join(f"{k} {'array<long>' if pa.types.is_list(t) else 'decimal(38,0)' if pa.types.is_decimal(t) else 'long'}" for k, t in PART_TYPES.items())
    return _chunks(spark, spins, partitions).mapInArrow(run, schema)


def _square_sum(x: np.ndarray) -> int:
    """Exact: squares of 31-bit halves fit in 64 bits, also when a chunk of them is added up."""
    high, low = x >> 20, x & ((1 << 20) - 1)
    return (int((high * high).sum()) << 40) + (int((high * low).sum()) << 21) + int((low * low).sum())


def simulate_players(spark: SparkSession, game: Game, players: int, rounds: int, init_bets: int, seed: int = 1, bet_mode: int = 0, partitions: int | None = None, logic: Logic | None = None) -> DataFrame:
    """A ledger of each player's rounds until bust, cash-out or ``rounds``; all players of a batch play a round together."""
    make = logic or LOGICS[game.logic_key]
    unit = game.bet_units[bet_mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        play = make(game)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            start = unit * init_bets
            balance, live = np.full(len(ids), start), np.arange(len(ids)) if start >= unit else np.arange(0)
            for k in range(rounds):
                if not len(live):
                    break
                spin = ids[live] * rounds + k
                base, total, trigger = play(rng.streams(seed, spin), 1)
                n = len(live)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spin), pa.array(ids[live]), pa.array(np.full(n, k)), pa.array(np.full(n, unit)), pa.array(np.full(n, unit)), pa.array(total), pa.array(base), pa.array(trigger.astype(np.int32))],
                    names=["spin_id", "player_id", "seq", "bet_unit", "bet", "total_win", "base_win", "trigger"],
                )
                balance[live] += total - unit
                live = live[(balance[live] >= unit) & (balance[live] < 3 * start)]

    return spark.range(0, players, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(run, LEDGER)


def results(spark: SparkSession, game: Game, spins: int, seed: int = 1, bet_mult: int = 1, partitions: int | None = None, logic: Logic | None = None, first_spin: int = 0) -> DataFrame:
    """(spin_id, gamemodes): the same spins as :func:`simulate`, with all their modes, acts, screens and details."""
    make = logic or LOGICS[game.logic_key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        play = make(game)
        for batch in batches:
            for lo in range(0, batch.num_rows, RECORDED):
                ids = batch.column(0).slice(lo, RECORDED)
                acts, triggers = record(play, rng.streams(seed, ids.to_numpy()), bet_mult)
                yield pa.RecordBatch.from_arrays([ids, assemble(acts, len(ids), triggers, game.logic_key)], names=["spin_id", "gamemodes"])

    return spark.range(first_spin, first_spin + spins, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(run, f"spin_id long, gamemodes array<{MODE_TYPE}>")


def _starts(batch: pa.RecordBatch, seed: int, bank: SeedBank | None) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(seed of each request, its spin, what is wrong): of its snapshot, or else of its id or the bank."""
    ids, error, texts = batch.column(0).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
    seeds, spins = np.full(len(ids), seed, np.int64), ids.copy() if bank is None else banked(bank, rng.streams(~seed, ids)).copy()
    for i, text in enumerate(texts):
        if text and error[i] is None:
            if found := restore(text):
                seeds[i], spins[i] = found
            else:
                error[i] = "the start state can't be read"
    return seeds, spins, error


def wins(requests: DataFrame, game: Game, logic: Logic, seed: int, bank: SeedBank | None = None) -> DataFrame:
    """(request_id, gid, win, base_win, trigger, error): :func:`answers` without the acts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        play = logic(game)
        for batch in batches:
            mult, n = batch.column(2).to_numpy(zero_copy_only=False), batch.num_rows
            seeds, spins, error = _starts(batch, seed, bank)
            ok = np.array([e is None for e in error], bool)
            win, base, trigger = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
            for m in np.unique(mult[ok]):
                at = np.flatnonzero(ok & (mult == m))
                base[at], win[at], trigger[at] = play(rng.streams(seeds[at], spins[at]), int(m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(win, mask=~ok), pa.array(base, mask=~ok), pa.array(trigger, mask=~ok), pa.array(error, pa.string())], names=["request_id", "gid", "win", "base_win", "trigger", "error"])

    return requests.mapInArrow(run, "request_id long, gid long, win long, base_win long, trigger int, error string")


def answers(requests: DataFrame, game: Game, logic: Logic, seed: int, bank: SeedBank | None = None) -> DataFrame:
    """(request_id, gid, win, base_win, trigger, error, spin_state, gamemodes) for checked requests (request_id, gid, bet_mult, error, start).

    A request with a ``start`` plays the spin of that snapshot again; one without plays the spin of its id, or what the bank's weights pick for
    it.  The state after a spin is the snapshot of the next one.  Where ``error`` is not null, or the snapshot can't be read, nothing is played.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        play = logic(game)
        for whole in batches:
            for lo in range(0, whole.num_rows, RECORDED):
                batch = whole.slice(lo, RECORDED)
                mult, n = batch.column(2).to_numpy(zero_copy_only=False), batch.num_rows
                seeds, spins, error = _starts(batch, seed, bank)
                ok = np.array([e is None for e in error], bool)
                acts: list[Acts] = []
                triggers: dict[int, np.ndarray] = {}
                for m in np.unique(mult[ok]):
                    at = np.flatnonzero(ok & (mult == m))
                    some, counts = record(play, rng.streams(seeds[at], spins[at]), int(m))
                    for part in some:
                        part.row = at[part.row]
                    acts += some
                    for mode, count in counts.items():
                        triggers.setdefault(mode, np.zeros(n, np.int32))[at] = count
                won = np.zeros((2, n), np.int64)
                for part in acts:
                    np.add.at(won[0], part.row, part.win)
                    if part.mode == 0:
                        np.add.at(won[1], part.row, part.win)
                state = [{"start_b64u": snapshot(int(s), int(i)), "after_b64u": snapshot(int(s), int(i) + 1), "cp": None} if e is None else None for s, i, e in zip(seeds, spins, error, strict=True)]
                kind = pa.struct([("start_b64u", pa.string()), ("after_b64u", pa.string()), ("cp", pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(won[0], mask=~ok), pa.array(won[1], mask=~ok), pa.array(triggers.get(0, np.zeros(n, np.int32)), mask=~ok), pa.array(error, pa.string()), pa.array(state, kind), assemble(acts, n, triggers, game.logic_key)],
                    names=["request_id", "gid", "win", "base_win", "trigger", "error", "spin_state", "gamemodes"],
                )

    return requests.mapInArrow(run, f"request_id long, gid long, win long, base_win long, trigger int, error string, spin_state {STATE_TYPE}, gamemodes array<{MODE_TYPE}>")
