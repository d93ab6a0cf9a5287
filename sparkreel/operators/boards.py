"""Board scoring and transforms.

A board is an array of symbol indexes, row by row.  Boards are scored a batch at a time in numpy inside ``mapInArrow``: a line is read by a small
automaton, ways and counts are sums of matches by column and board, clusters grow as integers of bits (see :mod:`.cluster`).  As expressions the
same rules are either lambdas, which are interpreted for each cell, or methods too large for the JVM to compile; both were measured
to be ten times slower and more.  Transforms come both as expressions, without lambdas, and in batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import ConfigError, Mode, bet_kind, reads_left, reads_right
from .cluster import Clusters

DETAIL = "struct<win:bigint,symbol:smallint,line:int,count:int,comb:int,direction:smallint,hits:array<smallint>>"
ARROW_DETAIL = pa.struct([("win", pa.int64()), ("symbol", pa.int16()), ("line", pa.int32()), ("count", pa.int32()), ("comb", pa.int32()), ("direction", pa.int16()), ("hits", pa.list_(pa.int16()))])
#: Boards that are scored at once; bounds the temporary arrays.
BATCH = 1 << 14


class Found(NamedTuple):
    """Paid hits of one candidate over a batch: rows, a key of their order within a row, what a detail holds, and (rows, cells) of hits."""

    row: np.ndarray
    order: np.ndarray
    win: np.ndarray
    symbol: np.ndarray
    line: int
    count: np.ndarray
    comb: np.ndarray
    direction: int
    cells: np.ndarray


class Scorer(Protocol):
    """Scores boards (n, cells) whose cells of no known symbol are ``k``: their hits, one candidate after another."""

    def found(self, boards: np.ndarray, mult: np.ndarray) -> Iterator[Found]: ...


def _table(values: Iterable[int], kind: str = "int") -> Column:
    """A literal array, folded from text when the plan is made: a list of literals would be an expression for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _directions(bet_type: str) -> list[int]:
    return [0] * reads_right(bet_type) + [1] * reads_left(bet_type)


def _pays(mode: Mode, most: int) -> np.ndarray:
    """Pay by symbol and length from 0 to ``most``; a run beyond the table pays nothing."""
    return np.array([[0, *list(r)[:most], *[0] * (most - len(r))] for r in mode.pay_table], np.int64)


def line_automaton(mode: Mode) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(next state by state and symbol, (win, symbol, count) by state) for reading the cells of a line from its start.

    A state knows the leading run of wilds and its first one, the first other symbol, and how long it runs on with wilds.  The better of the
    two runs pays.  The last symbol stands for cells of no known symbol.
    """
    k, wild, paid = len(mode.symbols), (*mode.wild, False), (*mode.paid, False)

    def step(state: tuple, x: int) -> tuple:
        wilds, first, symbol, run, on = state
        if not on:
            return state
        if symbol < 0:
            if wild[x]:
                return wilds + 1, x if wilds == 0 else first, -1, 0, True
            return (wilds, first, x, wilds + 1, True) if paid[x] else (wilds, first, -1, 0, False)
        return (wilds, first, symbol, run + 1, True) if wild[x] or x == symbol else (wilds, first, symbol, run, False)

    def pay(symbol: int, n: int) -> int:
        return mode.pay_table[symbol][n - 1] if 0 < n <= len(mode.pay_table[symbol]) else 0

    def result(state: tuple) -> tuple[int, int, int]:
        wilds, first, symbol, run, _ = state
        by_wild, by_run = pay(first, wilds), pay(symbol, run) if symbol >= 0 else 0
        return (by_wild, first, wilds) if by_wild > by_run else (by_run, symbol, run)

    states, goes, fresh = {(0, -1, -1, 0, True): 0}, {}, [(0, -1, -1, 0, True)]
    for _ in range(mode.columns):
        found = []
        for state in fresh:
            for x in range(k + 1):
                after = step(state, x)
                if after not in states:
                    states[after] = len(states)
                    found.append(after)
                goes[states[state], x] = states[after]
        fresh = found
    return [goes.get((s, x), s) for s in range(len(states)) for x in range(k + 1)], [result(s) for s in states]


class Lines:
    """Lines left to right, right to left or both; a full-width run pays once in each direction."""

    def __init__(self, mode: Mode) -> None:
        goes, results = line_automaton(mode)
        self.base = len(mode.symbols) + 1
        self.goes = np.array(goes, np.int32)
        self.wins, self.symbols, self.counts = np.array(results, np.int64).T
        self.lines = [(d, number, [r * mode.columns + c for c, r in enumerate(line)][:: -1 if d else 1]) for d in _directions(mode.bet_type) for number, line in enumerate(mode.lines)]

    def found(self, boards: np.ndarray, mult: np.ndarray) -> Iterator[Found]:
        cells = np.ascontiguousarray(boards.T).astype(np.int32)
        known: dict[tuple[int, ...], np.ndarray] = {(): np.zeros(len(boards), np.int32)}  # lines that begin alike are read once
        for i, (d, number, at) in enumerate(self.lines):
            for n in range(1, len(at) + 1):
                if tuple(at[:n]) not in known:
                    known[tuple(at[:n])] = self.goes.take(known[tuple(at[: n - 1])] * self.base + cells[at[n - 1]])
            state = known[tuple(at)]
            row = np.flatnonzero(self.wins.take(state) > 0)
            state = state[row]
            count = self.counts[state]
            hit = np.zeros((len(row), boards.shape[1]), bool)
            hit[:, at] = np.arange(len(at)) < count[:, None]
            yield Found(row, np.full(len(row), i), self.wins[state] * mult[row], self.symbols[state], number, count, np.zeros(len(row), np.int64), d, hit)


class Ways:
    """Each distinct symbol of the first column runs over columns that hold it or a wild.

    Wilds don't stand in for it in the first column.  A wild leads only if some wild is paid, and then runs over wilds alone.  The win is
    the pay of the run's length; the number of combinations is reported, not multiplied in.
    """

    def __init__(self, mode: Mode) -> None:
        self.mode, self.pays = mode, _pays(mode, mode.columns)
        self.wild = np.array([*mode.wild, False])
        leads = any(w and p for w, p in zip(mode.wild, mode.paid, strict=True))
        self.starts = [s for s, p in enumerate(mode.paid) if p and (leads or not mode.wild[s])]

    def found(self, boards: np.ndarray, mult: np.ndarray) -> Iterator[Found]:
        mode, n = self.mode, len(boards)
        grid = boards.reshape(n, mode.rows, mode.columns)
        wild = self.wild[grid]
        for d in _directions(mode.bet_type):
            order = np.arange(mode.columns)[:: -1 if d else 1]
            for s in self.starts:
                own = grid == s
                begins = own[:, :, order[0]]
                at = np.flatnonzero(begins.any(1))
                match = wild[at] if self.wild[s] else own[at] | wild[at]
                if not self.wild[s]:
                    match[:, :, order[0]] = begins[at]
                held = match.sum(1)[:, order]
                run = np.cumprod(held > 0, 1).sum(1)
                win = self.pays[s, run] * mult[at]
                good = win > 0
                at, match, held, run, win = at[good], match[good], held[good], run[good], win[good]
                inside = np.zeros((len(at), mode.columns), bool)
                inside[:, order] = np.arange(mode.columns) < run[:, None]
                comb = np.where(np.arange(mode.columns) < run[:, None], held, 1).prod(1)
                yield Found(at, d * mode.rows + begins[at].argmax(1), win, np.full(len(at), s), 0, run, comb, d, (match & inside[:, None, :]).reshape(len(at), -1))


class Counts:
    """Each paid symbol by its number on the board plus all wilds, though it has none itself; a paid wild by the wilds alone."""

    def __init__(self, mode: Mode) -> None:
        self.pays, self.wild = _pays(mode, mode.columns * mode.rows), np.array([*mode.wild, False])
        self.paid = [s for s, p in enumerate(mode.paid) if p]

    def found(self, boards: np.ndarray, mult: np.ndarray) -> Iterator[Found]:
        wild = self.wild[boards]
        for s in self.paid:
            hit = wild if self.wild[s] else (boards == s) | wild
            count = hit.sum(1)
            win = self.pays[s, count] * mult
            row = np.flatnonzero(win > 0)
            yield Found(row, np.full(len(row), s), win[row], np.full(len(row), s), 0, count[row], np.zeros(len(row), np.int64), 0, hit[row])


class ClusterHits:
    """Clusters in the order of symbol, then first cell."""

    def __init__(self, mode: Mode) -> None:
        self.tool = Clusters(mode)

    def found(self, boards: np.ndarray, mult: np.ndarray) -> Iterator[Found]:
        tool = self.tool
        for row, symbol, size, win, bits in tool.score(boards, mult)[2]:
            cells = tool.spread(bits)
            yield Found(row, symbol * tool.cells + cells.argmax(1), win, symbol, 0, size, np.zeros(len(row), np.int64), 0, cells)


SCORERS: dict[str, type] = {"line": Lines, "way": Ways, "count": Counts, "cluster": ClusterHits}


def scorer(mode: Mode) -> Scorer:
    """What scores boards of the mode's bet type."""
    kind = bet_kind(mode.bet_type)
    if kind not in SCORERS:
        raise ConfigError(f"unknown bet type {mode.bet_type!r}")
    return SCORERS[kind](mode)


def cells_of(column: pa.Array, size: int, symbols: int, missing: int | None = None) -> np.ndarray:
    """(boards, size) of a list column; missing cells and what is no symbol become ``missing``, or ``symbols`` if none is named."""
    missing = symbols if missing is None else missing
    flat = column.flatten().fill_null(missing).to_numpy(zero_copy_only=False)
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if (length == size).all():
        out = flat.reshape(-1, size)
    else:
        out = np.full((len(length), size), missing, flat.dtype)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        row = np.repeat(np.arange(len(length)), length)
        out[row[place < size], place[place < size]] = flat[place < size]
    return np.where((out >= 0) & (out < symbols), out, missing).astype(flat.dtype)


def found_details(found: list[Found], n: int) -> pa.Array:
    """Lists of details for ``n`` boards, whose numbers are the rows of ``found``."""
    row, order, win, symbol, count, comb = (np.concatenate([getattr(f, c) for f in found]) for c in ("row", "order", "win", "symbol", "count", "comb"))
    line, direction = (np.repeat([getattr(f, c) for f in found], [len(f.row) for f in found]) for c in ("line", "direction"))
    by = np.lexsort((order, row))
    cells = np.concatenate([f.cells for f in found])[by]
    hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cells.sum(1))]).astype(np.int32)), pa.array(np.nonzero(cells)[1].astype(np.int16)))
    columns = [win, symbol.astype(np.int16), line.astype(np.int32), count.astype(np.int32), comb.astype(np.int32), direction.astype(np.int16)]
    flat = pa.StructArray.from_arrays([*(pa.array(c[by]) for c in columns), hits], fields=list(ARROW_DETAIL))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[by], np.arange(n + 1)).astype(np.int32)), flat)


def score_boards(boards: DataFrame, mode: Mode, board: str = "board", bet_mult: Column | None = None, details: bool = True) -> DataFrame:
    """``boards`` with ``win`` and, if wanted, ``details``: the paid hits of each board, by the mode's bet type.

    Hits of a detail are cells in rising order.  A null or short board counts its missing cells as no symbol, a long one is cut.  No column of
    ``boards`` may be called win or details.
    """
    scorer(mode)  # an unknown bet type fails here and not in a task
    size, k, width = mode.columns * mode.rows, len(mode.symbols), len(boards.columns)
    names = [*boards.columns, "win", *(["details"] if details else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scorer(mode)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                n, mult = batch.num_rows, batch.column(width + 1).fill_null(1).to_numpy()
                found = list(tool.found(cells_of(batch.column(width), size, k), mult)) if any(mode.paid) else []
                win = np.zeros(n, np.int64)
                for f in found:
                    np.add.at(win, f.row, f.win)
                out = [*batch.columns[:width], pa.array(win)]
                if details:
                    out.append(found_details(found, n) if found else pa.array([[]] * n, pa.list_(ARROW_DETAIL)))
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = boards.select("*", F.col(board).cast("array<smallint>").alias("__cells"), (F.lit(1) if bet_mult is None else bet_mult).cast("long").alias("__mult"))
    kinds = {"win": F.lit(0).cast("long")} | ({"details": F.lit(None).cast(f"array<{DETAIL}>")} if details else {})
    return rows.mapInArrow(run, boards.withColumns(kinds).schema)


def scatters(mode: Mode, board: Column) -> Column:
    """Positions of scatter symbols."""
    own = [i for i, x in enumerate(mode.scatter) if x]
    return F.array_remove(F.array(*(F.when(F.get(board, F.lit(i)).isin(own), F.lit(i)).otherwise(F.lit(-1)) for i in range(mode.columns * mode.rows))), -1)


# transforms: 0 is the empty cell


def clear(board: Column, hits: Column, size: int | None = None) -> Column:
    """The board with hit cells emptied; places outside it are ignored.  With the board's size the plan needs no lambda."""
    hits, none = hits.cast("array<int>"), F.lit(0).cast("short")
    if size is None:
        return F.transform(board, lambda x, i: F.when(F.array_contains(hits, i), none).otherwise(x.cast("short")))
    return F.array(*(F.when(F.array_contains(hits, F.lit(i)), none).otherwise(F.get(board, F.lit(i)).cast("short")) for i in range(size)))


def _column(board: Column, c: int, columns: int, rows: int) -> list[Column]:
    return [F.get(board, F.lit(r * columns + c)).cast("short") for r in range(rows)]


def _full(cells: Sequence[Column]) -> Column:
    """How many cells are not empty."""
    return _sum([F.lit(0), *((x != 0).cast("int") for x in cells)]) if cells else F.lit(0)


def _fallen(cells: list[Column]) -> list[Column]:
    """A column's cells after they fell: a cell takes the lowest symbol that lies at or above it and isn't taken by a lower cell.

    The symbols, from the top, are pushed into longs of four 16-bit places, of which the last one pushed is the lowest.
    """
    rows = len(cells)
    if rows > 4:
        # a symbol falls as far as there are empty cells below it
        below = [len(cells[i + 1 :]) - _full(cells[i + 1 :]) for i in range(rows)]
        return [F.coalesce(*(F.when((cells[i] != 0) & (below[i] == r - i), cells[i]) for i in range(r + 1)), F.lit(0).cast("short")) for r in range(rows)]
    pushed = F.lit(0).cast("long")
    for x in cells:
        pushed = F.when(x != 0, F.shiftleft(pushed, 16).bitwiseOR(x.cast("long").bitwiseAND(0xFFFF))).otherwise(pushed)
    return [F.shiftright(pushed, 16 * (rows - 1 - r)).bitwiseAND(0xFFFF).cast("short") for r in range(rows)]


def _board(parts: Sequence[Sequence[Column]]) -> Column:
    return F.array(*(parts[c][r] for r in range(len(parts[0])) for c in range(len(parts))))


def gravity(board: Column, columns: int, rows: int) -> Column:
    """Symbols of each column dropped to the bottom in their order, empty cells on top."""
    return _board([_fallen(_column(board, c, columns, rows)) for c in range(columns)])


def fill_index(board: Column, columns: int, rows: int) -> Column:
    """For each column the place of its lowest empty cell above the fallen symbols; negative where it is full."""
    return F.array(*((rows - _full(_column(board, c, columns, rows)) - 1) * columns + c for c in range(columns)))


def fill(board: Column, strips: list[list[int]], positions: Column, columns: int, rows: int) -> Column:
    """struct(board, positions): empty cells filled from the bottom; a reel steps back one symbol before each, and wraps."""
    parts, left = [], []
    for c in range(columns):
        cells, n = _column(board, c, columns, rows), len(strips[c])
        at = F.pmod(F.get(positions, F.lit(c)).cast("int"), F.lit(n))
        # the k-th hole from the bottom takes the symbol k back; the strip is unrolled, so that no step back wraps
        strip = _table([strips[c][(i - rows) % n] for i in range(n + rows)], "short")
        parts.append([F.when(x == 0, F.get(strip, at + _full(cells[r:]) + r)).otherwise(x) for r, x in enumerate(cells)])
        left.append(F.pmod(at + _full(cells) - rows, F.lit(n)))
    return F.struct(_board(parts).alias("board"), F.array(*left).alias("positions"))


def fall(boards: np.ndarray, columns: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(boards (n, rows, columns) whose symbols fell in each column, empty cells of each column)."""
    grid = boards.reshape(-1, rows, columns)
    out = np.zeros_like(grid)
    flat = out.reshape(-1)
    # each cell goes to the lowest place that is free; where it is empty, the next one above takes the same place
    place = (np.arange(len(grid))[:, None] * rows + rows - 1) * columns + np.arange(columns)
    lowest = place.copy()
    for r in range(rows - 1, -1, -1):
        flat[place] = grid[:, r]
        if r:
            place -= (grid[:, r] != 0) * columns
    return out, rows - (lowest - place) // columns - (grid[:, 0] != 0)


def refill(grid: np.ndarray, strips: Sequence[Sequence[int]], positions: np.ndarray) -> np.ndarray:
    """Fill the empty cells of boards (n, rows, columns) in place, from the bottom; the positions that the reels have stepped back to."""
    rows = grid.shape[1]
    size = np.array([len(s) for s in strips])
    # strips are unrolled by a board's height, so that no step back wraps
    table = np.concatenate([np.resize(np.roll(np.asarray(s, grid.dtype), rows), len(s) + rows) for s in strips])
    at = positions % size + rows + np.concatenate([[0], np.cumsum(size + rows)[:-1]])
    back = at.copy()
    for r in range(rows - 1, -1, -1):
        hole = grid[:, r] == 0
        back -= hole
        grid[:, r] = np.where(hole, table.take(back), grid[:, r])
    return (positions - (at - back)) % size


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype=np.int32)), pa.array(flat.ravel(), kind))


def _batched(boards: DataFrame, columns: dict[str, str], inputs: Sequence[Column], work) -> DataFrame:
    """``boards`` with further ``columns`` (name to type), which ``work`` makes of the arrays in ``inputs``, a batch at a time."""
    width, names = len(boards.columns), [*boards.columns, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *work(*batch.columns[width:])], names=names)

    rows = boards.select("*", *(c.alias(f"__{i}") for i, c in enumerate(inputs)))
    return rows.mapInArrow(run, boards.withColumns({k: F.lit(None).cast(t) for k, t in columns.items()}).schema)


def drop_boards(boards: DataFrame, columns: int, rows: int, board: str = "board") -> DataFrame:
    """``boards`` with ``fallen`` and ``fill``: :func:`gravity` and :func:`fill_index`, a batch at a time.  Missing cells are empty."""

    def work(column: pa.Array) -> list[pa.Array]:
        grid, empty = fall(cells_of(column, columns * rows, 1 << 15, 0), columns, rows)
        return [_lists(grid, pa.int16()), _lists((empty - 1) * columns + np.arange(columns), pa.int32())]

    return _batched(boards, {"fallen": "array<smallint>", "fill": "array<int>"}, [F.col(board).cast("array<smallint>")], work)


def fill_boards(boards: DataFrame, strips: Sequence[Sequence[int]], columns: int, rows: int, board: str = "board", positions: str = "positions") -> DataFrame:
    """``boards`` with ``filled`` and ``left``: :func:`fill`, a batch at a time.  Missing cells are empty; missing positions are 0."""

    def work(column: pa.Array, at: pa.Array) -> list[pa.Array]:
        grid = cells_of(column, columns * rows, 1 << 15, 0).reshape(-1, rows, columns)
        left = refill(grid, strips, cells_of(at, columns, 1 << 31, 0).astype(np.int64))
        return [_lists(grid, pa.int16()), _lists(left, pa.int32())]

    return _batched(boards, {"filled": "array<smallint>", "left": "array<int>"}, [F.col(board).cast("array<smallint>"), F.col(positions).cast("array<int>")], work)


def window_of_reels(strips: list[list[int]], starts: Column, rows: int) -> Column:
    """The board that reels show from their start positions."""
    tables = [_table(s, "short") for s in strips]
    return F.array(*(F.get(tables[c], F.pmod(F.get(starts, F.lit(c)) + r, F.lit(len(strips[c]))).cast("int")) for r in range(rows) for c in range(len(strips))))
