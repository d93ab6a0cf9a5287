"""Game configurations: parsing, validation and the catalogue.

A configuration is YAML or JSON text that becomes frozen dataclasses.  Settings are read leniently (unknown keys are ignored),
the free-form ``fixed`` part strictly (:func:`decode_fixed`).
"""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any, TypeVar

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError

T = TypeVar("T")


class ConfigError(EngineError):
    """A configuration that breaks a rule."""


# Symbol families by first letter, and their type numbers.
SYMBOL_TYPES = {"Z": 0, "S": 1, "C": 2, "W": 3, "H": 4, "L": 5}
SYMBOL_TYPE_NAMES = ("none", "special", "scatter", "wild", "high", "low")
# Bet types and reel generators.
BET_TYPES = ("line_ltr", "line_rtl", "line_both", "way_ltr", "way_rtl", "way_both", "count", "cluster")
REEL_TYPES = ("GenReelByReelIdx", "GenReelBySymbolWeight")
LUT_LIMIT = 10_000_000


def parse_bet_type(text: str) -> str | None:
    """The bet type that a text names; null if it names none."""
    return text if text in BET_TYPES else None


def bet_kind(bet_type: str) -> str:
    """line, way, count or cluster."""
    return bet_type.partition("_")[0]


def is_line(bet_type: str) -> bool:
    return bet_kind(bet_type) == "line"


def is_way(bet_type: str) -> bool:
    return bet_kind(bet_type) == "way"


def is_count(bet_type: str) -> bool:
    return bet_type == "count"


def is_cluster(bet_type: str) -> bool:
    return bet_type == "cluster"


def reads_right(bet_type: str) -> bool:
    """Whether hits may run from left to right."""
    return bet_type.endswith(("_ltr", "_both"))


def reads_left(bet_type: str) -> bool:
    return bet_type.endswith(("_rtl", "_both"))


def symbol_type(name: str) -> int:
    """Type number of a symbol name; names outside the six families of nine are ``none``."""
    return SYMBOL_TYPES[name[0]] if re.fullmatch("[ZSCWHL][1-9]", name) else 0


@dataclasses.dataclass(frozen=True)
class Reel:
    symbols: tuple[int, ...]
    weights: tuple[int, ...]


@dataclasses.dataclass(frozen=True)
class ReelSet:
    weight: int
    reels: tuple[Reel, ...]


@dataclasses.dataclass(frozen=True)
class Mode:
    """One game mode: board, reels, symbols and scoring."""

    columns: int
    rows: int
    reel_type: str
    reel_sets: tuple[ReelSet, ...]
    symbols: tuple[str, ...]
    pay_table: tuple[tuple[int, ...], ...]
    bet_type: str
    lines: tuple[tuple[int, ...], ...] = ()
    mask: tuple[int, ...] = ()

    @property
    def wild(self) -> tuple[bool, ...]:
        return tuple(symbol_type(s) == 3 for s in self.symbols)

    @property
    def scatter(self) -> tuple[bool, ...]:
        return tuple(symbol_type(s) == 2 for s in self.symbols)

    @property
    def paid(self) -> tuple[bool, ...]:
        return tuple(any(p > 0 for p in row) for row in self.pay_table)

    @property
    def least_paid(self) -> int:
        """The shortest run that pays anything; 0 where nothing pays."""
        return min((i + 1 for row in self.pay_table for i, p in enumerate(row) if p > 0), default=0)


@dataclasses.dataclass(frozen=True)
class Game:
    game_id: int
    name: str
    logic_key: str
    bet_units: tuple[int, ...]
    max_win_limit: int
    modes: tuple[Mode, ...]
    fixed: Mapping[str, Any]
    optimal: Mapping[str, Any]


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _reel(x: Mapping[str, Any], count: int) -> Reel:
    symbols = tuple(map(int, x.get("symbols") or ()))
    weights = tuple(map(int, x.get("weights") or (1,) * len(symbols)))
    _need(bool(symbols), "a reel has no symbols")
    _need(len(weights) == len(symbols), "a reel needs one weight for each symbol")
    _need(all(0 <= s < count for s in symbols), "a reel holds an unknown symbol")
    _need(all(w >= 0 for w in weights) and 0 < sum(weights) <= LUT_LIMIT, "reel weights must be from 0 and sum to 1..10,000,000")
    return Reel(symbols, weights)


def _mode(x: Mapping[str, Any]) -> Mode:
    screen, gen, sym, hit = (x.get(k) or {} for k in ("screen_setting", "gen_screen_setting", "symbol_setting", "hit_setting"))
    columns, rows = int(screen.get("columns", 0)), int(screen.get("rows", 0))
    _need(columns > 0 and rows > 0, "a board needs columns and rows")
    mask = tuple(screen.get("mask") or ())
    _need(len(mask) in (0, columns * rows), "the mask must cover the board")
    symbols = tuple(map(str, sym.get("symbol_used") or ()))
    _need(bool(symbols) and all(re.fullmatch("[ZSCWHL][1-9]", s) for s in symbols), "symbols must be named by family and number")
    pay = tuple(tuple(map(int, r)) for r in sym.get("pay_table") or ())
    _need(len(pay) == len(symbols), "the pay table needs one row for each symbol")
    _need(len({len(r) for r in pay}) == 1, "pay rows must be of one length")
    bet_type = hit.get("bet_type")
    _need(bet_type in BET_TYPES, f"unknown bet type {bet_type!r}")
    lines = tuple(tuple(map(int, r)) for r in hit.get("line_table") or ())
    if is_line(bet_type):
        _need(bool(lines), "line games need a line table")
        _need(all(len(r) == columns and all(0 <= v < rows for v in r) for r in lines), "a line needs one row number for each column")
    if is_count(bet_type):
        _need(len(pay[0]) >= columns * rows, "count games need pay rows that cover the whole board")
    reel_type = gen.get("gen_reel_type")
    _need(reel_type in REEL_TYPES, f"unknown reel generator {reel_type!r}")
    sets = tuple(ReelSet(int(s.get("weight", 0)), tuple(_reel(r, len(symbols)) for r in s.get("reels") or ())) for s in gen.get("reel_set_group") or ())
    _need(bool(sets) and all(len(s.reels) == columns for s in sets), "each reel set needs one reel for each column")
    _need(all(s.weight >= 0 for s in sets) and 0 < sum(s.weight for s in sets) <= LUT_LIMIT, "reel set weights must be from 0 and sum to 1..10,000,000")
    return Mode(columns, rows, reel_type, sets, symbols, pay, bet_type, lines, mask)


def parse_game(raw: Mapping[str, Any]) -> Game:
    """A validated game from parsed YAML or JSON."""
    units = tuple(map(int, raw.get("bet_units") or ()))
    limit = int(raw.get("max_win_limit", 0))
    _need(bool(units) and all(1 <= u <= limit for u in units), "bet units must be from 1 to the win limit")
    optimal = dict(raw.get("optimal_setting") or {})
    if optimal.get("use_optimal"):
        gachas, banks = optimal.get("gachas") or [], optimal.get("seed_bank") or []
        _need(bool(gachas) and len(gachas) == len(banks) == len(units), "optimal files: one of each for each bet unit")
    modes = tuple(_mode(m) for m in raw.get("game_mode_settings") or ())
    _need(bool(modes), "a game needs at least one mode")
    name = str(raw.get("game_name", "")).strip().lower()
    _need(bool(name), "a game needs a name")
    return Game(int(raw["game_id"]), name, str(raw.get("logic_key", "")), units, limit, modes, dict(raw.get("fixed") or {}), optimal)


def from_yaml(text: str | bytes) -> Game:
    return parse_game(yaml.safe_load(text))


def from_json(text: str | bytes) -> Game:
    return parse_game(json.loads(text))


def decode_fixed(kind: type[T], fixed: Mapping[str, Any]) -> T:
    """The free-form part as a dataclass; unknown keys are refused."""
    known = {f.name for f in dataclasses.fields(kind)}  # type: ignore[arg-type]
    if extra := sorted(set(fixed) - known):
        raise ConfigError(f"unknown fixed keys: {', '.join(extra)}")
    return kind(**fixed)


def config_files(folders: Iterable[str | Path]) -> dict[str, Path]:
    """File name to path over flat folders, by name; hidden names, other suffixes, subfolders and repeats are refused."""
    found: dict[str, Path] = {}
    for folder in folders:
        for p in sorted(Path(folder).iterdir()):
            _need(p.is_file(), f"configuration folders are flat: {p.name}")
            _need(not p.name.startswith(".") and p.suffix in (".yaml", ".yml", ".json"), f"no configuration file: {p.name}")
            _need(p.name not in found, f"two files are named {p.name}")
            found[p.name] = p
    return found


def load(path: str | Path) -> Game:
    text = Path(path).read_text(encoding="utf-8")
    return from_json(text) if Path(path).suffix == ".json" else from_yaml(text)


class Catalog:
    """Games by id and by name, case-insensitively; frozen once complete."""

    def __init__(self, logics: Iterable[str]) -> None:
        self._logics, self._by_id, self._by_name, self.frozen = set(logics), {}, {}, False

    def register(self, *games: Game) -> None:
        """Add all games or, if any breaks a rule, none."""
        _need(not self.frozen, "the catalogue is frozen")
        ids, names = dict(self._by_id), dict(self._by_name)
        for g in games:
            _need(g.logic_key in self._logics, f"no logic {g.logic_key!r}")
            _need(g.game_id not in ids, f"game id {g.game_id} is taken")
            _need(g.name not in names, f"game name {g.name!r} is taken")
            ids[g.game_id] = names[g.name] = g
        self._by_id, self._by_name = ids, names

    def freeze(self) -> None:
        self.frozen = True

    def get(self, key: int | str) -> Game:
        found = self._by_id.get(key) if isinstance(key, int) else self._by_name.get(key.strip().lower())
        _need(found is not None, f"no game {key!r}")
        return found

    def ids(self) -> list[int]:
        return sorted(self._by_id)

    def all(self) -> list[Game]:
        return [self._by_id[i] for i in self.ids()]

    def summary(self, spark: SparkSession) -> DataFrame:
        """(game_id, game_name, logic_key, bet_units, n_modes, bet_type), one row for each game."""
        rows = [(g.game_id, g.name, g.logic_key, list(g.bet_units), len(g.modes), g.modes[0].bet_type) for g in self.all()]
        return spark.createDataFrame(rows, "game_id long, game_name string, logic_key string, bet_units array<int>, n_modes int, bet_type string")


def symbols_frame(spark: SparkSession, game: Game) -> DataFrame:
    """(mode_id, idx, name, type, type_name, pays) of every symbol of every mode."""
    rows = [(m, i, s, symbol_type(s), SYMBOL_TYPE_NAMES[symbol_type(s)], list(mode.pay_table[i])) for m, mode in enumerate(game.modes) for i, s in enumerate(mode.symbols)]
    return spark.createDataFrame(rows, "mode_id int, idx int, name string, type int, type_name string, pays array<int>")
