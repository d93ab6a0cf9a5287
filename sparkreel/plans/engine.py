"""The engine: a catalogue of games, their logics, and what can be run on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Level
from ..operators import estimator, report, sessions, tags, tuner
from ..sources import ledger as ledgers
from ..sources import simulate as sims
from ..sources import record, wire
from ..sources.config import Catalog, ConfigError, Game, config_files, from_json, from_yaml, load

#: Most rounds, players, rounds of a player, replayed rounds and characters of a configuration in one service request.
MOST_ROUNDS, MOST_PLAYERS, MOST_PLAYER_ROUNDS, MOST_REPLAYED, MOST_CONFIG = 1_000_000, 100_000, 15_000, 5_000, 5 << 20


class ServiceError(ConfigError):
    """A call that breaks a service's rules: the caller's fault."""

    default = Level.WARN


def merge_logics(*parts: Mapping[str, sims.Logic]) -> dict[str, sims.Logic]:
    """One registry of several; a key in two of them is an error."""
    out: dict[str, sims.Logic] = {}
    for part in parts:
        if both := sorted(set(out) & set(part)):
            raise ConfigError(f"logic keys are taken: {', '.join(both)}")
        out |= part
    return out


class Engine:
    """``Engine(spark, folders)`` loads every configuration of the folders and freezes the catalogue."""

    def __init__(self, spark: SparkSession, folders: Iterable[str | Path] = (), logics: Mapping[str, sims.Logic] | None = None, games: Iterable[Game] = ()) -> None:
        self.spark = spark
        self.logics = merge_logics(sims.LOGICS, logics or {})
        self.catalog = Catalog(self.logics)
        self.catalog.register(*(load(p) for p in config_files(folders).values()), *games)
        self.catalog.freeze()

    def game(self, key: int | str | Game) -> Game:
        return key if isinstance(key, Game) else self.catalog.get(key)

    def simulate(self, key: int | str | Game, rounds: int, seed: int = 1, bet_mode: int = 0, bet_mult: int = 1, partitions: int | None = None, first_spin: int = 0, bank: tuner.SeedBank | None = None, prng: str = "splitmix") -> DataFrame:
        """A ledger of simulated rounds; ``first_spin`` replays a range, a ``bank`` weights what is played."""
        game = self.game(key)
        if rounds < 0 or not 0 <= bet_mode < len(game.bet_units) or bet_mult < 1:
            raise ConfigError("rounds from 0, a known bet mode and a multiplier from 1 are needed")
        return sims.simulate(self.spark, game, rounds, seed, bet_mode, bet_mult, partitions, self.logics[game.logic_key], first_spin, bank, prng)

    def simulate_report(self, key: int | str | Game, rounds: int, seed: int = 1, bet_mode: int = 0, bet_mult: int = 1, partitions: int | None = None, first_spin: int = 0, bank: tuner.SeedBank | None = None) -> dict[str, DataFrame]:
        """``summary`` and ``buckets`` of a simulation whose rounds are added up in the tasks that play them."""
        game = self.game(key)
        if rounds < 0 or not 0 <= bet_mode < len(game.bet_units) or bet_mult < 1:
            raise ConfigError("rounds from 0, a known bet mode and a multiplier from 1 are needed")
        parts = sims.simulated_parts(self.spark, game, rounds, seed, bet_mode, bet_mult, partitions, self.logics[game.logic_key], first_spin, bank)
        return {"summary": report.finalise(parts), "buckets": report.finalise_buckets(parts)}

    def simulate_players(self, key: int | str | Game, players: int, rounds: int, init_bets: int, seed: int = 1, bet_mode: int = 0) -> DataFrame:
        game = self.game(key)
        if players < 0 or rounds < 0 or init_bets < 0:
            raise ConfigError("players, rounds and bets from 0 are needed")
        return sims.simulate_players(self.spark, game, players, rounds, init_bets, seed, bet_mode, logic=self.logics[game.logic_key])

    def simulate_config(self, text: str, rounds: int, kind: str = "yaml", seed: int = 1) -> DataFrame:
        """Simulate a configuration that isn't in the catalogue; its id, name and logic must match the entry that is, if there is one."""
        game = from_yaml(text) if kind == "yaml" else from_json(text)
        if game.game_id in self.catalog.ids():
            have = self.catalog.get(game.game_id)
            if (have.name, have.logic_key) != (game.name, game.logic_key):
                raise ConfigError("the configuration contradicts the catalogue")
        return self.simulate(game, rounds, seed)

    def results(self, key: int | str | Game, rounds: int, seed: int = 1, bet_mult: int = 1, first_spin: int = 0, partitions: int | None = None) -> DataFrame:
        """(spin_id, gamemodes): the whole results of simulated rounds, or of a range of them played again; see ``wire.flatten_acts``."""
        game = self.game(key)
        if rounds < 0 or bet_mult < 1:
            raise ConfigError("rounds from 0 and a multiplier from 1 are needed")
        return sims.results(self.spark, game, rounds, seed, bet_mult, partitions, self.logics[game.logic_key], first_spin)

    def spin(self, requests: DataFrame, seed: int = 1, full: bool = False, banks: Mapping[int, tuner.SeedBank] | None = None) -> DataFrame:
        """Requests (request_id, gid, game, bet, bet_mode, bet_mult) answered with error or win: the request id is the spin id.

        Requests may have a ``start_state`` (start_b64u, cp), whose snapshot is played again, and choice with has_choice.  Spins of games in
        ``banks`` that begin anew are picked by the bank's weights.  With ``full`` a ``result`` holds what the wire sends: game, bet, the
        snapshots before and after, and all modes with their acts, screens and details; it is null where there is an error.
        """
        parts = []
        have = set(requests.columns)
        start = F.when(F.length("start_state.start_b64u") > 0, F.col("start_state.start_b64u")) if "start_state" in have else F.lit(None).cast("string")
        chosen = (F.coalesce("choice", F.lit(0)) != 0) & ~F.coalesce("has_choice", F.lit(False)) if {"choice", "has_choice"} <= have else F.lit(False)
        for game in self.catalog.all():
            own = requests.where(F.col("gid") == game.game_id)
            bad = wire.spin_errors(F.col("gid"), F.col("game"), F.col("bet"), F.col("bet_mode"), F.col("bet_mult"), game.game_id, game.name, game.bet_units)
            error = F.coalesce(bad, F.when(chosen, F.lit("a choice without has_choice")))
            slim = own.select(F.col("request_id").cast("long").alias("request_id"), F.col("gid").cast("long").alias("gid"), F.coalesce("bet_mult", F.lit(1)).cast("long").alias("bet_mult"), error.alias("error"), start.alias("start"))
            if full:
                found = sims.answers(slim, game, self.logics[game.logic_key], seed, (banks or {}).get(game.game_id))
                asked = own.select(F.col("request_id").cast("long").alias("request_id"), F.col("bet").cast("long").alias("bet"), F.col("bet_mode").cast("int").alias("betmode"), F.coalesce("bet_mult", F.lit(1)).cast("int").alias("betmult"))
                found = found.join(asked, "request_id")
                result = F.struct(F.lit(game.name).alias("game"), F.col("gid").alias("gameid"), "win", "bet", "betmode", "betmult", F.lit(True).alias("isend"), "spin_state", "gamemodes")
                parts.append(found.select("request_id", "gid", "win", "base_win", "trigger", "error", F.when(F.col("error").isNull(), result).alias("result")))
            else:
                parts.append(sims.wins(slim, game, self.logics[game.logic_key], seed, (banks or {}).get(game.game_id)))
        known = requests.where(~F.coalesce(F.col("gid").isin(self.catalog.ids()), F.lit(False)))
        lost = known.select("request_id", "gid", F.lit(None).cast("long").alias("win"), F.lit(None).cast("long").alias("base_win"), F.lit(None).cast("int").alias("trigger"), F.lit("no such game").alias("error"))
        parts.append(lost.withColumn("result", F.lit(None).cast(f"struct<{wire.RESULT_FIELDS}>")) if full else lost)
        return reduce(DataFrame.unionByName, parts)

    def stat(self, rows: DataFrame) -> DataFrame:
        return report.summary(rows)

    def posted_stat(self, posted: Mapping[str, Any]) -> DataFrame:
        return report.summary(ledgers.from_arrays(self.spark, posted))

    def player_study(self, rows: DataFrame, init_bets: int) -> dict[str, DataFrame]:
        """What players of a ledger experience; rounds after a player's end don't count."""
        played = sessions.running(rows, init_bets)
        return {
            "quantiles": estimator.rtp_quantiles(played),
            "cdf": estimator.rtp_cdf(played),
            "triggers": estimator.event_counts(played),
            "buckets": estimator.bucket_counts(played),
            "sessions": estimator.session_shares(rows, init_bets),
        }

    def tune(self, key: int | str | Game, settings: Mapping[str, Any], spins: int, seed: int = 1) -> tuner.SeedBank:
        """A seed bank from ``spins`` simulated spins: collect each class's quota, shape its weights, screen for the deviation."""
        target, classes = tuner.parse_settings(settings)
        tagger = tags.Tagger([t for c in classes for t in c.tags])
        unit = self.game(key).bet_units[0]
        rows = self.simulate(key, spins, seed).select("spin_id", (F.col("total_win") / unit).alias("win"), tagger.bits().alias("bits"))
        strata = [(c.name, tags.covers(F.col("bits"), tagger.mask(c.tags)) & F.col("win").between(c.min_win, c.max_win), c.collect) for c in classes]
        got = tags.collect_strata(rows, strata, "spin_id").orderBy("spin_id").collect()  # the quotas bound it
        parts = []
        for c in classes:
            own = [r for r in got if r["cname"] == c.name]
            if len(own) < c.collect:
                raise tuner.TunerError(f"class {c.name}: {len(own)} of {c.collect} samples in {spins} spins")
            parts.append((c, np.array([r["win"] for r in own]), [int(r["spin_id"]).to_bytes(8, "little") for r in own]))
        return tuner.tune(parts, target, seed)[0]

    def replay(self, key: int | str | Game, rounds: int, snapshot: str = "", seed: int = 1) -> dict[str, Any]:
        """Spins one after another with their whole results, from the start of ``seed`` or from a snapshot: before, after, bet, total_win,
        base_win, free_win and ``results``, a frame of (spin_id, gamemodes)."""
        game = self.game(key)
        if not 1 <= rounds <= MOST_REPLAYED:
            raise ServiceError(f"rounds from 1 to {MOST_REPLAYED}")
        start = (seed, 0)
        if snapshot and (start := record.restore(snapshot)) is None:
            raise ServiceError("the snapshot can't be read")
        found = self.results(game, rounds, start[0], first_spin=start[1])
        sums = self.simulate(game, rounds, start[0], first_spin=start[1]).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bet", "total_win", "base_win"))).first().asDict()
        return {"before": record.snapshot(*start), "after": record.snapshot(start[0], start[1] + rounds), **sums, "free_win": sums["total_win"] - sums["base_win"], "results": found}

    def service(self, name: str, **args: Any) -> list[dict[str, Any]]:
        """The service's routes as calls with their limits: ``spin``, ``sim``, ``simplayer``, ``simbycfg``, ``stat``, ``replay``, ``games`` and
        ``health``.  What the caller did wrong is a :class:`ServiceError`."""
        if name not in _ROUTES:
            raise ServiceError(f"no service {name!r}")
        try:
            return _ROUTES[name](self, args)
        except KeyError as e:
            raise ServiceError(f"{e.args[0]} is required") from e
        except ServiceError:
            raise
        except ConfigError as e:  # of a game or a configuration that the caller names
            raise ServiceError(str(e)) from e


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """Rows of a report, as nested dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _within(name: str, value: int, least: int, most: int) -> int:
    if not least <= value <= most:
        raise ServiceError(f"{name} from {least} to {most}")
    return value


def _spin(engine: Engine, args: Mapping[str, Any]) -> list[dict[str, Any]]:
    """One request, decoded from a JSON ``body`` or a ``query`` string, answered with the whole result."""
    raw = wire.decode_request(args.get("body"), args.get("query"))
    game = engine.catalog.get(raw["gid"]) if raw.get("gid") in engine.catalog.ids() else None
    wire.parse_request(raw, game.logic_key if game else "")
    spins = int(args.get("spin_id", 0))
    state = raw.get("start_state") or {}
    row = (spins, raw.get("gid"), raw.get("game"), raw.get("bet"), raw.get("bet_mode", 0), raw.get("bet_mult", 1), (state.get("start_b64u"), state.get("cp")), raw.get("choice", 0), raw.get("has_choice", False))
    schema = "request_id long, gid long, game string, bet long, bet_mode int, bet_mult int, start_state struct<start_b64u:string,cp:string>, choice int, has_choice boolean"
    (out,) = _rows(engine.spin(engine.spark.createDataFrame([row], schema), args.get("seed", 1), full=True))
    if out["error"]:
        raise ServiceError(out["error"])
    return [out["result"]]


def _sim(engine: Engine, args: Mapping[str, Any]) -> list[dict[str, Any]]:
    rounds = _within("rounds", args["rounds"], 1, MOST_ROUNDS)
    return _rows(engine.simulate_report(args["game"], rounds, args.get("seed", 1), args.get("bet_mode", 0))["summary"])


def _sim_by_config(engine: Engine, args: Mapping[str, Any]) -> list[dict[str, Any]]:
    if len(args["config"]) > MOST_CONFIG:
        raise ServiceError(f"configurations of at most {MOST_CONFIG} characters")
    rounds = _within("rounds", args["rounds"], 1, MOST_ROUNDS)
    return _rows(engine.stat(engine.simulate_config(args["config"], rounds, args.get("kind", "json"), args.get("seed", 1))))


def _sim_players(engine: Engine, args: Mapping[str, Any]) -> list[dict[str, Any]]:
    players, rounds = _within("players", args["players"], 1, MOST_PLAYERS), _within("rounds", args["rounds"], 1, MOST_PLAYER_ROUNDS)
    bets = _within("init_bets", args["init_bets"], 1, 1 << 31)
    rows = engine.simulate_players(args["game"], players, rounds, bets, args.get("seed", 1), args.get("bet_mode", 0)).persist()
    try:
        study = {k: _rows(v) for k, v in engine.player_study(rows, bets).items()} if args.get("study") else {}
        return [r | ({"study": study} if study else {}) for r in _rows(engine.stat(rows))]
    finally:
        rows.unpersist()


def _replay(engine: Engine, args: Mapping[str, Any]) -> list[dict[str, Any]]:
    out = engine.replay(args["game"], args["rounds"], args.get("snapshot", ""), args.get("seed", 1))
    return [out | {"results": _rows(out["results"].orderBy("spin_id"))}]


_ROUTES: dict[str, Callable[[Engine, Mapping[str, Any]], list[dict[str, Any]]]] = {
    "spin": _spin,
    "sim": _sim,
    "simplayer": _sim_players,
    "simbycfg": _sim_by_config,
    "replay": _replay,
    "stat": lambda engine, args: _rows(engine.posted_stat(args["ledger"])),
    "games": lambda engine, args: _rows(engine.catalog.summary(engine.spark)),
    "health": lambda engine, args: [{"ok": True, "games": len(engine.catalog.ids())}],
}
