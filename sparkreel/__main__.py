"""Command line: simulate a game, study players, replay spins, tune a seed bank, serve, or list games."""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from .functions import render
from .operators import tuner
from .plans import demo, http
from .plans.engine import MOST_PLAYER_ROUNDS, MOST_PLAYERS, Engine, _rows


def _arguments(args: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sparkreel")
    parser.add_argument("what", choices=["run", "players", "replay", "tune", "serve", "games"])
    parser.add_argument("--config", action="append", default=[], help="a folder of configurations; the demonstration games without it")
    parser.add_argument("--game", default="0", help="id or name")
    parser.add_argument("--rounds", type=int, default=1_000_000, help="rounds; of each player, where players are studied")
    parser.add_argument("--players", type=int, default=1000)
    parser.add_argument("--init-bets", type=int, default=200)
    parser.add_argument("--bet-mode", type=int, default=0)
    parser.add_argument("--seed", type=int, default=1)
    parser.add_argument("--snapshot", default="", help="where a replay begins")
    parser.add_argument("--settings", help="the tuner's settings, a YAML file")
    parser.add_argument("--bank", help="a folder with a seed bank: written by tune, played by run")
    parser.add_argument("--port", type=int, default=5808)
    parser.add_argument("--production", action="store_true", help="serve spins and health alone")
    parser.add_argument("--format", choices=sorted(render.RENDERERS), default="text")
    parser.add_argument("--out", help="a file for the report as well")
    a = parser.parse_args(args)
    if a.rounds < 1 or a.players < 1 or a.init_bets < 1:
        parser.error("rounds, players and bets must be positive")
    if a.what == "tune" and not (a.settings and a.bank):
        parser.error("tune needs --settings and --bank")
    if a.what == "players":
        a.players, a.rounds = min(a.players, MOST_PLAYERS), min(a.rounds, MOST_PLAYER_ROUNDS)
    return a


def main(args: list[str] | None = None) -> None:
    a = _arguments(args)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark, a.config, games=[] if a.config else [demo.line_game(), demo.cascade_game()])
    key = int(a.game) if a.game.isdigit() else a.game
    if a.what == "games":
        print(render.table([(str(g.game_id), g.name, g.modes[0].bet_type) for g in engine.catalog.all()]))
        return
    if a.what == "serve":
        http.server(engine, a.port, production=a.production).serve_forever()
        return
    game, began = engine.game(key), time.perf_counter()
    if a.what == "tune":
        bank = engine.tune(key, yaml.safe_load(Path(a.settings).read_text()), a.rounds, a.seed)
        tuner.save(bank, game.game_id, a.bank, {"rounds": a.rounds, "seed": a.seed})
        print(f"{len(bank.prob)} seeds of {game.name} in {a.bank}")
        return
    if a.what == "replay":
        out = engine.replay(key, a.rounds, a.snapshot, a.seed)
        report = out | {"results": _rows(out["results"].orderBy("spin_id"))}
        text = json.dumps(report) if a.format == "json" else render.to_yaml(report) if a.format == "yaml" else render.table([(k, str(v)) for k, v in report.items() if k != "results"])
    elif a.what == "players":
        rows = engine.simulate_players(key, a.players, a.rounds, a.init_bets, a.seed, a.bet_mode).persist()
        text = render.render(a.format, {k: _rows(v) for k, v in engine.player_study(rows, a.init_bets).items()}, game.name)
        rows.unpersist()
    else:
        bank = tuner.load_bank(game.game_id, a.bank) if a.bank else None
        found = engine.simulate_report(key, a.rounds, a.seed, a.bet_mode, bank=bank)
        text = render.render(a.format, {"summary": found["summary"].first().asDict(), "buckets": _rows(found["buckets"].orderBy("bucket"))}, game.name)
    if a.out:
        Path(a.out).write_text(text)
    print(text)
    print(f"{a.rounds} rounds in {render.duration(time.perf_counter() - began)}")


if __name__ == "__main__":
    main()
