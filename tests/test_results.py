"""Full results of spins: acts, screens and details, requests and snapshots, and the buffer's events."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreel import errors
from sparkreel.__main__ import main as command_line
from sparkreel.functions import codec, render, rng
from sparkreel.operators import tags
from sparkreel.plans import demo
from sparkreel.plans.engine import Engine
from sparkreel.sources import config, record, wire
from sparkreel.sources import simulate as sims

REQUEST = "request_id long, gid long, game string, bet long, bet_mode int, bet_mult int, start_state struct<start_b64u:string,cp:string>, choice int, has_choice boolean"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, games=[demo.line_game(), demo.cascade_game()])


@pytest.mark.parametrize("gid,n", [(0, 3000), (1, 400)])
def test_results_agree_with_the_ledger_and_nest_by_the_rules(engine, gid, n):
    plain = {r.spin_id: r for r in engine.simulate(gid, n).collect()}
    size = engine.game(gid).modes[0].columns * engine.game(gid).modes[0].rows
    found = engine.results(gid, n, partitions=3).collect()
    assert sorted(r.spin_id for r in found) == list(range(n))
    for r in found:
        modes = r.gamemodes
        assert [m.modeid for m in modes] == list(range(1 + (plain[r.spin_id].trigger > 0)))
        assert modes[0].win == plain[r.spin_id].base_win and sum(m.win for m in modes) == plain[r.spin_id].total_win
        assert modes[0].trigger == plain[r.spin_id].trigger
        for m in modes:
            total = round_ = step = 0
            where = (0, 0, 0)
            for k, a in enumerate(m.acts):
                total, round_, step = total + a.actwin, round_ + a.actwin, step + a.actwin
                assert (a.id, a.round, a.step, a.act) == (k, *where)
                assert (a.nowtotalwin, a.roundaccwin, a.stepaccwin) == (total, round_, step)
                assert a.screen is None or len(a.screen) == size
                if a.acttype == "win":
                    assert a.actwin == sum(d.win for d in a.details) > 0 and all(d.hits for d in a.details)
                if a.is_round_end:
                    assert a.is_step_end
                    where, round_, step = (a.round + 1, 0, 0), 0, 0
                elif a.is_step_end:
                    where, step = (a.round, a.step + 1, 0), 0
                else:
                    where = (a.round, a.step, a.act + 1)
            assert m.win == total and m.acts[-1].is_round_end
            assert sum(a.is_round_end for a in m.acts) == (1 if m.modeid == 0 else 10)
        trigger = [a for a in modes[0].acts if a.acttype == "trigger"]
        assert len(trigger) == (plain[r.spin_id].trigger > 0)
        if trigger:
            ext = json.loads(trigger[0].ext)
            assert ext["is_trigger"] and ext["scatters"] == len(ext["scatter_hits"]) >= 3


def test_cascade_screens_follow_from_each_other(engine):
    for r in engine.results(1, 200).collect():
        for m in r.gamemodes:
            screen, hits = None, set()
            for a in m.acts:
                if a.acttype == "win":
                    hits = {h for d in a.details for h in d.hits}
                elif a.acttype == "clear":
                    assert a.screen == [0 if i in hits else x for i, x in enumerate(screen)]
                elif a.acttype == "gravity":
                    assert all([x for x in a.screen[c::5] if x] == [x for x in screen[c::5] if x] and 0 not in [x for x in a.screen[c::5]][sum(x == 0 for x in screen[c::5]) :] for c in range(5))
                elif a.acttype == "fillscreen":
                    assert 0 not in a.screen and all(x in (0, y) for x, y in zip(screen, a.screen, strict=True))
                screen = a.screen or screen


def test_spin_restores_snapshots(spark, engine):
    rows = [(5, 0, "demo_normal", 40, 0, 1, None, 0, None), (6, 1, "demo_cascade", 60, 0, 2, ("", None), None, None), (7, 0, "demo_normal", 40, 0, 1, None, 1, False), (8, 0, "demo_normal", 40, 0, 1, ("!", None), 0, None), (9, 3, "x", 1, 0, 1, None, 0, None), (10, None, "x", 1, 0, 1, None, 0, None)]
    first = {r.request_id: r for r in engine.spin(spark.createDataFrame(rows, REQUEST), full=True).collect()}
    assert {k: r.error is None for k, r in first.items()} == {5: True, 6: True, 7: False, 8: False, 9: False, 10: False}
    assert all((r.result is None) == (r.error is not None) == (r.win is None) for r in first.values())
    slim = {r.request_id: r for r in engine.spin(spark.createDataFrame(rows, REQUEST)).collect()}
    assert all((r.win, r.base_win, r.trigger, r.error) == (slim[k].win, slim[k].base_win, slim[k].trigger, slim[k].error) for k, r in first.items())
    state = first[5].result.spin_state
    assert first[5].win == engine.simulate(0, 1, first_spin=5).first().total_win and first[6].win == 2 * engine.simulate(1, 1, first_spin=6).first().total_win
    again = [(100, 0, "demo_normal", 40, 0, 1, (state.start_b64u, None), 0, None), (101, 0, "demo_normal", 40, 0, 1, (state.after_b64u, None), 0, None)]
    back = {r.request_id: r for r in engine.spin(spark.createDataFrame(again, REQUEST), seed=77, full=True).collect()}
    assert back[100].result.gamemodes == first[5].result.gamemodes and back[100].result.spin_state == state
    assert back[101].win == engine.simulate(0, 1, first_spin=6).first().total_win
    assert [f.split(":")[0] for f in wire.RESULT_FIELDS.split(",")][0] == "game" and record.restore(state.start_b64u) == (1, 5)


def test_logics_without_a_record_and_renderers(spark):
    def logic(game):
        return lambda state, mult: (np.full(len(state), 3 * mult), np.full(len(state), 5 * mult), np.arange(len(state)) % 2)

    raw = demo.line_game()
    acts, triggers = sims.record(logic(raw), rng.streams(1, np.arange(4)), 2)
    got = record.assemble(acts, 4, triggers).to_pylist()
    assert [[(m["win"], m["trigger"], m["acts"][0]["acttype"]) for m in x] for x in got] == [[(6, 0, "base")], [(6, 1, "base"), (4, 0, "free")]] * 2
    assert record.assemble([], 2, {}).to_pylist() == [[], []]
    part = record.Acts("x", np.array([0]), 0, 0, 0, ext=[{"a": 1}])
    assert record.assemble([part], 1, {}, "demo").to_pylist()[0][0]["acts"][0]["ext"] == '{"a":1}'
    record.register_renderer("demo", lambda x: f"a is {x['a']}")
    try:
        assert record.assemble([part], 1, {}, "demo").to_pylist()[0][0]["acts"][0]["ext"] == "a is 1"
        with pytest.raises(ValueError):
            record.register_renderer("demo", str)
    finally:
        record.RENDERERS.clear()


def test_flattened_results(engine):
    rows = engine.results(1, 50)
    acts = wire.flatten_acts(rows)
    assert acts.agg(F.sum("actwin")).first()[0] == engine.simulate(1, 50).agg(F.sum("total_win")).first()[0]
    assert wire.flatten_details(rows).count() == acts.agg(F.sum("n_details")).first()[0]


# the buffer's events


EVENTS = "spin_id long, at int, kind string, win long, hits array<short>, acttype string, finish string, screen array<short>"


def ev(spin, at, kind, win=None, hits=None, acttype=None, finish=None, screen=None):
    return (spin, at, kind, win, hits, acttype, finish, screen)


def test_literal_event_sequences(spark):
    screen, d3, d2 = [1, 1, 1], [0, 1, 2], [0, 1]
    rows = [
        *(ev(1, 0, "detail", 10, d3), ev(1, 1, "act", acttype="base", finish="round", screen=screen)),
        *(ev(2, 0, "detail", 10, d3), ev(2, 1, "detail", 5, d2), ev(2, 2, "discard")),
        *(ev(3, 0, "detail", 20, [0, 1, 2, 3]),),
        *(ev(4, 0, "detail", 10, d3), ev(4, 1, "act", acttype="act1", finish="act", screen=screen), ev(4, 2, "detail", 5, d2), ev(4, 3, "act", acttype="act2", finish="step")),
        *(ev(5, 0, "detail", 10, d3), ev(5, 1, "act", acttype="a", finish="act"), ev(5, 2, "finish_step"), ev(5, 3, "finish_round")),
        *(ev(6, 0, "detail", 10, d3), ev(6, 1, "set_win", 20), ev(6, 2, "act", acttype="a", finish="act")),
        *(ev(7, 0, "detail", 10, d3), ev(7, 1, "act", acttype="a", finish="round"), ev(7, 2, "reset"), ev(7, 3, "detail", 1, d2), ev(7, 4, "set_win", 9), ev(7, 5, "discard"), ev(7, 6, "detail", 4, d2), ev(7, 7, "act", acttype="b")),
        *(ev(8, 0, "finish_step"), ev(8, 1, "act", acttype="a", screen=[1, 2]), ev(8, 2, "end"), ev(8, 3, "act"), ev(8, 4, "nope")),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    from sparkreel.operators import acts

    landed = {}
    for r in acts.land_acts(events, "spin_id", order="at").orderBy("spin_id", "at").collect():
        landed.setdefault(r.spin_id, []).append(r)
    one = landed[1][0]
    assert (one.actwin, one.is_round_end, len(one.details[0].hits), one.screen) == (10, True, 3, screen)
    assert 2 not in landed and 3 not in landed
    a, b = landed[4]
    assert not a.is_step_end and b.is_step_end and not b.is_round_end and (b.nowtotalwin, b.stepaccwin, a.act, b.act) == (15, 15, 0, 1)
    assert (landed[5][0].is_step_end, landed[5][0].is_round_end) == (True, True)
    assert landed[6][0].actwin == 20 and len(landed[6][0].details) == 1
    assert [(r.actwin, len(r.details), r.acttype, r.nowtotalwin) for r in landed[7]] == [(4, 1, "b", 4)]
    left = {r.spin_id: (r.win, len(r.hits), r.n_details) for r in acts.pending(events, "spin_id", order="at").collect()}
    assert {k: left[k] for k in (1, 2, 3, 4)} == {1: (0, 0, 0), 2: (0, 0, 0), 3: (20, 4, 1), 4: (0, 0, 0)}
    errors = {(r.spin_id, r["at"]): r.error for r in acts.event_errors(events, "spin_id", order="at", screen_size=3).collect()}
    assert errors == {(8, 0): "no act to finish", (8, 1): "the screen has another size", (8, 3): "the result has ended", (8, 4): "unknown kind"}
    shown = {r.spin_id: r.screen for r in acts.last_screen(acts.land_acts(events, "spin_id", order="at"), "spin_id", order="at").collect()}
    assert shown[1] == screen and shown[4] == screen and 6 not in shown


# services, errors, generators


def test_services(spark, engine):
    (one,) = engine.service("spin", query="gid=0&game=demo_normal&bet=40&bet_mode=0&bet_mult=1", spin_id=5)
    assert one["win"] == engine.simulate(0, 1, first_spin=5).first().total_win and one["gamemodes"][0]["acts"][0]["acttype"] == "screen"
    body = json.dumps({"gid": 0, "game": "demo_normal", "bet": 40, "bet_mult": 1, "start_state": {"start_b64u": one["spin_state"]["start_b64u"]}})
    assert engine.service("spin", body=body)[0] == one
    (back,) = engine.service("replay", game=0, rounds=3, snapshot=one["spin_state"]["start_b64u"])
    assert [r["spin_id"] for r in back["results"]] == [5, 6, 7] and back["total_win"] == back["base_win"] + back["free_win"]
    assert back["results"][0]["gamemodes"] == one["gamemodes"] and record.restore(back["after"]) == (1, 8)
    (study,) = engine.service("simplayer", game=0, players=4, rounds=6, init_bets=5, study=True)
    assert {r["name"] for r in study["study"]["sessions"]} == {"bust", "cashout", "alive"}
    assert "Trigger counts per player" in render.render("text", study["study"]) and render.render("json", study["study"])
    text = json.dumps({"game_id": 0, "game_name": "demo_normal", "logic_key": "demo_cascade"})
    for name, args in (("spin", {"query": "gid=0&game=x&bet=40"}), ("spin", {"body": "{"}), ("sim", {"game": 0}), ("sim", {"game": 0, "rounds": 0}), ("replay", {"game": 0, "rounds": 1, "snapshot": "!"}), ("replay", {"game": 0, "rounds": 9999}), ("simplayer", {"game": 0, "players": 1, "rounds": 1, "init_bets": 0}), ("nope", {})):
        with pytest.raises(errors.EngineError) as e:
            engine.service(name, **args)
        assert errors.status_code(e.value) == 400 and not errors.is_fatal(e.value)
    with pytest.raises(errors.EngineError):
        engine.service("simbycfg", config=text, rounds=5)


def test_http(engine):
    from sparkreel.plans import http

    server = http.server(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, None if body is None else json.dumps(body).encode())) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert ask("/v1/health") == (200, {"ok": True, "games": 2})
        status, one = ask("/v1/spin?gid=0&game=demo_normal&bet=40&bet_mult=1")
        assert status == 200 and one["gamemodes"] and ask("/v1/spin", {"gid": 0, "game": "demo_normal", "bet": 40, "bet_mult": 1}) == (200, one)
        assert ask("/v1/sim?gid=0&rounds=50")[1]["rounds"] == 50 and ask("/v1/sim", {"gid": 0, "rounds": 50})[1]["rounds"] == 50
        assert [ask(x)[0] for x in ("/v1/sim?gid=0", "/v1/sim?gid=0&rounds=x", "/v1/sim?gid=0&rounds=0", "/v1/spin?gid=0&game=x&bet=40", "/v1/sim?gid=9&rounds=1", "/nope")] == [400, 400, 400, 400, 400, 404]
        assert ask("/v1/stat", {"bet_units": [40], "total_wins": [40, 0], "base_wins": [40, 0], "free_wins": [0, 0], "triggers": [0, 0]})[1]["rtp"] == 0.5
        assert len(ask("/dev/games")[1]) == 2 and http.call(engine, "/dev/games", production=True)[0] == 404
    finally:
        server.shutdown()


def test_error_levels():
    warn = errors.Warn("no", extra="x")
    assert str(warn) == "no | x" and errors.level_of(errors.wrap(warn, "outer")) is errors.Level.WARN
    assert errors.is_fatal(errors.wrap(KeyError("k"), "outer")) and "cause" in str(errors.wrap(KeyError("k"), "outer"))
    assert errors.is_fatal(errors.EngineError("x")) and not errors.is_fatal(None) and not errors.is_fatal(KeyError("k"))
    late = errors.EngineError("x")
    late.__cause__ = TimeoutError()
    stopped = errors.Warn("x")
    stopped.__cause__ = InterruptedError()
    assert [errors.status_code(x) for x in (late, stopped, warn, KeyError("k"))] == [504, 408, 400, 500]


def test_checkpoints():
    assert wire.decode_checkpoint("a", '{"x":1}') == {"x": 1} and wire.decode_checkpoint("a", "") is None
    wire.register_checkpoint("a", int, str)
    try:
        assert wire.decode_checkpoint("a", "7") == 7 and wire.encode_checkpoint("a", 7) == "7" and wire.encode_checkpoint("a", None) is None
        with pytest.raises(wire.RequestError):
            wire.decode_checkpoint("a", "x")
        with pytest.raises(ValueError):
            wire.register_checkpoint("a", int, str)
    finally:
        wire.CHECKPOINTS.clear()


def test_bet_types_and_codecs():
    assert [t for t in config.BET_TYPES if config.is_line(t)] == ["line_ltr", "line_rtl", "line_both"] and [t for t in config.BET_TYPES if config.is_way(t)] == ["way_ltr", "way_rtl", "way_both"]
    assert config.is_count("count") and config.is_cluster("cluster") and config.parse_bet_type("line_ltr") == "line_ltr" and config.parse_bet_type("LINE") is None
    assert [config.reads_right(t) + 2 * config.reads_left(t) for t in config.BET_TYPES] == [1, 2, 3, 1, 2, 3, 0, 0]
    assert codec.decode_base64(codec.encode_base64(b"\xff\xfe?")) == b"\xff\xfe?"
    with pytest.raises(ValueError):
        codec.decode_base64("?")


def test_draws():
    state = rng.streams(1, np.arange(2000))
    bits = rng.draw(state, 3)
    assert rng.below(bits, 0).tolist() == [-1] * 2000 and rng.below(bits, 1).tolist() == [0] * 2000
    exact = [int(b) * n >> 64 for b in bits for n in (7, 10**12, 2**62 + 3)]
    got = np.stack([rng.below(bits, n) for n in (7, 10**12, 2**62 + 3)], 1)
    differ = [i for i, (a, b) in enumerate(zip(got.ravel().tolist(), exact, strict=True)) if a != b]
    assert all(i % 3 == 2 for i in differ) and 400 < len(differ) < 600  # a quarter of the numbers is refused there and drawn again
    assert rng.pick(bits, np.array([])).tolist() == [-1] * 2000 and set(rng.pick(bits, np.array([4, 9])).tolist()) == {4, 9}
    mixed = rng.shuffled(state, 5)
    assert (np.sort(mixed, 1) == np.arange(5)).all() and len({tuple(r) for r in mixed.tolist()}) == 120
    plain = rng.draw(state, np.arange(2000))
    with rng.using("pcg64"):
        other = rng.draw(state, np.arange(2000))
        assert (other != plain).mean() > 0.99 and (rng.draw(state[:1], 7) == rng.draw(np.repeat(state[:1], 8), np.arange(8))[7]).all()
        u = rng.unit(other)
        assert abs(u.mean() - 0.5) < 0.03 and abs(u.std() - 12**-0.5) < 0.02
        # the sequence itself, a step at a time
        x, out = int(state[0]), []
        for _ in range(4):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            w = (((x >> ((x >> 59) + 5)) ^ x) * 12605985483714917081) % 2**64
            out.append((w >> 43) ^ w)
        assert rng.draw(np.repeat(state[:1], 4), np.arange(4)).tolist() == out
    with pytest.raises(ValueError), rng.using("nope"):
        pass
    with pytest.raises(ValueError):
        rng.register_generator("pcg64", None)


def test_simulation_with_another_generator(engine):
    one = sorted(map(tuple, engine.simulate(0, 2000, prng="pcg64").collect()))
    assert one == sorted(map(tuple, engine.simulate(0, 2000, prng="pcg64", partitions=1).collect())) != sorted(map(tuple, engine.simulate(0, 2000).collect()))
    with pytest.raises(ValueError):
        engine.simulate(0, 10, prng="nope")


def test_sixty_four_tags(spark):
    names = [f"t{i}" for i in range(64)]
    for i, n in enumerate(names):
        tags._BUILDERS.setdefault(n, lambda i=i: F.col("id") % 64 == i)
    try:
        tagger = tags.Tagger(names)
        rows = spark.range(128).select("id", tagger.bits().alias("bits"))
        assert rows.where(tags.covers(F.col("bits"), tagger.mask(["t63"]))).count() == 2 and rows.where(tags.any_of(F.col("bits"), tagger.mask(["t63", "t0"]))).count() == 4
        assert rows.where(tags.none_of(F.col("bits"), tagger.mask(names))).count() == 0
        with pytest.raises(ValueError):
            tags.Tagger([*names, "bg"])
    finally:
        for n in names:
            tags._BUILDERS.pop(n, None)


def test_strata_in_one_pass(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") * 7 % 11).alias("x"))
    for k in (3, 9):
        strata = [(f"s{i}", F.col("x") % (i + 2) == 0, 20 + 5 * i) for i in range(k)]
        plan = tags.collect_strata(rows, strata, "id")
        got = {r.id: r.cname for r in plan.collect()}
        want, room = {}, {n: r for n, _, r in strata}
        for i in range(3000):
            for j in range(k):
                if (i * 7 % 11) % (j + 2) == 0 and room[f"s{j}"]:
                    want[i] = f"s{j}"
                    room[f"s{j}"] -= 1
                    break
        assert got == want
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1  # one read however many strata


def test_command_line_tools(spark, capsys, tmp_path):
    command_line(["replay", "--rounds", "2", "--format", "json"])
    assert len(json.loads(capsys.readouterr().out.splitlines()[0])["results"]) == 2
    command_line(["run", "--rounds", "500", "--out", str(tmp_path / "r.txt")])
    assert "win / bet" in (tmp_path / "r.txt").read_text()
    with pytest.raises(SystemExit):
        command_line(["tune"])
