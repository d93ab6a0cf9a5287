"""Configurations, catalogue, simulation, sampling, tuner, wire, renderers, streams and the driver entry."""

import dataclasses
import importlib.util
import json
import math

import numpy as np
import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkreel.__main__ import main as command_line
from sparkreel.functions import codec, render, rng
from sparkreel.operators import report, sampling, sessions, tuner
from sparkreel.plans import demo
from sparkreel.plans.engine import Engine, merge_logics
from sparkreel.sources import config, wire
from sparkreel.sources import simulate as sims
from sparkreel.streaming import sessions as streams


def raw_game(**change):
    hit = {"bet_type": "line_ltr", "line_table": [[0, 0, 0]]}
    mode = {
        "screen_setting": {"columns": 3, "rows": 1, "mask": None},
        "gen_screen_setting": {"gen_reel_type": "GenReelByReelIdx", "reel_set_group": [{"weight": 1, "reels": [{"symbols": [0]}] * 3}]},
        "symbol_setting": {"symbol_used": ["H1"], "pay_table": [[0, 2, 5]]},
        "hit_setting": hit,
    }
    return {"game_id": 7, "game_name": " Demo ", "logic_key": "demo_normal", "bet_units": [1, 2], "max_win_limit": 100, "game_mode_settings": [mode]} | change


def test_config_yaml_and_json_agree():
    raw = raw_game()
    assert config.from_yaml(yaml.safe_dump(raw)) == config.from_json(json.dumps(raw))
    assert config.parse_game(raw).name == "demo"


def _mode_change(section, **change):
    raw = raw_game()
    raw["game_mode_settings"][0][section] = raw["game_mode_settings"][0][section] | change
    return raw


@pytest.mark.parametrize(
    "raw",
    [
        raw_game(bet_units=[]),
        raw_game(bet_units=[0]),
        raw_game(bet_units=[101]),
        raw_game(game_mode_settings=[]),
        raw_game(game_name=" "),
        raw_game(optimal_setting={"use_optimal": True, "gachas": ["a"], "seed_bank": ["a"]}),
        _mode_change("screen_setting", rows=0),
        _mode_change("screen_setting", mask=[1]),
        _mode_change("symbol_setting", symbol_used=["X9"]),
        _mode_change("symbol_setting", pay_table=[[0], [0]]),
        _mode_change("hit_setting", bet_type="nope"),
        _mode_change("hit_setting", line_table=[]),
        _mode_change("hit_setting", line_table=[[0, 0]]),
        _mode_change("gen_screen_setting", gen_reel_type="nope"),
        _mode_change("gen_screen_setting", reel_set_group=[{"weight": 0, "reels": [{"symbols": [0]}] * 3}]),
        _mode_change("gen_screen_setting", reel_set_group=[{"weight": 1, "reels": [{"symbols": [1]}] * 3}]),
        _mode_change("gen_screen_setting", reel_set_group=[{"weight": 1, "reels": [{"symbols": [0], "weights": [1, 2]}] * 3}]),
        _mode_change("gen_screen_setting", reel_set_group=[{"weight": 1, "reels": [{"symbols": [0], "weights": [10**8]}] * 3}]),
    ],
)
def test_bad_configs(raw):
    with pytest.raises(config.ConfigError):
        config.parse_game(raw)


def test_catalogue(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(raw_game()))
    engine = Engine(spark, [tmp_path], games=[demo.cascade_game()])
    assert engine.catalog.ids() == [1, 7] and engine.catalog.get(" DEMO ").game_id == 7
    assert [r.game_name for r in engine.catalog.summary(spark).orderBy("game_id").collect()] == ["demo_cascade", "demo"]
    with pytest.raises(config.ConfigError):
        engine.catalog.register(demo.line_game())
    with pytest.raises(config.ConfigError):
        engine.catalog.get("nope")
    open_catalog = config.Catalog(["demo_normal"])
    open_catalog.register(config.parse_game(raw_game()))
    for bad in (raw_game(), raw_game(game_id=8), raw_game(game_name="x"), raw_game(game_id=9, game_name="y", logic_key="none")):
        with pytest.raises(config.ConfigError):
            open_catalog.register(config.parse_game(bad))
    (tmp_path / ".hidden.yaml").write_text("")
    with pytest.raises(config.ConfigError):
        config.config_files([tmp_path])
    with pytest.raises(config.ConfigError):
        merge_logics(sims.LOGICS, sims.LOGICS)
    with pytest.raises(config.ConfigError):
        config.decode_fixed(sims.CascadeRules, {"max_step": 1, "other": 2})
    assert {r.name: r.type_name for r in config.symbols_frame(spark, demo.line_game()).where("mode_id = 0").collect()}["W1"] == "wild"


def test_simulation_does_not_depend_on_partitions_and_replays(spark):
    for game, n in ((demo.line_game(), 5000), (demo.cascade_game(), 600)):
        engine = Engine(spark, games=[game])
        one = sorted(map(tuple, engine.simulate(game.game_id, n, partitions=1).collect()))
        assert one == sorted(map(tuple, engine.simulate(game.game_id, n, partitions=7).collect()))
        assert one[100:150] == sorted(map(tuple, engine.simulate(game.game_id, 50, first_spin=100).collect()))
        assert one != sorted(map(tuple, engine.simulate(game.game_id, n, seed=2).collect()))
        assert all(r[5] >= r[6] >= 0 and (r[7] or r[5] == r[6]) for r in one)


def test_forced_set_and_symbol_weights():
    reel = lambda s, w: config.Reel((s,), (w,))
    sets = (config.ReelSet(0, (reel(1, 1),) * 2), config.ReelSet(5, (reel(9, 1),) * 2))
    m = config.Mode(2, 2, "GenReelByReelIdx", sets, ("H1",), ((0, 0),), "count")
    assert (sims.Reels(m).boards(rng.streams(1, np.arange(50)), 0) == 9).all()
    weighted = config.Mode(1, 1, "GenReelBySymbolWeight", (config.ReelSet(1, (config.Reel((0, 1, 2), (1, 2, 7)),)),), ("H1",), ((0,),), "count")
    share = np.bincount(sims.Reels(weighted).boards(rng.streams(3, np.arange(50_000)), 0).ravel(), minlength=3) / 50_000
    assert np.abs(share - [0.1, 0.2, 0.7]).max() < 0.015


def test_mean_of_lines_agrees_with_expectation(spark):
    game = demo.line_game()
    base = game.modes[0]
    table = sims.line_table(base)
    k, expected = len(base.symbols), np.ones(1)
    for reel in base.reel_sets[0].reels:
        p = np.bincount(reel.symbols, minlength=k) / len(reel.symbols)
        expected = (expected[:, None] * p).ravel()
    mean = float(expected @ table) * len(base.lines)
    r = report.summary(Engine(spark, games=[game]).simulate(0, 200_000)).first()
    assert abs(r.base_win / r.rounds - mean) < 5 * 40 * r.std / math.sqrt(r.rounds)


def test_spin_requests_and_service(spark):
    engine = Engine(spark, games=[demo.line_game()])
    rows = [(1, 0, "demo_normal", 40, 0, 1), (2, 0, "DEMO_normal ", 80, 0, 2), (3, 0, "x", 40, 0, 1), (4, 5, "x", 40, 0, 1), (5, 0, "demo_normal", 41, 0, 1), (6, 0, "demo_normal", 40, 3, 1)]
    out = {r.request_id: r for r in engine.spin(spark.createDataFrame(rows, "request_id long, gid long, game string, bet long, bet_mode int, bet_mult int")).collect()}
    assert out[1].error is None and out[1].win == engine.simulate(0, 1, first_spin=1).first().total_win
    assert out[2].win == 2 * engine.simulate(0, 1, first_spin=2).first().total_win
    assert [out[k].error is None for k in (3, 4, 5, 6)] == [False] * 4 and out[4].win is None
    assert engine.service("health") == [{"ok": True, "games": 1}] and len(engine.service("games")) == 1
    assert engine.service("sim", game=0, rounds=100)[0]["rounds"] == 100
    assert engine.service("simplayer", game=0, players=3, rounds=5, init_bets=5)[0]["rounds"] <= 15
    for bad in ({"name": "sim", "game": 0, "rounds": 10**7}, {"name": "nope"}, {"name": "simplayer", "game": 0, "players": 0, "rounds": 1, "init_bets": 1}):
        with pytest.raises(config.ConfigError):
            engine.service(**bad)
    assert engine.simulate_config(yaml.safe_dump(raw_game()), 10).count() == 10


def test_rng():
    s = rng.streams(5, np.arange(1000))
    assert (rng.streams(5, np.arange(1000)) == s).all() and (rng.streams(6, np.arange(1000)) != s).all()
    u = rng.unit(rng.draw(s, 3))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05
    assert set(rng.below(rng.draw(s, 1), 7).tolist()) == set(range(7)) and (rng.below(rng.draw(s, 2), 1) == 0).all()
    z = rng.normal(rng.draw(s, 8), rng.draw(s, 9))
    assert abs(z.mean()) < 0.15 and abs(z.std() - 1) < 0.1 and abs(rng.exponential(rng.draw(s, 4)).mean() - 1) < 0.15
    assert len(set(rng.seed_stream(1, 100))) == 100 and rng.seed_stream(1, 5) == rng.seed_stream(1, 5) != rng.seed_stream(2, 5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=40).filter(sum))
def test_alias_mass(weights):
    prob, alias, total = sampling.alias_table(weights)
    assert sampling.alias_mass(prob, alias, total).tolist() == [w * len(weights) for w in weights]
    p, a = sampling.alias_table_real(weights)
    mass = np.minimum(p, 1) + np.bincount(a, 1 - np.minimum(p, 1), minlength=len(weights))
    assert np.allclose(mass, np.array(weights) * len(weights) / sum(weights), atol=1e-6)


def test_samplers(spark):
    assert sampling.lut([0, 2, 1]).tolist() == [1, 1, 2]
    for bad in ([], [-1, 2], [0, 0], [10**8]):
        with pytest.raises(ValueError):
            sampling.lut(bad)
    with pytest.raises(OverflowError):
        sampling.alias_table([2**61] * 3)
    assert sampling.alias_table([])[2] == 0 and sampling.alias_pick(*sampling.alias_table([]), np.zeros(2), np.zeros(2)).tolist() == [-1, -1]
    prob, alias, total = sampling.alias_table([10, 20, 70])
    g = np.random.default_rng(1)
    picks = sampling.alias_pick(prob, alias, total, g.integers(0, 3, 100_000), g.integers(0, total, 100_000))
    assert np.abs(np.bincount(picks) / 100_000 - [0.1, 0.2, 0.7]).max() < 0.01
    df = spark.range(20_000).select((F.col("id") / 2).cast("long").alias("g"), (F.col("id") % 2).alias("i"), F.when(F.col("id") % 2 == 0, 10).otherwise(90).alias("w"), ((F.xxhash64("id").bitwiseAND((1 << 40) - 1) + 0.5) / float(1 << 40)).alias("u"))
    first = sampling.weighted_order(df, "w", "u", "g", tie="i").where("place = 1").agg(F.avg("i")).first()[0]
    assert 0.87 < first < 0.93
    few = spark.createDataFrame([(0, i, w, 0.3 + i / 10) for i, w in enumerate([5, 0, 1, 4])], "g int, i int, w int, u double")
    order = [r.i for r in sampling.weighted_order(few, "w", "u", "g", tie="i", drop_zero=True).orderBy("place").collect()]
    assert sorted(order) == [0, 2, 3]
    assert [r.i for r in sampling.weighted_sample(few, 2, "w", "u", "g", tie="i").orderBy("place").collect()] == order[:2]
    assert [r.i for r in sampling.weighted_order(few, "w", "u", "g", tie="i").orderBy("place").collect()][-1] == 1
    assert sampling.reservoir(few, 9, "w", 1, "i").count() == 3
    assert [r.id for r in sampling.seeded_shuffle(spark.range(50), 1, "id").collect()] != list(range(50))


def tuner_settings():
    raw = {
        "trget_std": 2.0,
        "class_settings": [
            {"class_name": "base", "match_tags": ["bg"], "min_win": 0, "max_win": 50, "collect": 60, "hit_prob": 0, "exp_win": 0.75, "basis": 10, "shapes_collect": 20, "shape_cfg": {"method": "gamma", "gamma": {"k_range": [2, 3], "mu_center": 2, "mu_std": 2, "std_range": [1, 3], "amp_range": [0.1, 0.7], "zero_range": [0.6, 0.8], "spike": {"mass_range": [0.001, 0.002], "win_range": [20, 50]}, "biases": [{"range": [1, 2], "prob": 100000}]}}, "quality_evaluate": {"mean_median_ratio": [0, 1e12]}},
            {"class_name": "fg", "match_tags": ["fg"], "min_win": 5, "max_win": 60, "collect": 30, "hit_prob": 6800, "exp_win": 20, "basis": 10, "shapes_collect": 10, "shape_cfg": {"method": "gaussian", "gaussian": {"k_range": [1, 2], "mu_center": 20, "mu_std": 8, "std_range": [3, 6], "amp_range": [0.1, 0.6]}}, "quality_evaluate": {"mean_median_ratio": [0, 10]}},
        ],
    }
    return raw


def test_tuner(tmp_path):
    target, classes = tuner.parse_settings(tuner_settings())
    assert target == 2.0 and [c.hit_prob for c in classes] == [993200, 6800]
    g = np.random.default_rng(3)
    parts = [(classes[0], np.concatenate([np.zeros(20), g.uniform(0.1, 50, 40)]), [bytes([i, 0]) for i in range(60)]), (classes[1], g.uniform(5, 60, 30), [bytes([i, 1]) for i in range(30)])]
    bank, wins, weights = tuner.tune(parts, 2.5)
    assert math.isclose(weights.sum(), 1, abs_tol=1e-9)
    assert math.isclose(float(wins @ weights), 0.75 * 0.9932 + 20 * 0.0068, rel_tol=1e-9)
    order = np.argsort(parts[1][1], kind="stable")
    assert bank.seed(60) == bytes([order[0], 1]) and wins[60] == parts[1][1].min()
    tuner.save(bank, 3, tmp_path, {"std": 1})
    again = tuner.load_bank(3, tmp_path)
    assert (again.prob == bank.prob).all() and again.seeds == bank.seeds and again.total == bank.total
    assert np.frombuffer((tmp_path / "prob_3.bin").read_bytes(), "<u8").tolist() == bank.prob.tolist()
    with pytest.raises(tuner.TunerError):
        tuner.SeedBank(bank.prob, bank.alias, 1, 0, b"").validate()


@pytest.mark.parametrize("change", [{"hit_prob": 0}, {"hit_prob": 2_000_000}, {"quality_evaluate": None}, {"collect": 0}, {"shape_cfg": {"method": "nope"}}])
def test_bad_tuner_settings(change):
    raw = tuner_settings()
    raw["class_settings"][1] |= change
    with pytest.raises(tuner.TunerError):
        tuner.parse_settings(raw)


def test_tuner_pieces(spark):
    wins = np.array([0.0, 1.0, 2.0, 4.0])
    w = np.array([0.4, 0.2, 0.2, 0.2])
    assert tuner.mean_of(wins, w) == pytest.approx(1.4) and tuner.median_of(wins, w) == 1.0
    assert tuner.population_std(wins, w) == pytest.approx(math.sqrt(0.2 * (1 + 4 + 16) - 1.4**2))
    assert tuner.quantize([0.5, 0.25, 0.25]).tolist() == [tuner.ACCURACY // 3 * 2 // 4, tuner.ACCURACY // 3 // 4, tuner.ACCURACY // 3 // 4]
    assert tuner.quantize([0, 0]).tolist() == [1, 1] and tuner.quantize([]).tolist() == []
    x = np.linspace(0.001, 200, 400_000)
    assert np.trapezoid(tuner.gamma_pdf(x, np.array(20.0), np.array(8.0)), x) == pytest.approx(1, abs=1e-3)
    assert np.trapezoid(tuner.normal_pdf(x, np.array(100.0), np.array(8.0)), x) == pytest.approx(1, abs=1e-6)
    high, low = np.array([0, 0, 0.5, 0.5]), np.array([0.5, 0.5, 0, 0])
    assert tuner.mean_of(wins, tuner.blend(wins, low, high, 1.0)) == pytest.approx(1.0)
    assert tuner.blend(wins, high, low, 9.0) is None
    ratio = tuner.RatioFilter(3, 4)
    assert ratio(7, 2) and not any(ratio(1, 1) for _ in range(100)) and ratio.lo < 3 < 4 < ratio.hi
    assert not tuner.RatioFilter(3, 4)(0, 0) and tuner.RatioFilter(1, 4)(0, 0)
    _, classes = tuner.parse_settings(tuner_settings())
    shapes = tuner.shapes_frame(spark, classes[1], [5.0, 9.0, 20.0, 44.0], 6, partitions=3).collect()
    assert len(shapes) == 6 and all(abs(sum(r.weights) - 1) < 1e-9 for r in shapes)
    with pytest.raises(tuner.TunerError):
        tuner.make_basis(dataclasses.replace(classes[1], exp_win=1e9, mixture=tuner.Mixture("uniform")), np.array([5.0, 6.0]), np.random.default_rng(1))


def test_wire(spark):
    assert wire.decode_request(query="uid=a&gid=3&bet=40&choice=2&start_b64u=AQ&has_choice=true") == {"uid": "a", "gid": 3, "bet": 40, "choice": 2, "has_choice": True, "start_state": {"start_b64u": "AQ"}}
    with pytest.raises(wire.RequestError):
        wire.parse_request(wire.decode_request(query="choice=2"))
    with pytest.raises(wire.RequestError):
        wire.decode_request(body='{"uid": "a", "other": 1}')
    with pytest.raises(wire.RequestError):
        wire.decode_request(body="{")
    with pytest.raises(wire.RequestError):
        wire.parse_request({"start_state": {"start_b64u": "!"}})
    ok = wire.parse_request({"start_state": {"start_b64u": "AQI", "cp": "{}"}})
    assert ok["snapshot"] == b"\x01\x02" and ok["checkpoint"] == {}
    lines = ['{"uid":"a","gid":1,"start_state":{"start_b64u":"AQI"}}', '{"uid":"a","zzz":1}', "{", '{"choice":1}', '{"choice":1,"has_choice":true}', '{"gid":"x"}']
    out = wire.read_requests(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.error is None for r in out] == [True, False, False, False, True, False] and bytes(out[0].snapshot) == b"\x01\x02"
    act = (("a", 0, 0, 0, 0, False, True, 5, 5, 5, 5, [1], "", [(5, 1, 0, 3, 0, 0, [0, 1])]))
    results = spark.createDataFrame([("g", 1, 5, 1, 0, 1, True, (None, None, None), [(5, 0, True, 0, [act, act])])], wire.RESULT).withColumn("spin_id", F.lit(9))
    assert wire.flatten_acts(results).count() == 2 and wire.flatten_details(results).first().win == 5
    assert len(wire.nest_acts(wire.flatten_acts(results)).first().acts) == 2
    rows = Engine(spark, games=[demo.line_game()]).simulate(0, 200)
    assert wire.to_result(rows, "demo_normal", 0, 0, 1).where(F.size("gamemodes") > 1).count() == rows.where("trigger > 0").count()


@given(st.binary(max_size=300))
def test_codecs(data):
    assert codec.decode_base64url(codec.encode_base64url(data)) == data
    framed = codec.encode_frame(data) + b"tail"
    assert codec.decode_frame(framed) == (data, b"tail")
    with pytest.raises(ValueError):
        codec.decode_frame(codec.encode_frame(data + b"x")[:-1])
    with pytest.raises(ValueError):
        codec.decode_frame(codec.encode_frame(data + b"xx"), most=len(data) + 1)


def test_codec_columns(spark):
    df = spark.createDataFrame([(bytes(range(n)),) for n in range(0, 120, 7)], "b binary")
    out = df.select("b", codec.to_base64url(F.col("b")).alias("t"), codec.from_base64url(codec.to_base64url(F.col("b"))).alias("back"), codec.to_hex(F.col("b")).alias("h")).collect()
    assert all(r.t == codec.encode_base64url(bytes(r.b)) and bytes(r.back) == bytes(r.b) and r.h == bytes(r.b).hex() for r in out)


def test_renderers(spark):
    text = render.to_yaml({"a": [1, 2], "b": {"c": [[1], [2]]}})
    assert "a: [1, 2]" in text and yaml.safe_load(text) == {"a": [1, 2], "b": {"c": [[1], [2]]}}
    assert json.loads(render.to_json({"x": 1})) == {"x": 1}
    assert render.thousands(1234567) == "1,234,567" and render.percent(0.12345) == "12.35%" and render.width("盤a") == 3
    assert render.duration(3.5) == "3.50s" and render.duration(3723) == "1h 2m 3.00s" and render.percent_interval(0.5, 0.4, 0.6) == "50.00% [40.00%, 60.00%]"
    r = report.summary(Engine(spark, games=[demo.line_game()]).simulate(0, 100)).first().asDict()
    lines = render.report_text("demo", r).splitlines()
    assert len({render.width(x) for x in lines}) == 1 and len(lines) == 10


def test_streams(spark, tmp_path):
    rows = [(1, i, 40, w, 40, w, 0) for i, w in enumerate([0, 0, 500, 40])] + [(2, i, 40, 0, 40, 0, 0) for i in range(4)]
    kind = "player_id long, seq long, bet_unit long, total_win long, bet long, base_win long, trigger int"
    df = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds(F.col("seq") * 600))
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, how in (("windows", streams.windowed_report(live), "complete"), ("players", streams.session_stream(live, 3), "update")):
        q = out.writeStream.format("memory").queryName(name).outputMode(how).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("windows").agg(F.sum("rounds"), F.sum("total_win")).first()[:] == (8, 540)
    got = {r.player_id: r for r in spark.table("players").collect()}
    batch = {r.player_id: r for r in sessions.outcomes(df, 3).collect()}
    for p, r in got.items():
        assert (r.rounds, r.balance, r.outcome) == (batch[p].rounds, batch[p].balance, "cashout" if batch[p].cashout else "bust" if batch[p].bust else "alive")


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
    if importlib.util.find_spec("corpus_pipeline") and importlib.util.find_spec("sparkreel.llm"):
        assert "pipeline" in queries


def test_tuned_bank_is_played(spark, tmp_path):
    engine = Engine(spark, games=[demo.line_game()])
    raw = tuner_settings()
    raw["trget_std"] = 2.5
    bank = engine.tune(0, raw, 20_000)
    rows = engine.simulate(0, 20_000, bank=bank)
    ids = set(np.frombuffer(bank.seeds, "<i8").tolist())
    plain = {r.total_win for r in engine.simulate(0, 20_000).where(F.col("spin_id").isin(list(ids))).collect()}
    assert {r.total_win for r in rows.select("total_win").distinct().collect()} <= plain
    r = report.summary(rows).first()
    assert abs(r.rtp - (0.75 * 0.9932 + 20 * 0.0068)) < 5 * r.std / math.sqrt(r.rounds)
    tuner.save(bank, 0, tmp_path)
    assert set(tuner.load_bundle([40], [0], tmp_path)) == {40}
    with pytest.raises(tuner.TunerError):
        tuner.load_bundle([40, 80], [0], tmp_path)
    with pytest.raises(tuner.TunerError):
        engine.tune(0, raw, 100)


def test_command_line(spark, capsys):
    command_line(["games"])
    command_line(["run", "--rounds", "200", "--format", "json"])
    command_line(["players", "--rounds", "5", "--players", "20", "--init-bets", "5"])
    out = capsys.readouterr().out
    assert "demo_cascade" in out and '"rounds": 200' in out and "cashout" in out
