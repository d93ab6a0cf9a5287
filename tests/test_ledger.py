"""Reports, sessions, estimators, acts and tags."""

import math
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreel.functions.beta import beta_cdf, beta_quantile, clopper_pearson, quantile_ranks
from sparkreel.operators import acts, estimator, report, sessions, tags
from sparkreel.plans import demo
from sparkreel.plans.engine import Engine
from sparkreel.sources import ledger

SCHEMA = "spin_id long, player_id long, seq long, bet_unit long, bet long, total_win long, base_win long, trigger int"


def rounds(spark, wins, unit=40, player=0, base=None):
    return spark.createDataFrame([(i, player, i, unit, unit, w, w if base is None else base[i], 0) for i, w in enumerate(wins)], SCHEMA)


def test_formulas(spark):
    r = report.summary(rounds(spark, [40, 80])).first()
    assert r.rtp == 1.5 and math.isclose(r.std, math.sqrt(0.5), abs_tol=1e-12) and math.isclose(r.cv, r.std / 1.5, abs_tol=1e-12)
    assert math.isclose(r.ci_hi - r.rtp, 1.96 * r.std / math.sqrt(2)) and r.ci_lo == max(0, r.rtp - (r.ci_hi - r.rtp))
    d = report.distribution(rounds(spark, [40, 80])).collect()
    assert len(d) == 14 and sum(x.total_n for x in d) == sum(x.base_n for x in d) == sum(x.free_n for x in d) == 2


def test_empty_and_single(spark):
    r = report.summary(rounds(spark, [])).first()
    assert (r.rounds, r.rtp, r.std, r.cv, r.trigger_rate, r.hit_rate, r.ci_lo, r.ci_hi) == (0, 0, 0, 0, 0, 0, 0, 0)
    r = report.summary(rounds(spark, [100])).first()
    assert (r.rtp, r.std, r.ci_lo, r.ci_hi) == (2.5, 0, 2.5, 2.5)
    assert sum(x.total_n for x in report.distribution(rounds(spark, [])).collect()) == 0


@pytest.mark.parametrize("win,index", [(0, 0), (1, 1), (39, 1), (40, 2), (79, 2), (80, 3), (40 * 1999, 11), (40 * 2000, 12), (399_999, 12), (400_000, 13)])
def test_buckets(spark, win, index):
    assert spark.range(1).select(report.bucket(F.lit(win), F.lit(40)).alias("b")).first().b == index


def test_large_sums_do_not_overflow(spark):
    r = report.summary(rounds(spark, [4 * 10**9] * 4)).first()
    assert r.std == 0 and r.total_win == 16 * 10**9


def test_merge_adds_parts(spark):
    rows = rounds(spark, range(100))
    whole = report.summary(rows).first()
    parts = report.merge(report.summary(rows.withColumn("k", F.col("spin_id") % 3), "k")).first()
    assert all(parts[c] == whole[c] for c in ("rounds", "total_bet", "total_win", "no_win_rounds"))
    assert math.isclose(parts["total_mult_sq"], whole["total_mult_sq"])


def test_report_does_not_depend_on_partitions(spark):
    rows = rounds(spark, [i * 37 % 500 for i in range(1000)])
    assert report.summary(rows.repartition(1)).first() == report.summary(rows.repartition(7)).first()


def plain_session(wins, unit, bets):
    balance = start = unit * bets
    seen = []
    for w in wins:
        if balance < unit or balance >= 3 * start or (seen and (seen[-1] < unit)):
            break
        balance += w - unit
        seen.append(balance)
        if balance < unit or balance >= 3 * start:
            break
    return seen


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 200), min_size=1, max_size=25), min_size=1, max_size=6))
def test_sessions_agree_with_a_loop(spark, players):
    rows = [(100 * p + i, p, i, 40, 40, w, w, 0) for p, wins in enumerate(players) for i, w in enumerate(wins)]
    got = {r.player_id: r for r in sessions.outcomes(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    for p, wins in enumerate(players):
        seen, r = plain_session(wins, 40, 3), got[p]
        assert (r.rounds, r.balance) == (len(seen), seen[-1])
        assert (r.max_balance, r.min_balance) == (max([120, *seen]), min([120, *seen]))
        assert (r.bust, r.cashout, r.alive) == (seen[-1] < 40, seen[-1] >= 360, 40 <= seen[-1] < 360)


def test_beta_and_intervals():
    assert math.isclose(beta_cdf(2, 3, 0.4), 0.5248, abs_tol=1e-12)
    for a, b in ((1, 1), (3, 8), (150, 20), (0.5, 0.5)):
        for p in (0.025, 0.3, 0.975):
            assert math.isclose(beta_cdf(a, b, beta_quantile(p, a, b)), p, abs_tol=1e-9)
    for k, expect in ((3, (0.066740, 0.652453)), (2, (0.025211, 0.556095)), (5, (0.187086, 0.812914))):
        assert [round(x, 6) for x in clopper_pearson(k, 10)] == list(expect)
    assert clopper_pearson(0, 0) == (0, 1) and clopper_pearson(0, 5)[0] == 0 and clopper_pearson(5, 5)[1] == 1
    assert quantile_ranks(1, 0.5) == (0, 0) and quantile_ranks(100, 0.5)[0] < 50 <= quantile_ranks(100, 0.5)[1] + 1


def test_quantiles_of_players(spark):
    rows = [(p, p, 0, 100, 100, p, p, 0) for p in range(100)]
    got = {r.name: r for r in estimator.rtp_quantiles(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert math.isclose(got["p50"].value, 0.5) and math.isclose(got["p90"].value, 0.9) and math.isclose(got["p33"].value, 0.33)
    assert all(r.lo <= r.value <= r.hi for r in got.values())
    assert estimator.rtp_quantiles(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 0.5, 0.5, 2.0, 1e9, -3.0]), min_size=1, max_size=60))
def test_values_at_ranks(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
    assert estimator.values_at_ranks(df, "v", ranks) == {r: sorted(values)[r] for r in ranks}


def test_session_shares(spark):
    rows = []
    for p in range(10):
        wins = [0] * 20 if p < 3 else [500] if p < 5 else [40] * 3
        rows += [(100 * p + i, p, i, 40, 40, w, w, 0) for i, w in enumerate(wins)]
    got = {r.name: r.share for r in estimator.session_shares(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == {"bust": 0.3, "cashout": 0.2, "alive": 0.5}


def test_event_and_bucket_counts(spark):
    rows = [(i, p, i, 40, 40, 40, 40, 1) for p in range(6) for i in range(p)] + [(99, 9, 0, 40, 40, 0, 0, 0)]
    got = {r.times: r.players for r in estimator.event_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 3}
    buckets = estimator.bucket_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(buckets) == 56 and {(r.times, r.players) for r in buckets if r.bucket == 2} == {(0, 1), (1, 1), (2, 1), (3, 3)}


def test_posted_ledger_is_cut_to_its_shortest_array(spark):
    posted = {"bet_units": [40, 80], "bet_mode": 1, "total_wins": [10, 20, 30], "base_wins": [10, 5, 0], "free_wins": [0, 0], "triggers": [0, 1, 1]}
    r = report.summary(ledger.from_arrays(spark, posted)).first()
    assert (r.rounds, r.total_bet, r.total_win, r.free_win, r.triggers) == (2, 160, 30, 15, 1)
    assert report.summary(ledger.from_arrays(spark, posted | {"free_wins": []})).first().rounds == 0


def test_tags(spark):
    rows = [(0, 0, 0, 40, 40, 500, 100, 0), (1, 0, 0, 40, 40, 279, 40, 1), (2, 0, 0, 40, 40, 280, 40, 1)]
    tagger = tags.Tagger(["bg", "fg"])
    bits = {r.spin_id: r.b for r in spark.createDataFrame(rows, SCHEMA).select("spin_id", tagger.bits().alias("b")).collect()}
    assert bits == {0: 1, 1: 0, 2: 2}
    assert tagger.mask(["fg", "nope"]) == 2
    assert not tags.register_tag("bg", tags.base_only)
    with pytest.raises(ValueError):
        tags.Tagger(["nope"])
    with pytest.raises(ValueError):
        tags.Tagger([])


def test_strata_fill_in_order(spark):
    rows = spark.range(100).withColumnRenamed("id", "spin_id")
    strata = [("a", F.col("spin_id") % 2 == 0, 5), ("b", F.col("spin_id") % 3 == 0, 4), ("c", F.lit(True), 3)]
    got = {(r.cname, r.spin_id) for r in tags.collect_strata(rows, strata, "spin_id").collect()}
    room, expect = {n: k for n, _, k in strata}, set()
    for i in range(100):
        for n, ok in (("a", i % 2 == 0), ("b", i % 3 == 0), ("c", True)):
            if ok and room[n]:
                room[n] -= 1
                expect.add((n, i))
                break
    assert got == expect
    apart = [("even", F.col("spin_id") % 2 == 0, 5), ("odd", F.col("spin_id") % 2 == 1, 4)]
    assert {tuple(r) for r in tags.collect_disjoint(rows, apart, "spin_id").select("cname", "spin_id").collect()} == {tuple(r) for r in tags.collect_strata(rows, apart, "spin_id").select("cname", "spin_id").collect()}


def test_acts(spark):
    rows = [(1, 0, 10, False, False), (1, 1, 5, True, False), (1, 2, 7, True, True), (1, 3, 1, True, True), (2, 0, 9, True, True)]
    df = spark.createDataFrame(rows, "spin long, n long, actwin long, is_step_end boolean, is_round_end boolean")
    out = acts.running_totals(acts.number_acts(df, "spin", order="n"), "spin", order="n").orderBy("spin", "n").collect()
    assert [(r["round"], r.step, r.act, r.nowtotalwin, r.roundaccwin, r.stepaccwin) for r in out] == [(0, 0, 0, 10, 10, 10), (0, 0, 1, 15, 15, 15), (0, 1, 0, 22, 22, 7), (1, 0, 0, 23, 1, 1), (0, 0, 0, 9, 9, 9)]
    assert list(accumulate([10, 5, 7, 1])) == [r.nowtotalwin for r in out[:4]]


def test_published_arithmetic():
    # published sample figures, as a check of the formulas
    base, free, bet, std, n = 2_439_779_100, 1_382_422_560, 4_000_000_000, 6.797, 1e8
    rtp = (base + free) / bet
    assert round(100 * rtp, 2) == 95.56 and round(std / rtp, 3) == 7.113
    assert (round(rtp - 1.96 * std / math.sqrt(n), 6), round(rtp + 1.96 * std / math.sqrt(n), 6)) == (0.954218, 0.956883)


def test_player_study(spark):
    engine = Engine(spark, games=[demo.line_game()])
    rows = engine.simulate_players("demo_normal", 50, 30, 5).cache()
    study = engine.player_study(rows, 5)
    assert study["quantiles"].count() == 5 and study["cdf"].count() == 4 and study["sessions"].agg(F.sum("k")).first()[0] == 50
    # the source stops where the session rule stops
    assert sessions.running(rows, 5).count() == rows.count()


def test_reports_added_up_where_they_are_played(spark):
    engine = Engine(spark, games=[demo.line_game(), demo.cascade_game()])
    for gid, n in ((0, 70_000), (1, 3000), (0, 0)):
        got, plain = engine.simulate_report(gid, n, partitions=3), engine.simulate(gid, n)
        a, b = got["summary"].first().asDict(), report.summary(plain).first().asDict()
        assert set(a) == set(b) and all(a[k] == b[k] if isinstance(b[k], int | None) else math.isclose(a[k], b[k], rel_tol=1e-12) for k in b if not (n == 0 and k == "bet_unit"))
        if n:
            assert sorted(map(tuple, got["buckets"].collect())) == sorted(map(tuple, report.distribution(plain).collect()))


def test_merged_reports_are_whole(spark):
    rows = rounds(spark, [i * 37 % 500 for i in range(1000)]).withColumn("k", F.col("spin_id") % 7)
    whole, merged = report.summary(rows).first().asDict(), report.merge(report.summary(rows, "k")).first().asDict()
    assert all(math.isclose(merged[c], whole[c], rel_tol=1e-9) for c in whole)
    assert sorted(map(tuple, report.merge_buckets(report.distribution(rows, "k")).collect())) == sorted(map(tuple, report.distribution(rows).collect()))
    with pytest.raises(Exception, match="different bet units"):
        report.merge(report.summary(rounds(spark, [1])).unionByName(report.summary(rounds(spark, [1], unit=50)))).collect()
