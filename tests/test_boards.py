"""Scoring and transforms: literal cases and a plain version on random boards."""

import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreel.operators import boards
from sparkreel.operators.cluster import Clusters
from sparkreel.sources import simulate as sims
from sparkreel.sources.config import Mode


def mode(columns, rows, bet_type, symbols, pays, lines=()):
    return Mode(columns, rows, "GenReelByReelIdx", (), tuple(symbols), tuple(map(tuple, pays)), bet_type, tuple(map(tuple, lines)))


def native(spark, m, screens):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(screens)], "id long, board array<short>")
    out = boards.score_boards(df, m).select("id", "win", F.col("details").alias("d")).orderBy("id").collect()
    assert all(r.win == sum(d.win for d in r.d) for r in out)
    return [[(d.win, d.symbol, d["count"], d.direction, sorted(d.hits)) for d in r.d] for r in out]


@pytest.mark.parametrize(
    "m,screen,win,hits",
    [
        (mode(5, 3, "line_ltr", ["H1", "W1"], [[0, 0, 0, 0, 9], [0] * 5], [[1] * 5]), [0] * 15, 9, 5),
        (mode(3, 1, "way_ltr", ["H1"], [[0, 3, 6]]), [0, 0, 0], 6, 3),
        (mode(3, 1, "count", ["H1", "W1"], [[0, 0, 4], [0, 0, 0]]), [0, 0, 1], 4, 3),
    ],
)
def test_literal_boards(spark, m, screen, win, hits):
    (found,) = native(spark, m, [screen])
    assert [(f[0], len(f[4])) for f in found] == [(win, hits)]


def test_literal_cluster(spark):
    m = mode(2, 2, "cluster", ["H1"], [[0, 0, 5, 10]])
    df = spark.createDataFrame([(1, [0, 0, 0, 0])], "id long, board array<short>")
    (row,) = boards.score_boards(df, m).collect()
    assert row.win == 10 and [(d["count"], list(d.hits)) for d in row.details] == [(4, [0, 1, 2, 3])]


def plain_lines(m, s):
    out = []
    for d in {"ltr": [0], "rtl": [1], "both": [0, 1]}[m.bet_type.split("_")[1]]:
        for line in m.lines:
            cells = [r * m.columns + c for c, r in enumerate(line)]
            cells = cells[::-1] if d else cells
            v = [s[i] for i in cells]
            lead = 0
            while lead < len(v) and m.wild[v[lead]]:
                lead += 1
            run, sym = 0, None
            if lead < len(v) and m.paid[v[lead]]:
                sym, run = v[lead], lead
                while run < len(v) and (v[run] == sym or m.wild[v[run]]):
                    run += 1
            a = m.pay_table[v[0]][lead - 1] if lead else 0
            b = m.pay_table[sym][run - 1] if run else 0
            if max(a, b) > 0:
                n = lead if a > b else run
                out.append((max(a, b), v[0] if a > b else sym, n, d, sorted(cells[:n])))
    return out


def plain_ways(m, s):
    out = []
    lead = any(w and p for w, p in zip(m.wild, m.paid, strict=True))
    for d in {"ltr": [0], "rtl": [1], "both": [0, 1]}[m.bet_type.split("_")[1]]:
        order = list(range(m.columns))[:: -1 if d else 1]
        first = [s[r * m.columns + order[0]] for r in range(m.rows)]
        for sym in dict.fromkeys(first):
            hits, n = [], 0
            for k, c in enumerate(order):
                cells = [r * m.columns + c for r in range(m.rows)]
                if m.wild[sym] and lead:
                    ok = [i for i in cells if m.wild[s[i]]]
                else:
                    ok = [i for i in cells if s[i] == sym or (k and m.wild[s[i]])]
                if not ok:
                    break
                hits, n = hits + ok, n + 1
            if (m.wild[sym] and lead) or m.paid[sym]:
                win = m.pay_table[sym][n - 1]
                if win > 0:
                    out.append((win, sym, n, d, sorted(hits)))
    return out


def plain_counts(m, s):
    out, wilds = [], [i for i, v in enumerate(s) if m.wild[v]]
    for sym in range(len(m.symbols)):
        if m.paid[sym]:
            hits = wilds if m.wild[sym] else sorted([i for i, v in enumerate(s) if v == sym] + wilds)
            win = m.pay_table[sym][len(hits) - 1] if hits else 0
            if win > 0:
                out.append((win, sym, len(hits), 0, hits))
    return out


def plain_clusters(m, s):
    out, seen = [], set()
    for start in range(len(s)):
        if m.wild[s[start]] or not m.paid[s[start]] or start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            x = todo.pop()
            r, c = divmod(x, m.columns)
            for rr, cc in ((r, c - 1), (r, c + 1), (r - 1, c), (r + 1, c)):
                y = rr * m.columns + cc
                if 0 <= rr < m.rows and 0 <= cc < m.columns and y not in group and (s[y] == s[start] or m.wild[s[y]]):
                    group.add(y)
                    todo.append(y)
        seen |= {x for x in group if not m.wild[s[x]]}
        win = m.pay_table[s[start]][min(len(group), len(m.pay_table[0])) - 1]
        if win > 0:
            out.append((win, s[start], sorted(group)))
    return out


SYMBOLS = ["Z1", "W1", "W2", "H1", "H2", "L1"]
PAYS = [[0, 0, 0, 0, 0], [0, 2, 9, 30, 90], [0, 0, 8, 20, 70], [0, 0, 10, 20, 50], [0, 1, 5, 9, 20], [0, 0, 3, 6, 12]]
LINES = [[1, 1, 1, 1, 1], [0, 1, 2, 1, 0], [2, 1, 0, 1, 2]]


@pytest.mark.parametrize("bet_type", ["line_ltr", "line_rtl", "line_both", "way_ltr", "way_rtl", "way_both", "count"])
def test_random_boards(spark, bet_type):
    rng = random.Random(bet_type)
    pays = [[p * (i + 1) for i in range(15)] for p in (0, 1, 0, 3, 4, 0)] if bet_type == "count" else PAYS
    m = mode(5, 3, bet_type, SYMBOLS, pays, LINES)
    screens = [[rng.choice([0, 1, 2, 3, 3, 4, 4, 5]) for _ in range(15)] for _ in range(400)]
    plain = {"line": plain_lines, "way": plain_ways, "count": plain_counts}[bet_type.split("_")[0]]
    assert native(spark, m, screens) == [plain(m, s) for s in screens]


def test_line_table_agrees_with_native_rules():
    rng = random.Random(1)
    for bet_type in ("line_ltr", "line_rtl", "line_both"):
        m = mode(5, 3, bet_type, SYMBOLS, PAYS, LINES)
        screens = np.array([[rng.choice([0, 1, 2, 3, 3, 4, 5]) for _ in range(15)] for _ in range(2000)])
        assert sims.LineGame(m).win(screens).tolist() == [sum(d[0] for d in plain_lines(m, s)) for s in screens.tolist()]


def test_random_clusters():
    rng = random.Random(2)
    m = mode(6, 4, "cluster", SYMBOLS, [[0] * 8, [0] * 8, [0] * 8] + [[0, 0, 1, 2, 3, 4, 5, 6 + k] for k in range(3)])
    screens = [[rng.choice([0, 1, 2, 3, 3, 4, 5]) for _ in range(24)] for _ in range(500)]
    wins, hit, found = Clusters(m).score(np.array(screens))
    got = [[] for _ in screens]
    for rows, s, _, pays, bits in found:
        for r, sym, p, b in zip(rows.tolist(), s.tolist(), pays.tolist(), bits.tolist(), strict=True):
            got[r].append((p, sym, [k for k in range(24) if b >> k & 1]))
    plain = [plain_clusters(m, s) for s in screens]
    assert [sorted(g) for g in got] == [sorted(p) for p in plain]
    assert wins.tolist() == [sum(x[0] for x in p) for p in plain]
    assert [{k for k in range(24) if b >> k & 1} for b in hit.tolist()] == [set().union(*(x[2] for x in p)) for p in plain]


def test_odd_boards_and_multipliers(spark):
    m = mode(3, 1, "line_ltr", ["H1", "W1"], [[0, 2, 9], [0, 0, 0]], [[0, 0, 0]])
    df = spark.createDataFrame([(0, [0, 1, 0], 3), (1, None, 2), (2, [0, 0], 2), (3, [0, None, 0], 2), (4, [0, 0, 7], None), (5, [0, 0, -1], 1), (6, [0, 0, 0, 0], 1)], "id long, board array<int>, m int")
    out = boards.score_boards(df, m, bet_mult=F.col("m")).orderBy("id").collect()
    assert [r.win for r in out] == [27, 0, 4, 0, 2, 2, 9] and out[0].details[0].hits == [0, 1, 2]
    assert boards.score_boards(df, m, details=False).columns == ["id", "board", "m", "win"]
    with pytest.raises(ValueError):
        boards.score_boards(df, dataclasses.replace(m, bet_type="none"))


def test_nothing_paid(spark):
    m = mode(3, 1, "line_ltr", ["H1"], [[0, 0, 0]], [[0, 0, 0]])
    assert native(spark, m, [[0, 0, 0]]) == [[]]
    assert native(spark, dataclasses.replace(m, bet_type="way_ltr"), [[0, 0, 0]]) == [[]]
    assert native(spark, dataclasses.replace(m, bet_type="count"), [[0, 0, 0]]) == [[]]


def test_transforms(spark):
    one = spark.range(1)
    arr = lambda v: F.array(*map(F.lit, v)).cast("array<short>")
    row = one.select(
        boards.clear(arr([1, 2, 3]), F.array(F.lit(0), F.lit(2), F.lit(10))).alias("clear"),
        boards.gravity(arr([1, 0, 2, 0, 3, 0, 4, 0, 5]), 3, 3).alias("fallen"),
    ).first()
    assert list(row.clear) == [0, 2, 0] and list(row.fallen) == [0, 0, 0, 1, 0, 2, 4, 3, 5]
    filled = one.select(boards.fill(arr(row.fallen), [[7, 8, 9]] * 3, F.array(*[F.lit(0)] * 3), 3, 3).alias("f"), boards.fill_index(arr(row.fallen), 3, 3).alias("i")).first()
    assert list(filled.i) == [0, 4, 2]
    assert list(filled.f.board) == [9, 8, 9, 1, 9, 2, 4, 3, 5] and list(filled.f.positions) == [2, 1, 2]
    holes = one.select(boards.fill(arr([1, 0, 0, 2]), [[5], [6]], F.array(F.lit(0), F.lit(0)), 2, 2).alias("f")).first()
    assert list(holes.f.board) == [1, 6, 5, 2]
    full = one.select(boards.fill_index(arr([1, 1, 1, 1]), 2, 2).alias("i")).first()
    assert all(x < 0 for x in full.i)


def test_numpy_and_native_refill_agree(spark):
    rng = np.random.default_rng(1)
    reels = [[1 + (i * 3 + c) % 5 for i in range(6 + c)] for c in range(3)]
    screens = rng.integers(0, 4, (50, 9)).astype(np.int16)
    pos = np.stack([rng.integers(0, len(r), 50) for r in reels], 1)
    df = spark.createDataFrame([(i, s.tolist(), p.tolist()) for i, (s, p) in enumerate(zip(screens, pos, strict=True))], "id long, board array<short>, pos array<int>")
    dropped = df.select("id", boards.gravity(F.col("board"), 3, 3).alias("b"), "pos")
    out = dropped.select("id", boards.fill(F.col("b"), reels, F.col("pos"), 3, 3).alias("f")).orderBy("id").collect()

    class Fake:
        strips = [None, [np.array(r) for r in reels]]

    own = pos.copy()
    mine = sims._fall_and_fill(screens.copy(), Fake, own, 3, 3)
    assert [list(r.f.board) for r in out] == mine.tolist() and [list(r.f.positions) for r in out] == own.tolist()
