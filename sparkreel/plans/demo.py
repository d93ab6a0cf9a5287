"""Two small demonstration games, with reels made by a rule."""

from __future__ import annotations

from ..sources.config import Game, parse_game

# Symbols, pay rows of the line game's base and free modes by symbol, and its line table; pays of the cascade game's paid symbols
# in both modes, of 5 cells and more.
LINE_SYMBOLS = ("Z1", "C1", "W1", "H1", "H2", "H3", "L1", "L2", "L3", "L4", "L5")
LINE_PAYS = (
    (0, 0, 0, 0, 0),
    (0, 0, 0, 0, 0),
    (0, 0, 40, 400, 1600),
    (0, 0, 40, 400, 1600),
    (0, 0, 20, 280, 800),
    (0, 0, 20, 160, 600),
    (0, 0, 10, 80, 160),
    (0, 0, 10, 80, 160),
    (0, 0, 10, 80, 160),
    (0, 0, 10, 40, 120),
    (0, 0, 10, 40, 120),
)
LINE_FREE_PAYS = (
    (0, 0, 0, 0, 0),
    (0, 0, 0, 0, 0),
    (0, 0, 120, 1200, 4800),
    (0, 0, 120, 1200, 4800),
    (0, 0, 60, 900, 2400),
    (0, 0, 60, 480, 1800),
    (0, 0, 30, 240, 480),
    (0, 0, 30, 240, 480),
    (0, 0, 30, 240, 480),
    (0, 0, 30, 240, 360),
    (0, 0, 30, 240, 360),
)
LINES = (
    (1, 1, 1, 1, 1),
    (2, 2, 2, 2, 2),
    (0, 0, 0, 0, 0),
    (2, 1, 0, 1, 2),
    (1, 0, 0, 0, 1),
    (1, 0, 1, 2, 1),
    (0, 1, 0, 1, 0),
    (1, 2, 1, 0, 1),
    (0, 1, 1, 1, 0),
    (2, 2, 1, 0, 0),
    (1, 1, 0, 1, 1),
    (2, 1, 1, 1, 0),
    (0, 0, 1, 0, 0),
    (0, 0, 0, 1, 2),
    (1, 0, 0, 1, 2),
)
CASCADE_SYMBOLS = ("Z1", "C1", "W1", "H1", "H2", "H3", "H4", "L1", "L2", "L3")
CASCADE_PAYS = (
    (30, 48, 72, 120, 240, 360, 540, 750),
    (24, 36, 60, 90, 180, 300, 420, 540),
    (15, 30, 60, 72, 150, 240, 360, 480),
    (15, 30, 45, 60, 120, 210, 300, 420),
    (10, 20, 30, 45, 75, 150, 240, 360),
    (10, 20, 30, 45, 75, 150, 240, 330),
    (10, 20, 30, 45, 75, 150, 240, 300),
)
CASCADE_FREE_PAYS = (
    (120, 150, 240, 540, 750, 1000, 1250, 1500),
    (90, 120, 180, 420, 540, 750, 1000, 1250),
    (60, 90, 150, 360, 480, 600, 750, 1000),
    (60, 90, 150, 300, 420, 540, 750, 1000),
    (40, 60, 120, 240, 360, 480, 600, 840),
    (40, 60, 120, 240, 330, 480, 600, 840),
    (40, 60, 120, 240, 300, 480, 600, 840),
)


def _reel(column: int, length: int, low: int, high: int, scatters: int, wilds: int) -> list[int]:
    """A strip of paid symbols low..high in a fixed scatter, the lower the rarer, with scatters (1) and wilds (2) spread over it."""
    span = high - low + 1
    strip = [low + max((i * 7 + column * 3 + i * i % 5) % span, (i * 5 + column) % span) for i in range(length)]
    for k in range(scatters):
        strip[(k * length // max(scatters, 1) + 3 * column) % length] = 1
    for k in range(wilds):
        strip[(k * length // max(wilds, 1) + 5 * column + 2) % length] = 2
    return strip


def _mode(symbols, pays, columns, rows, hit, sets) -> dict:
    groups = [{"weight": w, "reels": [{"symbols": r} for r in reels]} for w, reels in sets]
    return {
        "screen_setting": {"columns": columns, "rows": rows},
        "gen_screen_setting": {"gen_reel_type": "GenReelByReelIdx", "reel_set_group": groups},
        "symbol_setting": {"symbol_used": list(symbols), "pay_table": [list(p) for p in pays]},
        "hit_setting": hit,
    }


def line_game(bet_type: str = "line_ltr") -> Game:
    hit = {"bet_type": bet_type, "line_table": [list(x) for x in LINES]}
    base = [_reel(c, 80, 3, 10, 4, 3 if c else 1) for c in range(5)]
    free = [_reel(c, 70, 3, 10, 0, 4) for c in range(5)]
    modes = [_mode(LINE_SYMBOLS, LINE_PAYS, 5, 3, hit, [(1, base)]), _mode(LINE_SYMBOLS, LINE_FREE_PAYS, 5, 3, hit, [(1, free)])]
    return parse_game({"game_id": 0, "game_name": "demo_normal", "logic_key": "demo_normal", "bet_units": [40], "max_win_limit": 400000, "game_mode_settings": modes, "fixed": {"free_round": 10}})


def cluster_pays(rows: tuple[tuple[int, ...], ...]) -> list[list[int]]:
    """Pay rows of 25 cells for all symbols: three that pay nothing, then nothing under 5 cells, the given pays, and their last one for more."""
    return [[0] * 25] * 3 + [[0] * 4 + list(r) + [r[-1]] * (21 - len(r)) for r in rows]


def cascade_game() -> Game:
    def mode(pays: tuple, scatters: int) -> dict:
        show = [_reel(c, 57 + 2 * c, 3, 9, scatters, 1) for c in range(5)]
        refill = [_reel(c, 33, 3, 9, scatters // 2, 2) for c in range(5)]
        return _mode(CASCADE_SYMBOLS, cluster_pays(pays), 5, 5, {"bet_type": "cluster"}, [(1, show), (0, refill)])

    fixed = {"max_step": 1000, "free_rounds": 10, "scatter_pay": 300, "trigger": 3}
    return parse_game({"game_id": 1, "game_name": "demo_cascade", "logic_key": "demo_cascade", "bet_units": [30], "max_win_limit": 600000, "game_mode_settings": [mode(CASCADE_PAYS, 2), mode(CASCADE_FREE_PAYS, 0)], "fixed": fixed})
