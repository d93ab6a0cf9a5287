"""Full results of spins: what a logic records, put together as nested modes, acts and details.

A logic records acts, many spins at a time, in any order.  :func:`assemble` sorts them, numbers rounds, steps and acts, adds up the running totals
and nests them, so that a spin's whole result is one row and no shuffle is needed.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa

from ..functions.codec import decode_base64url, encode_base64url
from ..operators.boards import ARROW_DETAIL, Found, found_details

ACT = pa.struct(
    [
        *((n, t) for n, t in (("acttype", pa.string()), ("id", pa.int32()), ("round", pa.int32()), ("step", pa.int32()), ("act", pa.int32()), ("is_round_end", pa.bool_()), ("is_step_end", pa.bool_()))),
        *((n, pa.int64()) for n in ("nowtotalwin", "roundaccwin", "stepaccwin", "actwin")),
        ("screen", pa.list_(pa.int16())),
        ("ext", pa.string()),
        ("details", pa.list_(ARROW_DETAIL)),
    ]
)
MODE = pa.struct([("win", pa.int64()), ("modeid", pa.int32()), ("isend", pa.bool_()), ("trigger", pa.int32()), ("acts", pa.list_(ACT))])
#: How a game's extension payload, a dictionary, becomes text; by logic key.  JSON unless a game registers its own.
RENDERERS: dict[str, Callable[[Any], str]] = {}


def register_renderer(logic_key: str, render: Callable[[Any], str]) -> None:
    """Render a logic's extension payloads by ``render``; a key can be registered once."""
    if logic_key in RENDERERS:
        raise ValueError(f"{logic_key} has a renderer")
    RENDERERS[logic_key] = render


@dataclass
class Acts:
    """Acts of one kind: of which spins (``row``), in which mode and round, in what order within the round, and what each of them holds.

    ``found`` are the hits of a scorer whose rows count these acts; ``win`` is the act's win, which need not be the sum of its hits.
    """

    kind: str
    row: np.ndarray
    mode: int
    round: np.ndarray | int
    order: int
    win: np.ndarray | int = 0
    screen: np.ndarray | None = None
    found: Sequence[Found] = ()
    ext: Sequence[Any] | None = None
    step_end: np.ndarray | bool = False
    widths: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.row)
        for name, kind in (("round", np.int64), ("win", np.int64), ("step_end", bool)):
            setattr(self, name, np.broadcast_to(np.asarray(getattr(self, name), kind), (n,)))
        self.widths = np.full(n, -1 if self.screen is None else self.screen.shape[1], np.int64)


def _running(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where ``starts`` is true (as it is at the first value)."""
    total = np.cumsum(values)
    return total - (total - values)[np.maximum.accumulate(np.where(starts, np.arange(len(values)), 0))]


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _screens(parts: Sequence[Acts], by: np.ndarray) -> pa.Array:
    """Lists of cells in sorted order; null for acts without a screen."""
    pool = np.concatenate([np.zeros(0, np.int16), *(p.screen.ravel().astype(np.int16) for p in parts if p.screen is not None)])
    width = np.concatenate([p.widths for p in parts])
    size = np.maximum(width, 0)
    start = np.cumsum(size) - size
    size, none, start = size[by], (width < 0)[by], start[by]
    offsets = np.concatenate([[0], np.cumsum(size)])
    values = pool[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(none, False)), pa.array(values))


def assemble(parts: Sequence[Acts], n: int, triggers: dict[int, np.ndarray], logic_key: str = "") -> pa.Array:
    """Lists of MODE for ``n`` spins; ``triggers`` are the trigger counts of the spins by mode.

    The last act of a round ends its round and step; other acts end their step where they say so.  A spin without acts has no modes.
    """
    parts = [p for p in parts if len(p.row)]
    if not parts:
        return pa.array([[]] * n, pa.list_(MODE))
    row, round_, win, step_end = (np.concatenate([getattr(p, c) for p in parts]) for c in ("row", "round", "win", "step_end"))
    size = [len(p.row) for p in parts]
    mode, order = (np.repeat([getattr(p, c) for p in parts], size) for c in ("mode", "order"))
    by = np.lexsort((order, round_, mode, row))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    row_s, mode_s, round_s, win_s = row[by], mode[by], round_[by], win[by]
    new_mode = _changes(row_s, mode_s)
    new_round = new_mode | _changes(round_s)
    round_end = np.append(new_round[1:], True)
    ends = step_end[by] | round_end
    new_step = new_round | np.append(True, ends[:-1])
    at = np.arange(len(by))
    since = lambda starts: at - np.maximum.accumulate(np.where(starts, at, 0))
    ints = {"id": since(new_mode), "round": _running(new_round.astype(np.int64), new_mode) - 1, "step": _running(new_step.astype(np.int64), new_round) - 1, "act": since(new_step)}
    totals = {"nowtotalwin": _running(win_s, new_mode), "roundaccwin": _running(win_s, new_round), "stepaccwin": _running(win_s, new_step), "actwin": win_s}
    first = np.cumsum([0, *size])
    wide = max([f.cells.shape[1] for p in parts for f in p.found], default=0)
    found = [f._replace(row=place[a + f.row], cells=np.pad(f.cells, ((0, 0), (0, wide - f.cells.shape[1])))) for p, a in zip(parts, first, strict=False) for f in p.found]
    render = RENDERERS.get(logic_key, lambda x: json.dumps(x, separators=(",", ":")))
    ext = np.array([None if x is None else render(x) for p in parts for x in (p.ext if p.ext is not None else [None] * len(p.row))], object)[by]
    kinds = np.repeat(np.array([p.kind for p in parts], object), size)[by]
    acts = pa.StructArray.from_arrays(
        [
            pa.array(kinds, pa.string()),
            *(pa.array(x.astype(np.int32)) for x in ints.values()),
            pa.array(round_end),
            pa.array(ends),
            *(pa.array(x) for x in totals.values()),
            _screens(parts, by),
            pa.array(ext, pa.string()),
            found_details(found, len(by)) if found else pa.array([[]] * len(by), pa.list_(ARROW_DETAIL)),
        ],
        fields=list(ACT),
    )
    begins = np.flatnonzero(new_mode)
    owner, number = row_s[begins], mode_s[begins]
    win_of = np.add.reduceat(win_s, begins)
    trigger = np.zeros(len(begins), np.int32)
    for m, count in triggers.items():
        trigger[number == m] = count[owner[number == m]]
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(by)).astype(np.int32)), acts)
    modes = pa.StructArray.from_arrays([pa.array(win_of), pa.array(number.astype(np.int32)), pa.array(np.ones(len(begins), bool)), pa.array(trigger), lists], fields=list(MODE))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), modes)


def snapshot(seed: int, spin_id: int) -> str:
    """What it takes to play a spin again, as text: its seed and its number."""
    return encode_base64url(struct.pack("<qq", seed, spin_id))


def restore(text: str) -> tuple[int, int] | None:
    """(seed, spin id) of a snapshot; null if it is none."""
    try:
        data = decode_base64url(text)
    except ValueError:
        return None
    return struct.unpack("<qq", data) if len(data) == 16 else None
