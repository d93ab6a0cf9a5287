"""Reports as JSON, as YAML with innermost lists on one line, and as text tables."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import yaml


def to_json(report: Mapping[str, Any]) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2)


class _Dumper(yaml.SafeDumper):
    pass


def _list(dumper: yaml.SafeDumper, data: Sequence[Any]):
    flat = not any(isinstance(x, list | tuple | dict) for x in data)
    return dumper.represent_sequence("tag:yaml.org,2002:seq", data, flow_style=flat)


_Dumper.add_representer(list, _list)
_Dumper.add_representer(tuple, _list)


def to_yaml(report: Mapping[str, Any]) -> str:
    return yaml.dump(dict(report), Dumper=_Dumper, allow_unicode=True, sort_keys=False)


def width(text: str) -> int:
    """Columns that a text takes in a terminal; wide characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def thousands(x: int) -> str:
    return f"{x:,}"


def percent(x: float) -> str:
    return f"{100 * x:.2f}%"


def percent_interval(x: float, lo: float, hi: float) -> str:
    return f"{percent(x)} [{percent(lo)}, {percent(hi)}]"


def duration(seconds: float) -> str:
    minutes, rest = divmod(seconds, 60)
    hours, minutes = divmod(int(minutes), 60)
    return f"{hours}h {minutes}m {rest:.2f}s" if hours else f"{minutes}m {rest:.2f}s" if minutes else f"{rest:.2f}s"


def table(rows: Sequence[Sequence[str]]) -> str:
    """Left-aligned columns between bars."""
    most = [max(width(r[i]) for r in rows) for i in range(len(rows[0]))] if rows else []
    rule = "+" + "+".join("-" * (m + 2) for m in most) + "+"
    body = ["| " + " | ".join(x + " " * (m - width(x)) for x, m in zip(r, most, strict=True)) + " |" for r in rows]
    return "\n".join([rule, *body, rule])


def report_text(name: str, r: Mapping[str, Any]) -> str:
    """A one-row summary as text."""
    rows = [
        ("game", name),
        ("rounds", thousands(r["rounds"])),
        ("RTP", percent(r["rtp"])),
        ("RTP 95% CI", f"[{percent(r['ci_lo'])}, {percent(r['ci_hi'])}]"),
        ("total bet / win", f"{thousands(r['total_bet'])} / {thousands(r['total_win'])}"),
        ("base / free win", f"{thousands(r['base_win'])} / {thousands(r['free_win'])}"),
        ("no-win rounds / triggers", f"{thousands(r['no_win_rounds'])} / {thousands(r['triggers'])}"),
        ("STD / CV", f"{r['std']:.3f} / {r['cv']:.3f}"),
    ]
    return table(rows)


def buckets_text(rows: Sequence[Mapping[str, Any]]) -> str:
    """The distribution of wins as a text table: each bucket's share of all, base and free wins."""
    body = [(r["label"], *(f"{thousands(r[f'{k}_n'])} ({percent(r[f'{k}_share'])})" for k in ("total", "base", "free"))) for r in rows]
    return table([("win / bet", "total", "base", "free"), *body])


TIMES = ("0 times", "1 time", "2 times", "3+ times")
QUANTILE_NAMES = {"p50": "Median RTP", "p10": "P10 RTP", "p33": "P33 RTP", "p67": "P67 RTP", "p90": "P90 RTP"}


def study_text(study: Mapping[str, Sequence[Mapping[str, Any]]]) -> str:
    """A player study (quantiles, cdf, triggers, buckets, sessions) as sections, each share with its interval."""
    share = lambda r: percent_interval(r["share"], r["lo"], r["hi"])
    by_name = {r["name"]: r for r in study["quantiles"]}
    rtp = [(label, percent_interval(by_name[k]["value"], by_name[k]["lo"], by_name[k]["hi"])) for k, label in QUANTILE_NAMES.items() if k in by_name]
    rtp += [(f"\u2264{100 * r['mark']:.0f}% RTP (players)", share(r)) for r in sorted(study["cdf"], key=lambda r: r["mark"])]
    counts = [(TIMES[r["times"]], share(r)) for r in sorted(study["triggers"], key=lambda r: r["times"])]
    buckets: dict[tuple[int, str], list[str]] = {}
    for r in sorted(study["buckets"], key=lambda r: (r["bucket"], r["times"])):
        buckets.setdefault((r["bucket"], r["label"]), []).append(f"{TIMES[r['times']]}: {percent(r['share'])}")
    sections = {
        "RTP (player experience)": rtp,
        "Trigger counts per player": counts,
        "Wins per player in each bucket": [(label, ", ".join(x)) for (_, label), x in buckets.items()],
        "Session outcome": [(r["name"], share(r)) for r in study["sessions"]],
    }
    return "\n\n".join(f"{title}\n{table(rows)}" for title, rows in sections.items() if rows)


def render(kind: str, report: Mapping[str, Any], title: str = "") -> str:
    """A report as ``json``, ``yaml`` or ``text``; a registered renderer for any other kind."""
    if kind not in RENDERERS:
        raise ValueError(f"no renderer {kind!r}")
    return RENDERERS[kind](report, title)


def _text(report: Mapping[str, Any], title: str) -> str:
    if "quantiles" in report:
        return study_text(report)
    parts = [report_text(title, report.get("summary", report))]
    return "\n".join([*parts, buckets_text(report["buckets"])] if report.get("buckets") else parts)


#: Renderers of reports by kind; add to it to have more.
RENDERERS: dict[str, Callable[[Mapping[str, Any], str], str]] = {"json": lambda r, _: to_json(r), "yaml": lambda r, _: to_yaml(r), "text": _text}


def estimate_text(rows: Sequence[Mapping[str, Any]]) -> str:
    """Estimates (name, value or share, lo, hi) as a text table."""
    return table([(r["name"], percent_interval(r.get("share", r.get("value")), r["lo"], r["hi"])) for r in rows])
