"""Spin requests and results on the wire: strict schemas, decoding with an error column, flattening to acts and hits."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Warn
from ..functions.codec import decode_base64url, from_base64url

REQUEST = "uid string, game string, gid long, bet long, bet_mode int, bet_mult int, cycle int, choice int, has_choice boolean, start_state struct<start_b64u:string,cp:string>"
DETAIL = "struct<win:long,symbol:short,line:int,count:int,comb:int,direction:short,hits:array<short>>"
ACT = f"struct<acttype:string,id:int,round:int,step:int,act:int,is_round_end:boolean,is_step_end:boolean,nowtotalwin:long,roundaccwin:long,stepaccwin:long,actwin:long,screen:array<short>,ext:string,details:array<{DETAIL}>>"
MODE = f"struct<win:long,modeid:int,isend:boolean,trigger:int,acts:array<{ACT}>>"
STATE = "struct<start_b64u:string,after_b64u:string,cp:string>"
RESULT = f"game string, gameid long, win long, bet long, betmode int, betmult int, isend boolean, spin_state {STATE}, gamemodes array<{MODE}>"
#: The same as the fields of a struct.
RESULT_FIELDS = f"game:string,gameid:bigint,win:bigint,bet:bigint,betmode:int,betmult:int,isend:boolean,spin_state:{STATE},gamemodes:array<{MODE}>"
MOST_BYTES = 1 << 20
_NUMBERS = ("gid", "bet", "bet_mode", "bet_mult", "cycle", "choice")


class RequestError(Warn):
    """A request that can't be decoded."""


def decode_request(body: str | bytes | None = None, query: str | None = None) -> dict[str, Any]:
    """A request from a JSON body or a query string; unknown fields and oversized bodies are refused."""
    if body is not None:
        if len(body) > MOST_BYTES:
            raise RequestError("the body is too long")
        try:
            raw = json.loads(body)
        except ValueError as e:
            raise RequestError("the body is no JSON") from e
    else:
        flat = dict(parse_qsl(query or "", keep_blank_values=True))
        raw = {k: int(v) if k in _NUMBERS else v for k, v in flat.items() if k not in ("start_b64u", "cp", "has_choice")}
        if "has_choice" in flat:
            raw["has_choice"] = flat["has_choice"].lower() in ("1", "true")
        state = {k: flat[k] for k in ("start_b64u", "cp") if k in flat}
        if state:
            raw["start_state"] = state
    known = {f.strip().split(" ")[0] for f in REQUEST.split(", ")}
    if extra := sorted(set(raw) - known):
        raise RequestError(f"unknown fields: {', '.join(extra)}")
    return raw


#: Checkpoints by logic key: (text to value, value to text).  JSON unless a game registers its own.
CHECKPOINTS: dict[str, tuple[Callable[[str], Any], Callable[[Any], str]]] = {}


def register_checkpoint(logic_key: str, decode: Callable[[str], Any], encode: Callable[[Any], str]) -> None:
    """How a logic's checkpoints are read and written; a key can be registered once."""
    if logic_key in CHECKPOINTS:
        raise ValueError(f"{logic_key} has a checkpoint codec")
    CHECKPOINTS[logic_key] = (decode, encode)


def decode_checkpoint(logic_key: str, text: str | None) -> Any:
    """The value of a checkpoint's text; null for none."""
    if not text:
        return None
    try:
        return CHECKPOINTS.get(logic_key, (json.loads, json.dumps))[0](text)
    except (ValueError, KeyError, TypeError) as e:
        raise RequestError("the checkpoint can't be read") from e


def encode_checkpoint(logic_key: str, value: Any) -> str | None:
    return None if value is None else CHECKPOINTS.get(logic_key, (json.loads, json.dumps))[1](value)


def has_payload(state: Mapping[str, Any] | None) -> bool:
    return bool(state and (state.get("start_b64u") or state.get("cp")))


def parse_request(raw: Mapping[str, Any], logic_key: str = "") -> dict[str, Any]:
    """A decoded request with its snapshot as bytes and its checkpoint as the logic reads it; a choice needs ``has_choice``."""
    if raw.get("choice", 0) != 0 and not raw.get("has_choice", False):
        raise RequestError("a choice without has_choice")
    out = dict(raw)
    state = raw.get("start_state")
    if has_payload(state):
        try:
            out["snapshot"] = decode_base64url(state.get("start_b64u") or "")
            out["checkpoint"] = decode_checkpoint(logic_key, state.get("cp"))
        except ValueError as e:
            raise RequestError("the start state can't be read") from e
    return out


def read_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as request columns with ``error``: null, or why the request is refused."""
    row = F.from_json(F.col(column), f"{REQUEST}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    names = [f.strip().split(" ")[0] for f in REQUEST.split(", ")]
    keys = F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>"))
    rows = lines.select(row.alias("r"), F.array_except(keys, F.array(*map(F.lit, names))).alias("extra"), F.length(column).alias("size"))
    error = (
        F.when(F.col("size") > MOST_BYTES, F.lit("the body is too long"))
        .when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), F.lit("the body is no JSON"))
        .when(F.size("extra") > 0, F.concat(F.lit("unknown fields: "), F.array_join("extra", ", ")))
        .when((F.coalesce("r.choice", F.lit(0)) != 0) & ~F.coalesce("r.has_choice", F.lit(False)), F.lit("a choice without has_choice"))
    )
    snapshot = F.when(F.coalesce(F.length("r.start_state.start_b64u"), F.lit(0)) > 0, from_base64url(F.col("r.start_state.start_b64u")))
    return rows.select(*(F.col(f"r.{n}").alias(n) for n in names), snapshot.alias("snapshot"), error.alias("error"))


def spin_errors(game_id: Column, game: Column, bet: Column, bet_mode: Column, bet_mult: Column, own_id: int, own_name: str, bet_units: tuple[int, ...]) -> Column:
    """Null for a request that fits a game, else what is wrong."""
    unit = F.get(F.array(*map(F.lit, bet_units)), bet_mode)
    return (
        F.when(game_id != own_id, F.lit("wrong game id"))
        .when(F.lower(F.trim(game)) != own_name, F.lit("wrong game name"))
        .when((bet_mode < 0) | unit.isNull(), F.lit("no such bet mode"))
        .when(bet_mult * unit != bet, F.lit("the bet is no multiple of its unit"))
    )


def flatten_acts(results: DataFrame, key: str = "spin_id") -> DataFrame:
    """One row for each act: (key, mode, round, step, act, acttype, actwin, stepaccwin, roundaccwin, nowtotalwin, n_details)."""
    modes = results.select(key, F.posexplode("gamemodes").alias("mode", "m"))
    acts = modes.select(key, "mode", F.explode("m.acts").alias("a"))
    names = ("round", "step", "act", "acttype", "actwin", "stepaccwin", "roundaccwin", "nowtotalwin")
    return acts.select(key, "mode", *(F.col(f"a.{n}").alias(n) for n in names), F.size("a.details").alias("n_details"))


def flatten_details(results: DataFrame, key: str = "spin_id") -> DataFrame:
    """One row for each paid hit, with its act."""
    modes = results.select(key, F.posexplode("gamemodes").alias("mode", "m"))
    acts = modes.select(key, "mode", F.explode("m.acts").alias("a")).select(key, "mode", "a.round", "a.step", "a.act", F.inline("a.details"))
    return acts


def nest_acts(acts: DataFrame, key: str = "spin_id") -> DataFrame:
    """(key, mode, acts) with the acts of each mode as an array in order: the inverse of :func:`flatten_acts`."""
    names = [c for c in acts.columns if c not in (key, "mode")]
    return acts.groupBy(key, "mode").agg(F.array_sort(F.collect_list(F.struct("round", "step", "act", *(n for n in names if n not in ("round", "step", "act"))))).alias("acts"))


def to_result(ledger: DataFrame, game_name: str, game_id: int, bet_mode: int, bet_mult: int) -> DataFrame:
    """Ledger rows as slim result structs without acts; the snapshot is the spin id."""
    mode = F.struct(F.col("base_win").alias("win"), F.lit(0).alias("modeid"), F.lit(True).alias("isend"), F.col("trigger").alias("trigger"), F.array().cast(f"array<{ACT}>").alias("acts"))
    free = F.struct((F.col("total_win") - F.col("base_win")).alias("win"), F.lit(1).alias("modeid"), F.lit(True).alias("isend"), F.lit(0).alias("trigger"), F.array().cast(f"array<{ACT}>").alias("acts"))
    return ledger.select(
        "spin_id",
        F.lit(game_name).alias("game"),
        F.lit(game_id).cast("long").alias("gameid"),
        F.col("total_win").alias("win"),
        "bet",
        F.lit(bet_mode).alias("betmode"),
        F.lit(bet_mult).alias("betmult"),
        F.lit(True).alias("isend"),
        F.when(F.col("trigger") > 0, F.array(mode, free)).otherwise(F.array(mode)).alias("gamemodes"),
    )
