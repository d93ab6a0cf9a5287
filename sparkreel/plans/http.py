"""The engine's calls over HTTP: a thin layer on the standard library's server.

``GET`` takes arguments from the query string, ``POST`` from a JSON body.  Spark does the work, so requests are answered one at a time for each
thread and a long simulation is a Spark job like any other.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from ..errors import status_code
from ..sources.wire import MOST_BYTES
from .engine import MOST_CONFIG, Engine, ServiceError

#: Calls by path; with production set only those of the second row are there.
ROUTES = {"/v1/sim": "sim", "/v1/simplayer": "simplayer", "/v1/simbycfg": "simbycfg", "/v1/stat": "stat", "/dev/replay": "replay", "/dev/games": "games"}
PRODUCTION = {"/v1/spin": "spin", "/v1/health": "health"}
NUMBERS = frozenset("rounds players init_bets bet_mode seed spin_id gid".split())


def call(engine: Engine, path: str, query: str = "", body: bytes | None = None, production: bool = False) -> tuple[int, Any]:
    """(status, answer) of a request; the answer is what JSON is made of."""
    routes = PRODUCTION if production else ROUTES | PRODUCTION
    if path not in routes:
        return 404, {"error": "no such path"}
    name = routes[path]
    try:
        if name == "spin":
            args: dict[str, Any] = {"body": body} if body is not None else {"query": query}
        else:
            args = _arguments(query, body)
            if name == "stat":
                args = {"ledger": args}
            elif name in ("sim", "simplayer", "replay"):
                args["game"] = args.pop("gid") if "gid" in args else args.get("game", "")
        found = engine.service(name, **args)
        return 200, found if name == "games" else found[0]
    except (ValueError, KeyError, TypeError) as e:
        return status_code(e), {"error": str(e)}


def _arguments(query: str, body: bytes | None) -> dict[str, Any]:
    try:
        raw = json.loads(body) if body else dict(parse_qsl(query, keep_blank_values=True))
        if not isinstance(raw, dict):
            raise ServiceError("an object of arguments is needed")
        return {k: int(v) if k in NUMBERS and isinstance(v, str) else v for k, v in raw.items()}
    except ServiceError:
        raise
    except ValueError as e:
        raise ServiceError("the arguments can't be read") from e


def server(engine: Engine, port: int = 0, host: str = "127.0.0.1", production: bool = False) -> ThreadingHTTPServer:
    """A server for ``serve_forever``; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body: bytes | None) -> None:
            parts = urlsplit(self.path)
            status, out = call(engine, parts.path, parts.query, body, production)
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802  the base class's name
            self._answer(None)

        def do_POST(self) -> None:  # noqa: N802
            size = int(self.headers.get("Content-Length") or 0)
            if size > (MOST_CONFIG if self.path.startswith("/v1/simbycfg") else MOST_BYTES):
                self.send_error(413)
                return
            self._answer(self.rfile.read(size))

        def log_message(self, format: str, *args: Any) -> None:
            """Nothing: Spark's log has the jobs."""

    return ThreadingHTTPServer((host, port), Handler)
