"""A store over HTTP, read only, and as tools over standard input and output.

``python -m veritrail.serve --store PATH --workspace NAME http [--host H --port P --allow-anonymous]`` (the key is
read from VERITRAIL_API_KEY) or ``... tools``.
"""

from __future__ import annotations

import argparse
import hmac
import json
import os
import sys
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, NamedTuple, TextIO
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession

from . import verbs
from .errors import EngineError
from .store import Store

LOOPBACK = ("127.0.0.1", "::1", "localhost")
#: Path -> verb and the query fields that it takes; chains are walked five levels deep.
ROUTES = {
    "/api/at": ("at", ("validAt", "asOf"), {}),
    "/api/evidence": ("evidence", ("edge",), {}),
    "/api/why": ("why", ("id", "direction"), {"depth": 5}),
    "/api/view": ("view", ("id",), {}),
}
REQUIRED = {"/api/at": "validAt", "/api/evidence": "edge", "/api/why": "id", "/api/view": "id"}


class Access(NamedTuple):
    host: str = "127.0.0.1"
    key: str | None = None
    anonymous: bool = False

    def refusal(self, shown: str | None) -> tuple[int, str] | None:
        """Why a request is refused: beyond the loopback without a key all are, unless that was asked for."""
        if self.host in LOOPBACK or self.anonymous:
            return None
        if not self.key:
            return 503, f"bound to {self.host} without an API key: set one, bind to the loopback, or allow anonymous access"
        if shown is None:
            return 401, "the header X-API-Key is required"
        return None if hmac.compare_digest(shown.encode(), self.key.encode()) else (401, "X-API-Key does not match")

    def warning(self) -> str | None:
        if self.host in LOOPBACK:
            return None
        if self.anonymous:
            return f"WARNING: bound to {self.host} with anonymous access: whoever reaches this port can read the whole store"
        return f"bound to {self.host}: every request needs X-API-Key" if self.key else f"WARNING: bound to {self.host} without an API key: every request is refused"


def answer(store: Store, access: Access, method: str, target: str, shown: str | None = None) -> tuple[int, Any]:
    """(status, body) of a request."""
    if method != "GET":
        return 405, {"error": "read only"}
    if (refused := access.refusal(shown)) is not None:
        return refused[0], {"error": refused[1]}
    url = urlsplit(target)
    if url.path == "/api/health":
        return 200, {"ok": True}
    fields = dict(parse_qsl(url.query))
    try:
        if url.path == "/api/graph":
            return 200, verbs.graph(store)
        if url.path not in ROUTES:
            return 404, {"error": "no such route"}
        if REQUIRED[url.path] not in fields:
            return 400, {"error": f"{REQUIRED[url.path]} is required"}
        name, takes, fixed = ROUTES[url.path]
        return 200, verbs.ask(store, name, {k: v for k, v in fields.items() if k in takes} | fixed)
    except (EngineError, verbs.BadArguments, ValueError) as e:
        return 400, {"error": str(e)}


def http(store: Store, access: Access, port: int = 4321) -> ThreadingHTTPServer:
    """A server that is bound and not yet started."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            status, body = answer(store, access, self.command, self.path, self.headers.get("X-API-Key"))
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(data)

        do_GET = do_HEAD = do_POST = do_PUT = do_DELETE = do_PATCH = do_OPTIONS = reply

        def log_message(self, *args: Any) -> None:
            """Requests may name records; none is logged."""

    return ThreadingHTTPServer((access.host, port), Handler)


_JSON = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", list: "array"}


def _schema(verb: verbs.Verb) -> dict:
    fields = {}
    for name, (kind, default) in verb.takes.items():
        fields[name] = {"type": _JSON[kind]} | ({"default": default} if default not in (..., None) else {})
        if name in verb.bounds:
            fields[name] |= dict(zip(("minimum", "maximum"), verb.bounds[name], strict=True))
    return {"type": "object", "properties": fields, "required": [k for k, (_, default) in verb.takes.items() if default is ...], "additionalProperties": False}


def _listed() -> dict:
    return {"tools": [{"name": k, "description": v.says, "inputSchema": _schema(v), "annotations": {"readOnlyHint": not v.writes}} for k, v in verbs.VERBS.items()]}


def _called(store: Store, params: Mapping[str, Any]) -> dict:
    try:
        text, failed = json.dumps(verbs.ask(store, params.get("name", ""), params.get("arguments") or {})), False
    except (EngineError, verbs.BadArguments) as e:
        text, failed = str(e), True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def respond(store: Store, message: Any) -> dict | None:
    """The answer to one JSON-RPC message of the model context protocol; none to a notification."""
    if not isinstance(message, dict) or "method" not in message:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
    if "id" not in message:
        return None
    methods: dict[str, Callable[[Mapping[str, Any]], dict]] = {
        "initialize": lambda p: {"protocolVersion": p.get("protocolVersion", "2025-03-26"), "capabilities": {"tools": {}}, "serverInfo": {"name": "veritrail", "version": "0.2.0"}},
        "ping": lambda p: {},
        "tools/list": lambda p: _listed(),
        "tools/call": lambda p: _called(store, p),
    }
    method = methods.get(message["method"])
    if method is None:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no such method: {message['method']}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": method(message.get("params") or {})}


def tools(store: Store, source: TextIO, sink: TextIO) -> None:
    """Answers one message a line until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            out = respond(store, json.loads(line))
        except json.JSONDecodeError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if out is not None:
            print(json.dumps(out), file=sink, flush=True)


def main(argv: list[str]) -> int:
    top = argparse.ArgumentParser(prog="veritrail.serve")
    top.add_argument("--store", required=True)
    top.add_argument("--workspace", required=True)
    top.add_argument("surface", choices=("http", "tools"))
    top.add_argument("--host", default="127.0.0.1")
    top.add_argument("--port", type=int, default=4321)
    top.add_argument("--allow-anonymous", action="store_true")
    a = top.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.store, a.workspace)
    if a.surface == "tools":
        tools(store, sys.stdin, sys.stdout)
        return 0
    access = Access(a.host, os.environ.get("VERITRAIL_API_KEY"), a.allow_anonymous)
    if (said := access.warning()) is not None:
        print(said, file=sys.stderr)
    http(store, access, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
