"""Command line, HTTP and stdio tool-call surfaces of the engine.

    python -m srcgraph.service [--root DIR] [--db DIR] COMMAND ...
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from srcgraph.engine import Engine
from srcgraph.runtime import scratch
from srcgraph.schema import QuerySyntaxError
from srcgraph.sources import config, git


@dataclass(frozen=True)
class Call:
    """One capability: parameters (name -> (type, default); default ... is required) and what it runs."""

    run: Callable[..., object]
    params: dict[str, tuple[type, object]] = field(default_factory=dict)
    listed: bool = False
    help: str = ""


def _one(name: str) -> dict[str, tuple[type, object]]:
    return {name: (str, ...)}


_LIMIT, _STATE = {"limit": (int, 0)}, {"state": (str, "")}

CALLS: dict[str, Call] = {
    "index": Call(lambda e, incremental: e.index(incremental), {"incremental": (bool, False)}, help="index the source tree"),
    "search": Call(lambda e, q, kind, limit, hybrid: e.search(q, kind, limit, hybrid), {"q": (str, ...), "kind": (str, "")} | _LIMIT | {"hybrid": (bool, False)}, True, "ranked symbol search, or hybrid"),
    "semantic-search": Call(lambda e, q, kind, limit: e.search(q, kind, limit, True), {"q": (str, ...), "kind": (str, "")} | _LIMIT, True, "hybrid symbol search"),
    "symbols": Call(lambda e, file: e.file_symbols(file), _one("file"), True, "symbols of a file"),
    "definitions": Call(lambda e, name: e.definitions(name), _one("name"), True, "definitions of a name"),
    "references": Call(lambda e, name: e.references(name), _one("name"), True, "other declarations of a name"),
    "text": Call(lambda e, q, file, limit: e.text(q, file, limit), {"q": (str, ...), "file": (str, "")} | _LIMIT, True, "lines that hold a text"),
    "files": Call(lambda e, language: e.files(language), {"language": (str, "")}, True, "indexed files"),
    "imports": Call(lambda e, file: e.imports(file), _one("file"), True, "imports of a file"),
    "importers": Call(lambda e, source: e.importers(source), _one("source"), True, "files that import a source"),
    "stats": Call(lambda e: e.stats(), {}, help="numbers of files, symbols and imports"),
    "map": Call(lambda e: e.map(), {}, help="symbols by directory"),
    "explain": Call(lambda e, file: e.explain(file), _one("file"), help="what a file holds and who imports it"),
    "context": Call(lambda e, name: e.context(name), _one("name"), help="a symbol and what is around it"),
    "snapshot": Call(lambda e, q, limit: e.snapshot(q, limit), _one("q") | _LIMIT, help="files for a query"),
    "trace": Call(lambda e, **p: e.trace(p["from"], p["to"]), _one("from") | _one("to"), help="way between two symbols"),
    "git-files": Call(lambda e, state: e.git_files(state), _STATE, True, "changed files"),
    "git-diff": Call(lambda e, state, context: e.git_diff(state, context), _STATE | {"context": (int, 0)}, True, "changed hunks and snippets"),
    "snapshot-git": Call(lambda e, state, limit: e.snapshot_git(state, limit), _STATE | _LIMIT, help="changed files explained"),
    "diff-impact": Call(lambda e, file, depth: e.diff_impact(file, depth), _one("file") | {"depth": (int, 0)}, help="what a change of a file touches"),
    "diff-impact-git": Call(lambda e, state, depth: e.diff_impact_git(state, depth), _STATE | {"depth": (int, 0)}, True, "what the changed files touch"),
}
#: Names on the command line and of tools that differ, routes that do, and commands without one.
ALIASES = {"find-def": "definitions", "find-refs": "references"}
ROUTES = {"git/files": "git-files", "git/diff": "git-diff"}
NO_ROUTE = {"files", *ROUTES.values()}


class BadRequestError(ValueError):
    pass


def _arguments(call: Call, given: dict[str, object]) -> dict[str, object]:
    out = {}
    for name, (kind, default) in call.params.items():
        value = given.get(name, "")
        if value in ("", None):
            if default is ...:
                raise BadRequestError(f"missing '{name}' parameter")
            out[name] = default
        elif kind is bool:
            out[name] = value is True or str(value).lower() == "true"
        elif kind is int:
            try:
                out[name] = int(value)
            except ValueError:
                out[name] = default
        else:
            out[name] = str(value)
    if "state" in out:
        try:
            git.parse_state(out["state"])
        except ValueError as e:
            raise BadRequestError(str(e)) from e
    return out


def invoke(engine: Engine, name: str, given: dict[str, object]) -> object:
    call = CALLS[ALIASES.get(name, name)]
    arguments = _arguments(call, given)
    # a server that runs for long must leave nothing behind
    with scratch():
        result = call.run(engine, **arguments)
    return {"results": result, "count": len(result)} if call.listed else result


# ---------------------------------------------------------------- HTTP
def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: object) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _serve(self, method: str) -> None:
            url = urlsplit(self.path)
            route = url.path.removeprefix("/api/")
            name = ROUTES.get(route, route)
            if not url.path.startswith("/api/") or name not in CALLS or route in NO_ROUTE:
                return self._send(404, {"error": "not found"})
            if (name == "index") != (method == "POST"):
                return self._send(405, {"error": "POST only" if name == "index" else "GET only"})
            try:
                self._send(200, invoke(engine, name, {k: v[0] for k, v in parse_qs(url.query).items()}))
            except BadRequestError as e:
                self._send(400, {"error": str(e)})
            except Exception as e:  # whatever fails is an answer here, not the end of the server
                self._send(500, {"error": str(e)})

        def do_GET(self) -> None:
            self._serve("GET")

        def do_POST(self) -> None:
            self._serve("POST")

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def serve(engine: Engine, port: int) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("", port), handler(engine))


# ---------------------------------------------------------------- tool calls
def tools() -> list[dict]:
    kind = {str: "string", int: "integer", bool: "boolean"}
    out, shown = [], {v: k for k, v in ALIASES.items()}
    for name, call in CALLS.items():
        props = {p: {"type": kind[t]} for p, (t, _) in call.params.items()}
        needed = [p for p, (_, d) in call.params.items() if d is ...]
        out.append({"name": shown.get(name, name).replace("-", "_"), "description": call.help, "inputSchema": {"type": "object", "properties": props, "required": needed}})
    return out


def answer(engine: Engine, request: dict) -> dict | None:
    """The reply to a JSON-RPC request; none to a notification."""
    method, params = request.get("method"), request.get("params") or {}
    reply: dict = {"jsonrpc": "2.0", "id": request.get("id")}
    if "id" not in request:
        return None
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "srcgraph", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": tools()}}
    if method == "tools/call":
        name = str(params.get("name", "")).replace("_", "-")
        if ALIASES.get(name, name) not in CALLS:
            return reply | {"error": {"code": -32602, "message": f"unknown tool: {params.get('name')}"}}
        try:
            given = dict(params.get("arguments") or {})
            if name == "search":
                given.setdefault("limit", 20)
            text, bad = json.dumps(invoke(engine, name, given), ensure_ascii=False, default=str), False
        except Exception as e:  # reported to the caller as a failed tool call
            text, bad = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": bad}}
    return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def stdio(engine: Engine, reader=sys.stdin, writer=sys.stdout) -> None:
    engine.index(True)
    for line in reader:
        if line.strip() and (reply := answer(engine, json.loads(line))) is not None:
            writer.write(json.dumps(reply, ensure_ascii=False) + "\n")
            writer.flush()


# ---------------------------------------------------------------- text output
def format_symbols(rows: list[dict]) -> str:
    return "".join(f"{r['name']:<40} {r['kind']:<10} {r['file_path']}:{r['line']}\n" for r in rows)


def format_matches(rows: list[dict]) -> str:
    return "".join(f"{r['file_path']}:{r['line']} {r['content']}\n" for r in rows)


def format_map(node: dict, depth: int = 0) -> str:
    row = f"{'  ' * depth}{node['path']}/ ({node['files']} files, {node['symbols']} symbols: {node['functions']} functions, {node['types']} types, {node['methods']} methods)\n"
    return row + "".join(format_map(c, depth + 1) for c in node.get("children", []))


def _text(name: str, result: object) -> str:
    rows = result["results"] if isinstance(result, dict) and "results" in result else None
    if name in ("search", "semantic-search", "symbols", "definitions", "references"):
        return format_symbols(rows) or "no results\n"
    if name == "text":
        return format_matches(rows) or "no results\n"
    if name == "map":
        return format_map(result)
    if name == "git-files":
        return "".join(f"{p}\n" for p in rows)
    return json.dumps(result, ensure_ascii=False, indent=2, default=str) + "\n"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="srcgraph")
    top.add_argument("--root", default="")
    top.add_argument("--db", default="")
    top.add_argument("--json", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    for name in (*CALLS, *ALIASES):
        call = CALLS[ALIASES.get(name, name)]
        p = sub.add_parser(name, help=call.help)
        for arg, (kind, default) in call.params.items():
            if default is ...:
                p.add_argument(arg)
            elif kind is bool:
                p.add_argument(f"--{arg}", action="store_true")
            else:
                p.add_argument(f"--{arg}", type=kind, default=3 if (name, arg) == ("git-diff", "context") else default)
    sub.add_parser("serve").add_argument("--port", type=int, default=0)
    sub.add_parser("mcp")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    try:
        settings = config.load(args.root)
    except config.ConfigNotFoundError:
        settings = config.Config()
    root = args.root or settings.root or "."
    spark = spark or SparkSession.builder.appName("srcgraph").getOrCreate()
    engine = Engine(spark, root, args.db or settings.db or f"{root}/.srcgraph")
    if args.command == "serve":
        serve(engine, args.port or settings.port or 9090).serve_forever()
        return 0
    if args.command == "mcp":
        stdio(engine)
        return 0
    name = ALIASES.get(args.command, args.command)
    try:
        result = invoke(engine, name, vars(args))
    except (BadRequestError, LookupError, QuerySyntaxError, git.GitError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    out.write(json.dumps(result, ensure_ascii=False, default=str) + "\n" if args.json else _text(name, result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
