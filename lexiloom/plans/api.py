"""The service over HTTP and over a line-based tool protocol, with the standard library alone."""

from __future__ import annotations

import json
import re
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl

from lexiloom.plans.service import TOOLS, RepairService, SessionNotFound, UnknownTool

#: Method, path and what it calls; {id} is a session.
ROUTES = [
    ("GET", "/health", lambda s, b: s.health()), ("GET", "/tools", lambda s, b: s.tools()), ("GET", "/evalset", lambda s, b: s.evalset()), ("GET", "/evaluate", lambda s, b: s.evaluate(b.get("session_id"))),
    ("POST", "/search", lambda s, b: s.search(b["query"], b.get("k", 10), b.get("session_id"))), ("POST", "/analyze", lambda s, b: s.analyze(b["text"], b.get("session_id"))),
    ("POST", "/sessions", lambda s, b: {"session_id": s.open(b.get("target_query"))}), ("GET", "/sessions", lambda s, b: s.list_sessions()),
    ("GET", "/sessions/{id}", lambda s, b, i: s.describe(i)), ("DELETE", "/sessions/{id}", lambda s, b, i: s.delete(i)), ("POST", "/sessions/{id}/target", lambda s, b, i: s.pin_target(i, b["target_query"])),
    ("POST", "/sessions/{id}/tools", lambda s, b, i: s.call(i, b["tool"], b.get("arguments", {}))), ("POST", "/sessions/{id}/prescriptions", lambda s, b, i: s.submit(i, b)), ("GET", "/sessions/{id}/elasticsearch", lambda s, b, i: s.export(i)),
]


def answer(service: RepairService, method: str, path: str, body: dict) -> tuple[int, object]:
    """Status and payload: 201 for a new session, 404 for absent sessions and tools, 400 for bad requests, 202 for a rejected patch. Words after ? join the body."""
    path, _, asked = path.partition("?")
    body = dict(parse_qsl(asked)) | body
    for m, pattern, call in ROUTES:
        hit = re.fullmatch(pattern.replace("{id}", "([^/]+)"), path)
        if m != method or not hit:
            continue
        try:
            out = call(service, body, *hit.groups())
        except (SessionNotFound, UnknownTool) as e:
            return 404, {"error": f"not found: {e}"}
        except LookupError as e:
            return 400 if isinstance(e, KeyError) else 404, {"error": str(e)}
        except ValueError as e:
            return 400, {"error": str(e)}
        if isinstance(out, dict) and out.get("is_error"):
            return 400, {"error": out["content"]}
        rejected = path.endswith("/prescriptions") and not out["content"]["accepted"]
        return 202 if rejected else 201 if (method, path) == ("POST", "/sessions") else 200, out
    return 404, {"error": "no such route"}


def serve(service: RepairService, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't started yet; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                status, out = answer(service, self.command, self.path, body)
            except json.JSONDecodeError as e:
                status, out = 400, {"error": str(e)}
            data = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


class ToolProtocol:
    """JSON-RPC by lines: initialize, tools/list, tools/call. One session per process, opened by open_target."""

    def __init__(self, service: RepairService) -> None:
        self.service, self.session = service, None

    def tools(self) -> list[dict]:
        own = [
            {"name": "open_target", "description": "Starts treating a failing query.", "input_schema": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}},
            {"name": "list_failing_queries", "description": "The failing queries.", "input_schema": {"type": "object", "properties": {}}},
        ]
        return [{"name": t["name"], "description": t["description"], "inputSchema": t["input_schema"]} for t in [*TOOLS, *own]]

    def call(self, name: str, arguments: dict) -> dict:
        if name == "list_failing_queries":
            return {"is_error": False, "content": self.service.list_failing_queries()}
        if name == "open_target":
            try:
                self.session = self.service.open(arguments["query"])
            except LookupError as e:
                return {"is_error": True, "content": str(e)}
            return {"is_error": False, "content": {"session_id": self.session}}
        if self.session is None:
            return {"is_error": True, "content": "open a target first"}
        try:
            return self.service.call(self.session, name, arguments)
        except UnknownTool as e:
            return {"is_error": True, "content": f"unknown tool: {e}"}

    def handle(self, request: dict) -> dict | None:
        method, params, key = request.get("method"), request.get("params") or {}, request.get("id")
        if key is None:
            return None
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lexiloom", "version": "0.1.0"}}
        elif method == "tools/list":
            result = {"tools": self.tools()}
        elif method == "tools/call":
            out = self.call(params["name"], params.get("arguments") or {})
            result = {"content": [{"type": "text", "text": json.dumps(out["content"], ensure_ascii=False, default=str)}], "isError": out["is_error"]}
        else:
            return {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"unknown method: {method}"}}
        return {"jsonrpc": "2.0", "id": key, "result": result}

    def run(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip() and (reply := self.handle(json.loads(line))):
                out.write(json.dumps(reply, ensure_ascii=False) + "\n")
                out.flush()
