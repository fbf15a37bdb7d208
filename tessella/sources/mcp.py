"""Models as tools of the Model Context Protocol: JSON-RPC 2.0, one message a line, over standard input and output or any pair of streams."""

from __future__ import annotations

import json
import sys
from collections.abc import Mapping
from typing import IO, Any

from ..errors import TessellaError
from ..model import SemanticTable
from .server import Service

PROTOCOL = "2025-06-18"
_TEXT, _LIST, _NUMBER = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer"}
_SPAN = {"type": "object", "properties": {"start": _TEXT, "end": _TEXT}}
_QUERY = {
    "model_name": _TEXT, "dimensions": _LIST, "measures": _LIST, "filters": {"type": "array", "items": {"type": "object"}}, "having": {"type": "array", "items": {"type": "object"}},
    "order_by": {"type": "array", "items": _LIST}, "limit": _NUMBER,
}
#: For each tool what it does, its arguments and which of them it needs.
TOOLS: dict[str, tuple[str, dict[str, Any], list[str]]] = {
    "list_models": ("The models and what they are about.", {}, []),
    "get_model": ("Dimensions and measures of a model.", {"model_name": _TEXT}, ["model_name"]),
    "get_time_range": ("First and last time of a model's data.", {"model_name": _TEXT}, ["model_name"]),
    "query_model": ("Measures by dimensions, filtered, ordered and limited.", {**_QUERY, "time_grain": _TEXT, "time_grains": {"type": "object"}, "time_range": _SPAN}, ["model_name"]),
    "compare_periods": ("Measures of two periods side by side.", {**_QUERY, "current_time_range": _SPAN, "previous_time_range": _SPAN, "time_dimension": _TEXT}, ["model_name", "measures", "current_time_range", "previous_time_range"]),
    "search_dimension_values": ("Values of a dimension that hold a term, most frequent first.", {"model_name": _TEXT, "dimension_name": _TEXT, "search_term": _TEXT, "limit": _NUMBER}, ["model_name", "dimension_name"]),
}


class McpServer:
    """Answers messages about a set of models."""

    def __init__(self, models: Mapping[str, SemanticTable], name: str = "tessella"):
        self.service, self.name = Service(models), name

    def answer(self, message: Mapping[str, Any]) -> dict[str, Any] | None:
        """The response to a request; None for a notification."""
        if "id" not in message:
            return None
        reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
        given = message.get("params") or {}
        method = message.get("method")
        if method == "initialize":
            return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": "1"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": a, "required": r}} for n, (d, a, r) in TOOLS.items()]}}
        if method == "tools/call":
            return reply | self._called(given.get("name"), given.get("arguments") or {})
        return reply | {"error": {"code": -32601, "message": f"no method {method!r}"}}

    def _called(self, tool: Any, arguments: Mapping[str, Any]) -> dict[str, Any]:
        if tool not in TOOLS:
            return {"error": {"code": -32602, "message": f"no tool {tool!r}"}}
        # some clients send lists and objects as JSON text
        known = {k: json.loads(v) if isinstance(v, str) and TOOLS[tool][1].get(k, _TEXT) is not _TEXT and v[:1] in "[{0123456789" else v for k, v in arguments.items()}
        try:
            text, failed = json.dumps(self.service.call(tool, known), default=str), False
        except (TessellaError, LookupError, ValueError, TypeError) as e:
            text, failed = str(e), True
        return {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}

    def serve(self, source: IO[str] | None = None, sink: IO[str] | None = None) -> None:
        """Answers line by line until the source ends."""
        source, sink = source or sys.stdin, sink or sys.stdout
        for line in source:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
            except ValueError:
                reply: dict[str, Any] | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
            else:
                reply = self.answer(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
            if reply is not None:
                sink.write(json.dumps(reply) + "\n")
                sink.flush()
