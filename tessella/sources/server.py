"""Models over HTTP, and as tools with JSON arguments. Standard library only; transport and tools share one set of functions."""

from __future__ import annotations

import datetime as dt
import hmac
import json
from collections.abc import Callable, Mapping
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlparse

from ..errors import TessellaError
from ..model import SemanticTable

MOST_ROWS = 100_000


def plain(x: Any) -> Any:
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    if isinstance(x, Decimal):
        return float(x)
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


class Service:
    """What a client may ask of a set of models."""

    def __init__(self, models: Mapping[str, SemanticTable]):
        self.models = dict(models)

    def model(self, name: str) -> SemanticTable:
        if name not in self.models:
            raise LookupError(f"no model {name!r}")
        return self.models[name]

    def list_models(self) -> dict[str, str]:
        return {n: m.description or f"model {n}" for n, m in self.models.items()}

    def get_model(self, model_name: str) -> dict[str, Any]:
        return self.model(model_name).json_definition

    def get_time_range(self, model_name: str) -> dict[str, Any]:
        return self.model(model_name).time_range()

    def search_dimension_values(self, model_name: str, dimension_name: str, search_term: str | None = None, limit: int = 20) -> dict[str, Any]:
        return plain(self.model(model_name).search_values(dimension_name, search_term, int(limit)))

    def _rows(self, result: Any, limit: int | None) -> dict[str, Any]:
        most = MOST_ROWS if limit is None else limit
        if not 0 <= most <= MOST_ROWS:
            raise ValueError(f"limit is 0 to {MOST_ROWS}")
        found = result.to_spark().limit(most).collect()  # at most MOST_ROWS rows
        return {"columns": list(result.to_spark().columns), "rows": [plain(r) for r in found], "row_count": len(found)}

    def query_model(self, model_name: str, dimensions: list[str] = (), measures: list[str] = (), limit: int | None = None, **kw: Any) -> dict[str, Any]:
        if kw.get("order_by"):
            kw["order_by"] = [tuple(o) for o in kw["order_by"]]
        return self._rows(self.model(model_name).query(dimensions, measures, **{k: v for k, v in kw.items() if v is not None}), limit)

    def compare_periods(self, model_name: str, limit: int | None = None, **kw: Any) -> dict[str, Any]:
        if kw.get("order_by"):
            kw["order_by"] = [tuple(o) for o in kw["order_by"]]
        return self._rows(self.model(model_name).compare_periods(**{k: v for k, v in kw.items() if v is not None}), limit)

    TOOLS = ("list_models", "get_model", "get_time_range", "query_model", "compare_periods", "search_dimension_values")

    def call(self, tool: str, arguments: Mapping[str, Any] | None = None) -> Any:
        """A tool by name, for agents."""
        if tool not in self.TOOLS:
            raise LookupError(f"no tool {tool!r}; known: {', '.join(self.TOOLS)}")
        return getattr(self, tool)(**dict(arguments or {}))

    def route(self, method: str, path: str, body: Mapping[str, Any]) -> Any:
        url = urlparse(path)
        parts = [unquote(p) for p in url.path.strip("/").split("/") if p]
        asked = {k: v[0] for k, v in parse_qs(url.query).items()}
        if method == "GET" and parts == ["health"]:
            return {"status": "ok"}
        if method == "GET" and parts == ["models"]:
            return {"models": self.list_models()}
        if method == "GET" and len(parts) == 3 and parts[0] == "models":
            if parts[2] == "schema":
                return self.get_model(parts[1])
            if parts[2] == "time-range":
                return self.get_time_range(parts[1])
        if method == "GET" and len(parts) == 5 and parts[0] == "models" and parts[2] == "dimensions" and parts[4] == "values":
            return self.search_dimension_values(parts[1], parts[3], asked.get("search"), int(asked.get("limit", 20)))
        if method == "POST" and parts in (["query"], ["compare-periods"]):
            given = dict(body)
            name = given.pop("model", None) or given.pop("model_name", None)
            return (self.query_model if parts == ["query"] else self.compare_periods)(name, **given)
        raise LookupError(f"nothing at {method} {url.path}")


def server(models: Mapping[str, SemanticTable], host: str = "127.0.0.1", port: int = 0, api_key: str | None = None, allow: Callable[[Mapping[str, str]], bool] | None = None) -> ThreadingHTTPServer:
    """An HTTP server over models; start it with serve_forever(). With api_key, requests carry it as X-API-Key."""
    service = Service(models)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, data: Any) -> None:
            raw = json.dumps(data, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def handle_one(self, method: str) -> None:
            if api_key is not None and not hmac.compare_digest(self.headers.get("X-API-Key", ""), api_key) or allow is not None and not allow(self.headers):
                self.answer(401, {"error": "not allowed"})
                return
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                self.answer(200, service.route(method, self.path, json.loads(raw) if raw else {}))
            except LookupError as e:
                self.answer(400 if isinstance(e, TessellaError) else 404, {"error": str(e)})
            except (TessellaError, ValueError, TypeError) as e:
                self.answer(400, {"error": str(e)})

        def do_GET(self) -> None:  # noqa: N802
            self.handle_one("GET")

        def do_POST(self) -> None:  # noqa: N802
            self.handle_one("POST")

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
