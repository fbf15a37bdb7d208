"""Filters: JSON, text, lambdas or expressions, as one expression tree."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from .errors import QueryError
from .expr.nodes import Call, Expr, Field, Lit, as_expr

_COMPARE = {"=": "==", "eq": "==", "equals": "==", "==": "==", "!=": "!=", "ne": "!=", "<>": "!=", ">": ">", "gt": ">", ">=": ">=", "gte": ">=", "<": "<", "lt": "<", "<=": "<=", "lte": "<="}
_LIKE = {"like": ("like", False), "not like": ("like", True), "ilike": ("ilike", False), "not ilike": ("ilike", True)}
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
_STAMP = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?\Z")


@dataclass(frozen=True)
class Filter:
    """A filter in any of its forms, kept until a query uses it."""

    filter: Any

    def to_expr(self) -> Expr:
        return as_filter(self.filter)


def typed(value: Any) -> Any:
    """Complete ISO dates and times become typed; other text stays text."""
    if isinstance(value, str):
        try:
            if _DATE.match(value):
                return dt.date.fromisoformat(value)
            if _STAMP.match(value):
                return dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return value
    return value


def field(name: str) -> Expr:
    if not isinstance(name, str) or not name:
        raise QueryError("a filter needs the name of a field")
    parts = name.removeprefix("_.").split(".")
    e: Expr = Field(parts[0])
    for p in parts[1:]:
        e = e[p]
    return e


def from_json(spec: Mapping[str, Any]) -> Expr:
    """The tree of {"field", "operator", "value" or "values"} or {"operator": AND or OR, "conditions": [...]}."""
    operator = spec.get("operator")
    if not isinstance(operator, str):
        raise QueryError("a filter needs an operator")
    if operator.upper() in ("AND", "OR"):
        conditions = spec.get("conditions")
        if not conditions:
            raise QueryError(f"{operator} needs conditions")
        parts = [as_filter(c) for c in conditions]
        out = parts[0]
        for p in parts[1:]:
            out = Call("&" if operator.upper() == "AND" else "|", (out, p))
        return out
    op = " ".join(operator.lower().split())
    f = field(spec.get("field", ""))
    if op in ("is null", "is not null"):
        if spec.get("value") is not None or spec.get("values") is not None:
            raise QueryError(f"{operator!r} takes no value")
        return Call("isnull" if op == "is null" else "notnull", (f,))
    if op in ("in", "not in"):
        values = spec.get("values", spec.get("value"))
        if values is None or isinstance(values, (str, bytes)) or not hasattr(values, "__iter__"):
            raise QueryError(f"{operator!r} needs a list of values")
        return Call("isin" if op == "in" else "notin", (f, tuple(Lit(typed(v)) for v in values)))
    if "value" not in spec or spec["value"] is None:
        raise QueryError(f"{operator!r} needs a value")
    if op in _COMPARE:
        return Call(_COMPARE[op], (f, Lit(typed(spec["value"]))))
    if op in _LIKE:
        name, negated = _LIKE[op]
        like = Call(name, (f, Lit(spec["value"])))
        return Call("not", (like,)) if negated else like
    raise QueryError(f"unknown filter operator {operator!r}")


def as_filter(p: Any) -> Expr:
    """The expression of a filter in any form."""
    if isinstance(p, Filter):
        return p.to_expr()
    if isinstance(p, Mapping):
        return from_json(p)
    if isinstance(p, str):
        from .expr.sandbox import parse

        return parse(p)
    if isinstance(p, Callable) and not isinstance(p, Expr):
        from .expr.nodes import SCOPE

        got = p(SCOPE)
        if isinstance(got, bool):
            raise QueryError("a filter gave a Python bool instead of an expression; compare fields with == and combine with & and |")
        return as_expr(got)
    return as_expr(p)


def conjuncts(spec: Any) -> list[Any]:
    """The conditions of a top-level AND, each by itself."""
    if isinstance(spec, Filter):
        return conjuncts(spec.filter)
    if isinstance(spec, Mapping) and str(spec.get("operator", "")).upper() == "AND":
        return [c for s in spec.get("conditions") or [] for c in conjuncts(s)]
    return [spec]
