"""Expressions and definitions as JSON and back."""

from __future__ import annotations

import datetime as dt
from dataclasses import fields
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame

from ..errors import SerializationError
from . import nodes
from .nodes import Expr, as_expr

VERSION = 1
_KINDS = {c.__name__: c for c in (nodes.Field, nodes.Attr, nodes.Lit, nodes.Call, nodes.Agg, nodes.WinFunc, nodes.Over, nodes.Total, nodes.Named, nodes.Window, nodes.SortKey)}
_SCALARS = {"date": dt.date.fromisoformat, "datetime": dt.datetime.fromisoformat, "decimal": Decimal, "time": dt.time.fromisoformat}


def to_data(x: Any) -> Any:
    """Plain data of an expression."""
    if isinstance(x, nodes.Raw):
        raise SerializationError("a raw Spark column can't be written")
    if _kind(type(x).__name__) and isinstance(x, (Expr, nodes.Window, nodes.SortKey)):
        return {"node": type(x).__name__, **{f.name: to_data(getattr(x, f.name)) for f in fields(x)}}
    if isinstance(x, tuple):
        return {"tuple": [to_data(i) for i in x]}
    if isinstance(x, dt.datetime):
        return {"datetime": x.isoformat()}
    if isinstance(x, dt.date):
        return {"date": x.isoformat()}
    if isinstance(x, dt.time):
        return {"time": x.isoformat()}
    if isinstance(x, Decimal):
        return {"decimal": str(x)}
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise SerializationError(f"{type(x).__name__} can't be written")


def from_data(x: Any) -> Any:
    """The expression of plain data; only known nodes are made."""
    if isinstance(x, dict):
        if "node" in x:
            kind = _kind(x["node"]) if isinstance(x["node"], str) else None
            if kind is None:
                raise SerializationError(f"unknown node {x['node']!r}")
            known = {f.name for f in fields(kind)}
            if set(x) - {"node"} - known:
                raise SerializationError(f"unknown fields of {x['node']!r}")
            return kind(**{k: from_data(v) for k, v in x.items() if k != "node"})
        if "tuple" in x:
            return tuple(from_data(i) for i in x["tuple"])
        for k, f in _SCALARS.items():
            if k in x:
                return f(x[k])
        raise SerializationError("unknown data")
    return x


def _kind(name: str):
    """The class of a node name; sides of join predicates and parameters are defined elsewhere."""
    from ..plans.tree import Side

    return _KINDS.get(name) or {"Side": Side, "Param": nodes.Param, "CaseBuilder": nodes.CaseBuilder}.get(name)


def _fields(dims: dict, measures: dict, filters: Any) -> dict[str, Any]:
    out = {}
    for n, d in dims.items():
        if d.metadata and any(k in d.metadata for k in ("expr", "derived_dimensions")):
            raise SerializationError(f"metadata of {n!r} has a reserved name")
        out[n] = {**d.to_json(), "derived_dimensions": list(d.derived_dimensions), "is_time_dimension": d.is_time_dimension, "smallest_time_grain": d.smallest_time_grain, "expr": to_data(as_expr(d.expr))}
    return {"dimensions": out, "measures": {n: {**m.to_json(), "prefer_measures": m.prefer_measures, "expr": to_data(as_expr(m.expr))} for n, m in measures.items()}, "filters": [to_data(f) for f in filters]}


def _node_to_data(node: Any) -> dict[str, Any]:
    from ..plans.tree import Leaf, _key_pairs

    own = _fields(node.dims, node.measures, node.filters)
    if isinstance(node, Leaf):
        return {"name": node.name, "description": node.description, **own}
    on = None if node.cardinality == "cross" else to_data(_key_pairs(node.on))
    return {"left": _node_to_data(node.left), "right": _node_to_data(node.right), "on": on, "how": node.how, "cardinality": node.cardinality, **own}


def model_to_data(model) -> dict[str, Any]:
    """A model, of one table or joined, as data; tables are named by their models, not written."""
    return {"version": VERSION, **_node_to_data(model.node)}


def _node_from_data(data: dict[str, Any], table: Any):
    from ..model import SemanticTable, to_semantic_table
    from ..plans.tree import Join

    if "left" in data:
        left, right = _node_from_data(data["left"], table), _node_from_data(data["right"], table)
        if data.get("cardinality") not in ("one", "many", "cross") or data.get("how") not in ("left", "cross"):
            raise SerializationError("unknown kind of join")
        model = SemanticTable(Join(left.node, right.node, from_data(data["on"]), data["how"], data["cardinality"]))
    else:
        name = data.get("name")
        if isinstance(table, dict):
            if name not in table:
                raise SerializationError(f"no table for model {name!r}")
        model = to_semantic_table(table[name] if isinstance(table, dict) else table, name, data.get("description"))
    model = model.with_dimensions(**{n: {**{k: v for k, v in d.items() if k != "derived_dimensions"}, "expr": from_data(d["expr"])} for n, d in data["dimensions"].items()})
    model = model.with_measures(**{n: {**m, "expr": from_data(m["expr"])} for n, m in data["measures"].items()})
    return model.filter(*map(from_data, data.get("filters", []))) if data.get("filters") else model


def model_from_data(data: dict[str, Any], table: DataFrame | dict[str, DataFrame]):
    """The model of data, over a table or, for joined models, tables by the names of their models."""
    if data.get("version") != VERSION:
        raise SerializationError(f"unknown version {data.get('version')!r}")
    return _node_from_data(data, table)
