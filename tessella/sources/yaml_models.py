"""Models as YAML or plain mappings."""

from __future__ import annotations

import difflib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import DefinitionError
from ..expr.sandbox import parse
from ..model import SemanticTable, as_dimension, as_measure, to_semantic_table
from ..plans.tree import Dimension, Measure
from ..predicate import as_filter
from .profiles import Connection, get_connection, read_yaml

_MODEL = {"table", "description", "database", "dimensions", "measures", "calculated_measures", "joins", "filter", "profile"}
_JOIN = {"model", "type", "left_on", "right_on", "alias", "how"}
_DIMENSION = {"expr", "description", "is_entity", "is_time_dimension", "is_event_timestamp", "smallest_time_grain", "derived_dimensions", "metadata", "is_unique"}
_MEASURE = {"expr", "description", "metadata"}


def _check(what: str, given: Mapping[str, Any], known: set[str]) -> None:
    for k in given:
        if k not in known:
            near = difflib.get_close_matches(str(k), sorted(known), n=1)
            raise DefinitionError(f"{what} has an unknown key {k!r}" + (f"; did you mean {near[0]!r}?" if near else f"; known: {', '.join(sorted(known))}"))


def _dimension(name: str, spec: Any) -> Dimension:
    if isinstance(spec, str):
        return Dimension(parse(spec))
    if not isinstance(spec, Mapping) or not isinstance(spec.get("expr"), str):
        raise DefinitionError(f"dimension {name!r} needs an expression")
    _check(f"dimension {name!r}", spec, _DIMENSION)
    return as_dimension({**spec, "expr": parse(spec["expr"])})


def _measure(name: str, spec: Any, calculated: bool = False) -> Measure:
    if isinstance(spec, str):
        spec = {"expr": spec}
    if not isinstance(spec, Mapping) or not isinstance(spec.get("expr"), str):
        raise DefinitionError(f"measure {name!r} needs an expression")
    _check(f"measure {name!r}", spec, _MEASURE)
    return as_measure({**spec, "expr": parse(spec["expr"]), "prefer_measures": calculated})


def from_config(config: Mapping[str, Any], tables: Mapping[str, Any] | None = None, profile: Any = None, profile_path: str | None = None, spark: SparkSession | None = None) -> dict[str, SemanticTable]:
    """Models by name; tables are DataFrames, (profile, table) pairs, or come from the profile."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    connections: dict[Any, Connection] = {}

    def connection(p: Any) -> Connection:
        key = repr(p)
        if key not in connections:
            connections[key] = get_connection(spark, p, profile_path)
        return connections[key]

    given: dict[str, DataFrame] = {}
    for n, t in (tables or {}).items():
        if isinstance(t, (tuple, list)):
            where = get_connection(spark, t[0], t[2] if len(t) > 2 else profile_path)
            given[n] = where.table(t[1])
        else:
            given[n] = t.to_spark() if hasattr(t, "to_spark") else t
    models: dict[str, SemanticTable] = {}
    specs = {n: c for n, c in config.items() if n != "profile" and isinstance(c, Mapping)}
    for name, spec in specs.items():
        _check(f"model {name!r}", spec, _MODEL)
        if not spec.get("table"):
            raise DefinitionError(f"model {name!r} needs a table")
        table = spec["table"]
        if table in given and not spec.get("database"):
            df = given[table]
        else:
            df = connection(spec.get("profile") or profile or config.get("profile")).table(table, spec.get("database"))
        model = to_semantic_table(df, name, spec.get("description"))
        model = model.with_dimensions(**{n: _dimension(n, d) for n, d in (spec.get("dimensions") or {}).items()})
        model = model.with_measures(**{n: _measure(n, m) for n, m in (spec.get("measures") or {}).items()})
        model = model.with_measures(**{n: _measure(n, m, True) for n, m in (spec.get("calculated_measures") or {}).items()})
        if spec.get("filter") is not None:
            model = model.filter(as_filter(spec["filter"]))
        models[name] = model
    plain = dict(models)
    for name, spec in specs.items():
        for alias, join in (spec.get("joins") or {}).items():
            models[name] = _joined(name, models[name], alias, join, plain)
    return models


def _joined(name: str, model: SemanticTable, alias: str, join: Mapping[str, Any], known: Mapping[str, SemanticTable]) -> SemanticTable:
    what = f"join {alias!r} of model {name!r}"
    if not isinstance(join, Mapping):
        raise DefinitionError(f"{what} must be a mapping")
    _check(what, join, _JOIN)
    other = join.get("model") or alias
    if other not in known:
        raise DefinitionError(f"{what}: no model {other!r}")
    right = known[other]
    own = join.get("alias") or alias
    if own != other:
        right = right.view(own)
    kind = join.get("type", "one")
    if join.get("how", "left") != "left":
        raise DefinitionError(f"{what}: joins are left joins; filter on a non-null field of the right side instead")
    if kind == "cross":
        return model.join_cross(right)
    if kind not in ("one", "many"):
        raise DefinitionError(f"{what}: type is one, many or cross, not {kind!r}")
    left_on, right_on = join.get("left_on"), join.get("right_on")
    if not left_on or not right_on:
        raise DefinitionError(f"{what} needs left_on and right_on")
    many = lambda x: [x] if isinstance(x, str) else list(x)
    pairs = list(zip(many(left_on), many(right_on), strict=True))

    def on(left: Any, r: Any) -> Any:
        out = None
        for a, b in pairs:
            x = left
            for p in str(a).split("."):
                x = x[p]
            part = x == r[b]
            out = part if out is None else out & part
        return out

    return (model.join_one if kind == "one" else model.join_many)(right, on)


def from_yaml(path: str | Path, tables: Mapping[str, Any] | None = None, profile: Any = None, profile_path: str | None = None, spark: SparkSession | None = None) -> dict[str, SemanticTable]:
    """The models of a YAML file, local or by an http(s) URL."""
    return from_config(read_yaml(path), tables, profile, profile_path, spark)
