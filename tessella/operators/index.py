"""The dimensional index: which values the fields of a model have, and how often."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnknownFieldError
from ..expr.nodes import Agg
from ..model import Result, SemanticTable, _field_name
from ..plans.planner import Planner, aggregate, scalar
from ..plans.tree import quoted


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return t.simpleString()


def _selected(model: SemanticTable, selector: Any) -> list[str]:
    known = list(model.tree.dimension_names())
    if selector is None:
        return known
    if isinstance(selector, Callable) and _field_name_or_none(selector) is None:
        selector = [n for n in known if selector(n)]
    items = selector if isinstance(selector, (list, tuple)) else [selector]
    out = []
    for s in items:
        name = _field_name(s)
        full = None if name is None else model.tree.find(name, known)
        if full is None:
            raise UnknownFieldError(str(s), known, "dimension")
        out.append(full)
    return out


def _field_name_or_none(x: Any) -> str | None:
    try:
        return _field_name(x)
    except Exception:
        return None


def _by_rows(rows: DataFrame, bounds: dict[str, Any], kinds: dict[str, str]) -> DataFrame:
    """The index with counts as weights: one pass for the values of all fields and one for the ranges of all numbers."""
    label = lambda n: (F.lit(n.rsplit(".", 1)[-1]).alias("fieldName"), F.lit(n).alias("fieldPath"), F.lit(kinds[n]).alias("fieldType"))
    parts = []
    if valued := [n for n in bounds if kinds[n] != "number"]:
        pairs = F.explode(F.array(*[F.struct(*label(n), scalar(bounds[n]).cast("string").alias("fieldValue")) for n in valued])).alias("p")
        parts.append(rows.select(pairs).select("p.*").groupBy("fieldName", "fieldPath", "fieldType", "fieldValue").agg(F.count("*").alias("weight")))
    if numbers := [n for n in bounds if kinds[n] == "number"]:
        spread = rows.agg(F.count("*").alias("weight"), *[f(scalar(bounds[n])).cast("string").alias(f"{way}{k}") for k, n in enumerate(numbers) for way, f in (("low", F.min), ("high", F.max))])
        spans = F.explode(F.array(*[F.struct(*label(n), F.concat(F.col(f"low{k}"), F.lit(" to "), F.col(f"high{k}")).alias("fieldValue")) for k, n in enumerate(numbers)])).alias("p")
        parts.append(spread.select(spans, "weight").select("p.*", "weight").filter(F.col("fieldValue").isNotNull()))
    return reduce(lambda a, b: a.unionByName(b), parts)


def index(model: SemanticTable, selector: Any = None, by: str | None = None, sample: int | None = None) -> Result:
    """Rows (fieldName, fieldPath, fieldType, fieldValue, weight) of each field's values; numbers give their range.

    weight counts rows, or is the measure by. sample takes that many rows as they come, which are no random ones.
    """
    if sample is not None and (isinstance(sample, bool) or not isinstance(sample, int) or sample <= 0):
        raise QueryError("sample must be a positive number of rows")
    names = _selected(model, selector)
    if not names:
        raise QueryError("no dimension is selected")
    if sample is not None:
        model = model.limit(sample)
    tree = model.tree
    planner = Planner(tree)
    known = tree.measure_names()
    measure = None
    if by is not None:
        measure = tree.find(by, known)
        if measure is None:
            raise UnknownFieldError(by, list(known), "measure")
    bounds = {n: tree.dimension(n) for n in names}
    planner.read_only(*bounds.values(), *model._filters())
    rows = planner._filtered(planner.joined(set(range(len(tree.leaves)))), model._filters())
    schema = rows.select(*[scalar(b).alias(n) for n, b in bounds.items()]).schema
    kinds = {n: _kind(schema[n].dataType) for n in names}
    if measure is None:
        df = _by_rows(rows, bounds, kinds)
        return Result(df, ["fieldName", "fieldPath", "fieldType", "fieldValue"], ["weight"], {"weight": "sum"}, model.name)
    parts = []
    for n, bound in bounds.items():
        kind = kinds[n]
        weight: dict[str, Any] = {"weight": measure}
        if kind == "number":
            spread = aggregate(tree, {}, {"low": Agg("min", bound), "high": Agg("max", bound)}, model._filters()).df
            totals = spread.crossJoin(F.broadcast(aggregate(tree, {}, weight, model._filters()).df))
            value = F.concat(quoted("low").cast("string"), F.lit(" to "), quoted("high").cast("string"))
            part = totals.filter(quoted("low").isNotNull()).select(value.alias("fieldValue"), quoted("weight").cast("double").alias("weight"))
        else:
            grouped = aggregate(tree, {"__value": bound}, weight, model._filters()).df
            part = grouped.select(quoted("__value").cast("string").alias("fieldValue"), quoted("weight").cast("double").alias("weight"))
        parts.append(part.select(F.lit(n.rsplit(".", 1)[-1]).alias("fieldName"), F.lit(n).alias("fieldPath"), F.lit(kind).alias("fieldType"), "fieldValue", "weight"))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    return Result(df, ["fieldName", "fieldPath", "fieldType", "fieldValue"], ["weight"], {"weight": "sum"}, model.name)
