"""Nests: for each outer group the rows of an inner query as an array of structs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..expr.nodes import Expr, SortKey
from ..functions.aggregate import sort_column
from ..model import Grouped, Result, SemanticTable, _names, check_limit, sort_key
from ..plans.planner import Planner, aggregate, scalar
from ..plans.tree import quoted


class NestScope:
    """What a nest's lambda receives; only group_by and aggregate lead on."""

    def __init__(self, model: SemanticTable):
        self._model = model

    def group_by(self, *keys: Any) -> Nest:
        return Nest(self._model, tuple(_names(keys)))

    def filter(self, *predicates: Any) -> NestScope:
        return NestScope(self._model.filter(*predicates))

    def aggregate(self, *measures: Any, **kw: Any) -> Nest:
        return Nest(self._model, ()).aggregate(*measures, **kw)

    def __getattr__(self, name: str) -> Any:
        raise NotImplementedError(f"{name!r} can't start a nest; use group_by(), filter() or aggregate()")


class Nest:
    """An inner query in progress; order and limit work within each outer group."""

    def __init__(self, model: SemanticTable, keys: tuple[Any, ...]):
        self.model, self.keys = model, keys
        self.measures: tuple[Any, ...] = ()
        self.named: dict[str, Any] = {}
        self.nest: Mapping[str, Callable] | None = None
        self.aggregated = False
        self.steps: list[tuple[str, Any]] = []

    def aggregate(self, *measures: Any, nest: Mapping[str, Callable] | None = None, **named: Any) -> Nest:
        self.measures, self.named, self.nest, self.aggregated = measures, named, nest, True
        return self

    agg = aggregate

    def _step(self, kind: str, what: Any) -> Nest:
        if not self.aggregated:
            raise NotImplementedError("aggregate() comes before this in a nest")
        self.steps.append((kind, what))
        return self

    def filter(self, *predicates: Any) -> Nest:
        if not self.aggregated:
            self.model = self.model.filter(*predicates)
            return self
        return self._step("filter", predicates)

    def mutate(self, **exprs: Any) -> Nest:
        return self._step("mutate", exprs)

    def order_by(self, *keys: Any) -> Nest:
        return self._step("order", _names(keys))

    def limit(self, n: int, offset: int = 0) -> Nest:
        check_limit(n, offset)
        return self._step("limit", (n, offset))


def _inner(nest: Nest, outer: dict[str, Expr], part: list[str]) -> tuple[Any, list[str], list[Any]]:
    """The inner rows at outer and inner keys, the names of the struct's fields, and their order."""
    group = Grouped(nest.model, nest.keys)
    keys = group.resolved()
    both = {**dict(zip(part, outer.values())), **keys}
    if not nest.aggregated:
        tree = nest.model.tree
        planner = Planner(tree)
        df = planner.joined(set(range(len(tree.leaves))))
        for f in nest.model._filters():
            df = df.filter(scalar(f))
        return df.select(*[scalar(e).alias(k) for k, e in both.items()]), list(keys), []
    wanted = group._wanted(nest.measures, nest.named)
    if nest.nest:
        result = with_nests(group, both, wanted, nest.nest)
    else:
        plan = aggregate(nest.model.tree, both, wanted, nest.model._filters())
        result = Result(plan.df, list(keys), plan.measures, plan.additive)
    order: list[tuple[Expr, bool]] = []
    for kind, what in nest.steps:
        if kind == "filter":
            result = result.filter(*what)
        elif kind == "mutate":
            result = result.mutate(**what)
        elif kind == "order":
            order = [sort_key(k) for k in what]
            result = result._but(result.df, order=tuple(SortKey(e, up) for e, up in order))
        else:
            n, offset = what
            sorts = [sort_column(result.column(e), up) for e, up in order] or [quoted(c) for c in keys] or [F.lit(1)]
            ranked = result.df.withColumn("__nth", F.row_number().over(W.partitionBy(*map(quoted, part)).orderBy(*sorts)))
            result = result._but(ranked.filter((F.col("__nth") > offset) & (F.col("__nth") <= offset + n)).drop("__nth"))
    fields = [c for c in result.df.columns if c not in part]
    sorts = [sort_column(result.column(e), up) for e, up in order]
    return result.df, fields, sorts


def with_nests(group: Grouped, keys: dict[str, Expr], wanted: dict[str, Any], nests: Mapping[str, Callable]) -> Result:
    """The outer aggregation with one array column a nest; groups without inner rows have a null array."""
    plan = aggregate(group.model.tree, keys, wanted, group.model._filters())
    df = plan.df
    depth = 1 + max([-1, *(int(k.split("_")[2][5:]) for k in keys if k.startswith("__outer"))])
    part = [f"__outer{depth}_{i}" for i in range(len(keys))]
    for name, build in nests.items():
        nest = build(NestScope(group.model))
        if not isinstance(nest, Nest):
            raise NotImplementedError("a nest must be a group_by() or an aggregate()")
        inner, fields, sorts = _inner(nest, keys, part)
        struct = F.struct(*[quoted(c).alias(c) for c in fields])
        if sorts:
            inner = inner.withColumn("__nth", F.row_number().over(W.partitionBy(*map(quoted, part)).orderBy(*sorts)))
            packed = inner.groupBy(*map(quoted, part)).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("__nth").alias("n"), struct.alias("s")))), lambda x: x["s"]).alias(name))
        else:
            packed = inner.groupBy(*map(quoted, part)).agg(F.collect_list(struct).alias(name))
        if part:
            on = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(p)) for k, p in zip(keys, part)])
            df = df.join(packed, on, "left").drop(*part)
        else:
            df = df.crossJoin(F.broadcast(packed))  # one row
    return Result(df, list(keys), [*plan.measures, *nests], plan.additive, group.model.name)
