"""Queries by parameters: dimensions, measures, filters, grains, ranges, order, limit; and period comparison."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError, UnknownFieldError
from .expr.nodes import Attr, Bound, Call, Expr, Field, Lit, MeasureRef, Over, SortKey, Total, WinFunc, as_expr, walk
from .model import GRAIN_ORDER, Grouped, Result, SemanticTable, check_limit, grain
from .functions.aggregate import sort_column
from .plans.planner import Planner, aggregate, scalar
from .plans.tree import Tree, quoted
from .predicate import as_filter, conjuncts, field


def _resolve(tree: Tree, name: Any, known: Any, kind: str) -> str:
    from .model import _field_name

    text = _field_name(name)
    full = None if text is None else tree.find(text.removeprefix("_."), known)
    if full is None:
        raise UnknownFieldError(str(name), list(known), kind)
    return full


def time_dimensions(model: SemanticTable) -> list[str]:
    return [n for n, d in model.get_dimensions().items() if d.is_time_dimension]


def range_filters(name: str, time_range: Mapping[str, str]) -> list[Expr]:
    """start <= time, and time < the day after a date, or time <= a time of day."""
    start, end = time_range.get("start"), time_range.get("end")
    if start is None or end is None:
        raise QueryError("time_range needs start and end")
    only_date = lambda x: isinstance(x, str) and len(x) == 10
    begin = dt.datetime.fromisoformat(start) if isinstance(start, str) else start
    finish = dt.datetime.fromisoformat(end) if isinstance(end, str) else end
    as_time = lambda x: x if isinstance(x, dt.datetime) else dt.datetime(x.year, x.month, x.day)
    if as_time(finish).replace(tzinfo=None) < as_time(begin).replace(tzinfo=None):
        raise QueryError("time_range ends before it starts")
    f = field(name)
    if only_date(end) or not isinstance(finish, dt.datetime):
        return [Call(">=", (f, Lit(as_time(begin)))), Call("<", (f, Lit(as_time(finish) + dt.timedelta(days=1))))]
    return [Call(">=", (f, Lit(as_time(begin)))), Call("<=", (f, Lit(finish)))]


def _paths(e: Expr) -> list[str]:
    """The dotted names that an expression reads."""
    out: list[str] = []

    def visit(x: Any) -> None:
        parts: list[str] = []
        y = x
        while isinstance(y, Attr):
            parts.insert(0, y.attr)
            y = y.base
        if isinstance(y, Field):
            out.append(".".join([y.field, *parts]))
            return
        from .expr.nodes import children

        for c in children(x):
            visit(c)

    visit(e)
    return out


def grain_expression(tree: Tree, bound: Expr, to: str) -> Expr:
    """A bound time truncated to a grain, of its own type."""
    planner = Planner(tree)
    leaves = {x.leaf for x in walk(bound) if isinstance(x, Bound)}
    kind = planner.joined(planner.needed(leaves)).select(scalar(bound)).schema[0].dataType
    cut = Call("truncate", (bound, Lit(to)))
    if isinstance(kind, T.DateType):
        return Call("date", (cut,))
    return Call("cast", (cut, Lit("timestamp_ltz"))) if isinstance(kind, T.TimestampType) else cut


def query(
    model: SemanticTable,
    dimensions: Sequence[Any] = (),
    measures: Sequence[Any] = (),
    filters: Sequence[Any] | None = None,
    order_by: Sequence[tuple[str, str]] | None = None,
    limit: int | None = None,
    time_grain: str | None = None,
    time_grains: Mapping[str, str] | None = None,
    time_range: Mapping[str, str] | None = None,
    having: Sequence[Any] | None = None,
) -> Result:
    """A query; filters that touch a measure hold after aggregation, all others before time grains apply."""
    tree = model.tree
    dims, known_measures = tree.dimension_names(), tree.measure_names()
    named = []
    for d in dimensions:
        from .model import _field_name

        text = _field_name(d)
        full = None if text is None else tree.find(text, dims)
        if full is None and text is not None and tree.raw(text) is not None and text not in dims and tree.find(text, known_measures) is None:
            full = text
        if full is None:
            raise UnknownFieldError(str(d), [*dims, *known_measures], "dimension")
        named.append(full)
    asked = [_resolve(tree, m, known_measures, "measure") for m in measures]
    if not named and not asked:
        raise QueryError("a query needs a dimension or a measure")
    if limit is not None:
        check_limit(limit)
    orders = []
    for key, direction in order_by or []:
        if direction.lower() not in ("asc", "ascending", "desc", "descending"):
            raise QueryError(f"unknown direction {direction!r}")
        full = tree.find(key, [*named, *asked])
        if full is None:
            raise QueryError(f"order_by {key!r} isn't selected")
        orders.append((full, direction.lower().startswith("asc")))
    if time_grain is not None and time_grains:
        raise QueryError("give time_grain or time_grains, not both")
    chosen = [d for d in named if d in dims and dims[d][1].is_time_dimension]
    if time_range is not None and not chosen:
        raise QueryError("time_range needs a time dimension among the dimensions")
    where = list(range_filters(chosen[0], time_range)) if time_range is not None else []
    after: list[Any] = list(having or [])

    def reads_measure(e: Expr) -> bool:
        return any(tree.find(p, dims) is None and tree.raw(p) is None and tree.find(p, known_measures) is not None for p in _paths(e))

    for f in filters or []:
        for part in conjuncts(f):
            (after if reads_measure(as_filter(part)) else where).append(part)
    for h in after:
        for p in _paths(as_filter(h)):
            if tree.find(p, [*named, *asked]) is None:
                raise QueryError(f"{p!r} is filtered after aggregation but isn't selected")
    grains = {}
    if time_grain is not None:
        if not chosen:
            raise QueryError("time_grain needs a time dimension among the dimensions")
        grains = {d: grain(time_grain) for d in chosen}
    for d, g in (time_grains or {}).items():
        full = _resolve(tree, d, dims, "dimension")
        if full not in named:
            raise QueryError(f"time_grains names {d!r}, which isn't selected")
        if not dims[full][1].is_time_dimension:
            raise QueryError(f"{d!r} is no time dimension")
        grains[full] = grain(g)
    for d, g in grains.items():
        least = dims[d][1].smallest_time_grain
        if least is not None and GRAIN_ORDER.index(g) < GRAIN_ORDER.index(grain(least)):
            raise QueryError(f"{d!r} is stored by {grain(least)}; {g} is finer")
    filtered = model.filter(*where) if where else model
    group = Grouped(filtered, tuple(named))
    keys = group.resolved()
    wanted = group._wanted(tuple(asked), {})
    group._check_shadows({k: e for k, e in keys.items() if k not in grains}, wanted)
    keys = {k: grain_expression(filtered.tree, e, grains[k]) if k in grains else e for k, e in keys.items()}
    plan = aggregate(filtered.tree, keys, wanted, filtered._filters())
    out = Result(plan.df, plan.keys, plan.measures, plan.additive, model.name)
    for h in after:
        out = out.filter(h)
    if orders:
        df = out.df.orderBy(*[sort_column(quoted(k), up) for k, up in orders])
        out = out._but(df, order=tuple(SortKey(field(k), up) for k, up in orders))
    return out.limit(limit) if limit is not None else out


def _apart(a: list[Expr], b: list[Expr]) -> bool:
    """Whether two spans of time, each as its two comparisons, share no moment."""
    (low, high), (other_low, other_high) = ([f.args[1].value for f in x] for x in (a, b))
    try:
        return high < other_low or other_high < low or high == other_low and a[1].func == "<" or other_high == low and b[1].func == "<"
    except TypeError:  # a time zone in one of them only
        return False


def _of_groups(tree: Tree, name: str) -> bool:
    """Whether a measure, with all that it refers to, reads its own group alone."""
    known, work, seen = tree.measure_names(), [name], set()
    while work:
        n = work.pop()
        if n in seen:
            continue
        seen.add(n)
        leaf, m = known[n]
        for x in walk(tree.bind_measure(as_expr(m.expr), leaf, n, m.prefer_measures)):
            if isinstance(x, (Total, Over, WinFunc)):
                return False
            if isinstance(x, MeasureRef):
                work.append(x.measure)
    return True


def _side_by_side(model: SemanticTable, named: list[str], asked: list[str], filters: list[Any], now: list[Expr], then: list[Expr]) -> DataFrame:
    """Measures of two spans that share no moment from one pass: the span is a further group key."""
    both = [Call("&", tuple(span)) for span in (now, then)]
    grouped = query(model.with_dimensions(__now=both[0]), [*named, "__now"], asked, [*filters, Call("|", tuple(both))]).to_spark()
    pick = lambda m, which: F.first(F.when(quoted("__now") == which, quoted(m)), ignorenulls=True)  # noqa: E731  # one row each
    return grouped.groupBy(*[quoted(d) for d in named]).agg(*[pick(m, True).alias(f"{m}_current") for m in asked], *[pick(m, False).alias(f"{m}_previous") for m in asked])


def _outer_joined(named: list[str], asked: list[str], now: DataFrame, then: DataFrame) -> DataFrame:
    """Measures of two spans from a query each."""
    now = now.select(*[quoted(d).alias(d) for d in named], *[quoted(m).alias(f"{m}_current") for m in asked])
    then = then.select(*[quoted(d).alias(f"__previous_{d}") for d in named], *[quoted(m).alias(f"{m}_previous") for m in asked])
    if not named:
        return now.crossJoin(F.broadcast(then))  # one row each
    on = reduce(lambda a, b: a & b, [quoted(d).eqNullSafe(quoted(f"__previous_{d}")) for d in named])
    return now.join(then, on, "full_outer").select(*[F.coalesce(quoted(d), quoted(f"__previous_{d}")).alias(d) for d in named], *[quoted(f"{m}_current") for m in asked], *[quoted(f"{m}_previous") for m in asked])


def compare_periods(
    model: SemanticTable,
    dimensions: Sequence[str] = (),
    measures: Sequence[str] = (),
    current_time_range: Mapping[str, str] | None = None,
    previous_time_range: Mapping[str, str] | None = None,
    filters: Sequence[Any] | None = None,
    time_dimension: str | None = None,
    time_grain: str | None = None,
    time_grains: Mapping[str, str] | None = None,
    order_by: Sequence[tuple[str, str]] | None = None,
    limit: int | None = None,
) -> Result:
    """Each measure of two ranges of time with its difference and relative change; a group of either range is a row."""
    if not measures:
        raise QueryError("compare_periods needs a measure")
    if current_time_range is None or previous_time_range is None:
        raise QueryError("compare_periods needs current_time_range and previous_time_range")
    tree = model.tree
    dims = tree.dimension_names()
    named = [_resolve(tree, d, dims, "dimension") for d in dimensions]
    asked = [_resolve(tree, m, tree.measure_names(), "measure") for m in measures]
    if time_dimension is not None:
        time = _resolve(tree, time_dimension, dims, "dimension")
    else:
        candidates = [d for d in named if dims[d][1].is_time_dimension] + time_dimensions(model)
        if not candidates:
            raise QueryError("compare_periods needs a time dimension; declare one or name it")
        time = candidates[0]
    spans = [range_filters(time, span) for span in (current_time_range, previous_time_range)]
    if named and time_grain is None and time_grains is None and not tree.joined and _apart(*spans) and all(_of_groups(tree, m) for m in asked):
        df = _side_by_side(model, named, asked, list(filters or []), *spans)
    else:
        sides = [query(model, named, asked, [*(filters or []), *span], time_grain=time_grain, time_grains=time_grains).to_spark() for span in spans]
        df = _outer_joined(named, asked, *sides)
    zero = F.lit(0)
    delta = {m: F.coalesce(quoted(f"{m}_current"), zero) - F.coalesce(quoted(f"{m}_previous"), zero) for m in asked}
    df = df.select(
        "*", *[c.alias(f"{m}_delta") for m, c in delta.items()], *[F.try_divide(c.cast("double"), F.nullif(quoted(f"{m}_previous"), zero).cast("double")).alias(f"{m}_pct_change") for m, c in delta.items()]
    )
    out = Result(df, named, [c for c in df.columns if c not in named], {}, f"{model.name or 'model'}_period_comparison")
    if order_by:
        sorts = []
        for key, direction in order_by:
            if direction.lower() not in ("asc", "ascending", "desc", "descending"):
                raise QueryError(f"unknown direction {direction!r}")
            sorts.append(sort_column(quoted(out._name(key)), direction.lower().startswith("asc")))
        out = out._but(df.orderBy(*sorts))
    if limit is not None:
        out = out.limit(limit)
    return out
