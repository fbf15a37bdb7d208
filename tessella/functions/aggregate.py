"""Reductions and window functions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import CompilationError
from ..expr.nodes import Agg, Bound, Call, Window, WinFunc

#: Reductions that can be added up from partial results, and how.
ADDITIVE = {"sum": "sum", "count": "sum", "min": "min", "max": "max", "any": "any", "all": "all"}


_TRUTHS = {"==", "!=", "<", "<=", ">", ">=", "&", "|", "^", "not", "and_", "or_", "isnull", "notnull", "isin", "notin", "between", "contains", "startswith", "endswith", "like", "ilike", "re_search", "identical_to"}


def is_truth(e: Any, typed: Callable[[Any], bool] | None = None) -> bool:
    """Whether an expression is a truth value; typed tells it of columns."""
    if isinstance(e, Call):
        return e.func in _TRUTHS
    return bool(typed and isinstance(e, Bound) and typed(e))


def reduction(e: Agg, column: Callable[[Any], Column], guard: Column | None = None, typed: Callable[[Any], bool] | None = None) -> Column:
    """The aggregate column of a reduction; rows for which guard is false count as absent. Truth values add up as 0 and 1."""
    conditions = [c for c in (guard, None if e.where is None else column(e.where)) if c is not None]
    condition = conditions[0] & conditions[1] if len(conditions) == 2 else conditions[0] if conditions else None

    def kept(c: Column) -> Column:
        return c if condition is None else F.when(condition, c)

    if e.arg is None:
        if e.kind != "count":
            raise CompilationError(f"{e.kind}() needs a field")
        return F.count(kept(F.lit(1)))
    arg = column(e.arg)
    if e.kind in ("sum", "mean", "std", "var", "median", "quantile") and is_truth(e.arg, typed):
        arg = arg.cast("int")
    x = kept(arg)
    plain = {
        "count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "nunique": F.count_distinct, "approx_nunique": F.approx_count_distinct, "median": F.median,
        "mode": F.mode, "any": F.bool_or, "all": F.bool_and, "collect": F.collect_list,
    }
    if e.kind in plain:
        return plain[e.kind](x)
    if e.kind == "approx_median":
        return F.percentile_approx(x, 0.5)
    if e.kind == "quantile":
        return F.percentile(x, float(e.params[0]))
    if e.kind in ("std", "var"):
        return getattr(F, {"std": "stddev", "var": "var"}[e.kind] + ("_pop" if e.params and e.params[0] == "pop" else "_samp"))(x)
    if e.kind in ("first", "arbitrary"):
        return F.first(x, ignorenulls=True)
    if e.kind == "last":
        return F.last(x, ignorenulls=True)
    if e.kind in ("argmax", "argmin"):
        return (F.max_by if e.kind == "argmax" else F.min_by)(x, kept(column(e.params[0])))
    raise CompilationError(f"no reduction {e.kind!r}")


def frame(window: Window, column: Callable[[Any], Column], order: list[Column], bounded: bool = True):
    """The Spark window; order is used where the window names none."""
    spec = W.partitionBy(*[column(k) for k in window.group_by])
    keys = [sort_column(column(k.key), k.ascending) for k in window.order_by] or order
    if keys:
        spec = spec.orderBy(*keys)
    if bounded and window.rows is not None:
        a, b = window.rows
        spec = spec.rowsBetween(W.unboundedPreceding if a is None else a, W.unboundedFollowing if b is None else b)
    return spec, bool(keys)


def sort_column(c: Column, ascending: bool) -> Column:
    """Nulls go last either way."""
    return c.asc_nulls_last() if ascending else c.desc_nulls_last()


def windowed(e: Agg | WinFunc, window: Window, column: Callable[[Any], Column], order: list[Column]) -> Column:
    """A reduction or window function over a window; ranks count from 0."""
    if isinstance(e, Agg):
        spec, ordered = frame(window, column, order if window.rows is not None else [])
        if window.rows is None and ordered:
            spec = spec.rowsBetween(W.unboundedPreceding, 0)
        if e.kind == "nunique":
            return F.size(F.collect_set(column(e.arg)).over(spec))
        if e.kind in ("first", "last"):
            return (F.first if e.kind == "first" else F.last)(column(e.arg)).over(spec)
        return reduction(e, column).over(spec)
    spec, ordered = frame(window, column, order, bounded=False)
    if not ordered:
        raise CompilationError(f"{e.kind}() needs an order: give order_by, or sort the result before")
    if e.kind in ("rank", "dense_rank", "row_number"):
        return getattr(F, e.kind)().over(spec) - 1
    if e.kind in ("percent_rank", "cume_dist"):
        return getattr(F, e.kind)().over(spec)
    numbers = [a.value if hasattr(a, "value") else a for a in e.args]
    if e.kind == "ntile":
        return F.ntile(int(numbers[-1])).over(spec) - 1
    if e.kind in ("lag", "lead"):
        step = int(numbers[1]) if len(numbers) > 1 else 1
        return getattr(F, e.kind)(column(e.args[0]), step, *([numbers[2]] if len(numbers) > 2 else [])).over(spec)
    base = {"cumsum": F.sum, "cummean": F.avg, "cummin": F.min, "cummax": F.max}[e.kind]
    return base(column(e.args[0])).over(spec.rowsBetween(W.unboundedPreceding, 0))
