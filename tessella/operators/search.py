"""Values of a dimension and the time that a model spans."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..errors import QueryError, UnknownFieldError
from ..expr.nodes import Agg
from ..model import SemanticTable, check_limit
from ..plans.planner import aggregate
from ..plans.tree import quoted


def value_counts(model: SemanticTable, dimension: str):
    """Rows (value, count), null left out, most frequent first, ties by value."""
    tree = model.tree
    full = tree.find(dimension, tree.dimension_names())
    if full is None:
        raise UnknownFieldError(dimension, list(tree.dimension_names()), "dimension")
    df = aggregate(tree, {"value": tree.dimension(full)}, {"count": Agg("count")}, model._filters()).df
    return df.filter(quoted("value").isNotNull()).orderBy(F.desc("count"), F.col("value").cast("string"))


def plain(c):
    """Text without case and separators."""
    return F.regexp_replace(F.lower(c.cast("string")), r"[\s_\-]+", "")


def search_values(model: SemanticTable, dimension: str, search: str | None = None, limit: int = 20) -> dict[str, Any]:
    """The most frequent values, those that contain the search if any do; is_complete tells whether there are no more."""
    check_limit(limit)
    counts = value_counts(model, dimension)
    rows = []
    if search:
        rows = counts.filter(F.contains(plain(F.col("value")), plain(F.lit(search)))).limit(limit + 1).collect()
    found = bool(rows)
    if not rows:
        rows = counts.limit(limit + 1).collect()
    out: dict[str, Any] = {"values": [{"value": r["value"], "count": r["count"]} for r in rows[:limit]], "is_complete": len(rows) <= limit}
    if search and not found:
        out |= {"is_complete": False, "note": f"no value contains {search!r}; these are the most frequent ones"}
    return out


def time_range(model: SemanticTable, dimension: str | None = None) -> dict[str, Any]:
    """Start and end of a time dimension, by default the first."""
    from ..query import time_dimensions

    tree = model.tree
    names = [dimension] if dimension else time_dimensions(model)
    if not names:
        raise QueryError("the model has no time dimension")
    full = tree.find(names[0], tree.dimension_names())
    if full is None:
        raise UnknownFieldError(names[0], list(tree.dimension_names()), "dimension")
    bound = tree.dimension(full)
    row = aggregate(tree, {}, {"start": Agg("min", bound), "end": Agg("max", bound)}, model._filters()).df.head()
    iso = lambda x: None if x is None else x.isoformat()
    return {"time_dimension": full, "start": iso(row["start"]), "end": iso(row["end"])}
