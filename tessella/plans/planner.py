"""From a model, keys, measures and filters to a DataFrame.

Each base measure is aggregated at the rows of its own source, so that joins never multiply it:

* over the root alone, or over joins that keep its rows single, it is one aggregation of the joined rows;
* else its rows meet *bridges* instead of the other sources' rows: for each part of the model that the source connects, the distinct
  combinations of that part's group keys and join keys, so that a row meets each group once;
* where predicates or keys mix sources in other ways, the distinct combinations of group keys and the source's own columns that
  they read are the bridge.

No row needs an identity for that: entity dimensions are descriptions, and only a dimension declared ``unique`` is trusted as a key.

Joined sources that nothing asks for are left out. Results of several sources meet on the group keys, null-safely; totals are a
one-row frame beside them. No action runs here: Catalyst sees one declarative plan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompilationError, QueryError, UnknownFieldError
from ..expr.nodes import Agg, Bound, Call, Expr, Field, Lit, MeasureRef, Named, Over, Param, Raw, Total, WinFunc, as_expr, rebuild, walk
from ..functions.aggregate import reduction, windowed
from ..functions.scalar import compile_call, lit
from .tree import Tree, has_reduction, is_calculated, owners, quoted


#: Reductions whose partial results add up.
PARTIAL = {"sum", "count", "min", "max", "mean"}
#: Reductions to which it is all one how often a row counts.
IDEMPOTENT = {"nunique", "approx_nunique", "min", "max", "any", "all"}
#: Functions that give null if an argument is null.
STRICT = {"==", "!=", "<", "<=", ">", ">=", "+", "-", "*", "/", "%", "neg", "not", "like", "ilike", "contains", "startswith", "endswith", "upper", "lower", "between", "cast"}


def blank(e: Any, leaves: set[int]) -> bool:
    """Whether an expression is surely null where all columns of these leaves are."""
    if isinstance(e, Bound):
        return e.leaf in leaves
    if isinstance(e, Call) and e.func in STRICT:
        return any(blank(a, leaves) for a in e.args)
    return isinstance(e, Call) and e.func in ("isin", "notin") and blank(e.args[0], leaves)


def rejects(e: Any, leaves: set[int]) -> bool:
    """Whether a filter surely drops rows in which all columns of these leaves are null."""
    if isinstance(e, Call) and e.func in ("&", "|"):
        return (any if e.func == "&" else all)(rejects(a, leaves) for a in e.args)
    return blank(e, leaves)


def equalities(predicate: Any, child: int) -> bool:
    """Whether a join predicate only compares expressions of the child with those of other leaves, by equality."""
    if isinstance(predicate, Call) and predicate.func == "&":
        return all(equalities(a, child) for a in predicate.args)
    if not (isinstance(predicate, Call) and predicate.func == "=="):
        return False
    a, b = map(owners, predicate.args)
    return (a == {child} and bool(b) and child not in b) or (b == {child} and bool(a) and child not in a)


def physical(leaf: int, column: str) -> str:
    return f"__{leaf}__{column}"


def mark(leaf: int) -> str:
    return f"__{leaf}__"


def scalar(e: Any, leaf_column=None) -> Column:
    """The Spark column of a bound row-level expression."""
    if isinstance(e, Bound):
        return quoted(physical(e.leaf, e.column))
    if isinstance(e, Lit):
        return lit(e.value)
    if isinstance(e, Raw):
        return e.column
    if isinstance(e, Named):
        return scalar(e.arg)
    if isinstance(e, Call):
        return compile_call(e.func, e.args, scalar)
    if isinstance(e, tuple):
        return F.array(*map(scalar, e))
    if isinstance(e, Param):
        return lit(e.default)
    if isinstance(e, (Agg, WinFunc, Over, Total, MeasureRef)):
        raise CompilationError("a reduction or window isn't allowed among row-level expressions")
    raise CompilationError(f"unbound expression {e!r}")


@dataclass
class Base:
    """A base measure to compute: its bound expression and the leaf whose rows it reduces (None: joined rows)."""

    name: str
    expr: Expr
    leaf: int | None
    array: tuple = ()


@dataclass
class Plan:
    """A compiled aggregation: output columns in order and how each may be totalled."""

    df: DataFrame
    keys: list[str]
    measures: list[str]
    additive: dict[str, str] = field(default_factory=dict)


class Planner:
    def __init__(self, tree: Tree):
        self.tree = tree
        #: Columns that a query reads, by leaf; None takes all.
        self.used: dict[int, set[str]] | None = None

    def read_only(self, *expressions: Any) -> None:
        """Leaves give only what these expressions and the join predicates read."""
        tree = self.tree
        used: dict[int, set[str]] = {i: set() for i in range(len(tree.leaves))}
        for e in [*expressions, *(edge.predicate for edge in tree.edges.values())]:
            for b in walk(e):
                if isinstance(b, Bound):
                    used[b.leaf].add(b.column)
        self.used = used

    def truth(self, b: Bound) -> bool:
        schema = self.tree.leaves[b.leaf].df.schema
        return b.column in schema.names and isinstance(schema[b.column].dataType, T.BooleanType)

    # sources and joins

    def leaf_frame(self, i: int) -> DataFrame:
        """A leaf with its own filters, columns renamed; a mark tells its rows from the nulls of an outer join."""
        leaf = self.tree.leaves[i]
        filters = [self.tree._in_leaf(f, i, ()) for f in leaf.filters]
        keep = None if self.used is None else self.used[i] | {b.column for f in filters for b in walk(f) if isinstance(b, Bound)}
        own = [quoted(c).alias(physical(i, c)) for c in leaf.df.columns if keep is None or c in keep]
        df = leaf.df.select(*own, *[c.alias(physical(i, n)) for n, c in self.tree.raws.get(i, {}).items() if keep is None or n in keep])
        for f in filters:
            df = df.filter(scalar(f))
        return df.withColumn(mark(i), F.lit(1))

    def needed(self, leaves: Iterable[int]) -> set[int]:
        out = {0}
        for i in leaves:
            out |= self.tree.above(i)
        return out

    def joined(self, leaves: set[int], instead: dict[int, DataFrame] | None = None) -> DataFrame:
        """The join of the leaves in declared order; but for the first, leaves must hold every parent. instead: other frames for some of them."""
        df = None
        for i in sorted(leaves):
            part = instead[i] if instead and i in instead else self.leaf_frame(i)
            if df is None:
                df = part
                continue
            edge = self.tree.edges[i]
            df = df.crossJoin(part) if edge.predicate is None else df.join(part, scalar(edge.predicate), "left")
        return df

    def single(self, leaf: int, leaves: set[int]) -> bool:
        """Whether the joined rows of leaves hold each row of leaf at most once, by declared cardinality and unique keys."""
        above = self.tree.above(leaf)
        for i in leaves - {0}:
            edge = self.tree.edges[i]
            if i in above:
                if edge.cardinality != "many" or not all(self.unique(p, i) for p in edge.parents):
                    return False
            elif edge.cardinality != "one":
                return False
        return True

    def unique(self, parent: int, child: int) -> bool:
        """Whether the parent's join columns hold a key that was declared unique, so that a child row meets one parent row."""
        predicate = self.tree.edges[child].predicate
        if predicate is None or not equalities(predicate, child):
            return False
        used = {repr(b) for b in walk(predicate) if isinstance(b, Bound) and b.leaf == parent}
        return any(repr(self.tree._in_leaf(as_expr(self.tree.leaves[parent].dims[k].expr), parent, (k,))) in used for k in self.tree.unique_keys(parent))

    # aggregation

    def frame(self, leaf: int | None, array: tuple[str, ...], keys: dict[str, Expr], bases: list[Base], filters: list[Expr]) -> DataFrame:
        """Keys and base measures of one source; every group of the filtered join is there."""
        tree = self.tree
        asked = set().union(*map(owners, keys.values()), *map(owners, filters)) if keys or filters else set()
        if leaf is None:
            leaves = set(range(len(tree.leaves)))
            df = self._filtered(self.joined(leaves), filters)
            return self._grouped(df.select("*", *[scalar(e).alias(k) for k, e in keys.items()]), keys, bases, None)
        leaves = self.needed(asked | {leaf})
        guard = None if leaf == 0 else quoted(mark(leaf)).isNotNull()
        own = [f for f in filters if owners(f) == {leaf}]
        rest = [f for f in filters if owners(f) != {leaf}]
        if self.single(leaf, leaves):
            if not array and (late := self.deferrable(leaf, leaves, keys, bases, filters)):
                return self._deferred(leaves - late, late, keys, bases, filters)
            df = self._filtered(self.joined(leaves), filters)
            df = df.select("*", *[scalar(e).alias(k) for k, e in keys.items()])
        else:
            repeatable = all(a.kind in IDEMPOTENT for m in bases for a in walk(m.expr) if isinstance(a, Agg))
            df = self._bridged(leaf, leaves, keys, own, rest, repeatable)
            if df is None:
                df = self._linked(leaf, leaves, keys, own, rest)
        if array:
            df, guard = self._exploded(df, leaf, array, [*keys])
        return self._grouped(df, keys, bases, guard)

    def deferrable(self, leaf: int, leaves: set[int], keys: dict[str, Expr], bases: list[Base], filters: list[Expr]) -> set[int]:
        """Large dimension tables that only give group keys: the facts are aggregated by their join key first.

        Joins must be plain equalities, and every reduction one that adds up. A table that Spark would broadcast stays where it is.
        """
        tree = self.tree
        if leaf or not all(a.kind in PARTIAL and not a.params for b in bases for a in walk(b.expr) if isinstance(a, Agg)):
            return set()
        out = set()
        for i in leaves - {0}:
            edge = tree.edges[i]
            parts = [c for c in walk(edge.predicate) if isinstance(c, Call)] if edge.predicate is not None else []
            plain = parts and all(c.func == "&" or c.func == "==" and all(isinstance(a, Bound) for a in c.args) for c in parts)
            alone = edge.parents == {0} and edge.cardinality == "one" and not any(i in tree.edges[j].parents for j in leaves - {0})
            whole = all(owners(e) == {i} or i not in owners(e) for e in keys.values()) and not any(i in owners(f) for f in filters)
            if plain and alone and whole and not self.small(i):
                out.add(i)
        return out

    def small(self, leaf: int) -> bool:
        """Whether a leaf's estimated size is within Spark's broadcast limit; it takes no job to tell."""
        df = self.tree.leaves[leaf].df
        limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit

    def _deferred(self, early: set[int], late: set[int], keys: dict[str, Expr], bases: list[Base], filters: list[Expr]) -> DataFrame:
        """Facts aggregated by keys and join keys, then the late tables joined, then the same reductions of the partial ones."""
        tree = self.tree
        df = self._filtered(self.joined(early), filters)
        own = {k: e for k, e in keys.items() if not owners(e) & late}
        on = sorted({physical(b.leaf, b.column) for i in late for b in walk(tree.edges[i].predicate) if isinstance(b, Bound) and b.leaf == 0})
        partial: dict[str, tuple[str, Agg]] = {}
        for b in bases:
            for a in walk(b.expr):
                if isinstance(a, Agg):
                    for kind in ("sum", "count") if a.kind == "mean" else (a.kind,):
                        part = Agg(kind, a.arg, a.where)
                        partial.setdefault(repr(part), (f"__part_{len(partial)}", part))
        first = df.select("*", *[scalar(e).alias(k) for k, e in own.items()]).groupBy(*[quoted(k) for k in own], *[quoted(c) for c in on if c not in own]).agg(*[reduction(a, scalar, None, self.truth).alias(n) for n, a in partial.values()])
        for i in sorted(late):
            first = first.join(self.leaf_frame(i), scalar(tree.edges[i].predicate), "left")
        first = first.select("*", *[scalar(e).alias(k) for k, e in keys.items() if k not in own])

        def again(e: Any) -> Column:
            if isinstance(e, Agg):
                if e.kind == "mean":
                    total, n = (partial[repr(Agg(k, e.arg, e.where))][0] for k in ("sum", "count"))
                    return F.try_divide(F.sum(total).cast("double"), F.sum(n).cast("double"))
                c = F.col(partial[repr(e)][0])
                return {"min": F.min, "max": F.max}.get(e.kind, F.sum)(c)
            if isinstance(e, Call):
                return compile_call(e.func, e.args, again)
            return again(e.arg) if isinstance(e, Named) else scalar(e)

        counted = lambda b: F.coalesce(again(b.expr), F.lit(0)) if isinstance(b.expr, Agg) and b.expr.kind == "count" else again(b.expr)
        return first.groupBy(*[quoted(k) for k in keys]).agg(*[counted(b).alias(b.name) for b in bases])

    def _parts(self, leaf: int, leaves: set[int]) -> list[set[int]]:
        """What leaves fall into without one of them, each part in order of its first leaf."""
        parts: list[set[int]] = []
        for i in sorted(leaves - {leaf}):
            near = (self.tree.edges[i].parents & leaves) - {leaf} if i else set()
            hit = [p for p in parts if p & near]
            parts = [p for p in parts if not p & near] + [{i}.union(*hit)]
        return sorted(parts, key=min)

    def _bridged(self, leaf: int, leaves: set[int], keys: dict[str, Expr], own: list[Expr], rest: list[Expr], repeatable: bool) -> DataFrame | None:
        """Rows of a leaf against a bridge for each part of the model around it; None if a predicate, key or filter doesn't allow it.

        A bridge holds the distinct group keys and join keys of its part. Joins by equality fix the join keys, so a row meets each combination of
        group keys once. repeatable: a row may count more often, so the only bridge below needn't be distinct.
        """
        tree = self.tree
        parts = self._parts(leaf, leaves)
        tops = {n: min(p) for n, p in enumerate(parts) if 0 not in p}
        fits = all(leaf not in tree.edges[i].parents or i in tops.values() and tree.edges[i].parents == {leaf} for i in leaves - {0, leaf})
        fits = fits and all(tree.edges[i].predicate is None or equalities(tree.edges[i].predicate, i) for i in [*tops.values(), *([leaf] if leaf else [])])
        fits = fits and all(not owners(e) or owners(e) == {leaf} or any(owners(e) <= p for p in parts) for e in (*keys.values(), *rest))
        fits = fits and (leaf == 0 or all(rejects(f, {leaf}) for f in own))
        fits = fits and all(rejects(f, p) for n, p in enumerate(parts) if n in tops for f in rest if owners(f) and owners(f) <= p)
        if not fits:
            return None

        def inside(part: set[int]) -> tuple[DataFrame, list[Column], list[Expr]]:
            held = [f for f in rest if owners(f) and owners(f) <= part]
            return self._filtered(self.joined(part), held), [scalar(e).alias(k) for k, e in keys.items() if owners(e) and owners(e) <= part], held

        def link(i: int, part: set[int]) -> list[Column]:
            return [quoted(c) for c in sorted({physical(b.leaf, b.column) for b in walk(tree.edges[i].predicate) if isinstance(b, Bound) and b.leaf in part})]

        df = self._filtered(self.leaf_frame(leaf), own)
        if leaf:
            up = next(p for p in parts if 0 in p)
            bridge, found, _ = inside(up)
            bridge = bridge.select(*(found + link(leaf, up) or [F.lit(1).alias("__any")])).distinct()
            predicate = tree.edges[leaf].predicate
            df = bridge.crossJoin(df) if predicate is None else bridge.join(df, scalar(predicate), "inner" if own else "left")
        for n, top in tops.items():
            bridge, found, held = inside(parts[n])
            predicate = tree.edges[top].predicate
            if predicate is not None and not found:
                df = df.join(bridge.select(*link(top, parts[n])), scalar(predicate), "left_semi") if held else df
                continue
            bridge = bridge.select(*found, *link(top, parts[n])) if predicate is not None or found else bridge.select(F.lit(1).alias("__any"))
            bridge = bridge if repeatable and len(tops) == 1 else bridge.distinct()
            df = df.crossJoin(bridge) if predicate is None else df.join(bridge, scalar(predicate), "inner" if held else "left")
        df = self._filtered(df, [f for f in rest if not owners(f)])
        return df.select("*", *[scalar(e).alias(k) for k, e in keys.items() if not owners(e) or owners(e) == {leaf}])

    def _linked(self, leaf: int, leaves: set[int], keys: dict[str, Expr], own: list[Expr], rest: list[Expr]) -> DataFrame:
        """Rows of a leaf against the distinct combinations of group keys and those of its own columns that predicates, mixed keys and filters read."""
        tree = self.tree
        edges = [tree.edges[i].predicate for i in leaves - {0}]
        mixed = [e for e in (*keys.values(), *rest) if leaf in owners(e) and owners(e) != {leaf}]
        columns = sorted({physical(leaf, b.column) for e in (*edges, *mixed, *(own if leaf else [])) for b in walk(e) if isinstance(b, Bound) and b.leaf == leaf})
        rows = self._filtered(self.leaf_frame(leaf), own)
        few = (self.leaf_frame(leaf) if leaf else rows).select(*map(quoted, columns), quoted(mark(leaf))).distinct()
        df = self._filtered(self.joined(leaves, {leaf: few}), [*rest, *(own if leaf else [])])
        outer = {k: e for k, e in keys.items() if owners(e) - {leaf}}
        bridge = df.select(*[scalar(e).alias(k) for k, e in outer.items()], quoted(mark(leaf)).alias("__met"), *[quoted(c).alias(f"__met{n}") for n, c in enumerate(columns)]).distinct()
        on = reduce(lambda a, b: a & b, [quoted(f"__met{n}").eqNullSafe(quoted(c)) for n, c in enumerate(columns)], quoted("__met").isNotNull())
        df = bridge.join(rows, on, "left" if leaf else "inner")
        return df.select("*", *[scalar(e).alias(k) for k, e in keys.items() if k not in outer])

    def _exploded(self, df: DataFrame, leaf: int, array: tuple[str, ...], keep: list[str]) -> tuple[DataFrame, Column]:
        """One row an element of an array path; groups whose arrays are all empty keep one row without an element."""
        element: Column = quoted(physical(leaf, array[0]))
        df = df.select(*[quoted(k) for k in keep], F.posexplode_outer(element).alias("__at", "__element"))
        for step in array[1:]:
            below = F.col("__element")
            for name in step:
                below = below.getField(name)
            df = df.select(*[quoted(k) for k in keep], F.posexplode_outer(below).alias("__at", "__element"))
        return df, F.col("__at").isNotNull()

    def _filtered(self, df: DataFrame, filters: list[Expr]) -> DataFrame:
        for f in filters:
            df = df.filter(scalar(f))
        return df

    def _grouped(self, df: DataFrame, keys: dict[str, Expr], bases: list[Base], guard: Column | None) -> DataFrame:
        names = [quoted(k) for k in keys]
        if not bases:
            return df.select(*names).distinct()
        return df.groupBy(*names).agg(*[self._reduced(b, guard).alias(b.name) for b in bases])

    def _reduced(self, base: Base, guard: Column | None) -> Column:
        def column(e: Any) -> Column:
            if isinstance(e, Agg):
                return reduction(e, inside, guard, self.truth)
            if isinstance(e, Call):
                return compile_call(e.func, e.args, column)
            if isinstance(e, Named):
                return column(e.arg)
            return F.lit(e.value) if isinstance(e, Lit) else F.first(inside(e), ignorenulls=True)

        def inside(e: Any) -> Column:
            if base.array and isinstance(e, Element):
                c = F.col("__element")
                for p in e.path:
                    c = c.getField(p)
                return c
            if isinstance(e, Call):
                return compile_call(e.func, e.args, inside)
            return scalar(e)

        return column(base.expr)

    # measures

    def array_path(self, e: Expr, leaf: int) -> tuple[tuple, tuple[str, ...]] | None:
        """(array path, field path of an element) of a reduction's argument that lies in arrays of a leaf, else None.

        The array path is the column, then for each further array the fields that lead to it from an element of the one before.
        """
        path: list[str] = []
        while isinstance(e, Call) and e.func == "struct_field":
            path.insert(0, e.args[1].value)
            e = e.args[0]
        if not isinstance(e, Bound) or e.column not in self.tree.columns(e.leaf):
            return None
        kind = self.tree.leaves[leaf].df.schema[e.column].dataType
        arrays, inner, at = [e.column], [], kind
        if not isinstance(kind, T.ArrayType):
            return None
        at = kind.elementType
        for p in path:
            if not isinstance(at, T.StructType) or p not in at.names:
                raise UnknownFieldError(p, at.names if isinstance(at, T.StructType) else [], "nested field")
            at = at[p].dataType
            if isinstance(at, T.ArrayType):
                arrays.append((*inner, p))
                inner = []
                at = at.elementType
            else:
                inner.append(p)
        return tuple(arrays), tuple(inner)

    def owner(self, name: str, e: Expr, declared: int | None) -> int | None:
        if declared is not None:
            return declared
        found = owners(e)
        if not found:
            return None if any(isinstance(x, Agg) for x in walk(e)) and self.tree.joined else 0
        if len(found) > 1:
            raise CompilationError(f"measure {name!r} reads several models; define it on one of them")
        return found.pop()


@dataclass(frozen=True, eq=False)
class Element(Expr):
    """The element of the array that a nested reduction runs over."""

    path: tuple[str, ...] = ()

    __hash__ = Expr.__hash__


def aggregate(tree: Tree, keys: dict[str, Expr], wanted: dict[str, Any], filters: list[Expr]) -> Plan:
    """Group keys (public name to bound expression) and measures (public name to expression or measure name) as a frame."""
    planner = Planner(tree)
    known = tree.measure_names()
    bases: dict[str, Base] = {}
    calculated: dict[str, Expr] = {}
    totals: set[str] = set()
    local = {k: v for k, v in wanted.items() if not isinstance(v, str)}
    shadow = {n for n in keys}

    def measure(name: str, stack: tuple[str, ...] = ()) -> None:
        """Plans a measure by its public or local name, with all that it depends on."""
        if name in bases or name in calculated:
            return
        if name in stack:
            raise CompilationError(f"measures refer to each other in a cycle: {' -> '.join((*stack, name))}")
        if name in local:
            leaf, expr = None, resolve_local(as_expr(local[name]), name)
        else:
            leaf, m = known[name]
            expr = tree.bind_measure(as_expr(m.expr), leaf, name, m.prefer_measures)
        plan(name, expr, leaf, stack)

    def resolve_local(e: Expr, name: str) -> Expr:
        def f(x: Expr) -> Expr | None:
            if isinstance(x, Field) and x.field in local and x.field != name and not any(isinstance(y, Field) and y.field == name for y in walk(as_expr(local[x.field]))):
                return MeasureRef(x.field)
            return None

        return tree.bind_measure(rebuild(e, f), None, name)

    def plan(name: str, e: Expr, leaf: int | None, stack: tuple[str, ...]) -> None:
        if isinstance(e, Named):
            e = e.arg
        nested = lift_arrays(name, e, leaf)
        if nested is not None:
            e = nested
        if not is_calculated(e) and nested is None:
            if not has_reduction(e) and owners(e):
                hit = next((k for k, v in keys.items() if all(repr(b) in {repr(x) for x in walk(v)} for b in walk(e) if isinstance(b, Bound))), None)
                if hit is None:
                    raise QueryError(f"{name!r} is neither a reduction nor an expression of the group keys")
                calculated[name] = rebuild(e, lambda x: next((MeasureRef(k) for k, v in keys.items() if repr(v) == repr(x)), None))
                return
            bases[name] = Base(name, e, planner.owner(name, e, leaf))
            return

        def lift(x: Expr) -> Expr | None:
            """Reductions inside a calculation become measures of their own."""
            if isinstance(x, Over) and isinstance(x.arg, (Agg, WinFunc)):
                return Over(rebuild_window(x.arg), rebuild(x.window, lift_keys))
            if isinstance(x, Agg):
                return MeasureRef(anonymous(x, leaf))
            if isinstance(x, Total) and isinstance(x.arg, str):
                return Total(MeasureRef(x.arg))
            if isinstance(x, Bound):
                hit = next((k for k, v in keys.items() if repr(v) == repr(x)), None)
                if hit is not None:
                    return MeasureRef(hit)
                raise QueryError(f"{name!r} reads column {x.column!r} outside a reduction")
            return None

        def lift_keys(x: Expr) -> Expr | None:
            if isinstance(x, Bound):
                hit = next((k for k, v in keys.items() if repr(v) == repr(x)), None)
                return MeasureRef(hit) if hit is not None else None
            return lift(x)

        if isinstance(e, Over) and isinstance(e.arg, Agg) and not e.window.group_by and not e.window.order_by and e.window.rows is None:
            read = [repr(b) for b in walk(e.arg) if isinstance(b, Bound)]
            if read and set(read) <= {repr(v) for v in keys.values()}:
                from ..errors import WindowedBaseReductionError

                raise WindowedBaseReductionError(f"{name!r}: an empty window over a reduction of group keys is ambiguous; all() totals the rows, and over() of a measure the groups")

        def rebuild_window(a: Agg | WinFunc) -> Expr:
            if isinstance(a, WinFunc):
                return WinFunc(a.kind, tuple(rebuild(x, lift) for x in a.args))
            inner = a.arg
            if inner is None or not any(isinstance(x, Bound) for x in walk(inner)) or all(isinstance(x, MeasureRef) for x in walk(rebuild(inner, lift_keys)) if isinstance(x, (Bound, MeasureRef))):
                return Agg(a.kind, None if inner is None else rebuild(inner, lift_keys), a.where, a.params)
            # a reduction of raw rows under a window: reduce each group, then add up over the window
            if a.kind not in ("sum", "count", "min", "max", "any", "all"):
                from ..errors import WindowedBaseReductionError

                raise WindowedBaseReductionError(f"{a.kind}() of raw rows can't be computed over a window of groups")
            return Agg("sum" if a.kind == "count" else a.kind, MeasureRef(anonymous(a, leaf)))

        e = rebuild(e, lift)
        calculated[name] = e
        for x in walk(e):
            if isinstance(x, MeasureRef) and x.measure not in keys:
                need(x.measure, (*stack, name))
        for x in walk(e):
            if isinstance(x, Total):
                for y in walk(x.arg):
                    if isinstance(y, MeasureRef):
                        want_total(y.measure)

    def need(n: str, stack: tuple[str, ...]) -> None:
        if n not in bases and n not in calculated:
            measure(n, stack)

    def want_total(n: str) -> None:
        if n in keys:
            raise QueryError(f"{n!r} is a group key and has no total")
        if n in totals:
            return
        totals.add(n)
        if n in calculated:
            for y in walk(calculated[n]):
                if isinstance(y, MeasureRef):
                    want_total(y.measure)

    def anonymous(a: Agg, leaf: int | None) -> str:
        for n, b in bases.items():
            if repr(b.expr) == repr(a):
                return n
        n = f"__reduction_{len(bases)}"
        got = lift_arrays(n, a, leaf)
        if got is None:
            bases[n] = Base(n, a, planner.owner(n, a, leaf))
        else:
            return got.measure
        return n

    def lift_arrays(name: str, e: Expr, leaf: int | None) -> Expr | None:
        """Reductions over arrays become measures at their own grain; None if there are none."""
        hit = False

        def f(x: Expr) -> Expr | None:
            nonlocal hit
            if isinstance(x, Agg) and x.arg is not None and x.kind != "collect" and len(own := owners(x.arg)) == 1:
                at = next(iter(own))
                found = None
                inner = x.arg
                if isinstance(inner, Bound) or isinstance(inner, Call) and inner.func == "struct_field":
                    found = planner.array_path(inner, at)
                if found is not None:
                    hit = True
                    arrays, fields = found
                    # counting an array counts its elements, nulls among them too
                    agg = Agg("count") if x.kind == "count" and not fields else Agg(x.kind, Element(fields), None, x.params)
                    n = name if x is e else f"__nested_{len(bases)}"
                    bases[n] = Base(n, agg, at, arrays)
                    return MeasureRef(n)
            return None

        out = rebuild(e, f)
        if not hit:
            return None
        return out

    for name, what in wanted.items():
        measure(what if isinstance(what, str) else name)
        if name in bases and name in calculated and isinstance(calculated[name], MeasureRef) and calculated[name].measure == name:
            del calculated[name]

    arrays = [Bound(b.leaf, b.array[0]) for b in bases.values() if b.array]
    planner.read_only(*keys.values(), *filters, *(b.expr for b in bases.values()), *arrays)
    df = combined(planner, keys, list(bases.values()), filters)
    if totals:
        sums = combined(planner, {}, [b for b in bases.values() if b.name in totals], filters)
        sums = sums.select(*[quoted(c).alias(f"__total__{c}") for c in sums.columns])
        if sums.columns:
            df = df.crossJoin(F.broadcast(sums))  # one row

    def post(e: Any, total: bool = False) -> Column:
        if isinstance(e, MeasureRef):
            if total and e.measure in calculated:
                return post(calculated[e.measure], True)
            return quoted(f"__total__{e.measure}") if total else quoted(e.measure)
        if isinstance(e, Total):
            inner = post(e.arg, True)
            return inner.cast("double") if integral(e.arg) else inner
        if isinstance(e, (Lit, Param)):
            return lit(e.value if isinstance(e, Lit) else e.default)
        if isinstance(e, Raw):
            return e.column
        if isinstance(e, Named):
            return post(e.arg, total)
        if isinstance(e, Call):
            return compile_call(e.func, e.args, lambda a: post(a, total))
        if isinstance(e, Over):
            if not isinstance(e.arg, (Agg, WinFunc)):
                raise CompilationError("over() follows a reduction or a window function")
            return windowed(e.arg, e.window, post, [])
        if isinstance(e, WinFunc):
            raise CompilationError(f"{e.kind}() needs a window")
        if isinstance(e, Field):
            return quoted(e.field)
        raise CompilationError(f"can't compute {e!r} on a result")

    def integral(e: Any) -> bool:
        return isinstance(e, MeasureRef) and e.measure in bases

    for name in ordered(calculated):
        df = df.withColumn(name, post(calculated[name]))
    names = list(wanted)
    outputs = [quoted(k) for k in keys] + [quoted(w if isinstance(w, str) else n).alias(n) for n, w in wanted.items()]
    additive = {n: bases[b].expr.kind for n, w in wanted.items() if (b := w if isinstance(w, str) else n) in bases and isinstance(bases[b].expr, Agg) and bases[b].expr.kind in ("sum", "count", "min", "max")}
    return Plan(df.select(*outputs), list(keys), names, additive)


def ordered(calculated: dict[str, Expr]) -> list[str]:
    """Calculated measures, each after those that it reads."""
    out: list[str] = []

    def visit(n: str, stack: tuple[str, ...]) -> None:
        if n in out:
            return
        if n in stack:
            raise CompilationError(f"measures refer to each other in a cycle: {' -> '.join((*stack, n))}")
        for x in walk(calculated[n]):
            if isinstance(x, MeasureRef) and x.measure in calculated and x.measure != n:
                visit(x.measure, (*stack, n))
        out.append(n)

    for n in calculated:
        visit(n, ())
    return out


def combined(planner: Planner, keys: dict[str, Expr], bases: list[Base], filters: list[Expr]) -> DataFrame:
    """Base measures of all sources side by side, joined null-safely on the keys."""
    by: dict[tuple[int | None, tuple[str, ...]], list[Base]] = {}
    for b in bases:
        by.setdefault((b.leaf, b.array), []).append(b)
    if not by:
        return keys_only(planner, keys, filters)
    frames = [planner.frame(leaf, array, keys, group, filters) for (leaf, array), group in by.items()]

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        if not keys:
            return a.crossJoin(F.broadcast(b))  # one row each
        names = {k: f"__again__{i}" for i, k in enumerate(keys)}
        b = b.select(*[quoted(k).alias(n) for k, n in names.items()], *[quoted(c) for c in b.columns if c not in names])
        on = reduce(lambda x, y: x & y, [quoted(k).eqNullSafe(quoted(n)) for k, n in names.items()])
        return a.join(b, on, "left").drop(*names.values())

    out = reduce(meet, frames)
    counts = [b.name for b in bases if isinstance(b.expr, Agg) and b.expr.kind in ("count", "nunique", "approx_nunique")]
    return out.withColumns({n: F.coalesce(quoted(n), F.lit(0)) for n in counts}) if len(frames) > 1 and counts else out


def keys_only(planner: Planner, keys: dict[str, Expr], filters: list[Expr]) -> DataFrame:
    """The distinct group keys; keys of a single model come from that model, with members that no row refers to."""
    if not keys:
        raise QueryError("a query needs a dimension or a measure")
    asked = set().union(*map(owners, keys.values()))
    if len(asked) == 1 and not filters:
        df = planner.leaf_frame(next(iter(asked)))
    else:
        df = planner._filtered(planner.joined(planner.needed(asked.union(*map(owners, filters)))), filters)
    return df.select(*[scalar(e).alias(k) for k, e in keys.items()]).distinct()
