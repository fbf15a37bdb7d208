"""What a model is: leaves with declared fields, joins of declared cardinality, and how names resolve in them."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DefinitionError, QueryError, UnknownFieldError
from ..expr.nodes import Agg, Attr, Bound, Call, Expr, Field, Lit, MeasureRef, Over, Raw, Total, WinFunc, as_expr, rebuild, walk


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Dimension:
    expr: Any
    description: str | None = None
    is_entity: bool = False
    is_time_dimension: bool = False
    is_event_timestamp: bool = False
    smallest_time_grain: str | None = None
    derived_dimensions: tuple[str, ...] = ()
    metadata: dict[str, Any] = field(default_factory=dict)
    #: Whether no two rows have the same value; the planner relies on it, and on nothing else but declared cardinality.
    is_unique: bool = False

    def to_json(self) -> dict[str, Any]:
        out: dict[str, Any] = {"description": self.description}
        for k in ("is_entity", "is_event_timestamp", "is_time_dimension", "is_unique"):
            if getattr(self, k):
                out[k] = True
        if self.is_time_dimension:
            out["smallest_time_grain"] = self.smallest_time_grain
        return out | dict(self.metadata)


@dataclass(frozen=True)
class Measure:
    expr: Any
    description: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    prefer_measures: bool = False

    def to_json(self) -> dict[str, Any]:
        return {"description": self.description} | dict(self.metadata)


@dataclass(frozen=True)
class Leaf:
    """A table with its declared fields; filters hold before any join."""

    name: str | None
    df: DataFrame
    dims: dict[str, Dimension] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    filters: tuple[Expr, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Join:
    """A left or cross join of two models, with fields and filters declared on the joined model."""

    left: Leaf | Join
    right: Leaf | Join
    on: Any
    how: str
    cardinality: str
    dims: dict[str, Dimension] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    filters: tuple[Expr, ...] = ()


Node = Leaf | Join


def leaves_of(node: Node) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    else:
        yield from leaves_of(node.left)
        yield from leaves_of(node.right)


@dataclass(frozen=True, eq=False)
class Side(Expr):
    """A column of the left or right side of a join predicate."""

    side: str
    path: tuple[str, ...] = ()

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        return Side(self.side, (*self.path, name))

    def __getitem__(self, name: Any) -> Any:
        return Side(self.side, (*self.path, name))

    def __call__(self, *args: Any, **kw: Any) -> Expr:
        from ..expr.nodes import method

        return method(Side(self.side, self.path[:-1]), self.path[-1], args, kw)

    __hash__ = Expr.__hash__


def _key_pairs(on: Any) -> Expr:
    """The predicate of any form of on: a name, a field, a list of them, or a lambda of both sides."""
    if isinstance(on, str):
        return Call("==", (Side("left", (on,)), Side("right", (on,))))
    if isinstance(on, (list, tuple)):
        parts = [_key_pairs(o) for o in on]
        if not parts:
            raise DefinitionError("a join needs a key")
        out = parts[0]
        for p in parts[1:]:
            out = Call("&", (out, p))
        return out
    if isinstance(on, Field):
        return _key_pairs(on.field)
    if isinstance(on, Expr) and any(isinstance(x, Side) for x in walk(on)):
        return on
    if callable(on) and not isinstance(on, Expr):
        return on(Side("left"), Side("right"))
    raise DefinitionError("on must be a name, a field, a list of them or a lambda of both sides")


@dataclass
class Edge:
    """How a leaf joins the leaves before it."""

    parents: frozenset[int]
    predicate: Expr | None
    cardinality: str


class Tree:
    """A flattened model. Columns of leaf i are named ``__i__column`` everywhere, so that names never collide."""

    def __init__(self, node: Node):
        self.leaves: list[Leaf] = []
        self.edges: dict[int, Edge] = {}
        self.dims: dict[str, Dimension] = {}
        self.measures: dict[str, Measure] = {}
        self.filters: list[Expr] = []
        self.raws: dict[int, dict[str, Column]] = {}
        self._add(node)
        names = [x.name for x in self.leaves if x.name]
        if len(names) != len(set(names)):
            raise DefinitionError(f"joined models need different names: {sorted(n for n in set(names) if names.count(n) > 1)}")
        self.joined = len(self.leaves) > 1
        self.by_name = {x.name: i for i, x in enumerate(self.leaves) if x.name}

    def _add(self, node: Node) -> list[int]:
        if isinstance(node, Leaf):
            self.leaves.append(node)
            return [len(self.leaves) - 1]
        left = self._add(node.left)
        filters = len(self.filters)
        right = self._add(node.right)
        if len(self.filters) > filters:
            raise QueryError("a joined model that is filtered can't be the right side of a join; filter its own models")
        root = right[0]
        predicate = None if node.cardinality == "cross" else rebuild(_key_pairs(node.on), lambda e: self._side(e, left, right))
        parents = {root_ for root_ in left[:1]}
        if predicate is not None:
            bound = {b.leaf for b in walk(predicate) if isinstance(b, Bound)}
            if not bound & set(left) or not bound & set(right):
                raise DefinitionError("a join predicate must compare both sides")
            parents = bound & set(left)
            if bound & set(right) - {root}:
                raise DefinitionError("a join must use columns of the first model of its right side")
        self.edges[root] = Edge(frozenset(parents), predicate, node.cardinality)
        self.dims |= node.dims
        self.measures |= node.measures
        self.filters += node.filters
        return left + right

    def _side(self, e: Expr, left: list[int], right: list[int]) -> Expr | None:
        if isinstance(e, Side):
            among = left if e.side == "left" else right
            path = e.path
            if len(path) > 1 and path[0] in (names := {self.leaves[i].name: i for i in among}):
                among, path = [names[path[0]]], path[1:]
            for i in among:
                found = None
                if path[0] in self.columns(i):
                    found = Bound(i, path[0])
                elif path[0] in self.leaves[i].dims:
                    found = self._in_leaf(as_expr(self.leaves[i].dims[path[0]].expr), i, (path[0],))
                if found is not None:
                    for p in path[1:]:
                        found = Call("struct_field", (found, Lit(p)))
                    return found
            raise UnknownFieldError(path[0], [c for i in among for c in self.columns(i)], "join column")
        return None

    def columns(self, leaf: int) -> list[str]:
        return self.leaves[leaf].df.columns

    def lifted(self, leaf: int | None, x: Raw) -> Bound:
        """A Spark column of the user's, evaluated on its own table under a name of its own."""
        if leaf is None:
            if self.joined:
                raise QueryError("a Spark column belongs to a single model; define it there")
            leaf = 0
        known = self.raws.setdefault(leaf, {})
        for name, c in known.items():
            if c is x.column:
                return Bound(leaf, name)
        name = f"__raw{len(known)}"
        known[name] = x.column
        return Bound(leaf, name)

    # names

    def qualified(self, leaf: int, name: str) -> str:
        own = self.leaves[leaf].name
        return f"{own}.{name}" if self.joined and own else name

    def dimension_names(self) -> dict[str, tuple[int | None, Dimension]]:
        """All declared dimensions by their public names."""
        out: dict[str, tuple[int | None, Dimension]] = {self.qualified(i, n): (i, d) for i, x in enumerate(self.leaves) for n, d in x.dims.items()}
        return out | {n: (None, d) for n, d in self.dims.items()}

    def measure_names(self) -> dict[str, tuple[int | None, Measure]]:
        out: dict[str, tuple[int | None, Measure]] = {self.qualified(i, n): (i, m) for i, x in enumerate(self.leaves) for n, m in x.measures.items()}
        return out | {n: (None, m) for n, m in self.measures.items()}

    def find(self, name: str, known: Any) -> str | None:
        """The public name that a name means: itself, its one suffix match, or itself without the name of the only model."""
        if name in known:
            return name
        near = [k for k in known if k.endswith(f".{name}")]
        if len(near) == 1:
            return near[0]
        if not self.joined and self.leaves[0].name and name.startswith(f"{self.leaves[0].name}.") and (bare := name.split(".", 1)[1]) in known:
            return bare
        return None

    def raw(self, name: str) -> Bound | None:
        """An undeclared column, bare or as model.column."""
        if "." in name:
            own, bare = name.split(".", 1)
            if own in self.by_name and bare in self.columns(self.by_name[own]):
                return Bound(self.by_name[own], bare)
        for i in range(len(self.leaves)):
            if name in self.columns(i):
                return Bound(i, name)
        # collision names of the right side: x_right, x_right2, ...
        if "_right" in name:
            bare, _, nth = name.rpartition("_right")
            having = [i for i in range(len(self.leaves)) if bare in self.columns(i)]
            k = int(nth) if nth.isdigit() else 1 if not nth else 0
            if 0 < k < len(having):
                return Bound(having[k], bare)
        return None

    # binding

    def dimension(self, name: str, seen: tuple[str, ...] = ()) -> Expr:
        """The bound expression of a dimension or raw column by name."""
        known = self.dimension_names()
        full = self.find(name, known)
        if full is None:
            near = [k for k in known if k.endswith(f".{name}")]
            if near:
                raise QueryError(f"{name!r} is ambiguous: {', '.join(sorted(near))}")
            if (raw := self.raw(name)) is not None:
                return raw
            raise UnknownFieldError(name, [*known, *(c for i in range(len(self.leaves)) for c in self.columns(i))], "dimension")
        leaf, d = known[full]
        if leaf is not None:
            bare = full.split(".", 1)[1] if self.joined and self.leaves[leaf].name else full
            return self._in_leaf(as_expr(d.expr), leaf, (bare,))
        if full in seen:
            raise DefinitionError(f"dimensions refer to each other in a cycle: {' -> '.join((*seen, full))}")
        return self.bind(as_expr(d.expr), (*seen, full))

    def _path(self, e: Expr) -> list[str] | None:
        if isinstance(e, Field):
            return [e.field]
        if isinstance(e, Attr) and (base := self._path(e.base)) is not None:
            return [*base, e.attr]
        return None

    @staticmethod
    def _fields(e: Expr, path: list[str]) -> Expr:
        for p in path:
            e = Call("struct_field", (e, Lit(p)))
        return e

    def _in_leaf(self, e: Expr, leaf: int, seen: tuple[str, ...]) -> Expr:
        """Binds an expression of a leaf's dimension: sibling dimensions by name, then columns."""
        dims, columns = self.leaves[leaf].dims, set(self.columns(leaf))

        def f(x: Expr) -> Expr | None:
            if isinstance(x, Raw):
                return self.lifted(leaf, x)
            path = self._path(x)
            if path is None:
                return None
            if path[0] == self.leaves[leaf].name and len(path) > 1 and path[0] not in columns and path[0] not in dims:
                path = path[1:]
            name = path[0]
            if name in dims and name not in seen:
                return self._fields(self._in_leaf(as_expr(dims[name].expr), leaf, (*seen, name)), path[1:])
            if name in columns:
                return self._fields(Bound(leaf, name), path[1:])
            if name in dims:
                raise DefinitionError(f"dimensions refer to each other in a cycle: {' -> '.join((*seen, name))}")
            raise UnknownFieldError(name, [*dims, *columns], "field")

        return rebuild(e, f)

    def bind(self, e: Expr, seen: tuple[str, ...] = ()) -> Expr:
        """Binds an expression of the whole model, such as a filter: dimensions first, then model.field, then columns."""

        def f(x: Expr) -> Expr | None:
            if isinstance(x, Raw):
                return self.lifted(None, x)
            path = self._path(x)
            if path is None:
                return None
            if len(path) > 1 and path[0] in self.by_name:
                leaf = self.by_name[path[0]]
                if path[1] in self.leaves[leaf].dims:
                    return self._fields(self._in_leaf(as_expr(self.leaves[leaf].dims[path[1]].expr), leaf, (path[1],)), path[2:])
                if path[1] in self.columns(leaf):
                    return self._fields(Bound(leaf, path[1]), path[2:])
                if path[0] not in self.dimension_names() and self.raw(path[0]) is None:
                    raise UnknownFieldError(f"{path[0]}.{path[1]}", [f"{path[0]}.{c}" for c in [*self.leaves[leaf].dims, *self.columns(leaf)]])
            if path[0] in seen and (raw := self.raw(path[0])) is not None:
                return self._fields(raw, path[1:])
            return self._fields(self.dimension(path[0], seen), path[1:])

        return rebuild(e, f)

    def bind_measure(self, e: Expr, leaf: int | None, name: str | None, prefer_measures: bool = False) -> Expr:
        """Binds a measure's expression: columns before measures of the same name (or after, if so preferred), then dimensions."""
        measures = self.measure_names()

        def as_measure(n: str) -> MeasureRef | None:
            if n == name:
                return None
            if leaf is not None and (own := self.qualified(leaf, n)) in measures:
                return MeasureRef(own) if own != name else None
            full = self.find(n, measures)
            return MeasureRef(full) if full is not None and full != name else None

        def f(x: Expr) -> Expr | None:
            if isinstance(x, Total) and isinstance(x.arg, str):
                full = as_measure(x.arg)
                if full is not None:
                    return Total(full)
                warnings.warn(f"all({x.arg!r}) names a column; use all(t.{x.arg}.sum())", DeprecationWarning, stacklevel=2)
                return Total(Agg("sum", f(Field(x.arg))))
            if isinstance(x, Raw):
                return self.lifted(leaf, x)
            path = self._path(x)
            if path is None:
                return None
            dotted = ".".join(path)
            if leaf is not None:
                columns, dims = self.columns(leaf), self.leaves[leaf].dims
                own = path[1:] if path[0] == self.leaves[leaf].name and len(path) > 1 and path[0] not in columns else path
                if prefer_measures and len(own) == 1 and (m := as_measure(own[0])) is not None:
                    return m
                if own[0] in columns:
                    return self._fields(Bound(leaf, own[0]), own[1:])
                if (m := as_measure(".".join(own))) is not None:
                    return m
                if own[0] in dims:
                    return self._fields(self._in_leaf(as_expr(dims[own[0]].expr), leaf, (own[0],)), own[1:])
                raise UnknownFieldError(own[0], [*columns, *measures, *dims], "field")
            if prefer_measures and (m := as_measure(dotted)) is not None:
                return m
            if len(path) == 1 and name is not None and (raw := self.raw(path[0])) is not None and self.find(path[0], measures) is None:
                return raw
            if (m := as_measure(dotted)) is not None:
                return m
            return self.bind(x)

        return rebuild(e, f)

    def above(self, leaf: int) -> set[int]:
        """A leaf with all leaves that it joins through, up to the root."""
        out, work = set(), [leaf]
        while work:
            i = work.pop()
            if i not in out:
                out.add(i)
                work += self.edges[i].parents if i else []
        return out

    def entities(self, leaf: int) -> list[str]:
        return [n for n, d in self.leaves[leaf].dims.items() if d.is_entity]

    def unique_keys(self, leaf: int) -> list[str]:
        return [n for n, d in self.leaves[leaf].dims.items() if d.is_unique]


def owners(e: Any) -> set[int]:
    """The leaves that an expression reads."""
    return {x.leaf for x in walk(e) if isinstance(x, Bound)}


def is_calculated(e: Expr) -> bool:
    """Whether a bound measure is computed from other measures, totals or windows."""
    return any(isinstance(x, (MeasureRef, Total, Over, WinFunc)) for x in walk(e))


def has_reduction(e: Expr) -> bool:
    return any(isinstance(x, Agg) for x in walk(e))
