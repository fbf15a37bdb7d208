"""Models and results: the fluent API."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CompilationError, DefinitionError, NonAdditiveTotalError, QueryError, UnknownFieldError
from .expr.nodes import Agg, Attr, Bound, Call, Expr, Field, Lit, MeasureRef, Named, Over, Raw, SortKey, Total, WinFunc, as_expr, rebuild, walk
from .functions.aggregate import reduction, sort_column, windowed
from .functions.scalar import compile_call, lit
from .plans.planner import Planner, aggregate, mark, scalar
from .plans.tree import Dimension, Join, Leaf, Measure, Node, Tree, is_calculated, leaves_of, quoted

#: Table operations that would bypass the model; Spark's own are reached through to_spark().
BLOCKED = frozenset(
    """alias anti_join any_inner_join any_left_join as_scalar asof_join bind cache cast count count_distinct cross_join describe difference distinct drop drop_null dropna equals fill_null fillna get_backend head
    info inner_join intersect left_join nunique outer_join pivot_longer pivot_wider preview projection relabel relocate rename right_join rowid sample semi_join to_array to_delta to_torch topk try_cast unbind
    union unpack value_counts view view_as visualize window_by""".split()
)
GRAIN_ORDER = ["second", "minute", "hour", "day", "week", "month", "quarter", "year"]
DERIVED = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "day_of_week")


def as_dimension(spec: Any) -> Dimension:
    if isinstance(spec, Dimension):
        return spec
    if isinstance(spec, Mapping):
        known = {"expr", "description", "is_entity", "is_time_dimension", "is_event_timestamp", "smallest_time_grain", "derived_dimensions", "metadata", "is_unique"}
        if "expr" not in spec:
            raise DefinitionError("a dimension needs an expr")
        extra = {k: v for k, v in spec.items() if k not in known}
        given = {k: v for k, v in spec.items() if k in known}
        given["derived_dimensions"] = tuple(given.get("derived_dimensions") or ())
        given["metadata"] = dict(given.get("metadata") or {}) | extra
        return Dimension(**given)
    return Dimension(spec)


def as_measure(spec: Any) -> Measure:
    if isinstance(spec, Measure):
        return spec
    if isinstance(spec, Mapping):
        if "expr" not in spec:
            raise DefinitionError("a measure needs an expr")
        extra = {k: v for k, v in spec.items() if k not in ("expr", "description", "metadata", "prefer_measures")}
        return Measure(spec["expr"], spec.get("description"), dict(spec.get("metadata") or {}) | extra, bool(spec.get("prefer_measures")))
    return Measure(spec)


def time_dimension(expr: Any, smallest_time_grain: str | None = None, description: str | None = None, derived_dimensions: Sequence[str] = ()) -> Dimension:
    return Dimension(expr, description, is_time_dimension=smallest_time_grain is not None, is_event_timestamp=True, smallest_time_grain=smallest_time_grain, derived_dimensions=tuple(derived_dimensions))


def entity_dimension(expr: Any, description: str | None = None, unique: bool = False) -> Dimension:
    """A key of what the rows are about. It may repeat; unique=True promises that it doesn't, which saves work in joins."""
    return Dimension(expr, description, is_entity=True, is_unique=unique)


def grain(name: str) -> str:
    """A time grain by any spelling, such as month, M or TIME_GRAIN_MONTH."""
    from .functions.scalar import GRAINS

    bare = str(name).removeprefix("TIME_GRAIN_")
    found = GRAINS.get(bare) or GRAINS.get(bare.lower()) or GRAINS.get(bare.upper())
    if found not in GRAIN_ORDER:
        raise QueryError(f"unknown time grain {name!r}; known: {', '.join(GRAIN_ORDER)}")
    return found


class Exported:
    """What a model and a result have in common: running, exporting and piping."""

    def to_spark(self) -> DataFrame:
        raise NotImplementedError

    to_untagged = to_dataframe = to_spark

    @property
    def schema(self) -> T.StructType:
        return self.to_spark().schema

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.to_spark().columns)

    def execute(self):
        return self.to_spark().toPandas()

    to_pandas = execute

    def to_pyarrow(self):
        return self.to_spark().toArrow()

    def to_pyarrow_batches(self, chunk_size: int = 65_536):
        """Record batches of at most chunk_size rows, in the rows' order; no more than one partition's are held at once."""
        import pyarrow as pa

        def packed(batches):
            for b in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

        for (raw,) in self.to_spark().mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
            for b in pa.ipc.open_stream(bytes(raw)):
                for at in range(0, b.num_rows, chunk_size):
                    yield b.slice(at, chunk_size)

    def to_pandas_batches(self, chunk_size: int = 65_536):
        return (b.to_pandas() for b in self.to_pyarrow_batches(chunk_size))

    def to_polars(self):
        import polars

        return polars.from_arrow(self.to_pyarrow())

    def compile(self) -> str:
        """The optimised plan as Spark explains it."""
        return self.to_spark()._jdf.queryExecution().toString()

    def explain(self, mode: str = "formatted") -> None:
        self.to_spark().explain(mode)

    def sql(self, name: str | None = None) -> str:
        """A SELECT that gives the rows in this session: over a temporary view, by that name, of the query. compile() has the plan."""
        df = self.to_spark()
        name = name or f"query_{id(self):x}"
        df.createOrReplaceTempView(name)
        quote = lambda c: "`" + c.replace("`", "``") + "`"
        return f"SELECT {', '.join(map(quote, df.columns))} FROM {quote(name)}"

    def to_parquet(self, path: str, **options: Any) -> None:
        self.to_spark().write.mode(options.pop("mode", "overwrite")).options(**options).parquet(path)

    to_parquet_dir = to_parquet

    def to_csv(self, path: str, **options: Any) -> None:
        self.to_spark().write.mode(options.pop("mode", "overwrite")).options(header=True, **options).csv(path)

    def to_json(self, path: str, **options: Any) -> None:
        self.to_spark().write.mode(options.pop("mode", "overwrite")).options(**options).json(path)

    def to_xlsx(self, path: str, **options: Any) -> None:
        try:
            self.execute().to_excel(path, index=False, **options)
        except ImportError as e:
            raise ImportError("to_xlsx needs openpyxl or xlsxwriter") from e

    def to_sql(self, name: str | None = None) -> str:
        return self.sql(name)

    def save_as_table(self, name: str, **options: Any) -> None:
        self.to_spark().write.mode(options.pop("mode", "overwrite")).options(**options).saveAsTable(name)

    def pipe(self, f: Callable, *args: Any, **kw: Any) -> Any:
        return f(self, *args, **kw)

    def __getattr__(self, name: str) -> Any:
        if name in BLOCKED:
            raise AttributeError(f"{name!r} isn't defined on semantic tables; use to_spark() and Spark's own operation")
        raise AttributeError(f"{type(self).__name__!r} has no attribute {name!r}")


def _names(keys: Iterable[Any]) -> list[Any]:
    out: list[Any] = []
    for k in keys:
        out += _names(k) if isinstance(k, (list, tuple)) else [k]
    return out


def _field_name(x: Any) -> str | None:
    """The name that a key gives: a string, a field, or a lambda of one."""
    if isinstance(x, str):
        return x
    if callable(x) and not isinstance(x, Expr):
        x = as_expr(x)
    parts: list[str] = []
    while isinstance(x, Attr):
        parts.insert(0, x.attr)
        x = x.base
    return ".".join([x.field, *parts]) if isinstance(x, Field) else None


class SemanticTable(Exported):
    """A model: tables, declared dimensions and measures, joins of declared cardinality."""

    def __init__(self, node: Node, order: tuple[SortKey, ...] = (), shown: tuple[str, ...] = ()):
        self.node = node
        self._order = order
        self._shown = shown  # dimensions of mutate() over a join, which to_spark() gives too

    # structure

    @cached_property
    def tree(self) -> Tree:
        return Tree(self.node)

    @property
    def name(self) -> str | None:
        return self.node.name if isinstance(self.node, Leaf) else None

    @property
    def description(self) -> str | None:
        return self.node.description if isinstance(self.node, Leaf) else None

    @property
    def dimensions(self) -> tuple[str, ...]:
        return tuple(self.tree.dimension_names())

    def get_dimensions(self) -> dict[str, Dimension]:
        return {n: d for n, (_, d) in self.tree.dimension_names().items()}

    @cached_property
    def _split_measures(self) -> tuple[dict[str, Measure], dict[str, Measure]]:
        base, calc = {}, {}
        for n, (leaf, m) in self.tree.measure_names().items():
            bound = self.tree.bind_measure(as_expr(m.expr), leaf, n, m.prefer_measures)
            (calc if is_calculated(bound) else base)[n] = m
        return base, calc

    @property
    def measures(self) -> tuple[str, ...]:
        return tuple(self.tree.measure_names())

    def get_measures(self) -> dict[str, Measure]:
        return self._split_measures[0]

    def get_calculated_measures(self) -> dict[str, Measure]:
        return self._split_measures[1]

    @property
    def json_definition(self) -> dict[str, Any]:
        dims = self.get_dimensions()
        out: dict[str, Any] = {
            "dimensions": {n: d.to_json() for n, d in dims.items()},
            "measures": {n: m.to_json() for n, (_, m) in self.tree.measure_names().items()},
            "name": self.name,
            "time_dimensions": {n: d.to_json() for n, d in dims.items() if d.is_time_dimension},
            "entity_dimensions": {n: d.to_json() for n, d in dims.items() if d.is_entity},
        }
        if self.description:
            out["description"] = self.description
        return out

    def __getitem__(self, key: str) -> Dimension | Measure:
        for known in (self.get_dimensions(), {n: m for n, (_, m) in self.tree.measure_names().items()}):
            if (full := self.tree.find(key, known)) is not None:
                return known[full]
        raise UnknownFieldError(key, [*self.dimensions, *self.measures])

    def get_graph(self) -> dict[str, dict[str, Any]]:
        from .operators.graph import dependency_graph

        return dependency_graph(self)

    def __repr__(self) -> str:
        from .operators.graph import describe

        return describe(self)

    # definitions

    def _expanded(self, dims: Mapping[str, Any]) -> dict[str, Dimension]:
        out: dict[str, Dimension] = {}
        for n, spec in dims.items():
            d = as_dimension(spec)
            out[n] = d
            for part in d.derived_dimensions:
                if part not in DERIVED:
                    raise DefinitionError(f"unknown derived dimension {part!r}; known: {', '.join(DERIVED)}")
                if f"{n}_{part}" not in dims:
                    out.setdefault(f"{n}_{part}", Dimension(Call(part, (Field(n),)), f"{part} of {n}"))
        return out

    def with_dimensions(self, **dims: Any) -> SemanticTable:
        new = self._expanded(dims)
        return SemanticTable(replace(self.node, dims={**{k: v for k, v in self.node.dims.items()}, **new}), self._order, self._shown)

    def with_measures(self, **measures: Any) -> SemanticTable:
        """Adds or redefines measures; one that only refers to itself is an error."""
        new = {n: as_measure(m) for n, m in measures.items()}
        out = SemanticTable(replace(self.node, measures={**self.node.measures, **new}), self._order, self._shown)
        columns = {c for x in leaves_of(self.node) for c in x.df.columns}
        for n, m in new.items():
            if isinstance(m.expr, str):
                raise DefinitionError(f"measure {n!r}: expressions as text go through YAML or sandbox.parse")
            e = as_expr(m.expr)
            if n not in columns and any(isinstance(x, Field) and x.field == n for x in walk(e)):
                raise DefinitionError(f"measure {n!r} refers to itself")
        return out

    def with_params(self, **values: Any) -> SemanticTable:
        """The model with the parameters of its expressions set."""
        from .expr.nodes import with_values

        def put(node: Node) -> Node:
            changed: dict[str, Any] = {
                "dims": {n: replace(d, expr=with_values(as_expr(d.expr), values)) for n, d in node.dims.items()},
                "measures": {n: replace(m, expr=with_values(as_expr(m.expr), values)) for n, m in node.measures.items()},
                "filters": tuple(with_values(f, values) for f in node.filters),
            }
            if isinstance(node, Join):
                changed |= {"left": put(node.left), "right": put(node.right)}
            return replace(node, **changed)

        return SemanticTable(put(self.node), self._order, self._shown)

    # joins

    def join_one(self, other: SemanticTable, on: Any, how: str = "left") -> SemanticTable:
        return self._join(other, on, how, "one")

    def join_many(self, other: SemanticTable, on: Any, how: str = "left") -> SemanticTable:
        return self._join(other, on, how, "many")

    def join_cross(self, other: SemanticTable) -> SemanticTable:
        return SemanticTable(Join(self.node, other.node, None, "cross", "cross"))

    def join(self, *args: Any, **kw: Any) -> SemanticTable:
        raise TypeError("join() says nothing about cardinality; use join_one, join_many or join_cross")

    def _join(self, other: SemanticTable, on: Any, how: str, cardinality: str) -> SemanticTable:
        if how != "left":
            raise DefinitionError(f"joins are left joins, not {how!r}; filter on a non-null field of the right side instead")
        out = SemanticTable(Join(self.node, other.node, on, how, cardinality))
        tree = out.tree  # resolves names and keys now
        if cardinality == "one" and self._upgrades(tree, other):
            warnings.warn("both models have entities and measures of different grain: join_one is treated as join_many", UserWarning, stacklevel=3)
            return SemanticTable(Join(self.node, other.node, on, how, "many"))
        return out

    def _upgrades(self, tree: Tree, other: SemanticTable) -> bool:
        """Whether both sides have entities and measures and the join keys don't cover the right side's entities."""
        left, right = list(leaves_of(self.node)), list(leaves_of(other.node))
        i = len(left)
        mine = {n for x in left for n, d in x.dims.items() if d.is_entity}
        theirs = [n for n, d in right[0].dims.items() if d.is_entity]
        if not mine or not theirs or not any(x.measures for x in left) or not any(x.measures for x in right):
            return False
        used = {repr(b) for b in walk(tree.edges[i].predicate) if isinstance(b, Bound) and b.leaf == i}
        keys = {repr(tree._in_leaf(as_expr(right[0].dims[n].expr), i, (n,))) for n in theirs}
        return not keys <= used

    def view(self, name: str) -> SemanticTable:
        """The same model under another name, for joining it twice."""
        if not isinstance(self.node, Leaf):
            raise DefinitionError("only a model of one table has a view")
        return SemanticTable(replace(self.node, name=name))

    # queries

    def filter(self, *predicates: Any) -> SemanticTable:
        from .predicate import as_filter

        new = []
        for p in predicates:
            e = as_filter(p)
            if isinstance(e, Lit) and isinstance(e.value, bool):
                raise QueryError("a filter gave a Python bool instead of an expression; compare fields with == and combine with & and |")
            new.append(e)
        return SemanticTable(replace(self.node, filters=(*self.node.filters, *new)), self._order, self._shown)

    where = filter

    def group_by(self, *keys: Any, **named: Any) -> Grouped:
        return Grouped(self.with_dimensions(**named) if named else self, tuple(_names(keys)) + tuple(named))

    def aggregate(self, *measures: Any, nest: Mapping[str, Callable] | None = None, **named: Any) -> Result:
        return Grouped(self, ()).aggregate(*measures, nest=nest, **named)

    agg = aggregate

    def mutate(self, **exprs: Any) -> SemanticTable:
        """Row-level expressions as further columns and dimensions, each of which may use those before."""
        out = self
        for n, e in exprs.items():
            if isinstance(out.node, Leaf):
                tree = out.tree
                value = scalar(tree.bind(as_expr(e)))
                leaf = out.node
                rows = Planner(tree).leaf_frame(0).select(*[quoted(f"__0__{c}").alias(c) for c in leaf.df.columns if c != n], value.alias(n))
                out = SemanticTable(replace(leaf, df=rows, dims={**leaf.dims, n: Dimension(Field(n))}, filters=()), out._order)
            else:
                out = out.with_dimensions(**{n: e})
                out = SemanticTable(out.node, out._order, (*[x for x in out._shown if x != n], n))
        return out

    def _flat(self) -> tuple[DataFrame, Tree]:
        tree = self.tree
        planner = Planner(tree)
        df = planner.joined(set(range(len(tree.leaves))))
        for f in self._filters():
            df = df.filter(scalar(f))
        return df, tree

    def _filters(self) -> list[Expr]:
        """Filters of the joined model; those of single models hold before the join."""
        return [self.tree.bind(f) for f in self.tree.filters]

    def to_spark(self) -> DataFrame:
        """The rows: columns under their own names, later ones of a name as x_right, x_right2, ..."""
        df, tree = self._flat()
        out, taken, taken_in_order = [], set(), []
        for i, leaf in enumerate(tree.leaves):
            for c in leaf.df.columns:
                name, k = c, 1
                while name in taken:
                    name = f"{c}_right{'' if k == 1 else k}"
                    k += 1
                taken.add(name)
                taken_in_order.append(name)
                out.append(quoted(f"__{i}__{c}").alias(name))
        return df.select(*[c for c, name in zip(out, taken_in_order) if name not in self._shown], *[scalar(tree.dimension(n)).alias(n) for n in self._shown])

    to_untagged = to_dataframe = to_spark

    def as_table(self) -> SemanticTable:
        return self

    def _materialised(self, change: Callable[[DataFrame, Tree], DataFrame]) -> SemanticTable:
        """A flat model over a changed frame of joined rows, with all fields kept."""
        df, tree = self._flat()
        df = change(df, tree)
        if len(tree.leaves) == 1:
            leaf = tree.leaves[0]
            plain = df.select(*[quoted(f"__0__{c}").alias(c) for c in leaf.df.columns])
            return SemanticTable(replace(leaf, df=plain, filters=()))
        marks = {mark(i) for i in range(len(tree.leaves))}
        taken = df.select(*[quoted(c) for c in df.columns if c not in marks])
        free = lambda e: rebuild(e, lambda x: Field(f"__{x.leaf}__{x.column}") if isinstance(x, Bound) else None)
        dims = {n: replace(d, expr=free(tree.dimension(n))) for n, (_, d) in tree.dimension_names().items()}
        measures = {n: replace(m, expr=free(tree.bind_measure(as_expr(m.expr), leaf, n, m.prefer_measures))) for n, (leaf, m) in tree.measure_names().items()}
        return SemanticTable(Leaf(None, taken, dims, measures))

    def order_by(self, *keys: Any) -> SemanticTable:
        def change(df: DataFrame, tree: Tree) -> DataFrame:
            return df.orderBy(*[sort_column(scalar(tree.bind(e)), up) for e, up in map(sort_key, _names(keys))])

        return self._materialised(change)

    def limit(self, n: int, offset: int = 0) -> SemanticTable:
        check_limit(n, offset)
        return self._materialised(lambda df, _: (df.offset(offset) if offset else df).limit(n))

    def unnest(self, column: Any) -> SemanticTable:
        """One row an element; an element's struct fields become columns; rows of empty or null arrays go."""
        if not isinstance(self.node, Leaf):
            raise QueryError("unnest before joining")
        name = _field_name(column)
        df = self.node.df
        if self.node.filters:
            df = Planner(self.tree).leaf_frame(0).select(*[quoted(f"__0__{c}").alias(c) for c in df.columns])
        return SemanticTable(replace(self.node, df=unnested(df, name), filters=()))

    def index(self, selector: Any = None, by: str | None = None, sample: int | None = None) -> Result:
        from .operators.index import index

        return index(self, selector, by, sample)

    def select(self, *args: Any, **kw: Any) -> Any:
        raise NotImplementedError("select() is not part of the semantic API; use group_by().aggregate(), or to_spark().select()")

    def query(self, dimensions: Sequence[str] = (), measures: Sequence[str] = (), **kw: Any) -> Result:
        from .query import query

        return query(self, dimensions, measures, **kw)

    def compare_periods(self, **kw: Any) -> Result:
        from .query import compare_periods

        return compare_periods(self, **kw)

    def search_values(self, dimension: str, search: str | None = None, limit: int = 20) -> dict[str, Any]:
        from .operators.search import search_values

        return search_values(self, dimension, search, limit)

    def time_range(self, dimension: str | None = None) -> dict[str, Any]:
        from .operators.search import time_range

        return time_range(self, dimension)


def sort_key(k: Any) -> tuple[Expr, bool]:
    if callable(k) and not isinstance(k, (Expr, SortKey)):
        k = k(_scope())
    up = True
    if isinstance(k, SortKey):
        k, up = k.key, k.ascending
    if isinstance(k, str):
        k = Field(k)
    return as_expr(k), up


def _scope():
    from .expr.nodes import SCOPE

    return SCOPE


def check_limit(n: Any, offset: Any = 0) -> None:
    for x, what in ((n, "limit"), (offset, "offset")):
        if isinstance(x, bool) or not isinstance(x, int):
            raise QueryError(f"{what} must be an integer, not {x!r}")
        if x < 0:
            raise QueryError(f"{what} must not be negative")


def unnested(df: DataFrame, name: str | None) -> DataFrame:
    if name is None or name not in df.columns:
        raise UnknownFieldError(str(name), df.columns, "column")
    kind = df.schema[name].dataType
    if not isinstance(kind, T.ArrayType):
        raise QueryError(f"{name!r} is no array")
    out = df.withColumn(name, F.explode(quoted(name)))
    if isinstance(kind.elementType, T.StructType):
        return out.select("*", *[quoted(name).getField(f).alias(f) for f in kind.elementType.names if f not in df.columns])
    return out


class Grouped:
    """A model with group keys, waiting for aggregate()."""

    def __init__(self, model: SemanticTable, keys: tuple[Any, ...]):
        self.model, self.keys = model, keys

    def filter(self, *predicates: Any) -> Grouped:
        """Filters rows; the keys stay."""
        return Grouped(self.model.filter(*predicates), self.keys)

    def resolved(self) -> dict[str, Expr]:
        tree = self.model.tree
        out: dict[str, Expr] = {}
        for k in self.keys:
            name = _field_name(k)
            if name is None:
                raise QueryError("group keys are names of dimensions; define expressions with with_dimensions()")
            known = tree.dimension_names()
            full = tree.find(name, known)
            if full is None and tree.find(name, tree.measure_names()) is not None:
                raise UnknownFieldError(name, list(known), "dimension")
            out[full or name] = tree.dimension(name)
        return out

    def _wanted(self, measures: tuple[Any, ...], named: Mapping[str, Any]) -> dict[str, Any]:
        tree = self.model.tree
        known = tree.measure_names()
        wanted: dict[str, Any] = {}
        for m in _names(measures):
            name = _field_name(m)
            if name is None:
                e = as_expr(m)
                if isinstance(e, Named):
                    wanted[e.label] = e.arg
                    continue
                raise QueryError("unnamed expressions need a name: aggregate(name=...)")
            full = tree.find(name, known)
            if full is None:
                if [k for k in known if k.endswith(f".{name}")]:
                    raise QueryError(f"{name!r} is ambiguous: {', '.join(k for k in known if k.endswith(f'.{name}'))}")
                raise UnknownFieldError(name, list(known), "measure")
            wanted[full] = full
        for n, e in named.items():
            name = _field_name(e)
            full = None if name is None else tree.find(name, known)
            wanted[n] = full if full is not None else as_expr(e)
        return wanted

    def _check_shadows(self, keys: dict[str, Expr], wanted: dict[str, Any]) -> None:
        """A key that redefines a column which a measure reads would be ambiguous."""
        tree = self.model.tree
        known = tree.measure_names()
        for k, e in keys.items():
            bare = k.rsplit(".", 1)[-1]
            raw = tree.raw(k)
            if raw is None or repr(raw) == repr(e) or bare != raw.column:
                continue
            for n, w in wanted.items():
                work, seen = [w if isinstance(w, str) else n], set()
                while work:
                    m = work.pop()
                    if m in seen:
                        continue
                    seen.add(m)
                    leaf, body = (known[m][0], known[m][1].expr) if m in known else (None, wanted[n])
                    bound = tree.bind_measure(as_expr(body), leaf, m)
                    if any(repr(x) == repr(raw) for x in walk(bound)):
                        raise QueryError(f"dimension {k!r} redefines column {raw.column!r}, which measure {n!r} reads; rename the dimension")
                    work += [x.measure for x in walk(bound) if isinstance(x, MeasureRef)]

    def aggregate(self, *measures: Any, nest: Mapping[str, Callable] | None = None, **named: Any) -> Result:
        keys, wanted = self.resolved(), self._wanted(measures, named)
        self._check_shadows(keys, wanted)
        if nest:
            from .operators.nest import with_nests

            return with_nests(self, keys, wanted, nest)
        plan = aggregate(self.model.tree, keys, wanted, self.model._filters())
        return Result(plan.df, plan.keys, plan.measures, plan.additive, self.model.name)

    agg = aggregate

    def mutate(self, **exprs: Any) -> Grouped:
        return Grouped(self.model.mutate(**exprs), self.keys)


class Result(Exported):
    """The rows of a query; further steps work on its columns."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = (), measures: Sequence[str] = (), additive: Mapping[str, str] | None = None, name: str | None = None, order: tuple[SortKey, ...] = ()):
        self.df, self.keys, self.measures_, self.additive, self.name, self.order = df, list(keys), list(measures), dict(additive or {}), name, order

    def to_spark(self) -> DataFrame:
        return self.df

    to_untagged = to_dataframe = to_spark

    @property
    def dimensions(self) -> tuple[str, ...]:
        return tuple(self.keys)

    @property
    def measures(self) -> tuple[str, ...]:
        return tuple(self.measures_)

    def _but(self, df: DataFrame, **kw: Any) -> Result:
        out = Result(df, self.keys, self.measures_, self.additive, self.name, self.order)
        out.__dict__.update(kw)
        return out

    def _find(self, path: list[str]) -> Column:
        """A result column by exact name, dotted path or unique suffix; the rest of a path are struct fields."""
        names = self.df.columns
        for n in range(len(path), 0, -1):
            dotted = ".".join(path[:n])
            hits = [dotted] if dotted in names else [c for c in names if c.endswith(f".{dotted}")]
            if len(hits) == 1:
                c = quoted(hits[0])
                for p in path[n:]:
                    c = c.getField(p)
                return c
        raise UnknownFieldError(".".join(path), names, "result column")

    def _name(self, e: Any) -> str:
        name = _field_name(e)
        hits = [name] if name in self.df.columns else [c for c in self.df.columns if name is not None and c.endswith(f".{name}")]
        if len(hits) != 1:
            raise UnknownFieldError(str(name), self.df.columns, "result column")
        return hits[0]

    def column(self, e: Any) -> Column:
        """The Spark column of an expression over the result."""
        if isinstance(e, (Field, Attr)):
            path: list[str] = []
            x = e
            while isinstance(x, Attr):
                path.insert(0, x.attr)
                x = x.base
            if isinstance(x, Field):
                return self._find([x.field, *path])
            c = self.column(x)
            for p in path:
                c = c.getField(p)
            return c
        if isinstance(e, Lit):
            return lit(e.value)
        if isinstance(e, Raw):
            return e.column
        if isinstance(e, Named):
            return self.column(e.arg)
        if isinstance(e, Call):
            return compile_call(e.func, e.args, self.column)
        if isinstance(e, Over):
            if isinstance(e.arg, Call):
                return compile_call(e.arg.func, tuple(Over(a, e.window) if isinstance(a, (Agg, WinFunc, Call)) else a for a in e.arg.args), self.column)
            return windowed(e.arg, e.window, self.column, [sort_column(self.column(k.key), k.ascending) for k in self.order])
        if isinstance(e, WinFunc):
            from .expr.nodes import Window

            return windowed(e, Window(), self.column, [sort_column(self.column(k.key), k.ascending) for k in self.order])
        if isinstance(e, tuple):
            return F.array(*map(self.column, e))
        if isinstance(e, Agg):
            raise CompilationError("a reduction over result rows needs over(), all() or another aggregate()")
        raise CompilationError(f"can't compute {e!r} on a result")

    def filter(self, *predicates: Any) -> Result:
        from .predicate import as_filter

        df = self.df
        for p in predicates:
            df = df.filter(self.column(as_filter(p)))
        return self._but(df)

    where = filter

    def mutate(self, **exprs: Any) -> Result:
        out = self
        for n, e in exprs.items():
            df, tree = out._with_totals(as_expr(e))
            shown = Result(df, out.keys, out.measures_, out.additive, out.name, out.order)
            made = df.withColumn(n, shown.column(tree)).select(*[quoted(c) for c in out.df.columns if c != n], quoted(n))
            out = out._but(made, measures_=[m for m in out.measures_ if m != n] + [n], additive={k: v for k, v in out.additive.items() if k != n})
        return out

    def _with_totals(self, e: Expr) -> tuple[DataFrame, Expr]:
        """A frame with the totals that an expression needs, as columns of a crossed one-row frame."""
        found: dict[str, tuple[str, Column]] = {}

        def f(x: Expr) -> Expr | None:
            if not isinstance(x, Total):
                return None
            inner = Field(x.arg) if isinstance(x.arg, str) else x.arg

            def g(y: Expr) -> Expr | None:
                if isinstance(y, Agg):
                    alias = f"__total_{len(found)}"
                    found[repr(y)] = (alias, reduction(y, self.column))
                    return Field(alias)
                if _field_name(y) is not None:
                    name = self._name(y)
                    how = self.additive.get(name)
                    if how is None:
                        raise NonAdditiveTotalError(f"{name!r} can't be totalled from the result's rows; ask for all() inside aggregate()")
                    alias = f"__total_{len(found)}"
                    found[repr(y)] = (alias, (F.sum if how in ("sum", "count") else F.min if how == "min" else F.max)(quoted(name)))
                    return Call("cast", (Field(alias), Lit("double")))
                return None

            return rebuild(inner, g)

        tree = rebuild(e, f)
        if not found:
            return self.df, tree
        totals = self.df.agg(*[c.alias(a) for a, c in found.values()])
        return self.df.crossJoin(F.broadcast(totals)), tree  # one row

    def order_by(self, *keys: Any) -> Result:
        sorts = [sort_key(k) for k in _names(keys)]
        return self._but(self.df.orderBy(*[sort_column(self.column(e), up) for e, up in sorts]), order=tuple(SortKey(e, up) for e, up in sorts))

    def limit(self, n: int, offset: int = 0) -> Result:
        check_limit(n, offset)
        return self._but((self.df.offset(offset) if offset else self.df).limit(n))

    def group_by(self, *keys: Any) -> Regrouped:
        return Regrouped(self, tuple(self._name(k) for k in _names(keys)))

    def aggregate(self, *measures: Any, **named: Any) -> Result:
        return Regrouped(self, ()).aggregate(*measures, **named)

    agg = aggregate

    def unnest(self, column: Any) -> Result:
        return self._but(unnested(self.df, self._name(column)))

    def select(self, *columns: Any) -> Result:
        raise NotImplementedError("select() is not part of the semantic API; use to_spark().select()")

    def as_table(self) -> SemanticTable:
        """A flat model over the result, without declared fields."""
        return SemanticTable(Leaf(self.name, self.df))

    def with_dimensions(self, **dims: Any) -> SemanticTable:
        return self.as_table().with_dimensions(**dims)

    def with_measures(self, **measures: Any) -> SemanticTable:
        return self.as_table().with_measures(**measures)

    def join_one(self, other: SemanticTable, on: Any, how: str = "left") -> SemanticTable:
        return self.as_table().join_one(other, on, how)

    def join_many(self, other: SemanticTable, on: Any, how: str = "left") -> SemanticTable:
        return self.as_table().join_many(other, on, how)

    def chart(self, backend: str = "vega", spec: Mapping[str, Any] | None = None) -> Any:
        from .operators.chart import chart_spec

        return chart_spec(self, backend, spec)

    def __repr__(self) -> str:
        return f"Result(keys={self.keys}, measures={self.measures_})"


class Regrouped:
    """A result with group keys: measures now read the result's columns."""

    def __init__(self, result: Result, keys: tuple[str, ...]):
        self.result, self.keys = result, keys

    def aggregate(self, *measures: Any, **named: Any) -> Result:
        exprs = {}
        for m in _names(measures):
            e = as_expr(m) if not isinstance(m, str) else Field(m)
            if isinstance(e, Named):
                exprs[e.label] = e.arg
            else:
                raise QueryError("measures over a result need a name: aggregate(name=...)")
        model = SemanticTable(Leaf(None, self.result.df))
        return Grouped(model, self.keys).aggregate(**exprs, **named)

    agg = aggregate


def to_semantic_table(table: DataFrame, name: str | None = None, description: str | None = None) -> SemanticTable:
    """A model of a table, without fields yet."""
    if isinstance(table, Exported):
        table = table.to_spark()
    if not hasattr(table, "schema") or not hasattr(table, "select"):
        raise TypeError("a model needs a Spark DataFrame")
    return SemanticTable(Leaf(name, table, description=description))
