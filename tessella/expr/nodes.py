"""The expression tree that dimensions, measures, filters and windows are written in.

A tree names fields and functions; the planner binds the names and compiles it to Spark columns. It is inspected, never
executed: which fields it reads, which reductions it holds and whether it needs totals is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column


class Expr:
    """A node; operators and methods build larger trees."""

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("_"):
            raise AttributeError(name)
        return Attr(self, name)

    def __getitem__(self, key: Any) -> Expr:
        if isinstance(key, str):
            return Attr(self, key)
        if isinstance(key, slice):
            return Call("slice", (self, _lift(key.start or 0), _lift(key.stop)))
        return Call("item", (self, _lift(key)))

    def __iter__(self) -> Iterator[Expr]:
        raise TypeError("an expression can't be iterated over")

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use &, | and ~")

    def __hash__(self) -> int:
        return hash(repr(self))

    def over(self, window: Window | None = None, **kw: Any) -> Expr:
        return Over(self, window if window is not None else make_window(**kw))

    def name(self, alias: str) -> Expr:
        return Named(self, alias)

    alias = name

    def pipe(self, f: Callable, *args: Any, **kw: Any) -> Any:
        return f(self, *args, **kw)

    def asc(self) -> SortKey:
        return SortKey(self, True)

    def desc(self) -> SortKey:
        return SortKey(self, False)


def _lift(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, Column):
        return Raw(x)
    return Lit(x)


lift = _lift


@dataclass(frozen=True, eq=False)
class Field(Expr):
    """A field by name; "model.field" once it is qualified."""

    field: str


@dataclass(frozen=True, eq=False)
class Attr(Expr):
    """A field of a model or struct, or what becomes a method when it is called."""

    base: Expr
    attr: str

    def __call__(self, *args: Any, **kw: Any) -> Expr:
        return method(self.base, self.attr, args, kw)


@dataclass(frozen=True, eq=False)
class Bound(Expr):
    """A physical column that the planner has found."""

    leaf: int
    column: str


@dataclass(frozen=True, eq=False)
class MeasureRef(Expr):
    measure: str


@dataclass(frozen=True, eq=False)
class Lit(Expr):
    value: Any


@dataclass(frozen=True, eq=False)
class Raw(Expr):
    """A Spark column as it is; opaque to the planner, which evaluates it at the rows of its own source."""

    column: Column


@dataclass(frozen=True, eq=False)
class Call(Expr):
    """A scalar function."""

    func: str
    args: tuple[Any, ...]


@dataclass(frozen=True, eq=False)
class Agg(Expr):
    """A reduction; without an argument it counts rows."""

    kind: str
    arg: Expr | None = None
    where: Expr | None = None
    params: tuple[Any, ...] = ()


@dataclass(frozen=True, eq=False)
class WinFunc(Expr):
    """A function that has a meaning only over ordered rows."""

    kind: str
    args: tuple[Any, ...] = ()


@dataclass(frozen=True, eq=False)
class Window:
    group_by: tuple[Expr, ...] = ()
    order_by: tuple[SortKey, ...] = ()
    rows: tuple[int | None, int | None] | None = None


@dataclass(frozen=True, eq=False)
class Over(Expr):
    arg: Expr
    window: Window


@dataclass(frozen=True, eq=False)
class Total(Expr):
    """The value over all filtered rows, without group keys."""

    arg: Any


@dataclass(frozen=True, eq=False)
class Named(Expr):
    arg: Expr
    label: str


@dataclass(frozen=True, eq=False)
class SortKey:
    key: Any
    ascending: bool = True


@dataclass(frozen=True, eq=False)
class CaseBuilder(Expr):
    """``case().when(...)`` chains in progress."""

    whens: tuple[tuple[Expr, Expr], ...] = ()

    def when(self, condition: Any, value: Any) -> CaseBuilder:
        return CaseBuilder((*self.whens, (_lift(condition), _lift(value))))

    def else_(self, value: Any) -> Expr:
        return Call("case", (*[x for w in self.whens for x in w], _lift(value)))

    def end(self) -> Expr:
        return Call("case", (*[x for w in self.whens for x in w], Lit(None)))


REDUCTIONS = {
    "count", "sum", "mean", "avg", "min", "max", "nunique", "approx_nunique", "median", "approx_median", "quantile", "mode", "std", "var",
    "first", "last", "arbitrary", "argmax", "argmin", "any", "all", "collect",
}
WINDOW_FUNCTIONS = {"rank", "dense_rank", "row_number", "ntile", "percent_rank", "cume_dist", "lag", "lead", "cumsum", "cummean", "cummin", "cummax"}
#: Reductions of a window over ordered rows rather than of a group.
_ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "//", "mod": "%", "pow": "**", "and": "&", "or": "|", "xor": "^", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "==", "ne": "!="}


def _install() -> None:
    def binary(sign: str) -> Callable:
        return lambda self, other: Call(sign, (self, _lift(other)))

    def swapped(sign: str) -> Callable:
        return lambda self, other: Call(sign, (_lift(other), self))

    for name, sign in _ARITHMETIC.items():
        setattr(Expr, f"__{name}__", binary(sign))
        if name not in ("lt", "le", "gt", "ge", "eq", "ne"):
            setattr(Expr, f"__r{name}__", swapped(sign))
    Expr.__invert__ = lambda self: Call("not", (self,))
    Expr.__neg__ = lambda self: Call("neg", (self,))
    for cls in (Field, Attr, Bound, MeasureRef, Lit, Raw, Call, Agg, WinFunc, Over, Total, Named, CaseBuilder):
        cls.__hash__ = Expr.__hash__


_install()


def method(base: Expr, name: str, args: tuple, kw: dict[str, Any]) -> Expr:
    """What a call of a method on a tree means."""
    where = kw.pop("where", None)
    where = None if where is None else _lift(where)
    if name in REDUCTIONS and not (name in ("first", "last") and kw.get("window")):
        kind = {"avg": "mean"}.get(name, name)
        params: tuple[Any, ...] = ()
        if kind == "quantile":
            params = (args[0] if args else kw.get("quantile", kw.get("q", 0.5)),)
        elif kind in ("argmax", "argmin"):
            params = (_lift(args[0] if args else kw["key"]),)
        elif kind in ("std", "var"):
            params = (kw.get("how", "sample"),)
        elif args:
            if kind == "count" and len(args) == 1:
                where = _lift(args[0])
            else:
                raise TypeError(f"{name}() takes no positional arguments")
        return Agg(kind, base, where, params)
    if name in WINDOW_FUNCTIONS:
        return WinFunc(name, (base, *args, *kw.values()))
    from ..functions.scalar import FUNCTIONS

    if name in ("index", "full_name") and not args and (isinstance(base, Attr) and base.attr == "day_of_week" or isinstance(base, Call) and base.func == "day_of_week"):
        return Call("day_of_week_index" if name == "index" else "day_of_week_name", (base.base if isinstance(base, Attr) else base.args[0],))
    if name == "cases":
        pairs = [x for c in args for x in (Call("==", (base, _lift(c[0]))), _lift(c[1]))]
        return Call("case", (*pairs, _lift(kw.get("else_"))))
    if name not in FUNCTIONS:
        raise AttributeError(f"expressions have no method {name!r}")
    return Call(name, (base, *map(_argument, args), *map(_argument, kw.values())))


def _argument(x: Any) -> Any:
    return tuple(map(_argument, x)) if isinstance(x, (list, tuple, set, frozenset)) else _lift(x)


def make_window(group_by: Any = None, order_by: Any = None, preceding: Any = "default", following: Any = "default", rows: tuple | None = None, range: tuple | None = None) -> Window:
    """A window; preceding and following count rows, None is unbounded; rows is (first, last) relative to the row."""

    def many(x: Any) -> tuple:
        return () if x is None else tuple(x) if isinstance(x, (list, tuple)) else (x,)

    named = lambda x: Field(x) if isinstance(x, str) else x(SCOPE) if callable(x) and not isinstance(x, Expr) else x
    keys = tuple(map(named, many(group_by)))
    order = tuple(o if isinstance(o, SortKey) else SortKey(o) for o in map(named, many(order_by)))
    if range is not None:
        raise TypeError("windows are framed by rows")
    if rows is None and (preceding != "default" or following != "default"):
        begin = None if preceding in ("default", None) else -int(preceding)
        end = (0 if preceding != "default" else None) if following == "default" else None if following is None else int(following)
        rows = (begin, end)
    return Window(keys, order, rows)


class Scope:
    """What lambdas receive and what ``_`` is: attributes are fields, a few names are functions of the whole table."""

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return Field(name)

    def __getitem__(self, name: str) -> Expr:
        return Field(name)

    def count(self, where: Any = None) -> Expr:
        return Agg("count", None, None if where is None else _lift(where))

    def all(self, what: Any) -> Expr:
        return Total(what if isinstance(what, str) else _lift(what))

    def nunique(self) -> Expr:
        raise AttributeError("nunique() is a method of a field")


SCOPE = Scope()
_ = SCOPE


def as_expr(x: Any) -> Expr:
    """The tree of a tree, a lambda over a scope, a Spark column or a constant."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, Column):
        return Raw(x)
    if callable(x):
        return as_expr(x(SCOPE))
    if isinstance(x, Scope):
        raise TypeError("an expression names a field, not the whole table")
    return Lit(x)


def children(e: Any) -> Iterator[Any]:
    """The expressions directly below a node."""
    if isinstance(e, Over):
        yield e.arg
        yield from e.window.group_by
        yield from (k.key for k in e.window.order_by)
        return
    if isinstance(e, CaseBuilder):
        yield from (x for w in e.whens for x in w)
        return
    if not isinstance(e, Expr):
        return
    for f in fields(e):
        v = getattr(e, f.name)
        for x in _flat(v):
            if isinstance(x, Expr):
                yield x


def _flat(v: Any) -> Iterator[Any]:
    if isinstance(v, tuple):
        for x in v:
            yield from _flat(x)
    else:
        yield v


def walk(e: Any) -> Iterator[Expr]:
    yield e
    for c in children(e):
        yield from walk(c)


def rebuild(e: Any, f: Callable[[Expr], Expr | None]) -> Any:
    """The tree with nodes replaced from the top: where f gives a tree, that stands; below others the work goes on."""
    if isinstance(e, tuple):
        return tuple(rebuild(x, f) for x in e)
    if isinstance(e, SortKey):
        return SortKey(rebuild(e.key, f), e.ascending)
    if isinstance(e, Window):
        return Window(rebuild(e.group_by, f), tuple(rebuild(k, f) for k in e.order_by), e.rows)
    if not isinstance(e, Expr):
        return e
    got = f(e)
    if got is not None:
        return got
    if isinstance(e, CaseBuilder):
        return CaseBuilder(rebuild(e.whens, f))
    return type(e)(*[rebuild(getattr(e, x.name), f) for x in fields(e)])


def same(a: Any, b: Any) -> bool:
    """Whether two trees are equal."""
    return repr(a) == repr(b)


def ifelse(condition: Any, yes: Any, no: Any) -> Expr:
    return Call("case", (_lift(condition), _lift(yes), _lift(no)))


def case() -> CaseBuilder:
    return CaseBuilder()


def window(**kw: Any) -> Window:
    return make_window(**kw)


def literal(x: Any) -> Expr:
    return Lit(x)


def raw(column: Column) -> Expr:
    """A Spark column, such as a UDF's, as a row-level expression of its own table."""
    return Raw(column)


def desc(x: Any) -> SortKey:
    return SortKey(Field(x) if isinstance(x, str) else x, False)


def asc(x: Any) -> SortKey:
    return SortKey(Field(x) if isinstance(x, str) else x, True)


def function(name: str, *args: Any) -> Expr:
    """A scalar function of the table's functions by name, for those without a first operand."""
    return Call(name, tuple(map(_argument, args)))


def _window_function(kind: str, doc: str):
    def make(*args: Any) -> WinFunc:
        return WinFunc(kind, tuple(map(_lift, args)))

    make.__name__, make.__doc__ = kind, doc
    return make


row_number = _window_function("row_number", "The place of a row in its window, from 0.")
rank = _window_function("rank", "The place of a row in its window, from 0; ties share it and leave a gap.")
dense_rank = _window_function("dense_rank", "The place of a row in its window, from 0; ties share it and leave no gap.")
ntile = _window_function("ntile", "Which of n even parts of its window a row is in, from 0.")
percent_rank = _window_function("percent_rank", "The relative place of a row in its window, 0 to 1.")
cume_dist = _window_function("cume_dist", "The share of its window's rows up to a row.")


def interval(value: int | None = None, unit: str | None = None, **units: int) -> Expr:
    """A span of time, such as interval(days=3) or interval(2, "h"), to add to times or to take from them."""
    if value is not None:
        names = {"Y": "years", "Q": "quarters", "M": "months", "W": "weeks", "D": "days", "h": "hours", "m": "minutes", "s": "seconds"}
        units = {names.get(unit or "s", unit or "seconds"): value, **units}
    known = ("years", "quarters", "months", "weeks", "days", "hours", "minutes", "seconds")
    if not units or set(units) - set(known):
        raise TypeError(f"interval() takes {', '.join(known)}")
    months = units.pop("months", 0) + 3 * units.pop("quarters", 0)
    return Call("interval", (Lit(units.get("years", 0)), Lit(months), Lit(units.get("weeks", 0)), Lit(units.get("days", 0)), Lit(units.get("hours", 0)), Lit(units.get("minutes", 0)), Lit(units.get("seconds", 0))))


def coalesce(*args: Any) -> Expr:
    return function("coalesce", *args)


def greatest(*args: Any) -> Expr:
    return function("greatest", *args)


def least(*args: Any) -> Expr:
    return function("least", *args)


def and_(*args: Any) -> Expr:
    return function("and_", *args) if args else Lit(True)


def or_(*args: Any) -> Expr:
    return function("or_", *args) if args else Lit(False)


def now() -> Expr:
    return function("now")


def today() -> Expr:
    return function("today")


def random() -> Expr:
    return function("random")


def uuid() -> Expr:
    return function("uuid")


@dataclass(frozen=True, eq=False)
class Param(Expr):
    """A named value that is set before a query: model.with_params(name=value)."""

    label: str
    default: Any = None

    __hash__ = Expr.__hash__


def param(name: str, default: Any = None) -> Expr:
    return Param(name, default)


def with_values(e: Any, values: dict[str, Any]) -> Any:
    """The tree with parameters replaced by their values or defaults."""
    return rebuild(e, lambda x: Lit(values.get(x.label, x.default)) if isinstance(x, Param) else None)
