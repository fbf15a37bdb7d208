"""Scalar functions of the expression language, each as Spark columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CompilationError

GRAINS = {
    "Y": "year", "Q": "quarter", "M": "month", "W": "week", "D": "day", "h": "hour", "m": "minute", "s": "second", "ms": "millisecond", "us": "microsecond",
}
for _name in list(GRAINS.values()):
    GRAINS[_name] = GRAINS[_name.upper()] = _name
GRAINS["H"] = "hour"

TYPES = {
    "int": "bigint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "double", "float32": "float", "float64": "double",
    "str": "string", "bool": "boolean", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz",
}
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def lit(x: Any) -> Column:
    if isinstance(x, dt.datetime):
        return F.lit(x.isoformat(sep=" ")).cast("timestamp" if x.tzinfo else "timestamp_ntz")
    if isinstance(x, dt.date):
        return F.lit(x.isoformat()).cast("date")
    if isinstance(x, (list, tuple)):
        return F.array(*map(lit, x))
    return F.lit(x)


def value(x: Any) -> Any:
    """The constant that an argument must be."""
    from ..expr.nodes import Lit

    if isinstance(x, Lit):
        return x.value
    if isinstance(x, tuple):
        return [value(i) for i in x]
    raise CompilationError("this argument must be a constant")


def strftime(pattern: str) -> str:
    """The Spark pattern of a strftime pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "%" and i + 1 < len(pattern):
            i += 1
            out.append("%" if pattern[i] == "%" else _STRFTIME[pattern[i]])
        else:
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
        i += 1
    return "".join(out)


def truncate(c: Column, grain: str) -> Column:
    """The start of the time grain, as wall-clock time; queries cast it back to the type of their dimension."""
    if grain not in GRAINS:
        raise CompilationError(f"unknown time grain {grain!r}")
    return F.date_trunc(GRAINS[grain], c).cast("timestamp_ntz")


def _between(c: Column, a: Column, b: Column) -> Column:
    return c.between(a, b)


def _substr(c: Column, start: Column, length: Column | None = None) -> Column:
    return F.substring(c, start + 1, F.lit(2**31 - 1) if length is None else length)


def _slice(c: Column, start: Column, stop: Column) -> Column:
    return F.when(c.isNotNull(), F.slice(c, start + 1, F.greatest(F.coalesce(stop, F.size(c)) - start, F.lit(0))))


def _split_column(f: Callable[..., Column], plain: tuple[int, ...]) -> Callable[..., Column]:
    f.plain = plain  # positions of arguments that stay constants
    return f


def _plain(*positions: int) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    return lambda f: _split_column(f, positions)


@_plain(1)
def _cast(c: Column, kind: Any) -> Column:
    return c.cast(TYPES.get(str(kind), str(kind)))


@_plain(1)
def _try_cast(c: Column, kind: Any) -> Column:
    return c.try_cast(TYPES.get(str(kind), str(kind)))


@_plain(1)
def _truncate(c: Column, grain: Any) -> Column:
    return truncate(c, grain)


@_plain(1)
def _strftime(c: Column, pattern: Any) -> Column:
    return F.date_format(c, strftime(pattern))


@_plain(1)
def _isin(c: Column, values: Any) -> Column:
    return c.isin(list(values) if isinstance(values, (list, tuple)) else [values])


@_plain(1)
def _notin(c: Column, values: Any) -> Column:
    return ~_isin(c, values)


@_plain(1)
def _like(c: Column, pattern: Any) -> Column:
    return _any_of(c.like, pattern)


@_plain(1)
def _ilike(c: Column, pattern: Any) -> Column:
    return _any_of(c.ilike, pattern)


def _any_of(f: Callable[[str], Column], patterns: Any) -> Column:
    patterns = patterns if isinstance(patterns, list) else [patterns]
    out = f(patterns[0])
    for p in patterns[1:]:
        out = out | f(p)
    return out


@_plain(1, 2)
def _re_extract(c: Column, pattern: Any, index: Any = 0) -> Column:
    return F.regexp_extract(c, pattern, index)


@_plain(1)
def _round(c: Column, digits: Any = 0) -> Column:
    return F.round(c, digits or 0)


@_plain(1)
def _struct_field(c: Column, name: Any) -> Column:
    return c.getField(name)


def _case(*args: Column) -> Column:
    out = F.when(args[0], args[1])
    for a, b in zip(args[2:-1:2], args[3:-1:2]):
        out = out.when(a, b)
    return out.otherwise(args[-1])


def _fold(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def all_of(*args: Column) -> Column:
        out = args[0]
        for a in args[1:]:
            out = f(out, a)
        return out

    return all_of


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "//": lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("bigint"),
    "%": lambda a, b: F.try_mod(a, b),
    "**": lambda a, b: F.pow(a, b),
    "&": lambda a, b: a & b,
    "|": lambda a, b: a | b,
    "^": lambda a, b: a != b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "not": lambda a: ~a,
    "neg": lambda a: -a,
    "case": _case,
    "item": lambda a, i: F.get(a, i),
    "slice": _slice,
    "struct_field": _struct_field,
    "and_": _fold(lambda a, b: a & b),
    "or_": _fold(lambda a, b: a | b),
    # null
    "coalesce": lambda *a: F.coalesce(*a),
    "fill_null": lambda a, b: F.coalesce(a, b),
    "fillna": lambda a, b: F.coalesce(a, b),
    "isnull": lambda a: a.isNull(),
    "notnull": lambda a: a.isNotNull(),
    "nullif": lambda a, b: F.nullif(a, b),
    "identical_to": lambda a, b: a.eqNullSafe(b),
    # conditional and membership
    "ifelse": lambda c, a, b: F.when(c, a).otherwise(b),
    "greatest": lambda *a: F.greatest(*a),
    "least": lambda *a: F.least(*a),
    "between": _between,
    "isin": _isin,
    "notin": _notin,
    # types
    "cast": _cast,
    "try_cast": _try_cast,
    "typeof": lambda a: F.typeof(a),
    # numbers
    "abs": lambda a: F.abs(a),
    "ceil": lambda a: F.ceil(a),
    "floor": lambda a: F.floor(a),
    "round": _round,
    "sign": lambda a: F.signum(a),
    "sqrt": lambda a: F.sqrt(a),
    "exp": lambda a: F.exp(a),
    "ln": lambda a: F.ln(a),
    "log": lambda a: F.ln(a),
    "log10": lambda a: F.log10(a),
    "log2": lambda a: F.log2(a),
    # strings
    "capitalize": lambda a: F.concat(F.upper(F.substring(a, 1, 1)), F.lower(F.substring(a, 2, 2**31 - 1))),
    "contains": lambda a, b: F.contains(a, b),
    "endswith": lambda a, b: F.endswith(a, b),
    "startswith": lambda a, b: F.startswith(a, b),
    "find": lambda a, b: F.position(b, a) - 1,
    "length": lambda a: F.length(a),
    "like": _like,
    "ilike": _ilike,
    "lower": lambda a: F.lower(a),
    "upper": lambda a: F.upper(a),
    "lpad": lambda a, n, p: F.lpad(a, n, p),
    "rpad": lambda a, n, p: F.rpad(a, n, p),
    "strip": lambda a: F.regexp_replace(a, r"^\s+|\s+$", ""),
    "lstrip": lambda a: F.regexp_replace(a, r"^\s+", ""),
    "rstrip": lambda a: F.regexp_replace(a, r"\s+$", ""),
    "repeat": lambda a, n: F.repeat(a, n),
    "replace": lambda a, b, c: F.replace(a, b, c),
    "reverse": lambda a: F.reverse(a),
    "left": lambda a, n: F.left(a, n),
    "right": lambda a, n: F.right(a, n),
    "split": lambda a, b: F.split(a, F.concat(F.lit(r"\Q"), b, F.lit(r"\E"))),
    "substr": _substr,
    "translate": lambda a, b, c: F.call_function("translate", a, b, c),
    "concat": lambda *a: F.concat(*a),
    # regular expressions
    "re_extract": _re_extract,
    "re_replace": lambda a, b, c: F.regexp_replace(a, b, c),
    "re_search": lambda a, b: F.rlike(a, b),
    "re_split": lambda a, b: F.split(a, b),
    # time
    "date": lambda a: F.to_date(a),
    "year": lambda a: F.year(a),
    "quarter": lambda a: F.quarter(a),
    "month": lambda a: F.month(a),
    "week_of_year": lambda a: F.weekofyear(a),
    "day": lambda a: F.dayofmonth(a),
    "day_of_week_index": lambda a: F.weekday(a),
    "day_of_week": lambda a: F.weekday(a),
    "day_of_week_name": lambda a: F.date_format(a, "EEEE"),
    "day_of_year": lambda a: F.dayofyear(a),
    "hour": lambda a: F.hour(a),
    "minute": lambda a: F.minute(a),
    "second": lambda a: F.second(a),
    "millisecond": lambda a: F.date_format(a, "SSS").cast("int"),
    "microsecond": lambda a: F.date_format(a, "SSSSSS").cast("int"),
    "epoch_seconds": lambda a: F.unix_timestamp(a.cast("timestamp")),
    "strftime": _strftime,
    "time": lambda a: F.date_format(a, "HH:mm:ss"),
    "timestamp": lambda a: a.cast("timestamp_ntz"),
    "truncate": _truncate,
    "make_date": lambda y, m, d: F.make_date(y, m, d),
    "interval": lambda *a: F.make_interval(*a),
    "now": lambda: F.current_timestamp(),
    "today": lambda: F.current_date(),
    "random": lambda: F.rand(),
    "uuid": lambda: F.expr("uuid()"),
    # arrays
    "unique": lambda a: F.array_distinct(a),
    "array_length": lambda a: F.size(a),
    "unnest": lambda a: F.explode(a),
}


def compile_call(name: str, args: tuple, column: Callable[[Any], Column]) -> Column:
    """The Spark column of a scalar function; column compiles an argument."""
    if name not in FUNCTIONS:
        raise CompilationError(f"no function {name!r}")
    f = FUNCTIONS[name]
    plain = getattr(f, "plain", ())
    return f(*[value(a) if i in plain else column(a) for i, a in enumerate(args)])
