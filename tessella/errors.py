"""Errors of the semantic layer."""

from __future__ import annotations

import difflib


class TessellaError(Exception):
    """Base of all errors raised here."""


class DefinitionError(TessellaError, ValueError):
    """A model is defined wrongly."""


class QueryError(TessellaError, ValueError):
    """A query asks for something that has no answer."""


class UnknownFieldError(QueryError, KeyError):
    """A name that no dimension, measure or column has."""

    def __init__(self, name: str, known: list[str], kind: str = "field"):
        self.name, self.known, self.kind = name, sorted(known), kind
        self.near = difflib.get_close_matches(name, self.known, n=3)
        hint = f" Did you mean {', '.join(self.near)}?" if self.near else ""
        super().__init__(f"Unknown {kind} {name!r}.{hint}")

    def __str__(self) -> str:
        return str(self.args[0])


class CompilationError(TessellaError, ValueError):
    """An expression can't be turned into a plan."""


class NonAdditiveTotalError(CompilationError):
    """A total of a result column that can't be added up."""


class WindowedBaseReductionError(CompilationError):
    """A reduction of raw rows under a window that the result's rows can't give."""


class BackendError(TessellaError):
    """A source or a connection failed."""


class SerializationError(TessellaError):
    """A model or an expression that can't be written or read."""
