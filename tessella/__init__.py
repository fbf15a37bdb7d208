"""A semantic layer on Spark: dimensions and measures declared once, queries that joins can't make wrong."""

from .errors import BackendError, CompilationError, DefinitionError, NonAdditiveTotalError, QueryError, SerializationError, TessellaError, UnknownFieldError, WindowedBaseReductionError
from .expr.nodes import _, and_, asc, case, coalesce, cume_dist, dense_rank, desc, function, greatest, ifelse, interval, least, literal, now, ntile, or_, param, percent_rank, random, rank, raw, row_number, today, uuid, window
from .expr.sandbox import parse
from .model import Result, SemanticTable, entity_dimension, time_dimension, to_semantic_table
from .plans.tree import Dimension, Measure
from .predicate import Filter
from .query import compare_periods, query
from .sources.yaml_models import from_config, from_yaml

__all__ = [
    "BackendError", "CompilationError", "DefinitionError", "Dimension", "Filter", "Measure", "NonAdditiveTotalError", "QueryError", "Result", "SemanticTable", "SerializationError", "TessellaError", "UnknownFieldError",
    "WindowedBaseReductionError", "_", "and_", "asc", "case", "coalesce", "compare_periods", "cume_dist", "dense_rank", "desc", "from_config", "from_yaml", "greatest", "interval", "least", "now", "ntile", "or_", "param", "percent_rank", "random", "rank", "raw", "row_number", "today", "uuid", "entity_dimension", "function", "ifelse", "literal", "parse", "query", "time_dimension", "to_semantic_table", "window",
]
