"""The dependency graph of a model's fields, and its description."""

from __future__ import annotations

from collections import deque
from typing import Any

from ..expr.nodes import Bound, MeasureRef, as_expr, walk
from ..plans.tree import Join, Leaf, is_calculated

Graph = dict[str, dict[str, Any]]


def dependency_graph(model) -> Graph:
    """{field: {"deps": {name: kind}, "type": kind}}; kinds are dimension, measure, calc_measure and column."""
    tree = model.tree
    dims, measures = tree.dimension_names(), tree.measure_names()
    out: Graph = {}
    for n, (leaf, d) in dims.items():
        bare = n.rsplit(".", 1)[-1]
        deps: dict[str, str] = {}
        siblings = tree.leaves[leaf].dims if leaf is not None else {k: v for k, (_, v) in dims.items()}
        from ..query import _paths

        for p in _paths(as_expr(d.expr)):
            first = p.split(".")[0]
            if first in siblings and first != bare:
                deps[tree.qualified(leaf, first) if leaf is not None else first] = "dimension"
            else:
                deps[p] = "column"
        out[n] = {"deps": deps, "type": "dimension"}
    for n, (leaf, m) in measures.items():
        bound = tree.bind_measure(as_expr(m.expr), leaf, n, m.prefer_measures)
        deps = {}
        for x in walk(bound):
            if isinstance(x, MeasureRef):
                deps[x.measure] = "measure"
            elif isinstance(x, Bound):
                deps[x.column] = "column"
        out[n] = {"deps": deps, "type": "calc_measure" if is_calculated(bound) else "measure"}
    return out


def predecessors(graph: Graph, node: str) -> set[str]:
    """What a field reads."""
    return set(graph.get(node, {}).get("deps", {}))


def successors(graph: Graph, node: str) -> set[str]:
    """The fields that read a field."""
    return {n for n, x in graph.items() if node in x["deps"]}


def bfs(graph: Graph, start: str) -> list[str]:
    """A field with all that it reads, nearest first."""
    seen, order, work = {start}, [], deque([start])
    while work:
        n = work.popleft()
        order.append(n)
        for p in sorted(predecessors(graph, n)):
            if p not in seen:
                seen.add(p)
                work.append(p)
    return order


def invert(graph: Graph) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for n, x in graph.items():
        for d in x["deps"]:
            out.setdefault(d, set()).add(n)
    return out


def to_dict(graph: Graph) -> dict[str, Any]:
    """Nodes and edges, for drawing."""
    nodes = {n: x["type"] for n, x in graph.items()}
    for x in graph.values():
        for d, kind in x["deps"].items():
            nodes.setdefault(d, kind)
    return {"nodes": [{"id": n, "type": t} for n, t in nodes.items()], "edges": [{"source": d, "target": n, "type": k} for n, x in graph.items() for d, k in x["deps"].items()]}


def describe(model) -> str:
    """The model as a tree of text."""
    lines: list[str] = []

    def visit(node: Leaf | Join, depth: int) -> None:
        pad = "  " * depth
        if isinstance(node, Leaf):
            lines.append(f"{pad}SemanticTable: {node.name or '<unnamed>'}")
        else:
            lines.append(f"{pad}Join [{node.cardinality}]")
            visit(node.left, depth + 1)
            visit(node.right, depth + 1)
        for n, d in node.dims.items():
            tags = "".join(f" [{t}]" for t, on in (("entity", d.is_entity), ("time", d.is_time_dimension)) if on)
            lines.append(f"{pad}  {n} [dim]{tags}")
        for n in node.measures:
            lines.append(f"{pad}  {n} [measure]")
        for _ in node.filters:
            lines.append(f"{pad}  [filter]")

    visit(model.node, 0)
    return "\n".join(lines)
