"""Chart specifications for results: what to draw follows from keys and measures."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import types as T

from ..errors import QueryError


def detect(result) -> str:
    """indicator, line, multi_line, bar, heatmap, scatter or table."""
    schema = result.to_spark().schema
    times = [k for k in result.keys if isinstance(schema[k].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    dims, measures = len(result.keys), len(result.measures_)
    if dims == 0 and measures == 1:
        return "indicator"
    if dims == 1 and measures >= 1:
        return "line" if times else "bar"
    if dims == 2 and measures == 1:
        return "multi_line" if times else "heatmap"
    if dims == 0 and measures == 2:
        return "scatter"
    return "table"


#: A chart of more rows than this is an error.
MOST_ROWS = 50_000


def chart_spec(result, backend: str = "vega", spec: Mapping[str, Any] | None = None) -> Any:
    """The chart as data: a Vega-Lite, ECharts or Plotly specification whose values are the result's rows, an Altair chart, or text for a terminal."""
    kind = (spec or {}).get("chart_type") or detect(result)
    rows = [r.asDict() for r in result.to_spark().limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise QueryError(f"a chart shows at most {MOST_ROWS} rows; limit or aggregate the result first")
    if backend == "altair":
        import altair

        return altair.Chart.from_dict(_spec(result, rows, kind, "vega", spec))
    return _spec(result, rows, kind, backend, spec)


def _spec(result, rows: list[dict[str, Any]], kind: str, backend: str, spec: Mapping[str, Any] | None) -> Any:
    schema = result.to_spark().schema
    kind_of = lambda c: "temporal" if isinstance(schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "quantitative" if isinstance(schema[c].dataType, T.NumericType) else "nominal"
    keys, measures = result.keys, result.measures_
    if backend == "vega":
        field = lambda c, t=None: {"field": c.replace(".", "\\."), "type": t or kind_of(c), "title": c}
        base: dict[str, Any] = {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "data": {"values": rows}}
        if kind == "indicator":
            base |= {"mark": {"type": "text", "fontSize": 48}, "encoding": {"text": field(measures[0])}}
        elif kind in ("bar", "line"):
            t = None if kind == "line" else "nominal"
            if len(measures) == 1:
                base |= {"mark": kind, "encoding": {"x": field(keys[0], t), "y": field(measures[0])}}
            else:
                base |= {"transform": [{"fold": measures, "as": ["measure", "value"]}], "mark": kind, "encoding": {"x": field(keys[0], t), "y": {"field": "value", "type": "quantitative"}, "color": {"field": "measure", "type": "nominal"}}}
        elif kind == "multi_line":
            time = next(k for k in keys if kind_of(k) == "temporal")
            base |= {"mark": "line", "encoding": {"x": field(time), "y": field(measures[0]), "color": field(next(k for k in keys if k != time), "nominal")}}
        elif kind == "heatmap":
            base |= {"mark": "rect", "encoding": {"x": field(keys[0], "nominal"), "y": field(keys[1], "nominal"), "color": field(measures[0])}}
        elif kind == "scatter":
            base |= {"mark": "point", "encoding": {"x": field(measures[0]), "y": field(measures[1]), **({"tooltip": field(keys[0])} if keys else {})}}
        else:
            base |= {"mark": "text", "encoding": {"text": field(keys[0])}} if keys else {"mark": "text"}
        return base | {k: v for k, v in (spec or {}).items() if k != "chart_type"}
    if backend == "echarts":
        if kind == "indicator":
            return {"series": [{"type": "gauge", "data": [{"value": rows[0][measures[0]], "name": measures[0]}]}]}
        if kind in ("bar", "line"):
            return {"xAxis": {"type": "category", "data": [r[keys[0]] for r in rows]}, "yAxis": {"type": "value"}, "series": [{"type": kind, "name": m, "data": [r[m] for r in rows]} for m in measures]}
        if kind == "heatmap":
            xs, ys = (list(dict.fromkeys(r[k] for r in rows)) for k in keys[:2])
            return {"xAxis": {"data": xs}, "yAxis": {"data": ys}, "series": [{"type": "heatmap", "data": [[xs.index(r[keys[0]]), ys.index(r[keys[1]]), r[measures[0]]] for r in rows]}]}
        return {"dataset": {"source": rows}}
    if backend == "plotly":
        of = lambda c: [r[c] for r in rows]
        if kind == "indicator":
            traces: list[dict[str, Any]] = [{"type": "indicator", "mode": "number", "value": rows[0][measures[0]], "title": {"text": measures[0]}}]
        elif kind in ("bar", "line"):
            traces = [{"type": "bar"} if kind == "bar" else {"type": "scatter", "mode": "lines"} for _ in measures]
            traces = [{**t, "name": m, "x": of(keys[0]), "y": of(m)} for t, m in zip(traces, measures)]
        elif kind == "multi_line":
            time = next(k for k in keys if kind_of(k) == "temporal")
            other = next(k for k in keys if k != time)
            groups = {v: [r for r in rows if r[other] == v] for v in dict.fromkeys(of(other))}
            traces = [{"type": "scatter", "mode": "lines", "name": str(v), "x": [r[time] for r in rs], "y": [r[measures[0]] for r in rs]} for v, rs in groups.items()]
        elif kind == "heatmap":
            traces = [{"type": "heatmap", "x": of(keys[0]), "y": of(keys[1]), "z": of(measures[0])}]
        elif kind == "scatter":
            traces = [{"type": "scatter", "mode": "markers", "x": of(measures[0]), "y": of(measures[1]), "text": [str(r[keys[0]]) if keys else "" for r in rows]}]
        else:
            columns = list(schema.names)
            traces = [{"type": "table", "header": {"values": columns}, "cells": {"values": [of(c) for c in columns]}}]
        return {"data": traces, "layout": {k: v for k, v in (spec or {}).items() if k != "chart_type"}}
    if backend in ("text", "plotext"):
        if kind not in ("bar", "line") or not rows:
            return "\n".join("  ".join(f"{k}={v}" for k, v in r.items()) for r in rows)
        most = max((abs(r[measures[0]] or 0) for r in rows), default=0) or 1
        width = max(len(str(r[keys[0]])) for r in rows)
        return "\n".join(f"{str(r[keys[0]]):<{width}} {'█' * round(40 * abs(r[measures[0]] or 0) / most)} {r[measures[0]]}" for r in rows)
    raise QueryError(f"unknown chart backend {backend!r}; known: vega, echarts, plotly, altair, text")
