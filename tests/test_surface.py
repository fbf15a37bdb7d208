"""Exports, serialization of joined models, YAML over HTTP, profiles of folders, the tool protocol, charts and blocked names."""

import http.server
import io
import json
import threading

import pytest

from tessella import QueryError, WindowedBaseReductionError, _, from_yaml, to_semantic_table, window
from tessella.expr import serialize
from tessella.model import BLOCKED
from tessella.sources.mcp import McpServer
from tessella.sources.profiles import Connection


@pytest.fixture(scope="module")
def sales(spark):
    orders = to_semantic_table(spark.createDataFrame([(1, 10, 100), (2, 10, 50), (3, 20, 70)], "oid int, cid int, amount int"), "orders", "what was bought")
    customers = to_semantic_table(spark.createDataFrame([(10, "n"), (20, "s")], "cid int, side string"), "customers").with_dimensions(side=_.side)
    orders = orders.with_dimensions(oid=_.oid).with_measures(total=_.amount.sum(), n=_.count(), per=lambda t: t.total / t.n)
    return orders.join_one(customers, "cid")


def rows(x):
    return sorted(map(tuple, x.to_spark().collect()), key=str)


def test_mutate_is_exported(spark, sales):
    orders = to_semantic_table(spark.createDataFrame([(1, 5), (2, 7)], "a int, b int"), "t").with_measures(total=_.b.sum())
    more = orders.filter(_.a > 0).mutate(c=_.a * 10).mutate(d=_.c + _.b, a=_.a + 1)
    assert more.columns == ("b", "c", "d", "a") and rows(more) == [(5, 10, 15, 2), (7, 20, 27, 3)]
    assert rows(more.group_by("d").aggregate("total")) == [(15, 5), (27, 7)]
    wide = sales.mutate(big=lambda t: t.amount > 60)
    assert wide.columns[-1] == "big" and {r.big for r in wide.to_spark().collect()} == {True, False}
    assert rows(wide.group_by("big").aggregate("orders.n")) == [(False, 1), (True, 2)]


def test_batches_are_streamed_in_order(spark):
    import pyarrow as pa

    table = to_semantic_table(spark.range(0, 1000, 1, 7).selectExpr("id", "id * 2 AS twice"), "t")
    batches = list(table.to_pyarrow_batches(64))
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows <= 64 for b in batches)
    assert pa.Table.from_batches(batches).column("id").to_pylist() == list(range(1000))
    assert sum(len(p) for p in table.to_pandas_batches(300)) == 1000


def test_sql_runs_in_the_session(spark, sales):
    out = sales.group_by("customers.side").aggregate("orders.total")
    text = out.to_sql("by_side")
    assert text == "SELECT `customers.side`, `orders.total` FROM `by_side`"
    assert sorted(map(tuple, spark.sql(text).collect())) == rows(out) == [("n", 150), ("s", 70)]


def test_joined_models_as_data(spark, sales):
    data = json.loads(json.dumps(serialize.model_to_data(sales.with_measures(each=lambda t: t["orders.total"] / t["orders.n"]).filter(_.amount > 60))))
    tables = {"orders": sales.tree.leaves[0].df, "customers": sales.tree.leaves[1].df}
    again = serialize.model_from_data(data, tables)
    assert rows(again.group_by("customers.side").aggregate("orders.total", "orders.per", "each")) == [("n", 100, 100.0, 100.0), ("s", 70, 70.0, 70.0)]
    theta = sales.join_many(to_semantic_table(spark.createDataFrame([(60,), (90,)], "least int"), "bands").with_measures(k=_.count()), lambda l, b: l.amount >= b.least)
    again = serialize.model_from_data(serialize.model_to_data(theta), tables | {"bands": theta.tree.leaves[2].df})
    assert rows(again.group_by("orders.oid").aggregate("bands.k")) == [(1, 2), (2, 0), (3, 1)]
    for bad in ({**data, "cardinality": "some"}, {**data, "version": 0}, {**data, "on": {"node": "System"}}):
        with pytest.raises(serialize.SerializationError):
            serialize.model_from_data(bad, tables)
    with pytest.raises(serialize.SerializationError):
        serialize.model_from_data(data, {"orders": tables["orders"]})


def test_yaml_by_url_and_folders_by_uri(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "nums.parquet"))

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = b"m:\n  table: nums\n  measures:\n    n: _.count()\n"
            self.send_response(200 if self.path == "/m.yml" else 404)
            self.end_headers()
            self.wfile.write(body if self.path == "/m.yml" else b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        for folder in (str(tmp_path), f"file://{tmp_path}"):
            c = Connection(spark, {"type": "files", "path": folder})
            assert c.list_tables() == ["nums"] and c.table("nums").count() == 3
            assert rows(from_yaml(f"{base}/m.yml", profile=c, spark=spark)["m"].aggregate("n")) == [(3,)]
        with pytest.raises(Exception, match="can't be read"):
            from_yaml(f"{base}/none.yml", spark=spark)
    finally:
        server.shutdown()


def test_tool_protocol(sales):
    asked = [
        {"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "query_model", "arguments": {"model_name": "sales", "dimensions": '["customers.side"]', "measures": ["orders.total"], "order_by": [["orders.total", "desc"]], "limit": "1"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "query_model", "arguments": {"model_name": "none"}}}, {"id": 5, "method": "nothing"}, {"id": 6, "method": "tools/call", "params": {"name": "rm"}},
        {"id": 7, "method": "tools/call", "params": {"name": "search_dimension_values", "arguments": {"model_name": "sales", "dimension_name": "customers.side", "search_term": "n"}}}, {"id": 8, "method": "ping"},
    ]
    out = io.StringIO()
    McpServer({"sales": sales}).serve(io.StringIO("\n".join(map(json.dumps, asked)) + "\n\nnot json\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert "tools" in got[1]["result"]["capabilities"] and len(got[2]["result"]["tools"]) == 6
    assert json.loads(got[3]["result"]["content"][0]["text"])["rows"] == [{"customers.side": "n", "orders.total": 150}] and not got[3]["result"]["isError"]
    assert got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601 and got[6]["error"]["code"] == -32602 and got[None]["error"]["code"] == -32700
    assert json.loads(got[7]["result"]["content"][0]["text"])["values"] == [{"value": "n", "count": 2}]


def test_chart_backends(sales, monkeypatch):
    from tessella.operators import chart

    by_side = sales.group_by("customers.side").aggregate("orders.total").order_by("customers.side")
    plot = by_side.chart("plotly")
    assert plot["data"] == [{"type": "bar", "name": "orders.total", "x": ["n", "s"], "y": [150, 70]}]
    assert by_side.chart("text").splitlines()[0].startswith("n █")
    points = sales.aggregate("orders.total", "orders.n")
    assert points.chart("vega")["mark"] == "point" and points.chart("plotly")["data"][0]["mode"] == "markers"
    monkeypatch.setattr(chart, "MOST_ROWS", 1)
    with pytest.raises(QueryError):
        by_side.chart()


def test_blocked_names(sales):
    result = sales.aggregate("orders.n")
    for name in BLOCKED - {"view"}:
        for x in (sales, result):
            with pytest.raises(AttributeError, match="to_spark"):
                getattr(x, name)


def test_empty_window_over_keys_is_ambiguous(spark):
    t = to_semantic_table(spark.createDataFrame([(1, 5), (1, 5), (2, 5)], "qty int, v int"), "t").with_measures(total=_.v.sum())
    with pytest.raises(WindowedBaseReductionError):
        t.group_by("qty").aggregate(x=lambda t: t.qty.sum().over(window()))
    assert rows(t.group_by("qty").aggregate("total", share=lambda t: t.total / t.all(t.total))) == [(1, 10, 2 / 3), (2, 5, 1 / 3)]


def test_arrays_below_structs_below_arrays(spark):
    data = [(1, [{"box": {"items": [{"v": 1}, {"v": 2}]}}, {"box": {"items": [{"v": 3}]}}]), (2, [{"box": {"items": []}}]), (3, None)]
    t = to_semantic_table(spark.createDataFrame(data, "k int, parts array<struct<box:struct<items:array<struct<v:int>>>>>"), "t").with_measures(total=_.parts.box.items.v.sum(), n=_.parts.box.items.count(), parts_n=_.parts.count())
    assert rows(t.group_by("k").aggregate("total", "n", "parts_n")) == [(1, 6, 3, 2), (2, None, 0, 1), (3, None, 0, 0)]


def test_periods_from_one_pass_equal_two(spark, monkeypatch):
    import importlib

    module = importlib.import_module("tessella.query")

    data = [("a", f"2024-01-{d:02d}", v) for d, v in ((1, 1), (2, 2), (9, 4), (12, 8), (20, 16))] + [("b", "2024-01-03", 5), ("c", "2024-01-15", 7), (None, "2024-01-02", 3), (None, "2024-01-16", 6), ("d", "2024-03-01", 9)]
    t = to_semantic_table(spark.createDataFrame(data, "k string, at string, v int").selectExpr("k", "to_timestamp(at) AS at", "v"), "t")
    t = t.with_dimensions(k=_.k, at={"expr": _.at, "is_time_dimension": True, "smallest_time_grain": "day"}).with_measures(n=_.count(), total=_.v.sum(), mid=_.v.median(), per=lambda t: t.total / t.n, share=lambda t: t.total / t.all(t.total))
    ask = dict(dimensions=["k"], current_time_range={"start": "2024-01-11", "end": "2024-01-20"}, previous_time_range={"start": "2024-01-01", "end": "2024-01-10"})
    scans = lambda r: r.to_spark()._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    one = t.compare_periods(measures=["n", "total", "mid", "per"], **ask)
    shared = t.compare_periods(measures=["share"], **ask)
    late = t.compare_periods(measures=["n"], **{**ask, "previous_time_range": {"start": "2024-01-01", "end": "2024-01-11"}})
    assert (scans(one), scans(late)) == (1, 2) and scans(shared) > 1
    monkeypatch.setattr(module, "_apart", lambda *a: False)
    two = t.compare_periods(measures=["n", "total", "mid", "per"], **ask)
    assert two.columns == one.columns and rows(two) == rows(one) and len(rows(one)) == 4
