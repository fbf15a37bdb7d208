"""Flat models: definitions, filters, calculated measures, totals, windows, nests, arrays, index, query API."""

import datetime as dt

import pytest

from tessella import CompilationError, DefinitionError, NonAdditiveTotalError, QueryError, UnknownFieldError, _, case, entity_dimension, ifelse, parse, time_dimension, to_semantic_table, window
from tessella.expr import serialize
from tessella.operators import graph
from tessella.sources.profiles import Connection, expanded
from tessella.sources.yaml_models import from_config, from_yaml

from .test_joins import rows


@pytest.fixture(scope="module")
def flights(spark):
    df = spark.createDataFrame([("A", "x", 10), ("A", "y", 20), ("A", "x", 30), ("B", "y", 100)], "carrier string, origin string, distance int")
    return to_semantic_table(df, "flights").with_dimensions(carrier=_.carrier, origin=_.origin).with_measures(n=_.count(), total=_.distance.sum(), mean=_.distance.mean())


@pytest.fixture(scope="module")
def orders(spark):
    df = spark.createDataFrame([("a", "e", 1, 10), ("a", "w", 1, 20), ("b", "e", 2, 30), ("b", "w", 2, 40), ("c", "e", 3, 100), ("c", "w", 3, 200)], "status string, region string, day int, amount int")
    return to_semantic_table(df, "orders").with_dimensions(status=_.status, region=_.region, day=_.day).with_measures(amount_sum=_.amount.sum(), n=_.count())


def test_three_notations_agree(flights):
    want = [("A", 3, 60), ("B", 1, 100)]
    assert rows(flights.group_by("carrier").aggregate("n", "total")) == want
    assert rows(flights.group_by(_.carrier).aggregate(lambda t: t.n, _.total)) == want
    assert rows(flights.group_by("flights.carrier").aggregate(n=lambda t: t.n, total=_.distance.sum())) == want
    assert rows(flights.group_by(["carrier"]).agg("n", "total")) == want


def test_totals(flights):
    out = flights.group_by("carrier").aggregate(s=lambda t: t.total / t.all(t.total), m=lambda t: t.mean / t.all(t.mean), i=lambda t: t.distance.max() / t.all(t.distance.max()))
    assert rows(out) == [("A", 60 / 160, 20 / 40, 0.3), ("B", 100 / 160, 100 / 40, 1.0)]
    filtered = flights.filter(_.origin == "x").group_by("carrier").aggregate(s=lambda t: t.total / t.all(t.total))
    assert rows(filtered) == [("A", 1.0)]
    with pytest.raises(NonAdditiveTotalError):
        flights.group_by("carrier").aggregate("mean").mutate(x=lambda t: t.mean / t.all(t.mean))
    after = flights.group_by("carrier").aggregate("total").filter(_.total > 60).mutate(x=lambda t: t.total / t.all(t.total))
    assert rows(after) == [("B", 100, 1.0)]


def test_calculated_measures(flights):
    m = flights.with_measures(per=lambda t: t.total / t.n).with_measures(double=lambda t: t.per * 2, rel=lambda t: t.per / t.all(t.per))
    assert rows(m.group_by("carrier").aggregate("double", "rel")) == [("A", 40.0, 0.5), ("B", 200.0, 2.5)]
    assert set(m.get_calculated_measures()) == {"per", "double", "rel"} and set(m.get_measures()) == {"n", "total", "mean"}
    with pytest.raises(DefinitionError):
        flights.with_measures(loop=lambda t: t.loop + 1)
    with pytest.raises(CompilationError):
        flights.with_measures(a=lambda t: t.b + 1, b=lambda t: t.a + 1).group_by("carrier").aggregate("a")
    with pytest.raises(QueryError):
        flights.group_by("carrier").aggregate(x=_.distance)
    assert rows(flights.group_by("carrier").aggregate(low=lambda t: t.carrier.lower(), n=_.count())) == [("A", "a", 3), ("B", "b", 1)]


def test_windows(orders):
    by_day = orders.group_by("day").aggregate("amount_sum").order_by("day")
    assert rows(by_day.mutate(run=_.amount_sum.cumsum(), prev=_.amount_sum.lag())) == [(1, 30, 30, None), (2, 70, 100, 30), (3, 300, 400, 70)]
    inside = orders.group_by("region", "day").aggregate(share=lambda t: t.amount_sum / t.amount_sum.sum().over(window(group_by=t.region)))
    assert {(r[0], r[1]): round(r[2], 6) for r in rows(inside)}[("e", 3)] == round(100 / 140, 6)
    run = orders.group_by("day").aggregate(run=lambda t: t.amount.sum().over(window(order_by=t.day, rows=(None, 0))))
    assert rows(run) == [(1, 30), (2, 100), (3, 400)]
    ranked = by_day.mutate(r=lambda t: t.amount_sum.rank().over(order_by=t.amount_sum.desc()), k=_.amount_sum.row_number().over(order_by="day"), avg2=_.amount_sum.mean().over(order_by="day", preceding=1, following=0))
    assert rows(ranked) == [(1, 30, 2, 0, 30.0), (2, 70, 1, 1, 50.0), (3, 300, 0, 2, 185.0)]
    with pytest.raises(CompilationError):
        orders.group_by("day").aggregate("amount_sum").mutate(run=_.amount_sum.cumsum())


def test_filters_in_every_form(orders):
    forms = [
        _.amount > 30,
        lambda t: t.amount > 30,
        "_.amount > 30",
        {"field": "amount", "operator": ">", "value": 30},
        {"operator": "OR", "conditions": [{"field": "amount", "operator": "gt", "value": 30}, {"operator": "AND", "conditions": [{"field": "orders.status", "operator": "=", "value": "zz"}]}]},
    ]
    for f in forms:
        assert rows(orders.filter(f).aggregate("n")) == [(3,)], f
    assert rows(orders.group_by("status").filter(_.amount > 30).aggregate("n")) == [("b", 1), ("c", 2)]
    bad = [{"field": "amount"}, {"field": "amount", "operator": ">"}, {"field": "amount", "operator": "in", "values": "abc"}, {"field": "amount", "operator": "is null", "value": 1}, {"operator": "AND", "conditions": []}, {"field": "a", "operator": "zzz", "value": 1}]
    for f in bad:
        with pytest.raises(QueryError):
            orders.filter(f)
    with pytest.raises(QueryError):
        orders.filter(lambda t: True)
    with pytest.raises(UnknownFieldError):
        orders.filter({"field": "nope", "operator": "=", "value": 1}).aggregate("n").to_spark()


def test_dimensions_on_dimensions(spark):
    df = spark.createDataFrame([(10 * i, i, s) for i, s in zip(range(1, 7), "aabbcc")], "amount int, qty int, status string")
    m = to_semantic_table(df, "t").with_dimensions(big=_.amount > 30, label=lambda t: ifelse(t.big, "big", "small"), amount=_.amount, status=lambda t: t.status.upper()).with_measures(n=_.count(), total=_.amount.sum(), low=_.status.min())
    assert rows(m.group_by("label").aggregate("n", "total")) == [("big", 3, 150), ("small", 3, 60)]
    assert rows(m.filter(lambda t: t.status == "A").group_by("status").aggregate("n")) == [("A", 2)]
    with pytest.raises(QueryError):
        m.group_by("status").aggregate("low")  # the key redefines the column that low reads
    with pytest.raises(DefinitionError):
        m.with_dimensions(p=_.q, q=_.p).group_by("p").aggregate("n")
    with pytest.raises(UnknownFieldError, match="label"):
        m.group_by("lable").aggregate("n")


@pytest.fixture(scope="module")
def events(spark):
    when = [dt.datetime(2025, 1, 5, 9), dt.datetime(2025, 1, 31, 12), dt.datetime(2025, 2, 10, 8), dt.datetime(2025, 3, 2)]
    df = spark.createDataFrame([(w, i + 1, "k") for i, w in enumerate(when)], "ts timestamp_ntz, v int, kind string").selectExpr("*", "CAST(ts AS DATE) AS d")
    return to_semantic_table(df, "events").with_dimensions(ts=time_dimension(_.ts, "TIME_GRAIN_SECOND", derived_dimensions=["year", "month"]), d=time_dimension(_.d, "day"), kind=_.kind).with_measures(total=_.v.sum(), n=_.count())


def test_grains_ranges_and_periods(events):
    by_month = events.query(["ts"], ["total"], time_grain="month", order_by=[("ts", "desc")])
    assert [tuple(r) for r in by_month.to_spark().collect()] == [(dt.datetime(2025, 3, 1), 4), (dt.datetime(2025, 2, 1), 3), (dt.datetime(2025, 1, 1), 3)]
    assert rows(events.query(["d"], ["n"], time_grains={"d": "TIME_GRAIN_QUARTER"})) == [(dt.date(2025, 1, 1), 4)]
    assert rows(events.query(["ts"], ["n"], time_grain="Y", time_range={"start": "2025-01-01", "end": "2025-01-31"})) == [(dt.datetime(2025, 1, 1), 2)]
    assert rows(events.query(["ts"], ["n"], time_grain="Y", time_range={"start": "2025-01-01", "end": "2025-01-31T11:00:00"})) == [(dt.datetime(2025, 1, 1), 1)]
    assert rows(events.group_by("ts_year", "ts_month").aggregate("n")) == [(2025, 1, 2), (2025, 2, 1), (2025, 3, 1)]
    late = {"field": "ts", "operator": ">=", "value": "2025-01-31"}
    assert rows(events.query(["ts"], ["total"], time_grain="month", filters=[late])) == [(dt.datetime(2025, 1, 1), 2), (dt.datetime(2025, 2, 1), 3), (dt.datetime(2025, 3, 1), 4)]
    out = events.compare_periods(measures=["total"], dimensions=["kind"], time_dimension="ts", current_time_range={"start": "2025-02-01", "end": "2025-02-28"}, previous_time_range={"start": "2025-01-01", "end": "2025-01-31"})
    assert rows(out) == [("k", 3, 3, 0, 0.0)]
    one = events.compare_periods(measures=["total"], time_dimension="ts", current_time_range={"start": "2025-03-01", "end": "2025-03-31"}, previous_time_range={"start": "2024-01-01", "end": "2024-01-31"})
    assert rows(one) == [(4, None, 4, None)]
    wrong = [dict(time_grain="month", time_grains={"ts": "day"}), dict(time_range={"start": "2025-02-01", "end": "2025-01-01"}), dict(limit=-1), dict(limit=True), dict(order_by=[("n", "sideways")]), dict(order_by=[("total", "asc")]), dict(time_grain="eon")]
    for kw in wrong:
        with pytest.raises(QueryError):
            events.query(["ts"], ["n"], **kw)
    with pytest.raises(QueryError):
        events.query(["d"], ["n"], time_grain="hour")
    assert rows(events.query(["ts"], ["n"], limit=0)) == []


def test_having(orders):
    assert rows(orders.query(["status"], ["amount_sum"], filters=[{"field": "amount_sum", "operator": ">", "value": 50}])) == [("b", 70), ("c", 300)]
    both = {"operator": "AND", "conditions": [{"field": "region", "operator": "=", "value": "e"}, {"field": "amount_sum", "operator": ">", "value": 20}]}
    assert rows(orders.query(["status"], ["amount_sum"], filters=[both])) == [("b", 30), ("c", 100)]
    with pytest.raises(QueryError):
        orders.query(["status"], ["n"], having=[{"field": "amount_sum", "operator": ">", "value": 50}])


def test_nests(orders):
    top = orders.group_by("region").aggregate("n", nest={"best": lambda t: t.group_by("status").aggregate("amount_sum").order_by(_.amount_sum.desc()).limit(2)})
    got = {r["region"]: (r["n"], [tuple(x) for x in r["best"]]) for r in top.to_spark().collect()}
    assert got == {"e": (3, [("c", 100), ("b", 30)]), "w": (3, [("c", 200), ("b", 40)])}
    few = orders.group_by("region").aggregate("n", nest={"best": lambda t: t.group_by("status").aggregate("amount_sum").filter(_.amount_sum > 100)})
    assert {r["region"]: r["best"] and [tuple(x) for x in r["best"]] for r in few.to_spark().collect()} == {"e": None, "w": [("c", 200)]}
    plain = orders.group_by("status").aggregate(nest={"data": lambda t: t.group_by("day", "amount")})
    assert {r["status"]: sorted(tuple(x) for x in r["data"]) for r in plain.to_spark().collect()} == {"a": [(1, 10), (1, 20)], "b": [(2, 30), (2, 40)], "c": [(3, 100), (3, 200)]}
    again = plain.as_table().with_measures(k=_.data.count(), s=_.data.amount.sum()).group_by("status").aggregate("k", "s")
    assert rows(again) == [("a", 2, 30), ("b", 2, 70), ("c", 2, 300)]
    deep = orders.group_by("region").aggregate(nest={"x": lambda t: t.group_by("status").aggregate("n", nest={"y": lambda u: u.group_by("day").aggregate("amount_sum")})})
    assert {r["region"]: sorted((x["status"], x["n"], [tuple(y) for y in x["y"]]) for x in r["x"]) for r in deep.to_spark().collect()}["e"] == [("a", 1, [(1, 10)]), ("b", 1, [(2, 30)]), ("c", 1, [(3, 100)])]
    with pytest.raises(NotImplementedError):
        orders.group_by("region").aggregate("n", nest={"x": lambda t: t.order_by("day")})


def test_nested_arrays(spark):
    df = spark.createDataFrame([("filled", [1, 2, 2]), ("empty", []), ("null", None)], "category string, hits array<int>")
    m = to_semantic_table(df, "t").with_dimensions(category=_.category).with_measures(k=_.hits.count(), d=_.hits.nunique(), s=_.hits.sum(), n=_.count())
    assert rows(m.group_by("category").aggregate("k", "d", "s", "n")) == [("empty", 0, 0, None, 1), ("filled", 3, 2, 5, 1), ("null", 0, 0, None, 1)]
    assert rows(m.unnest("hits").aggregate(n=_.count())) == [(3,)]
    deep = spark.createDataFrame([(1, [(1, [("p", 2.0), ("q", 3.0)]), (2, [])]), (2, [(3, [("p", 5.0)])])], "id int, hits array<struct<h:int,product:array<struct<sku:string,price:double>>>>")
    g = to_semantic_table(deep, "ga").with_dimensions(id=_.id).with_measures(hits=_["hits"].count(), products=_["hits"].product.count(), price=_["hits"].product.price.sum(), top=_["hits"].h.max(), sessions=_.count())
    assert rows(g.group_by("id").aggregate("hits", "products", "price", "top", "sessions")) == [(1, 2, 2, 5.0, 2, 1), (2, 1, 1, 5.0, 3, 1)]
    assert g.unnest("hits").to_spark().columns == ["id", "hits", "h", "product"]


def test_index_and_search(flights):
    got = rows(flights.index(["carrier", "origin"]))
    assert ("carrier", "carrier", "string", "A", 3) in got and ("origin", "origin", "string", "y", 2) in got and len(got) == 4
    m = flights.with_dimensions(distance=_.distance)
    assert ("distance", "distance", "number", "10 to 100", 4) in rows(m.index())
    assert ("carrier", "carrier", "string", "B", 100.0) in rows(flights.index("carrier", by="total"))
    with pytest.raises(UnknownFieldError):
        flights.index("nope")
    with pytest.raises(QueryError):
        flights.index(sample=0)
    assert flights.search_values("carrier", "a") == {"values": [{"value": "A", "count": 3}], "is_complete": True}
    assert flights.search_values("carrier", "zzz")["is_complete"] is False


def test_reaggregate_order_limit(orders):
    sums = orders.group_by("status").aggregate("amount_sum")
    assert rows(sums.aggregate(top=_.amount_sum.max(), k=_.count())) == [(300, 3)]
    assert [tuple(r) for r in sums.order_by(_.amount_sum.desc()).limit(2, offset=1).to_spark().collect()] == [("b", 70), ("a", 30)]
    assert rows(orders.order_by(_.amount.desc()).limit(2).group_by("region").aggregate("n")) == [("e", 1), ("w", 1)]
    with pytest.raises(QueryError):
        sums.limit(-1)
    with pytest.raises(AttributeError, match="to_spark"):
        orders.union(orders)
    with pytest.raises(NotImplementedError):
        orders.select("status")


def test_mutate_and_join_a_result(spark, orders):
    lifted = orders.mutate(twice=_.amount * 2, four=_.twice * 2).group_by("four").aggregate("n")
    assert len(rows(lifted)) == 6
    names = to_semantic_table(spark.createDataFrame([("a", "Alpha")], "code string, label string"), "names").with_dimensions(label=_.label)
    joined = orders.group_by("status").aggregate("amount_sum").with_measures(total=_.amount_sum.sum()).join_one(names, lambda l, r: l.status == r.code)
    assert rows(joined.group_by("names.label").aggregate("total")) == [("Alpha", 30), (None, 370)]


def test_sandbox():
    good = ["_.a.sum() / _.count()", "_.a.isin([1, 2])", "_.x if _.y > 1 else None", "lambda t: t.a.cast('int')", "ibis.ifelse(_.a > 1, 'x', 'y')", "_.a.sum().over(window(order_by=_.b, rows=(None, 0)))", "not (_.a is None)", "-_.a ** 2", "_['a b'].max()"]
    for text in good:
        parse(text)
    evil = ["__import__('os')", "_.__class__", "(lambda: 1)()", "[x for x in _]", "_.a.pipe(print)", "open('x')", "_.a.sum(**{})", "f'{_}'", "_.a.to_pandas()", "lambda x=1: x", "1 +", "_._private", "_['__class__']"]
    for text in evil:
        with pytest.raises(DefinitionError):
            parse(text)


def test_yaml_and_profiles(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("A", 1, 10), ("B", 2, 20), ("A", 3, 30)], "carrier string, id int, distance int").write.parquet(str(tmp_path / "flights.parquet"))
    spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "code string, name string").write.parquet(str(tmp_path / "carriers.parquet"))
    monkeypatch.setenv("DATA_DIR", str(tmp_path))
    (tmp_path / "profiles.yml").write_text("local:\n  type: files\n  tables:\n    flights: ${DATA_DIR}/flights.parquet\n    carriers: {source: carriers.parquet}\n")
    (tmp_path / "m.yml").write_text(
        """
profile: local
carriers:
  table: carriers
  dimensions: {code: _.code, name: _.name}
flights:
  table: flights
  description: all flights
  dimensions:
    carrier: _.carrier
  measures:
    n: _.count()
    total: {expr: _.distance.sum(), description: sum}
  calculated_measures:
    mean: _.total / _.n
    pct: _.total / _.all(_.total) * 100
  filter: _.distance > 0
  joins:
    carriers: {model: carriers, type: one, left_on: carrier, right_on: code}
"""
    )
    models = from_yaml(tmp_path / "m.yml", profile_path=tmp_path / "profiles.yml", spark=spark)
    assert rows(models["flights"].group_by("carriers.name").aggregate("n", "mean", "pct")) == [("Alpha", 2, 20.0, 40 / 60 * 100), ("Beta", 1, 20.0, 20 / 60 * 100)]
    assert Connection(spark, {"type": "files", "path": str(tmp_path)}).list_tables() == ["carriers", "flights"]
    with pytest.raises(DefinitionError, match="dimensions"):
        from_config({"x": {"table": "t", "dimension": {}}}, {"t": spark.range(1)}, spark=spark)
    with pytest.raises(DefinitionError):
        expanded("${NOT_SET_ANYWHERE}")
    assert expanded("${NOT_SET_ANYWHERE:-d}") == "d"


def test_introspection_and_serialization(flights):
    m = flights.with_dimensions(route={"expr": lambda t: t.carrier + t.origin, "description": "r", "unit": "u"}, id=entity_dimension(_.carrier)).with_measures(per=lambda t: t.total / t.n)
    g = m.get_graph()
    assert g["route"]["deps"] == {"carrier": "dimension", "origin": "dimension"} and g["per"]["type"] == "calc_measure"
    assert graph.successors(g, "total") == {"per"} and graph.bfs(g, "per")[0] == "per" and "n" in graph.predecessors(g, "per")
    d = m.json_definition
    assert d["name"] == "flights" and d["dimensions"]["route"] == {"description": "r", "unit": "u"} and set(d["entity_dimensions"]) == {"id"}
    assert "carrier [dim]" in repr(m) and m["carrier"].expr is not None
    again = serialize.model_from_data(serialize.model_to_data(flights.with_measures(per=lambda t: t.total / t.n).filter(_.distance > 10)), flights.node.df)
    assert rows(again.group_by("carrier").aggregate("per")) == [("A", 25.0), ("B", 100.0)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("  Ab_c ", 7, -2, dt.datetime(2024, 2, 29, 13, 45, 6, 250000), None, [3, 1, 3])], "s string, a int, b int, t timestamp_ntz, n string, l array<int>")
    m = to_semantic_table(df, "t")
    cases = [
        (_.a / 2, 3.5), (_.a // 2, 3), (_.b // 4, -1), (_.a % 4, 3), (_.a**2, 49.0), (-_.a, -7), (_.a / 0, None), (_.b.abs(), 2), (_.a.sign(), 1.0), ((_.a / 3).round(2), 2.33), ((_.a / 2).ceil(), 4), ((_.a / 2).floor(), 3),
        (_.s.strip(), "Ab_c"), (_.s.lstrip(), "Ab_c "), (_.s.rstrip(), "  Ab_c"), (_.s.strip().lower(), "ab_c"), (_.s.strip().upper(), "AB_C"), (_.s.strip().capitalize(), "Ab_c"), (_.s.length(), 7), (_.s.contains("b_"), True),
        (_.s.strip().startswith("Ab"), True), (_.s.strip().endswith("x"), False), (_.s.find("A"), 2), (_.s.find("zz"), -1), (_.s.strip().substr(1, 2), "b_"), (_.s.strip().right(2), "_c"), (_.s.strip().reverse(), "c_bA"),
        (_.s.strip().replace("_", "-"), "Ab-c"), (_.s.strip().split("_"), ["Ab", "c"]), (_.s.strip().lpad(6, "*"), "**Ab_c"), (_.s.strip().repeat(2), "Ab_cAb_c"), (_.s.strip().translate("Ac", "12"), "1b_2"), (_.s.like("%b%"), True), (_.s.ilike("%AB%"), True),
        (_.s.re_extract("([A-Z])", 1), "A"), (_.s.strip().re_replace("[a-z]", "."), "A._."), (_.s.re_search("b_c"), True), (_.s.strip().re_split("_"), ["Ab", "c"]),
        (_.t.year(), 2024), (_.t.quarter(), 1), (_.t.month(), 2), (_.t.day(), 29), (_.t.hour(), 13), (_.t.minute(), 45), (_.t.second(), 6), (_.t.millisecond(), 250), (_.t.day_of_week(), 3), (_.t.week_of_year(), 9), (_.t.date(), dt.date(2024, 2, 29)),
        (_.t.truncate("M"), dt.datetime(2024, 2, 1)), (_.t.truncate("week"), dt.datetime(2024, 2, 26)), (_.t.strftime("%Y-%m/%d"), "2024-02/29"), (_.t.epoch_seconds(), 1709214306),
        (_.n.isnull(), True), (_.n.notnull(), False), (_.n.fill_null("z"), "z"), (_.n.coalesce("q"), "q"), (_.a.nullif(7), None), (_.n.identical_to(None), True), (_.a.between(1, 7), True), (_.a.isin([1, 7]), True), (_.a.notin([7]), False),
        (_.a.greatest(9), 9), (_.a.least(1), 1), (_.a.cast("string"), "7"), (_.s.try_cast("int"), None), ((_.a > 1).ifelse("y", "n"), "y"), (case().when(_.a > 9, "x").when(_.a > 5, "y").else_("z"), "y"), (_.a.cases((7, "seven"), else_="other"), "seven"),
        (_.l[0], 3), (_.l.unique(), [3, 1]), (_.l[1:3], [1, 3]), (~(_.a > 1), False), ((_.a > 1) ^ (_.b > 1), True),
    ]
    for e, want in cases:
        name = "x"
        got = m.with_dimensions(**{name: e}).group_by(name).aggregate().to_spark().collect()[0][0]
        assert got == want, (e, got, want)


def test_functions_of_the_package(spark, orders):
    import tessella as t

    by_day = orders.group_by("day").aggregate("amount_sum")
    out = by_day.mutate(k=t.row_number().over(order_by="day"), d=t.dense_rank().over(order_by=_.amount_sum.desc()), q=t.ntile(2).over(order_by="day"), g=t.greatest(_.day, 2), c=t.coalesce(None, _.day))
    assert rows(out) == [(1, 30, 0, 2, 0, 2, 1), (2, 70, 1, 1, 0, 2, 2), (3, 300, 2, 0, 1, 3, 3)]
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31), 1)], "t timestamp_ntz, x int")
    m = to_semantic_table(df).with_dimensions(later=_.t + t.interval(days=1, hours=2), over=_.x > t.param("least", 0)).with_measures(n=_.count())
    assert rows(m.group_by("later").aggregate()) == [(dt.datetime(2024, 2, 1, 2),)]
    assert rows(m.group_by("over").aggregate("n")) == [(True, 1)] and rows(m.with_params(least=5).group_by("over").aggregate("n")) == [(False, 1)]
    assert rows(m.filter(t.or_(_.x == 1, _.x == 9)).aggregate("n")) == [(1,)]


def test_spark_columns_and_udfs(spark):
    from pyspark.sql import functions as F

    import tessella as t

    df = spark.createDataFrame([("a b", 1), ("c", 2), ("d e f", 3)], "s string, v int")
    words = F.udf(lambda s: len(s.split()), "int")
    m = to_semantic_table(df, "m").with_dimensions(words=t.raw(words("s")), v=_.v).with_measures(total=_.v.sum(), longest=t.raw(F.length("s")).max(), many=lambda x: (x.words > 1).sum())
    assert rows(m.group_by("words").aggregate("total", "longest")) == [(1, 2, 1), (2, 1, 3), (3, 3, 5)]
    assert rows(m.filter(_.words > 1).aggregate("total", "many")) == [(4, 2)]
    other = to_semantic_table(spark.createDataFrame([(1, "x"), (2, "y")], "k int, n string"), "o").with_dimensions(n=_.n)
    assert rows(m.join_one(other, lambda a, b: a.v == b.k).group_by("o.n").aggregate("m.longest")) == [("x", 3), ("y", 1), (None, 5)]


def test_truths_add_up(spark):
    df = spark.createDataFrame([(1, True), (5, False), (9, None)], "x int, b boolean")
    m = to_semantic_table(df).with_measures(over=(_.x > 4).sum(), share=(_.x > 4).mean(), b=_.b.sum(), some=_.b.any(), every=_.b.all())
    assert rows(m.aggregate("over", "b", "some", "every")) == [(2, 1, True, False)]
    assert rows(m.aggregate(s=lambda t: t.share * 3)) == [(2.0,)]


def test_bucketing_with_other(spark):
    import tessella as t

    df = spark.createDataFrame([(f"S{i % 5}", f"c{i}", i) for i in range(20)], "state string, code string, elevation int")
    m = to_semantic_table(df, "airports").with_dimensions(state=_.state, code=_.code, elevation=_.elevation).with_measures(mean=_.elevation.mean())
    out = m.group_by("state").aggregate("mean", nest={"data": lambda t: t.group_by(["code", "elevation"])})
    out = out.mutate(rank=lambda x: t.row_number().over(t.window(order_by=t.desc(x.mean))))
    out = out.mutate(bucket=lambda x: t.ifelse(x.rank > 1, "OTHER", x.state)).group_by("bucket").aggregate(airports=_.data.count(), mean=_.data.elevation.mean())
    assert rows(out) == [("OTHER", 12, 8.5), ("S3", 4, 10.5), ("S4", 4, 11.5)]


def test_streaming_batches(spark, tmp_path):
    from tessella.streaming.sources import for_each_batch, stream

    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    build = lambda df: to_semantic_table(df, "s").with_dimensions(k=_.k).with_measures(total=_.v.sum())
    q = for_each_batch(stream(spark, str(tmp_path / "in"), "k string, v int"), build, lambda m: m.group_by("k").aggregate("total"), lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert sorted(got) == [("a", 4), ("b", 2)]


def test_streaming_windows(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessella.streaming.sources import stream, windowed_counts

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([("a", at(0, 1)), ("a", at(0, 9)), ("b", at(0, 12)), ("a", at(3, 0))], "k string, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream(spark, str(tmp_path / "in"), "k string, ts timestamp_ntz")
    out = windowed_counts(source, "ts", "10 minutes", ["k"], {"n": F.count("*")}, late="30 minutes")
    q = out.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.window_start.hour * 60 + r.window_start.minute, r.k, r.n) for r in spark.table("windows").collect()}
    assert got == {(0, "a", 2), (10, "b", 1)}  # the last window is still open


def test_chart_specification(flights):
    bar = flights.group_by("carrier").aggregate("total").chart()
    assert bar["mark"] == "bar" and len(bar["data"]["values"]) == 2
    assert flights.aggregate("n").chart()["encoding"]["text"]["field"] == "n"
    assert flights.group_by("carrier", "origin").aggregate("n").chart("echarts")["series"][0]["type"] == "heatmap"


def test_exports(flights, tmp_path):
    out = flights.group_by("carrier").aggregate("n").order_by("carrier")
    assert out.execute()["n"].tolist() == [3, 1] and out.to_pyarrow().num_rows == 2
    assert sum(b.num_rows for b in out.to_pyarrow_batches(1)) == 2
    for kind in ("parquet", "csv", "json"):
        getattr(out, f"to_{kind}")(str(tmp_path / kind))
    assert flights.node.df.sparkSession.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert "Aggregate" in out.compile() and out.columns == ("carrier", "n")


def test_http_service(flights):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from tessella.sources.server import Service, server

    s = server({"flights": flights}, api_key="k")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"

    def ask(path, body=None, key="k"):
        data = None if body is None else json.dumps(body).encode()
        return json.loads(urlopen(Request(base + path, data, {"X-API-Key": key})).read())

    try:
        assert ask("/health") == {"status": "ok"} and set(ask("/models")["models"]) == {"flights"}
        assert ask("/models/flights/schema")["name"] == "flights"
        out = ask("/query", {"model": "flights", "dimensions": ["carrier"], "measures": ["n"], "order_by": [["n", "desc"]], "limit": 1})
        assert out == {"columns": ["carrier", "n"], "rows": [{"carrier": "A", "n": 3}], "row_count": 1}
        assert ask("/models/flights/dimensions/carrier/values?search=b")["values"] == [{"value": "B", "count": 1}]
        for path, body, key, status in (("/query", {"model": "flights", "measures": ["zz"]}, "k", 400), ("/models/none/schema", None, "k", 404), ("/health", None, "bad", 401), ("/query", {"model": "flights", "measures": ["n"], "limit": 10**9}, "k", 400)):
            with pytest.raises(HTTPError) as e:
                ask(path, body, key)
            assert e.value.code == status
    finally:
        s.shutdown()
    assert Service({"flights": flights}).call("list_models") == {"flights": "model flights"}
