"""Measures over joins: fan-out, chasm, participation, exact measures, star, grain; hand-computed answers."""

import itertools
import random
import warnings

import pytest

from tessella import CompilationError, DefinitionError, QueryError, UnknownFieldError, _, entity_dimension, to_semantic_table


def rows(x, *order):
    got = [tuple(r) for r in x.to_spark().collect()]
    return sorted(got, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def model(spark, name, schema, data):
    return to_semantic_table(spark.createDataFrame(data, schema), name)


@pytest.fixture(scope="module")
def orders_items(spark):
    orders = model(spark, "orders", "order_id int, customer_id int, status string, amount int", [(1, 10, "open", 100), (2, 10, "closed", 120), (3, 20, "open", 80)])
    items = model(spark, "items", "item_id int, order_id int, qty int, sku string", [(1, 1, 1, "a"), (2, 1, 2, "b"), (3, 1, 1, "a"), (4, 2, 3, "c"), (5, 3, 1, "a"), (6, 3, 1, "b")])
    orders = orders.with_dimensions(status=_.status, order_id=_.order_id).with_measures(
        total=_.amount.sum(), n=_.count(), median=_.amount.median(), mean=_.amount.mean(), ratio=_.amount.sum() / _.count(), open_mean=_.amount.mean(where=_.status == "open"), customers=_.customer_id.nunique()
    )
    items = items.with_dimensions(sku=_.sku, qty=_.qty).with_measures(item_count=_.count(), total_qty=_.qty.sum(), median_qty=_.qty.median())
    return orders.join_many(items, "order_id")


def test_fan_out(orders_items):
    assert rows(orders_items.aggregate("orders.total", "items.item_count", "items.total_qty")) == [(300, 6, 9)]
    assert rows(orders_items.group_by("orders.status").aggregate("total", "item_count")) == [("closed", 120, 1), ("open", 180, 5)]


def test_parent_measures_by_a_child_key_count_each_parent_once_a_group(orders_items):
    by_sku = orders_items.group_by("items.sku").aggregate("orders.median", "orders.ratio", "orders.mean", "orders.total")
    assert rows(by_sku) == [("a", 90.0, 90.0, 90.0, 180), ("b", 90.0, 90.0, 90.0, 180), ("c", 120.0, 120.0, 120.0, 120)]
    by_qty = orders_items.group_by("items.qty").aggregate("orders.total")
    assert rows(by_qty) == [(1, 180), (2, 100), (3, 120)]


def test_filters_of_both_sides(orders_items):
    both = orders_items.filter(lambda t: (t.sku == "a") & (t.status == "open"))
    assert rows(both.aggregate("items.item_count", "orders.total")) == [(3, 180)]
    chained = orders_items.filter(lambda t: t.sku == "a").filter(lambda t: t.status == "open")
    assert rows(chained.aggregate("items.item_count", "orders.total")) == [(3, 180)]
    either = orders_items.filter(lambda t: (t.sku == "c") | (t.status == "open"))
    assert rows(either.aggregate("items.item_count", "orders.total")) == [(6, 300)]
    assert rows(orders_items.filter(_.sku == "c").aggregate("orders.open_mean", "orders.n")) == [(None, 1)]


def test_answers_do_not_depend_on_the_other_measures(orders_items):
    names = ["orders.total", "orders.n", "orders.median", "items.item_count", "items.total_qty", "orders.customers"]
    alone = {n: dict(rows(orders_items.group_by("items.sku").aggregate(n))) for n in names}
    for some in itertools.combinations(names, 3):
        for r in orders_items.group_by("items.sku").aggregate(*some).to_spark().collect():
            for n in some:
                assert r[n] == alone[n][r["items.sku"]], (some, n)


def test_chasm(spark):
    customers = model(spark, "customers", "customer_id int, name string", [(1, "Alice"), (2, "Bob")]).with_dimensions(name=_.name)
    orders = model(spark, "orders", "order_id int, customer_id int, amount int", [(1, 1, 100), (2, 1, 200), (3, 2, 150)]).with_measures(order_count=_.count(), amount=_.amount.sum())
    tickets = model(spark, "tickets", "ticket_id int, customer_id int, priority string", [(1, 1, "high"), (2, 2, "low"), (3, 2, "medium")]).with_dimensions(priority=_.priority).with_measures(ticket_count=_.count())
    joined = customers.join_many(orders, "customer_id").join_many(tickets, "customer_id")
    assert rows(joined.aggregate("orders.order_count", "tickets.ticket_count", "orders.amount")) == [(3, 3, 450)]
    assert rows(joined.group_by("customers.name").aggregate("order_count", "ticket_count")) == [("Alice", 2, 1), ("Bob", 1, 2)]
    assert rows(joined.group_by("tickets.priority").aggregate("orders.amount")) == [("high", 300), ("low", 150), ("medium", 150)]


def test_double_count_through_three_levels(spark):
    departments = model(spark, "departments", "dept_id int, dept_name string", [(1, "Eng"), (2, "Ops")]).with_dimensions(dept=_.dept_name)
    employees = model(spark, "employees", "emp_id int, dept_id int, salary int", [(1, 1, 80000), (2, 1, 90000), (3, 2, 60000), (4, 2, 70000)]).with_measures(total_salary=_.salary.sum())
    tasks = model(spark, "tasks", "task_id int, emp_id int, hours int", [(1, 1, 8), (2, 1, 4), (3, 2, 6), (4, 3, 3), (5, 3, 5), (6, 4, 7), (7, 4, 2)]).with_measures(task_count=_.count(), hours=_.hours.sum())
    joined = departments.join_many(employees, "dept_id").join_many(tasks, lambda l, t: l.emp_id == t.emp_id)
    assert rows(joined.aggregate("total_salary", "task_count", "hours")) == [(300000, 7, 35)]
    assert rows(joined.group_by("dept").aggregate("total_salary", "task_count")) == [("Eng", 170000, 3), ("Ops", 130000, 4)]


def test_participation_of_orphans_and_nulls(spark):
    customers = model(spark, "customers", "cust_id int, tier string", [(10, "gold"), (20, "silver"), (30, None), (40, "bronze")]).with_dimensions(tier=_.tier)
    orders = model(spark, "orders", "id int, cust_id int, status string, amount int", [(1, 10, "open", 10), (2, 20, "closed", 20), (3, None, "open", 40), (4, 99, "weird", 80), (5, 10, None, 5), (6, 30, "open", 7)])
    orders = orders.with_dimensions(status=_.status).with_measures(n=_.count(), total=_.amount.sum())
    joined = customers.join_many(orders, "cust_id")
    assert rows(joined.aggregate("n", "total")) == [(4, 42)]
    by_status = rows(joined.group_by("orders.status").aggregate("n", "total"))
    assert ("weird", 1, 80) not in by_status and {r[0] for r in by_status} == {"open", "closed", None}
    assert sum(r[1] for r in by_status) == 4 and sum(r[2] or 0 for r in by_status) == 42
    assert rows(joined.group_by("customers.tier").aggregate("n", "total")) == [("bronze", 0, None), ("gold", 2, 15), ("silver", 1, 20), (None, 1, 7)]
    assert rows(joined.group_by("customers.tier").aggregate()) == [("bronze",), ("gold",), ("silver",), (None,)]


def test_mean_of_a_child_by_the_parents_key(spark):
    customers = model(spark, "customers", "id int, region string", [(1, "West"), (2, "West"), (3, "East")]).with_dimensions(region=_.region)
    orders = model(spark, "orders", "oid int, cid int, amount int", [(1, 1, 100), (2, 1, 200), (3, 2, 300), (4, 2, 400), (5, 3, 500), (6, 3, 600)]).with_measures(avg_amount=_.amount.mean())
    joined = customers.join_many(orders, lambda c, o: c.id == o.cid)
    assert rows(joined.group_by("region").aggregate("avg_amount")) == [("East", 550.0), ("West", 250.0)]
    assert rows(joined.aggregate("avg_amount")) == [(350.0,)]


def test_median_of_a_child_is_exact(spark):
    orders = model(spark, "orders", "order_id int, band string", [(1, "A"), (2, "A")]).with_dimensions(band=_.band)
    items = model(spark, "items", "order_id int, qty int", [(1, 1), (1, 5), (1, 9), (2, 1), (2, 3)]).with_measures(median_qty=_.qty.median(), avg_qty=_.qty.mean())
    assert rows(orders.join_many(items, "order_id").group_by("band").aggregate("median_qty", "avg_qty")) == [("A", 3.0, 19 / 5)]


@pytest.fixture(scope="module")
def star(spark):
    facts = model(spark, "facts", "date_id int, store_id int, item_id int, sale_amount int, quantity int", [(1, 10, 100, 10, 1), (2, 20, 100, 20, 2), (3, 10, 200, 30, 3), (1, 20, 200, 40, 4), (2, 10, 100, 50, 5)])
    facts = facts.with_measures(sales=_.sale_amount.sum(), n=_.count())
    stores = model(spark, "stores", "store_id int, store_name string, city string", [(10, "A", "X"), (20, "B", "Y"), (30, "C", "Z")]).with_dimensions(city=_.city, store_id=entity_dimension(_.store_id))
    items = model(spark, "items", "item_id int, item_name string, category string", [(100, "p", "food"), (200, "q", "toys")]).with_dimensions(category=_.category)
    return facts.join_one(stores, "store_id").join_one(items, lambda l, r: l.item_id == r.item_id)


def test_star_and_pruning(star):
    assert rows(star.group_by("stores.city", "items.category").aggregate("sales")) == [("X", "food", 60), ("X", "toys", 30), ("Y", "food", 20), ("Y", "toys", 40)]
    plan = star.group_by("items.category").aggregate("sales").to_spark()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # stores isn't asked for
    assert star.aggregate("sales").to_spark()._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert rows(star.group_by("stores.city").aggregate()) == [("X",), ("Y",), ("Z",)]  # members without facts
    assert rows(star.filter(_.category == "food").group_by("city").aggregate("n")) == [("X", 2), ("Y", 1)]


def test_large_dimensions_are_joined_after_aggregation(spark):
    facts = model(spark, "facts", "k int, v int", [(1, 10), (1, 20), (2, 30), (9, 5), (None, 7)]).with_measures(n=_.count(), total=_.v.sum(), mean=_.v.mean(), span=_.v.max() - _.v.min(), odd=_.count(where=_.v == 5))
    dims = model(spark, "dims", "k int, name string", [(1, "x"), (2, "x"), (3, "y")]).with_dimensions(k=entity_dimension(_.k), name=_.name)
    joined = facts.join_one(dims, "k")
    ask = lambda: joined.group_by("dims.name").aggregate("n", "total", "mean", "span", "odd")
    plain = rows(ask())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ask().to_spark()._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate") < plan.index("Join") < plan.rindex("Aggregate")
        assert rows(ask()) == plain == [("x", 3, 60, 20.0, 20, 0), (None, 2, 12, 6.0, 2, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_entities_are_no_row_identity(spark):
    events = model(spark, "events", "cust int, amount int", [(7, 100), (7, 50), (8, 30)]).with_dimensions(cust=entity_dimension(_.cust)).with_measures(total=_.amount.sum(), n=_.count(), mid=_.amount.median())
    tags = model(spark, "tags", "cust int, tag string", [(7, "x"), (7, "y"), (8, "x"), (7, "x")]).with_dimensions(tag=_.tag)
    joined = events.join_many(tags, "cust")
    assert rows(joined.group_by("tags.tag").aggregate("total", "n", "mid")) == [("x", 180, 3, 50.0), ("y", 150, 2, 75.0)]
    assert rows(joined.aggregate("total", "n")) == [(180, 3)]
    parents = model(spark, "parents", "k int, name string", [(7, "a"), (7, "b"), (8, "c")]).with_dimensions(k=entity_dimension(_.k), name=_.name)
    children = model(spark, "children", "k int, v int", [(7, 10), (8, 5), (8, 5)]).with_measures(total=_.v.sum(), n=_.count())
    joined = parents.join_many(children, "k")
    assert rows(joined.aggregate("children.total", "n")) == [(20, 3)]
    assert rows(joined.group_by("parents.name").aggregate("children.total")) == [("a", 10), ("b", 10), ("c", 10)]
    assert rows(joined.filter(_.name != "b").aggregate("children.total")) == [(20,)]


def test_joins_that_are_no_equality_count_each_row_once_a_group(spark):
    rates = model(spark, "rates", "lo int, hi int, band string", [(0, 5, "A"), (3, 9, "A"), (8, 9, "B"), (20, 30, "C")]).with_dimensions(band=_.band).with_measures(n_rates=_.count())
    sales = model(spark, "sales", "at int, v int, kind string", [(4, 10, "p"), (4, 10, "p"), (8, 1, "q"), (99, 7, "q")]).with_dimensions(kind=_.kind).with_measures(total=_.v.sum(), n=_.count())
    joined = rates.join_many(sales, lambda r, s: (r.lo <= s.at) & (s.at <= r.hi))
    assert rows(joined.group_by("rates.band").aggregate("total", "n")) == [("A", 21, 3), ("B", 1, 1), ("C", None, 0)]
    assert rows(joined.group_by("sales.kind").aggregate("n_rates")) == [("p", 2), ("q", 2), (None, 1)]
    assert rows(joined.group_by("sales.kind", "rates.band").aggregate("total", "n_rates")) == [("p", "A", 20, 2), ("q", "A", 1, 1), ("q", "B", 1, 1), (None, "C", None, 1)]
    assert rows(joined.filter(_.v > _.lo).group_by("rates.band").aggregate("total")) == [("A", 20)]
    assert rows(joined.filter(_.kind == "q").group_by("rates.band").aggregate("total", "n_rates")) == [("A", 1, 1), ("B", 1, 1)]


def test_mixed_keys_and_two_arms(spark, orders_items):
    mixed = orders_items.with_dimensions(both=lambda t: t.status.upper().concat(t.sku))
    assert rows(mixed.group_by("both").aggregate("orders.total", "items.total_qty")) == [("CLOSEDc", 120, 3), ("OPENa", 180, 3), ("OPENb", 180, 3)]
    a = model(spark, "a", "k int, v int", [(1, 10), (1, 20), (2, 5)]).with_measures(total=_.v.sum())
    b = model(spark, "b", "k int, x string", [(1, "p"), (1, "p"), (1, "q")]).with_dimensions(x=_.x)
    c = model(spark, "c", "k int, y string", [(1, "r"), (1, "s"), (1, "s"), (2, "s")]).with_dimensions(y=_.y)
    joined = a.join_many(b, "k").join_many(c, lambda l, r: l.a.k == r.k)
    assert rows(joined.group_by("b.x", "c.y").aggregate("total")) == [("p", "r", 30), ("p", "s", 30), ("q", "r", 30), ("q", "s", 30), (None, "s", 5)]
    assert rows(joined.filter(_.y == "s").group_by("b.x").aggregate("total")) == [("p", 30), ("q", 30), (None, 5)]
    assert rows(joined.filter(_.y == "r").aggregate("total")) == [(30,)]


def test_rows_without_their_entity_key_count_each(spark):
    orders = model(spark, "o", "oid int, amount int", [(1, 10), (None, 20), (None, 30)]).with_dimensions(oid=entity_dimension(_.oid)).with_measures(total=_.amount.sum(), n=_.count())
    items = model(spark, "i", "oid int, sku string", [(1, "a"), (1, "b")]).with_dimensions(sku=_.sku)
    assert rows(orders.join_many(items, "oid").group_by("i.sku").aggregate("total", "n")) == [("a", 10, 1), ("b", 10, 1), (None, 50, 2)]


def test_measures_of_a_one_side_count_each_row_once(spark):
    orders = model(spark, "orders", "oid int, cid int", [(1, 1), (2, 1), (3, 2)]).with_dimensions(oid=_.oid).with_measures(n=_.count())
    customers = model(spark, "customers", "cid int, balance int", [(1, 10), (2, 20), (3, 40)]).with_measures(balance=_.balance.sum())
    joined = orders.join_one(customers, "cid")
    assert rows(joined.aggregate("orders.n", "customers.balance")) == [(3, 30)]


def test_role_playing_and_names(spark):
    airports = model(spark, "airports", "code string, city string", [("a", "NY"), ("b", "LA")]).with_dimensions(city=_.city)
    flights = model(spark, "flights", "origin string, dest string, passengers int", [("a", "b", 100), ("a", "a", 230), ("b", "a", 120), ("b", "b", 200)]).with_measures(passengers=_.passengers.sum(), flights=_.count())
    joined = flights.join_one(airports.view("origin_airport"), lambda f, a: f.origin == a.code).join_one(airports.view("dest_airport"), lambda f, a: f.dest == a.code)
    assert rows(joined.group_by("origin_airport.city").aggregate("passengers")) == [("LA", 320), ("NY", 330)]
    with pytest.raises(QueryError):
        joined.group_by("city").aggregate("passengers")
    with pytest.raises(DefinitionError):
        flights.join_one(airports, lambda f, a: f.origin == a.code).join_one(airports, lambda f, a: f.dest == a.code)
    assert joined.to_spark().columns == ["origin", "dest", "passengers", "code", "city", "code_right", "city_right"]


def test_join_rules(spark, orders_items):
    with pytest.raises(TypeError):
        orders_items.join(orders_items)
    a = model(spark, "a", "x int", [(1,)])
    b = model(spark, "b", "x int", [(1,), (2,)]).with_measures(n=_.count())
    with pytest.raises(DefinitionError):
        a.join_one(b, "x", how="inner")
    with pytest.raises(UnknownFieldError):
        a.join_one(b, "y")
    crossed = a.with_dimensions(ax=_.x).join_cross(b)
    assert rows(crossed.group_by("a.ax").aggregate("b.n")) == [(1, 2)]


def test_grain_upgrade_warns(spark):
    months = model(spark, "financials", "year int, month int, revenue int", [(2024, 1, 100), (2024, 2, 200), (2024, 3, 300)])
    months = months.with_dimensions(year=entity_dimension(_.year), month=entity_dimension(_.month)).with_measures(revenue=_.revenue.sum())
    days = model(spark, "hours", "year int, month int, day int, worked int", [(2024, 1, 1, 8), (2024, 1, 2, 8), (2024, 2, 1, 4), (2024, 2, 2, 4), (2024, 3, 1, 6), (2024, 3, 2, 6)])
    days = days.with_dimensions(year=entity_dimension(_.year), month=entity_dimension(_.month), day=entity_dimension(_.day)).with_measures(worked=_.worked.sum())
    with pytest.warns(UserWarning):
        joined = months.join_one(days, ["year", "month"])
    assert rows(joined.aggregate("revenue", "worked")) == [(600, 36)]
    assert rows(joined.group_by("financials.month").aggregate("revenue", "worked")) == [(1, 100, 16), (2, 200, 8), (3, 300, 12)]


def test_wrapper_fields(orders_items):
    wide = orders_items.with_measures(per_item=lambda t: t["orders.total"] / t["items.item_count"], all_rows=_.count())
    assert rows(wide.aggregate("per_item", "all_rows")) == [(50.0, 6)]
    keyed = orders_items.with_dimensions(loud=lambda t: t.sku.upper())
    assert rows(keyed.group_by("loud").aggregate("items.item_count")) == [("A", 3), ("B", 2), ("C", 1)]
    with pytest.raises(CompilationError):
        orders_items.aggregate(mixed=lambda t: (t.amount * t.qty).sum())


def test_totals_over_joins(orders_items):
    share = orders_items.group_by("orders.status").aggregate(pct=lambda t: t.items.total_qty / t.all(t.items.total_qty))
    assert rows(share) == [("closed", 3 / 9), ("open", 6 / 9)]


def brute(customers, orders, items, key, what, keep):
    """Each order or item once a group, over the full left join."""
    joined = []
    for c in customers:
        mine = [o for o in orders if o[1] is not None and o[1] == c[0]] or [None]
        for o in mine:
            for i in [i for i in items if o and i[1] is not None and i[1] == o[0]] or [None]:
                joined.append((c, o, i))
    groups = {}
    for c, o, i in joined:
        if keep(c, o, i):
            k = {"tier": c[1], "status": o and o[2], "sku": i and i[2]}[key]
            groups.setdefault(k, []).append((c, o, i))
    out = set()
    for k, g in groups.items():
        seen = {id(t[{"amount": 1, "qty": 2, "balance": 0}[what]]): t[{"amount": 1, "qty": 2, "balance": 0}[what]] for t in g if t[{"amount": 1, "qty": 2, "balance": 0}[what]]}
        values = [x[{"amount": 3, "qty": 3, "balance": 2}[what]] for x in seen.values()]
        known = [v for v in values if v is not None]
        out.add((k, len(values), sum(known) if known else None, len(set(known))))
    return out


@pytest.mark.parametrize("seed", [1, 2, 4, 5])
def test_random_chains_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    some = lambda xs, p=0.15: None if rng.random() < p else rng.choice(xs)
    repeat = (lambda i, n: rng.randrange(n)) if seed > 3 else (lambda i, n: i)
    customers = [(repeat(i, 4), some(["g", "s", "b"]), some(range(50))) for i in range(6)]
    orders = [(repeat(i, 9), some(range(8)), some(["o", "c"]), some(range(9))) for i in range(14)]
    items = [(i, some(range(18)), some(["x", "y", "z"]), some(range(5))) for i in range(30)]
    c = model(spark, "c", "cid int, tier string, balance int", customers).with_dimensions(tier=_.tier, cid=entity_dimension(_.cid) if seed % 2 else _.cid).with_measures(c_n=_.count(), c_sum=_.balance.sum(), c_d=_.balance.nunique())
    o = model(spark, "o", "oid int, ocid int, status string, amount int", orders).with_dimensions(status=_.status, oid=entity_dimension(_.oid) if seed > 1 else _.oid).with_measures(o_n=_.count(), o_sum=_.amount.sum(), o_d=_.amount.nunique())
    i = model(spark, "i", "iid int, ioid int, sku string, qty int", items).with_dimensions(sku=_.sku).with_measures(i_n=_.count(), i_sum=_.qty.sum(), i_d=_.qty.nunique())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        joined = c.join_many(o, lambda a, b: a.cid == b.ocid).join_many(i, lambda a, b: a.oid == b.ioid)
    filters = [
        (lambda c, o, i: True, None),
        (lambda c, o, i: o is not None and o[2] == "o", _.status == "o"),
        (lambda c, o, i: i is not None and i[2] == "x", _.sku == "x"),
        (lambda c, o, i: i is None or i[2] is None, _.sku.isnull()),
        (lambda c, o, i: o is None or o[2] is None, _.status.isnull()),
        (lambda c, o, i: i is not None and i[2] == "x" or o is not None and o[2] == "o", (_.sku == "x") | (_.status == "o")),
        (lambda c, o, i: i is not None and i[2] in ("x", "y") and o[3] is not None and o[3] > 4, _.sku.isin(["x", "y"]) & (_.amount > 4)),
    ]
    for keep, predicate in filters:
        m = joined if predicate is None else joined.filter(predicate)
        for key in ("tier", "status", "sku"):
            got = m.group_by(key).aggregate(*[f"{p}_{x}" for p in "coi" for x in ("n", "sum", "d")]).to_spark().collect()
            for n, what in enumerate(("balance", "amount", "qty")):
                assert {(r[0], *r[1 + 3 * n : 4 + 3 * n]) for r in got} == brute(customers, orders, items, key, what, keep), (key, what)
