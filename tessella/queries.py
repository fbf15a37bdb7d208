"""The registered queries of the semantic layer, each with the SQL that states the same result."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _, entity_dimension, ifelse, time_dimension, to_semantic_table, window
from .model import Result, SemanticTable
from .plans.tree import quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = f(models(spark, sf_dir))
            return plain(got.to_spark() if isinstance(got, (Result, SemanticTable)) else got)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return run

    return register


def plain(df: DataFrame) -> DataFrame:
    """Names without dots and doubles to two places, for comparison."""
    return df.select(*[(F.round(quoted(c), 2) if t == "double" else quoted(c)).alias(c.replace(".", "_")) for c, t in df.dtypes])


class Models:
    """The models over the test tables, defined once a session and folder, as a user of the layer would."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self.tables[name]

    @cached_property
    def orders(self) -> SemanticTable:
        return (
            to_semantic_table(self.table("orders"), "orders", "customer orders")
            .with_dimensions(
                orderkey=entity_dimension(_.o_orderkey, unique=True),
                status=_.o_orderstatus,
                priority=_.o_orderpriority,
                ordered={"expr": _.o_orderdate, "is_time_dimension": True, "smallest_time_grain": "TIME_GRAIN_DAY", "derived_dimensions": ["year", "month"]},
                size=lambda t: ifelse(t.o_totalprice > 250000, "large", "small"),
                size_label=lambda t: t.size.upper(),
            )
            .with_measures(n=_.count(), revenue=_.o_totalprice.sum(), avg_price=_.o_totalprice.mean(), top_price=_.o_totalprice.max(), median_price=_.o_totalprice.median(), customers=_.o_custkey.nunique())
            .with_measures(per_order=lambda t: t.revenue / t.n, share=lambda t: t.revenue / t.all(t.revenue), over_mean=lambda t: t.avg_price - t.all(t.avg_price))
        )

    @cached_property
    def lineitem(self) -> SemanticTable:
        return (
            to_semantic_table(self.table("lineitem"), "lineitem")
            .with_dimensions(flag=_.l_returnflag, linestatus=_.l_linestatus, shipped=time_dimension(_.l_shipdate, "TIME_GRAIN_DAY"), partkey=_.l_partkey, suppkey=_.l_suppkey)
            .with_measures(lines=_.count(), qty=_.l_quantity.sum(), avg_qty=_.l_quantity.mean(), min_qty=_.l_quantity.min(), max_qty=_.l_quantity.max(), median_qty=_.l_quantity.median(), parts=_.l_partkey.nunique())
            .with_measures(gross=lambda t: (t.l_extendedprice * (1 - t.l_discount)).sum(), gross_per_unit=lambda t: t.gross / t.qty)
        )

    @cached_property
    def customer(self) -> SemanticTable:
        return (
            to_semantic_table(self.table("customer"), "customer")
            .with_dimensions(custkey=entity_dimension(_.c_custkey, unique=True), segment=_.c_mktsegment)
            .with_measures(customers=_.count(), balance=_.c_acctbal.sum())
        )

    @cached_property
    def nation(self) -> SemanticTable:
        return to_semantic_table(self.table("nation"), "nation").with_dimensions(nationkey=entity_dimension(_.n_nationkey, unique=True), name=_.n_name)

    @cached_property
    def region(self) -> SemanticTable:
        return to_semantic_table(self.table("region"), "region").with_dimensions(name=_.r_name)

    @cached_property
    def supplier(self) -> SemanticTable:
        return to_semantic_table(self.table("supplier"), "supplier").with_dimensions(suppkey=entity_dimension(_.s_suppkey, unique=True)).with_measures(suppliers=_.count(), supplier_balance=_.s_acctbal.sum())

    @cached_property
    def part(self) -> SemanticTable:
        return to_semantic_table(self.table("part"), "part").with_dimensions(partkey=entity_dimension(_.p_partkey, unique=True), brand=_.p_brand, kind=_.p_type, psize=_.p_size).with_measures(parts=_.count())

    @cached_property
    def events(self) -> SemanticTable:
        return (
            to_semantic_table(self.table("events"), "events")
            .with_dimensions(at=time_dimension(_.ts, "TIME_GRAIN_SECOND"), kind=_.event_type, user=_.user_id)
            .with_measures(events=_.count(), total=_.value.sum(), users=_.user_id.nunique())
        )

    @cached_property
    def embeddings(self) -> SemanticTable:
        return to_semantic_table(self.table("embeddings"), "emb").with_dimensions(label=_.label).with_measures(vectors=_.count(), components=_.embedding.count(), total=_.embedding.sum(), least=_.embedding.min())

    @cached_property
    def order_lines(self) -> SemanticTable:
        return self.orders.join_many(self.lineitem, lambda o, l: o.o_orderkey == l.l_orderkey)

    @cached_property
    def order_customers(self) -> SemanticTable:
        return self.orders.join_one(to_semantic_table(self.table("customer"), "customer").with_dimensions(segment=_.c_mktsegment), lambda o, c: o.o_custkey == c.c_custkey)


@lru_cache(maxsize=8)
def models(spark: SparkSession, sf_dir: str) -> Models:
    return Models(spark, sf_dir)


_COUNT = "CAST(COUNT(*) AS BIGINT)"


@query(f"SELECT o_orderstatus AS status, {_COUNT} AS n, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders GROUP BY 1")
def flat_group_sum_count(m):
    return m.orders.group_by("status").aggregate("n", "revenue")


@query(f"SELECT l_returnflag AS flag, l_linestatus AS linestatus, {_COUNT} AS lines, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS gross FROM lineitem GROUP BY 1, 2")
def flat_multi_key(m):
    return m.lineitem.group_by("flag", _.linestatus).aggregate("lines", "qty", "gross")


@query(f"SELECT {_COUNT} AS n, ROUND(SUM(o_totalprice), 2) AS revenue, ROUND(AVG(o_totalprice), 2) AS avg_price, COUNT(DISTINCT o_custkey) AS customers FROM orders")
def grand_total(m):
    return m.orders.aggregate("n", "revenue", "avg_price", "customers")


@query("SELECT DISTINCT o_orderpriority AS priority FROM orders")
def keys_only(m):
    return m.orders.group_by("priority").aggregate()


@query(f"SELECT o_orderstatus AS status, {_COUNT} AS n FROM orders WHERE o_totalprice > 100000 AND o_orderpriority <> '5-LOW' GROUP BY 1")
def filter_row(m):
    return m.orders.filter(lambda t: (t.o_totalprice > 100000) & (t.priority != "5-LOW")).group_by("status").aggregate("n")


@query(f"SELECT o_custkey, {_COUNT} AS n, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders GROUP BY 1 HAVING COUNT(*) >= 12")
def filter_having(m):
    return m.orders.query(["o_custkey"], ["n", "revenue"], having=[{"field": "n", "operator": ">=", "value": 12}])


@query(f"SELECT o_orderpriority AS priority, {_COUNT} AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING COUNT(*) > 10")
def filter_and_split(m):
    both = {"operator": "AND", "conditions": [{"field": "status", "operator": "=", "value": "F"}, {"field": "n", "operator": ">", "value": 10}]}
    return m.orders.query(["priority"], ["n"], filters=[both])


@query(f"SELECT o_orderstatus AS status, {_COUNT} AS n FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice < 50000 GROUP BY 1")
def filter_or(m):
    either = {"operator": "OR", "conditions": [{"field": "priority", "operator": "eq", "value": "1-URGENT"}, {"field": "o_totalprice", "operator": "<", "value": 50000}]}
    return m.orders.query(["status"], ["n"], filters=[either])


@query(f"SELECT c_mktsegment AS segment, {_COUNT} AS customers FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3) GROUP BY 1")
def filter_in(m):
    return m.customer.query(["segment"], ["customers"], filters=[{"field": "segment", "operator": "in", "values": ["BUILDING", "MACHINERY"]}, {"field": "c_nationkey", "operator": "not in", "values": [1, 2, 3]}])


@query(f"SELECT c_mktsegment AS segment, {_COUNT} AS customers FROM customer WHERE c_name LIKE '%1%' AND NOT c_mktsegment ILIKE 'build%' GROUP BY 1")
def filter_like(m):
    return m.customer.query(["segment"], ["customers"], filters=[{"field": "c_name", "operator": "like", "value": "%1%"}, {"field": "segment", "operator": "not ilike", "value": "build%"}])


@query(f"SELECT o_orderstatus AS status, {_COUNT} AS n FROM orders WHERE o_orderdate IS NOT NULL AND o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def filter_null(m):
    return m.orders.query(["status"], ["n"], filters=[{"field": "ordered", "operator": "is not null"}, {"field": "ordered", "operator": ">=", "value": "1997-01-01"}])


@query(f"SELECT o_orderstatus AS status, {_COUNT} AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def filter_text(m):
    return m.orders.filter("_.o_totalprice.between(1000, 200000) and _.status in ['F', 'O']").group_by("status").aggregate("n")


@query(f"SELECT UPPER(CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END) AS size_label, {_COUNT} AS n FROM orders GROUP BY 1")
def dim_on_dim(m):
    return m.orders.group_by("size_label").aggregate("n")


@query(f"SELECT CAST(EXTRACT(year FROM o_orderdate) AS INTEGER) AS ordered_year, CAST(EXTRACT(month FROM o_orderdate) AS INTEGER) AS ordered_month, {_COUNT} AS n FROM orders GROUP BY 1, 2")
def derived_year_month(m):
    return m.orders.group_by("ordered_year", "ordered_month").aggregate("n")


@query(f"SELECT CASE WHEN p_size <= 10 THEN 'S' WHEN p_size <= 30 THEN 'M' ELSE 'L' END AS bucket, {_COUNT} AS parts FROM part GROUP BY 1")
def bucket_case(m):
    from . import case

    return m.part.with_dimensions(bucket=lambda t: case().when(t.p_size <= 10, "S").when(t.p_size <= 30, "M").else_("L")).group_by("bucket").aggregate("parts")


for _name, _table, _measure in (("month", "orders", "n"), ("quarter", "orders", "n"), ("week", "orders", "n"), ("day", "events", "events"), ("hour", "events", "events")):
    _time = "ordered" if _table == "orders" else "at"
    _column = "o_orderdate" if _table == "orders" else "ts"

    def _grain(m, table=_table, time=_time, measure=_measure, g=_name):
        return getattr(m, table).query([time], [measure], time_grain=f"TIME_GRAIN_{g.upper()}")

    _grain.__name__ = f"grain_{_name}"
    query(f"SELECT CAST(DATE_TRUNC('{_name}', {_column}) AS TIMESTAMP) AS \"{_time}\", {_COUNT} AS {_measure} FROM {_table} GROUP BY 1")(_grain)


@query(f"""SELECT CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS "at", {_COUNT} AS events, ROUND(SUM(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13' GROUP BY 1""")
def time_range_inclusive(m):
    return m.events.query(["at"], ["events", "total"], time_grain="day", time_range={"start": "2024-01-05", "end": "2024-01-12"})


@query(
    f"""WITH a AS (SELECT event_type AS kind, {_COUNT} AS c, SUM(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1),
    b AS (SELECT event_type AS kind, {_COUNT} AS c, SUM(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1)
    SELECT coalesce(a.kind, b.kind) AS kind, a.c AS events_current, ROUND(a.v, 2) AS total_current, b.c AS events_previous, ROUND(b.v, 2) AS total_previous,
    coalesce(a.c, 0) - coalesce(b.c, 0) AS events_delta, ROUND(coalesce(a.v, 0) - coalesce(b.v, 0), 2) AS total_delta,
    ROUND((coalesce(a.c, 0) - coalesce(b.c, 0)) / NULLIF(b.c, 0), 2) AS events_pct_change, ROUND((coalesce(a.v, 0) - coalesce(b.v, 0)) / NULLIF(b.v, 0), 2) AS total_pct_change
    FROM a FULL OUTER JOIN b ON a.kind IS NOT DISTINCT FROM b.kind"""
)
def compare_periods(m):
    return m.events.compare_periods(dimensions=["kind"], measures=["events", "total"], current_time_range={"start": "2024-01-11", "end": "2024-01-20"}, previous_time_range={"start": "2024-01-01", "end": "2024-01-10"})


@query("SELECT o_orderstatus AS status, ROUND(SUM(o_totalprice) / COUNT(*), 2) AS per_order FROM orders GROUP BY 1")
def calc_ratio(m):
    return m.orders.group_by("status").aggregate("per_order")


@query("SELECT o_orderpriority AS priority, ROUND(SUM(o_totalprice), 2) AS revenue, ROUND(100 * SUM(o_totalprice) / (SELECT SUM(o_totalprice) FROM orders), 2) AS pct FROM orders GROUP BY 1")
def pct_of_total(m):
    return m.orders.group_by("priority").aggregate("revenue", pct=lambda t: 100 * t.revenue / t.all(t.revenue))


@query("SELECT o_orderpriority AS priority, ROUND(AVG(o_totalprice) - (SELECT AVG(o_totalprice) FROM orders), 2) AS over_mean FROM orders GROUP BY 1")
def pct_mean_total(m):
    return m.orders.group_by("priority").aggregate("over_mean")


@query("SELECT o_orderstatus AS status, ROUND((SUM(o_totalprice) / COUNT(*)) / (SELECT SUM(o_totalprice) / COUNT(*) FROM orders), 2) AS rel FROM orders GROUP BY 1")
def total_of_calc(m):
    return m.orders.group_by("status").aggregate(rel=lambda t: t.per_order / t.all(t.per_order))


@query("SELECT o_orderstatus AS status, ROUND(100.0 * COUNT(DISTINCT o_custkey) / (SELECT COUNT(DISTINCT o_custkey) FROM orders), 2) AS reach FROM orders GROUP BY 1")
def inline_total(m):
    return m.orders.group_by("status").aggregate(reach=lambda t: 100 * t.o_custkey.nunique() / t.all(t.o_custkey.nunique()))


@query("SELECT o_orderstatus AS status, ROUND(SUM(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent, CAST(COUNT(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS big FROM orders GROUP BY 1")
def filtered_aggregates(m):
    return m.orders.group_by("status").aggregate(urgent=_.o_totalprice.sum(where=_.o_orderpriority == "1-URGENT"), big=_.count(where=_.o_totalprice > 200000))


@query(
    "SELECT o_orderstatus AS status, ROUND(STDDEV_SAMP(o_totalprice), 2) AS sd, ROUND(VAR_POP(o_totalprice) / 1e6, 2) AS v, ROUND(QUANTILE_CONT(o_totalprice, 0.9), 2) AS p90, "
    "ROUND(MEDIAN(o_totalprice), 2) AS med, arg_max(o_orderkey, o_totalprice) AS top_order FROM orders GROUP BY 1"
)
def statistics(m):
    return m.orders.group_by("status").aggregate(
        sd=_.o_totalprice.std(), v=lambda t: t.o_totalprice.var(how="pop") / 1e6, p90=_.o_totalprice.quantile(0.9), med=_.o_totalprice.median(), top_order=_.o_orderkey.argmax(_.o_totalprice)
    )


@query(
    f"""SELECT CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS ordered, {_COUNT} AS n, CAST(SUM(COUNT(*)) OVER (ORDER BY DATE_TRUNC('month', o_orderdate)) AS BIGINT) AS running FROM orders GROUP BY 1, DATE_TRUNC('month', o_orderdate)"""
)
def window_running(m):
    return m.orders.query(["ordered"], ["n"], time_grain="month", order_by=[("ordered", "asc")]).mutate(running=_.n.cumsum())


@query(
    f"""WITH d AS (SELECT CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS "at", {_COUNT} AS events FROM events GROUP BY 1)
    SELECT "at", events, ROUND(AVG(events) OVER (ORDER BY "at" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS avg7 FROM d"""
)
def window_moving_avg(m):
    return m.events.query(["at"], ["events"], time_grain="day").mutate(avg7=lambda t: t.events.mean().over(window(order_by="at", preceding=6, following=0)))


@query(
    """WITH d AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2)
    SELECT *, CAST(RANK() OVER (PARTITION BY status ORDER BY revenue DESC) - 1 AS INTEGER) AS place FROM d"""
)
def window_rank(m):
    return m.orders.group_by("status", "priority").aggregate("revenue").mutate(place=lambda t: t.revenue.rank().over(group_by="status", order_by=t.revenue.desc()))


@query(
    f"""WITH d AS (SELECT CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS ordered, {_COUNT} AS n FROM orders GROUP BY 1)
    SELECT ordered, n, LAG(n) OVER (ORDER BY ordered) AS before, n - LAG(n) OVER (ORDER BY ordered) AS change FROM d"""
)
def window_lag(m):
    return m.orders.query(["ordered"], ["n"], time_grain="month").mutate(before=_.n.lag().over(order_by="ordered"), change=lambda t: t.n - t.n.lag().over(order_by="ordered"))


@query(f"SELECT c_mktsegment AS customer_segment, {_COUNT} AS orders_n, ROUND(SUM(o_totalprice), 2) AS orders_revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_one_dim(m):
    return m.order_customers.group_by("customer.segment").aggregate("orders.n", "orders.revenue")


@query(
    f"""SELECT r_name AS region_name, n_name AS nation_name, {_COUNT} AS orders_n FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
)
def join_three_way(m):
    joined = m.order_customers.join_one(m.nation, lambda l, n: l.c_nationkey == n.n_nationkey).join_one(m.region, lambda l, r: l.n_regionkey == r.r_regionkey)
    return joined.group_by("region.name", "nation.name").aggregate("orders.n")


@query(f"SELECT o_orderstatus AS orders_status, {_COUNT} AS orders_n FROM orders GROUP BY 1")
def join_pruned(m):
    return m.order_customers.group_by("orders.status").aggregate("n")


@query("SELECT DISTINCT n_name AS nation_name FROM nation")
def dim_only_members(m):
    return m.customer.join_one(m.nation, lambda c, n: c.c_nationkey == n.n_nationkey).group_by("nation.name").aggregate()


@query("SELECT n1.n_name AS home_name, n2.n_name AS seller_name, CAST(COUNT(*) AS BIGINT) AS lineitem_lines FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation n1 ON c_nationkey = n1.n_nationkey LEFT JOIN nation n2 ON s_nationkey = n2.n_nationkey GROUP BY 1, 2")  # fmt: skip
def role_playing_nation(m):
    bare = lambda name: to_semantic_table(m.table(name), name)
    joined = m.lineitem.join_one(bare("orders"), lambda l, o: l.l_orderkey == o.o_orderkey).join_one(bare("customer"), lambda l, c: l.o_custkey == c.c_custkey)
    joined = joined.join_one(bare("supplier"), lambda l, s: l.l_suppkey == s.s_suppkey)
    joined = joined.join_one(m.nation.view("home"), lambda l, n: l.c_nationkey == n.n_nationkey).join_one(m.nation.view("seller"), lambda l, n: l.s_nationkey == n.n_nationkey)
    return joined.group_by("home.name", "seller.name").aggregate("lines")


@query("SELECT r_name AS region_name, CAST(COUNT(*) AS BIGINT) AS part_parts FROM part CROSS JOIN region GROUP BY 1")
def join_cross_total(m):
    return m.part.join_cross(m.region).group_by("region.name").aggregate("part.parts")


@query(
    f"""WITH o AS (SELECT o_orderstatus AS s, ROUND(SUM(o_totalprice), 2) AS revenue, {_COUNT} AS n FROM orders GROUP BY 1),
    l AS (SELECT o_orderstatus AS s, ROUND(SUM(l_quantity), 2) AS qty, CAST(COUNT(l_orderkey) AS BIGINT) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT o.s AS orders_status, revenue AS orders_revenue, n AS orders_n, qty AS lineitem_qty, lines AS lineitem_lines FROM o JOIN l ON o.s = l.s"""
)
def fanout_sum(m):
    return m.order_lines.group_by("orders.status").aggregate("orders.revenue", "orders.n", "lineitem.qty", "lineitem.lines")


@query(
    """WITH p AS (SELECT DISTINCT l_returnflag AS f, o_orderkey, o_totalprice FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT f AS lineitem_flag, ROUND(AVG(o_totalprice), 2) AS orders_avg_price FROM p GROUP BY 1"""
)
def fanout_mean(m):
    return m.order_lines.group_by("lineitem.flag").aggregate("orders.avg_price")


@query(
    """SELECT o_orderpriority AS orders_priority, MIN(l_quantity) AS lineitem_min_qty, MAX(l_quantity) AS lineitem_max_qty FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def fanout_minmax(m):
    return m.order_lines.group_by("orders.priority").aggregate("lineitem.min_qty", "lineitem.max_qty")


@query(
    """SELECT l_returnflag AS lineitem_flag, COUNT(DISTINCT o_custkey) AS orders_customers, COUNT(DISTINCT l_partkey) AS lineitem_parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def fanout_distinct(m):
    return m.order_lines.group_by("lineitem.flag").aggregate("orders.customers", "lineitem.parts")


@query(
    """WITH p AS (SELECT DISTINCT l_returnflag AS f, o_orderkey, o_totalprice FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT f AS lineitem_flag, ROUND(MEDIAN(o_totalprice), 2) AS orders_median_price FROM p GROUP BY 1"""
)
def fanout_median(m):
    return m.order_lines.group_by("lineitem.flag").aggregate("orders.median_price")


@query(
    """WITH o AS (SELECT o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY 1), l AS (SELECT o_orderstatus AS s, COUNT(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT o.s AS orders_status, ROUND(lines / n, 2) AS lines_per_order FROM o JOIN l ON o.s = l.s"""
)
def fanout_ratio(m):
    return m.order_lines.with_measures(lines_per_order=lambda t: t["lineitem.lines"] / t["orders.n"]).group_by("orders.status").aggregate("lines_per_order")


@query(
    """WITH p AS (SELECT DISTINCT o_orderstatus AS s, o_orderkey, o_totalprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND o_orderpriority <> '5-LOW')
    SELECT s AS orders_status, ROUND(SUM(o_totalprice), 2) AS orders_revenue, CAST(COUNT(*) AS BIGINT) AS orders_n,
    (SELECT CAST(COUNT(*) AS BIGINT) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND o_orderpriority <> '5-LOW' AND o_orderstatus = s) AS lineitem_lines FROM p GROUP BY 1"""
)
def fanout_filter_cross(m):
    return m.order_lines.filter(lambda t: (t.flag == "A") & (t.priority != "5-LOW")).group_by("orders.status").aggregate("orders.revenue", "orders.n", "lineitem.lines")


@query(
    """WITH l AS (SELECT o_orderstatus AS s, SUM(l_quantity) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT s AS orders_status, ROUND(100 * qty / (SELECT SUM(qty) FROM l), 2) AS pct FROM l"""
)
def fanout_total(m):
    return m.order_lines.group_by("orders.status").aggregate(pct=lambda t: 100 * t.lineitem.qty / t.all(t.lineitem.qty))


@query(
    """WITH c AS (SELECT n_name, COUNT(c_custkey) AS cs FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
    s AS (SELECT n_name, COUNT(s_suppkey) AS ss, SUM(s_acctbal) AS sb FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT c.n_name AS nation_name, cs AS customer_customers, ss AS supplier_suppliers, ROUND(sb, 2) AS supplier_supplier_balance FROM c JOIN s ON c.n_name = s.n_name"""
)
def chasm_two_arms(m):
    joined = m.nation.join_many(m.customer, lambda n, c: n.n_nationkey == c.c_nationkey).join_many(m.supplier, lambda n, s: n.n_nationkey == s.s_nationkey)
    return joined.group_by("nation.name").aggregate("customer.customers", "supplier.suppliers", "supplier.supplier_balance")


@query("SELECT n_name AS nation_name, ROUND(SUM(l_quantity), 2) AS lineitem_qty, COUNT(DISTINCT o_orderkey) AS orders_n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def deep_chain(m):
    joined = m.nation.join_many(m.customer, lambda n, c: n.n_nationkey == c.c_nationkey).join_many(m.orders, lambda c, o: c.c_custkey == o.o_custkey).join_many(m.lineitem, lambda o, l: o.o_orderkey == l.l_orderkey)
    return joined.group_by("nation.name").aggregate("lineitem.qty", "orders.n")


@query(f"SELECT p_brand AS part_brand, {_COUNT} AS lineitem_lines, ROUND(SUM(l_quantity), 2) AS lineitem_qty FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def deferred_dim_join(m):
    return m.lineitem.join_one(m.part, lambda l, p: l.l_partkey == p.p_partkey).group_by("part.brand").aggregate("lineitem.lines", "lineitem.qty")


@query(
    """WITH c AS (SELECT c_mktsegment AS s, COUNT(*) AS n FROM customer GROUP BY 1), o AS (SELECT c_mktsegment AS s, SUM(o_totalprice) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT c.s AS customer_segment, n AS customer_customers, ROUND(r, 2) AS orders_revenue FROM c JOIN o ON c.s = o.s"""
)
def grain_autoupgrade(m):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        joined = m.customer.join_one(m.orders, lambda c, o: c.c_custkey == o.o_custkey)
    return joined.group_by("customer.segment").aggregate("customer.customers", "orders.revenue")


@query(
    "SELECT label, CAST(COUNT(*) AS BIGINT) AS vectors, CAST(SUM(len(embedding)) AS BIGINT) AS components, ROUND(SUM(list_sum([CAST(x AS DOUBLE) FOR x IN embedding])), 2) AS total FROM embeddings GROUP BY 1"
)
def nested_array_stats(m):
    return m.embeddings.group_by("label").aggregate("vectors", "components", "total")


@query("SELECT label, CAST(COUNT(*) AS BIGINT) AS positive FROM (SELECT label, unnest(embedding) AS e FROM embeddings) WHERE e > 0 GROUP BY 1")
def unnest_array(m):
    return m.embeddings.unnest("embedding").filter(lambda t: t.embedding > 0).group_by("label").aggregate(positive=_.count())


@query(
    """WITH d AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, SUM(o_totalprice) AS revenue FROM orders GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY status ORDER BY revenue DESC) AS k FROM d)
    SELECT r.status, t.n, priority, ROUND(revenue, 2) AS revenue FROM r JOIN (SELECT o_orderstatus AS status, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY 1) t ON r.status = t.status WHERE k <= 2"""
)
def nest_topn(m):
    out = m.orders.group_by("status").aggregate("n", nest={"top": lambda t: t.group_by("priority").aggregate("revenue").order_by(_.revenue.desc()).limit(2)})
    return out.to_spark().select("status", "n", F.explode("top").alias("x")).select("status", "n", "x.priority", "x.revenue")


@query(
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN FLOOR(EPOCH(ts)) - FLOOR(EPOCH(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) <= 86400 THEN 0 ELSE 1 END AS fresh, event_id FROM events),
    s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, CAST(COUNT(*) AS BIGINT) AS events, ROUND(SUM(value), 2) AS total FROM s GROUP BY 1, 2"""
)
def sessionize_events(m):
    rows = m.events.group_by("user_id", "ts", "event_id").aggregate(value=_.value.sum())
    w = dict(group_by="user_id", order_by=["ts", "event_id"])
    gaps = rows.mutate(before=_.ts.lag().over(**w))
    fresh = gaps.mutate(fresh=lambda t: ifelse(t.before.isnull() | (t.ts.epoch_seconds() - t.before.epoch_seconds() > 86400), 1, 0))
    numbered = fresh.mutate(session=_.fresh.sum().over(**w, rows=(None, 0)))
    return numbered.group_by("user_id", "session").aggregate(events=_.count(), total=_.value.sum())


@query(
    """SELECT 'brand' AS fieldName, 'brand' AS fieldPath, 'string' AS fieldType, p_brand AS fieldValue, CAST(COUNT(*) AS BIGINT) AS weight FROM part GROUP BY p_brand
    UNION ALL SELECT 'psize', 'psize', 'number', MIN(p_size) || ' to ' || MAX(p_size), CAST(COUNT(*) AS BIGINT) FROM part"""
)
def index_fields(m):
    return m.part.index(["brand", "psize"])


@query("SELECT c_mktsegment AS value, CAST(COUNT(*) AS BIGINT) AS count FROM customer WHERE lower(c_mktsegment) LIKE '%ing%' GROUP BY 1")
def search_values(m):
    from .operators.search import plain as bare
    from .operators.search import value_counts

    return value_counts(m.customer, "segment").filter(F.contains(bare(F.col("value")), F.lit("ing")))


@query("SELECT MIN(ts) AS start, MAX(ts) AS \"end\" FROM events")
def model_time_range(m):
    return m.events.aggregate(start=_.ts.min(), end=_.ts.max())


@query("SELECT o_orderkey, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders GROUP BY 1 ORDER BY SUM(o_totalprice) DESC, 1 LIMIT 10 OFFSET 5")
def topk_offset(m):
    return m.orders.group_by("o_orderkey").aggregate("revenue").order_by(_.revenue.desc(), "o_orderkey").limit(10, offset=5)


@query("SELECT k, CAST(COUNT(*) AS BIGINT) AS customers, CAST(SUM(k) AS BIGINT) AS orders FROM (SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS k FROM orders GROUP BY 1) GROUP BY 1")
def reaggregate(m):
    return m.orders.group_by("o_custkey").aggregate(k=_.count()).group_by("k").aggregate(customers=_.count(), orders=_.k.sum())


@query(
    """WITH d AS (SELECT o_orderpriority AS p, SUM(o_totalprice) AS r FROM orders GROUP BY 1), t AS (SELECT *, ROW_NUMBER() OVER (ORDER BY r DESC) AS k FROM d)
    SELECT CASE WHEN k <= 2 THEN p ELSE 'OTHER' END AS bucket, ROUND(SUM(r), 2) AS revenue FROM t GROUP BY 1"""
)
def bucketing_with_other(m):
    ranked = m.orders.group_by("priority").aggregate("revenue").mutate(k=_.revenue.row_number().over(order_by=_.revenue.desc()))
    return ranked.mutate(bucket=lambda t: ifelse(t.k < 2, t.priority, "OTHER")).group_by("bucket").aggregate(revenue=_.revenue.sum())


@query(
    f"""SELECT l_returnflag AS flag, {_COUNT} AS lines, ROUND(SUM(l_extendedprice * (1 - l_discount)) / SUM(l_quantity), 2) AS gross_per_unit FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1"""
)
def yaml_model(m):
    from .sources.yaml_models import from_config

    config = {
        "sales": {
            "table": "lines",
            "dimensions": {"flag": "_.l_returnflag", "shipped": {"expr": "_.l_shipdate", "is_time_dimension": True, "smallest_time_grain": "day"}},
            "measures": {"lines": "_.count()", "gross": "(_.l_extendedprice * (1 - _.l_discount)).sum()", "qty": "_.l_quantity.sum()"},
            "calculated_measures": {"gross_per_unit": "_.gross / _.qty"},
            "filter": "_.l_shipdate <= '1998-09-02'",
        }
    }
    return from_config(config, {"lines": m.table("lineitem")}, spark=m.spark)["sales"].group_by("flag").aggregate("lines", "gross_per_unit")


@query(
    "SELECT c_custkey, INITCAP_ AS cap, pos, rep FROM (SELECT c_custkey, UPPER(SUBSTR(c_mktsegment, 1, 1)) || LOWER(SUBSTR(c_mktsegment, 2)) AS INITCAP_, CAST(INSTR(c_name, '0') - 1 AS INTEGER) AS pos, REPLACE(c_name, 'Customer', 'C') AS rep FROM customer)"
)
def scalar_strings(m):
    dims = dict(cap=_.c_mktsegment.capitalize(), pos=_.c_name.find("0"), rep=_.c_name.replace("Customer", "C"))
    return m.customer.with_dimensions(**dims).group_by("c_custkey", *dims).aggregate()


@query(
    f"""SELECT CAST(EXTRACT(quarter FROM o_orderdate) AS INTEGER) AS q, CAST(EXTRACT(isodow FROM o_orderdate) - 1 AS INTEGER) AS dow, CAST(EXTRACT(week FROM o_orderdate) AS INTEGER) AS wk, STRFTIME(o_orderdate, '%Y-%m') AS ym,
    STRFTIME(o_orderdate, '%d') AS day, {_COUNT} AS n FROM orders GROUP BY 1, 2, 3, 4, 5"""
)
def scalar_dates(m):
    dims = dict(q=_.o_orderdate.quarter(), dow=_.o_orderdate.day_of_week(), wk=_.o_orderdate.week_of_year(), ym=_.o_orderdate.strftime("%Y-%m"), day=_.o_orderdate.date().strftime("%d"))
    return m.orders.with_dimensions(**dims).group_by(*dims).aggregate("n")


@query(
    "SELECT p_partkey, ROUND(p_size / NULLIF(p_size - 25, 0), 2) AS ratio, CAST(FLOOR(p_retailprice / 100) AS BIGINT) AS hundreds, p_size % 7 AS rest, CAST(ROUND(SQRT(p_size), 2) AS DOUBLE) AS root, "
    "GREATEST(p_size, 20) AS most, LEAST(p_size, 20) AS least, p_size BETWEEN 5 AND 15 AS mid FROM part"
)
def scalar_math(m):
    dims = dict(ratio=_.p_size / (_.p_size - 25), hundreds=_.p_retailprice // 100, rest=_.p_size % 7, root=_.p_size.sqrt().round(2), most=_.p_size.greatest(20), least=_.p_size.least(20), mid=_.p_size.between(5, 15))
    return m.part.with_dimensions(**dims).group_by("p_partkey", *dims).aggregate()


@query("SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, regexp_replace(c_name, '0+', '0', 'g') AS short, regexp_matches(c_mktsegment, '^[A-H]') AS early, right(c_name, 3) AS tail, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS code FROM customer")
def scalar_regex(m):
    dims = dict(digits=_.c_name.re_extract("([0-9]+)$", 1), short=_.c_name.re_replace("0+", "0"), early=_.c_mktsegment.re_search("^[A-H]"), tail=_.c_name.right(3), code=_.c_nationkey.cast("string").lpad(4, "0"))
    return m.customer.with_dimensions(**dims).group_by("c_custkey", *dims).aggregate()


@query("SELECT l_returnflag AS flag, bool_or(l_quantity > 49) AS some, bool_and(l_quantity > 0) AS every, MODE(l_linestatus) AS usual, arg_min(l_orderkey, l_extendedprice) AS cheapest, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS states FROM lineitem GROUP BY 1")
def other_reductions(m):
    return m.lineitem.group_by("flag").aggregate(
        some=(_.l_quantity > 49).any(), every=(_.l_quantity > 0).all(), usual=_.l_linestatus.mode(), cheapest=_.l_orderkey.argmin(_.l_extendedprice), states=_.l_linestatus.collect()
    ).to_spark().withColumn("states", F.array_join(F.array_sort(F.array_distinct("states")), ","))


@query(
    """WITH a AS (SELECT l_suppkey, l_returnflag, CAST(COUNT(*) AS BIGINT) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
    SELECT a.l_suppkey, a.l_returnflag, a.n AS lines, ROUND(a.q, 2) AS qty, ROUND(a.q / b.q, 2) AS part FROM a JOIN (SELECT l_suppkey, SUM(q) AS q FROM a GROUP BY 1) b ON a.l_suppkey = b.l_suppkey"""
)
def share_within_parent(m):
    return m.lineitem.group_by("l_suppkey", "l_returnflag").aggregate("lines", "qty", part=lambda t: t.qty / t.l_quantity.sum().over(window(group_by=t.l_suppkey)))


@query(
    f"""SELECT o_orderpriority AS priority, {_COUNT} AS n, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled, ROUND(100.0 * SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / COUNT(*), 2) AS pct FROM orders GROUP BY 1"""
)
def conditional_share(m):
    return m.orders.group_by("priority").aggregate("n", filled=ifelse(_.status == "F", 1, 0).sum(), pct=lambda t: 100 * ifelse(t.status == "F", 1, 0).sum() / t.n)


@query("SELECT o_orderstatus AS status, ROUND(PERCENT_RANK() OVER (ORDER BY revenue), 2) AS pr, ROUND(CUME_DIST() OVER (ORDER BY revenue), 2) AS cd, CAST(NTILE(2) OVER (ORDER BY revenue) - 1 AS INTEGER) AS half FROM (SELECT o_orderstatus, SUM(o_totalprice) AS revenue FROM orders GROUP BY 1)")
def window_distribution(m):
    from . import cume_dist, ntile, percent_rank

    out = m.orders.group_by("status").aggregate("revenue").mutate(pr=percent_rank().over(order_by="revenue"), cd=cume_dist().over(order_by="revenue"), half=ntile(2).over(order_by="revenue"))
    return out.to_spark().select("status", "pr", "cd", "half")


_PAIRS = "WITH p AS (SELECT DISTINCT c_mktsegment AS g, s_suppkey, s_acctbal, s_nationkey FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey)"


@query(f"{_PAIRS} SELECT g AS customer_segment, {_COUNT} AS supplier_n, ROUND(SUM(s_acctbal), 2) AS supplier_total, ROUND(AVG(s_acctbal), 2) AS supplier_mean, ROUND(MEDIAN(s_acctbal), 2) AS supplier_mid, COUNT(DISTINCT s_nationkey) AS supplier_nations FROM p GROUP BY 1")
def fanout_repeated_entity(m):
    """The source's entity repeats: it is no row identity."""
    supplier = to_semantic_table(m.table("supplier"), "supplier").with_dimensions(nation=entity_dimension(_.s_nationkey))
    supplier = supplier.with_measures(n=_.count(), total=_.s_acctbal.sum(), mean=_.s_acctbal.mean(), mid=_.s_acctbal.median(), nations=_.s_nationkey.nunique())
    return supplier.join_many(m.customer, lambda s, c: s.s_nationkey == c.c_nationkey).group_by("customer.segment").aggregate("supplier.n", "total", "mean", "mid", "nations")


@query("""SELECT c_mktsegment AS customer_segment, CAST(COUNT(s_suppkey) AS BIGINT) AS supplier_suppliers, ROUND(SUM(s_acctbal), 2) AS supplier_supplier_balance FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) LEFT JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1""")
def fanout_repeated_parent(m):
    """The parent's entity repeats: a child meets many parents and counts once a group."""
    customer = to_semantic_table(m.table("customer"), "customer").with_dimensions(nation=entity_dimension(_.c_nationkey), segment=_.c_mktsegment)
    return customer.join_many(m.supplier, lambda c, s: c.c_nationkey == s.s_nationkey).group_by("customer.segment").aggregate("supplier.suppliers", "supplier.supplier_balance")


@query("SELECT r_name AS region_name, CAST(COUNT(n_nationkey) AS BIGINT) AS nation_n FROM region LEFT JOIN nation ON r_regionkey <= n_regionkey GROUP BY 1")
def join_by_inequality(m):
    nation = to_semantic_table(m.table("nation"), "nation").with_measures(n=_.count())
    return m.region.join_many(nation, lambda r, n: r.r_regionkey <= n.n_regionkey).group_by("region.name").aggregate("nation.n")


@query("""WITH p AS (SELECT DISTINCT o_orderkey, o_totalprice, upper(o_orderstatus) || l_returnflag AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) SELECT k AS both, ROUND(SUM(o_totalprice), 2) AS orders_revenue, CAST(COUNT(*) AS BIGINT) AS orders_n FROM p GROUP BY 1""")
def joined_key_of_two_models(m):
    return m.order_lines.with_dimensions(both=lambda t: t.status.upper().concat(t.flag)).group_by("both").aggregate("orders.revenue", "orders.n")


@query("""WITH p AS (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_extendedprice * 2 > o_totalprice) SELECT o_orderstatus AS orders_status, CAST(COUNT(*) AS BIGINT) AS orders_n FROM p GROUP BY 1""")
def filter_across_models(m):
    return m.order_lines.filter(lambda t: t.l_extendedprice * 2 > t.o_totalprice).group_by("orders.status").aggregate("orders.n")


@query("""SELECT r_name AS region_name, CAST(COUNT(embedding) AS BIGINT) AS emb_vectors, CAST(SUM(len(embedding)) AS BIGINT) AS emb_components, ROUND(SUM(list_sum([CAST(x AS DOUBLE) FOR x IN embedding])), 2) AS emb_total FROM region LEFT JOIN embeddings ON label = r_regionkey GROUP BY 1""")
def nested_over_join(m):
    return m.region.join_many(m.embeddings, lambda r, e: r.r_regionkey == e.label).group_by("region.name").aggregate("emb.vectors", "emb.components", "emb.total")


@query("SELECT p_partkey, p_size * 2 AS twice, CAST(p_size * 2 + 1 AS BIGINT) AS more FROM part WHERE p_size > 10")
def mutate_export(m):
    return m.part.filter(_.p_size > 10).mutate(twice=_.p_size * 2).mutate(more=(_.twice + 1).cast("int64")).to_spark().select("p_partkey", "twice", "more")


@query(f"SELECT p_size % 5 AS rest, {_COUNT} AS parts FROM part GROUP BY 1")
def mutate_then_group(m):
    return m.part.mutate(rest=_.p_size % 5).group_by("rest").aggregate("parts")


@query(f"SELECT o_orderstatus AS orders_status, {_COUNT} AS orders_n FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
def filter_after_group_by(m):
    return m.order_lines.group_by("orders.status").filter(lambda t: t.o_totalprice > 200000).aggregate("orders.n")


@query("""WITH d AS (SELECT o_orderpriority AS priority, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders GROUP BY 1)
    SELECT *, FIRST_VALUE(revenue) OVER w AS first_one, LAST_VALUE(revenue) OVER (ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_one FROM d WINDOW w AS (ORDER BY priority)""")
def window_first_last(m):
    whole = dict(order_by="priority", rows=(None, None))
    return m.orders.group_by("priority").aggregate("revenue").mutate(first_one=_.revenue.first().over(**whole), last_one=_.revenue.last().over(**whole))


@query(f"""WITH d AS (SELECT CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS ordered, {_COUNT} AS n FROM orders GROUP BY 1)
    SELECT *, ROUND(AVG(n) OVER w, 2) AS mean, MIN(n) OVER w AS low, MAX(n) OVER w AS high FROM d WINDOW w AS (ORDER BY ordered)""")
def window_cumulative(m):
    w = window(order_by="ordered")
    return m.orders.query(["ordered"], ["n"], time_grain="month").mutate(mean=_.n.cummean().over(w), low=_.n.cummin().over(w), high=_.n.cummax().over(w))


@query("""WITH d AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1, 2)
    SELECT d.*, k FROM d JOIN (SELECT status, CAST(COUNT(DISTINCT customers) AS BIGINT) AS k FROM d GROUP BY 1) s ON d.status = s.status""")
def window_distinct(m):
    return m.orders.group_by("status", "priority").aggregate("customers").mutate(k=_.customers.nunique().over(group_by="status")).to_spark().withColumn("k", F.col("k").cast("long"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS words, CAST(FLOOR(p_retailprice) AS BIGINT) AS whole, TRY_CAST(p_brand AS INTEGER) AS none, lower(typeof(p_retailprice)) AS kind FROM part")
def scalar_casts(m):
    dims = dict(words=_.p_size.cast("string"), whole=_.p_retailprice.floor().cast("int64"), none=_.p_brand.try_cast("int32"), kind=_.p_retailprice.typeof())
    return m.part.with_dimensions(**dims).group_by("p_partkey", *dims).aggregate()


@query("SELECT p_partkey, NULLIF(p_size, 10) AS a, COALESCE(NULLIF(p_size, 10), -1) AS b, NULLIF(p_size, 10) IS NULL AS c, NULLIF(p_size, 10) IS NOT DISTINCT FROM NULL AS d, COALESCE(NULL, p_size) AS e FROM part")
def scalar_nulls(m):
    from . import coalesce, literal

    gone = _.p_size.nullif(10)
    dims = dict(a=gone, b=gone.fill_null(-1), c=gone.isnull(), d=gone.identical_to(None), e=coalesce(literal(None), _.p_size))
    return m.part.with_dimensions(**dims).group_by("p_partkey", *dims).aggregate()


@query(f"SELECT CAST(HOUR(ts) AS INTEGER) AS h, dayname(ts) AS weekday, CAST(ISODOW(ts) - 1 AS INTEGER) AS nth, CAST(DAYOFYEAR(ts) AS INTEGER) AS yday, {_COUNT} AS events FROM events GROUP BY 1, 2, 3, 4")
def scalar_times(m):
    dims = dict(h=_.ts.hour(), weekday=_.ts.day_of_week.full_name(), nth=_.ts.day_of_week.index(), yday=_.ts.day_of_year())
    return m.events.with_dimensions(**dims).group_by(*dims).aggregate("events")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size, embedding[1] > 0 AS head, CAST(len(list_distinct(embedding)) AS INTEGER) AS different FROM embeddings")
def scalar_arrays(m):
    dims = dict(size=_.embedding.array_length(), head=_.embedding[0] > 0, different=_.embedding.unique().array_length())
    return m.embeddings.with_dimensions(**dims).group_by("vec_id", *dims).aggregate()


@query(f"SELECT o_orderstatus AS status, {_COUNT} AS n, 7 AS seven, ROUND(SUM(o_totalprice) / 7, 2) AS part FROM orders GROUP BY 1")
def constant_measure(m):
    from . import literal

    return m.orders.with_measures(seven=literal(7), part=lambda t: t.revenue / 7).group_by("status").aggregate("n", "seven", "part")


@query("SELECT o_orderstatus AS status, ROUND(100 * SUM(o_totalprice) / (SELECT SUM(o_totalprice) FROM orders), 2) AS pct FROM orders GROUP BY 1")
def total_of_a_column(m):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return m.orders.group_by("status").aggregate(pct=lambda t: 100 * t.o_totalprice.sum() / t.all("o_totalprice"))


@query(f"SELECT o_orderpriority AS priority, {_COUNT} AS n FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000) GROUP BY 1 HAVING COUNT(*) > 5")
def filter_not(m):
    return m.orders.filter(~((_.status == "F") | (_.o_totalprice < 50000))).group_by("priority").aggregate("n").filter(_.n > 5)


@query(f"SELECT c_mktsegment AS customer_segment, {_COUNT} AS orders_n, ROUND(SUM(o_totalprice), 2) AS orders_revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1")
def serialized_join(m):
    from .expr import serialize

    data = serialize.model_to_data(m.order_customers.filter(_.o_totalprice > 1000))
    again = serialize.model_from_data(data, {"orders": m.table("orders"), "customer": m.table("customer")})
    return again.group_by("customer.segment").aggregate("orders.n", "orders.revenue")


@query("SELECT CAST(COUNT(*) AS BIGINT) AS groups, ROUND(MAX(revenue), 2) AS best FROM (SELECT o_custkey, SUM(o_totalprice) AS revenue FROM orders GROUP BY 1)")
def result_as_table(m):
    return m.orders.group_by("o_custkey").aggregate("revenue").as_table().with_measures(groups=_.count(), best=_.revenue.max()).pipe(lambda t: t.aggregate("groups", "best"))


@query(f"SELECT o_orderstatus AS orders_status, c_mktsegment AS customer_segment, {_COUNT} AS orders_n, ROUND(SUM(o_totalprice) / COUNT(*), 2) AS per_one FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def text_expressions_over_join(m):
    from . import parse

    return m.order_customers.with_measures(per_one=parse("_['orders.revenue'] / _['orders.n']")).group_by("orders.status", "customer.segment").aggregate("orders.n", "per_one")


@query("SELECT 'segment' AS fieldName, 'customer.segment' AS fieldPath, 'string' AS fieldType, c_mktsegment AS fieldValue, CAST(COUNT(*) AS BIGINT) AS weight FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment UNION ALL SELECT 'status', 'orders.status', 'string', o_orderstatus, CAST(COUNT(*) AS BIGINT) FROM orders GROUP BY o_orderstatus")
def index_over_join(m):
    return m.order_customers.index(["customer.segment", "orders.status"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
