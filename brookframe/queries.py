"""The registered queries over the driver tables, one or more for each operator family, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import MANY_TO_MANY, MANY_TO_ONE, ONE_TO_MANY, Contract, Model, Relation, Variant
from .functions import geo, text, vector
from .functions.document import acc, fn
from .operators import mutate
from .plans.collection import Database
from .plans.pipeline import Pipeline
from .plans.select import Select
from .sources.tables import parquet
from .streaming.events import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Driver tables by name, as DataFrames and as selects."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return parquet(self.spark, self.folder, name)

    def sql(self, name: str, alias: str | None = None) -> Select:
        return Select.table(self[name], alias or name)

    def docs(self, name: str) -> Pipeline:
        return Pipeline(self[name])


def query(sql: str | None = None):
    """Register a function of Tables, with its SQL."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


CONTRACT = Contract(
    (
        Model("Customer", "customer", ("c_custkey",), {"orders": Relation("Order", ONE_TO_MANY, (("c_custkey", "o_custkey"),)), "nation": Relation("Nation", MANY_TO_ONE, (("c_nationkey", "n_nationkey"),))}),
        Model("Order", "orders", ("o_orderkey",), {"lines": Relation("Line", ONE_TO_MANY, (("o_orderkey", "l_orderkey"),)), "customer": Relation("Customer", MANY_TO_ONE, (("o_custkey", "c_custkey"),))}),
        Model("Line", "lineitem", ("l_orderkey", "l_linenumber"), {"order": Relation("Order", MANY_TO_ONE, (("l_orderkey", "o_orderkey"),))}),
        Model("Nation", "nation", ("n_nationkey",), {"region": Relation("Region", MANY_TO_ONE, (("n_regionkey", "r_regionkey"),))}),
        Model("Region", "region", ("r_regionkey",), {"nations": Relation("Nation", ONE_TO_MANY, (("r_regionkey", "n_regionkey"),))}),
        Model("Part", "part", ("p_partkey",), {"suppliers": Relation("Supplier", MANY_TO_MANY, (("p_partkey", "l_partkey"),), "part_supplier", (("l_suppkey", "s_suppkey"),))}),
        Model("Supplier", "supplier", ("s_suppkey",)),
        Model("Event", "events", ("event_id",), discriminator="event_type", variants=(Variant("Purchase", "purchase"), Variant("Click", "click"), Variant("Error", "error"))),
    )
)


def database(t: Tables) -> Database:
    names = ["customer", "orders", "lineitem", "nation", "region", "part", "supplier", "events"]
    tables = {n: t[n] for n in names}
    tables["part_supplier"] = tables["lineitem"].select("l_partkey", "l_suppkey").distinct()
    return Database(t.spark, CONTRACT, tables)


# relational builder


@query("""SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 3 DESC""")
def sql_join_group(t: Tables) -> DataFrame:
    joined = t.sql("customer", "c").inner_join(t.sql("orders", "o"), lambda f, fn: fn.eq(f.c.c_custkey, f.o.o_custkey))
    q = joined.where(lambda f, fn: fn.eq(f.o_orderstatus, "F")).select("segment", lambda f: f.c_mktsegment).select(lambda f, fn: {"orders": fn.count(), "total": F.round(fn.sum(f.o_totalprice), 2)})
    return q.group_by("segment").order_by("total", "desc").build()


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2""")
def sql_pricing_summary(t: Tables) -> DataFrame:
    q = t.sql("lineitem", "l").where(lambda f, fn: fn.lte(f.l_shipdate, F.lit("1998-09-02").cast("timestamp"))).select("l_returnflag", "l_linestatus")
    q = q.select(lambda f, fn: {"sum_qty": F.round(fn.sum(f.l_quantity), 2), "revenue": F.round(fn.sum(f.l_extendedprice * (1 - f.l_discount)), 2), "avg_disc": F.round(fn.avg(f.l_discount), 6), "n": fn.count()})
    return q.group_by("l_returnflag", "l_linestatus").order_by("l_returnflag").order_by("l_linestatus").build()


@query("""SELECT n_name, r_name, count(c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def sql_left_joins(t: Tables) -> DataFrame:
    q = t.sql("region").outer_left_join(t.sql("nation"), lambda f, fn: fn.eq(f.n_regionkey, f.r_regionkey)).outer_left_join(t.sql("customer"), lambda f, fn: fn.eq(f.c_nationkey, f.n_nationkey))
    return q.select("n_name", "r_name").select("customers", lambda f, fn: fn.count(f.c_custkey)).group_by("n_name", "r_name").build()


@query("""SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000""")
def sql_right_join(t: Tables) -> DataFrame:
    return t.sql("orders").outer_right_join(t.sql("customer"), lambda f, fn: fn.and_(fn.eq(f.o_custkey, f.c_custkey), fn.gt(f.o_totalprice, 100000))).select("c_custkey", "o_orderkey").build()


@query("""SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey""")
def sql_full_join(t: Tables) -> DataFrame:
    return t.sql("supplier").outer_full_join(t.sql("customer"), lambda f, fn: fn.and_(fn.eq(f.s_suppkey, f.c_custkey), fn.eq(f.s_nationkey, f.c_nationkey))).select("s_suppkey", "c_custkey").build()


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def sql_self_theta_join(t: Tables) -> DataFrame:
    q = t.sql("nation", "a").inner_join(t.sql("nation", "b"), lambda f, fn: fn.and_(fn.eq(f.a.n_regionkey, f.b.n_regionkey), fn.lt(f.a.n_nationkey, f.b.n_nationkey)))
    return q.select(lambda f, fn: {"a": f.a.n_name, "b": f.b.n_name}).build()


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t""")
def sql_lateral_top(t: Tables) -> DataFrame:
    inner = lambda o: t.sql("orders").where(lambda f, fn: fn.eq(f.o_custkey, o.c_custkey)).select("o_orderkey", "o_totalprice").order_by("o_totalprice", "desc").order_by("o_orderkey").limit(2)
    return t.sql("customer").lateral_join("t", inner).select("c_custkey", "o_orderkey", "o_totalprice").build()


@query("""SELECT c_custkey, n FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') t ON true""")
def sql_outer_lateral(t: Tables) -> DataFrame:
    inner = lambda o: t.sql("orders").where(lambda f, fn: fn.and_(fn.eq(f.o_custkey, o.c_custkey), fn.eq(f.o_orderpriority, "1-URGENT"))).select("n", lambda f, fn: fn.count())
    return t.sql("customer").outer_lateral_join("t", inner).select("c_custkey", "n").build()


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.0)""")
def sql_in_subqueries(t: Tables) -> DataFrame:
    big = t.sql("lineitem").where(lambda f, fn: fn.gte(f.l_quantity, 50)).select("l_partkey")
    full = t.sql("lineitem").where(lambda f, fn: fn.eq(f.l_discount, 0.0)).select("l_partkey")
    return t.sql("part").where(lambda f, fn: fn.in_(f.p_partkey, big)).where(lambda f, fn: fn.not_in(f.p_partkey, full)).select("p_partkey", "p_name").build()


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def sql_exists(t: Tables) -> DataFrame:
    def having(status: str):
        return lambda f: t.sql("orders").where(lambda o, fn: fn.and_(fn.eq(o.o_custkey, f.c_custkey.outer()), fn.eq(o.o_orderstatus, status)))

    return t.sql("customer").where(lambda f, fn: fn.exists(having("O")(f))).where(lambda f, fn: fn.not_exists(having("F")(f))).select("c_custkey").build()


@query("""SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer""")
def sql_scalar_subquery(t: Tables) -> DataFrame:
    best = lambda f, fn: fn.scalar(t.sql("orders").where(lambda o, g: g.eq(o.o_custkey, f.c_custkey.outer())).select("m", lambda o, g: g.max(o.o_totalprice)))
    return t.sql("customer").select("c_custkey").select("best", best).build()


@query("""SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 12 ORDER BY n DESC, o_custkey""")
def sql_having(t: Tables) -> DataFrame:
    q = t.sql("orders").select("o_custkey").select(lambda f, fn: {"n": fn.count(), "top": fn.max(f.o_totalprice)}).group_by("o_custkey")
    return q.having(lambda f, fn: fn.gt(fn.count(), 12)).order_by("n", "desc").order_by("o_custkey").build()


@query("""SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey""")
def sql_distinct_on(t: Tables) -> DataFrame:
    return t.sql("orders").distinct_on("o_custkey").order_by("o_custkey").order_by("o_totalprice", "desc").order_by("o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice").build()


@query("""SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""")
def sql_distinct(t: Tables) -> DataFrame:
    return t.sql("orders").select("o_orderstatus", "o_orderpriority").distinct().build()


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20 OFFSET 10""")
def sql_paging(t: Tables) -> DataFrame:
    return t.sql("customer").select("c_custkey", "c_acctbal").order_by("c_acctbal", "desc").order_by("c_custkey").offset(10).limit(20).build()


@query("""SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind, upper(substring(p_brand, 1, 7)) AS brand, CAST(floor(p_retailprice) AS BIGINT) AS price, p_name
FROM part WHERE (p_name LIKE '%e%' OR p_type ILIKE '%StEeL%' OR p_brand ILIKE 'brand#1%') AND p_size IS NOT NULL""")
def sql_expressions(t: Tables) -> DataFrame:
    q = t.sql("part").where(lambda f, fn: fn.or_(fn.like(f.p_name, "%e%"), fn.ilike(f.p_type, "%StEeL%"), fn.ilike(f.p_brand, "brand#1%"))).where(lambda f, fn: fn.ne(f.p_size, None))
    return q.select(
        lambda f, fn: {
            "kind": fn.case((fn.lt(f.p_size, 10), "small"), (fn.lt(f.p_size, 30), "medium"), else_="large"),
            "brand": fn.call("upper", fn.call("substring", f.p_brand, 1, 7)),
            "price": fn.cast(F.floor(f.p_retailprice), "bigint"),
            "p_name": f.p_name,
        }
    ).build()


@query("""SELECT s.seg, round(avg(s.total), 2) AS mean FROM (SELECT c_mktsegment AS seg, c_custkey, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) s GROUP BY 1""")
def sql_derived_table(t: Tables) -> DataFrame:
    inner = t.sql("customer").inner_join(t.sql("orders"), lambda f, fn: fn.eq(f.o_custkey, f.c_custkey)).select("seg", lambda f: f.c_mktsegment).select("c_custkey").select("total", lambda f, fn: fn.sum(f.o_totalprice)).group_by("seg", "c_custkey")
    return inner.as_("s").select("seg").select("mean", lambda f, fn: F.round(fn.avg(f.total), 2)).group_by("seg").build()


@query("""SELECT 1 + 1 AS two, 'x' AS x""")
def sql_no_from(t: Tables) -> DataFrame:
    return Select.nothing(t.spark).select(two=lambda f: F.lit(1) + 1, x=lambda f: F.lit("x")).build()


# model collections


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey), '') AS keys
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def orm_include_many(t: Tables) -> DataFrame:
    rows = database(t).collection("Customer").select("c_custkey").include("orders", lambda o: o.order_by("o_orderdate").order_by("o_orderkey")).all()
    total = F.round(F.aggregate("orders", F.lit(0.0), lambda a, o: a + o["o_totalprice"]), 2)
    return rows.select("c_custkey", F.array_size("orders").cast("long").alias("n"), total.alias("total"), F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("keys"))


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def orm_include_one_nested(t: Tables) -> DataFrame:
    rows = database(t).collection("Order").select("o_orderkey").include("customer", lambda c: c.include("nation", lambda n: n.include("region"))).all()
    return rows.select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.col("customer.nation.n_name").alias("n_name"), F.col("customer.nation.region.r_name").alias("r_name"))


@query("""SELECT c_custkey, string_agg(k, ',' ORDER BY rn) AS top FROM (SELECT c_custkey, o_orderkey || ':' || (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS k, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn <= 3 GROUP BY 1""")
def orm_include_refined(t: Tables) -> DataFrame:
    rows = database(t).collection("Customer").select("c_custkey").include("orders", lambda o: o.order_by("o_totalprice", "desc").order_by("o_orderkey").take(3).select("o_orderkey").include("lines", lambda x: x.count())).all()
    listed = F.array_join(F.transform("orders", lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit(":"), o["lines"].cast("string"))), ",")
    return rows.where(F.array_size("orders") > 0).select("c_custkey", listed.alias("top"))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS best FROM customer""")
def orm_include_combine(t: Tables) -> DataFrame:
    rows = database(t).collection("Customer").select("c_custkey").include("orders", lambda o: o.combine(n=o.count(), best=o.where({"o_orderstatus": "F"}).max("o_totalprice"))).all()
    return rows.select("c_custkey", "orders.n", "orders.best")


@query("""SELECT p_partkey, count(s_suppkey) AS n, coalesce(string_agg(s_suppkey, ',' ORDER BY s_suppkey), '') AS keys FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def orm_include_many_to_many(t: Tables) -> DataFrame:
    rows = database(t).collection("Part").select("p_partkey").include("suppliers").all()
    return rows.select("p_partkey", F.array_size("suppliers").cast("long").alias("n"), F.array_join(F.transform("suppliers", lambda s: s["s_suppkey"].cast("string")), ",").alias("keys"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def orm_some_none(t: Tables) -> DataFrame:
    return database(t).collection("Customer").where(lambda c: c.orders.some(lambda o: o.o_totalprice > 200000) & c.orders.none({"o_orderstatus": "P"})).select("c_custkey").all()


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 20000))""")
def orm_every(t: Tables) -> DataFrame:
    return database(t).collection("Customer").where(lambda c: c.orders.every(lambda o: o.o_totalprice > 20000)).select("c_custkey").all()


@query("""SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal < 0)""")
def orm_some_many_to_many(t: Tables) -> DataFrame:
    return database(t).collection("Part").where(lambda p: p.suppliers.some(lambda s: s.s_acctbal < 0)).select("p_partkey").all()


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def orm_cursor(t: Tables) -> DataFrame:
    q = database(t).collection("Order").order_by("o_totalprice", "desc").order_by("o_orderkey").cursor({"o_totalprice": 150000.0, "o_orderkey": 10}).take(25)
    return q.select("o_orderkey", "o_totalprice").all()


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def orm_distinct(t: Tables) -> DataFrame:
    return database(t).collection("Order").order_by("o_totalprice").order_by("o_orderkey").distinct("o_orderpriority").select("o_orderpriority", "o_orderkey").all()


@query("""SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1 HAVING count(*) > 100 AND max(o_totalprice) > 1000""")
def orm_group_having(t: Tables) -> DataFrame:
    q = database(t).collection("Order").group_by("o_orderstatus").having("count", None, "gt", 100).having("max", "o_totalprice", "gt", 1000)
    return q.aggregate(n=("count", None), mean=("avg", "o_totalprice")).withColumn("mean", F.round("mean", 2))


@query("""SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'O'""")
def orm_aggregate(t: Tables) -> DataFrame:
    return database(t).collection("Order").where({"o_orderstatus": "O"}).aggregate(n=("count", None), low=("min", "o_totalprice"), high=("max", "o_totalprice"))


@query("""SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50""")
def orm_variant(t: Tables) -> DataFrame:
    return database(t).collection("Event").variant("Purchase").where(lambda e: e.value > 50).select("event_id", "user_id", "value").all()


# document pipeline


@query("""SELECT o_orderpriority AS _id, round(sum(o_totalprice), 2) AS total, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 2 DESC LIMIT 3""")
def doc_match_group_sort(t: Tables) -> DataFrame:
    q = t.docs("orders").match({"o_orderstatus": "F"}).group("$o_orderpriority", total=acc.sum("$o_totalprice"), n=acc.count(), top=acc.max("$o_totalprice"))
    return q.add_fields(total=F.round("total", 2)).sort({"total": -1}).limit(3).build()


@query("""SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value * 2 + 1 AS v, strlen(event_type) AS size FROM events WHERE value IS NULL OR value <> 10""")
def doc_project(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    q = t.docs("events").match({"value": {"$ne": 10}}).project({"event_id": 1, "event_type": 1, "k": k, "v": fn.add(fn.multiply("$value", 2), 1), "size": fn.str_len_bytes("$event_type").cast("long")})
    return q.build()


@query("""SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def doc_lookup(t: Tables) -> DataFrame:
    q = t.docs("nation").lookup(t["customer"].select("c_nationkey", "c_custkey"), "customers", "n_nationkey", "c_nationkey")
    return q.add_fields(n=fn.size("$customers").cast("long")).project({"n_name": 1, "n": 1}).build()


@query("""SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 1000) AS rich FROM nation""")
def doc_lookup_pipeline(t: Tables) -> DataFrame:
    rich = lambda p, key: p.match((F.col("s_nationkey") == key) & (F.col("s_acctbal") > 1000))
    q = t.docs("nation").lookup(t["supplier"], "rich", let={"key": "$n_nationkey"}, pipeline=rich)
    return q.project({"n_nationkey": 1, "rich": F.coalesce(F.array_size("rich"), F.lit(0)).cast("long")}).build()


@query("""SELECT c_custkey, i, k FROM (SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS i, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey)
UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def doc_unwind(t: Tables) -> DataFrame:
    q = t.docs("customer").lookup(t["orders"].select("o_orderkey", "o_custkey"), "orders", "c_custkey", "o_custkey")
    q = q.add_fields(k=fn.map("$orders", lambda o: o["o_orderkey"])).project({"c_custkey": 1, "k": 1}).unwind("k", preserve=True, index="i")
    return q.project({"c_custkey": 1, "i": 1, "k": 1}).build()


@query("""SELECT c_mktsegment AS _id, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1""")
def doc_sort_by_count(t: Tables) -> DataFrame:
    return t.docs("customer").sort_by_count("$c_mktsegment").build()


@query("""SELECT CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 10 WHEN p_size < 40 THEN 20 ELSE -1 END AS INTEGER) AS _id, count(*) AS n, round(avg(p_retailprice), 2) AS price FROM part GROUP BY 1""")
def doc_bucket(t: Tables) -> DataFrame:
    q = t.docs("part").bucket("$p_size", [0, 10, 20, 40], default=-1, output={"n": acc.count(), "price": acc.avg("$p_retailprice")})
    return q.add_fields(price=F.round("price", 2)).build()


@query("""WITH c AS (SELECT p_size AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY p_size) - count(*) AS before FROM part GROUP BY 1), b AS (SELECT v, n, floor(before * 5 / (SELECT sum(n) FROM c)) AS b FROM c),
g AS (SELECT b, min(v) AS lo, max(v) AS hi, sum(n) AS n FROM b GROUP BY 1) SELECT lo, coalesce(lead(lo) OVER (ORDER BY b), hi) AS up, CAST(n AS BIGINT) AS n FROM g""")
def doc_bucket_auto(t: Tables) -> DataFrame:
    q = t.docs("part").bucket_auto("$p_size", 5, {"n": acc.count()})
    return q.build().select(F.col("_id.min").alias("lo"), F.col("_id.max").alias("up"), "n")


@query("""SELECT (SELECT count(*) FROM part) AS n, (SELECT string_agg(p_brand || ':' || c, ',' ORDER BY p_brand) FROM (SELECT p_brand, count(*) AS c FROM part GROUP BY 1)) AS brands""")
def doc_facet(t: Tables) -> DataFrame:
    q = t.docs("part").facet(total=lambda p: p.count("n"), brands=lambda p: p.group("$p_brand", c=acc.count()).sort({"_id": 1}))
    brands = F.array_join(F.transform("brands", lambda b: F.concat(b["_id"], F.lit(":"), b["c"].cast("string"))), ",")
    return q.build().select(F.col("total")[0]["n"].alias("n"), brands.alias("brands"))


@query("""WITH RECURSIVE up(p, a, d) AS (SELECT p_partkey, p_partkey // 2, CAST(0 AS BIGINT) FROM part UNION ALL SELECT p, a // 2, d + 1 FROM up WHERE a >= 1), hit AS (SELECT p, a, d FROM up JOIN part ON p_partkey = a)
SELECT p_partkey, count(a) AS n, coalesce(max(d), -1) AS far FROM part LEFT JOIN hit ON p = p_partkey GROUP BY 1""")
def doc_graph_lookup(t: Tables) -> DataFrame:
    parts = t["part"].select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    q = Pipeline(parts).graph_lookup(parts.withColumn("p_partkey", F.col("p_partkey")), "parent", "parent", "p_partkey", "above", "p_partkey", depth_field="d")
    return q.build().select("p_partkey", F.array_size("above").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("above", lambda a: a["d"])), F.lit(-1)).alias("far"))


@query("""SELECT event_id, round(sum(value) OVER w, 4) AS running, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def doc_set_window_fields(t: Tables) -> DataFrame:
    q = t.docs("events").set_window_fields({"running": (acc.sum("$value"), (None, 0)), "moving": (acc.avg("$value"), (-2, 0))}, "$user_id", {"ts": 1, "event_id": 1})
    return q.add_fields(running=F.round("running", 4), moving=F.round("moving", 4)).project({"event_id": 1, "running": 1, "moving": 1}).build()


@query("""WITH d AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, count(*) AS n FROM events GROUP BY 1), r AS (SELECT unnest(generate_series((SELECT min(h) FROM d), (SELECT max(h) FROM d), INTERVAL 1 HOUR)) AS h)
SELECT strftime(r.h, '%Y-%m-%d %H') AS h, coalesce(n, 0) AS n FROM r LEFT JOIN d USING (h)""")
def doc_densify_fill(t: Tables) -> DataFrame:
    hours = t.docs("events").add_fields(h=F.date_trunc("hour", "ts").cast("timestamp")).group("$h", n=acc.count()).replace_root({"h": "$_id", "n": "$n"})
    q = hours.densify("h", 1, "hour").fill({"n": {"value": 0}})
    return q.project({"h": fn.date_to_string("$h", "%Y-%m-%d %H"), "n": 1}).build()


@query("""WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)
SELECT o_orderkey, last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS v FROM x""")
def doc_fill_locf(t: Tables) -> DataFrame:
    holes = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    return t.docs("orders").add_fields(v=holes).fill({"v": "locf"}, {"o_orderkey": 1}, ["o_custkey"]).project({"o_orderkey": 1, "v": 1}).build()


@query("""WITH x AS (SELECT o_custkey AS c, CAST(o_orderkey AS DOUBLE) AS k, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders),
y AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS y0, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER p AS x0, first_value(v IGNORE NULLS) OVER q AS y1, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER q AS x1 FROM x
WINDOW p AS (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY c ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT o_orderkey, round(coalesce(v, y0 + (y1 - y0) * (k - x0) / (x1 - x0)) + 1e-7, 3) AS v FROM y""")
def doc_fill_linear(t: Tables) -> DataFrame:
    holes = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    q = t.docs("orders").add_fields(v=holes).fill({"v": "linear"}, {"o_orderkey": 1}, ["o_custkey"])
    return q.project({"o_orderkey": 1, "v": F.round(F.col("v") + 1e-7, 3)}).build()


@query("""SELECT n_name AS name, 'nation' AS kind, n_regionkey AS region FROM nation UNION ALL SELECT r_name, 'region', NULL FROM region""")
def doc_union_with(t: Tables) -> DataFrame:
    nations = t.docs("nation").project({"name": "$n_name", "kind": fn.literal("nation"), "region": "$n_regionkey"})
    return nations.union_with(t["region"], lambda p: p.project({"name": "$r_name", "kind": fn.literal("region")})).build()


@query("""SELECT o_custkey AS _id, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS keys, list_sort(list(DISTINCT o_orderstatus))[1] AS s1, round(stddev_pop(o_totalprice), 3) AS sd FROM orders GROUP BY 1""")
def doc_accumulators(t: Tables) -> DataFrame:
    q = t.docs("orders").sort({"o_orderkey": 1}).group("$o_custkey", cheapest=acc.top({"o_totalprice": 1, "o_orderkey": 1}, "$o_orderkey"), keys=acc.push("$o_orderkey"), s=acc.add_to_set("$o_orderstatus"), sd=acc.std_dev_pop("$o_totalprice"))
    return q.build().select("_id", "cheapest", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"), F.col("s")[0].alias("s1"), F.round("sd", 3).alias("sd"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_diff('month', TIMESTAMP '1992-01-15', o_orderdate) AS months, strftime(o_orderdate, '%d/%m/%Y') AS shown, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS start, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS later FROM orders""")
def doc_dates(t: Tables) -> DataFrame:
    shown = {"y": fn.year("$o_orderdate").cast("long"), "m": fn.month("$o_orderdate").cast("long"), "months": fn.date_diff(F.lit("1992-01-15").cast("timestamp"), "$o_orderdate", "month"), "shown": fn.date_to_string("$o_orderdate", "%d/%m/%Y")}
    shown |= {"start": fn.date_to_string(fn.date_trunc("$o_orderdate", "month"), "%Y-%m-%d"), "later": fn.date_to_string(fn.date_add("$o_orderdate", "day", 10), "%Y-%m-%d")}
    return t.docs("orders").project({"o_orderkey": 1} | shown).build()


@query("""SELECT p_partkey, lower(p_name) || '-' || p_brand AS a, length(p_type) AS n, replace(p_type, ' ', '_') AS r, split_part(p_type, ' ', 1) AS w, regexp_matches(p_type, 'BR|CO') AS has, substring(p_brand, 2, 3) AS sub FROM part""")
def doc_strings(t: Tables) -> DataFrame:
    spec = {"a": fn.concat(fn.to_lower("$p_name"), "-", "$p_brand"), "n": fn.str_len_cp("$p_type").cast("long"), "r": fn.replace_all("$p_type", " ", "_"), "w": fn.first_elem(fn.split("$p_type", " ")), "has": fn.regex_match("$p_type", "BR|CO"), "sub": fn.substr("$p_brand", 1, 3)}
    return t.docs("part").project({"p_partkey": 1} | spec).build()


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT (c_nationkey = 3 OR c_nationkey = 4)""")
def doc_filters(t: Tables) -> DataFrame:
    spec = {"c_acctbal": {"$gt": 0}, "c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}, "$nor": [{"c_nationkey": 3}, {"c_nationkey": 4}]}
    return t.docs("customer").match(spec).project({"c_custkey": 1}).build()


@query("""SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05""")
def doc_count(t: Tables) -> DataFrame:
    return t.docs("lineitem").match({"l_discount": {"$gt": 0.05}}).count("n").build()


@query("""SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0""")
def doc_redact(t: Tables) -> DataFrame:
    rule = lambda get: F.when(get("c_acctbal") < 0, "$$PRUNE").otherwise("$$KEEP")
    return t.docs("customer").redact(rule).project({"c_custkey": 1, "c_name": 1}).build()


# extensions


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10""")
def ext_vector_search(t: Tables) -> DataFrame:
    first = t["embeddings"].where("vec_id = 0").select("embedding").first().embedding
    return t.docs("embeddings").vector_search("embedding", first, 10, "vec_id").build().select("vec_id", F.round("score", 6).alias("score"))


@query("""SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cd, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def ext_vector_distances(t: Tables) -> DataFrame:
    a = t["embeddings"].select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vector.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("cd"), F.round(vector.euclidean(F.col("embedding"), F.col("other")), 5).alias("d"))


_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), r AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'with')) AS a, len(list_filter(w, lambda x: x = 'from')) AS b FROM d),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM r)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM r, s WHERE a > 0 OR b > 0""")
def ext_text_bm25(t: Tables) -> DataFrame:
    return text.bm25(t["documents"], "doc_id", "text", "with from").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""SELECT doc_id, list_contains(w, 'the') AS one, list_contains(w, 'the') AND list_contains(w, 'of') AS both FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)""")
def ext_text_match(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", text.term(F.col("text"), "the").alias("one"), text.match_all(F.col("text"), "the of").alias("both"))


@query("""WITH p AS (SELECT c_custkey AS k, (c_custkey * 37 % 360) - 180.0 AS x, (c_custkey * 17 % 180) - 90.0 AS y FROM customer)
SELECT k, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(48.0 - y) / 2), 2) + cos(radians(y)) * cos(radians(48.0)) * pow(sin(radians(2.0 - x) / 2), 2)))) / 1000, 3) AS km, x BETWEEN -10 AND 30 AND y BETWEEN 30 AND 60 AS near FROM p""")
def ext_geo(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    p = geo.point((k * 37 % 360) - 180.0, (k * 17 % 180) - 90.0)
    ring = geo.bbox_polygon(-10.5, 29.5, 30.5, 60.5)
    return t["customer"].select(k.alias("k"), F.round(geo.distance_sphere(p, geo.point(2.0, 48.0)) / 1000, 3).alias("km"), geo.contains(ring, p).alias("near"))


# mutations


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE NOT (c_nationkey = 5)""")
def mut_update_delete(t: Tables) -> DataFrame:
    changed = mutate.update(t["customer"], {"c_acctbal": 0.0, "c_mktsegment": "DEBT"}, F.col("c_acctbal") < 0).table
    return mutate.delete(changed, F.col("c_nationkey") == 5).table.select("c_custkey", "c_acctbal", "c_mktsegment")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier) a FULL JOIN (SELECT c_custkey + 7 AS k, c_acctbal AS v FROM customer) b ON a.k = b.k""")
def mut_merge(t: Tables) -> DataFrame:
    target = t["supplier"].select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    rows = t["customer"].select((F.col("c_custkey") + 7).alias("k"), F.col("c_acctbal").alias("v"))
    return Pipeline(rows).merge(target, ["k"])


@query("""SELECT event_id, value + 5 AS value, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value, event_type FROM events WHERE event_type <> 'click' OR event_type IS NULL""")
def mut_document_update(t: Tables) -> DataFrame:
    changed = mutate.update_documents(t["events"], {"$inc": {"value": 5.0}, "$set": {"event_type": "tap"}}, F.col("event_type") == "click")
    return changed.table.select("event_id", "value", "event_type")


# windows of event time, as the streaming operator computes them


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS h, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2""")
def stream_hourly(t: Tables) -> DataFrame:
    rows = windowed(t["events"].withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.round(F.sum("value"), 3))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("h"), "event_type", "n", "total")


from . import operator_queries  # noqa: E402, F401  (registers its queries above)
