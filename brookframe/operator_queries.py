"""Further registered queries: every expression, accumulator, filter, stage, predicate and mutation has one that shows its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import geo, text
from .functions.document import acc, fn, operator
from .operators import mutate
from .plans.pipeline import Pipeline
from .queries import _TOKENS, Tables, database, query
from .sources.tables import function_source


def joined(c: Column) -> Column:
    """An array as one string."""
    return F.array_join(c.cast("array<string>"), ",", "null")


def shown(c: Column) -> Column:
    """The same, and null for an empty array, as a filtered list in the SQL is."""
    return F.when(F.array_size(c) > 0, joined(c))


def nearest(c: Column, digits: int) -> Column:
    """A double, not negative, rounded by its own value; round() goes by its shortest decimal form, which moves ties."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


# expressions


@query("""SELECT p_partkey, p_retailprice - p_size AS sub, round(p_retailprice / nullif(p_size - 24, 0), 6) AS quotient, CAST(floor(p_retailprice) AS BIGINT) AS whole, CAST(p_size AS DOUBLE) AS number, CAST(p_partkey AS VARCHAR) AS shown,
p_size % 2 <> 0 AS odd, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN 2 ELSE 3 END AS class, CAST(round(p_size / 4.0, 2) AS DOUBLE) AS exact FROM part""")
def doc_numbers(t: Tables) -> DataFrame:
    spec = {"sub": fn.subtract("$p_retailprice", "$p_size"), "quotient": F.round(fn.divide("$p_retailprice", fn.subtract("$p_size", 24)), 6), "whole": fn.to_long(F.floor("p_retailprice")), "number": fn.to_double("$p_size"), "shown": fn.to_string("$p_partkey")}
    spec |= {"odd": fn.to_bool(F.col("p_size") % 2), "kind": fn.cond(fn.gt("$p_size", 25), "large", "small"), "class": fn.switch((fn.lt("$p_size", 10), 1), (fn.lt("$p_size", 20), 2), default=3), "exact": fn.to_double(F.round(fn.to_decimal("$p_size") / 4, 2))}
    return t.docs("part").project({"p_partkey": 1} | spec).build()


@query(r"""WITH p AS (SELECT p_partkey, p_brand, p_name, '  ' || p_type || ' ' AS x FROM part)
SELECT p_partkey, upper(p_name) AS up, substring(p_brand, 1, 3) AS bytes, trim(x) AS t, ltrim(x) AS l, rtrim(x) AS r, trim(p_brand, 'Bd') AS chars, regexp_extract(p_name, '[aeiou](.)', 1) AS after, instr(p_name, regexp_extract(p_name, '[aeiou]')) - 1 AS idx,
len(regexp_extract_all(p_name, '[aeiou]')) AS vowels, regexp_replace(p_name, 'e', 'EE') AS one, split_part(p_name, ' ', -1) AS word, length(p_name) AS n FROM p""")
def doc_more_strings(t: Tables) -> DataFrame:
    found = fn.regex_find("$p_name", "[aeiou](.)")
    spec = {"up": fn.to_upper("$p_name"), "bytes": fn.substr_bytes("$p_brand", 0, 3), "t": fn.trim("$x"), "l": fn.ltrim("$x"), "r": fn.rtrim("$x"), "chars": fn.trim("$p_brand", "Bd")}
    spec |= {"after": found["captures"][0], "idx": found["idx"].cast("long"), "vowels": fn.size(fn.regex_find_all("$p_name", "[aeiou]")).cast("long"), "one": fn.replace_one("$p_name", "e", "EE"), "word": fn.last_elem(fn.split("$p_name", " ")), "n": operator("$strLenBytes", "$p_name").cast("long")}
    return t.docs("part").add_fields(x=F.concat(F.lit("  "), "p_type", F.lit(" "))).project({"p_partkey": 1} | spec).build()


@query("""SELECT event_id, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, CAST(millisecond(ts) % 1000 AS BIGINT) AS ms, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS before,
strftime(strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y'), '%Y-%m-%d') AS back, strftime(time_bucket(INTERVAL 20 MINUTE, ts), '%H:%M') AS bin, strftime(CAST(strftime(ts, '%Y-%m-%d') AS TIMESTAMP), '%j') AS nth, strftime(make_timestamp(event_id * 1000000000), '%Y-%m-%d %H:%M:%S') AS made FROM events""")
def doc_date_parts(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    spec = {"d": fn.day_of_month(ts).cast("long"), "h": fn.hour(ts).cast("long"), "mi": fn.minute(ts).cast("long"), "s": fn.second(ts).cast("long"), "ms": fn.millisecond(ts).cast("long"), "before": fn.date_to_string(fn.date_subtract(ts, "hour", 3), "%Y-%m-%d %H:%M:%S")}
    spec |= {"back": fn.date_to_string(fn.date_from_string(fn.date_to_string(ts, "%d.%m.%Y"), "%d.%m.%Y"), "%Y-%m-%d"), "bin": fn.date_to_string(fn.date_trunc(ts, "minute", 20), "%H:%M"), "nth": fn.date_to_string(fn.to_date(fn.date_to_string(ts, "%Y-%m-%d")), "%j"), "made": fn.date_to_string(fn.millis_to_date(F.col("event_id") * 1000000), "%Y-%m-%d %H:%M:%S")}
    return t.docs("events").project({"event_id": 1} | spec).build()


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS x, c_nationkey AS n FROM customer)
SELECT c_custkey, CASE WHEN x IS NULL THEN -1 WHEN x < 100 THEN -1 WHEN x = 100 THEN 0 ELSE 1 END AS cmp, x IS NOT DISTINCT FROM NULL AS eq, n <> 3 AS ne, coalesce(x > 100, false) AS gt, coalesce(x >= 100, false) AS gte, x IS NULL OR x < 100 AS lt, x IS NULL OR x <= 100 AS lte, n IN (1, 3, 5) AS listed, '$n' AS plain FROM c""")
def doc_comparisons(t: Tables) -> DataFrame:
    holes = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    spec = {"cmp": fn.cmp("$x", 100.0), "eq": fn.eq("$x", None), "ne": fn.ne("$c_nationkey", 3), "gt": fn.gt("$x", 100.0), "gte": fn.gte("$x", 100.0), "lt": fn.lt("$x", 100.0), "lte": fn.lte("$x", 100.0), "listed": fn.is_in("$c_nationkey", [1, 3, 5]), "plain": fn.literal("$n")}
    return t.docs("customer").add_fields(x=holes).project({"c_custkey": 1} | spec).build()


@query("""WITH p AS (SELECT p_partkey, [p_size, 3, p_size % 5] AS a, p_size AS n FROM part)
SELECT p_partkey, array_to_string(list_concat(a, [7, 8]), ',') AS both, a[1] AS first, a[3] AS last, a[2] AS second, CAST(coalesce(list_position(a, 3), 0) - 1 AS BIGINT) AS place, array_to_string(a[1:2], ',') AS head, array_to_string(a[2:3], ',') AS tail, array_to_string(list_reverse(a), ',') AS back,
array_to_string(range(0, n, 10), ',') AS steps, CAST(len(a) AS BIGINT) AS size, true AS is_list, array_to_string(list_filter(a, lambda x: x > 2), ',') AS big, array_to_string(list_transform(a, lambda x: x * 2), ',') AS twice, CAST(list_sum(a) AS BIGINT) AS total, a[1] || '-' || 9 AS pair FROM p""")
def doc_arrays(t: Tables) -> DataFrame:
    spec = {"both": joined(fn.concat_arrays("$a", [7, 8])), "first": fn.first_elem("$a"), "last": fn.last_elem("$a"), "second": fn.array_elem_at("$a", 1), "place": fn.index_of_array("$a", 3).cast("long"), "head": joined(fn.slice("$a", 2)), "tail": joined(fn.slice("$a", -2)), "back": joined(fn.reverse_array("$a"))}
    spec |= {"steps": joined(fn.range(F.lit(0), "$p_size", 10)), "size": fn.size("$a").cast("long"), "is_list": fn.is_array("$a"), "big": joined(fn.filter("$a", lambda x: x > 2)), "twice": joined(fn.map("$a", lambda x: x * 2)), "total": fn.reduce("$a", F.lit(0), lambda s, x: s + x).cast("long"), "pair": F.array_join(fn.zip("$a", [9])[0].cast("array<string>"), "-")}
    return t.docs("part").add_fields(a=F.array("p_size", F.lit(3), F.col("p_size") % 5)).project({"p_partkey": 1} | spec).build()


@query("""WITH p AS (SELECT p_partkey, [p_size % 4, 1] AS a, [1, 2, p_size % 3] AS b FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS d,
list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same, list_has_all(b, a) AS inside, list_bool_or(list_transform(a, lambda x: x = 2)) AS some, list_bool_and(list_transform(a, lambda x: x > 0)) AS every FROM p""")
def doc_sets(t: Tables) -> DataFrame:
    arrays = {"a": F.array(F.col("p_size") % 4, F.lit(1)), "b": F.array(F.lit(1), F.lit(2), F.col("p_size") % 3)}
    spec = {k: joined(F.array_sort(f("$a", "$b"))) for k, f in (("u", fn.set_union), ("i", fn.set_intersection), ("d", fn.set_difference))}
    spec |= {"same": fn.set_equals("$a", "$b"), "inside": fn.set_is_subset("$a", "$b"), "some": fn.any_element_true(fn.map("$a", lambda x: x == 2)), "every": fn.all_elements_true(fn.map("$a", lambda x: x > 0))}
    return t.docs("part").add_fields(**arrays).project({"p_partkey": 1} | spec).build()


@query("""SELECT p_partkey, 'string' AS ts, 'long' AS tl, 'double' AS td, CASE WHEN p_size > 25 THEN 'null' ELSE 'int' END AS tn, 'array' AS ta, 'object' AS tob, coalesce(TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER), -1) AS number, coalesce(TRY_CAST(p_name AS INTEGER), -1) AS wrong, printf('%024x', p_partkey) AS oid FROM part""")
def doc_types(t: Tables) -> DataFrame:
    spec = {"ts": fn.type_of("$p_name"), "tl": fn.type_of("$p_partkey"), "td": fn.type_of("$p_retailprice"), "tn": fn.type_of(F.when(F.col("p_size") <= 25, F.col("p_size"))), "ta": fn.type_of(F.array("p_size")), "tob": fn.type_of(F.struct("p_size"))}
    spec |= {"number": fn.convert(F.split_part("p_brand", F.lit("#"), F.lit(2)), "int", on_error=-1), "wrong": fn.convert("$p_name", "int", on_error=-1), "oid": fn.to_object_id(F.lpad(F.upper(F.hex("p_partkey")), 24, "0"))}
    return t.docs("part").project({"p_partkey": 1} | spec).build()


@query("""SELECT c_custkey, 'bal:' || CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) || ',nation:' || CAST(c_nationkey AS VARCHAR) AS pairs, c_nationkey * 10 + 1 AS let, c_nationkey AS own, c_nationkey + 1 AS changed, 'x' AS won, CAST(c_nationkey AS BIGINT) AS from_map FROM customer""")
def doc_objects(t: Tables) -> DataFrame:
    one = F.struct(F.floor("c_acctbal").cast("string").alias("bal"), F.col("c_nationkey").cast("string").alias("nation"))
    pairs = F.array_join(fn.map(fn.object_to_array("$o", ["bal", "nation"]), lambda e: F.concat(e["k"], F.lit(":"), e["v"])), ",")
    rounded = F.struct(F.bround("c_acctbal").cast("long").cast("string").alias("bal"), F.col("c_nationkey").cast("string").alias("nation"))
    spec = {"pairs": pairs, "let": fn.let({"n": fn.multiply("$c_nationkey", 10)}, lambda n: n + 1), "own": fn.get_field(F.struct("c_nationkey"), "c_nationkey"), "changed": fn.get_field(fn.set_field(F.struct("c_nationkey"), "c_nationkey", fn.add("$c_nationkey", 1)), "c_nationkey")}
    spec |= {"won": fn.merge_objects((one, ["bal", "nation"]), (F.struct(F.lit("x").alias("bal")), ["bal"]))["bal"], "from_map": fn.array_to_object(F.array(F.struct(F.lit("k").alias("k"), F.col("c_nationkey").alias("v"))))["k"].cast("long")}
    return t.docs("customer").add_fields(o=rounded).project({"c_custkey": 1} | spec).build()


# accumulators


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders)
SELECT o_custkey AS _id, round(coalesce(sum(x), 0), 2) AS total, round(avg(x), 4) AS mean, min(x) AS low, max(x) AS high, count(*) AS n, first(o_orderkey ORDER BY o_orderkey) AS f, last(o_orderkey ORDER BY o_orderkey) AS l, array_to_string(list(coalesce(CAST(x AS VARCHAR), 'null') ORDER BY o_orderkey), ',') AS pushed,
array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS kinds, round(stddev_pop(x), 3) AS sp, round(stddev_samp(x), 3) AS ss, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:2], ',') AS f2, array_to_string(list_reverse(list(o_orderkey ORDER BY o_orderkey DESC)[1:2]), ',') AS l2, array_to_string(list(x ORDER BY x DESC) FILTER (x IS NOT NULL)[1:2], ',') AS hi2, array_to_string(list(x ORDER BY x) FILTER (x IS NOT NULL)[1:2], ',') AS lo2,
first(o_orderkey ORDER BY o_orderpriority DESC, o_orderkey) AS top, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS bottom, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey)[1:2], ',') AS top2, array_to_string(list_reverse(list(o_orderkey ORDER BY o_orderpriority, o_orderkey DESC)[1:2]), ',') AS bottom2 FROM o GROUP BY 1""")
def acc_grouped(t: Tables) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice"))
    fields = dict(total=acc.sum("$x"), mean=acc.avg("$x"), low=acc.min("$x"), high=acc.max("$x"), n=acc.count(), f=acc.first("$o_orderkey"), l=acc.last("$o_orderkey"), pushed=acc.push("$x"), kinds=acc.add_to_set("$o_orderstatus"), sp=acc.std_dev_pop("$x"), ss=acc.std_dev_samp("$x"))
    fields |= dict(f2=acc.first_n("$o_orderkey", 2), l2=acc.last_n("$o_orderkey", 2), hi2=acc.max_n("$x", 2), lo2=acc.min_n("$x", 2), top=acc.top({"o_orderpriority": -1, "o_orderkey": 1}, "$o_orderkey"), bottom=acc.bottom({"o_orderdate": 1, "o_orderkey": 1}, "$o_orderkey"))
    fields |= dict(top2=acc.top_n(2, {"o_orderdate": -1, "o_orderkey": 1}, "$o_orderkey"), bottom2=acc.bottom_n(2, {"o_orderpriority": -1, "o_orderkey": 1}, "$o_orderkey"))
    df = t.docs("orders").add_fields(x=x).sort({"o_orderkey": 1}).group("$o_custkey", **fields).build()
    rounded = {"total": F.round("total", 2), "mean": nearest(F.col("mean"), 4), "sp": F.round("sp", 3), "ss": F.round("ss", 3)}
    return df.withColumns(rounded | {c: joined(F.col(c)) for c in ("pushed", "kinds", "f2", "l2", "top2", "bottom2")} | {c: shown(F.col(c)) for c in ("hi2", "lo2")})


@query("""WITH e AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS x FROM events)
SELECT event_id, round(coalesce(sum(x) OVER w, 0), 3) AS total, round(avg(x) OVER w, 4) AS mean, min(x) OVER w AS low, max(x) OVER w AS high, count(*) OVER w AS n, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, array_to_string(list_transform(list({'v': x}) OVER w, lambda s: coalesce(CAST(s.v AS VARCHAR), 'null')), ',') AS pushed,
array_to_string(list_sort(list_distinct(list(event_type) OVER w)), ',') AS kinds, round(stddev_pop(x) OVER w, 3) AS sp, round(stddev_samp(x) OVER w, 3) AS ss, array_to_string((list(event_id) OVER w)[1:2], ',') AS f2, array_to_string((list(event_id) OVER w)[-2:], ',') AS l2, array_to_string(list_filter(list_sort(list(x) OVER w, 'DESC', 'NULLS LAST'), lambda v: v IS NOT NULL)[1:2], ',') AS hi2, array_to_string(list_filter(list_sort(list(x) OVER w), lambda v: v IS NOT NULL)[1:2], ',') AS lo2,
list_sort(list({'a': event_type, 'b': event_id}) OVER w)[-1].b AS top, list_sort(list({'a': event_type, 'b': event_id}) OVER w)[1].b AS bottom, array_to_string(list_transform(list_reverse(list_sort(list({'a': event_type, 'b': event_id}) OVER w))[1:2], lambda s: s.b), ',') AS top2, array_to_string(list_transform(list_reverse(list_sort(list({'a': event_type, 'b': event_id}) OVER w))[-2:], lambda s: s.b), ',') AS bottom2
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def acc_windowed(t: Tables) -> DataFrame:
    x, by = F.when(F.col("event_id") % 4 != 0, F.col("value")), {"event_type": -1, "event_id": -1}
    fields = dict(total=acc.sum("$x"), mean=acc.avg("$x"), low=acc.min("$x"), high=acc.max("$x"), n=acc.count(), f=acc.first("$event_id"), l=acc.last("$event_id"), pushed=acc.push("$x"), kinds=acc.add_to_set("$event_type"), sp=acc.std_dev_pop("$x"), ss=acc.std_dev_samp("$x"))
    fields |= dict(f2=acc.first_n("$event_id", 2), l2=acc.last_n("$event_id", 2), hi2=acc.max_n("$x", 2), lo2=acc.min_n("$x", 2), top=acc.top(by, "$event_id"), bottom=acc.bottom(by, "$event_id"), top2=acc.top_n(2, by, "$event_id"), bottom2=acc.bottom_n(2, by, "$event_id"))
    df = t.docs("events").add_fields(x=x).set_window_fields({k: (a, (-3, 0)) for k, a in fields.items()}, "$user_id", {"ts": 1, "event_id": 1}).build()
    rounded = {"total": F.round("total", 3), "mean": F.round("mean", 4), "sp": F.round("sp", 3), "ss": F.round("ss", 3)}
    return df.withColumns(rounded | {c: joined(F.col(c)) for c in ("pushed", "kinds", "f2", "l2", "hi2", "lo2", "top2", "bottom2")}).select("event_id", *fields)


# filters and stages


@query("""SELECT c_custkey FROM customer WHERE c_acctbal >= 100 AND c_acctbal <= 9000 AND c_nationkey IS NOT NULL AND c_mktsegment <> 'BUILDING' AND regexp_matches(c_name, '[1-9]$') AND c_nationkey NOT IN (2, 9) AND (c_nationkey < 20 OR c_mktsegment = 'FURNITURE') AND c_acctbal > c_nationkey""")
def doc_filter_operators(t: Tables) -> DataFrame:
    spec = {"c_acctbal": {"$gte": 100, "$lte": 9000}, "c_nationkey": {"$exists": True, "$nin": [2, 9, "x"], "$type": "int"}, "c_mktsegment": {"$not": {"$eq": "BUILDING"}}, "c_name": {"$regex": "[1-9]$"}}
    return t.docs("customer").match(spec | {"$or": [{"c_nationkey": {"$lt": 20}}, {"c_mktsegment": "FURNITURE"}], "$and": [{"$expr": fn.gt("$c_acctbal", "$c_nationkey")}]}).project({"c_custkey": 1}).build()


@query("""SELECT (SELECT count(*) FROM customer) AS everything, CAST(0 AS BIGINT) AS other_kind, (SELECT count(*) FROM customer WHERE c_name = 'Customer#000000003') AS mixed, (SELECT count(*) FROM part WHERE p_size = 7 OR p_size % 5 = 2) AS element, (SELECT count(*) FROM part WHERE p_size > 10 OR p_size % 5 > 10) AS element_gt, (SELECT count(*) FROM part WHERE p_size = 2 AND p_size % 5 = 2) AS both, (SELECT count(*) FROM customer WHERE c_nationkey = 4) AS dotted""")
def doc_filter_kinds(t: Tables) -> DataFrame:
    count = lambda q, name: q.group(None, **{name: acc.count()}).build().select(name)
    c, p = t.docs("customer"), t.docs("part").add_fields(a=F.array("p_size", F.col("p_size") % 5))
    none = c.match({"c_name": {"$gt": 5}}).build().union(c.match({"c_acctbal": {"$lt": "x"}}).build()).union(c.match({"c_name": 5}).build())
    parts = [count(c.match({"c_name": {"$ne": 5}}), "everything"), none.agg(F.count(F.lit(1)).alias("other_kind")), count(c.match({"c_name": {"$in": [1, "Customer#000000003"]}}), "mixed")]
    parts += [count(p.match({"$or": [{"a": 7}, {"a": 2}, {"a": {"$elemMatch": lambda x: x == 7}}]}), "element"), count(p.match({"a": {"$gt": 10}}), "element_gt"), count(p.match({"a": {"$all": [2], "$size": 2}}).match(F.col("p_size") == 2), "both")]
    parts.append(count(c.add_fields(s=F.struct("c_nationkey")).match({"s.c_nationkey": 4}), "dotted"))
    out = parts[0]
    for one in parts[1:]:
        out = out.crossJoin(one)  # one row each
    return out


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 15 OFFSET 5""")
def doc_skip(t: Tables) -> DataFrame:
    return t.docs("customer").sort({"c_acctbal": 1, "c_custkey": 1}).skip(5).limit(15).project({"c_custkey": 1, "c_acctbal": 1}).build()


@query("""SELECT s_suppkey, s_acctbal * 2 AS s_acctbal, 'x' AS tag FROM supplier""")
def doc_set_unset(t: Tables) -> DataFrame:
    return t.docs("supplier").set(s_acctbal=fn.multiply("$s_acctbal", 2), tag=F.lit("x")).unset("s_name", "s_nationkey").build()


@query("""SELECT CAST(5 AS BIGINT) AS n, true AS inside""")
def doc_sample(t: Tables) -> DataFrame:
    rows = t.docs("nation").sample(5).build()
    return rows.agg(F.countDistinct("n_nationkey").alias("n"), (F.max("n_nationkey") < 25).alias("inside"))


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 360) - 180.0 AS x, (c_custkey * 17 % 180) - 90.0 AS y FROM customer),
d AS (SELECT c_custkey, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(48.0 - y) / 2), 2) + cos(radians(y)) * cos(radians(48.0)) * pow(sin(radians(2.0 - x) / 2), 2)))) AS d FROM p) SELECT c_custkey, round(d / 1000, 3) AS km FROM d WHERE d <= 3000000 ORDER BY d, c_custkey LIMIT 20""")
def doc_geo_near(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    q = t.docs("customer").add_fields(x=(k * 37 % 360) - 180.0, y=(k * 17 % 180) - 90.0).geo_near((2.0, 48.0), "x", "y", "d", max_distance=3e6)
    return q.sort({"d": 1, "c_custkey": 1}).limit(20).build().select("c_custkey", F.round(F.col("d") / 1000, 3).alias("km"))


@query(f"""WITH d AS (SELECT doc_id, lang, {_TOKENS} AS w FROM documents) SELECT lang, count(*) AS count FROM d WHERE list_has_any(w, ['with', 'und']) GROUP BY 1""")
def doc_search_meta(t: Tables) -> DataFrame:
    return t.docs("documents").search_meta("with und", "text", facet="lang").build()


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), r AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'with')) AS a FROM d), s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da FROM r)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM r, s WHERE a > 0""")
def doc_search(t: Tables) -> DataFrame:
    return t.docs("documents").search("with", "text", "doc_id").build().select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT p_type AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY p_type) - count(*) AS before FROM part GROUP BY 1), b AS (SELECT v, n, floor(before * 3 / (SELECT sum(n) FROM c)) AS b FROM c), g AS (SELECT b, min(v) AS lo, max(v) AS hi, sum(n) AS n FROM b GROUP BY 1) SELECT lo, coalesce(lead(lo) OVER (ORDER BY b), hi) AS up, CAST(n AS BIGINT) AS n FROM g""")
def doc_bucket_auto_text(t: Tables) -> DataFrame:
    return t.docs("part").bucket_auto("$p_type", 3, {"n": acc.count()}).build().select(F.col("_id.min").alias("lo"), F.col("_id.max").alias("up"), "n")


@query("""WITH c AS (SELECT o_orderdate AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY o_orderdate) - count(*) AS before FROM orders GROUP BY 1), b AS (SELECT v, n, floor(before * 6 / (SELECT sum(n) FROM c)) AS b FROM c), g AS (SELECT b, min(v) AS lo, max(v) AS hi, sum(n) AS n FROM b GROUP BY 1) SELECT strftime(lo, '%Y-%m-%d') AS lo, strftime(coalesce(lead(lo) OVER (ORDER BY b), hi), '%Y-%m-%d') AS up, CAST(n AS BIGINT) AS n FROM g""")
def doc_bucket_auto_dates(t: Tables) -> DataFrame:
    out = t.docs("orders").bucket_auto("$o_orderdate", 6, {"n": acc.count()}).build()
    return out.select(F.date_format("_id.min", "yyyy-MM-dd").alias("lo"), F.date_format("_id.max", "yyyy-MM-dd").alias("up"), "n")


@query("""SELECT (SELECT string_agg(p_brand, ',' ORDER BY p_brand DESC) FROM (SELECT DISTINCT p_brand FROM part)) AS brands, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS last""")
def doc_facet_descending(t: Tables) -> DataFrame:
    days = t.docs("orders").facet(days=lambda p: p.group("$o_orderdate").sort({"_id": -1}).limit(3)).build()
    brands = t.docs("part").facet(brands=lambda p: p.group("$p_brand").sort({"_id": -1})).build()
    return brands.crossJoin(days).select(F.array_join(F.transform("brands", lambda b: b["_id"]), ",").alias("brands"), F.date_format(F.col("days")[0]["_id"], "yyyy-MM-dd").alias("last"))


@query("""SELECT c_custkey, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey""")
def doc_unwind_dotted(t: Tables) -> DataFrame:
    q = t.docs("customer").lookup(t["orders"].select("o_orderkey", "o_custkey"), "orders", "c_custkey", "o_custkey").project({"c_custkey": 1, "inside": F.struct(F.transform("orders", lambda o: o["o_orderkey"]).alias("keys"))})
    return q.unwind("$inside.keys").unwind("$c_custkey").build().select("c_custkey", F.col("inside.keys").alias("k"))


@query("""SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY 1""")
def doc_redact_nested(t: Tables) -> DataFrame:
    own = t["orders"].select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "open").otherwise("closed").alias("level"))
    q = t.docs("customer").lookup(own, "orders", "c_custkey", "o_custkey").add_fields(level=F.when(F.col("c_acctbal") >= 0, "open").otherwise("closed"), box=F.struct(F.lit("open").alias("level"), F.col("orders")))
    q = q.redact(lambda get: F.when(get("level") == "open", "$$DESCEND").otherwise("$$PRUNE"), ("box", "box.orders"))
    return q.build().select("c_custkey", joined(F.transform("box.orders", lambda o: o["o_orderkey"])).alias("keys"))


# relational predicates and clauses


@query("""SELECT c_custkey, c_nationkey % 7 AS m FROM customer WHERE c_nationkey IN (1, 2, 3, 4, 5, 6, 7, 8) AND c_mktsegment NOT IN ('BUILDING') AND NOT (c_acctbal < 0) AND c_name IS NOT NULL AND contains(c_name, '00') AND starts_with(c_name, 'Customer') AND (ends_with(c_name, '1') OR ends_with(c_name, '2') OR c_acctbal IS NULL)""")
def sql_predicates(t: Tables) -> DataFrame:
    q = t.sql("customer").where(lambda f, fn: fn.and_(fn.in_(f.c_nationkey, [1, 2, 3, 4, 5, 6, 7, 8]), fn.not_in(f.c_mktsegment, ["BUILDING"]), fn.not_(fn.lt(f.c_acctbal, 0)), fn.is_not_null(f.c_name), fn.contains(f.c_name, "00"), fn.starts_with(f.c_name, "Customer")))
    q = q.where(lambda f, fn: fn.or_(fn.ends_with(f.c_name, "1"), fn.ends_with(f.c_name, "2"), fn.is_null(f.c_acctbal))).where(lambda f, fn: fn.all())
    return q.select("c_custkey").select("m", lambda f, fn: fn.raw("`customer.c_nationkey` % 7", "int")).build()


@query("""SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_totalprice, o_orderkey), ',') AS keys, max(o_orderkey) || ':' || count(*) AS shown FROM orders GROUP BY 1""")
def sql_json(t: Tables) -> DataFrame:
    q = t.sql("orders").select("o_custkey").select(lambda f, fn: {"keys": fn.json_array_agg(f.o_orderkey, f.o_totalprice), "o": fn.json_object(k=fn.max(f.o_orderkey), n=fn.count())})
    return q.group_by("o_custkey").build().select("o_custkey", joined(F.col("keys")).alias("keys"), F.concat(F.col("o.k").cast("string"), F.lit(":"), F.col("o.n").cast("string")).alias("shown"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS nth FROM orders""")
def sql_row_number(t: Tables) -> DataFrame:
    return t.sql("orders").select("o_orderkey").select("nth", lambda f, fn: fn.row_number([f.o_custkey], [f.o_totalprice.desc(), f.o_orderkey])).build()


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS x FROM customer), a AS (SELECT 'first' AS k, c_custkey FROM c ORDER BY x NULLS FIRST, c_custkey LIMIT 20), b AS (SELECT 'last' AS k, c_custkey FROM c ORDER BY x DESC NULLS LAST, c_custkey LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b""")
def sql_nulls_order(t: Tables) -> DataFrame:
    from .plans.select import Order, Select

    holes = t["customer"].select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("x"))
    first = Select.table(holes, "c").order_by("x", nulls="first").order_by("c_custkey").limit(20).select("c_custkey").build()
    turned = Order("x", nulls="first").reverse()
    last = Select.table(holes, "c").order_by(turned.column, turned.direction, turned.nulls).order_by("c_custkey").limit(20).select("c_custkey").build()
    return first.select(F.lit("first").alias("k"), "c_custkey").union(last.select(F.lit("last").alias("k"), "c_custkey"))


@query("""SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) t ON k = c_custkey WHERE n > 5""")
def sql_join_subquery(t: Tables) -> DataFrame:
    counts = t.sql("orders").select("k", lambda f: f.o_custkey).select("n", lambda f, fn: fn.count()).group_by("k").as_("t")
    return t.sql("customer").inner_join(counts, lambda f, fn: fn.eq(f.k, f.c_custkey)).where(lambda f, fn: fn.gt(f.n, 5)).select("c_custkey", "n").build()


@query("""SELECT range AS n, range * range AS square FROM range(50)""")
def sql_function_source(t: Tables) -> DataFrame:
    return function_source(t.spark, "range", 50, alias="r", columns=["n"]).select("n", (F.col("n") * F.col("n")).alias("square"))


# collections


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def orm_first(t: Tables) -> DataFrame:
    row = database(t).collection("Order").order_by("o_totalprice", "desc").order_by("o_orderkey").select("o_orderkey", "o_totalprice").first()
    return t.spark.createDataFrame([tuple(row)], "o_orderkey long, o_totalprice double")


@query("""SELECT c_custkey, string_agg(o_orderstatus || o_orderkey, ',' ORDER BY o_orderstatus) AS firsts FROM (SELECT c_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1""")
def orm_include_distinct(t: Tables) -> DataFrame:
    rows = database(t).collection("Customer").select("c_custkey").include("orders", lambda o: o.order_by("o_orderstatus").order_by("o_orderkey").distinct("o_orderstatus").select("o_orderstatus", "o_orderkey")).all()
    return rows.where(F.array_size("orders") > 0).select("c_custkey", F.array_join(F.transform("orders", lambda o: F.concat(o["o_orderstatus"], o["o_orderkey"].cast("string"))), ",").alias("firsts"))


@query("""SELECT c_custkey, (SELECT round(avg(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS mean, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS total, (SELECT min(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS low FROM customer""")
def orm_include_scalars(t: Tables) -> DataFrame:
    rows = database(t).collection("Customer").select("c_custkey").include("orders", lambda o: o.combine(mean=o.avg("o_totalprice"), total=o.sum("o_totalprice"), low=o.min("o_totalprice"))).all()
    return rows.select("c_custkey", nearest(F.col("orders.mean"), 2).alias("mean"), F.round("orders.total", 2).alias("total"), "orders.low")


# geometry and text


@query("""WITH p AS (SELECT c_custkey AS k, CAST(c_custkey * 7 % 50 AS DOUBLE) AS x, CAST(c_custkey * 11 % 40 AS DOUBLE) AS y FROM customer)
SELECT k, round(sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)), 6) AS d, sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)) <= 12.5 AS near, x <= 30 AND x + 3 >= 10 AND y <= 25 AND y + 3 >= 5 AS boxes, x <= 30 AND x + 3 >= 10 AND y <= 25 AND y + 3 >= 5 AS shapes FROM p""")
def ext_geo_shapes(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k * 7 % 50).cast("double"), (k * 11 % 40).cast("double")
    p, box = geo.point(x, y), geo.bbox_polygon(10, 5, 30, 25)
    own = F.array(*[geo.point(x + i, y + j) for i, j in ((0, 0), (3, 0), (3, 3), (0, 3))])
    target = geo.point(10.0, 20.0)
    return t["customer"].select(k.alias("k"), F.round(geo.distance(p, target), 6).alias("d"), geo.dwithin(p, target, 12.5).alias("near"), geo.intersects_bbox(own, box).alias("boxes"), geo.intersects(own, box).alias("shapes"))


@query(f"""WITH d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM (SELECT doc_id, {_TOKENS} AS w FROM documents))
SELECT doc_id, list_has_any(w, ['the', 'und']) AS m, contains(s, ' of the ') AS p, regexp_matches(s, ' of ([^ ]+ ){{0,2}}the ') AS slop, regexp_matches(s, ' of ([^ ]+ ){{0,1}}the ') OR regexp_matches(s, ' the ([^ ]+ ){{0,1}}of ') AS prox, len(list_filter(w, lambda x: levenshtein(x, 'there') <= 1)) > 0 AS fuzzy,
CAST(CASE WHEN list_contains(w, 'the') THEN 3 ELSE 0 END AS DOUBLE) AS const, CAST(len(w) * 1.5 AS DOUBLE) AS boosted FROM d""")
def ext_text_operators(t: Tables) -> DataFrame:
    c = F.col("text")
    return t["documents"].select("doc_id", text.match(c, "the und").alias("m"), text.phrase(c, "of the").alias("p"), text.phrase(c, "of the", 2).alias("slop"), text.proximity(c, "of", 1, "the").alias("prox"), text.fuzzy(c, "there", 1).alias("fuzzy"), text.constant(text.term(c, "the"), 3.0).alias("const"), text.boost(F.array_size(text.tokens(c)), 1.5).alias("boosted"))


# mutations


@query("""SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'NEW' UNION ALL SELECT 101, 'DEFAULT'""")
def mut_insert(t: Tables) -> DataFrame:
    return mutate.insert(t["region"], [{"r_regionkey": 100, "r_name": "NEW"}, {"r_regionkey": 101}], {"r_name": lambda: "DEFAULT"}).table


@query("""SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_nationkey < 5""")
def mut_returning(t: Tables) -> DataFrame:
    return mutate.update(t["supplier"], {"s_acctbal": F.col("s_acctbal") + 1}, F.col("s_nationkey") < 5).returning("s_suppkey", "s_acctbal")


@query("""SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'TWO' ELSE r_name END AS r_name FROM region UNION ALL SELECT 77, 'SEVEN'""")
def mut_upsert(t: Tables) -> DataFrame:
    once = mutate.upsert(t["region"], {"r_regionkey": 2, "r_name": "X"}, {"r_name": "TWO"}, ["r_regionkey"]).table
    return mutate.upsert(once, {"r_regionkey": 77, "r_name": "SEVEN"}, {"r_name": "Y"}, ["r_regionkey"]).table


@query("""SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'ONE' ELSE r_name END AS r_name FROM region UNION ALL SELECT 50, 'FIFTY'""")
def mut_on_conflict(t: Tables) -> DataFrame:
    kept = mutate.insert_on_conflict(t["region"], [{"r_regionkey": 0, "r_name": "NO"}, {"r_regionkey": 50, "r_name": "FIFTY"}], ["r_regionkey"])
    return mutate.insert_on_conflict(kept, [{"r_regionkey": 1, "r_name": "ONE"}], ["r_regionkey"], do_update=["r_name"])


@query("""WITH p AS (SELECT *, p_size > 20 AS hit FROM part) SELECT p_partkey, CASE WHEN hit THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice, CASE WHEN hit THEN NULL ELSE p_type END AS p_type, CASE WHEN hit THEN NULL ELSE p_name END AS p_name, CASE WHEN hit THEN p_name END AS label, CASE WHEN hit THEN least(p_size, 30) ELSE p_size END AS lo, CASE WHEN hit THEN greatest(p_size, 30) ELSE p_size END AS hi,
array_to_string(CASE WHEN hit THEN [p_size, 1, 2, 9] ELSE [p_size, 1, 2] END, ',') AS pushed, array_to_string([p_size, 1, 2], ',') AS added, array_to_string(CASE WHEN hit THEN [p_size, 1] ELSE [p_size, 1, 2] END, ',') AS popped, array_to_string(CASE WHEN hit THEN [p_size, 2] ELSE [p_size, 1, 2] END, ',') AS pulled, array_to_string(CASE WHEN hit THEN [p_size] ELSE [p_size, 1, 2] END, ',') AS cleared, hit AS dated FROM p""")
def mut_field_updates(t: Tables) -> DataFrame:
    a = F.array("p_size", F.lit(1), F.lit(2))
    df = t["part"].withColumns({"lo": F.col("p_size"), "hi": F.col("p_size"), "at": F.lit(None).cast("timestamp")} | {c: a for c in ("pushed", "added", "popped", "pulled", "cleared")})
    changes = {"$mul": {"p_retailprice": 2.0}, "$unset": {"p_type": ""}, "$rename": {"p_name": "label"}, "$min": {"lo": 30}, "$max": {"hi": 30}, "$push": {"pushed": 9}, "$addToSet": {"added": 2}, "$pop": {"popped": 1}, "$pull": {"pulled": 1}, "$pullAll": {"cleared": [1, 2]}, "$currentDate": {"at": True}, "$setOnInsert": {"p_brand": "no"}}
    out = mutate.update_documents(df, changes, F.col("p_size") > 20).table
    lists = [joined(F.col(c)).alias(c) for c in ("pushed", "added", "popped", "pulled", "cleared")]
    return out.select("p_partkey", "p_retailprice", "p_type", "p_name", "label", "lo", "hi", *lists, F.col("at").isNotNull().alias("dated"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 'BIG' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def mut_update_by_relation(t: Tables) -> DataFrame:
    db = database(t)
    db.collection("Customer").where(lambda c: c.orders.some(lambda o: o.o_totalprice > 400000)).update_all(c_mktsegment="BIG")
    return db.tables["customer"].select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS INTEGER) AS orders FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND c_nationkey < 20""")
def mut_delete_by_relation(t: Tables) -> DataFrame:
    db = database(t)
    gone = db.collection("Customer").where(lambda c: c.orders.none({"o_orderpriority": "1-URGENT"})).where(lambda c: c.c_nationkey < 20).select("c_custkey").include("orders").delete_all()
    return gone.rows.select("c_custkey", F.array_size("orders").alias("orders"))


@query("""SELECT c_custkey, c_acctbal, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM (SELECT c_custkey, CAST(1.5 AS DOUBLE) AS c_acctbal FROM customer WHERE c_nationkey = 3)""")
def mut_update_read_back(t: Tables) -> DataFrame:
    changed = database(t).collection("Customer").where({"c_nationkey": 3}).select("c_custkey", "c_acctbal").include("orders", lambda o: o.count()).update_all(c_acctbal=1.5)
    return changed.rows


@query("""SELECT n_nationkey, CASE WHEN n_nationkey = 24 THEN 'LAST' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 0 UNION ALL SELECT 90, 'A', 1 UNION ALL SELECT 91, 'B', 2""")
def mut_document_commands(t: Tables) -> DataFrame:
    df = mutate.insert_many(t["nation"], [{"n_nationkey": 90, "n_name": "A", "n_regionkey": 1}, {"n_nationkey": 91, "n_name": "B", "n_regionkey": 2}]).table
    df = mutate.find_one_and_update(df, F.col("n_nationkey") < 50, {"$set": {"n_name": "LAST"}}, ["n_nationkey"], sort={"n_nationkey": -1}).table
    return mutate.find_one_and_delete(df, F.col("n_nationkey") < 50, ["n_nationkey"]).table


@query("""SELECT s_suppkey, CASE WHEN s_nationkey = 4 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def mut_pipeline_update(t: Tables) -> DataFrame:
    return mutate.update_with_stages(t["supplier"], lambda p: p.set(s_acctbal=F.lit(0.0)), F.col("s_nationkey") == 4).table.select("s_suppkey", "s_acctbal")


@query("""SELECT c_custkey, count(o_orderkey) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT 1000000) c LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey = 3 THEN 1000000 ELSE o_custkey END AS o_custkey FROM orders UNION ALL SELECT 9000000, 1000000) o ON o_custkey = c_custkey GROUP BY 1""")
def mut_nested_create(t: Tables) -> DataFrame:
    db = database(t)
    db.collection("Customer").create_nested({"c_custkey": 1000000, "c_name": "N"}, orders={"create": [{"o_orderkey": 9000000}], "connect": [{"o_orderkey": 3}]})
    return db.collection("Customer").select("c_custkey").include("orders", lambda o: o.count()).all().withColumnRenamed("orders", "n")


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT 5000000, 1""")
def mut_variant_create(t: Tables) -> DataFrame:
    db = database(t)
    db.collection("Event").variant("Click").create(event_id=5000000, user_id=1)
    return db.collection("Event").variant("Click").select("event_id", "user_id").all()


@query("""SELECT o_orderkey, o_orderkey % 7 AS m FROM orders""")
def doc_pipe(t: Tables) -> DataFrame:
    return Pipeline(t["orders"]).pipe(lambda df: df.select("o_orderkey", (F.col("o_orderkey") % 7).alias("m"))).build()
