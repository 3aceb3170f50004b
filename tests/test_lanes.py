"""Golden cases for the relational builder, collections, the pipeline and mutations, on a few rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from brookframe.contract import MANY_TO_MANY, MANY_TO_ONE, ONE_TO_MANY, Contract, Model, Relation, Variant, require, schema_diff
from brookframe.functions import geo, text
from brookframe.functions.document import acc, document_filter, fn, operator
from brookframe.operators import mutate
from brookframe.plans.collection import Database
from brookframe.plans.pipeline import Pipeline
from brookframe.plans.runtime import BudgetError, Cache, Hooks, LintError, Runtime, lint, lint_change, lint_raw, prepared
from brookframe.plans.select import Select
from brookframe.sources.tables import data_transform, function_source, violations
from brookframe.streaming.events import read, windowed

CONTRACT = Contract(
    (
        Model("User", "users", ("id",), {"posts": Relation("Post", ONE_TO_MANY, (("id", "user_id"),)), "tags": Relation("Tag", MANY_TO_MANY, (("id", "user_id"),), "user_tags", (("tag_id", "id"),)), "invitedBy": Relation("User", MANY_TO_ONE, (("invited_by_id", "id"),))}),
        Model("Post", "posts", ("id",), {"author": Relation("User", MANY_TO_ONE, (("user_id", "id"),))}),
        Model("Tag", "tags", ("id",)),
        Model("Task", "tasks", ("id",), discriminator="type", variants=(Variant("Bug", "bug", ("severity",)), Variant("Feature", "feature", table="features"))),
    )
)


@pytest.fixture(scope="module")
def db(spark):
    make = spark.createDataFrame
    return lambda: Database(
        spark,
        CONTRACT,
        {
            "users": make([(1, "Alice", "alice@e", None), (2, "Bob", "bob@e", 1), (3, "Charlie", "c@e", 1), (4, "Diana", "d@e", 2)], "id int, name string, email string, invited_by_id int"),
            "posts": make([(1, "Hello World", 1, 100), (2, "Second Post", 1, 50), (3, "Bobs Post", 2, 200), (4, "Another One", 3, 10)], "id int, title string, user_id int, views int"),
            "tags": make([(10, "x"), (11, "y")], "id int, name string"),
            "user_tags": make([(1, 10), (1, 11), (2, 11)], "user_id int, tag_id int"),
            "tasks": make([(1, "a", "bug", "high"), (2, "b", "feature", None)], "id int, title string, type string, severity string"),
            "features": make([(2, 5)], "id int, priority int"),
        },
    )


def test_null_comparison_and_ordering(spark, db):
    users = Select.table(db().tables["users"], "users")
    assert [r.name for r in users.select("name").where(lambda f, fn: fn.eq(f.invited_by_id, None)).build().collect()] == ["Alice"]
    order = lambda **k: [r.id for r in users.select("id").order_by("invited_by_id", **k).order_by("id").build().collect()]
    assert order() == [2, 3, 4, 1] and order(direction="desc") == [1, 4, 2, 3] and order(nulls="first") == [1, 2, 3, 4]


def test_empty_connectives(spark, db):
    users = Select.table(db().tables["users"], "users")
    count = lambda p: users.select("id").where(p).build().count()
    assert count(lambda f, fn: fn.and_()) == 4 and count(lambda f, fn: fn.or_()) == 0
    assert count(lambda f, fn: fn.in_(f.id, [])) == 0 and count(lambda f, fn: fn.not_in(f.id, [])) == 4
    with pytest.raises(AttributeError):
        users.select("nothing")


def test_ambiguous_names_and_having_replaces(db):
    d = db()
    j = Select.table(d.tables["users"], "u").inner_join(Select.table(d.tables["posts"], "p"), lambda f, fn: fn.eq(f.u.id, f.p.user_id))
    with pytest.raises(AttributeError):
        j.where(lambda f: f.id == 1)
    q = j.select("name").select("n", lambda f, fn: fn.count()).group_by("name").having(lambda f, fn: fn.gt(fn.count(), 100)).having(lambda f, fn: fn.gt(fn.count(), 1))
    assert [tuple(r) for r in q.build().collect()] == [("Alice", 2)]


def test_not_in_with_null(db):
    d = db()
    inviters = Select.table(d.tables["users"], "i").select("invited_by_id")
    assert Select.table(d.tables["users"], "u").select("id").where(lambda f, fn: fn.not_in(f.id, inviters)).build().count() == 0


def test_includes(db):
    d = db()
    rows = d.collection("User").order_by("id").select("id").include("posts", lambda p: p.order_by("views", "desc").take(1).select("title")).include("invitedBy", lambda u: u.select("name")).include("tags", lambda t: t.select("name")).all().collect()
    assert [[p.title for p in r.posts] for r in rows] == [["Hello World"], ["Bobs Post"], ["Another One"], []]
    assert [r.invitedBy and r.invitedBy.name for r in rows] == [None, "Alice", "Alice", "Bob"]
    assert [[t.name for t in r.tags] for r in rows] == [["x", "y"], ["y"], [], []]


def test_relation_filters(db):
    users = db().collection("User").order_by("id").select("id")
    ids = lambda p: [r.id for r in users.where(p).all().collect()]
    assert ids(lambda u: u.posts.some(lambda p: p.views > 60)) == [1, 2]
    assert ids(lambda u: u.posts.none()) == [4]
    assert ids(lambda u: u.posts.every(lambda p: p.views >= 100)) == [2, 4]
    assert ids(lambda u: u.tags.some({"name": "x"})) == [1]


def test_cursor_distinct_and_groups(db):
    d = db()
    assert [r.id for r in d.collection("User").order_by("id").cursor({"id": 2}).take(2).all().collect()] == [3, 4]
    assert [r.id for r in d.collection("User").order_by("id", "desc").cursor({"id": 3}).all().collect()] == [2, 1]
    with pytest.raises(ValueError):
        d.collection("User").cursor({"id": 1})
    g = d.collection("Post").group_by("user_id").having("count", None, "gt", 1).aggregate(n=("count", None), v=("sum", "views"))
    assert [tuple(r) for r in g.collect()] == [(1, 2, 150)]
    with pytest.raises(ValueError):
        d.collection("Post").aggregate()


def test_variants(db):
    d = db()
    assert [(r.id, r.priority) for r in d.collection("Task").order_by("id").all().collect()] == [(1, None), (2, 5)]
    assert [r.priority for r in d.collection("Task").variant("Feature").all().collect()] == [5]
    d.collection("Task").variant("Feature").create(id=3, title="c", priority=9)
    assert d.collection("Task").variant("Feature").count() == 2


def test_mutations(db):
    d = db()
    assert d.collection("User").where(lambda u: u.invited_by_id == 1).update(name="X").returning("id").collect()[0].id == 2
    assert d.tables["users"].where("name = 'X'").count() == 1
    d.collection("User").upsert({"id": 9, "name": "N", "email": "n"}, {"name": "M"})
    d.collection("User").upsert({"id": 9, "name": "N", "email": "n"}, {"name": "M"})
    assert d.tables["users"].where("id = 9").first().name == "M"
    d.collection("User").where({"id": 9}).delete_all()
    assert d.tables["users"].count() == 4
    d.collection("User").create_nested({"id": 5, "name": "E", "email": "e"}, posts={"create": [{"id": 50, "title": "t", "views": 1}], "connect": [{"id": 4}]}, tags={"connect": [{"id": 10}]})
    assert sorted(r.id for r in d.tables["posts"].where("user_id = 5").collect()) == [4, 50] and d.tables["user_tags"].count() == 4
    with pytest.raises(KeyError):
        d.collection("User").create_nested({"id": 6, "name": "F", "email": "f"}, posts={"create": [{"nope": 1}]})
    assert d.tables["users"].where("id = 6").count() == 0


def test_merge_rules(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int"), spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string")
    rows = lambda **k: sorted(tuple(r) for r in mutate.merge_rows(old, new, ["k"], **k).collect())
    assert rows() == [(1, "a", 1), (2, "z", 2), (3, "c", None)]
    assert rows(when_matched="replace", when_not_matched="discard") == [(1, "a", 1), (2, "z", None)]
    assert rows(when_matched="keepExisting") == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    with pytest.raises(Exception, match="must not"):
        rows(when_matched="fail")


def test_document_updates(spark):
    df = spark.createDataFrame([(1, 5, [1, 2], ("a", 1)), (2, None, [], ("b", 2))], "id int, n int, xs array<int>, s struct<t: string, u: int>")
    out = mutate.update_documents(df, {"$inc": {"n": 2}, "$push": {"xs": 3}, "$set": {"s.t": "z"}, "$rename": {"id": "key"}}, F.col("id") > 0).table.orderBy("key").collect()
    assert [(r.key, r.n, r.xs, r.s.t) for r in out] == [(1, 7, [1, 2, 3], "z"), (2, 2, [3], "z")]
    out = mutate.update_documents(df, {"$pop": {"xs": 1}, "$max": {"n": 6}, "$unset": {"s": ""}}, F.col("id") == 1).table.orderBy("id").collect()
    assert out[0].xs == [1] and out[0].n == 6 and out[0].s is None and out[1].s.t == "b"


def test_pipeline_golden(spark):
    rows = [("eng", 100, "completed"), ("eng", 200, "completed"), ("eng", 50, "pending"), ("sales", 150, "completed"), ("sales", 300, "completed"), ("hr", 75, "completed")]
    orders = Pipeline(spark.createDataFrame(rows, "department string, amount int, status string"))
    q = orders.match({"status": "completed"}).group("$department", total=acc.sum("$amount")).sort({"total": -1}).limit(2)
    assert [tuple(r) for r in q.build().collect()] == [("sales", 450), ("eng", 300)]
    assert orders.match({"amount": {"$gt": 1000}}).count("n").build().count() == 0
    first = orders.sort({"amount": 1}).group("$department", low=acc.first("$amount"), all=acc.push("$amount"), top=acc.first_n("$amount", 2)).build().where("_id = 'eng'").first()
    assert first.low == 50 and first.all == [50, 100, 200] and first.top == [50, 100]
    with pytest.raises(ValueError):
        orders.limit(-1)
    assert orders.sample(3).build().count() == 3
    out = orders.project({"status": 0}).build().columns
    assert out == ["department", "amount"]


def test_two_valued_filters(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, x int")
    ids = lambda spec: sorted(r.id for r in df.where(document_filter(spec)).collect())
    assert ids({"x": {"$ne": 5}}) == [1] and ids({"x": {"$nin": [5]}}) == [1] and ids({"$nor": [{"x": {"$gt": 1}}]}) == [1]
    assert ids({"x": {"$in": [None, 5]}}) == [1, 2] and ids({"x": {"$exists": False}}) == [1] and ids({"$expr": fn.gt("$x", "$id")}) == [2]


def test_expressions(spark):
    df = spark.createDataFrame([([3, 1, 2], "a-b-a", "2024-02-28 23:30:00", {"k": 1})], "xs array<int>, s string, d string, m map<string, int>").withColumn("d", F.col("d").cast("timestamp"))
    get = lambda c: df.select(c.alias("v")).first().v
    assert get(fn.replace_one("$s", "a", "z")) == "z-b-a" and get(fn.replace_all("$s", "a", "z")) == "z-b-z"
    assert get(fn.slice("$xs", 2)) == [3, 1] and get(fn.slice("$xs", -2)) == [1, 2] and get(fn.array_elem_at("$xs", -1)) == 2 and get(fn.array_elem_at("$xs", 9)) is None
    assert get(fn.zip("$xs", fn.range(0, 2))) == [[3, 0], [1, 1]] and get(fn.range(5, 1, -2)) == [5, 3] and get(fn.range(3, 3)) == []
    assert get(fn.index_of_array("$xs", 2)) == 2 and get(fn.index_of_array("$xs", 7)) == -1
    assert get(fn.date_diff("$d", fn.date_add("$d", "hour", 1), "day")) == 1 and get(fn.date_to_string("$d", "%Y/%m/%dT%H")) == "2024/02/28T23"
    assert get(fn.date_from_string("nope", on_error=F.lit(None).cast("timestamp"))) is None
    assert get(fn.date_trunc("$d", "minute", 20)) == datetime.datetime(2024, 2, 28, 23, 20)
    assert get(fn.set_equals(fn.set_union("$xs", F.array(F.lit(4))), F.array(*map(F.lit, (4, 3, 2, 1)))))
    assert get(fn.convert("x", "int", on_error=-1)) == -1 and get(fn.divide(1, 0)) is None and get(fn.cmp(None, 1)) == -1
    assert get(fn.regex_find("$s", "b(-)")).idx == 2 and len(get(fn.regex_find_all("$s", "a"))) == 2
    assert get(fn.object_to_array("$m"))[0].k == "k" and get(fn.switch((fn.eq("$s", "q"), 1), default=2)) == 2
    assert get(operator("$strLenCP", "$s")) == 5 and get(operator("$toUpper", "$s")) == "A-B-A"
    with pytest.raises(ValueError):
        operator("$nothing")


def test_graph_lookup_broadcasts_nothing(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    df = spark.range(1, 41).selectExpr("id", "id div 2 AS parent").union(spark.createDataFrame([(5, 1)], "id long, parent long"))
    up = Pipeline(df.where("id <> 5 OR parent = 2")).graph_lookup(df, "parent", "parent", "id", "above", "id").build()
    assert {r.id: [(a.id, a.parent, a.depth) for a in r.above] for r in up.collect()}[40] == [(1, 0, 3), (2, 1, 3), (5, 1, 2), (5, 2, 2), (10, 5, 1), (20, 10, 0)]
    plans = [store.executionsList(i, 1).apply(0).physicalPlanDescription() for i in range(seen, store.executionsCount())]
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_stages(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, 9)], "id int, parent int")
    up = Pipeline(df).graph_lookup(df, "parent", "parent", "id", "above", "id", max_depth=1).build().orderBy("id").collect()
    assert [[a.id for a in r.above] for r in up] == [[], [1], [1, 2], [2, 3], []]
    cyclic = spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int")
    assert [len(r.above) for r in Pipeline(cyclic).graph_lookup(cyclic, "parent", "parent", "id", "above", "id").build().collect()] == [2, 2]
    with pytest.raises(Exception, match="boundaries"):
        Pipeline(df).bucket("$id", [0, 3]).build().collect()
    auto = Pipeline(df).bucket_auto("$id", 2).build().orderBy("_id.min").collect()
    assert [(r._id.min, r._id.max, r["count"]) for r in auto] == [(1, 4, 3), (4, 5, 2)]
    nested = spark.createDataFrame([(1, "ok", [("no", 1), ("ok", 2)])], "id int, level string, parts array<struct<level: string, v: int>>")
    rule = lambda get: F.when(get("level") == "ok", "$$DESCEND").otherwise("$$PRUNE")
    assert [p.v for p in Pipeline(nested).redact(rule, ("parts",)).build().first().parts] == [2]
    assert Pipeline(df).union_with(df.select("id")).build().count() == 10
    assert Pipeline(df).add_fields(s=F.struct(F.col("id").alias("q"))).replace_root("$s").build().columns == ["q"]


def test_text_and_geo(spark):
    df = spark.createDataFrame([("The quick brown fox",), ("fox quick",)], "t string")
    hits = lambda c: [r.v for r in df.select(c.alias("v")).collect()]
    assert hits(text.phrase(F.col("t"), "quick brown")) == [True, False] and hits(text.phrase(F.col("t"), "quick fox", 1)) == [True, False]
    assert hits(text.fuzzy(F.col("t"), "quik")) == [True, True] and hits(text.proximity(F.col("t"), "fox", 1, "quick")) == [True, True] and hits(text.proximity(F.col("t"), "fox", 1, "quick", ordered=True)) == [False, True]
    one = spark.range(1)
    square, other = geo.polygon([(0, 0), (2, 0), (2, 2), (0, 2)]), geo.bbox_polygon(1, 1, 3, 3)
    row = one.select(geo.contains(square, geo.point(1, 1)).alias("a"), geo.contains(square, geo.point(3, 1)).alias("b"), geo.intersects(square, other).alias("c"), geo.intersects(square, geo.bbox_polygon(5, 5, 6, 6)).alias("d"), geo.dwithin(geo.point(0, 0), geo.point(3, 4), 5).alias("e")).first()
    assert tuple(row) == (True, False, True, False, True)


def test_runtime(spark, db):
    users = Select.table(db().tables["users"], "users")
    assert lint(users) == ["selects all columns", "has no limit"] and lint_raw("select * from t") and not lint_raw("select a from t limit 1")
    with pytest.raises(LintError):
        lint_raw("delete from t")
    with pytest.raises(LintError):
        lint_change("update", None)
    seen = []
    tenant = lambda q: q.where(lambda f: f.id > 1)
    run = Runtime(Hooks(before_compile=[tenant], on_row=[seen.append]))
    assert len(list(run.rows(users.select("id")))) == 3 == len(seen)
    with pytest.raises(BudgetError):
        list(Runtime(max_rows=2).rows(users.select("id")))
    cache = Cache(1)
    a = cache(users.select("id").build(), {"cache": True})
    assert cache(users.select("id").build(), {"cache": True}) is a
    assert prepared(spark, "select :x + 1 as y where true limit 1")(x=2).first().y == 3


def test_contract_and_sources(spark, db):
    d = db()
    assert len(CONTRACT.hash()) == 64
    with pytest.raises(TypeError):
        require(d.tables["users"].schema["id"].dataType, "textual", "ilike")
    assert schema_diff(d.tables["users"].schema, d.tables["posts"].schema)[0] == "missing name"
    broken = violations(d.tables["posts"], key=["user_id"], check="views > 20", foreign=(["user_id"], d.tables["users"].where("id < 3"), ["id"]))
    assert {k: v.count() for k, v in broken.items()} == {"key": 1, "check": 1, "foreign key": 1}
    with pytest.raises(ValueError):
        data_transform(d.tables["posts"], "views > 20", lambda x: x, "true")
    assert [r.n for r in function_source(spark, "range", 3, alias="r", columns=["n"]).collect()] == [0, 1, 2]


def test_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 5)
    df = spark.createDataFrame([(at, "a", 1.0), (at + datetime.timedelta(hours=3), "a", 2.0)], "ts timestamp, kind string, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed(read(spark, str(tmp_path / "in"), df.schema), "ts", "1 hour", ["kind"], n=F.count(F.lit(1)))
    stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("hours").count() == 2


def test_not_in_subquery_is_not_broadcast(spark, db):
    d = db()
    inviters = Select.table(d.tables["users"].where("invited_by_id is not null"), "i").select("invited_by_id")
    q = Select.table(d.tables["users"], "u").select("id").where(lambda f, fn: fn.not_in(f.id, inviters)).build()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in q._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in q.collect()) == [3, 4]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nobody = Select.table(d.tables["users"].where("id < 0"), "i").select("id")
    assert Select.table(d.tables["users"], "u").select("id").where(lambda f, fn: fn.not_in(f.invited_by_id, nobody)).build().count() == 4


def test_changes_by_relations_and_variants(db):
    d = db()
    posts = lambda u: u.posts.some(lambda p: p.views > 60)
    changed = d.collection("User").where(posts).include("posts").update_all(name="Z")
    assert sorted((r.id, r.name, len(r.posts)) for r in changed.rows.collect()) == [(1, "Z", 2), (2, "Z", 1)]
    assert d.tables["users"].columns == ["id", "name", "email", "invited_by_id"] and d.tables["users"].where("name = 'Z'").count() == 2
    gone = d.collection("User").where(lambda u: u.posts.none()).include("invitedBy").delete_all().rows.collect()
    assert [(r.id, r.invitedBy.name) for r in gone] == [(4, "Z")] and d.tables["users"].count() == 3
    d.collection("Task").variant("Bug").delete_all()
    assert [r.type for r in d.tables["tasks"].collect()] == ["feature"]


def test_order_of_any_type(spark):
    df = spark.createDataFrame([(1, "a", "ab", True, b"x"), (2, "a", "abc", False, b"xy"), (3, "a", None, None, None), (4, "a", "b", True, b"a")], "id int, k string, s string, b boolean, raw binary")
    one = lambda name, way: Pipeline(df).group("$k", v=acc.top_n(4, {name: way, "id": 1}, "$id")).build().first().v
    assert one("s", 1) == [3, 1, 2, 4] and one("s", -1) == [4, 2, 1, 3] and one("b", -1) == [1, 4, 2, 3] and one("raw", -1) == [2, 1, 4, 3]
    rows = Pipeline(df).sort({"s": -1}).group("$k", f=acc.first("$id"), l=acc.last("$id"), all=acc.push("$s")).build().first()
    assert (rows.f, rows.l, rows["all"]) == (4, 3, ["b", "abc", "ab", None])
    with pytest.raises(TypeError):
        Pipeline(df.withColumn("m", F.create_map(F.lit(1), F.lit(2)))).group("$k", v=acc.top({"m": -1}, "$id"))


def test_filters_compare_one_kind_only(spark):
    df = spark.createDataFrame([(1, "x", [1, 5]), (2, None, []), (3, "y", None)], "id int, s string, xs array<int>")
    ids = lambda spec: sorted(r.id for r in Pipeline(df).match(spec).build().collect())
    assert ids({"s": {"$gt": 5}}) == [] and ids({"s": {"$in": [1, "x"]}}) == [1] and ids({"s": {"$ne": 5}}) == [1, 2, 3] and ids({"s": {"$nin": [1, None]}}) == [1, 3]
    assert ids({"xs": 5}) == [1] and ids({"xs": {"$ne": 5}}) == [2, 3] and ids({"xs": {"$gt": 4}}) == [1] and ids({"xs": {"$in": [1, "z"]}}) == [1] and ids({"xs": {"$not": {"$gt": 4}}}) == [2, 3]
    with pytest.raises(ValueError):
        ids({"s": {"$near": 1}})


def test_unwind_of_paths_and_scalars(spark):
    df = spark.createDataFrame([(1, ([7, 8],)), (2, ([],)), (3, (None,))], "id int, o struct<xs: array<int>>")
    rows = Pipeline(df).unwind("$o.xs", index="i").build().collect()
    assert [(r.id, r.o.xs, r.i) for r in rows] == [(1, 7, 0), (1, 8, 1)]
    assert Pipeline(df).unwind("o.xs", preserve=True).build().count() == 4 and Pipeline(df).unwind("id", index="i").build().where("i is null").count() == 3


def test_find_one_commands(spark, db):
    users = db().tables["users"]
    was = mutate.find_one_and_update(users, F.col("id") > 1, {"$set": {"name": "Q"}}, ["id"], sort={"id": -1}, before=True)
    assert was.rows.first().name == "Diana" and was.table.where("name = 'Q'").first().id == 4
    gone = mutate.find_one_and_delete(users, F.col("id") > 100, ["id"])
    assert gone.rows.count() == 0 and gone.table.count() == 4


def test_extremes_of_nothing_are_empty_lists(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5)], "k int, x int")
    rows = {r["_id"]: r for r in Pipeline(df).group("$k", hi=acc.max_n("$x", 2), lo=acc.min_n("$x", 2)).build().collect()}
    assert (rows[1].hi, rows[1].lo, rows[2].hi, rows[2].lo) == ([], [], [5], [5])
