"""The document pipeline: 28 stages, each a function from DataFrame to DataFrame.

Documents are rows; sub-documents are structs and arrays. Sorting puts nulls first ascending, as documents do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, text, vector
from ..functions.document import Accumulator, Rows, acc, document_filter, sort_key, value

_KEEP, _PRUNE, _DESCEND = "$$KEEP", "$$PRUNE", "$$DESCEND"


def _orders(spec: dict[str, int]) -> list[Column]:
    for k, way in spec.items():
        if way not in (1, -1):
            raise ValueError(f"sort {k} is 1 or -1")
    return [F.col(k).asc_nulls_first() if way > 0 else F.col(k).desc_nulls_last() for k, way in spec.items()]


def _searched(c: Column, edges: list, low: int = 0) -> Column:
    """How many of the sorted edges are at most c, by halving."""
    if not edges:
        return F.lit(low)
    half = len(edges) // 2
    return F.when(c >= F.lit(edges[half]), _searched(c, edges[half + 1 :], low + half + 1)).otherwise(_searched(c, edges[:half], low))


def running_total(df: DataFrame, order: str, amount: str, out: str, ranges: int = 64, sample: int = 4096) -> DataFrame:
    """df with the sum of `amount` over all rows up to this one, by a column of any ordered type with unique values.

    Ranges of the order column, cut by a bounded sample of its values, are summed first, so that no task sorts all rows:
    only their totals are summed in one.
    """
    chosen = sorted(r[0] for r in df.select(order).orderBy(F.xxhash64(order)).limit(sample).collect() if r[0] is not None and r[0] == r[0])
    edges = sorted({chosen[len(chosen) * i // ranges] for i in range(1, ranges)}) if chosen else []
    parted = df.withColumn("_part", _searched(F.col(order), edges))
    sums = parted.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = sums.select(F.col("_part").alias("_p"), (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # `ranges` rows
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy(order))
    return parted.withColumn(out, inside).join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_p", "_before")


@dataclass(frozen=True)
class Pipeline:
    """Stages over df. Every method returns a new pipeline; build() gives the DataFrame."""

    df: DataFrame
    sorted_by: tuple[tuple[str, int], ...] = ()

    def build(self) -> DataFrame:
        return self.df

    def _to(self, df: DataFrame, keep_order: bool = True) -> Pipeline:
        return replace(self, df=df, sorted_by=self.sorted_by if keep_order else ())

    def pipe(self, stage: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """Any function of a DataFrame."""
        return self._to(stage(self.df))

    def match(self, spec: dict | Column) -> Pipeline:
        return self._to(self.df.where(spec if isinstance(spec, Column) else document_filter(spec, self.df)))

    def project(self, spec: dict[str, Any]) -> Pipeline:
        """{field: 1} keeps, {field: 0} leaves out, anything else computes. `_id` stays unless it is 0."""
        out = {k for k, v in spec.items() if isinstance(v, int) and v == 0}
        rest = {k: v for k, v in spec.items() if k not in out}
        if not rest:
            return self._to(self.df.drop(*out))
        names = ["_id"] if "_id" in self.df.columns and "_id" not in spec else []
        chosen = [F.col(k) if isinstance(v, int) and v == 1 else value(v).alias(k) for k, v in rest.items()]
        return self._to(self.df.select(*names, *chosen))

    def sort(self, spec: dict[str, int]) -> Pipeline:
        return replace(self, df=self.df.orderBy(*_orders(spec)), sorted_by=tuple(spec.items()))

    def limit(self, n: int) -> Pipeline:
        if not isinstance(n, int) or n < 0:
            raise ValueError("limit is a non-negative integer")
        return self._to(self.df.limit(n))

    def skip(self, n: int) -> Pipeline:
        if not isinstance(n, int) or n < 0:
            raise ValueError("skip is a non-negative integer")
        return self._to(self.df.offset(n))

    def add_fields(self, **fields: Any) -> Pipeline:
        return self._to(self.df.withColumns({k: value(v) for k, v in fields.items()}))

    set = add_fields

    def unset(self, *fields: str) -> Pipeline:
        return self._to(self.df.drop(*fields))

    def lookup(self, source: DataFrame, as_: str, local: str | None = None, foreign: str | None = None, let: dict[str, Any] | None = None, pipeline: Callable[..., Pipeline] | None = None) -> Pipeline:
        """The matching rows of source as an array (empty if none), by equal fields or by a pipeline that may use `let`.

        Equal fields: source is grouped by its field once, and joined. A pipeline gets a Pipeline over source, and the
        outer fields named in let; it runs for each row as a lateral join.
        """
        if (local is None) == (pipeline is None) or (let and pipeline is None):
            raise ValueError("give local and foreign, or a pipeline (with let)")
        empty = F.array()
        if pipeline is None:
            rows = F.struct(*[F.col(c) for c in source.columns])
            key = f"_{as_}_key"
            grouped = source.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias(key)).agg(F.array_sort(F.collect_list(rows)).alias(as_))
            kind = grouped.schema[as_].dataType
            found = self.df.drop(as_).join(grouped, F.col(local) == F.col(key), "left").drop(key)
            return self._to(found.withColumn(as_, F.coalesce(as_, empty.cast(kind))), False)
        # names that source does not have: an outer column is looked for there first
        bound = {f"_let_{k}": value(v) for k, v in (let or {}).items()}
        outer = {k.removeprefix("_let_"): F.col(k).outer() for k in bound}
        inner = pipeline(Pipeline(source), **outer).df
        listed = inner.select(F.array_sort(F.collect_list(F.struct("*"))).alias(as_))  # agg would resolve the outer columns too early
        return self._to(self.df.withColumns(bound).drop(as_).lateralJoin(listed, how="left").drop(*bound), False)

    def unwind(self, path: str, preserve: bool = False, index: str | None = None) -> Pipeline:
        """A row for each element; preserve keeps rows with a null or empty array, with null. A value that is no array is its own only element.

        path may be dotted: the element then stands in the array's place inside the document. index: a column for the place, null for what is no array.
        """
        path = path.lstrip("$")
        top, _, rest = path.partition(".")
        kind = self.df.select(F.col(path)).schema[0].dataType
        plain = not isinstance(kind, T.ArrayType)
        listed = F.when(F.col(path).isNotNull(), F.array(F.col(path))) if plain else F.col(path)
        df = self.df.select("*", (F.posexplode_outer if preserve else F.posexplode)(listed).alias("_at", "_one"))
        df = df.withColumn(top, F.col(top).withField(rest, F.col("_one")) if rest else F.col("_one"))
        if index:
            df = df.withColumn(index, F.lit(None).cast("int") if plain else F.col("_at"))
        return self._to(df.drop("_at", "_one"))

    def _order(self) -> Column:
        """The rows' order as a value; columns that a later stage has taken away no longer count."""
        known = dict(self.sorted_by) if {k.split(".")[0] for k, _ in self.sorted_by} <= set(self.df.columns) else {}
        return sort_key(self.df, known) if known else F.lit(0)

    def group(self, _id: Any, **fields: Accumulator) -> Pipeline:
        """Rows by _id (an expression, a dict of them, or None for all); fields are accumulators."""
        for k, a in fields.items():
            if not isinstance(a, Accumulator):
                raise TypeError(f"{k} is not an accumulator")
        rows = Rows(self.df, self._order())
        out = [a.grouped(rows).alias(k) for k, a in fields.items()]
        if _id is None:
            found = self.df.agg(*(out or [F.count(F.lit(1)).alias("_n")]), F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows", "_n")
            return self._to(found.select(F.lit(None).cast("string").alias("_id"), *found.columns), False)
        key = value(_id).alias("_id")
        return self._to(self.df.groupBy(key).agg(*out) if out else self.df.select(key).distinct(), False)

    def replace_root(self, new: Any) -> Pipeline:
        return self._to(self.df.select(value(new).alias("_root")).select("_root.*"))

    replace_with = replace_root

    def count(self, name: str) -> Pipeline:
        """One row with the number of rows; none for no rows."""
        return self._to(self.df.agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 0), False)

    def sort_by_count(self, expression: Any) -> Pipeline:
        found = self.df.groupBy(value(expression).alias("_id")).agg(F.count(F.lit(1)).alias("count"))
        return replace(self, df=found.orderBy(F.desc("count"), F.asc_nulls_first("_id")), sorted_by=(("count", -1),))

    def sample(self, size: int) -> Pipeline:
        """Random rows: each task keeps its `size` smallest of random numbers."""
        return self._to(self.df.withColumn("_rand", F.rand()).orderBy("_rand").limit(size).drop("_rand"), False)

    def redact(self, decide: Callable[[Callable[[str], Column]], Column], nested: tuple[str, ...] = ()) -> Pipeline:
        """decide gets a function from field name to Column, and returns '$$KEEP', '$$PRUNE' or '$$DESCEND' as a Column.

        Descend looks at the named struct fields, or arrays of structs, by the same rule, and at fields inside them whose
        dotted paths are named ('parts', 'parts.sub'); pruned ones are null or left out.
        """

        def inner(c: Column, kind: T.DataType, paths: list[str]) -> Column:
            """A struct or an array of structs after the rule."""
            if isinstance(kind, T.ArrayType):
                kept = F.filter(c, lambda e: decide(lambda n: e.getField(n)).isin(_KEEP, _DESCEND))
                return F.transform(kept, lambda e: below(e, kind.elementType, paths)) if paths else kept
            return F.when(decide(lambda n: c.getField(n)).isin(_KEEP, _DESCEND), below(c, kind, paths))

        def below(c: Column, kind: T.StructType, paths: list[str]) -> Column:
            out = c
            for top in dict.fromkeys(p.partition(".")[0] for p in paths):
                deeper = [p.partition(".")[2] for p in paths if p.startswith(f"{top}.")]
                out = out.withField(top, inner(c.getField(top), kind[top].dataType, deeper))
            return F.when(decide(lambda n: c.getField(n)) == _KEEP, c).otherwise(out) if paths else c

        verdict = decide(lambda name: F.col(name))
        df = self.df.where(verdict.isin(_KEEP, _DESCEND))
        columns = {}
        for top in dict.fromkeys(p.partition(".")[0] for p in nested):
            deeper = [p.partition(".")[2] for p in nested if p.startswith(f"{top}.")]
            columns[top] = F.when(verdict == _KEEP, F.col(top)).otherwise(inner(F.col(top), df.schema[top].dataType, deeper))
        return self._to(df.withColumns(columns) if columns else df)

    def out(self, path: str) -> DataFrame:
        """Replace the table at path by the rows."""
        self.df.write.mode("overwrite").parquet(path)
        return self.df.sparkSession.read.parquet(path)

    def merge(self, target: DataFrame, on: list[str], when_matched: str = "merge", when_not_matched: str = "insert") -> DataFrame:
        """target with the rows put in by key. when_matched: replace, keepExisting, merge or fail; when_not_matched: insert, discard or fail."""
        from ..operators.mutate import merge_rows

        return merge_rows(target, self.df, on, when_matched, when_not_matched)

    def union_with(self, other: DataFrame, pipeline: Callable[[Pipeline], Pipeline] | None = None) -> Pipeline:
        other = pipeline(Pipeline(other)).df if pipeline else other
        return self._to(self.df.unionByName(other, allowMissingColumns=True), False)

    def bucket(self, by: Any, boundaries: list, default: Any = None, output: dict[str, Accumulator] | None = None) -> Pipeline:
        """Rows by the half-open range their value is in, named by its lower end. Outside: default, or an error."""
        x = value(by)
        which = None
        for low, high in zip(boundaries, boundaries[1:], strict=False):
            inside = (x >= low) & (x < high)
            label = F.lit(low) if default is None or type(default) is type(low) else F.lit(str(low))
            which = F.when(inside, label) if which is None else which.when(inside, label)
        which = which.otherwise(F.lit(default) if default is not None else F.raise_error(F.lit("a value is outside the boundaries")))
        return self.add_fields(_bucket=which).group("$_bucket", **(output or {"count": acc.count()}))

    def bucket_auto(self, by: Any, buckets: int, output: dict[str, Accumulator] | None = None) -> Pipeline:
        """About evenly filled ranges {min, max}; equal values share one. A bucket ends at the first value that fills its share."""
        rows = self.df.withColumn("_by", value(by)).where("_by is not null")
        counts = running_total(rows.groupBy("_by").agg(F.count(F.lit(1)).alias("_n")), "_by", "_n", "_upto")
        total = rows.agg(F.count(F.lit(1)).alias("_all"))
        # the place of a value's first row decides its bucket
        number = F.floor((F.col("_upto") - F.col("_n")) * buckets / F.col("_all"))
        numbered = counts.crossJoin(F.broadcast(total))  # one row
        ends = sorted(numbered.groupBy(number.alias("_bucket")).agg(F.min("_by").alias("low"), F.max("_by").alias("high")).collect())  # a row per bucket
        kind = rows.schema["_by"].dataType
        lows = [r.low for r in ends]
        ups = [*lows[1:], ends[-1].high] if ends else []
        which = _searched(F.col("_by"), lows[1:])
        ranges = F.array(*[F.struct(F.lit(a).cast(kind).alias("min"), F.lit(b).cast(kind).alias("max")) for a, b in zip(lows, ups, strict=True)]) if ends else F.array(F.struct(F.lit(None).cast(kind).alias("min"), F.lit(None).cast(kind).alias("max")))
        grouped = self._to(rows.withColumn("_which", which)).group("$_which", **(output or {"count": acc.count()}))
        return self._to(grouped.df.withColumn("_id", F.get(ranges, F.col("_id"))), False)

    def geo_near(self, near: tuple[float, float], x: str, y: str, distance_field: str, max_distance: float | None = None, limit: int | None = None) -> Pipeline:
        """Rows from near to far by great-circle metres."""
        df = self.df.withColumn(distance_field, geo.distance_sphere(geo.point(F.col(x), F.col(y)), geo.point(*near)))
        if max_distance is not None:
            df = df.where(F.col(distance_field) <= max_distance)
        df = df.orderBy(distance_field)
        return replace(self, df=df.limit(limit) if limit is not None else df, sorted_by=((distance_field, 1),))

    def facet(self, **branches: Callable[[Pipeline], Pipeline]) -> Pipeline:
        """One row with each branch's rows as an array; branches are summaries, as each array is one value."""
        found = None
        for name, branch in branches.items():
            own = branch(Pipeline(self.df))
            key = own._order()
            rows = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("o"), F.struct(*own.df.columns).alias("r")))), lambda e: e["r"])
            one = own.df.agg(rows.alias(name))
            found = one if found is None else found.crossJoin(one)  # one row each
        return self._to(found, False)

    def graph_lookup(self, source: DataFrame, start_with: str, connect_from: str, connect_to: str, as_: str, key: str, max_depth: int | None = None, depth_field: str = "depth") -> Pipeline:
        """All rows of source that can be reached from start_with, each once at its least depth, as an array sorted by connect_to.

        One join for each level; rows already reached are not followed again, so cycles end. key identifies the documents.
        Levels are checkpointed where the session has a checkpoint folder. Joins are sort-merge joins: a broadcast for each level
        would send all levels, again and again, through the driver.
        """
        spark = self.df.sparkSession
        kept = bool(spark.sparkContext.getCheckpointDir())
        nodes = source.select(F.col(connect_to).alias("_to"), F.col(connect_from).alias("_from")).distinct().hint("merge")
        frontier = self.df.select(F.col(key).alias("_key"), F.col(start_with).alias("_at")).where("_at is not null").distinct()
        found, depth = None, 0
        while True:
            level = frontier.join(nodes, F.col("_at") == F.col("_to")).select("_key", "_to", "_from", F.lit(depth).alias("_depth"))
            if found is not None:
                level = level.join(found.select("_key", "_to").hint("merge"), ["_key", "_to"], "left_anti")
            level = level.checkpoint() if kept else level.persist()
            if level.isEmpty():
                break
            found = level if found is None else found.union(level)
            if max_depth is not None and depth == max_depth:
                break
            frontier, depth = level.where("_from is not null").select("_key", F.col("_from").alias("_at")).distinct(), depth + 1
        if found is None:
            found = level
        rows = source.select(F.col(connect_to).alias("_to"), F.struct(*source.columns).alias("_row")).distinct()
        reached = found.select("_key", "_to", "_depth").distinct().join(rows.hint("merge"), "_to")
        entry = F.struct(F.col("_to"), F.struct("_row.*", F.col("_depth").cast("long").alias(depth_field)).alias("r"))
        listed = reached.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["r"]).alias(as_))
        out = self.df.join(listed.hint("merge"), F.col(key) == F.col("_key"), "left").drop("_key")
        return self._to(out.withColumn(as_, F.coalesce(as_, F.array().cast(listed.schema[as_].dataType))), False)

    def set_window_fields(self, output: dict[str, tuple[Accumulator, tuple | None]], partition_by: Any = None, sort_by: dict[str, int] | None = None) -> Pipeline:
        """output: field -> (accumulator, (low, high) in rows, None for unbounded on that side, or None for all rows)."""
        base = Window.partitionBy(value(partition_by)) if partition_by is not None else Window.partitionBy()
        if sort_by:
            base = base.orderBy(*_orders(sort_by))
        columns = {}
        for name, (a, frame) in output.items():
            low, high = frame or (None, None)
            w = base.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
            columns[name] = a.over(Rows(self.df, F.lit(0)), w)
        return self._to(self.df.withColumns(columns))

    def densify(self, field: str, step: int, unit: str | None = None, partition_by: list[str] = (), bounds: tuple | None = None) -> Pipeline:
        """Rows for the missing values of a field, every step (of a unit of time), from the least to the greatest of a partition or between bounds (the end excluded)."""
        size = F.expr(f"interval {step} {unit}") if unit else F.lit(step)
        if bounds:
            low, high = (F.lit(b).cast(self.df.schema[field].dataType) for b in bounds)
            ends = (self.df.select(*partition_by).distinct() if partition_by else self.df.sparkSession.range(1).select()).select(*partition_by, F.explode(F.sequence(low, high - size, size)).alias(field))
        else:
            ends = self.df.groupBy(*partition_by).agg(F.min(field).alias("_lo"), F.max(field).alias("_hi")).where("_lo is not null").select(*partition_by, F.explode(F.sequence(F.col("_lo"), F.col("_hi"), size)).alias(field))
        missing = ends.join(self.df.select(*partition_by, field), [*partition_by, field], "left_anti")
        return self._to(self.df.unionByName(missing, allowMissingColumns=True), False)

    def fill(self, output: dict[str, Any], sort_by: dict[str, int] | None = None, partition_by: list[str] = ()) -> Pipeline:
        """Nulls of a field become a value ({'value': x}), the last before ('locf') or the straight line between neighbours ('linear')."""
        columns = {}
        for name, how in output.items():
            c = F.col(name)
            if isinstance(how, dict):
                columns[name] = F.coalesce(c, value(how["value"]))
                continue
            w = Window.partitionBy(*partition_by).orderBy(*_orders(sort_by))
            before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
            if how == "locf":
                columns[name] = F.last(c, ignorenulls=True).over(before)
            elif how == "linear":
                key = F.col(next(iter(sort_by)))
                at = F.unix_micros(key.cast("timestamp")).cast("double") if self.df.schema[next(iter(sort_by))].dataType.typeName().startswith(("timestamp", "date")) else key.cast("double")
                known = F.when(c.isNotNull(), F.struct(at.alias("x"), c.cast("double").alias("y")))
                a, b = F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)
                columns[name] = F.coalesce(c.cast("double"), a["y"] + F.try_divide((b["y"] - a["y"]) * (at - a["x"]), b["x"] - a["x"]))
            else:
                raise ValueError(f"unknown fill {how}")
        return self._to(self.df.withColumns(columns))

    def search(self, query: str, path: str, key: str, score: str = "score") -> Pipeline:
        """Rows with any word of the query, by BM25 score."""
        found = text.bm25(self.df, key, path, query).withColumnRenamed("score", score)
        return replace(self, df=self.df.join(found, key).orderBy(F.desc(score), key), sorted_by=((score, -1),))

    def search_meta(self, query: str, path: str, facet: str | None = None) -> Pipeline:
        """How many rows match: one row {count}, or one for each value of the facet."""
        rows = self.df.where(text.match_any(F.col(path), query))
        return self._to((rows.groupBy(facet) if facet else rows).agg(F.count(F.lit(1)).alias("count")), False)

    def vector_search(self, path: str, query_vector: list[float], limit: int, key: str) -> Pipeline:
        return replace(self, df=vector.vector_search(self.df, path, query_vector, limit, key), sorted_by=(("score", -1),))
