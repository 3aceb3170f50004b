"""Model collections: filters, includes, keyset paging, aggregates and variants over a contract.

Includes become joins with children that are grouped by parent first: one query, whatever the depth.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import Contract, Model, Relation, require
from ..functions.sql import Functions
from ..operators import mutate
from .select import Order

_NUMBERS = count()
_AGGREGATES = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


class ModelFields:
    """Columns of a model, and its relations with some, none and every."""

    def __init__(self, collection: Collection):
        self._c, self._related = collection, False

    def __getattr__(self, name: str) -> Any:
        return self[name]

    def __getitem__(self, name: str) -> Any:
        if name in self._c.model.relations:
            self._related = True
            return RelationFilter(self._c, self._c.model.relations[name])
        return F.col(name)


class RelationFilter:
    """Existence of related rows, as subqueries that become semi and anti joins."""

    def __init__(self, collection: Collection, relation: Relation):
        self.c, self.r = collection, relation

    def _related(self, predicate: Any, negate: bool = False) -> DataFrame:
        child = self.c.db.collection(self.r.to)
        rows = child.base().alias(child.alias)
        if predicate is not None:
            found = child._predicate(predicate)
            rows = rows.where(~found if negate else found)
        if self.r.through:
            junction = self.c.db.tables[self.r.through]
            keys = rows.select(*[F.col(t).alias(f"_t{i}") for i, (_, t) in enumerate(self.r.target_on)])
            on = [F.col(j) == F.col(f"_t{i}") for i, (j, _) in enumerate(self.r.target_on)]
            rows = junction.join(keys, reduce(lambda a, b: a & b, on), "left_semi")
        # by alias: a bare name of an outer column would be looked for in the subquery first
        return rows.where(reduce(lambda a, b: a & b, [F.col(t) == F.col(f"{self.c.alias}.{local}").outer() for local, t in self.r.on]))

    def some(self, predicate: Any = None) -> Column:
        return self._related(predicate).exists()

    def none(self, predicate: Any = None) -> Column:
        return ~self._related(predicate).exists()

    def every(self, predicate: Any) -> Column:
        """True without related rows; a row for which the predicate is null does not count against it."""
        return ~self._related(predicate, negate=True).exists()


@dataclass(frozen=True)
class Collection:
    """Immutable: every method returns a new collection. all() gives the DataFrame."""

    db: Database
    model: Model
    filters: tuple[Column, ...] = ()
    orders: tuple[Order, ...] = ()
    most: int | None = None
    skip_: int = 0
    columns: tuple[str, ...] | None = None
    includes: tuple[tuple[str, Any], ...] = ()
    unique: tuple[str, ...] = ()
    after: dict[str, Any] | None = None
    of_variant: str | None = None
    related: bool = False  # a filter looks at related rows
    alias: str = field(default_factory=lambda: f"_c{next(_NUMBERS)}")

    # the rows
    def base(self) -> DataFrame:
        """The model's rows: of one variant (its table joined), or of all (other variants' columns null)."""
        df, m = self.db.tables[self.model.table], self.model
        if self.of_variant:
            v = m.variant(self.of_variant)
            df = df.where(F.col(m.discriminator) == v.value)
            return df.join(self.db.tables[v.table], list(m.key)) if v.table else df
        for v in m.variants:
            if v.table:
                df = df.join(self.db.tables[v.table], list(m.key), "left")
        return df

    def _predicate(self, p: Any) -> Column:
        """A Column, a dict of equal values (None: is null), or a function of (fields, functions)."""
        if isinstance(p, Column):
            return p
        if isinstance(p, dict):
            fn, out = self.db.functions, F.lit(True)
            for k, v in p.items():
                if v is not None:
                    require(self.db.tables[self.model.table].schema[k].dataType if k in self.db.tables[self.model.table].columns else self.base().schema[k].dataType, "equality", "equality")
                out = out & fn.eq(F.col(k), v)
            return out
        return self._called(p, ModelFields(self))

    def _called(self, p: Callable[..., Column], f: ModelFields) -> Column:
        return p(f, self.db.functions) if p.__code__.co_argcount > 1 else p(f)

    def where(self, predicate: Any) -> Collection:
        if isinstance(predicate, Column | dict):
            return replace(self, filters=(*self.filters, self._predicate(predicate)))
        f = ModelFields(self)
        found = self._called(predicate, f)
        return replace(self, filters=(*self.filters, found), related=self.related or f._related)

    def order_by(self, column: str, direction: str = "asc", nulls: str | None = None) -> Collection:
        return replace(self, orders=(*self.orders, Order(column, direction, nulls)))

    def take(self, n: int) -> Collection:
        return replace(self, most=n)

    def skip(self, n: int) -> Collection:
        return replace(self, skip_=n)

    def select(self, *columns: str) -> Collection:
        """The last call counts. Without it: all scalar columns."""
        return replace(self, columns=columns)

    def distinct(self, *columns: str) -> Collection:
        """One row for each value of the columns: the first by order."""
        return replace(self, unique=columns)

    distinct_on = distinct

    def cursor(self, values: dict[str, Any]) -> Collection:
        """Rows after these values in the order; the order's columns must be given."""
        if values and not self.orders:
            raise ValueError("a cursor needs an order")
        return replace(self, after=values)

    def variant(self, name: str) -> Collection:
        self.model.variant(name)
        return replace(self, of_variant=name)

    def include(self, relation: str, refine: Callable[[Include], Include] | None = None) -> Collection:
        """The related rows as an array (to many) or a struct or null (to one), or what refine makes of them."""
        r = self.model.relations[relation]
        own = Include(self.db.collection(r.to))
        own = refine(own) if refine else own
        if own.branches and not r.to_many:
            raise ValueError("only to-many relations have aggregates")
        return replace(self, includes=(*self.includes, (relation, own)))

    def _after(self) -> Column:
        """Lexicographic: greater in the first column, or equal there and greater in the next, and so on."""
        given = [o for o in self.orders if o.column in self.after]
        out, equal = F.lit(False), F.lit(True)
        for o in given:
            c, v = F.col(o.column), F.lit(self.after[o.column])
            out = out | (equal & ((c > v) if o.direction == "asc" else (c < v)))
            equal = equal & (c == v)
        return out

    def _order(self) -> list[Column]:
        return [o.on(F.col(o.column)) for o in self.orders]

    def _filtered(self) -> DataFrame:
        df = self.base().alias(self.alias)
        for p in self.filters:
            df = df.where(p)
        return df.where(self._after()) if self.after else df

    def _unique(self, df: DataFrame, within: list[str] = ()) -> DataFrame:
        if not self.unique:
            return df
        order = self._order() or [F.col(k) for k in (*self.unique, *self.model.key)]
        w = Window.partitionBy(*within, *self.unique).orderBy(*order)
        return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")

    def all(self) -> DataFrame:
        df = self._unique(self._filtered())
        scalars = list(self.columns or [c for c in df.columns])
        if self.orders:
            df = df.orderBy(*self._order())
        if self.skip_:
            df = df.offset(self.skip_)
        if self.most is not None:
            df = df.limit(self.most)
        for relation, include in self.includes:
            df = include.join(df, self.model.relations[relation], relation)
        if self.includes and self.orders:
            df = df.orderBy(*self._order())  # joins do not keep order
        return df.select(*scalars, *[r for r, _ in self.includes])

    def first(self) -> Any:
        return self.take(1).all().first()

    # aggregates
    def aggregate(self, **spec: tuple[str, str | None]) -> DataFrame:
        """One row: alias=('sum', 'column') and so on; count takes no column."""
        if not spec:
            raise ValueError("aggregate needs a selector")
        return self._filtered().agg(*[_AGGREGATES[f](F.col(c) if c else None).alias(k) for k, (f, c) in spec.items()])

    def count(self) -> int:
        return self.aggregate(n=("count", None)).first().n

    def group_by(self, *keys: str) -> Grouped:
        return Grouped(self, keys)

    # mutations
    def create(self, **row: Any) -> mutate.Changed:
        return self.create_all([row])

    def create_all(self, rows: list[dict[str, Any]]) -> mutate.Changed:
        """One table's append; the rows of a variant with its own table go to both."""
        v = self.model.variant(self.of_variant) if self.of_variant else None
        if v:
            rows = [r | {self.model.discriminator: v.value} for r in rows]
        base = self.db.tables[self.model.table]
        if v and v.table:
            own = self.db.tables[v.table]
            self.db.tables[v.table] = mutate.insert(own, [{k: x for k, x in r.items() if k in own.columns} for r in rows]).table
            rows = [{k: x for k, x in r.items() if k in base.columns} for r in rows]
        return self._publish(mutate.insert(base, rows, self.model.defaults))

    def _publish(self, changed: mutate.Changed) -> mutate.Changed:
        """The table changes; the affected rows come with the collection's columns and includes."""
        table = changed.table.drop("_hit")
        rows = changed.rows.drop("_hit").alias(self.alias)
        for relation, include in self.includes:
            rows = include.join(rows, self.model.relations[relation], relation)
        if self.columns or self.includes:
            rows = rows.select(*(self.columns or table.columns), *[r for r, _ in self.includes])
        self.db.tables[self.model.table] = table
        return mutate.Changed(table, rows)

    def _target(self) -> tuple[DataFrame, Column]:
        """The table and a predicate for the rows to change. Filters on relations are looked up once, and joined by key."""
        table, filters = self.db.tables[self.model.table], list(self.filters)
        if self.of_variant:
            filters.append(F.col(self.model.discriminator) == self.model.variant(self.of_variant).value)
        if not self.related:
            return table, reduce(lambda a, b: a & b, filters, F.lit(True))
        keys = self._filtered().select(*[F.col(k) for k in self.model.key]).distinct().withColumn("_hit", F.lit(True))
        return table.join(keys, list(self.model.key), "left").select(*table.columns, "_hit"), F.col("_hit")

    def update(self, **values: Any) -> mutate.Changed:
        """One row, even if several match."""
        table, where = self._target()
        return self._publish(mutate.update_one(table, values, where, list(self.model.key)))

    def update_all(self, **values: Any) -> mutate.Changed:
        table, where = self._target()
        return self._publish(mutate.update(table, values, where))

    def delete(self) -> mutate.Changed:
        table, where = self._target()
        return self._publish(mutate.delete_one(table, where, list(self.model.key)))

    def delete_all(self) -> mutate.Changed:
        table, where = self._target()
        return self._publish(mutate.delete(table, where))

    def upsert(self, create: dict[str, Any], update: dict[str, Any], on: list[str] | None = None) -> mutate.Changed:
        return self._publish(mutate.upsert(self.db.tables[self.model.table], create, update, on or list(self.model.key), self.model.defaults))

    def create_nested(self, row: dict[str, Any], **related: dict[str, list]) -> None:
        """The row, and for each relation {'create': rows} (which may nest by the same words), {'connect': keys} or {'disconnect': keys}; all or nothing."""
        with self.db.transaction() as tx:
            inner = Database(self.db.spark, self.db.contract, tx, self.db.functions)
            inner.collection(self.model.name).create(**row)
            for name, change in related.items():
                inner._relate(self.model, row, name, change)


@dataclass(frozen=True)
class Include:
    """A refined relation: where, select, order_by, take, skip, distinct and include of the child; or aggregates; or several of these."""

    child: Collection
    branches: tuple[tuple[str, Any], ...] = ()  # ('', (function, column)) for one scalar, or named branches

    def __getattr__(self, name: str) -> Callable[..., Include]:
        if name in ("where", "select", "order_by", "take", "skip", "distinct", "include", "variant"):
            return lambda *a, **k: replace(self, child=getattr(self.child, name)(*a, **k))
        raise AttributeError(f"an include has no {name}")

    def count(self) -> Include:
        return replace(self, branches=(("", ("count", None)),))

    def sum(self, column: str) -> Include:
        return replace(self, branches=(("", ("sum", column)),))

    def avg(self, column: str) -> Include:
        return replace(self, branches=(("", ("avg", column)),))

    def min(self, column: str) -> Include:
        return replace(self, branches=(("", ("min", column)),))

    def max(self, column: str) -> Include:
        return replace(self, branches=(("", ("max", column)),))

    def combine(self, **branches: Include) -> Include:
        return replace(self, branches=tuple(branches.items()))

    def join(self, parents: DataFrame, r: Relation, name: str) -> DataFrame:
        if self.branches and self.branches[0][0]:
            parts = []
            for i, (part, own) in enumerate(self.branches):
                parents = own.join(parents, r, f"_{name}{i}")
                parts.append((part, f"_{name}{i}"))
            return parents.withColumn(name, F.struct(*[F.col(c).alias(p) for p, c in parts])).drop(*[c for _, c in parts])
        keys = [f"_{name}_k{i}" for i in range(len(r.on))]
        scalar = self.branches[0][1] if self.branches else None
        c = self.child
        rows = c._filtered()
        for relation, include in c.includes:
            rows = include.join(rows, c.model.relations[relation], relation)
        shown = [*(c.columns or c.base().columns), *[n for n, _ in c.includes]]
        if r.through:
            links = c.db.tables[r.through].select(*[F.col(j).alias(k) for k, (_, j) in zip(keys, r.on, strict=True)], *[F.col(j).alias(f"_j{i}") for i, (j, _) in enumerate(r.target_on)])
            rows = rows.join(links, reduce(lambda a, b: a & b, [F.col(t) == F.col(f"_j{i}") for i, (_, t) in enumerate(r.target_on)]))
        else:
            rows = rows.withColumns({k: F.col(t) for k, (_, t) in zip(keys, r.on, strict=True)})
        match = reduce(lambda a, b: a & b, [F.col(local) == F.col(k) for k, (local, _) in zip(keys, r.on, strict=True)])
        if scalar:
            f, column = scalar
            one = rows.groupBy(*keys).agg(_AGGREGATES[f](F.col(column) if column else None).alias(name))
            out = parents.join(one, match, "left").drop(*keys)
            return out.withColumn(name, F.coalesce(name, F.lit(0))) if f == "count" else out
        if not r.to_many:
            one = rows.select(*keys, F.struct(*shown).alias(name))
            return parents.join(one, match, "left").drop(*keys)
        rows = c._unique(rows, keys)
        order = c._order() or [F.col(k) for k in c.model.key]
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        if c.skip_:
            rows = rows.where(F.col("_nth") > c.skip_)
        if c.most is not None:
            rows = rows.where(F.col("_nth") <= c.skip_ + c.most)
        listed = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", F.struct(*shown).alias("row")))), lambda x: x["row"]).alias(name))
        out = parents.join(listed, match, "left").drop(*keys)
        return out.withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))


@dataclass(frozen=True)
class Grouped:
    """Groups with having (calls are ANDed) and aggregates."""

    collection: Collection
    keys: tuple[str, ...]
    conditions: tuple[tuple, ...] = ()

    def having(self, function: str, column: str | None, op: str, number: Any) -> Grouped:
        """An aggregate against a literal: op is eq, neq, gt, lt, gte or lte."""
        if op not in ("eq", "neq", "gt", "lt", "gte", "lte") or isinstance(number, Column):
            raise ValueError("having compares an aggregate with a literal")
        return replace(self, conditions=(*self.conditions, (function, column, op, number)))

    def aggregate(self, **spec: tuple[str, str | None]) -> DataFrame:
        hidden = [_AGGREGATES[f](F.col(c) if c else None).alias(f"_h{i}") for i, (f, c, _, _) in enumerate(self.conditions)]
        shown = [_AGGREGATES[f](F.col(c) if c else None).alias(k) for k, (f, c) in spec.items()]
        df = self.collection._filtered().groupBy(*self.keys).agg(*shown, *hidden)
        for i, (_, _, op, n) in enumerate(self.conditions):
            h = F.col(f"_h{i}")
            df = df.where({"eq": h == n, "neq": h != n, "gt": h > n, "lt": h < n, "gte": h >= n, "lte": h <= n}[op])
        return df.select(*self.keys, *spec)


@dataclass
class Database:
    """Tables by name and the contract over them. Mutations replace tables here; nothing is written."""

    spark: Any
    contract: Contract
    tables: Any
    functions: Functions = field(default_factory=Functions)
    collections: dict[str, type] = field(default_factory=dict)

    def collection(self, model: str) -> Collection:
        """The model's collection, of its own class if one is registered."""
        return self.collections.get(model, Collection)(self, self.contract.model(model))

    def transaction(self) -> mutate.Transaction:
        return mutate.Transaction(self.tables)

    def _relate(self, parent: Model, row: dict[str, Any], name: str, change: dict[str, list]) -> None:
        r = parent.relations[name]
        child = self.contract.model(r.to)
        link = {t: row[local] for local, t in r.on}
        for new in change.get("create", ()):
            nested = {k: new[k] for k in new if k in child.relations}
            plain = {k: v for k, v in new.items() if k not in nested}
            plain = plain if r.through else plain | link
            self.collection(r.to).create(**plain)
            for k, v in nested.items():
                self._relate(child, plain, k, v)
            if r.through:
                self.tables[r.through] = mutate.insert(self.tables[r.through], [link | {j: plain[t] for j, t in r.target_on}]).table
        for key in change.get("connect", ()):
            if r.through:
                self.tables[r.through] = mutate.insert(self.tables[r.through], [link | {j: key[t] for j, t in r.target_on}]).table
            else:
                self.collection(r.to).where(key).update_all(**link)
        for key in change.get("disconnect", ()):
            if r.through:
                same = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in (link | {j: key[t] for j, t in r.target_on}).items()])
                self.tables[r.through] = mutate.delete(self.tables[r.through], same).table
            else:
                self.collection(r.to).where(key).update_all(**dict.fromkeys(link))
